"""Text, signature and URL helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.columns import clamp, coalesce_text, col


def strip_noise_tokens(c: str | Column) -> Column:
    """Without page references, bracketed URLs, the keyword-only note and pilcrows."""
    t = coalesce_text(c)
    for p in (r"\(#page=[0-9]+\)", r"\(https?://[^)]*\)", r"\(PEP ?3102[^)]*\)", "¶"):
        t = F.regexp_replace(t, p, "")
    return F.trim(t)


def looks_like_code(c: str | Column) -> Column:
    """A prompt, a bullet, or an assignment before the first bracket."""
    t = F.trim(coalesce_text(c))
    eq, br = F.instr(t, "="), F.instr(t, "(")
    return t.rlike(r"^(>>>|\.\.\.|[-*+] )") | ((eq > 0) & ((br == 0) | (eq < br)))


def first_variant(signatures: str | Column) -> Column:
    """full, else no_types, else default of a variant map."""
    m = col(signatures)
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in ("full", "no_types", "default")])


def normalize_signature(c: str | Column) -> Column:
    """Lower case, without URLs, square brackets, quotes and spaces."""
    t = F.regexp_replace(F.lower(coalesce_text(c)), r"https?://\S+", "")
    return F.regexp_replace(t, r"[\s\[\]'\"`]+", "")


def signature_has_params(c: str | Column) -> Column:
    return coalesce_text(c).rlike(r"\(\s*[^)\s]")


def no_user_params(c: str | Column) -> Column:
    """No parameters but self or cls."""
    return coalesce_text(c).rlike(r"\(\s*((self|cls)\s*)?\)")


def length_penalty(n: Column, low: int = 500, high: int = 15000, most: float = 0.15) -> Column:
    """0 up to ``low`` characters, rising evenly to ``most`` at ``high``."""
    return F.round(clamp((n - low) / (high - low) * most, 0.0, most), 6)


def hybrid_score(exact: Column, fuzzy: Column, semantic: Column, penalty: Column, we: float = 0.5, ws: float = 0.5) -> Column:
    return we * exact + 0.01 * fuzzy + ws * semantic - penalty


def dehyphenate(c: str | Column) -> Column:
    """Words wrapped at a hyphen joined; prefixes that keep theirs stay."""
    t = F.regexp_replace(coalesce_text(c), r"\b(non|self|pre|re|co|multi)-\n\s*", "$1-")
    return F.regexp_replace(t, r"([A-Za-z])-\n\s*([a-z])", "$1$2")


def sanitize(c: str | Column) -> Column:
    """No control characters; runs of eighty spaces or twenty tabs become one."""
    t = F.regexp_replace(coalesce_text(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(F.regexp_replace(t, " {80,}", " "), "\t{20,}", "\t")


def looks_degenerate(c: str | Column) -> Column:
    """More than fifty control characters, or one character a hundred times in a row that is one."""
    t = coalesce_text(c)
    return (F.regexp_count(t, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")) > 50) | t.rlike(r"([\x00-\x08\x0b\x0c\x0e-\x1f])\1{99,}")


def typography(c: str | Column) -> Column:
    """Curly quotes, dashes and special spaces as plain ones."""
    return F.translate(coalesce_text(c), "‘’“”–—  ", "''\"\"--  ")


def artifact_stem(name: str | Column, kind: str | Column, shared: Column) -> Column:
    """A safe file stem; names that collide in case get their kind appended."""
    safe = F.regexp_replace(coalesce_text(name), r"[^A-Za-z0-9_.-]", "_")
    return F.when(shared, F.concat_ws("-", safe, col(kind))).otherwise(safe)


def clean_api_name(c: str | Column) -> Column:
    """Single dots, only identifier characters, no empty or numeric-led segments."""
    t = F.regexp_replace(F.regexp_replace(coalesce_text(c), r"[^A-Za-z0-9_.]", ""), r"\.{2,}", ".")
    good = F.filter(F.split(t, "[.]"), lambda x: x.rlike("^[A-Za-z_]"))
    return F.array_join(good, ".")


def link_count(c: str | Column) -> Column:
    """Markdown links and bare URLs."""
    t = coalesce_text(c)
    md = F.regexp_count(t, F.lit(r"\[[^\]]+\]\([^)]+\)"))
    return md + F.regexp_count(F.regexp_replace(t, r"\[[^\]]+\]\([^)]+\)", ""), F.lit(r"https?://\S+"))


def strip_links(c: str | Column) -> Column:
    """Links as their visible text."""
    return F.regexp_replace(F.regexp_replace(coalesce_text(c), r"\[([^\]]+)\]\([^)]+\)", "$1"), r"https?://\S+", "")


# fixed values: punctuation as plain signs, prefixes that keep their hyphen, what placeholders look like
PLAIN = {"\u2022": "-", "\u2023": "-", "\u25e6": "-", "\u2043": "-", "\u2219": "-", "\u00b7": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u00a0": " ", "\u202f": " ", "\u2009": " "}
KEEP_HYPHEN = "non|self|multi|inter|intra|anti|pre|post|sub|re|co|un|well|high|low|cross|meta|semi|pseudo"
LINK_TARGET = r"\((https?://[^)\s]+|#page=\d+)\)"


def with_placeholders(c: str | Column) -> Column:
    """struct<text, urls>: links in brackets and page references replaced by ``url_placeholder_k`` in their order, urls[k] being what stood there."""
    t = coalesce_text(c)
    urls = F.regexp_extract_all(t, F.lit(LINK_TARGET), 1)
    pieces = F.split(t, LINK_TARGET)
    body = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("(url_placeholder_"), (i - 1).cast("string"), F.lit(")"), p))), "")
    return F.struct(body.alias("text"), urls.alias("urls"))


def restored(text: Column, urls: Column) -> Column:
    """The text with its placeholders as addresses again, the longest placeholders first, so that _1 never hits _10; unknown ones stay."""
    order = F.reverse(F.sequence(F.lit(0), F.greatest(F.size(urls) - 1, F.lit(0))))
    return F.when(F.size(urls) > 0, F.aggregate(order, text, lambda acc, k: F.replace(acc, F.concat(F.lit("url_placeholder_"), k.cast("string")), F.element_at(urls, k + 1)))).otherwise(text)


def plain_typography(c: str | Column) -> Column:
    """Bullets, dashes, quotes and special spaces as plain signs, an ellipsis as three stops."""
    return F.replace(F.translate(coalesce_text(c), "".join(PLAIN), "".join(PLAIN.values())), F.lit("\u2026"), F.lit("..."))


def joined_words(c: str | Column) -> Column:
    """Words wrapped at a hyphen joined; after prefixes that keep theirs the hyphen stays."""
    t = F.regexp_replace(coalesce_text(c), rf"(?i)\b({KEEP_HYPHEN})-\n[ \t]*(\w)", "$1-$2")
    return F.regexp_replace(t, r"(\w+)-\n[ \t]*(\w)", "$1$2")


def squeezed_blank_lines(c: str | Column, most: int = 2) -> Column:
    """At most so many blank lines in a row."""
    return F.regexp_replace(coalesce_text(c), r"((?:^|\n)(?:[ \t]*\n){%d})(?:[ \t]*\n)+" % most, "$1")


IDENTIFIER = r"([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)*)"


def identifiers(c: str | Column) -> Column:
    """All identifiers of a text, dotted ones whole; ASCII letters only, so they end where other scripts begin."""
    return F.regexp_extract_all(coalesce_text(c), F.lit(IDENTIFIER), 1)


def capwords(c: str | Column) -> Column:
    """Distinct CapWord identifiers."""
    return F.array_distinct(F.filter(identifiers(c), lambda x: x.rlike("^([A-Z][a-z0-9]+){2,}$")))


def xref_candidates(c: str | Column) -> Column:
    """Distinct identifiers that may be references: dotted ones that start in lower case, and CapWords."""
    return F.array_distinct(F.filter(identifiers(c), lambda x: x.rlike("^([a-z_][A-Za-z0-9_]*([.][A-Za-z0-9_]+)+|([A-Z][a-z0-9]+){2,})$")))


def doc_default(c: str | Column) -> Column:
    """What a description gives as the default, or null."""
    v = F.regexp_extract(coalesce_text(c), r"(?i)\bdefaults?(?: to|:| is)?\s+[`'\"]?([\w.+-]+)", 1)
    return F.when(v != "", F.regexp_replace(v, r"[.]$", ""))


def defaults_match(a: str | Column, b: str | Column) -> Column:
    """Equal without quotes and case, or equal as numbers."""
    clean = lambda c: F.lower(F.regexp_replace(F.trim(coalesce_text(c)), r"^['\"]|['\"]$", ""))
    x, y = clean(a), clean(b)
    return (x == y) | F.coalesce(x.try_cast("double") == y.try_cast("double"), F.lit(False))


def failure_cause(name: str | Column) -> Column:
    """A guess why a name was not found."""
    n = coalesce_text(name)
    p = F.split(n, "[.]")
    last = F.element_at(p, -1)
    any_of = lambda *xs: F.exists(p, lambda x: x.isin(*xs))
    constant = ((F.upper(last) == last) & last.rlike(r"\p{Lu}")) | last.startswith("TYPE_")
    return F.when(n.startswith("_"), "private_api").when(F.exists(p, lambda x: x.startswith("_")), "internal_module").when(any_of("test", "tests", "testing"), "test_code").when(any_of("example", "examples", "demo"), "example_code").when(constant, "type_alias_or_constant").otherwise("unknown")


def stem_parts(c: str | Column) -> Column:
    """struct<name, kind> of a file stem: a known kind behind the last ``-`` is taken off, else kind is null."""
    kind = F.regexp_extract(coalesce_text(c), r"-(class|function|method|variable|property|module)$", 1)
    return F.struct(F.regexp_replace(coalesce_text(c), r"-(class|function|method|variable|property|module)$", "").alias("name"), F.nullif(kind, F.lit("")).alias("kind"))


def retry_reason(payload: str | Column, finish: str | Column) -> Column:
    """Why a generated document should be asked for again: cut off, empty, degenerate, or no JSON object or list; null if it is fine."""
    p = col(payload)
    return F.when(col(finish) == "length", "truncated").when(p.isNotNull() & (F.trim(p) != ""), F.when(looks_degenerate(p), "degenerate").when(~p.rlike(r"^\s*[{\[]") | F.try_parse_json(sanitize(p)).isNull(), "no_json")).otherwise("empty")


def tolerant_json(c: str | Column) -> Column:
    """The JSON value of a text: as it is, else without control characters and a fence around it; null if neither is one."""
    bare = F.regexp_replace(F.trim(sanitize(c)), r"^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(col(c)), F.try_parse_json(bare))
