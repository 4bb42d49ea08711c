"""Addresses of documentation pages: names in them, scope, anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.columns import col

# fixed values: endings and folders that are no part of a name, pages that name nothing, endings of files that are no pages
ENDINGS = r"\.(html?|php|aspx?)$"
FOLDERS = ["generated", "api", "reference", "modules", "_modules"]
NO_NAMES = ["index", "genindex", "modindex", "py-modindex", "search", "contents", "changelog"]
NO_PAGES = r"(?i)\.(png|jpe?g|gif|svg|css|js|zip|gz|pdf|ico|xml|json|txt)$"


def clean_name(c: str | Column) -> Column:
    """A dotted name of identifiers: dots squeezed, other characters and parts that do not begin like a name dropped; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"\.{2,}", "."), r"^\.+|\.+$", "")
    good = t.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*(\.[a-zA-Z_][a-zA-Z0-9_]*)*$")
    kept = F.filter(F.transform(F.split(t, "[.]"), lambda x: F.regexp_replace(x, "[^a-zA-Z0-9_]", "")), lambda x: x.rlike("^[a-zA-Z_]"))
    return F.nullif(F.when(good, t).otherwise(F.array_join(kept, ".")), F.lit(""))


def api_name(url: str | Column, prefix: str | Column = "") -> Column:
    """The name a page's address stands for: its fragment, else its path below ``prefix`` (else its last part) without ending and folders; ``-`` and ``/`` count as dots; null for indexes."""
    u = col(url)
    pre = F.lit(prefix) if isinstance(prefix, str) else prefix
    fragment = F.nullif(F.split_part(u, F.lit("#"), F.lit(2)), F.lit(""))
    path = F.try_url_decode(F.regexp_replace(F.split_part(F.split_part(u, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"^https?://[^/]*", ""))
    rest = F.when(path.startswith(pre) & (pre != ""), F.regexp_replace(F.substring(path, F.length(pre) + 1, F.length(path)), "^/+", "")).when(pre == "", F.regexp_replace(path, "^/+", "")).otherwise(F.element_at(F.split(path, "/"), -1))
    rest = F.regexp_replace(rest, ENDINGS, "")
    for folder in FOLDERS:
        rest = F.regexp_replace(rest, rf"^{folder}[/.]", "")
    low = F.lower(rest)
    none = F.element_at(F.split(low, "/"), -1).isin(*NO_NAMES)
    dots = lambda c: F.translate(c, "-/", "..")
    return F.when(fragment.isNotNull(), clean_name(F.try_url_decode(F.translate(fragment, "-", ".")))).when(~none, clean_name(dots(rest)))


def is_relevant(url: str | Column, base: str | Column, sub: str | Column) -> Column:
    """Is a page in scope: the base itself, the page or folder ``sub`` below it, or one page right in that folder?"""
    u, b, s = col(url), F.regexp_replace(col(base), "/+$", ""), col(sub)
    page = F.split_part(u, F.lit("#"), F.lit(1))
    rest = F.regexp_replace(F.substring(page, F.length(b) + 1, F.length(page)), "^/+|/+$", "")
    tail = F.substring(rest, F.length(s) + 2, F.length(rest))
    single = F.lower(s).endswith(".html")
    inside = rest.startswith(F.concat(s, F.lit("/"))) & ~tail.contains("/") & F.lower(tail).endswith(".html") & ~tail.rlike("^(genindex|modindex|search)")
    return page.startswith(b) & ((F.regexp_replace(u, "/+$", "") == b) | (F.lower(rest) == F.lower(s)) | (~single & inside))


def is_page(url: str | Column) -> Column:
    return ~F.split_part(F.split_part(col(url), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)).rlike(NO_PAGES)


def well_formed(url: str | Column) -> Column:
    """At most one ``#``, and behind it a dotted name."""
    u = col(url)
    n = F.regexp_count(u, F.lit("#"))
    return (n == 0) | ((n == 1) & F.split_part(u, F.lit("#"), F.lit(2)).contains("."))


def page_stem(url: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.split_part(col(url), F.lit("#"), F.lit(1)), "/"), -1), r"\.html?$", "")


def module_parts(url: str | Column) -> Column:
    """The parts of a page's name at dots and underscores, in lower case."""
    return F.filter(F.split(F.lower(page_stem(url)), "[._]"), lambda x: x != "")


def anchor_fits(url: str | Column, reference: str | Column) -> Column:
    """Does an anchor belong on a page: the page's own name, or at most two parts below it, whatever package is written in front?"""
    plain, split = F.lower(page_stem(url)), F.array_join(module_parts(url), ".")
    ref = F.lower(col(reference))
    module = F.when(plain.contains("_") & F.contains(ref, plain), plain).otherwise(split)
    dotted = F.concat(F.lit("."), module, F.lit("."))
    below = F.substring(ref, F.length(module) + 2, F.length(ref))
    parts = lambda c: F.size(F.filter(F.split(c, "[.]"), lambda x: x != ""))
    at = F.instr(ref, dotted)
    inner = F.substring(ref, at + F.length(dotted), F.length(ref))
    fits = F.when(ref == module, True).when(ref.startswith(F.concat(module, F.lit("."))), parts(below) <= 2).when(at > 0, parts(inner) <= 2).otherwise(ref.endswith(F.concat(F.lit("."), module)))
    return F.coalesce(ref.contains(".") & fits, F.lit(False))


def retry_after(header: str | Column) -> Column:
    """Seconds a Retry-After header asks to wait, as a number or up to a date from now; null if it is neither."""
    h = F.trim(col(header))
    date = F.try_to_timestamp(F.regexp_replace(h, r"^\w{3},\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    left = (F.unix_timestamp(date) - F.unix_timestamp(F.current_timestamp())).cast("double")
    return F.coalesce(h.try_cast("double"), F.when(date.isNotNull(), F.greatest(F.lit(0.0), left)))


def next_delay(delay: Column, asked: Column, most: float = 6.0) -> Column:
    """The delay after a refusal: what was asked for, else twice the last one, up to a bound."""
    return F.least(F.lit(most), F.when(asked.isNotNull(), F.greatest(delay, asked)).otherwise(delay * 2))
