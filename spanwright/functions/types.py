"""Types as texts: one spelling for equal ones, tokens, equivalence, and what is built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.functions.columns import coalesce_text, col

# fixed values: other spellings of types, in the order they are replaced
ALIASES = [("integer", "int"), ("string", "str"), ("boolean", "bool"), ("floating-point", "float"), ("floating point", "float"), ("nonetype", "none"), ("none type", "none"), ("array-like", "array_like"), ("arraylike", "array_like")]
# fixed values: containers whose brackets become "of"
CONTAINERS = ["list", "tuple", "dict", "sequence", "iterable", "set"]
# fixed values: names of built-in types
BUILTINS = ["int", "str", "bool", "float", "list", "dict", "tuple", "set", "bytes", "bytearray", "frozenset", "complex", "none", "object", "type", "callable"]
SPLIT = r"\b(?:or|and|of)\b|[\s,;:|]+"
DROPPED = ["", "or", "and", "of"]


def _unions(s: Column) -> Column:
    """``union[a, b]`` without brackets inside as ``a or b``."""
    pieces = F.split(s, r"union\[")

    def rest(p: Column) -> Column:
        end = F.instr(p, "]")
        inner = F.substring(p, F.lit(1), end - 1)
        plain = (end > 1) & ~inner.contains("[")
        joined = F.array_join(F.transform(F.split(inner, ","), lambda x: F.trim(x)), " or ")
        return F.when(plain, F.concat(joined, F.substring(p, end + 1, F.length(p)))).otherwise(F.concat(F.lit("union["), p))

    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), rest), ""))


def normalize(c: str | Column) -> Column:
    """The type in one spelling, '' for null, blank and N/A: links give way to their labels, ``, optional`` and Optional[X]
    become ``or none``, unions ``or``, containers ``of``, aliases their short names."""
    raw = F.trim(coalesce_text(col(c)))
    s = F.lower(raw)
    for old, new in ((r"\[([^\]]+)\]\((https?://[^)]+)\)", "$1"), (r"\((https?://[^)]+)\)", ""), (r"url_placeholder_\d+", ""), (r"\(\s*\)", ""), (r"\s*,\s*optional\b(?!\s*\[)|\s+optional\b(?!\s*\[)", " or none"), (r"\s*,?\s*\b(required|default)\b", ""), (r"optional\[(.+?)\]", "$1 or none")):
        s = F.regexp_replace(s, old, new)
    s = _unions(s)
    for name in CONTAINERS:
        s = F.regexp_replace(s, name + r"\[(.+?)\]", name + " of $1")
    s = F.regexp_replace(s, r"\s*\|\s*", " or ")
    for old, new in ALIASES:
        s = F.regexp_replace(s, rf"\b{old}\b", new)
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^[ ,;:]+|[ ,;:]+$", "")
    return F.when(F.upper(raw).isin("", "N/A", "NA", "NONE TYPE"), "").otherwise(s)


def normalize_sql(x: str) -> str:
    """The same in SQL, for oracles."""
    s = f"lower(trim(coalesce({x}, ''), ' '))"
    for old, new in ((r"\[([^\]]+)\]\((https?://[^)]+)\)", r"\1"), (r"\((https?://[^)]+)\)", ""), (r"url_placeholder_\d+", ""), (r"\(\s*\)", ""), (r"optional(\s*)\[", r"OPTIONAL\1["), (r"\s*,\s*optional\b|\s+optional\b", " or none"), (r"OPTIONAL(\s*)\[", r"optional\1["), (r"\s*,?\s*\b(required|default)\b", ""), (r"optional\[(.+?)\]", r"\1 or none")):
        s = f"regexp_replace({s}, '{old}', '{new}', 'g')"
    s = f"list_transform([string_split({s}, 'union[')], lambda w: w[1] || array_to_string(list_transform(w[2:], lambda p: CASE WHEN strpos(p, ']') > 1 AND NOT contains(p[1:strpos(p, ']') - 1], '[') THEN array_to_string(list_transform(string_split(p[1:strpos(p, ']') - 1], ','), lambda q: trim(q, ' ')), ' or ') || p[strpos(p, ']') + 1:] ELSE 'union[' || p END), ''))[1]"
    for name in CONTAINERS:
        s = f"regexp_replace({s}, '{name}\\[(.+?)\\]', '{name} of \\1', 'g')"
    s = f"regexp_replace({s}, '\\s*\\|\\s*', ' or ', 'g')"
    for old, new in ALIASES:
        s = f"regexp_replace({s}, '\\b{old}\\b', '{new}', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '\\s+', ' ', 'g'), '^[ ,;:]+|[ ,;:]+$', '', 'g')"
    return f"CASE WHEN upper(trim(coalesce({x}, ''), ' ')) IN ('', 'N/A', 'NA', 'NONE TYPE') THEN '' ELSE {s} END"


def tokens(normal: Column) -> Column:
    """Distinct tokens of a normalised type without its operators."""
    return F.array_distinct(F.filter(F.split(normal, SPLIT), lambda x: ~x.isin(*DROPPED)))


def tokens_sql(normal: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({normal}, '{SPLIT}'), lambda x: x NOT IN ('', 'or', 'and', 'of')))"


def equivalent(a: Column, b: Column, least: float = 0.8) -> Column:
    """Are two normalised types equal, or their tokens alike to ``least`` (Jaccard)?  An absent one equals only an absent one."""
    ta, tb = tokens(a), tokens(b)
    like = F.size(F.array_intersect(ta, tb)) >= least * F.size(F.array_union(ta, tb))
    return (a == b) | ((a != "") & (b != "") & (F.size(ta) > 0) & (F.size(tb) > 0) & like)


def is_builtin(normal: Column) -> Column:
    t = tokens(normal)
    return (F.size(t) > 0) & (F.size(F.array_except(t, F.array(*[F.lit(x) for x in BUILTINS]))) == 0)
