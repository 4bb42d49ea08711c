"""Column helpers that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that stand for an absent value
ABSENT = ["N/A", "NA", "NONE", "NULL", "TBD"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_present(c: str | Column) -> Column:
    """Not null, not blank and no sentinel for 'absent' (in any case)."""
    c = col(c)
    return c.isNotNull() & (F.trim(c) != "") & ~F.upper(F.trim(c)).isin(ABSENT)


def first_present(*cs: str | Column) -> Column:
    return F.coalesce(*[F.when(is_present(c), col(c)) for c in cs])


def coalesce_text(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


def ratio(num: str | Column, den: str | Column, digits: int = 6) -> Column:
    """num / den rounded, 0 where den is 0 or null."""
    return F.coalesce(F.round(F.try_divide(col(num), col(den)), digits), F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def weighted_mean(parts: Sequence[tuple[Column, float]], default: float = 0.0) -> Column:
    """Mean of the non-null scores under their weights; ``default`` if all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) * w for s, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts])
    return F.when(weight > 0, total / weight).otherwise(F.lit(default))


def parts(c: str | Column) -> Column:
    return F.split(col(c), "[.]")


def segments(c: str | Column) -> Column:
    """Number of dotted segments."""
    return F.size(parts(c))


def name_prefixes(c: str | Column) -> Column:
    """All dotted prefixes of a name, the longest first, the name itself included."""
    p = parts(c)
    return F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "."))


def access_modifier(c: str | Column) -> Column:
    """private (``__x``), protected (``_x``) or public; dunder names are public."""
    c = col(c)
    return F.when(c.startswith("__") & ~c.endswith("__"), "private").when(c.startswith("_") & ~c.startswith("__"), "protected").otherwise("public")


def normalize_for_match(c: str | Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def token_count(c: str | Column) -> Column:
    t = F.trim(F.regexp_replace(coalesce_text(c), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def occurrences(text: str | Column, needle: str | Column) -> Column:
    """Non-overlapping occurrences of a literal needle; 0 for an empty one."""
    t, n = coalesce_text(text), coalesce_text(needle)
    return F.when(F.length(n) > 0, ((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("long")).otherwise(F.lit(0).cast("long"))


def module_from_path(path: str | Column) -> Column:
    """Dotted module of a file path in any spelling; ``__init__`` names its package."""
    p = F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^(\./)+|/+$", "")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"\.(pyi?|mjs|js|json|toml)$", "")
    return F.replace(F.regexp_replace(p, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def cosine(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def type_tokens(c: str | Column) -> Column:
    """Distinct lower-case word tokens of a type text, without or/and/of."""
    words = F.filter(F.split(F.lower(coalesce_text(c)), "[^a-z0-9_]+"), lambda x: x != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(x) for x in ("or", "and", "of")]))
