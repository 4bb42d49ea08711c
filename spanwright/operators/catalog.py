"""The relational catalogue: current rows, look-ups, joins and counts over modules, members, exports and inherited members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.columns import is_present, name_prefixes, segments


def current(members: DataFrame, *columns: str) -> DataFrame:
    """(id, columns): each member's row of the latest ``ingested_at``.

    Ties go to the greatest digest of the docstring, public name and format; the
    digest stands for the text, so docstrings are shuffled only where they are asked for.
    """
    latest = F.struct("ingested_at", F.md5(F.coalesce("docstring", F.lit(""))).alias("d"), "primary_api_name", "doc_format")
    return members.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*columns), latest).alias("r")).select("id", "r.*")


def once(df: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """(key, columns) with repeated rows counted once; null keys are left out."""
    return df.where(F.col(key).isNotNull()).select(key, *columns).dropDuplicates([key])


def own_names(members: DataFrame) -> DataFrame:
    """(name, id, tier): every name that a member answers to itself; 0 primary, 1 listed, 3 full name."""
    primary = members.where("primary_api_name is not null").select(F.col("primary_api_name").alias("name"), "id", F.lit(0).alias("tier"))
    listed = members.select(F.explode("all_api_names").alias("name"), "id", F.lit(1).alias("tier"))
    full = members.where("fully_qualified_name is not null").select(F.col("fully_qualified_name").alias("name"), "id", F.lit(3).alias("tier"))
    return primary.unionByName(listed).unionByName(full)


def inherited_names(inherited: DataFrame) -> DataFrame:
    """(name, id, tier): 2 for the name an inherited member has, or any it is listed under."""
    direct = inherited.where("inherited_api_name is not null").select(F.col("inherited_api_name").alias("name"), "id", F.lit(2).alias("tier"))
    return direct.unionByName(inherited.select(F.explode("inherited_api_names").alias("name"), "id", F.lit(2).alias("tier")))


def resolve(wanted: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """``wanted`` with (id, tier) of the best match by (tier, id), null if there is none; one aggregate, no window over hot names."""
    best = names.groupBy("name").agg(F.min(F.struct("tier", "id")).alias("b")).select(F.col("name").alias(name), F.col("b.tier").alias("tier"), F.col("b.id").alias("id"))
    return wanted.join(best, name, "left")


def longest_prefix(wanted: DataFrame, known: DataFrame, name: str, key: str) -> DataFrame:
    """``wanted`` with ``match``: the longest dotted prefix of ``name`` that is a ``key`` of ``known`` (both distinct)."""
    each = wanted.select(name, F.explode(name_prefixes(name)).alias("prefix"))
    hit = each.join(known.select(F.col(key).alias("prefix")).distinct(), "prefix", "left_semi")
    return wanted.join(hit.groupBy(name).agg(F.max_by("prefix", segments("prefix")).alias("match")), name, "left")


def coverage(members: DataFrame) -> DataFrame:
    """(member_type, total, documented, percent) for class, function and method, and for all under 'total' (variables count only there)."""
    doc = F.count_if(is_present("docstring"))
    by = members.where(F.col("member_type").isin("class", "function", "method")).groupBy("member_type").agg(F.count("*").alias("total"), doc.alias("documented"))
    everything = members.agg(F.count("*").alias("total"), doc.alias("documented")).select(F.lit("total").alias("member_type"), "total", "documented")
    return by.unionByName(everything).withColumn("percent", F.coalesce(F.round(F.try_divide(F.col("documented") * 100.0, F.col("total")), 4), F.lit(0.0)))


def counts(**groups: tuple[DataFrame, Column]) -> DataFrame:
    """One row per name with the aggregate of its frame."""
    out = None
    for name, (df, agg) in groups.items():
        row = df.agg(agg.alias("n")).select(F.lit(name).alias("what"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
