"""Name resolution, export chains, inheritance and integrity over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.columns import name_prefixes, parts, segments


def merge_exports(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """(module_id, name, origin): full outer merge; what both know is 'both'."""
    s = static.select("module_id", "name").distinct().withColumn("s", F.lit(True))
    d = dynamic.select("module_id", "name").distinct().withColumn("d", F.lit(True))
    origin = F.when(F.col("s") & F.col("d"), "both").when(F.col("d"), "dynamic").otherwise("static")
    return s.join(d, ["module_id", "name"], "full_outer").select("module_id", "name", origin.alias("origin"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the given order, without a window over the key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def without_own(inherited: DataFrame, own: DataFrame) -> DataFrame:
    """Inherited (class_id, member_name) that the class does not define itself; names with one underscore are left out, dunders stay."""
    hidden = F.col("member_name").startswith("_") & ~F.col("member_name").startswith("__")
    return inherited.where(~hidden).join(own.select("class_id", "member_name").distinct(), ["class_id", "member_name"], "left_anti")


def nearest_definition(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """(want_id, def_id): of the definitions with the wanted name the one in the same module, else in the nearest ancestor
    package, else in a sibling, else the first by id.

    wanted: (want_id, name, module); definitions: (def_id, name, module).

    The tiers are equi-joins with one row per key on the right, so a name that
    half of all definitions bear costs no more than any other.
    """

    def package(c: str) -> Column:
        return F.array_join(F.slice(parts(c), F.lit(1), F.greatest(F.size(parts(c)) - 1, F.lit(0))), ".")

    in_module = definitions.groupBy("name", "module").agg(F.min("def_id").alias("def_id"))
    in_package = definitions.groupBy("name", package("module").alias("package"), segments("module").alias("k")).agg(F.min("def_id").alias("def_id"))
    by_name = definitions.groupBy("name").agg(F.min("def_id").alias("def_id"))
    above = wanted.select("want_id", "name", F.explode(name_prefixes("module")).alias("module"), "module").toDF("want_id", "name", "module", "own")
    near = above.join(in_module, ["name", "module"]).select("want_id", F.when(F.col("module") == F.col("own"), 0).otherwise(1).alias("tier"), F.when(F.col("module") == F.col("own"), 0).otherwise(-segments("module")).alias("far"), "def_id")
    beside = wanted.withColumn("package", package("module")).withColumn("k", segments("module")).join(in_package, ["name", "package", "k"]).select("want_id", F.lit(2).alias("tier"), F.lit(0).alias("far"), "def_id")
    any_ = wanted.join(by_name, "name").select("want_id", F.lit(3).alias("tier"), F.lit(0).alias("far"), "def_id")
    best = F.min(F.struct("tier", "far", "def_id"))
    return near.unionByName(beside).unionByName(any_).groupBy("want_id").agg(best.alias("b")).select("want_id", "b.def_id", "b.tier")


def integrity(members: DataFrame, modules: DataFrame, exports: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule of the schema."""
    ids = members.select("id")

    def count(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")

    checks = [
        count("duplicate_fqn", members.where("fully_qualified_name is not null").groupBy("fully_qualified_name").agg(F.count("*").alias("k")).where("k > 1")),
        count("missing_parent", members.where("parent_id is not null").select(F.col("parent_id").alias("id")).join(ids, "id", "left_anti")),
        count("own_parent", members.where("parent_id = id")),
        count("missing_module", members.select(F.col("module_id").alias("id")).join(modules.select("id"), "id", "left_anti")),
        count("lines_reversed", members.where("source_end_line < source_start_line")),
        count("missing_target", exports.where("target_member_id is not null").select(F.col("target_member_id").alias("id")).join(ids, "id", "left_anti")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
