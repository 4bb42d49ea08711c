"""Inheritance: closures, depths, diamonds, interfaces and the members that classes inherit.

Edges run from a class to its base (src -> dst).  Closures hold one row per class
and ancestor; where a class graph is one great cycle they are as large as that asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators import graph as G
from spanwright.operators.relations import first_wins
from spanwright.runtime import written


def closure(inherits: DataFrame) -> DataFrame:
    """(cls, ancestor, level): all strict ancestors of every class with their least distance; a class is never its own."""
    e = G.distinct_edges(inherits)
    found = G.bfs(e, e.select(F.col("src").alias("node")).distinct())
    return found.select(F.col("seed").alias("cls"), F.col("node").alias("ancestor"), "level")


def with_self(up: DataFrame, classes: DataFrame) -> DataFrame:
    """The closure with every class of classes(cls) as its own ancestor at level 0."""
    return up.unionByName(classes.select("cls", F.col("cls").alias("ancestor"), F.lit(0).alias("level")))


def class_cards(inherits: DataFrame, implements: DataFrame) -> DataFrame:
    """(cls, n_parents, n_children, n_ancestors, n_descendants, n_interfaces, depth), one row per class."""
    e = written(G.distinct_edges(inherits), "inherits")
    up = written(closure(e), "closure")
    classes = G.nodes_of(e).withColumnRenamed("node", "cls")
    parts = [
        e.groupBy(F.col("src").alias("cls")).agg(F.count("*").alias("n_parents")),
        e.groupBy(F.col("dst").alias("cls")).agg(F.count("*").alias("n_children")),
        up.groupBy("cls").agg(F.count("*").alias("n_ancestors")),
        up.groupBy(F.col("ancestor").alias("cls")).agg(F.count("*").alias("n_descendants")),
        interfaces_of(up, implements).groupBy("cls").agg(F.count("*").alias("n_interfaces")),
        G.longest_depths(e).withColumnRenamed("node", "cls"),
    ]
    out = reduce(lambda a, b: a.join(b, "cls", "left"), parts, classes)
    return out.fillna(0)


def interfaces_of(up: DataFrame, implements: DataFrame) -> DataFrame:
    """(cls, interface): what a class or one of its ancestors implements."""
    own = implements.select(F.col("src").alias("cls"), F.col("dst").alias("interface"))
    above = up.select("cls", "ancestor").join(own.select(F.col("cls").alias("ancestor"), "interface"), "ancestor").select("cls", "interface")
    return own.unionByName(above).distinct()


def implementers_of(up: DataFrame, implements: DataFrame) -> DataFrame:
    """(interface, cls): who implements an interface, directly or below one who does."""
    return interfaces_of(up, implements).select("interface", "cls")


def is_subclass(up: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(child, parent) with ``subclass``: strict, a class is no subclass of itself."""
    known = up.select(F.col("cls").alias("child"), F.col("ancestor").alias("parent"), F.lit(True).alias("yes"))
    return pairs.join(known, ["child", "parent"], "left").select("child", "parent", F.coalesce("yes", F.lit(False)).alias("subclass"))


def common_ancestors(up: DataFrame, depths: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with their deepest common ancestor, themselves included; the least of equals, null if there is none.

    depths: (node, depth).
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    full = with_self(up.join(wanted, "cls", "left_semi"), wanted).select("cls", "ancestor").distinct()
    both = pairs.distinct().join(full.withColumnRenamed("cls", "a"), "a").join(full.withColumnRenamed("cls", "b"), ["b", "ancestor"])
    deep = both.join(depths.select(F.col("node").alias("ancestor"), "depth"), "ancestor", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    best = deep.groupBy("a", "b").agg(F.min(F.struct((-F.col("depth")).alias("d"), "ancestor"))["ancestor"].alias("common"))
    return pairs.distinct().join(best, ["a", "b"], "left")


def diamonds(inherits: DataFrame, up: DataFrame) -> DataFrame:
    """(cls, common): classes two of whose direct bases share a strict ancestor, with the least such ancestor.

    The bases of a class are counted per ancestor, so no pairs of bases are made.
    """
    e = G.distinct_edges(inherits).where("src <> dst")
    shared = e.select(F.col("src").alias("cls"), F.col("dst").alias("base")).join(up.select(F.col("cls").alias("base"), "ancestor"), "base").groupBy("cls", "ancestor").agg(F.count("*").alias("n"))
    return shared.where("n > 1").groupBy("cls").agg(F.min("ancestor").alias("common"))


def mixins(inherits: DataFrame, min_children: int = 1) -> DataFrame:
    """(cls, n_children): classes with children and no bases but ``object``."""
    e = G.distinct_edges(inherits)
    kids = e.groupBy(F.col("dst").alias("cls")).agg(F.count("*").alias("n_children")).where(F.col("n_children") >= min_children)
    return kids.join(e.where("dst <> 'object'").select(F.col("src").alias("cls")), "cls", "left_anti")


def complex_classes(cards: DataFrame, min_depth: int = 5, min_children: int = 5) -> DataFrame:
    return cards.where((F.col("depth") >= min_depth) | (F.col("n_children") >= min_children)).select("cls", "depth", "n_children")


def metrics(cards: DataFrame, n_diamonds: DataFrame, n_mixins: DataFrame) -> DataFrame:
    """(metric, value): classes, depth and children (mean, greatest), the widest level, diamonds and mixins."""
    width = cards.groupBy("depth").agg(F.count("*").alias("w")).agg(F.max("w").alias("v")).select(F.lit("max_width").alias("metric"), F.col("v").cast("double").alias("value"))
    one = cards.agg(F.count("*").alias("total_classes"), F.max("depth").alias("max_depth"), F.avg("depth").alias("average_depth"), F.max("n_children").alias("max_children"), F.avg("n_children").alias("average_children"))
    flat = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in one.columns])))
    out = flat.unionByName(width)
    for name, df in (("diamonds", n_diamonds), ("mixins", n_mixins)):
        out = out.unionByName(df.agg(F.count("*").alias("v")).select(F.lit(name).alias("metric"), F.col("v").cast("double").alias("value")))
    return out


def classified_bases(bases: DataFrame, components: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """bases(cls, module, base_name, base_fqn) with (fqn, internal, how): a class of the same module, else what an import binds, else by its root package.

    components: (module, fqn); imports: (module, bound, points_to, internal), the first of a
    name counts by points_to; packages: (root).  Within imports the whole name comes before its first part.
    """
    local = components.select("module", "fqn").distinct()
    short = F.element_at(F.split("base_name", "[.]"), -1)
    b = bases.withColumn("short", short).withColumn("here", F.concat_ws(".", "module", short)).withColumn("first", F.split("short", "[.]")[0])
    b = b.join(local.select("module", F.col("fqn").alias("here"), F.lit(True).alias("is_here")), ["module", "here"], "left")
    b = b.join(local.select("module", F.col("fqn").alias("base_fqn"), F.lit(True).alias("is_local")), ["module", "base_fqn"], "left")
    bound = imports.groupBy("module", "bound").agg(F.min(F.struct("points_to", "internal")).alias("i")).select("module", F.col("bound").alias("short"), F.col("i.points_to").alias("points_to"), F.col("i.internal").alias("i_internal"))
    b = b.join(bound, ["module", "short"], "left")
    roots = F.broadcast(packages.select(F.col("root").alias("base_root"), F.lit(True).alias("known")).distinct())  # one row per analysed package
    b = b.withColumn("base_root", F.split("base_fqn", "[.]")[0]).join(roots, "base_root", "left")
    how = F.when(F.col("is_here") | F.col("is_local"), "local").when(F.col("i_internal").isNotNull(), "import").otherwise("package")
    fqn = F.when(F.col("is_here"), F.col("here")).when(F.col("is_local"), F.col("base_fqn")).when(how == "import", F.coalesce("points_to", "base_fqn")).otherwise(F.col("base_fqn"))
    internal = F.when(how == "local", True).when(how == "import", F.col("i_internal")).otherwise(F.coalesce("known", F.lit(False)))
    return b.select("cls", "base_name", fqn.alias("fqn"), internal.alias("internal"), how.alias("how"))


def inherited_members(bases: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, name, provider, member_id, level): what each class inherits.

    bases: (cls, base, idx), idx the base's place; members: (cls, name, member_id).
    Bases are visited breadth first in their order and the first that has a name
    provides it; what a class defines itself shadows it; names with one leading
    underscore are not inherited, dunder names are.
    """
    e = written(bases.where("cls is not null and base is not null and cls <> base").groupBy("cls", "base").agg(F.min("idx").alias("idx")), "bases")
    frontier = written(e.select("cls", F.col("base").alias("provider"), F.array("idx").alias("turn")), "mro")
    found, level = [frontier.withColumn("level", F.lit(1))], 1
    step_e = e.select(F.col("cls").alias("provider"), F.col("base").alias("next"), "idx")
    while True:
        level += 1
        step = frontier.join(step_e, "provider").select("cls", F.col("next").alias("provider"), F.concat("turn", F.array("idx")).alias("turn"))
        step = step.where("provider <> cls").groupBy("cls", "provider").agg(F.min("turn").alias("turn"))
        seen = reduce(DataFrame.unionByName, found).select("cls", "provider")
        frontier = written(step.join(seen, ["cls", "provider"], "left_anti"), "mro")
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("level", F.lit(level)))
    order = reduce(DataFrame.unionByName, found)
    visible = members.where(~(F.col("name").startswith("_") & ~F.col("name").startswith("__")))
    own = visible.groupBy(F.col("cls").alias("provider"), "name").agg(F.min("member_id").alias("member_id"))
    first = first_wins(order.join(own, "provider"), ["cls", "name"], ["level", "turn", "provider"])
    return first.join(members.select("cls", "name").distinct(), ["cls", "name"], "left_anti").select("cls", "name", "provider", "member_id", "level")
