"""Inheritance queries over the classes that inherited members tell of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.columns import name_prefixes
from spanwright.operators import catalog as C
from spanwright.operators import graph as G
from spanwright.operators import inheritance as I
from spanwright.plans.catalogue import cur, inh, mods
from spanwright.plans.registry import CUR, INH, MODS, Registry
from spanwright.runtime import written

query = Registry()

#: class -> base by full names; external bases count as interfaces
_E = f"{CUR}, {INH}, e AS (SELECT DISTINCT c.fully_qualified_name AS src, i.source_class_fqn AS dst FROM inh i JOIN cur c ON c.id = i.inheriting_class_id WHERE c.fully_qualified_name IS NOT NULL AND i.source_class_fqn IS NOT NULL AND NOT i.is_external), im AS (SELECT DISTINCT c.fully_qualified_name AS src, i.source_class_fqn AS dst FROM inh i JOIN cur c ON c.id = i.inheriting_class_id WHERE c.fully_qualified_name IS NOT NULL AND i.source_class_fqn IS NOT NULL AND i.is_external)"
_UP = f"{_E}, walk AS (SELECT src AS cls, dst AS ancestor, 1 AS level FROM e WHERE src <> dst UNION SELECT w.cls, e.dst, w.level + 1 FROM walk w JOIN e ON e.src = w.ancestor WHERE w.level < 60), up AS (SELECT cls, ancestor, min(level) AS level FROM walk WHERE cls <> ancestor GROUP BY 1, 2), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
#: longest way up; classes that run into a cycle count 0
_DEPTH = f"{_UP}, cyc AS (SELECT DISTINCT w.cls AS node FROM walk w JOIN (SELECT DISTINCT cls FROM walk WHERE cls = ancestor UNION SELECT src FROM e WHERE src = dst) k ON k.cls = w.ancestor UNION SELECT cls FROM walk WHERE cls = ancestor UNION SELECT src FROM e WHERE src = dst), dp AS (SELECT nd.node, CASE WHEN nd.node IN (SELECT node FROM cyc) THEN 0 ELSE coalesce(m.d, 0) END::INT AS depth FROM nd LEFT JOIN (SELECT cls, max(level) AS d FROM walk GROUP BY 1) m ON m.cls = nd.node)"
_CARD = f"{_DEPTH}, itf AS (SELECT src AS cls, dst AS interface FROM im UNION SELECT up.cls, im.dst FROM up JOIN im ON im.src = up.ancestor), card AS (SELECT nd.node AS cls, (SELECT count(*) FROM e WHERE e.src = nd.node) AS n_parents, (SELECT count(*) FROM e WHERE e.dst = nd.node) AS n_children, (SELECT count(*) FROM up WHERE up.cls = nd.node) AS n_ancestors, (SELECT count(*) FROM up WHERE up.ancestor = nd.node) AS n_descendants, (SELECT count(*) FROM itf WHERE itf.cls = nd.node) AS n_interfaces, dp.depth FROM nd JOIN dp ON dp.node = nd.node)"
_DIAMONDS = "dm AS (SELECT cls, min(ancestor) AS common FROM (SELECT e.src AS cls, up.ancestor FROM e JOIN up ON up.cls = e.dst WHERE e.src <> e.dst GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)"
_MIXINS = "mx AS (SELECT dst AS cls, count(*) AS n_children FROM e WHERE dst NOT IN (SELECT src FROM e WHERE dst <> 'object') GROUP BY 1)"


def class_edges(s: SparkSession, d: str, external: bool = False) -> DataFrame:
    """(src, dst): a class and a base of its inherited members; external bases stand for interfaces."""
    names = cur(s, d, "fully_qualified_name").select(F.col("id").alias("inheriting_class_id"), F.col("fully_qualified_name").alias("src"))
    rows = inh(s, d, "inheriting_class_id", "source_class_fqn", "is_external").where(F.col("is_external") if external else ~F.col("is_external"))
    return rows.join(names, "inheriting_class_id").select("src", F.col("source_class_fqn").alias("dst")).where("src is not null and dst is not null").distinct()


def _cards(s, d):
    return I.class_cards(class_edges(s, d), class_edges(s, d, True))


@query(f"WITH {_E} SELECT src AS cls, dst AS other, 'parent' AS relation FROM e UNION ALL SELECT dst, src, 'child' FROM e")
def class_relatives(s, d):
    """Direct bases and direct subclasses of every class."""
    e = class_edges(s, d)
    return e.select(F.col("src").alias("cls"), F.col("dst").alias("other"), F.lit("parent").alias("relation")).unionByName(e.select(F.col("dst").alias("cls"), F.col("src").alias("other"), F.lit("child").alias("relation")))


@query(f"WITH RECURSIVE {_UP} SELECT cls, ancestor, level::INT AS level FROM up")
def class_ancestors(s, d):
    """All ancestors of every class, and so all descendants of every base."""
    return I.closure(class_edges(s, d))


@query(f"WITH RECURSIVE {_DEPTH} SELECT node AS cls, depth FROM dp")
def class_depths(s, d):
    return G.longest_depths(class_edges(s, d)).select(F.col("node").alias("cls"), "depth")


@query(f"WITH RECURSIVE {_CARD} SELECT * FROM card")
def class_cards(s, d):
    return _cards(s, d)


@query(f"WITH RECURSIVE {_E}, p AS (SELECT src AS cls, dst AS ancestor, [src, dst] AS path FROM e WHERE src <> dst UNION ALL SELECT p.cls, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.ancestor WHERE NOT list_contains(p.path, e.dst)) SELECT cls, ancestor, array_to_string(arg_min(path, (len(path), path)), ' > ') AS path FROM p GROUP BY 1, 2")
def inheritance_paths(s, d):
    """The shortest way from every class to each of its ancestors, the first of equals."""
    e = class_edges(s, d)
    return G.shortest_paths(e, e.select(F.col("src").alias("node")).distinct()).select(F.col("seed").alias("cls"), F.col("node").alias("ancestor"), F.array_join("path", " > ").alias("path"))


@query(f"WITH RECURSIVE {_CARD} SELECT * FROM itf")
def implemented_interfaces(s, d):
    return I.interfaces_of(written(I.closure(class_edges(s, d)), "closure"), class_edges(s, d, True))


@query(f"WITH RECURSIVE {_CARD} SELECT interface, count(*) AS n_implementers FROM itf GROUP BY 1")
def interface_implementers(s, d):
    found = I.implementers_of(written(I.closure(class_edges(s, d)), "closure"), class_edges(s, d, True))
    return found.groupBy("interface").agg(F.count("*").alias("n_implementers"))


@query(f"WITH RECURSIVE {_UP} SELECT e.dst AS child, b.dst AS parent, up.cls IS NOT NULL AS subclass FROM (SELECT DISTINCT src, dst FROM e) e JOIN (SELECT src, min(dst) AS dst FROM e GROUP BY 1) b ON b.src = e.src LEFT JOIN up ON up.cls = e.dst AND up.ancestor = b.dst")
def subclass_checks(s, d):
    """Of every class's bases: is it a subclass of the class's first base?"""
    e = written(class_edges(s, d), "inherits")
    first = e.groupBy("src").agg(F.min("dst").alias("parent"))
    pairs = e.join(first, "src").select(F.col("dst").alias("child"), "parent")
    return I.is_subclass(I.closure(e), pairs)


@query(f"WITH RECURSIVE {_DEPTH}, pr AS (SELECT DISTINCT min(dst) AS a, max(dst) AS b FROM e GROUP BY src HAVING count(*) > 1), slf AS (SELECT cls, ancestor FROM up UNION SELECT node, node FROM nd), j AS (SELECT pr.a, pr.b, x.ancestor, dp.depth FROM pr JOIN slf x ON x.cls = pr.a JOIN slf y ON y.cls = pr.b AND y.ancestor = x.ancestor JOIN dp ON dp.node = x.ancestor) SELECT pr.a, pr.b, k.common FROM pr LEFT JOIN (SELECT a, b, arg_min(ancestor, (-depth, ancestor)) AS common FROM j GROUP BY 1, 2) k USING (a, b)")
def common_ancestors(s, d):
    """The deepest common ancestor of the first and the last base of every class that has several."""
    e = written(class_edges(s, d), "inherits")
    pairs = e.groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b"), F.count("*").alias("n")).where("n > 1").select("a", "b").distinct()
    return I.common_ancestors(written(I.closure(e), "closure"), G.longest_depths(e), pairs)


@query(f"WITH RECURSIVE {_UP}, {_DIAMONDS} SELECT * FROM dm")
def diamonds(s, d):
    e = written(class_edges(s, d), "inherits")
    return I.diamonds(e, I.closure(e))


@query(f"WITH {_E}, {_MIXINS} SELECT * FROM mx")
def mixins(s, d):
    return I.mixins(class_edges(s, d))


@query(f"WITH RECURSIVE {_CARD} SELECT cls, depth, n_children FROM card WHERE depth >= 5 OR n_children >= 5")
def complex_hierarchies(s, d):
    return I.complex_classes(_cards(s, d))


@query(f"WITH RECURSIVE {_CARD}, {_DIAMONDS}, {_MIXINS} SELECT 'total_classes' AS metric, count(*)::DOUBLE AS value FROM card UNION ALL SELECT 'max_depth', max(depth) FROM card UNION ALL SELECT 'average_depth', round(avg(depth), 6) FROM card UNION ALL SELECT 'max_children', max(n_children) FROM card UNION ALL SELECT 'average_children', round(avg(n_children), 6) FROM card UNION ALL SELECT 'max_width', max(w) FROM (SELECT count(*) AS w FROM card GROUP BY depth) UNION ALL SELECT 'diamonds', count(*) FROM dm UNION ALL SELECT 'mixins', count(*) FROM mx")
def inheritance_metrics(s, d):
    e = written(class_edges(s, d), "inherits")
    return I.metrics(written(_cards(s, d), "cards"), I.diamonds(e, I.closure(e)), I.mixins(e))


@query(f"WITH {_E}, {MODS}, x AS (SELECT DISTINCT f, array_to_string(string_split(f, '.')[1:k], '.') AS p, k FROM (SELECT f, unnest(range(1, len(string_split(f, '.')) + 1)) AS k FROM (SELECT src AS f FROM e UNION SELECT dst FROM e))), o AS (SELECT x.f, arg_max(m.name, k) AS module FROM x JOIN mods m ON m.name = x.p GROUP BY 1) SELECT b.module, count(DISTINCT a.module) AS n_modules FROM e JOIN o a ON a.f = e.src JOIN o b ON b.f = e.dst GROUP BY 1")
def modules_with_subclasses(s, d):
    """How many modules hold direct subclasses of a module's classes."""
    e = written(class_edges(s, d), "inherits")
    owner = C.longest_prefix(G.nodes_of(e), mods(s, d, "name"), "node", "name").where("match is not null")
    below, above = owner.toDF("src", "child_module"), owner.toDF("dst", "module")
    return e.join(below, "src").join(above, "dst").groupBy("module").agg(F.count_distinct("child_module").alias("n_modules"))


_BASES = f"{CUR}, {INH}, bs AS (SELECT c.id AS cls, b.id AS base, min(i.id) AS idx FROM inh i JOIN cur c ON c.id = i.inheriting_class_id JOIN (SELECT fully_qualified_name AS f, min(id) AS id FROM cur WHERE member_type = 'class' GROUP BY 1) b ON b.f = i.source_class_fqn WHERE c.id <> b.id GROUP BY 1, 2), mb AS (SELECT parent_id AS cls, name, min(id) AS member_id FROM cur WHERE parent_id IS NOT NULL AND name IS NOT NULL AND member_type <> 'class' GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {_BASES}, w AS (SELECT cls, base AS provider, [idx] AS turn FROM bs UNION ALL SELECT w.cls, b.base, list_append(w.turn, b.idx) FROM w JOIN bs b ON b.cls = w.provider WHERE b.base <> w.cls AND len(w.turn) < 40), o AS (SELECT cls, provider, min((len(turn), turn)) AS turn FROM w GROUP BY 1, 2), f AS (SELECT o.cls, mb.name, arg_min((o.provider, mb.member_id, o.turn[1]), (o.turn, o.provider)) AS p FROM o JOIN mb ON mb.cls = o.provider WHERE NOT (starts_with(mb.name, '_') AND NOT starts_with(mb.name, '__')) GROUP BY 1, 2) SELECT f.cls, f.name, f.p[1] AS provider, f.p[2] AS member_id, f.p[3]::INT AS level FROM f WHERE NOT EXISTS (SELECT 1 FROM mb WHERE mb.cls = f.cls AND mb.name = f.name)")
def resolved_inheritance(s, d):
    """What every class inherits, its bases visited breadth first and the first provider of a name winning."""
    c = written(cur(s, d, "fully_qualified_name", "parent_id", "name", "member_type"), "members")
    known = c.where("member_type = 'class'").groupBy(F.col("fully_qualified_name").alias("source_class_fqn")).agg(F.min("id").alias("base"))
    rows = inh(s, d, "inheriting_class_id", "source_class_fqn").join(known, "source_class_fqn").join(c.select(F.col("id").alias("inheriting_class_id")), "inheriting_class_id", "left_semi")
    bases = rows.groupBy(F.col("inheriting_class_id").alias("cls"), "base").agg(F.min("id").alias("idx"))
    members = c.where("parent_id is not null and name is not null and member_type <> 'class'").select(F.col("parent_id").alias("cls"), "name", F.col("id").alias("member_id"))
    return I.inherited_members(bases, members)


@query(f"WITH {CUR}, {INH}, n AS (SELECT id, unnest(CASE WHEN len(all_api_names) > 0 THEN all_api_names ELSE [fully_qualified_name] END) AS name FROM cur WHERE member_type = 'class'), x AS (SELECT i.id, n.name || '.' || i.member_name AS api FROM inh i JOIN n ON n.id = i.inheriting_class_id WHERE i.member_name IS NOT NULL) SELECT id, count(DISTINCT api) AS n_names, min(api) AS first_name FROM x WHERE api IS NOT NULL GROUP BY 1")
def inherited_api_names(s, d):
    """Public names of inherited members: every name of the class with the member's."""
    c = cur(s, d, "member_type", "all_api_names", "fully_qualified_name").where("member_type = 'class'")
    names = c.select(F.col("id").alias("inheriting_class_id"), F.explode(F.when(F.size("all_api_names") > 0, F.col("all_api_names")).otherwise(F.array("fully_qualified_name"))).alias("name"))
    rows = inh(s, d, "inheriting_class_id", "member_name").where("member_name is not null").join(names.where("name is not null"), "inheriting_class_id")
    return rows.select("id", F.concat_ws(".", "name", "member_name").alias("api")).distinct().groupBy("id").agg(F.count("*").alias("n_names"), F.min("api").alias("first_name"))


QUERIES, ORACLES = query.queries, query.oracles
