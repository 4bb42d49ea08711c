"""Queries over the property graph of modules, members, exports and inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import property_graph as P
from spanwright.plans.catalogue import cur, exps, inh, mods
from spanwright.plans.graphs import _EV, event_graph
from spanwright.plans.registry import CUR, EXPS, INH, MODS, Registry
from spanwright.runtime import written

query = Registry()

_G = f"""{CUR}, {MODS}, {EXPS}, {INH}, raw AS (SELECT p.fully_qualified_name AS src, c.fully_qualified_name AS dst, 'CONTAINS' AS type, 'CONTAINS' AS key FROM cur c JOIN cur p ON p.id = c.parent_id WHERE c.id <> p.id UNION SELECT m.name, c.fully_qualified_name, 'CONTAINS', 'CONTAINS' FROM cur c JOIN mods m ON m.id = c.module_id WHERE c.parent_id IS NULL
 UNION SELECT m.name, c.fully_qualified_name, 'EXPORTS', 'EXPORT_' || e.exported_name FROM exps e JOIN mods m ON m.id = e.exporter_module_id JOIN cur c ON c.id = e.target_member_id WHERE e.exported_name IS NOT NULL UNION SELECT c.fully_qualified_name, i.source_class_fqn, 'INHERITS', 'INHERITS' FROM inh i JOIN cur c ON c.id = i.inheriting_class_id),
 ge AS (SELECT DISTINCT * FROM raw WHERE src IS NOT NULL AND dst IS NOT NULL), gn AS (SELECT id, max(node_type) AS node_type FROM (SELECT name AS id, CASE WHEN is_package THEN 'package' ELSE 'module' END AS node_type FROM mods UNION ALL SELECT fully_qualified_name, member_type FROM cur UNION ALL SELECT src, NULL FROM ge UNION ALL SELECT dst, NULL FROM ge) WHERE id IS NOT NULL GROUP BY 1)"""
_INV = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.INVERSE.items()) + " END"


def property_graph(s: SparkSession, d: str) -> P.PropertyGraph:
    """Modules and members by name; what contains, exports and inherits what."""
    c = cur(s, d, "fully_qualified_name", "parent_id", "module_id", "member_type")
    m = mods(s, d, "name", "is_package")
    name = c.select(F.col("id").alias("key_id"), F.col("fully_qualified_name").alias("f"))
    inner = c.join(name.toDF("parent_id", "src"), "parent_id").where("id <> parent_id").select("src", F.col("fully_qualified_name").alias("dst"))
    top = c.where("parent_id is null").join(m.select(F.col("id").alias("module_id"), F.col("name").alias("src")), "module_id").select("src", F.col("fully_qualified_name").alias("dst"))
    e = exps(s, d, "exporter_module_id", "exported_name", "target_member_id", "is_explicit", "is_reexport").join(m.select(F.col("id").alias("exporter_module_id"), F.col("name").alias("module")), "exporter_module_id").join(name.toDF("target_member_id", "target"), "target_member_id")
    bases = inh(s, d, "inheriting_class_id", "source_class_fqn").join(name.toDF("inheriting_class_id", "src"), "inheriting_class_id").select("src", F.col("source_class_fqn").alias("dst"))
    exported = P.export_edges(e.where("exported_name is not null").select("module", "target", F.col("exported_name").alias("name"), "is_explicit", "is_reexport"))
    edges = P.relationship(inner.unionByName(top), "containment").unionByName(exported).unionByName(P.relationship(bases, "inheritance"))
    none = F.create_map().cast("map<string,string>")
    nodes = m.select(F.col("name").alias("id"), F.when(F.col("is_package"), "package").otherwise("module").alias("node_type"), none.alias("attrs")).unionByName(c.select(F.col("fully_qualified_name").alias("id"), F.col("member_type").alias("node_type"), none.alias("attrs")))
    return P.PropertyGraph.of(nodes, edges)


def stored(s, d) -> P.PropertyGraph:
    g = property_graph(s, d)
    return P.PropertyGraph(written(g.nodes, "nodes"), written(g.edges, "edges"))


@query(f"WITH {_G} SELECT type, count(*) AS n FROM ge GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM ge UNION ALL SELECT 'nodes', count(*) FROM gn")
def graph_counts(s, d):
    """Edges per type, and all nodes and edges."""
    return stored(s, d).counts()


@query(f"WITH {_G} SELECT id, node_type FROM gn")
def graph_nodes(s, d):
    return property_graph(s, d).nodes.select("id", "node_type")


@query(f"WITH {_G}, nb AS (SELECT src AS node, 'out' AS direction, type FROM ge UNION ALL SELECT dst, 'in', type FROM ge) SELECT node, direction, type, count(*) AS n FROM nb GROUP BY 1, 2, 3")
def graph_neighbours(s, d):
    """Edges out of and into every node by type."""
    return property_graph(s, d).neighbours().groupBy("node", "direction", "type").agg(F.count("*").alias("n"))


@query(f"WITH {_G}, nb AS (SELECT src AS node, 0 AS i, 1 AS o FROM ge UNION ALL SELECT dst, 1, 0 FROM ge) SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, round(count(*) / (SELECT 2 * count(*) FROM ge), 9)::DOUBLE AS importance FROM nb GROUP BY 1")
def graph_node_metrics(s, d):
    return stored(s, d).node_metrics().select("node", "in_degree", "out_degree", "importance")


@query(f"WITH {_G}, f AS (SELECT min(src) AS a FROM ge WHERE type = 'EXPORTS') SELECT 'successor' AS relation, dst AS node, type FROM ge, f WHERE src = a UNION ALL SELECT 'predecessor', src, type FROM ge, f WHERE dst = a UNION ALL SELECT 'export', dst, type FROM ge, f WHERE src = a AND type = 'EXPORTS'")
def graph_look_ups(s, d):
    """The neighbours of one node, and its edges of one type."""
    g = stored(s, d)
    a = g.find(type_="EXPORTS").agg(F.min("src")).first()[0]  # one name
    if a is None:
        return g.successors("").select(F.lit("").alias("relation"), "node", "type")
    row = lambda df, r: df.select(F.lit(r).alias("relation"), "node", "type")
    return row(g.successors(a), "successor").unionByName(row(g.predecessors(a), "predecessor")).unionByName(row(g.successors(a, "EXPORTS"), "export"))


@query(f"WITH {_G} SELECT e.dst AS src, e.src AS dst, x.n > 0 AS present FROM (SELECT DISTINCT src, dst FROM ge) e LEFT JOIN (SELECT src, dst, count(*) AS n FROM ge GROUP BY 1, 2) x ON x.src = e.dst AND x.dst = e.src WHERE x.n > 0 UNION ALL SELECT e.dst, e.src, false FROM (SELECT DISTINCT src, dst FROM ge) e WHERE NOT EXISTS (SELECT 1 FROM ge x WHERE x.src = e.dst AND x.dst = e.src)")
def graph_has_reverse(s, d):
    """Is there an edge that runs back from every edge?"""
    g = stored(s, d)
    return g.has_edge(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())


@query(f"WITH {_G}, b AS (SELECT DISTINCT dst AS src, src AS dst, {_INV} AS type FROM ge) SELECT type, count(*) AS n FROM (SELECT src, dst, type, key FROM ge UNION ALL SELECT b.src, b.dst, b.type, b.type FROM b WHERE b.type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ge x WHERE x.src = b.src AND x.dst = b.dst AND x.type = b.type)) GROUP BY 1")
def graph_with_inverses(s, d):
    """Edges per type when those that run back are added."""
    g = stored(s, d)
    return g.add_relationships(g.edges).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_G}, f AS (SELECT min(name) AS a FROM mods), k AS (SELECT ge.* FROM ge, f WHERE NOT (src = a OR starts_with(src, a || '.') OR dst = a OR starts_with(dst, a || '.'))) SELECT type, count(*) AS n FROM k GROUP BY 1")
def graph_without_module(s, d):
    """Edges per type without those of one module."""
    first = mods(s, d, "name").agg(F.min("name")).first()[0]  # one name
    return property_graph(s, d).without_module(first or "").edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_G}, k AS (SELECT id FROM gn WHERE node_type = 'class') SELECT type, count(*) AS n FROM ge WHERE src NOT IN (SELECT id FROM k) AND dst NOT IN (SELECT id FROM k) GROUP BY 1")
def graph_without_classes(s, d):
    """Edges per type when all classes are removed."""
    g = stored(s, d)
    return g.without_nodes(g.nodes_with(node_type="class").select("id")).edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_G} SELECT type, count(*) AS n FROM ge WHERE type <> 'INHERITS' GROUP BY 1")
def graph_without_inheritance(s, d):
    return stored(s, d).without_edges(type_="INHERITS").edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {_G}, k AS (SELECT id FROM gn WHERE node_type IN ('class', 'method')) SELECT src, dst, type FROM ge WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def class_subgraph(s, d):
    """The graph induced on classes and methods."""
    return stored(s, d).filtered(F.col("node_type").isin("class", "method")).edges.select("src", "dst", "type")


@query(f"WITH {_G} SELECT src, dst FROM ge WHERE type = 'INHERITS'")
def inheritance_graph_data(s, d):
    """The edges of one kind of relationship, for drawing."""
    return property_graph(s, d).of_types("INHERITS").edges.select("src", "dst")


@query(f"WITH {_G}, u AS (SELECT src AS a, dst AS b FROM ge WHERE type = 'INHERITS' AND src <> dst UNION SELECT dst, src FROM ge WHERE type = 'INHERITS' AND src <> dst), w AS (SELECT a, b, 1 AS k FROM u UNION SELECT u.a, v.b, 2 FROM u JOIN u v ON v.a = u.b WHERE v.b <> u.a) SELECT a AS seed, b AS node, min(k)::INT AS distance FROM w GROUP BY 1, 2")
def related_classes(s, d):
    """Classes within two steps of inheritance, either way."""
    g = stored(s, d).of_types("INHERITS")
    return g.related(g.nodes.select(F.col("id").alias("node")), 2, ["INHERITS"]).select("seed", "node", "distance")


def _events(s, d) -> P.PropertyGraph:
    none = F.create_map().cast("map<string,string>")
    e = event_graph(s, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.lit("event").alias("node_type"), none.alias("attrs"))
    return P.PropertyGraph(n, P.edge_rows(e, "FOLLOWED_BY"))


def _event_pairs(s, d):
    """(a, b): the first event type and each other one."""
    e = event_graph(s, d)
    first = e.agg(F.min("src").alias("a"))
    return e.select(F.col("dst").alias("b")).distinct().crossJoin(F.broadcast(first)).where("a <> b")  # one row


_PATHS = f"{_EV}, f AS (SELECT min(src) AS a FROM ev), p AS (SELECT [src, dst] AS path FROM ev WHERE src <> dst UNION ALL SELECT list_append(p.path, e.dst) FROM p JOIN ev e ON e.src = p.path[-1] WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 5)"


@query(f"WITH RECURSIVE {_PATHS} SELECT path[1] AS a, path[-1] AS b, array_to_string(path, '>') AS path FROM p, f WHERE path[1] = f.a OR path[-1] = f.a")
def paths_between_events(s, d):
    """All simple paths of at most five event types between the first type and every other, both ways."""
    return _events(s, d).paths_between(_event_pairs(s, d), 5).select("a", "b", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {_PATHS}, st AS (SELECT DISTINCT path[k] AS src, path[k + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS k FROM p, f WHERE path[1] = f.a OR path[-1] = f.a)) SELECT ev.src, ev.dst, st.src IS NOT NULL AS on_path FROM ev LEFT JOIN st USING (src, dst)")
def highlighted_paths(s, d):
    """Which steps between event types lie on such a path."""
    return _events(s, d).highlighted(_event_pairs(s, d), 5)


@query(f"WITH {_G} SELECT CASE coalesce(node_type, '?') WHEN 'module' THEN '#4C78A8' WHEN 'package' THEN '#72B7B2' WHEN 'class' THEN '#F58518' WHEN 'function' THEN '#54A24B' WHEN 'method' THEN '#88D27A' WHEN 'variable' THEN '#B79A20' ELSE '?' END AS colour, count(*) AS n FROM gn WHERE node_type IN ('module', 'package', 'class', 'function', 'method', 'variable') GROUP BY 1")
def drawn_nodes(s, d):
    """Nodes of known kinds by the colour they are drawn in."""
    g = property_graph(s, d)
    known = P.PropertyGraph(g.nodes.where(F.col("node_type").isin(*P.NODE_COLOUR)), g.edges)
    return known.visualization()[0].groupBy("colour").agg(F.count("*").alias("n"))


@query(f"WITH {_G} SELECT type, CASE WHEN type IN ('IMPORTS', 'DEPENDS_ON', 'REFERENCES') THEN 'dashed' ELSE 'solid' END AS style, count(*) AS n FROM ge GROUP BY 1, 2")
def drawn_links(s, d):
    return property_graph(s, d).visualization()[1].groupBy("type", "style").agg(F.count("*").alias("n"))


@query(f"WITH {CUR} SELECT id, CASE WHEN regexp_matches(p[-1], '^[A-Z]') THEN 'class' WHEN len(p) > 1 AND regexp_matches(p[-2], '^[A-Z]') THEN 'method' WHEN len(p) > 1 THEN 'function' ELSE 'module' END AS kind FROM (SELECT id, string_split(fully_qualified_name, '.') AS p FROM cur WHERE fully_qualified_name IS NOT NULL)")
def guessed_kinds(s, d):
    """What members look like by their names alone."""
    return cur(s, d, "fully_qualified_name").where("fully_qualified_name is not null").select("id", P.node_kind("fully_qualified_name").alias("kind"))


@query(f"WITH {EXPS} SELECT count_if(exporter_module_id IS NOT NULL AND target_member_id IS NOT NULL) AS added, count_if(exporter_module_id IS NULL OR target_member_id IS NULL) AS skipped FROM exps")
def bulk_added(s, d):
    """How many export records make edges, and how many lack an end."""
    e = exps(s, d, "exporter_module_id", "target_member_id").select(F.col("exporter_module_id").cast("string").alias("src"), F.col("target_member_id").cast("string").alias("dst"), F.lit("EXPORTS").alias("type"))
    return _events(s, d).bulk_counts(e)


QUERIES, ORACLES = query.queries, query.oracles
