"""Graph queries over module dependencies, class containment and event transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.operators import graph as G
from spanwright.operators import hierarchy
from spanwright.plans.catalogue import _DEPS, cur, module_dependencies, mods
from spanwright.plans.registry import CUR, MODS, Registry
from spanwright.runtime import table, written

query = Registry()

_EV = "ev AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
_NA = "na AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)"
_TREE = f"{CUR}, tree AS (SELECT parent_id AS src, id AS dst FROM cur WHERE parent_id IS NOT NULL AND parent_id <> id AND parent_id IN (SELECT id FROM cur))"


def event_graph(s: SparkSession, d: str) -> DataFrame:
    """(src, dst): an event of type dst follows one of type src of the same user."""
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(s, d, "events").select(F.col("event_type").alias("src"), nxt.alias("dst")).where("dst is not null").distinct()


def nation_graph(s: SparkSession, d: str) -> DataFrame:
    """(src, dst): customers of nation src bought from suppliers of nation dst."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "src")
    l = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey")
    return l.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey").select("src", "dst").distinct()


def containment(s: SparkSession, d: str) -> DataFrame:
    """(src, dst): parent to child among current members, self links left out."""
    c = cur(s, d, "parent_id")
    links = c.where("parent_id is not null and parent_id <> id").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"))
    return links.join(c.select(F.col("id").alias("src")), "src", "left_semi")


_DEG = "deg AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, sum(i + o)::BIGINT AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {0} UNION ALL SELECT dst, 1, 0 FROM {0}) GROUP BY 1)"


@query(f"WITH {_DEPS}, {_DEG.format('deps')} SELECT * FROM deg")
def degree_metrics(s, d):
    return G.degrees(module_dependencies(s, d))


@query(f"WITH {_DEPS}, {_DEG.format('deps')} SELECT count(*) AS n_nodes, sum(fan_in)::BIGINT AS n_edges, round(sum(fan_in) / (count(*) * (count(*) - 1)), 9) AS density, round(sum(fan_in) / count(*), 6) AS avg_fan_in, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out FROM deg")
def graph_density(s, d):
    return G.graph_metrics(module_dependencies(s, d))


@query(f"WITH {_DEPS} SELECT dst AS node, count(*) AS fan_in FROM deps GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def fan_in_top(s, d):
    return module_dependencies(s, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in")).orderBy(F.desc("fan_in"), "node").limit(10)


@query(f"WITH {_DEPS} SELECT src AS node, count(*) AS fan_out FROM deps GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def fan_out_top(s, d):
    return module_dependencies(s, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out")).orderBy(F.desc("fan_out"), "node").limit(10)


@query(f"WITH {_DEPS}, {_DEG.format('deps')} SELECT node, degree FROM deg WHERE degree >= 5")
def highly_coupled(s, d):
    return G.degrees(module_dependencies(s, d)).where("degree >= 5").select("node", "degree")


@query(f"WITH {_DEPS}, {_DEG.format('deps')} SELECT node, round(degree / ((SELECT count(*) FROM deg) - 1), 9) AS centrality FROM deg")
def degree_centrality(s, d):
    deg = G.degrees(module_dependencies(s, d))
    n = deg.agg(F.count("*").alias("n"))
    return deg.crossJoin(F.broadcast(n)).select("node", F.round(F.col("degree") / (F.col("n") - 1), 9).alias("centrality"))  # one row


_COUPLING = f"{_DEPS}, e AS (SELECT * FROM deps WHERE src <> dst), s AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, 2 AS w FROM e UNION ALL SELECT x.src, y.src, 1 FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src UNION ALL SELECT x.dst, y.dst, 1 FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst), cp AS (SELECT a, b, sum(w)::BIGINT AS coupling FROM s GROUP BY 1, 2)"


@query(f"WITH {_COUPLING} SELECT * FROM cp WHERE coupling >= 2")
def coupling_pairs(s, d):
    """Pairs of modules, linked or not, whose coupling is two or more."""
    return G.coupling(module_dependencies(s, d), 2)


@query(f"WITH {_COUPLING} SELECT * FROM cp WHERE coupling >= 3 ORDER BY coupling DESC, a, b LIMIT 10")
def highly_coupled_pairs(s, d):
    """The ten pairs of the greatest coupling of three or more."""
    return G.coupling(module_dependencies(s, d), 3).orderBy(F.desc("coupling"), "a", "b").limit(10)


@query(f"WITH {_DEPS}, nb AS (SELECT src AS node, dst AS other FROM deps WHERE src <> dst UNION SELECT dst, src FROM deps WHERE src <> dst), k AS (SELECT node, count(*) AS k FROM nb GROUP BY 1), t AS (SELECT a.node, count(*) AS m FROM nb a JOIN nb b ON a.node = b.node JOIN deps e ON e.src = a.other AND e.dst = b.other AND e.src <> e.dst GROUP BY 1) SELECT k.node, k.k AS neighbours, CASE WHEN k.k > 1 THEN round(coalesce(t.m, 0) / (k.k * (k.k - 1)), 6) ELSE 0.0 END::DOUBLE AS coefficient FROM k LEFT JOIN t USING (node)")
def clustering_coeff(s, d):
    return G.clustering(module_dependencies(s, d))


@query(f"WITH RECURSIVE {_DEPS}, k AS (SELECT count(*) AS n FROM (SELECT src FROM deps UNION SELECT dst FROM deps)), b AS (SELECT min(src) AS node, 0 AS level FROM deps UNION SELECT e.dst, b.level + 1 FROM b JOIN deps e ON e.src = b.node JOIN k ON b.level < k.n) SELECT node, min(level) AS level FROM b WHERE node <> (SELECT min(src) FROM deps) GROUP BY 1")
def bfs_levels(s, d):
    """Distance in edges from the first module of all modules in reach (no path needs more edges than there are modules)."""
    e = module_dependencies(s, d)
    return G.bfs(e, e.agg(F.min("src").alias("node"))).select("node", "level")


@query(f"WITH RECURSIVE {_EV}, r AS (SELECT src AS seed, dst AS node FROM ev UNION SELECT r.seed, e.dst FROM r JOIN ev e ON e.src = r.node) SELECT seed, count(*) AS n_reachable FROM r WHERE node <> seed GROUP BY 1")
def reachability(s, d):
    """How many other event types can follow each, at any distance."""
    e = event_graph(s, d)
    return G.bfs(e, G.nodes_of(e)).groupBy("seed").agg(F.count("*").alias("n_reachable"))


@query(f"WITH RECURSIVE {_DEPS}, k AS (SELECT count(*) AS n FROM (SELECT src FROM deps UNION SELECT dst FROM deps)), r AS (SELECT dst AS seed, src AS node FROM deps UNION SELECT r.seed, e.src FROM r JOIN deps e ON e.dst = r.node), top AS (SELECT seed, count(*) AS n_affected FROM r WHERE node <> seed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10), b AS (SELECT seed, seed AS node, 0 AS level FROM top UNION SELECT b.seed, e.src, b.level + 1 FROM b JOIN deps e ON e.dst = b.node JOIN k ON b.level < k.n), m AS (SELECT seed, node, min(level) AS level FROM b GROUP BY 1, 2), x AS (SELECT seed, max(level) AS max_depth FROM m GROUP BY 1) SELECT seed AS node, n_affected, max_depth FROM top JOIN x USING (seed)")
def dependency_impact(s, d):
    """The ten modules whose change reaches the most others at any distance, and how far it goes."""
    return G.impact(module_dependencies(s, d))


@query(f"WITH RECURSIVE {_EV}, b AS (SELECT src AS seed, src AS node, 0 AS level FROM ev UNION SELECT b.seed, e.dst, b.level + 1 FROM b JOIN ev e ON e.src = b.node WHERE b.level < 10), m AS (SELECT seed, node, min(level) AS level FROM b GROUP BY 1, 2) SELECT seed, max(level) AS call_depth FROM m WHERE node <> seed GROUP BY 1")
def call_depth(s, d):
    e = event_graph(s, d)
    return G.bfs(e, G.nodes_of(e), 10).groupBy("seed").agg(F.max("level").alias("call_depth"))


@query(f"WITH RECURSIVE {_EV}, p AS (SELECT [src, dst] AS path FROM ev WHERE src <> dst UNION ALL SELECT list_append(p.path, e.dst) FROM p JOIN ev e ON e.src = p.path[-1] WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 4) SELECT array_to_string(path, '>') AS path FROM p")
def simple_paths_3(s, d):
    """All simple paths of up to three edges."""
    e = event_graph(s, d)
    return G.simple_paths(e, G.nodes_of(e), 3).select(F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {_EV}, p AS (SELECT [src, dst] AS path FROM ev WHERE src < dst UNION ALL SELECT list_append(p.path, e.dst) FROM p JOIN ev e ON e.src = p.path[-1] WHERE NOT list_contains(p.path, e.dst) AND e.dst > p.path[1] AND len(p.path) < 4) SELECT array_to_string(p.path, '>') AS cycle FROM p JOIN ev e ON e.src = p.path[-1] AND e.dst = p.path[1] UNION ALL SELECT src FROM ev WHERE src = dst")
def simple_cycles_4(s, d):
    return G.simple_cycles(event_graph(s, d), 4).select(F.array_join("cycle", ">").alias("cycle"))


@query(f"WITH RECURSIVE {_EV}, b AS (SELECT src AS a, dst AS b, [src, dst] AS path FROM ev WHERE src <> dst UNION ALL SELECT b.a, e.dst, list_append(b.path, e.dst) FROM b JOIN ev e ON e.src = b.b WHERE NOT list_contains(b.path, e.dst) AND len(b.path) <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) AS rn FROM b) SELECT a, b, len(path)::INT AS n_nodes, array_to_string(path, '>') AS path FROM r WHERE rn = 1")
def shortest_paths(s, d):
    """The shortest path of at most ten edges between every two event types, the first of equals, and its length in nodes."""
    e = event_graph(s, d)
    found = G.shortest_paths(e, G.nodes_of(e), 10)
    return found.select(F.col("seed").alias("a"), F.col("node").alias("b"), F.size("path").alias("n_nodes"), F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {_EV}, b AS (SELECT src AS a, dst AS b, 1 AS k FROM ev WHERE src <> dst UNION SELECT b.a, e.dst, b.k + 1 FROM b JOIN ev e ON e.src = b.b WHERE b.k < 10), m AS (SELECT a, b, min(k) + 1 AS n FROM b WHERE a <> b GROUP BY 1, 2) SELECT count(*) AS connected_pairs, coalesce(round(avg(n), 6), 0.0)::DOUBLE AS average_nodes, coalesce(max(n), 0)::INT AS diameter_nodes FROM m")
def path_metrics(s, d):
    return G.path_metrics(event_graph(s, d))


@query(f"WITH {_EV} SELECT src AS node FROM ev WHERE src = dst")
def self_loops(s, d):
    return event_graph(s, d).where("src = dst").select(F.col("src").alias("node"))


@query(f"WITH {_NA} SELECT src, dst, 'BUYS_FROM' AS type FROM na UNION SELECT dst, src, 'SELLS_TO' FROM na")
def inverse_edges(s, d):
    return G.with_inverse(nation_graph(s, d).withColumn("type", F.lit("BUYS_FROM")), {"BUYS_FROM": "SELLS_TO", "SELLS_TO": "BUYS_FROM"})


@query(f"WITH {_DEPS}, {MODS}, k AS (SELECT id FROM mods WHERE NOT is_package) SELECT src, dst FROM deps WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def induced_subgraph(s, d):
    keep = mods(s, d, "is_package").where("not is_package").select(F.col("id").alias("node"))
    return G.induced(module_dependencies(s, d), keep)


@query(f"WITH {_DEPS} SELECT DISTINCT src AS node FROM deps WHERE src NOT IN (SELECT dst FROM deps)")
def entry_points(s, d):
    e = module_dependencies(s, d)
    return e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")


@query(f"WITH {_DEPS} SELECT DISTINCT dst AS node FROM deps WHERE dst NOT IN (SELECT src FROM deps)")
def terminal_nodes(s, d):
    e = module_dependencies(s, d)
    return e.select(F.col("dst").alias("node")).distinct().join(e.select(F.col("src").alias("node")), "node", "left_anti")


@query(f"WITH RECURSIVE {_TREE}, a AS (SELECT dst AS node, src AS anc FROM tree UNION SELECT a.node, t.src FROM a JOIN tree t ON t.dst = a.anc) SELECT node, count(*) AS n_ancestors FROM a WHERE node <> anc GROUP BY 1")
def ancestors(s, d):
    """Distinct ancestors of every member that has any: its depth in a tree; what runs into a cycle, some few, is walked."""
    c = cur(s, d, "parent_id", "name", "module_id")
    known = c.select(F.col("id").alias("parent"))
    nodes = c.join(c.where("parent_id <> id").select("id", F.col("parent_id").alias("parent")).join(known, "parent", "left_semi"), "id", "left").select("id", "parent", "name", "module_id")
    found = hierarchy.hierarchy(written(nodes, "nodes"), mods(s, d, "name").select(F.col("id").alias("module_id"), F.col("name").alias("top")))
    trees = found.where("status = 'tree' and depth > 0").select(F.col("member_id").alias("node"), F.col("depth").cast("long").alias("n_ancestors"))
    loops = written(found.where("status <> 'tree'").select(F.col("member_id").alias("node")), "loops")
    links = containment(s, d).join(loops.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    return trees.unionByName(G.bfs(links, loops, reverse=True).groupBy(F.col("seed").alias("node")).agg(F.count("*").alias("n_ancestors")))


def _pagerank_sql(rounds: int) -> str:
    sql = f"WITH {_NA}, nodes AS (SELECT src AS node FROM na UNION SELECT dst FROM na), n AS (SELECT count(*) AS n FROM nodes), k AS (SELECT src AS node, count(*) AS k FROM na GROUP BY 1), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, n)"
    for i in range(rounds):
        sql += f", s{i} AS (SELECT e.dst AS node, sum(r.rank / k.k) AS s FROM r{i} r JOIN k USING (node) JOIN na e ON e.src = r.node GROUP BY 1), l{i} AS (SELECT coalesce(sum(r.rank), 0) AS l FROM r{i} r WHERE r.node NOT IN (SELECT node FROM k)), r{i + 1} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * (coalesce(s, 0) + l / n) AS rank FROM nodes LEFT JOIN s{i} USING (node), l{i}, n)"
    return sql + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql(10))
def pagerank_10(s, d):
    return G.pagerank(nation_graph(s, d), 10).select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH RECURSIVE {_TREE}, u AS (SELECT src AS a, dst AS b FROM tree UNION SELECT dst, src FROM tree), c AS (SELECT a AS node, a AS m FROM u UNION SELECT c.node, u.b FROM c JOIN u ON u.a = c.m) SELECT m AS component, count(*) AS n FROM (SELECT node, min(m) AS m FROM c GROUP BY 1) GROUP BY 1")
def connected_components(s, d):
    """Members joined by containment, named by the least id."""
    return G.components(containment(s, d)).groupBy("component").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_TREE}, {MODS}, u AS (SELECT src AS a, dst AS b FROM tree UNION SELECT dst, src FROM tree), n0 AS (SELECT DISTINCT a AS node, a AS label FROM u), " + ", ".join(f"v{i} AS (SELECT node, label, count(*) AS n FROM (SELECT u.a AS node, l.label FROM u JOIN n{i} l ON l.node = u.b UNION ALL SELECT node, label FROM n{i}) GROUP BY 1, 2), n{i + 1} AS MATERIALIZED (SELECT node, arg_min(label, (-n, label)) AS label FROM v{i} GROUP BY 1)" for i in range(5)) + " SELECT label AS community, count(*) AS n FROM n5 GROUP BY 1 HAVING count(*) >= 2")
def member_communities(s, d):
    """Communities among contained members after five rounds of label propagation."""
    return G.communities(containment(s, d), 5).groupBy("community").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_DEPS}, r AS (SELECT src AS a, dst AS b FROM deps UNION SELECT r.a, e.dst FROM r JOIN deps e ON e.src = r.b), bad AS (SELECT DISTINCT b AS node FROM r WHERE a IN (SELECT a FROM r WHERE a = b)), n AS (SELECT src AS node FROM deps UNION SELECT dst FROM deps), ok AS (SELECT * FROM deps WHERE dst NOT IN (SELECT node FROM bad)), lv AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM deps) UNION SELECT e.dst, lv.level + 1 FROM lv JOIN ok e ON e.src = lv.node) SELECT node, max(level)::INT AS level FROM lv GROUP BY 1 UNION ALL SELECT node, -1 FROM bad")
def topological_order(s, d):
    """Kahn's levels of the module dependencies; modules on or behind cycles get -1."""
    return G.topological_levels(module_dependencies(s, d))


@query(f"WITH {_NA} SELECT src AS node, dst AS other, 'out' AS direction FROM na UNION ALL SELECT dst, src, 'in' FROM na")
def bidirectional_relationships(s, d):
    e = nation_graph(s, d)
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("direction")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction")))


@query(f"WITH {_DEPS}, {_EV}, {_NA} SELECT 'DEPENDS_ON' AS type, count(*) AS n FROM deps UNION ALL SELECT 'FOLLOWED_BY', count(*) FROM ev UNION ALL SELECT 'BUYS_FROM', count(*) FROM na")
def relationship_counts(s, d):
    parts = [module_dependencies(s, d).select(F.lit("DEPENDS_ON").alias("type")), event_graph(s, d).select(F.lit("FOLLOWED_BY").alias("type")), nation_graph(s, d).select(F.lit("BUYS_FROM").alias("type"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {CUR}, p AS (SELECT primary_api_name AS name, min(fully_qualified_name) AS target FROM cur WHERE primary_api_name <> fully_qualified_name GROUP BY 1), w AS (SELECT name, target, 1 AS k FROM p UNION ALL SELECT w.name, p.target, w.k + 1 FROM w JOIN p ON p.name = w.target WHERE w.k < 200), l AS (SELECT name, max(k) AS k, arg_max(target, k) AS target FROM w GROUP BY 1) SELECT name, CASE WHEN k < 200 THEN target END AS target, k >= 200 AS broken FROM l")
def resolved_pointers(s, d):
    """Follow each export's name to the member it stands for, through re-exports of the same name."""
    c = cur(s, d, "fully_qualified_name", "primary_api_name")
    return G.pointer_targets(c.where("primary_api_name <> fully_qualified_name").select(F.col("primary_api_name").alias("name"), F.col("fully_qualified_name").alias("target")))


@query(f"WITH RECURSIVE {_EV}, p AS (SELECT [src, dst] AS path FROM ev WHERE src <> dst UNION ALL SELECT list_append(p.path, e.dst) FROM p JOIN ev e ON e.src = p.path[-1] WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 20) SELECT max(len(path)) AS n_nodes, min(array_to_string(path, '>')) FILTER (WHERE len(path) = (SELECT max(len(path)) FROM p)) AS path FROM p")
def longest_chain(s, d):
    """The longest simple path of up to twenty nodes; ties go to the first in order."""
    e = event_graph(s, d)
    paths = G.simple_paths(e, G.nodes_of(e), 19)
    best = F.min(F.struct((-F.size("path")).alias("k"), F.array_join("path", ">").alias("path")))
    return paths.agg(best.alias("b")).select((-F.col("b.k")).alias("n_nodes"), "b.path")


QUERIES, ORACLES = query.queries, query.oracles
