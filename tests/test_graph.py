"""Graph operators on small graphs with results worked out by hand."""

import random

import pytest

from spanwright.operators import graph as G

CALLS = [("entry1", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("b", "b"), ("c", "d"), ("d", "terminal1"), ("e", "f"), ("f", "e")]
CLASSES = [("B", "A"), ("C", "A"), ("D", "B"), ("D", "C"), ("E", "D"), ("E", "Mixin1"), ("E", "Mixin2"), ("X", "A"), ("Y", "A"), ("Z", "X"), ("Z", "Y")]


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(CALLS + CALLS[:2], "src string, dst string")


def test_degrees_and_density(calls):
    d = {r.node: (r.fan_in, r.fan_out) for r in G.degrees(calls).collect()}
    assert d["d"] == (2, 1) and d["b"] == (2, 2) and d["entry1"] == (0, 1)
    m = G.graph_metrics(calls).first()
    assert (m.n_nodes, m.n_edges) == (8, 9) and m.density == pytest.approx(9 / 56)


def test_cycles_and_paths(spark, calls):
    assert {tuple(r.cycle) for r in G.simple_cycles(calls, 4).collect()} == {("b",), ("e", "f")}
    one = spark.createDataFrame([("entry1",)], "node string")
    paths = {tuple(r.path) for r in G.simple_paths(calls, one, 4).collect()}
    assert max(map(len, paths)) == 5 and ("entry1", "a", "b", "d", "terminal1") in paths
    levels = {r.node: r.level for r in G.bfs(calls, one).collect()}
    assert levels == {"a": 1, "b": 2, "c": 2, "d": 3, "terminal1": 4}
    assert {r.node for r in G.bfs(calls, spark.createDataFrame([("e",)], "node string")).collect()} == {"f"}


def test_inheritance(spark):
    edges = spark.createDataFrame(CLASSES, "src string, dst string")
    up = G.bfs(edges, spark.createDataFrame([("E",)], "node string"))
    assert {r.node for r in up.collect()} == {"D", "B", "C", "A", "Mixin1", "Mixin2"}
    order = {r.node: r.level for r in G.topological_levels(edges).collect()}
    assert order["E"] == 0 and order["D"] == 1 and order["A"] == 3
    assert len({r.component for r in G.components(edges).collect()}) == 1


def test_topological_levels_mark_cycles(calls):
    order = {r.node: r.level for r in G.topological_levels(calls).collect()}
    assert order["entry1"] == 0 and order["a"] == 1 and order["e"] == order["f"] == order["b"] == order["d"] == -1


def test_pointers(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), (None, "q"), ("r", None)], "name string, target string")
    got = {r.name: (r.target, r.broken) for r in G.pointer_targets(p).collect()}
    assert got["a"] == got["b"] == got["c"] == ("d", False) and got["x"] == got["y"] == (None, True) and "r" not in got


def brute(edges):
    out, into = {}, {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            into.setdefault(b, set()).add(a)
    return out, into


def test_coupling_and_clustering_on_random_graphs_with_a_hub(spark):
    pick = random.Random(4)
    edges = sorted({(pick.randrange(30), pick.randrange(30)) for _ in range(90)} | {(i, 0) for i in range(1, 25)} | {(0, 1), (0, 2)})
    out, into = brute(edges)
    nodes = sorted({x for e in edges for x in e})
    for least in (1, 2, 3):
        want = {}
        for i, a in enumerate(nodes):
            for b in nodes[i + 1 :]:
                score = 2 * ((b in out.get(a, ())) + (a in out.get(b, ()))) + len(out.get(a, set()) & out.get(b, set())) + len(into.get(a, set()) & into.get(b, set()))
                if score >= least:
                    want[a, b] = score
        got = {(r.a, r.b): r.coupling for r in G.coupling(spark.createDataFrame(edges, "src int, dst int"), least).collect()}
        assert got == want
    for r in G.clustering(spark.createDataFrame(edges, "src int, dst int")).collect():
        near = out.get(r.node, set()) | into.get(r.node, set())
        inside = sum(b in out.get(a, ()) for a in near for b in near)
        assert r.neighbours == len(near) and r.coefficient == pytest.approx(inside / (len(near) * (len(near) - 1)) if len(near) > 1 else 0.0, abs=1e-6)


def test_long_chains_are_walked_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src int, dst int")
    assert G.bfs(chain, spark.createDataFrame([(0,)], "node int")).count() == 70
    assert {r.level for r in G.topological_levels(chain).collect()} == set(range(71))
    assert {r.component for r in G.components(chain).collect()} == {0}
    names = spark.createDataFrame([(str(i), str(i + 1)) for i in range(70)], "name string, target string")
    assert {(r.target, r.broken) for r in G.pointer_targets(names).collect()} == {("70", False)}


def test_components_of_random_graphs(spark):
    pick = random.Random(7)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)]
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert {r.node: r.component for r in G.components(spark.createDataFrame(edges, "src int, dst int")).collect()} == least


def test_shortest_paths_and_communities(spark, calls):
    one = spark.createDataFrame([("entry1",)], "node string")
    got = {r.node: r.path for r in G.shortest_paths(calls, one).collect()}
    assert got["terminal1"] == ["entry1", "a", "b", "d", "terminal1"] and "e" not in got
    assert {r.community for r in G.communities(calls).where("node in ('e', 'f')").collect()} == {"e"}
    depth = {r.node: r.depth for r in G.longest_depths(spark.createDataFrame(CLASSES, "src string, dst string")).collect()}
    assert depth["A"] == 0 and depth["D"] == 2 and depth["E"] == 3 and depth["Z"] == 2


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert G.degrees(e).count() == G.pagerank(e).count() == G.components(e).count() == G.topological_levels(e).count() == G.simple_cycles(e, 3).count() == G.coupling(e).count() == G.clustering(e).count() == 0


def test_pagerank_sums_to_one(calls):
    ranks = [r["rank"] for r in G.pagerank(calls, 12).collect()]
    assert sum(ranks) == pytest.approx(1.0)


def test_impact_counts_all_dependents(spark):
    pick = random.Random(1)
    edges = sorted({(pick.randrange(40), pick.randrange(40)) for _ in range(52)})
    before = {n: {s for s, t in edges if t == n} for n in {x for e in edges for x in e}}

    def walk(node):
        seen, level, depth = {node}, {node}, 0
        while level := set().union(*(before[n] for n in level)) - seen:
            seen |= level
            depth += 1
        return len(seen) - 1, depth

    want = sorted(((n, *walk(n)) for n in before), key=lambda x: (-x[1], x[0]))[:10]
    got = G.impact(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
