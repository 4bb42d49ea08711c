"""Property-graph operators over ``edges(src, dst)``; each is a program of joins and aggregates.

Fixpoints run level by level: only the frontier is joined, what is known is taken
off with an anti join, and the frontier is a written table, so lineage stays short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.runtime import discard, written, written_view


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """(node): every end of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, degree) over distinct edges: both directions counted in one aggregate."""
    ends = distinct_edges(edges).select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).withColumn("degree", F.col("fan_in") + F.col("fan_out"))


def graph_metrics(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, density, avg_fan_in, max_fan_in, max_fan_out): density is e / (n (n - 1)), 0 for fewer than two nodes."""
    d = degrees(edges)
    one = d.agg(F.count("*").alias("n_nodes"), F.sum("fan_in").alias("n_edges"), F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return one.select("n_nodes", "n_edges", F.coalesce(F.round(F.try_divide("n_edges", pairs), 9), F.lit(0.0)).alias("density"), F.coalesce(F.round(F.try_divide("n_edges", "n_nodes"), 6), F.lit(0.0)).alias("avg_fan_in"), "max_fan_in", "max_fan_out")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(seed, node, level): nodes reachable from each seed, the seed itself excluded even on a cycle; without max_depth to the end.

    Only the frontier is joined.  What is known is one table, rewritten when the
    levels since the last rewrite hold as many rows as it does, so a walk of any
    depth reads each row a logarithmic number of times and its plan stays short.
    """
    e = distinct_edges(edges)
    e = written(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else e, "edges")
    frontier = written(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("level", F.lit(0)), "bfs")
    known, recent, n_known, n_recent, level = frontier, [], frontier.count(), 0, 0
    while max_depth is None or level < max_depth:
        level += 1
        step = frontier.select("seed", F.col("node").alias("src")).join(e, "src").select("seed", F.col("dst").alias("node")).distinct()
        for part in (known, *recent):
            step = step.join(part.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = written(step.withColumn("level", F.lit(level)), "bfs")
        new = frontier.count()
        if not new:
            discard(frontier)
            break
        recent.append(frontier)
        n_recent += new
        if n_recent >= n_known or len(recent) > 8:
            old = [known, *recent]
            known = written(reduce(DataFrame.unionByName, old), "bfs")
            discard(*(t for t in old if t is not frontier))
            n_known, n_recent, recent = n_known + n_recent, 0, []
    return reduce(DataFrame.unionByName, [known, *recent]).where("level > 0")


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_edges: int | None = None) -> DataFrame:
    """(seed, node, path): a shortest path from each seed to every node in reach, the first in order of those of its length.

    max_edges bounds the length where the caller wants that; unset, walks go to the end.
    """
    e = written(distinct_edges(edges), "edges")
    frontier = written(seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("path")).distinct(), "paths")
    known, level = [frontier], 0
    while max_edges is None or level < max_edges:
        level += 1
        step = frontier.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), "path")
        best = step.groupBy("seed", "node").agg(F.min("path").alias("path")).select("seed", "node", F.concat("path", F.array("node")).alias("path"))
        seen = reduce(DataFrame.unionByName, known).select("seed", "node")
        frontier = written(best.join(seen, ["seed", "node"], "left_anti"), "paths")
        if frontier.isEmpty():
            break
        known.append(frontier)
        if len(known) > 16:
            known = [written(reduce(DataFrame.unionByName, known), "paths")]
    return reduce(DataFrame.unionByName, known).where("seed <> node")


def path_metrics(edges: DataFrame) -> DataFrame:
    """(connected_pairs, average_nodes, diameter_nodes) over all ordered pairs in reach; lengths count nodes."""
    d = bfs(edges, nodes_of(distinct_edges(edges)))
    n = F.col("level") + 1
    return d.agg(F.count("*").alias("connected_pairs"), F.coalesce(F.round(F.avg(n), 6), F.lit(0.0)).alias("average_nodes"), F.coalesce(F.max(n), F.lit(0)).alias("diameter_nodes"))


def impact(edges: DataFrame, k: int = 10) -> DataFrame:
    """(node, n_affected, max_depth) of the k nodes with the most nodes that depend on them at any distance; ties go to the least node.

    Counts are exact for every node without a pair per node and dependent: with a
    hub p, all that reach p (``above``, p included) reach whatever p reaches
    (``below``, p included).  So a node below p has all of ``above``, and walks to it
    from elsewhere keep clear of ``above``; a node not below p is reached by walks
    that keep clear of ``below``.  Depths are walked for the k nodes alone.
    """
    e = written(distinct_edges(edges), "edges")
    nodes = written(nodes_of(e), "nodes")
    p = degrees(e).orderBy(F.desc(F.col("fan_in") * F.col("fan_out")), "node").limit(1).select("node")
    p = written(p, "hub")
    above = written(bfs(e, p, reverse=True).select("node").unionByName(p), "above")
    below = written(bfs(e, p).select("node").unionByName(p), "below")

    def outside(cut: DataFrame, seeds: DataFrame) -> DataFrame:
        clear = e.join(cut.select(F.col("node").alias("src")), "src", "left_anti").join(cut.select(F.col("node").alias("dst")), "dst", "left_anti")
        return bfs(clear, seeds, reverse=True).groupBy(F.col("seed").alias("node")).agg(F.count("*").alias("more"))

    more = outside(above, below.join(above, "node", "left_anti")).unionByName(outside(below, nodes.join(below, "node", "left_anti")))
    base = below.crossJoin(F.broadcast(above.agg(F.count("*").alias("base"))))  # one row
    # a node does not count itself
    inside = base.join(above.withColumn("own", F.lit(1)), "node", "left").select("node", (F.col("base") - F.coalesce("own", F.lit(0))).alias("base"))
    count = (F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_affected")
    top = written(nodes.join(inside, "node", "left").join(more, "node", "left").select("node", count).orderBy(F.desc("n_affected"), "node").limit(k), "impact")
    depth = bfs(e, top, reverse=True).groupBy(F.col("seed").alias("node")).agg(F.max("level").alias("max_depth"))
    return top.join(depth, "node", "left").select("node", "n_affected", F.coalesce("max_depth", F.lit(0)).alias("max_depth"))


def simple_paths(edges: DataFrame, starts: DataFrame, max_edges: int, ends: Column | None = None) -> DataFrame:
    """(path): simple paths from the start nodes of 1 .. max_edges edges; the bound is part of the operator."""
    e = distinct_edges(edges)
    level = starts.select(F.array("node").alias("path")).distinct()
    found = []
    for _ in range(max_edges):
        last = F.element_at("path", -1)
        level = level.withColumn("src", last).join(e, "src").where(~F.expr("array_contains(path, dst)")).select(F.concat("path", F.array("dst")).alias("path"))
        found.append(level)
    out = reduce(DataFrame.unionByName, found)
    return out if ends is None else out.where(ends)


def simple_cycles(edges: DataFrame, max_edges: int) -> DataFrame:
    """(cycle): simple cycles of up to max_edges edges, each once, starting at its least node; self loops have one node."""
    e = distinct_edges(edges)
    loops = e.where("src = dst").select(F.array("src").alias("cycle"))
    level = e.where("src < dst").select(F.array("src", "dst").alias("path"))
    found = [loops]
    for size in range(2, max_edges + 1):
        last = level.withColumn("src", F.element_at("path", -1)).join(e, "src")
        found.append(last.where("dst = path[0]").select(F.col("path").alias("cycle")))
        if size < max_edges:
            level = last.where(F.expr("dst > path[0] and not array_contains(path, dst)")).select(F.concat("path", F.array("dst")).alias("path"))
    return reduce(DataFrame.unionByName, found)


def coupling(edges: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, coupling): pairs a < b whose score is at least ``least``: 2 per direct edge, 1 per common successor and per common predecessor.

    Linked or not, every such pair is found.  A node's neighbours are tokens
    ("out" x, "in" x).  Two nodes that share c tokens share one even after each
    left out its c - 1 most frequent ones, so only the others make candidates: a
    hub, frequent by definition, makes pairs only with nodes that have little else.
    """
    e = written(distinct_edges(edges).where("src <> dst"), "edges")
    pair = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg((2 * F.count("*")).alias("direct"))
    tokens = e.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit("out").alias("way"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.lit("in").alias("way"), F.col("src").alias("other")))))
    often = tokens.groupBy("way", "other").agg(F.count("*").alias("n"))
    ranked = tokens.join(often.where("n > 1"), ["way", "other"])
    for _ in range(least - 1):  # leaves out the most frequent token that each node still has
        top = ranked.groupBy("node").agg(F.max(F.struct("n", "way", "other")).alias("t")).select("node", "t.way", "t.other")
        ranked = ranked.join(top, ["node", "way", "other"], "left_anti")
    x, y = ranked.select("way", "other", F.col("node").alias("a")), ranked.select("way", "other", F.col("node").alias("b"))
    found = x.join(y, ["way", "other"]).where("a < b").select("a", "b").distinct()
    wanted = written(pair.select("a", "b").unionByName(found).distinct(), "pairs")
    t1, t2 = tokens.select(F.col("node").alias("a"), "way", "other"), tokens.select(F.col("node").alias("b"), "way", "other")
    common = wanted.join(t1, "a").join(t2, ["b", "way", "other"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    total = F.coalesce("direct", F.lit(0)) + F.coalesce("common", F.lit(0))
    return wanted.join(pair, ["a", "b"], "left").join(common, ["a", "b"], "left").select("a", "b", total.alias("coupling")).where(F.col("coupling") >= least)


def clustering(edges: DataFrame) -> DataFrame:
    """(node, neighbours, coefficient): directed edges among a node's neighbours over k (k - 1).

    Triangles are found at their corner of least degree (ties: least node), from
    where at most sqrt(2 m) edges lead on, so a hub's neighbours never meet each other.
    """
    e = distinct_edges(edges).where("src <> dst")
    both = written(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("w")), "pairs")
    k = both.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("neighbours"))
    da, db = k.select(F.col("node").alias("a"), F.col("neighbours").alias("ka")), k.select(F.col("node").alias("b"), F.col("neighbours").alias("kb"))
    low_a = F.struct("ka", "a") < F.struct("kb", "b")
    turned = both.join(da, "a").join(db, "b").select(
        F.when(low_a, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(low_a, F.col("b")).otherwise(F.col("a")).alias("high"), "w"
    )
    turned = written(turned, "turned")
    p, q = turned.select("low", F.col("high").alias("p"), F.col("w").alias("wp")), turned.select("low", F.col("high").alias("q"), F.col("w").alias("wq"))
    tri = p.join(q, "low").where("p < q").join(both.select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("w").alias("wpq")), ["p", "q"])
    corners = tri.select(F.inline(F.array(F.struct(F.col("low").alias("node"), F.col("wpq").alias("w")), F.struct(F.col("p").alias("node"), F.col("wq").alias("w")), F.struct(F.col("q").alias("node"), F.col("wp").alias("w")))))
    inside = corners.groupBy("node").agg(F.sum("w").alias("m"))
    value = F.when(F.col("neighbours") > 1, F.coalesce("m", F.lit(0)) / (F.col("neighbours") * (F.col("neighbours") - 1))).otherwise(F.lit(0.0))
    return k.join(inside, "node", "left").select("node", "neighbours", F.round(value, 6).alias("coefficient"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank): power iteration from 1/n; rank of nodes without successors is spread evenly.

    Each round writes what the nodes are given once (the row of node null is what
    nodes without successors would give); ranks follow from it and are not written.
    """
    e = written(distinct_edges(edges), "edges")
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    nodes = written(nodes_of(e).join(out, "node", "left"), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks, last = nodes.withColumn("rank", F.lit(1.0 / n)), None
    for _ in range(rounds):
        shares = ranks.join(e.withColumnRenamed("src", "node"), "node", "left").select(F.col("dst").alias("node"), (F.col("rank") / F.coalesce("k", F.lit(1))).alias("s"))
        given = written(shares.groupBy("node").agg(F.sum("s").alias("s")), "given")
        lost = given.where("node is null").select("s").first()  # one number
        base = (1 - damping) / n + damping * (lost[0] if lost else 0.0) / n
        ranks = nodes.join(given.where("node is not null"), "node", "left").select("node", "k", (F.lit(base) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if last is not None:
            discard(last)
        last = given
    return ranks.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected components, named by their least node.

    Contraction: every node points to the least of itself and its neighbours, the
    pointers are followed to their ends by doubling, and the graph of the ends is
    what is left.  At most half of the nodes are ends, so rounds shrink
    geometrically whatever the diameter; a hub is one aggregate's key.
    """
    e = distinct_edges(edges)
    nodes = written(nodes_of(e), "nodes")
    left, maps = written(e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "contracted"), []
    while not left.isEmpty():
        both = left.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
        to = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to")), "pointers")
        while True:  # the pointers lead to lesser nodes, so they end; each turn doubles their reach
            ahead = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            new = written(to.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            moved = not new.where("moved").isEmpty()
            discard(to)
            to = written_view(new, "node", "to")
            if not moved:
                break
        maps.append(to)
        ends = to.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        ends_b = to.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        step = left.join(ends, "a").join(ends_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        old, left = left, written(step, "contracted")
        discard(old)
    final = None
    for to in reversed(maps):
        if final is None:
            final = to
        else:
            final = to.join(final.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    if final is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(final, "node", "left").select("node", F.coalesce("to", "node").alias("component"))


def communities(edges: DataFrame, rounds: int = 5, least_size: int = 2) -> DataFrame:
    """(node, community): synchronous label propagation over undirected edges, from each node's own label.

    In each round a node takes the label most of its neighbours and itself bear,
    the least of equals; ``rounds`` is part of the operator.  Communities of fewer than
    ``least_size`` nodes are left out.
    """
    e = distinct_edges(edges).where("src <> dst")
    both = written(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = nodes_of(both).withColumn("label", F.col("node"))
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").select(F.col("src").alias("node"), "label").unionByName(labels)
        votes = heard.groupBy("node", "label").agg(F.count("*").alias("n"))
        labels = written(votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label")), "labels")
    size = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least_size).select("label")
    return labels.join(size, "label", "left_semi").select("node", F.col("label").alias("community"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): Kahn's levels (a node comes after all it depends on, edges run src -> dst); nodes on or behind cycles get -1.

    A node is at the level after that of its last predecessor.  Each round takes
    the edges of the level just found off the counts of what is left, to the end.
    """
    e = written(distinct_edges(edges), "edges")
    waits = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("waits"))
    rest = written(nodes_of(e).join(waits, "node", "left").select("node", F.coalesce("waits", F.lit(0)).alias("waits")), "topo")
    done, level = [], 0
    while True:
        free = written(rest.where("waits = 0").select("node", F.lit(level).alias("level")), "topo")
        if free.isEmpty():
            break
        done.append(free)
        gone = free.select(F.col("node").alias("src")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"))
        old = rest
        rest = written(rest.where("waits > 0").join(gone, "node", "left").select("node", (F.col("waits") - F.coalesce("k", F.lit(0))).alias("waits")), "topo")
        discard(old)
        level += 1
        if len(done) > 32:
            done = [written(reduce(DataFrame.unionByName, done), "topo")]
    return reduce(DataFrame.unionByName, [*done, rest.select("node", F.lit(-1).alias("level"))])


def with_inverse(edges: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """(src, dst, type) with the inverse edge of every type that has one, none twice."""
    inverse = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    back = edges.withColumn("t", F.try_element_at(inverse, F.col("type"))).where("t is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("t").alias("type"))
    return edges.select("src", "dst", "type").unionByName(back).distinct()


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges with both ends in ``keep(node)``."""
    return edges.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def pointer_targets(pointers: DataFrame) -> DataFrame:
    """(name, target, broken): follow (name -> target) to its end by pointer jumping; names that run into a cycle are broken and have no target.

    A pointer that does not end within as many steps as there are names never
    does, so log2 of their number rounds decide; if a name has several targets the least counts.
    """
    p = written(pointers.where("name is not null and target is not null").groupBy("name").agg(F.min("target").alias("target")), "pointers")
    n = p.count()
    for _ in range(n.bit_length() + 1):
        step = p.join(p.select(F.col("name").alias("target"), F.col("target").alias("next")), "target", "left").select("name", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved"))
        new = written(step, "pointers")
        p = new.select("name", "target")
        if new.where("moved").isEmpty():
            break
    ends = p.select(F.col("name").alias("target"), F.lit(True).alias("again")).distinct()
    broken = F.coalesce("again", F.lit(False))
    return p.join(ends, "target", "left").select("name", F.when(~broken, F.col("target")).alias("target"), broken.alias("broken"))


def longest_depths(edges: DataFrame) -> DataFrame:
    """(node, depth): edges of the longest path from a node along src -> dst to a node without successors; nodes that run into a cycle get 0.

    The topological level over reversed edges is just that; what Kahn's rounds leave over lies on or before a cycle.
    """
    levels = topological_levels(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return levels.select("node", F.greatest("level", F.lit(0)).alias("depth"))
