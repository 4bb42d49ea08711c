"""Parent-child rows of unknown depth into full hierarchies, with cycle detection.

Three steps (with doubling, round k handles distance 2**k, so depth d costs
log2(d) rounds; rows that are done take no further part):

1. upward: every node's subtree size.  A node hands the size it has gathered so
   far to its 2**k-th ancestor, which thus learns of descendants twice as far.
2. what is still unprocessed when a round finishes no node lies on or below a
   cycle (see ``_upward``); those nodes are split into the two kinds, the cycles
   are cut, and what hangs below is sized like any tree.
3. downward: siblings get preorder ranges by distributed prefix sums of their
   sizes; start, depth, root and path follow from the parent's, level by level
   while levels are a good part of what is left, then by doubling for the deep rest.

``range_start``/``range_end`` are nested-set ranges within a root: b is a
descendant of a iff both have the same root and a.range_start < b.range_start
< a.range_end.

Hot parents: sums are combined map-side; in look-ups of an ancestor's state the
keys that hold more than a share of the rows (at most ``_HOT_KEYS`` of them by
construction) are joined by broadcasting just their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.prefix import prefix_sums
from spanwright.runtime import shuffle_partitions, written

_HOT_KEYS = 256


def current_rows(members: DataFrame) -> DataFrame:
    """One row per id, that of the latest ``ingested_at`` (ties: the greatest row); null ids are left out."""
    cols = ["ingested_at", "parent_id", "module_id", "name", "fully_qualified_name"]
    return members.where("id is not null").groupBy("id").agg(F.max(F.struct(*cols)).alias("r")).select("id", *[f"r.{c}" for c in cols[1:]])


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent``: by parent_id, else by the longest proper dotted prefix of the name that is a node's.

    nodes: (id, parent_id, fully_qualified_name, ...), unique by id.  If several
    nodes bear the prefix the smallest id counts.
    """
    ids = nodes.select(F.col("id").alias("parent"))
    by_id = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("parent")).join(ids, "parent", "left_semi")
    known = nodes.join(by_id, "id", "left")
    known = written(known, "known")
    parts = F.split("fully_qualified_name", "[.]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(k.alias("k"), F.concat_ws(".", F.slice(parts, F.lit(1), k)).alias("fqn")))
    orphans = known.where("parent is null and instr(fully_qualified_name, '.') > 0").select("id", F.explode(prefixes).alias("p")).select("id", "p.k", "p.fqn")
    names = known.where("fully_qualified_name is not null").groupBy(F.col("fully_qualified_name").alias("fqn")).agg(F.min("id").alias("of"))
    by_name = orphans.join(names, "fqn").where("id <> of").groupBy("id").agg(F.max_by("of", "k").alias("named"))
    return known.join(by_name, "id", "left").withColumn("parent", F.coalesce("parent", "named")).drop("named")


def _hot(rows: DataFrame, key: str, total: int) -> list[int]:
    """Keys with so many of the ``total`` rows that they would overfill a task: fewer than _HOT_KEYS."""
    least = max(total // _HOT_KEYS, 1_000_000 // shuffle_partitions(rows.sparkSession), 10_000)
    if total <= least:
        return []
    return [r[0] for r in rows.groupBy(key).count().where(F.col("count") > least).select(key).collect()]


def _look_up(left: DataFrame, key: str, right: DataFrame, hot: list[int], how: str = "inner") -> DataFrame:
    """Join on ``key``, unique in ``right``; rows of hot keys meet a broadcast of just those keys' rows."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    return left.where(~is_hot).join(right, key, how).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))


def _upward(forest: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Subtree sizes of (id, parent): what each node gained as rows (id, gain), its size being 1 + their sum;
    then (id) of the nodes on or below a cycle, and their number.

    Only nodes that have an ancestor 2**k up are active in round k.  If a node of
    finite depth were still active after it, its ancestors of depth 2**k ..
    2**(k+1)-1 would have ended in that round; so a round that ends no node
    leaves only nodes whose ancestors run into a cycle.
    """
    active = written(forest.where("parent is not null").select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size")), "up")
    count, gains = active.count(), []
    while count:
        gained = active.groupBy(F.col("anc").alias("id")).agg(F.try_sum("size").alias("gain"))
        if count > 100_000:
            gained = written(gained, "gains")
        gains.append(gained)
        hot = _hot(active, "anc", count)
        ahead = active.select(F.col("id").alias("anc"), F.col("anc").alias("next"))
        new = written(
            _look_up(active, "anc", ahead, hot).join(gained, "id", "left").select("id", F.col("next").alias("anc"), F.try_add("size", F.coalesce("gain", F.lit(0))).alias("size")),
            "up",
        )
        left = new.count()
        if left == count:
            return _all(gains), new.select("id"), left
        active, count = new, left
    return _all(gains) if gains else active.select("id", F.col("size").alias("gain")), active.select("id"), 0


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sizes(gains: DataFrame) -> DataFrame:
    return gains.groupBy("id").agg((F.try_sum("gain") + 1).alias("size"))


def _cycles(rest: DataFrame) -> DataFrame:
    """(id, parent, on_cycle, root_id) of the nodes on or below cycles, given (id, parent).

    f is the parent function.  The image of f**(2**k) shrinks to the nodes on
    cycles; once a further doubling leaves its size alone, f**(2**k) permutes it,
    so it is exactly those.  The smallest id on the cycle is the minimum over a
    window of ancestors that doubles until no node's minimum changes.
    """
    state = written(rest.select("id", "parent", F.col("parent").alias("anc"), F.least("id", "parent").alias("low")), "cycles")
    size, total = -1, state.count()
    while True:
        image = state.select(F.col("anc").alias("id")).distinct()
        now, changed = image.count(), 0
        done = now == size
        right = state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        new = _look_up(state, "anc", right, _hot(state, "anc", total)).select("id", "parent", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("ch"))
        new = written(new, "cycles")
        if done:
            changed = new.join(image, "id", "left_semi").where("ch").count()
        state = new.drop("ch")
        size = now
        if done and not changed:
            on = image.withColumn("on_cycle", F.lit(True))
            # anc is on the cycle now, and there every window holds the whole cycle's minimum
            lows = state.join(image, "id", "left_semi").select(F.col("id").alias("anc"), F.col("low").alias("root_id"))
            hot = _hot(state, "anc", total)
            split = _look_up(state.select("id", "parent", "anc"), "anc", lows, hot).join(on, "id", "left")
            return written(split.select("id", "parent", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), "root_id"), "cycles")


_STATE = ["id", "root_id", "depth", "range_start", "path", "size"]


def _below(rows: DataFrame) -> DataFrame:
    """The state of rows that carry their own (name, off) and their parent's state as p_*."""
    return rows.select(
        "id", F.col("p_root").alias("root_id"), (F.col("p_depth") + F.col("depth")).alias("depth"), (F.col("p_start") + F.col("off")).alias("range_start"), F.concat_ws("/", "p_path", "name").alias("path"), "size"
    )


def _as_parent(state: DataFrame, key: str) -> DataFrame:
    return state.select(F.col("id").alias(key), F.col("root_id").alias("p_root"), F.col("depth").alias("p_depth"), F.col("range_start").alias("p_start"), F.col("path").alias("p_path"))


def _downward(roots: DataFrame, children: DataFrame) -> DataFrame:
    """_STATE of a forest; roots already as _STATE, children as (id, parent, off, name, size)."""
    level = written(roots.select(*_STATE), "level")
    done, rest = [level], children.select("id", "parent", "off", "name", "size", F.lit(1).alias("depth"))
    total = rest.count()
    while total:
        hot = _hot(rest, "parent", total)
        joined = _look_up(rest, "parent", _as_parent(level, "parent"), hot, "left")
        split = written(joined, "split")
        level = _below(split.where("p_root is not null"))
        rest = split.where("p_root is null").select(*rest.columns)
        left = rest.count()
        done.append(level)
        if left and (total - left) * 8 < total:
            done.append(_deep(rest, level))
            break
        level = written(level, "level") if left > 100_000 else level
        total = left
    return _all(done)


def _deep(rest: DataFrame, level: DataFrame) -> DataFrame:
    """_STATE of the nodes below ``level``, by doubling among themselves, then one look-up of the topmost one's parent."""
    ids = rest.select(F.col("id").alias("parent"), F.lit(True).alias("inside"))
    state = written(
        _look_up(rest, "parent", ids, _hot(rest, "parent", rest.count()), "left").select("id", F.when(F.col("inside"), F.col("parent")).alias("anc"), F.when(F.col("inside").isNull(), F.col("parent")).alias("top"), "off", "name", "depth", "size"),
        "deep",
    )
    active = state.where("anc is not null").count()
    while active:
        moving = state.where("anc is not null")
        ahead = state.select(F.col("id").alias("anc"), F.col("anc").alias("a_anc"), F.col("top").alias("a_top"), F.col("off").alias("a_off"), F.col("name").alias("a_name"), F.col("depth").alias("a_depth"))
        moved = _look_up(moving, "anc", ahead, _hot(moving, "anc", active)).select(
            "id", F.col("a_anc").alias("anc"), F.col("a_top").alias("top"), (F.col("off") + F.col("a_off")).alias("off"), F.concat_ws("/", "a_name", "name").alias("name"), (F.col("depth") + F.col("a_depth")).alias("depth"), "size"
        )
        new = written(state.where("anc is null").unionByName(moved), "deep")
        state, active = new, new.where("anc is not null").count()
    tops = state.withColumnRenamed("top", "parent")
    return _below(_look_up(tops, "parent", _as_parent(level, "parent"), _hot(tops, "parent", tops.count())))


def hierarchy(nodes: DataFrame, top_names: DataFrame) -> DataFrame:
    """(member_id, root_id, depth, n_descendants, path, status, range_start, range_end), one row per node.

    nodes: (id, parent, name, module_id), unique by id, parent null for roots.
    top_names: (module_id, top) gives what a root's path begins with; a missing
    or null one counts as ''.  Null names count as ''.

    status ``tree``: root_id the topmost node, depth from 0, path ``top/.../name``.
    ``on_cycle`` / ``below_cycle``: root_id the smallest id on the cycle, depth -1,
    path '', ranges null.  n_descendants counts distinct other nodes below; on a
    cycle those are all others that run into it.  An empty table gives an empty one.
    """
    base = nodes.select("id", "parent", F.coalesce("name", F.lit("")).alias("name"), "module_id")
    gains, cyclic, n_cyclic = _upward(base)
    trees = base.join(cyclic, "id", "left_anti") if n_cyclic else base
    sized = written(trees.join(_sizes(gains), "id", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long"))), "sized")
    children = prefix_sums(sized.where("parent is not null").select("parent", "id", "size", "name"), "parent", ["id"], "size", "before")
    children = children.select("id", "parent", (F.col("before") + 1).alias("off"), "name", "size")
    tops = top_names.groupBy("module_id").agg(F.min("top").alias("top"))
    roots = sized.where("parent is null").join(tops, "module_id", "left").select(
        "id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("range_start"), F.concat_ws("/", F.coalesce("top", F.lit("")), "name").alias("path"), "size"
    )
    out = _downward(roots, children).select(
        F.col("id").alias("member_id"), "root_id", "depth", "path", F.lit("tree").alias("status"), "range_start", (F.col("range_start") + F.col("size")).alias("range_end")
    )
    out = out.withColumn("n_descendants", F.col("range_end") - F.col("range_start") - 1)
    if n_cyclic:
        found = _cycles(base.join(cyclic, "id", "left_semi").select("id", "parent"))
        cut = found.select("id", F.when(~F.col("on_cycle"), F.col("parent")).alias("parent"))
        joined = found.join(_sizes(_upward(cut)[0]), "id", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
        whole = joined.groupBy("root_id").agg(F.count("*").alias("component"))
        loops = joined.join(whole, "root_id").select(
            F.col("id").alias("member_id"), "root_id", F.lit(-1).alias("depth"), F.lit("").alias("path"), F.when(F.col("on_cycle"), "on_cycle").otherwise("below_cycle").alias("status"),
            F.lit(None).cast("long").alias("range_start"), F.lit(None).cast("long").alias("range_end"), (F.when(F.col("on_cycle"), F.col("component")).otherwise(F.col("size")) - 1).alias("n_descendants"),
        )
        out = out.unionByName(loops)
    return out.select("member_id", "root_id", "depth", "n_descendants", "path", "status", "range_start", "range_end")


def ancestor_links(found: DataFrame) -> DataFrame:
    """(ancestor_id, member_id, distance): every pair of a node and one above it, from the nested-set ranges of ``hierarchy``.

    Containment of a start in a range becomes an equi-join: an ancestor's range
    below its start is cut into the at most 2 log2(size) aligned blocks of powers
    of two that make it up, and a start lies in one block of each width.  The
    blocks of a range are disjoint, so a pair is found once; nodes without
    descendants take part as starts only.  Rows whose status is not ``tree`` have no ranges and give no pairs.
    """
    trees = found.where("status = 'tree'")
    blocks = trees.where("n_descendants > 0").select(F.col("member_id").alias("ancestor_id"), "root_id", F.col("depth").alias("above"), F.expr("range_start + 1").alias("lo"), F.col("range_end").alias("hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, roots, above, width, block = [], [], [], [], []
            for a, r, d, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                while lo < hi:
                    k = min((lo & -lo).bit_length() - 1 if lo else 62, (hi - lo).bit_length() - 1)
                    ids.append(a)
                    roots.append(r)
                    above.append(d)
                    width.append(k)
                    block.append(lo >> k)
                    lo += 1 << k
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64()), pa.array(above, pa.int32()), pa.array(width, pa.int32()), pa.array(block, pa.int64())], names=["ancestor_id", "root_id", "above", "width", "block"])

    blocks = blocks.mapInArrow(cut, "ancestor_id long, root_id long, above int, width int, block long")
    tops = blocks.groupBy("root_id").agg(F.max("width").alias("top"))
    points = trees.where("depth > 0").join(tops, "root_id").select("root_id", "member_id", "depth", "range_start", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("width"))
    points = points.select("root_id", "member_id", "depth", "width", F.expr("shiftright(range_start, width)").alias("block"))
    return points.join(blocks, ["root_id", "width", "block"]).select("ancestor_id", "member_id", (F.col("depth") - F.col("above")).alias("distance"))


def member_hierarchy(members: DataFrame, modules: DataFrame) -> DataFrame:
    """``hierarchy`` of the current rows of ``members``, paths starting with the module's name."""
    nodes = written(with_parents(current_rows(members)).select("id", "parent", "name", "module_id"), "nodes")
    return hierarchy(nodes, modules.select(F.col("id").alias("module_id"), F.col("name").alias("top")))
