import random
from datetime import datetime

from spanwright.operators.hierarchy import hierarchy, member_hierarchy
from spanwright.operators.prefix import prefix_sums

MEMBERS = "id long, module_id long, name string, fully_qualified_name string, parent_id long, ingested_at timestamp, extra string"


def brute(nodes, tops):
    """nodes: id -> (parent, name, module)."""
    out = {}
    children = {}
    for i, (p, _, _) in nodes.items():
        children.setdefault(p, []).append(i)

    def below(i):
        seen, todo = set(), [i]
        while todo:
            for c in children.get(todo.pop(), []):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen - {i}

    for i in nodes:
        chain, at = [i], nodes[i][0]
        while at is not None and at not in chain:
            chain.append(at)
            at = nodes[at][0]
        n = len(below(i))
        if at is None:
            names = [nodes[x][1] or "" for x in reversed(chain)]
            out[i] = (chain[-1], len(chain) - 1, n, "/".join([tops.get(nodes[chain[-1]][2]) or "", *names]), "tree")
        else:
            loop = chain[chain.index(at):]
            out[i] = (min(loop), -1, n, "", "on_cycle" if at == i else "below_cycle")
    return out


def rows(df):
    return {r.member_id: (r.root_id, r.depth, r.n_descendants, r.path, r.status) for r in df.collect()}


def test_random_forests_with_cycles(spark):
    rng = random.Random(4)
    nodes = {}
    for i in range(400):
        pick = rng.random()
        parent = None if pick < 0.2 else rng.randrange(i) if i and pick < 0.93 else rng.randrange(400)
        nodes[i] = (parent, rng.choice(["a", "b", None]), rng.randrange(4))
    for i in range(400, 520):  # a deep chain, one hot parent
        nodes[i] = (i - 1 if i > 400 else None, f"n{i}", 1)
    for i in range(520, 700):
        nodes[i] = (410, "x", 9)
    tops = {0: "m0", 1: "m1", 2: None}
    df = spark.createDataFrame([(i, *v) for i, v in nodes.items()], "id long, parent long, name string, module_id long")
    mods = spark.createDataFrame(list(tops.items()), "module_id long, top string")
    found = hierarchy(df, mods)
    assert rows(found) == brute(nodes, tops)
    ranges = {r.member_id: r for r in found.where("status='tree'").collect()}
    for a in range(400, 500, 7):
        inside = [b for b in ranges.values() if b.root_id == ranges[a].root_id and ranges[a].range_start < b.range_start < ranges[a].range_end]
        assert len(inside) == ranges[a].n_descendants


def test_current_row_fqn_fallback_and_nulls(spark):
    t = lambda d: datetime(2024, 1, d)
    data = [
        (1, 1, "A", "m.A", None, t(1), "x"),
        (2, 1, "old", "m.zzz", 9, t(1), "x"),
        (2, 1, "f", "m.A.f", 99, t(3), "x"),  # parent 99 does not exist: by name
        (2, 1, "f", "m.A.f", 99, t(3), "x"),
        (3, 1, "g", "m.A.f.h.g", None, t(1), None),  # the longest prefix that exists is m.A.f
        (4, None, None, None, 4, t(1), None),  # its own parent
        (5, 7, "k", "", None, t(1), None),
        (None, 1, "n", "m.n", None, t(1), None),
    ]
    mods = spark.createDataFrame([(1, "m"), (1, "m")], "id long, name string")
    found = rows(member_hierarchy(spark.createDataFrame(data, MEMBERS), mods))
    assert found == {
        1: (1, 0, 2, "m/A", "tree"), 2: (1, 1, 1, "m/A/f", "tree"), 3: (1, 2, 0, "m/A/f/g", "tree"),
        4: (4, -1, 0, "", "on_cycle"), 5: (5, 0, 0, "/k", "tree"),
    }
    assert member_hierarchy(spark.createDataFrame([], MEMBERS), mods).count() == 0


def test_prefix_sums_over_split_groups(spark):
    data = [(g, i, v) for g, m in ((1, 3), (2, 5000), (3, 1), (4, 0), (5, 40)) for i in range(m) for v in ((i * 7) % 11,)]
    df = spark.createDataFrame(data, "g long, i long, v long")
    got = {(r.g, r.i): r.s for r in prefix_sums(df, "g", ["i"], "v", "s", 6).collect()}
    want, run = {}, {}
    for g, i, v in sorted(data):
        want[g, i] = run.get(g, 0)
        run[g] = want[g, i] + v
    assert got == want
