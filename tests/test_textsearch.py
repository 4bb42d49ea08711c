import numpy as np
import pytest

from spanwright.operators import sections
from spanwright.operators import textsearch as T
from spanwright.operators.evaluation import drift_of
from spanwright.operators.fidelity import alignment, canonical, grounding, omissions
from spanwright.operators.relations import nearest_definition


@pytest.mark.parametrize("n_queries", [7, 0])
def test_nearest_against_brute_force(spark, n_queries):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)).round(1)
    x[3] = x[9] = x[11]
    x[5] = 0
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in T.nearest(df.repartition(5), df.where(f"vec_id < {n_queries}"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    for q in range(n_queries):
        s = np.round(u.astype(np.float32).astype(float) @ u[q], 5)
        order = [j for j in np.lexsort((np.arange(60), -s)) if j != q][:4]
        assert np.allclose([s[v] for _, v in sorted(got[q])], s[order], atol=1e-4)
    assert len(got) == n_queries


def test_windows_lines_and_density(spark):
    df = spark.createDataFrame([(1, "abcdef\ngh", 0), (2, "", 0), (3, None, 0)], "doc_id int, text string, line_no int")
    assert T.lines(df).count() == 3
    assert {r.doc_id: r.hits for r in T.density(df, "b").collect()} == {1: 1, 2: 0, 3: 0}


def test_sections(spark):
    text = "# A\nx\n## B\n```\n# no\n```\n### C\n## D\n# E"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    got = [(r.title, r.parent_line, r.end_line) for r in sections.section_tree(df).orderBy("line_no").collect()]
    assert got == [("A", None, 1), ("B", 0, 5), ("C", 2, 6), ("D", 0, 7), ("E", None, 8)]
    assert sections.fenced_lines(df).first().n_code == 1


def test_fidelity(spark):
    assert canonical("A “b”\nc-\nd") == 'a "b" cd'
    assert alignment("walks it", "he walks it now") == 1.0 and alignment("walks at", "he walks it now") > 0.7 > alignment("zzzz", "he walks")
    assert drift_of("f(a, b)", {"full": "f(a, b)", "no_types": "x"}) == 0 and drift_of(None, {"full": "f"}) is None and drift_of("f", {}) is None
    df = spark.createDataFrame([(1, "It walks. Zqx jv.", "It walks."), (2, None, "x"), (3, "a", None)], "id long, doc string, source string")
    got = {r.id: (r.n_units, r.grounded, r.score) for r in grounding(df).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, None), 3: (1, 0, None)}
    src = spark.createDataFrame([(1, "It walks along the shore.", "It walks along the shore. Then it sleeps for eleven hours. It walked along the shores."), (2, None, "x" * 20), (3, "a", None)], "id long, doc string, source string")
    assert [(r.id, r.unit_no, r.kind) for r in omissions(src).collect()] == [(1, 1, "omitted")]


def test_nearest_definition(spark):
    want = spark.createDataFrame([(1, "x", "a.b.c"), (2, "x", "a.q"), (3, "y", "z"), (4, "none", "z")], "want_id int, name string, module string")
    defs = spark.createDataFrame([(10, "x", "a"), (11, "x", "a.b"), (12, "x", "k.l"), (13, "x", "a.r"), (14, "y", "m")], "def_id int, name string, module string")
    assert {r.want_id: (r.def_id, r.tier) for r in nearest_definition(want, defs).collect()} == {1: (11, 1), 2: (10, 1), 3: (14, 2)}
