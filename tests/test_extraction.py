"""Finding members in texts, on small texts."""

import difflib
import random

from pyspark.sql import functions as F

from spanwright.operators import extraction as E

MEMBER = "id long, api_name string, member_type string, variants map<string,string>"


def test_context_scores(spark):
    lines = {"- name (int) x": -30, "class Foo(a)": 20, "property size": 20, "method run(x)": 15, "classmethod make(x)": 10, "run(x) (https://h/p#run)": 15, "run(x) -> int": 10, "Like run() (#page=17)": -25, "class Foo(a) -> K": 30, "plain text": 0, "": 0}
    df = spark.createDataFrame([(k,) for k in lines], "l string")
    assert {r.l: r.s for r in df.select("l", E.context_score("l").alias("s")).collect()} == lines


def test_needles(spark):
    m = spark.createDataFrame([(1, "p.m.Foo", "class", {"full": "Foo(a, b)"}), (2, "p.Foo.run", "method", {"full": "run(self)"}), (3, "p.X", "variable", None), (4, "p.f", "function", {"full": "f(a)", "zz": "f(q)"})], MEMBER)
    got = {}
    for r in E.needles(m).orderBy("id", "tier", "place").collect():
        got.setdefault((r.id, r.tier), []).append(r.needle)
    assert got[1, "exact"] == ["class p.m.Foo(a, b)", "p.m.Foo(a, b)", "class Foo(a, b)", "Foo(a, b)"] and got[1, "anchor"] == ["p.m.Foo"]
    assert got[2, "anchor"] == ["run", "p.Foo.run", "Foo.run"] and got[2, "exact"] == ["run(self)", "Foo.run(self)", "p.Foo.run(self)"]
    assert (3, "exact") not in got and got[3, "anchor"] == ["X", "p.X"] and got[4, "exact"] == ["f(a)", "p.f(a)", "f(q)", "p.f(q)"]


def test_definition_lines_and_spans(spark):
    text = "intro on Foo(a, b)\n```\nFoo(a, b)\n```\n- Foo(a, b) is listed\nclass p.m.Foo(a, b)\n  body of foo\nx = Foo(a, b)\nproperty size: int\n  the size\nend"
    docs = spark.createDataFrame([(1, text, "Foo"), (2, None, None), (3, "See Bar on page 4", None)], "doc_id long, text string, title string")
    m = E.needles(spark.createDataFrame([(1, "p.m.Foo", "class", {"full": "Foo(a, b)"}), (2, "p.m.Foo.size", "variable", None), (3, "q.Bar", "variable", None)], MEMBER))
    lines = E.text_lines(docs)
    best = E.best_lines(E.line_matches(lines, m))
    got = {(r.doc_id, r.id): (r.line_no, r.score) for r in best.collect()}
    assert got[1, 1] == (5, 130.0) and got[1, 2][0] == 8 and got[3, 3][1] == 1.0
    spans = {r.id: (r.start_line, r.end_line, r.stopped) for r in E.spans(best.where("doc_id = 1"), lines).collect()}
    assert spans == {1: (5, 7, True), 2: (8, 10, False)}
    peers = spark.createDataFrame([(1, "size", "fallback"), (1, "other", "primary")], "id long, short string, kind string")
    only = E.spans(best.where("doc_id = 1 and id = 1"), lines, peers)
    assert (only.first().end_line, only.first().stopped) == (7, True)
    assert E.span_texts(docs, only).first().text == "class p.m.Foo(a, b)\n  body of foo\nx = Foo(a, b)"
    scores = {(r.doc_id, r.id): r.score for r in E.section_scores(docs, best, m).collect()}
    assert scores[3, 3] == 1.0 - 20 and scores[1, 2] > 50


def test_windows_cover_every_line():
    pick = random.Random(3)
    for _ in range(60):
        text = "".join(pick.choice(["ab", "c", "\n", "\n\n", "long " * 8]) for _ in range(pick.randrange(0, 60)))
        spans = E.line_windows(text, 60, 40)
        covered = set()
        for a, b in spans:
            assert a < b and (a == 0 or text[a - 1] == "\n") and (b == len(text) or text[b - 1] == "\n")
            covered |= set(range(a, b))
        assert covered == set(range(len(text)))
    assert E.line_windows("") == []


def test_similar_names_against_brute_force(spark):
    pick = random.Random(5)
    names = sorted({"".join(pick.choice("abcd._") for _ in range(pick.randrange(3, 14))) for _ in range(120)})
    wanted = names[::9] + ["zzzzzz"]
    got = {}
    for r in E.similar_names(spark.createDataFrame([(n,) for n in wanted], "name string"), spark.createDataFrame([(n,) for n in names], "name string")).collect():
        got.setdefault(r.name, []).append((r.rank, r.match))
    for q in wanted:
        scored = sorted(((round(100 * difflib.SequenceMatcher(None, q, n, autojunk=False).ratio(), 6), n) for n in names), key=lambda x: (-x[0], x[1]))
        assert [m for _, m in sorted(got.get(q, []))] == [n for s, n in scored if s > 60][:3]


def test_peers_and_signatures(spark):
    rows = [("class", None, "p.Other(x)", "primary"), ("class", None, "run(x)", "fallback"), ("method", "Foo", "p.Foo.go(x)", "primary"), ("method", "Foo", "p.Bar.go(x)", "never"), ("method", "Foo", "p.mod.go(x)", "fallback"), ("method", "Foo", "Foo", "fallback"), ("function", None, "anything", "primary")]
    df = spark.createDataFrame(rows, "t string, o string, p string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", E.peer_kind(F.col("t"), F.col("o"), F.col("p"))).collect())
    text = "foo(a,\n    b,\n    c=(1, 2))\nnext line\nbar(x)\nbaz(q,\n\nafter"
    got = {r.line_no: (r.n_lines, r.text) for r in E.joined_signatures(E.text_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()}
    assert got[0] == (3, "foo(a, b, c=(1, 2))") and got[3] == (1, "next line") and got[4] == (1, "bar(x)") and got[7][1] == "after"
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(E.signature_prefix(F.lit("f(a, b: dict[str, int], c=(1, 2), d)"))) == "f(a, b: dict[str, int], c=(1, 2)" and one(E.signature_prefix(F.lit("bare"))) == "bare"
    assert one(F.regexp(F.lit("my . func_name ("), E.tolerant_pattern(F.lit("my.func_name")))) and one(F.regexp(F.lit("FUNC NAME("), E.tolerant_pattern(F.lit("func_name"))))
    assert [one(E.prose_with_call(F.lit(x))) for x in ("Use f(x).", "f(a, b=1.)", "atol=f(1).", "pkg.mod.")] == [True, False, False, False]


def test_profiles(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)] + [(99, None)], "vec_id long, embedding array<float>")
    p = {r.query_id: r for r in E.score_profile(v.repartition(3), v.where("vec_id in (0, 1)")).collect()}
    assert p[0].n == 19 and p[0].best >= p[0].second and p[0].deviation > 0
    assert E.acceptance(E.score_profile(v, v.where("false"))).count() == 0


def test_fuzzy_and_similar_lines(spark):
    assert E.partial_ratio("abc", "xxabcxx") == 100 and E.partial_ratio("", "x") == 0
    df = spark.createDataFrame([(1, "load_tile(a)\nother words here\nx", ["load_tile"]), (2, None, ["a"])], "id long, text string, needles array<string>")
    got = {r.id: r.fuzzy for r in E.fuzzy_scores(df).collect()}
    assert got[2] == 0 and 50 < got[1] < 100
    pairs = spark.createDataFrame([(1, 1, "intro\nall about cats\nload_tile loads tiles\nend", "loads tiles", "load_tile(a)", "load_tile"), (2, 1, "", "q", "s", "n")], "doc_id long, id long, text string, query string, signature string, name string")
    assert [(r.doc_id, r.line_no) for r in E.similar_lines(pairs).collect()] == [(1, 2)]


def test_sections_and_aliases(spark):
    s = spark.createDataFrame([(1, 0, 1, 1, 10), (1, 1, 2, 2, 5), (1, 2, 2, 6, 10), (1, 3, 3, 2, 3)], "doc_id long, id long, level int, first_page int, last_page int")
    assert sorted(r.id for r in E.not_covered(s).collect()) == [0, 1, 2, 3]
    assert sorted(r.id for r in E.not_covered(s.where("id <> 0").unionByName(spark.createDataFrame([(1, 9, 1, 2, 10)], s.schema))).collect()) == [1, 2, 3]
    index = E.alias_index(spark.createDataFrame([(1, "p.Foo", ["q.Foo"]), (2, "p.foo", None), (3, "r.Bar", [])], "id long, api_name string, names array<string>"))
    asked = spark.createDataFrame([("p.Foo",), ("R.BAR",), ("module-x.y",), ("plain",), ("q.Foo",), (None,)], "name string")
    got = {r.name: (r.id, r.exact) for r in E.extraction_list(asked, index, spark.createDataFrame([(9,)], "id long")).collect()}
    assert got == {"p.Foo": (1, True), "q.Foo": (1, True), "R.BAR": (3, False)}
