"""Evaluation and mending of documentation with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from spanwright.operators import docview as V
from spanwright.operators import evaluation as E
from spanwright.operators import maintenance as M

DOC = f"id long, member_type string, signature string, purpose string, info array<string>, parameters {V.PARAMETER}, returns struct<type:string,description:string>, examples {V.EXAMPLE}, notes array<string>, edge_cases array<string>"
TRUTH = "has_truth boolean, t_type string, t_parameters array<struct<name:string,type:string,default:string>>, t_returns string, t_async boolean, t_deprecated boolean, t_variants map<string,string>"


def doc(i, kind="function", signature=None, purpose=None, parameters=(), returns=None, examples=(), truth=None):
    t = truth if truth else (None,) * 7
    return (i, kind, signature, purpose, [], [tuple(p) for p in parameters], returns, [tuple(e) for e in examples], [], [], *t)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), f"{DOC}, {TRUTH}")


CODE = (True, "function", [("a", "int", None), ("b", "Optional[str]", "'x'"), ("c", None, "1.0")], "bool", True, True, {"full": "f(a: int, b='x', c=1.0)", "no_types": "f(a, b='x', c=1.0)"})
ONE = doc(1, signature="f(a, b)", purpose="Short one.", parameters=[("a", "integer", "the first value of it"), ("b", "str, optional", "Default: 'y'"), ("z", "Tensor", None)], returns=("str", None), examples=[("x = f(1)", None), ("N/A", None)], truth=CODE)
NONE = doc(2)


def test_completeness(spark):
    got = frame(spark, ONE, NONE, doc(3, "class", "class K", "A class that holds things.", truth=(True, "class", [], None, False, False, {"full": "K()"}))).select("id", *[c.alias(k) for k, c in E.completeness_metrics().items()], E.completeness_score(E.completeness_metrics()).alias("score"))
    m = {r.id: r.asDict() for r in got.collect()}
    assert (m[1]["SigCov"], m[1]["PurpCov"], m[1]["PTC"], m[1]["RC"], m[1]["ExC"]) == (1, 1, 1, 0.5, 1)
    assert m[1]["PaC"] == pytest.approx(2 / 3) and m[1]["PDC"] == pytest.approx(1 / 3)
    assert m[1]["score"] == pytest.approx(0.1 + 0.2 + 0.2 * 2 / 3 + 0.15 + 0.15 / 3 + 0.05 + 0.1)
    assert m[2]["score"] == pytest.approx(0.2 + 0.15 + 0.15)  # nothing documented, no parameters: those metrics are whole
    assert m[3]["score"] == pytest.approx((0.1 + 0.2 + 0.2 + 0.15 + 0.15 + 5 * 0.1 / 6))


def codes(df, column):
    return sorted(((r.id, r.code, r.target) for r in E.issue_rows(df.select("id", column.alias("issues"))).collect()), key=str)


def test_issues(spark):
    d = E.with_drift(E.with_matches(frame(spark, ONE)))
    assert codes(d, E.completeness_issues()) == [(1, "COMP_EXAMPLE_EMPTY", "1"), (1, "COMP_PARAM_DESCRIPTION_MISSING", "b"), (1, "COMP_PARAM_DESCRIPTION_MISSING", "z"), (1, "COMP_PARAM_NAME_MISSING", "c"), (1, "COMP_RETURN_DESCRIPTION_MISSING", None)]
    found = codes(d, E.accuracy_issues())
    assert (1, "ACC_PARAM_NAME_UNKNOWN", "z") in found and (1, "ACC_PARAM_MISSING_FROM_DOC", "c") in found and (1, "ACC_PARAM_DEFAULT_MISMATCH", "b") in found
    assert (1, "ACC_RETURN_TYPE_MISMATCH", None) in found and (1, "ACC_ASYNC_MARKER_MISSING", None) in found and (1, "ACC_DEPRECATED_NOT_NOTED", None) in found
    assert not any(c == "ACC_PARAM_TYPE_MISMATCH" for _, c, _ in found)  # integer is int, "str, optional" is Optional[str]
    assert codes(E.with_drift(E.with_matches(frame(spark, NONE))), E.accuracy_issues()) == []


def test_accuracy(spark):
    d = E.with_drift(E.with_matches(frame(spark, ONE, NONE)))
    m = E.accuracy_metrics()
    got = {r.id: r.asDict() for r in d.select("id", "drift", *[c.alias(k) for k, c in m.items()], E.accuracy_score(m).alias("score")).collect()}
    one = got[1]
    assert (one["PCA"], one["PNA"], one["PTC_acc"], one["PDA"], one["RTC"], one["AsyncMarker"], one["DeprecatedMarker"]) == (1, 0.5, 1, 0, 0, 0, 0)
    assert 0 < one["drift"] < 1 and one["score"] == pytest.approx(0.1 + 0.15 * 0.5 + 0.2 + 0.2 * (1 - one["drift"]))
    assert got[2]["score"] == 1.0 and got[2]["PCA"] is None and got[2]["drift"] is None


def test_text_and_code_readability(spark):
    text = "It is written here. It was seen twice by us. We run."
    row = spark.createDataFrame([(text,), ("one",)], "t string").select(E.text_metrics(F.col("t"), True).alias("m")).select("m.*", E.section_score(F.col("m"), False).alias("score")).collect()
    assert (row[0].words, row[0].sentences) == (12, 3) and row[0].passive == pytest.approx(2 / 3) and row[0].score == pytest.approx(1 - (2 / 3 - 0.4) * 1.25)
    assert row[0].spread == pytest.approx((((4 - 4) ** 2 + (6 - 4) ** 2 + (2 - 4) ** 2) / 3) ** 0.5) and row[0].fk is None and row[1].score == 1.0
    m = E.code_metrics("```python\n# note\nfor i in x:\n    if i and y:\n        print(i)\n```")
    assert (m["loc"], m["indent"], m["comments"], m["parses"], m["branches"]) == (4, 2, 1, True, 1)
    assert not E.code_metrics("def (")["parses"] and E.code_metrics(">>> a = 1\n>>> b")["output"]


def test_maintainability(spark):
    p = [("a", "Tensor", "the tensor of values"), ("b", "int(https://d/int)", "see Tensor and pkg.mod.f(https://d/f)"), ("c", "bool", None)]
    d = E.with_links(E.with_sections(frame(spark, doc(1, purpose="Uses url_placeholder_3 here.", parameters=p, returns=("str", "x")))))
    m = E.maintainability_metrics()
    got = d.select(*[c.alias(k) for k, c in m.items()]).first()
    # int(...) loses its link and is built in; Tensor is the only other type, and it has none
    assert got.TXRefC == 0 and got.BTRefC == pytest.approx(1 / 3) and got.ITR == pytest.approx(0.5)
    assert {"MAINT_BROKEN_PLACEHOLDER", "MAINT_TYPE_NOT_LINKED", "MAINT_BUILTIN_NOT_LINKED", "MAINT_INLINE_TYPE_RESTATEMENT"} <= {c for _, c, _ in codes(d, E.maintainability_issues())}
    share, missing = E.internal_references(d, spark.createDataFrame([("Tensor",), ("pkg.mod.f",)], "name string"))
    assert share.first().ixref == pytest.approx(1 / 2) and [r.target for r in missing.collect()] == ["Tensor"]


def test_reports(spark):
    direct = frame(spark, ONE)
    found = E.reports(direct, frame(spark, NONE), spark.createDataFrame([("Tensor",)], "name string"))
    r = {(x.route, x.id): x for x in found.collect()}
    assert not r["direct", 1].skipped and r["inherited", 2].skipped and r["inherited", 2].overall == 0 and 0 < r["direct", 1].overall < 1
    s = E.library_summary(found)
    assert s["total"].first().reports == 2 and s["total"].first().skipped == 1 and s["dimensions"].count() == 4
    assert "completeness" in M.html_report(s["total"], s["dimensions"], s["worst"])


def test_patches_and_their_application(spark):
    d = E.with_drift(E.with_matches(frame(spark, ONE)))
    rows = E.issue_rows(d.select("id", F.concat(E.completeness_issues(), E.accuracy_issues()).alias("issues")))
    made = {(r.code, r.json_path): r.new_value for r in M.patches(rows, d).collect()}
    assert json.loads(made["COMP_PARAM_NAME_MISSING", "$.parameters"]) == {"name": "c", "type": "N/A", "description": "Default: 1.0", "additional_information": "N/A"}
    assert made["ACC_RETURN_TYPE_MISMATCH", "$.returns.type"] == "bool" and made["ACC_PARAM_DEFAULT_MISMATCH", "$.parameters[?name=='b'].description"] == "Default: 'x'.  (corrected; previously: 'y')"
    assert ("ACC_ASYNC_MARKER_MISSING", "$.module_member_signature") not in made  # low severity
    docs = spark.createDataFrame([(1, json.dumps({"parameters": [{"name": "a"}, {"name": "b", "description": "d"}], "returns": {"type": "str"}})), (2, "{bad"), (3, None)], "id long, json string")
    done = {r.id: r for r in M.apply_patches(docs, M.patches(rows, d)).collect()}
    new = json.loads(done[1].candidate)
    assert new["returns"]["type"] == "bool" and [p["name"] for p in new["parameters"]] == ["a", "b", "c"] and new["parameters"][1]["description"].startswith("Default: 'x'")
    assert done[2].candidate == "{bad" and done[2].n_applied == 0
    cand = spark.createDataFrame([(1, docs.first().json, done[1].candidate, 4)], "id long, json string, candidate string, n_applied int")
    ids = spark.createDataFrame([(1,)], "id long")
    after = M.approved(docs, cand, ids)
    assert after.where("id = 1").first().json == done[1].candidate and M.rolled_back(after, docs, ids).where("id = 1").first().json == docs.first().json
    assert M.pending(cand, ids).count() == 0 and '+    "type": "bool"' in M.diff(docs.first().json, done[1].candidate)


def test_paths():
    d = {"a": [{"k": "x", "v": 1}], "o": {}}
    assert M.set_path(d, "$.a[?k=='x'].v", 2) and M.set_path(d, "$.a[0].w", 3) and M.set_path(d, "$.n.m", 4) and d == {"a": [{"k": "x", "v": 2, "w": 3}], "o": {}, "n": {"m": 4}}
    assert not M.set_path(d, "$.a[5].v", 1) and not M.set_path(d, "$.a[?k=='q'].v", 1) and not M.set_path(d, "oops", 1) and not M.set_path(d, "$.a..b", 1)


def test_signature_cells(spark):
    cells = [None, "", "{}", '{"full": "f(a: int, *b, c=(1, 2)) -> str", "no_types": "f(a)"}', '"g(x)"', '[{"variant": "default", "text": "h(y=[1, 2])"}]', '"{\\"no_types\\": \\"k(z)\\"}"', '{"full": "cut(', "bare(self, q: dict[str, int] = 1)"]
    got = [(r.t, [tuple(p) for p in r.p]) for r in spark.createDataFrame([(c,) for c in cells], "s string").select(V.signature_text("s").alias("t")).select("t", V.signature_parameters("t").alias("p")).collect()]
    assert got[3] == ("f(a: int, *b, c=(1, 2)) -> str", [("a", "int", None), ("b", None, None), ("c", None, "Default: (1, 2)")])
    assert got[4][0] == "g(x)" and got[5][1] == [("y", None, "Default: [1, 2]")] and got[6][0] == "k(z)" and got[7][0] is None and got[2] == (None, [])
    assert got[8][1] == [("q", "dict[str, int]", "Default: 1")]


def test_class_items(spark):
    items = spark.createDataFrame([(1, "method", "f", "f(a)", "does"), (1, "method", "g", None, None), (1, "attribute", "x (https://u)", None, "an x"), (1, "attribute", "y", None, "N/A"), (1, "method", "h", "zzz(qqqq, wwww)", "ok")], "id long, kind string, name string, signature string, description string")
    actual = spark.createDataFrame([(1, "method", "f", {"full": "f(a)"}), (1, "attribute", "x", {}), (1, "method", "h", {"full": "h(b)"})], "id long, kind string, name string, variants map<string,string>")
    assert sorted((r.code, r.target) for r in E.class_issues(items, actual).collect()) == [("ACC_CLASS_ATTR_NOT_FOUND", "y"), ("ACC_CLASS_METHOD_NOT_FOUND", "g"), ("ACC_CLASS_METHOD_SIG_DRIFT", "h"), ("COMP_CLASS_ATTR_DESC_MISSING", "y"), ("COMP_CLASS_METHOD_DESC_MISSING", "g")]
