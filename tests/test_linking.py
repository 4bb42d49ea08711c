"""Registry, property graph, ingestion and source extraction on small cases."""

import json

from pyspark.sql import functions as F

from spanwright.operators import ingest as N
from spanwright.operators import property_graph as P
from spanwright.operators import registry as R
from spanwright.operators.shredding import shred_tables
from spanwright.sources import pysource


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("x")).first().x


def test_star_imports_spread_through_chains_and_cycles(spark):
    exports = spark.createDataFrame([("a", "x", "a.x"), ("b", "x", "b.x"), ("b", "y", "b.y"), ("c", "z", None)], "module string, name string, target string")
    links = spark.createDataFrame([("c", "b", 1), ("c", "a", 0), ("d", "c", 0), ("a", "d", 0), ("q", "q", 0)], "module string, source string, turn int")
    got = {(r.module, r.name): (r.target, r.provider, r.depth) for r in R.expanded(exports, links).collect()}
    assert got["c", "x"] == ("a.x", "a", 1) and got["c", "y"] == ("b.y", "b", 1) and got["d", "x"] == ("a.x", "c", 2) and got["a", "x"] == ("a.x", "a", 0)
    assert got["a", "y"] == ("b.y", "d", 3) and got["d", "z"] == (None, "c", 1)


def test_imports(spark):
    rel = lambda p, lv, m: spark.range(1).select(R.resolve_relative(F.lit(p), F.lit(lv), F.lit(m)).alias("x")).first().x
    assert [rel("a.b.c", 0, "x"), rel("a.b.c", 1, "x"), rel("a.b.c", 3, None), rel("a", 2, "x"), rel("", 1, "x")] == ["x", "a.b.c.x", "a", None, None]
    imps = spark.createDataFrame([("m", "s"), ("m", "t"), ("n", "t")], "module string, source string")
    seen = spark.createDataFrame([("m", "s")], "module string, source string")
    assert {tuple(r) for r in R.observed_imports(imps, seen).collect()} == {("m", "s"), ("n", "t")}
    assert one(spark, "os.path", R.is_stdlib("v")) and not one(spark, "numpy", R.is_stdlib("v"))
    assert one(spark, "sk_x", R.distribution_names("v")) == ["sk_x", "sk-x", "scikit-_x", "python-sk_x", "pysk_x"]


def test_exports(spark):
    mods = spark.createDataFrame([("m", True, False, ["a", "b"]), ("d", True, True, ["z"]), ("n", False, False, None)], "module string, has_all boolean, is_dynamic boolean, names array<string>")
    defs = spark.createDataFrame([("m", "a", "m.a"), ("n", "f", "n.f"), ("n", "_g", "n._g")], "module string, name string, fqn string")
    imps = spark.createDataFrame([("m", "b", "o.b", False), ("n", "h", "o.h", False), ("n", "*", None, True)], "module string, bound string, points_to string, wildcard boolean")
    found = R.determined_exports(mods, defs, imps)
    assert {(r.module, r.name, r.how) for r in found.collect()} == {("m", "a", "listed"), ("m", "b", "listed"), ("n", "f", "defined"), ("n", "h", "imported")}
    rows = {(r.module, r.name): (r.target, r.is_reexport, r.needs_linking) for r in R.export_rows(found.unionByName(found.limit(1).select(F.lit("m").alias("module"), F.lit("ghost").alias("name"), F.lit("listed").alias("how"))), defs, imps).collect()}
    assert rows["m", "a"] == ("m.a", False, False) and rows["m", "b"] == ("o.b", True, False) and rows["m", "ghost"] == (None, True, True)


def test_scores(spark):
    score = lambda m, init: spark.range(1).select(R.target_score(F.lit(m), F.lit(init)).alias("x")).first().x
    assert [score("pkg", True), score("pkg.a", False), score("pkg._a.b", True), score("pkg.utils", False)] == [540.0, -10.0, -180.0, -210.0]
    s = {"is_init": F.lit(True), "export_import_ratio": F.lit(4.0), "external_import_ratio": F.lit(0.2), "reexport_ratio": F.lit(0.5), "has_all": F.lit(True), "has_docstring": F.lit(False)}
    # 1 + 5 + 2 + 0 + 1.5 + 2 + (2 - .5) = 13
    assert spark.createDataFrame([("pkg.a",)], "module string").select(R.boundary_score(s).alias("x")).first().x == 13.0
    chain = spark.createDataFrame([([("d", 2.0, False, "definition"), ("p", 8.0, True, "alias")],)], "c array<struct<module:string,boundary:double,explicit:boolean,how:string>>")
    # 20 - 1 + (.2 * .5 * 2) + (.8 * 1 * 2 + 1 - .5) + 5 + 1 = 27.3
    assert abs(chain.select(R.chain_score("c").alias("x")).first().x - 27.3) < 1e-9


def test_module_paths_keep_to_re_exporters(spark):
    edges = spark.createDataFrame([("p", "q"), ("q", "d"), ("p", "x"), ("x", "d"), ("q", "p")], "src string, dst string")
    allowed = spark.createDataFrame([("d.T", "q"), ("d.T", "p")], "target string, module string")
    pairs = spark.createDataFrame([("d.T", "p", "d")], "target string, module string, definition string")
    assert [r.path for r in R.module_paths(edges, allowed, pairs).collect()] == [["p", "q", "d"]]


def test_property_graph(spark):
    m = "map<string,string>"
    nodes = spark.createDataFrame([("a", "class", {"k": "1", "l": "2"}), ("a", "class", {"k": "1", "l": "2"}), (None, "x", {})], f"id string, node_type string, attrs {m}")
    edges = spark.createDataFrame([("a", "b", "CALLS", None, {}), ("a", "b", "CALLS", None, {}), ("a", "b", "USES", None, {"w": "1"}), ("b", None, "CALLS", None, {})], f"src string, dst string, type string, key string, attrs {m}")
    g = P.PropertyGraph.of(nodes, edges)
    assert {r.id: r.node_type for r in g.nodes.collect()} == {"a": "class", "b": None} and g.edges.count() == 2
    g2 = g.add(spark.createDataFrame([("a", "class", {"k": "9"})], nodes.schema))
    assert g2.node("a").first().attrs == {"k": "9", "l": "2"}
    assert g.update(spark.createDataFrame([("a", {"l": "7"})], f"id string, attrs {m}")).node("a").first().attrs == {"k": "1", "l": "7"}
    both = g.add_relationships(g.edges)
    assert {(r.src, r.dst, r.type) for r in both.edges.collect()} == {("a", "b", "CALLS"), ("b", "a", "CALLED_BY"), ("a", "b", "USES"), ("b", "a", "USED_BY")}
    assert {r.type for r in both.without_edges(type_="CALLS", inverse=True).edges.collect()} == {"USES", "USED_BY"}
    assert g.find(properties={"w": "1"}).count() == 1 and g.find("a", "b", "CALLS").count() == 1 and g.nodes_with("class", k="1").count() == 1
    assert g.without_nodes(spark.createDataFrame([("b",)], "id string")).edges.count() == 0 and g.cleared().nodes.count() == 0
    assert g.without_prefix("b", "USES").edges.count() == 1
    c = g.bulk_counts(edges).first()
    assert (c.added, c.skipped) == (3, 1)


def test_import_edges(spark):
    schema = "importer string, source string, specifier string, imported_name string, alias string, entity string, points_to string, is_relative boolean, is_wildcard boolean, level int, line int"
    rows = [("m", "foo.bar", "foo.bar", "foo.bar", "fb", "foo.bar", "foo.bar", False, False, 0, 1), ("m", "foo", "foo", "baz", "b", "foo.baz", "foo.baz", False, False, 0, 2), ("m", "st", "st", "*", None, None, None, False, True, 0, 3), (None, "x", "x", "x", None, "x", "x", False, False, 0, 4), ("m", None, "y", "y", None, None, None, False, False, 0, 5)]
    got = {(r.dst, r.type, r.attrs.get("alias_name")) for r in P.import_edges(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("foo.bar", "IMPORTS", None), ("foo.bar", "MODULE_ALIAS", "fb"), ("foo", "IMPORTS", None), ("foo.baz", "NAME_ALIAS", "b"), ("st", "IMPORTS", None), ("st", "WILDCARD_IMPORT", None)}


def test_ingestion(spark):
    comp = {"p.A": {"name": "A", "fully_qualified_name": "p.A", "component_kind": "class", "signature": {"full": "A()"}, "inherited_methods": {"h": {"original_fqn": "p.B.h"}}, "methods": [{"name": "_f", "fully_qualified_name": "p.A._f", "component_kind": "method"}]}, "p.B.h": {"name": "h", "fully_qualified_name": "p.B.h"}}
    exports = [{"exported_name": "A", "target_item_fqn": "p.A"}, {"exported_name": "gone", "target_item_fqn": "z.z"}, {"target_item_fqn": "p.A"}]
    data = [(1, "p", json.dumps({"is_init_file": True}), json.dumps(comp), json.dumps(exports)), (2, "p", json.dumps({"is_init_file": False}), json.dumps(comp), "[]"), (3, "q", None, None, None)]
    res = spark.createDataFrame(data, "result_id long, module_name string, module_interface string, components string, export_records string")
    names = res.select(F.col("result_id").alias("record_id"), F.col("module_name").alias("module"))
    t = N.load(shred_tables(res), names)
    assert {r.name: r.is_package for r in t["modules"].collect()} == {"p": True, "q": False}
    members = {r.fully_qualified_name: r for r in t["members"].collect()}
    assert set(members) == {"p.A", "p.A._f", "p.B.h"} and members["p.A._f"].parent_id == members["p.A"].id and members["p.A._f"].access_modifier == "protected" and members["p.B.h"].member_type == "unknown"
    assert {(r.exported_name, r.target_member_id is not None) for r in t["exports"].collect()} == {("A", True), ("gone", False)}
    assert t["inherited_members"].first().original_member_id == members["p.B.h"].id and t["signatures"].first().signature_text == "A()"
    known = spark.createDataFrame([(1, "p.A", "pub.A", ["alt.A"], None), (2, "p.B", None, None, "old")], "id long, fully_qualified_name string, primary_api_name string, all_api_names array<string>, doc string")
    docs = spark.createDataFrame([("alt.A", 1, "one"), ("pub.A", 2, "two"), ("pub.A", 3, None), ("nope", 4, "x")], "name string, seq long, doc string")
    patched, counts = N.ingest_documents(docs, known, ["doc"])
    assert {r.id: r.doc for r in patched.collect()} == {1: "two", 2: "old"} and tuple(counts.first()) == (3, 1)
    assert set(N.empty_tables(spark)) == set(N.TABLES)


def test_document_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"fqn": "m.f", "x": 1}))
    (tmp_path / "b.name.json").write_text("{}")
    (tmp_path / "c.json").write_text("{broken")
    assert {r.name for r in N.document_files(spark, str(tmp_path)).collect()} == {"m.f", "b.name"}


def test_calls_and_uses_in_sources():
    src = "import os, sys as s\nfrom .a import b as c\nclass A(c):\n    def f(self):\n        self.g()\n        super().f()\n        os.path.join()\n        def inner(): pass\n        inner()\n    @staticmethod\n    def g(*a, **k): pass\n    @property\n    def get_x(self): return A.g()\ntry:\n    pass\nexcept ImportError:\n    class B: pass\n__all__ = ['A'] + c.__all__\n"
    rows = pysource.rows_of(src)
    calls = {r[1]: (r[2], r[6]["target"], r[6]["how"]) for r in rows if r[0] == "call"}
    assert calls["self.g"] == ("A.f", ":A.g", "self") and calls["super().f"][1:] == (".a.b.f", "super") and calls["os.path.join"][1:] == ("os.path.join", "import") and calls["inner"][1:] == (":A.f.inner", "local") and calls["A.g"][1:] == (":A.g", "class")
    assert {r[1]: r[6]["used"] for r in rows if r[0] == "import"} == {"os": True, "s": False, "c": True}
    by = {r[1]: r[6] for r in rows if r[0] in ("function", "class", "exports")}
    assert by["g"]["overload"] == "primary" and by["g"]["method_type"] == "static" and by["get_x"]["names"] == ["get_x", "x", "x_property", "x_getter", "x.getter"] and by["B"]["fallback"] and not by["A"]["fallback"] and by["__all__"]["sources"] == ["c"]
    assert pysource.instance_attributes("class K:\n    z = 1\n    def f(self):\n        self.a = self._b = 2\n") == ["a", "z"] and pysource.instance_attributes("def (") == []
