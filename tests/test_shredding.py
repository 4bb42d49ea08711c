import json

from spanwright.operators.shredding import COMPONENT, decoded, entity_table, level_report, shred_results, shred_signatures, shred_tables, stripe

RESULTS = "result_id long, module_name string, module_interface string, components string, export_records string, id long, entity string"


def test_shapes_and_unreadable_cells(spark):
    comp = [
        {"name": "A", "fully_qualified_name": "m.A", "parameters": ["x", {"name": "y"}], "signature": "A(x)",
         "methods": [{"name": "f", "signature": [{"variant": "full", "text": None}], "parameters": {"p": "int", "q": None}}],
         "nested_classes": [{"name": "B", "fully_qualified_name": "m.A.B", "methods": [{"name": "g"}], "nested_classes": None}],
         "inherited_methods": {"h": {"signature": {"full": None, "no_types": "h()"}}, "k": {}}},
        {"name": "v", "fully_qualified_name": "m.v", "parent_fqn": "other"},
    ]
    data = [
        (1, "m", json.dumps({"all_values": ["A", "é"]}), json.dumps(json.dumps(comp)), json.dumps({"records": [{"exported_name": "A"}, {"exported_name": None}]}), 5, "e"),
        (1, "m", json.dumps({"all_values": ["A", "é"]}), json.dumps(json.dumps(comp)), json.dumps({"records": [{"exported_name": "A"}, {"exported_name": None}]}), 5, "e"),
        (2, "n", '{"all_values": ["A', "", None, 5, "e"),
        (3, None, "{}", json.dumps(comp), "[]", 5, "e"),
        (4, "o", "null", "{}", "[]", None, None),
    ]
    got = {tuple(r) for r in shred_results(spark.createDataFrame(data, RESULTS)).collect()}
    want = {
        ("component", "m.A", "m"), ("parameter", "m.A:x", "m.A"), ("parameter", "m.A:y", "m.A"), ("signature", "m.A:full", "m.A"),
        ("component", "m.A.f", "m.A"), ("signature", "m.A.f:full", "m.A.f"), ("parameter", "m.A.f:p", "m.A.f"), ("parameter", "m.A.f:q", "m.A.f"),
        ("component", "m.A.B", "m.A"), ("component", "m.A.B.g", "m.A.B"), ("inherited", "m.A:h", "m.A"), ("inherited", "m.A:k", "m.A"),
        ("inherited_signature", "m.A:h:full", "m.A:h"), ("inherited_signature", "m.A:h:no_types", "m.A:h"), ("component", "m.v", "other"),
        ("export", "A", "m"), ("all_value", "A", "m"), ("all_value", "é", "m"),
    }
    assert got == {(1, *w) for w in want}
    assert shred_results(spark.createDataFrame([], RESULTS)).count() == 0
    assert level_report(spark.createDataFrame(data, RESULTS)).where("group_path = 'components' and leaf = 'name'").first().n_real == 2


def test_tables_carry_every_leaf(spark):
    comp = {"m.A": {"name": "A", "fully_qualified_name": "m.A", "line_number": 7, "API_names": ["A", "m.A"], "signature": {"full": "A(x)"}, "parameters": [{"name": "x", "type": "int"}, {"name": "y", "default": "0"}], "odd": {"deep": [[1]]}}}
    exports = {"records": [{"exported_name": "A", "metadata": {"line": 3}, "wildcard_sources": ["p", "q"]}, {"target_item_fqn": "m.B"}]}
    interface = {"has_all": True, "all_values": ["A"], "imports": [{"raw_module_specifier": "p", "level": 1}, {"raw_module_specifier": "q"}]}
    row = (1, "m", json.dumps(interface), json.dumps(comp), json.dumps(exports), 5, "e")
    found = shred_tables(spark.createDataFrame([row, row, (2, "n", "{", None, "", 5, "e")], RESULTS))
    got = {(r.group_path, r.entry): (r.entity, r.parent_entry, r.item_key, dict(r.leaf_values)) for r in found.collect()}
    assert got["components", 0] == ("component", None, "m.A", {"(key)": "m.A", "name": "A", "fully_qualified_name": "m.A", "line_number": "7"})
    assert got["components.parameters", 1] == ("parameter", 0, "m.A:y", {"name": "y", "default": "0"})
    assert got["components.signature", 0] == ("signature", 0, "m.A:full", {"(key)": "full", "=": "A(x)"})
    assert [got["components.API_names", i][3]["(key)"] for i in (0, 1)] == ["A", "m.A"] and got["components.odd", 0][1] == 0
    assert got["export_records", 1][3] == {"target_item_fqn": "m.B"} and got["export_records.metadata", 0][3] == {"line": "3"} and got["export_records.wildcard_sources", 1][1] == 0
    assert got["module_interface.imports", 0][3] == {"raw_module_specifier": "p", "level": "1"} and got["module_interface.all_values", 0][2] == "A"
    assert {r.record_id for r in found.collect()} == {1}
    assert entity_table(found, "imports", level="int").where("level = 1").count() == 1


def test_deep_nesting_is_unreadable_or_whole(spark):
    def deep(k):
        return "[" + '{"name": "a", "nested_classes": [' * k + "]}" * k + "]"

    data = [(1, "m", None, deep(900), None, None, None), (2, "m", None, deep(60_000), None, None, None), (3, "m", "[" * 100_000, None, None, None, None)]
    got = shred_results(spark.createDataFrame(data, RESULTS)).groupBy("record_id").count().collect()
    assert got[0].record_id == 1 and got[0]["count"] == 900 and len(got) <= 2


def test_levels_rebuild_parents():
    value = [{"name": "a", "methods": []}, {"name": "b", "methods": [{"name": "x"}, {"name": "y"}]}, {"name": "c"}, {"name": "d", "methods": [{"name": "z"}]}]
    groups = stripe("c", COMPONENT, value).groups
    _, rep, defn, leaves = groups["c", "methods"]
    assert rep == [0, 1, 2, 1, 1] and defn == [1, 2, 2, 1, 2] and leaves["name"] == [None, "x", "y", None, "z"]


def test_signatures(spark):
    data = [(1, "f", '"f(x)"'), (2, "g", '"{\\"full\\": null}"'), (3, "h", '[{"variant": "bound", "text": "h()"}]'), (4, "i", '{"full": "i('), (5, "j", None), (6, "k", ""), (7, "l", "{}"), (8, "m", "m(x)"), (1, "f", '"f(x)"')]
    got = {tuple(r) for r in shred_signatures(spark.createDataFrame(data, "id long, member_name string, signature string")).collect()}
    assert got == {(1, "member_signature", "full", "f"), (2, "member_signature", "full", "g"), (3, "member_signature", "bound", "h"), (8, "member_signature", "full", "m")}
    assert decoded("7") == 7
