"""Inheritance on small class graphs with results worked out by hand."""

from spanwright.operators import graph as G
from spanwright.operators import inheritance as I

CLASSES = [("B", "A"), ("C", "A"), ("D", "B"), ("D", "C"), ("E", "D"), ("E", "Mixin1"), ("E", "Mixin2"), ("X", "A"), ("Y", "A"), ("Z", "X"), ("Z", "Y")]


def test_class_graph(spark):
    e = spark.createDataFrame(CLASSES + CLASSES[:1], "src string, dst string")
    im = spark.createDataFrame([("B", "Interface1"), ("D", "Interface2")], "src string, dst string")
    up = I.closure(e)
    assert {r.ancestor for r in up.where("cls = 'E'").collect()} == {"D", "B", "C", "A", "Mixin1", "Mixin2"}
    assert {r.cls: r.common for r in I.diamonds(e, up).collect()} == {"D": "A", "Z": "A"}
    assert {r.interface for r in I.interfaces_of(up, im).where("cls = 'E'").collect()} == {"Interface1", "Interface2"}
    assert {r.cls for r in I.implementers_of(up, im).where("interface = 'Interface1'").collect()} == {"B", "D", "E"}
    assert {r.cls for r in I.mixins(e).collect()} == {"A", "Mixin1", "Mixin2"}
    cards = {r.cls: r for r in I.class_cards(e, im).collect()}
    assert [cards[c].depth for c in "ABDE"] == [0, 1, 2, 3] and cards["A"].n_children == 4 and cards["A"].n_descendants == 7 and cards["E"].n_ancestors == 6
    pairs = spark.createDataFrame([("D", "Z"), ("B", "D"), ("E", "Mixin1"), ("Mixin1", "A")], "a string, b string")
    assert {(r.a, r.b): r.common for r in I.common_ancestors(up, G.longest_depths(e), pairs).collect()} == {("D", "Z"): "A", ("B", "D"): "B", ("E", "Mixin1"): "Mixin1", ("Mixin1", "A"): None}
    asked = spark.createDataFrame([("E", "A"), ("A", "E"), ("A", "A")], "child string, parent string")
    assert {(r.child, r.parent): r.subclass for r in I.is_subclass(up, asked).collect()} == {("E", "A"): True, ("A", "E"): False, ("A", "A"): False}


def test_inherited_members_breadth_first_and_cycles(spark):
    bases = spark.createDataFrame([("K", "P", 0), ("K", "Q", 1), ("P", "R", 0), ("Q", "R", 0), ("R", "K", 0)], "cls string, base string, idx int")
    members = spark.createDataFrame([("K", "own", 1), ("P", "a", 2), ("Q", "a", 3), ("Q", "b", 4), ("R", "b", 5), ("R", "own", 6), ("R", "_hid", 7), ("R", "__len__", 8)], "cls string, name string, member_id long")
    got = {(r.cls, r.name): (r.provider, r.level) for r in I.inherited_members(bases, members).collect()}
    assert got["K", "a"] == ("P", 1) and got["K", "b"] == ("Q", 1) and got["K", "__len__"] == ("R", 2) and ("K", "own") not in got and ("K", "_hid") not in got
    assert got["P", "own"] == ("R", 1) and got["R", "a"] == ("P", 2)
    assert I.inherited_members(bases.where("false"), members).count() == 0


def test_base_classes(spark):
    b = spark.createDataFrame([("m.C", "m", "Base", "other.Base"), ("m.D", "m", "ABC", "abc.ABC"), ("m.E", "m", "Imp", "x.Imp"), ("m.F", "m", "Far", "pkg.q.Far")], "cls string, module string, base_name string, base_fqn string")
    comps = spark.createDataFrame([("m", "m.Base")], "module string, fqn string")
    imps = spark.createDataFrame([("m", "Imp", "lib.Imp", True)], "module string, bound string, points_to string, internal boolean")
    got = {r.cls: (r.fqn, r.internal, r.how) for r in I.classified_bases(b, comps, imps, spark.createDataFrame([("pkg",)], "root string")).collect()}
    assert got == {"m.C": ("m.Base", True, "local"), "m.D": ("abc.ABC", False, "package"), "m.E": ("lib.Imp", True, "import"), "m.F": ("pkg.q.Far", True, "package")}
