"""A typed property graph: nodes(id, node_type, attrs) and edges(src, dst, type, key, attrs), attrs being maps of texts.

A graph is a pair of DataFrames and never changes: what the methods that add,
update or remove return is a new graph, so a batch of changes is one plan.  A
later row for the same node, or for the same (src, dst, key), replaces an earlier
one, with its attributes laid over the earlier ones; ends of edges are nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.operators import graph as G

# fixed values: relationship types with the type of the edge that runs back
INVERSE = {
    "DEFINES": "DEFINED_IN", "CONTAINS": "CONTAINED_BY", "IMPORTS": "IMPORTED_BY", "EXPORTS": "EXPORTED_FROM", "INHERITS": "INHERITED_BY", "IMPLEMENTS": "IMPLEMENTED_BY", "CALLS": "CALLED_BY", "USES": "USED_BY",
    "DECORATES": "DECORATED_BY", "OVERRIDES": "OVERRIDDEN_BY", "HAS_PARAMETER": "PARAMETER_OF", "RETURNS": "RETURNED_BY", "INSTANTIATES": "INSTANTIATED_BY", "REFERENCES": "REFERENCED_BY", "DEPENDS_ON": "DEPENDENCY_OF",
}
INVERSE |= {v: k for k, v in INVERSE.items()}
# fixed values: what each kind of relationship is stored as, and the attribute and default that go with it
KINDS = {
    "call": ("CALLS", None, None), "inheritance": ("INHERITS", None, None), "reference": ("REFERENCES", "reference_type", "variable"), "containment": ("CONTAINS", "container_type", "module"),
    "dependency": ("DEPENDS_ON", "dependency_type", "runtime"), "implementation": ("IMPLEMENTS", None, None), "usage": ("USES", "usage_type", "module"), "override": ("OVERRIDES", None, None), "access": ("ACCESSES", "access_type", "read"),
}
# fixed values: how node and edge types are drawn
NODE_COLOUR = {"module": "#4C78A8", "package": "#72B7B2", "class": "#F58518", "function": "#54A24B", "method": "#88D27A", "variable": "#B79A20"}
DASHED = ("IMPORTS", "DEPENDS_ON", "REFERENCES")

_MAP = "map<string,string>"


def _over(old: Column, new: Column) -> Column:
    """Map ``new`` laid over ``old``; null counts as empty."""
    empty = F.create_map().cast(_MAP)
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def _last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last ``value`` per key, the attributes of the new rows (order 1) laid over those of the old ones (order 0).

    Of several rows of a batch the greatest counts, so a key that half of all rows bear is one partial aggregate.
    """
    part = lambda k: F.max_by("attrs", F.when(F.col(order) == k, F.to_json("attrs"))).alias(f"a{k}")
    g = df.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value), part(0), part(1))
    return g.select(*keys, value, _over(F.col("a0"), F.col("a1")).alias("attrs"))


def _where(df: DataFrame, **equal: str | Column | None) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def _having(df: DataFrame, properties: dict[str, str] | None) -> DataFrame:
    """Rows whose attributes have all the given values."""
    for k, v in (properties or {}).items():
        df = df.where(F.coalesce(F.try_element_at("attrs", F.lit(k)) == v, F.lit(False)))
    return df


def edge_rows(rows: DataFrame, type_: str | None = None, attrs: Column | None = None, key: Column | None = None) -> DataFrame:
    """Rows (src, dst[, type]) as edges; the key is the type unless given."""
    t = F.lit(type_) if type_ else F.col("type")
    return rows.select("src", "dst", t.alias("type"), (t if key is None else key).alias("key"), (F.create_map().cast(_MAP) if attrs is None else attrs.cast(_MAP)).alias("attrs"))


def relationship(rows: DataFrame, kind: str, value: str | Column | None = None) -> DataFrame:
    """Rows (src, dst) as edges of one of ``KINDS``, with that kind's attribute set to ``value`` or its default."""
    type_, attribute, default = KINDS[kind]
    attrs = None
    if attribute:
        attrs = F.create_map(F.lit(attribute), F.coalesce(value if isinstance(value, Column) else F.lit(value), F.lit(default)))
    return edge_rows(rows, type_, attrs)


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    # building

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """A graph of rows that may repeat; ends of edges become nodes (of type null) where they are none."""
        return PropertyGraph(nodes.limit(0), edges.limit(0)).add(nodes, edges)

    def add(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> PropertyGraph:
        """Upsert; rows without id, source, target or type are left out."""
        order = F.lit(1)
        e = self.edges.withColumn("seq", F.lit(0))
        if edges is not None:
            good = edges.where("src is not null and dst is not null and type is not null")
            e = e.unionByName(good.select("src", "dst", "type", F.coalesce("key", "type").alias("key"), "attrs", order.alias("seq")))
        n = self.nodes.withColumn("seq", F.lit(0))
        if nodes is not None:
            n = n.unionByName(nodes.where("id is not null").select("id", "node_type", "attrs", order.alias("seq")))
        ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.lit(None).cast("string").alias("node_type"), F.create_map().cast(_MAP).alias("attrs"), F.lit(-1).alias("seq"))
        n = n.unionByName(ends)
        typed = n.groupBy("id").agg(F.max_by("node_type", F.when(F.col("node_type").isNotNull(), F.struct("seq", "node_type"))).alias("t"))
        kept = _last(n.withColumn("node_type", F.coalesce("node_type", F.lit(""))), ["id"], "seq", "node_type").join(typed, "id").select("id", F.col("t").alias("node_type"), "attrs")
        return PropertyGraph(kept, _last(e, ["src", "dst", "key"], "seq", "type").select("src", "dst", "type", "key", "attrs"))

    def add_relationships(self, edges: DataFrame) -> PropertyGraph:
        """As ``add``, with the edge that runs back for every type that has one, unless it is there already."""
        return self.add(edges=with_inverse(edges))

    def bulk_counts(self, edges: DataFrame) -> DataFrame:
        """(added, skipped) of a batch: rows that lack source, target or type are skipped."""
        good = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("type").isNotNull()
        return edges.agg(F.count_if(good).alias("added"), F.count_if(~good).alias("skipped"))

    def update(self, changes: DataFrame) -> PropertyGraph:
        """Attributes of existing nodes overlaid with those of (id, attrs); unknown ids change nothing."""
        c = changes.groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("attrs", "seq").alias("more")) if "seq" in changes.columns else changes.groupBy("id").agg(F.first("attrs").alias("more"))
        n = self.nodes.join(c.select("id", "more"), "id", "left").select("id", "node_type", F.when(F.col("more").isNull(), F.col("attrs")).otherwise(_over(F.col("attrs"), F.col("more"))).alias("attrs"))
        return PropertyGraph(n, self.edges)

    # removing

    def without_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Without the nodes of ids(id) and their edges."""
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(ids.select(F.col("id").alias(end)), end, "left_anti")
        return PropertyGraph(self.nodes.join(ids.select("id"), "id", "left_anti"), e.select(*self.edges.columns))

    def without_edges(self, source: str | None = None, target: str | None = None, type_: str | None = None, key: str | None = None, properties: dict[str, str] | None = None, inverse: bool = False) -> PropertyGraph:
        """Without the edges that match all that is given; with ``inverse`` also without those that run back from them."""
        gone = self.find(source, target, type_, properties, key).select("src", "dst", "key", "type")
        e = self.edges.join(gone.select("src", "dst", "key"), ["src", "dst", "key"], "left_anti")
        if inverse:
            back = gone.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.try_element_at(_inverse_map(), F.col("type")).alias("type")).where("type is not null")
            e = e.join(back, ["src", "dst", "type"], "left_anti")
        return PropertyGraph(self.nodes, e.select(*self.edges.columns))

    def without_module(self, module: str, types: Sequence[str] | None = None) -> PropertyGraph:
        """Without the edges (of some types) with an end in a module: its own name or one that begins with it and a dot."""
        inside = [(F.col(end) == module) | F.col(end).startswith(module + ".") for end in ("src", "dst")]
        hit = inside[0] | inside[1]
        return PropertyGraph(self.nodes, self.edges.where(~(hit if types is None else hit & F.col("type").isin(*types))))

    def without_prefix(self, prefix: str, type_: str) -> PropertyGraph:
        """Without the edges of a type with an end that begins with ``prefix``."""
        return PropertyGraph(self.nodes, self.edges.where(~((F.col("type") == type_) & (F.col("src").startswith(prefix) | F.col("dst").startswith(prefix)))))

    def cleared(self) -> PropertyGraph:
        return PropertyGraph(self.nodes.limit(0), self.edges.limit(0))

    # looking up

    def node(self, id_: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)

    def nodes_with(self, node_type: str | None = None, **attrs: str) -> DataFrame:
        return _having(_where(self.nodes, node_type=node_type), attrs)

    def find(self, source: str | None = None, target: str | None = None, type_: str | Sequence[str] | None = None, properties: dict[str, str] | None = None, key: str | None = None) -> DataFrame:
        """Edges that match all that is given."""
        e = _having(_where(self.edges, src=source, dst=target, key=key), properties)
        return e if type_ is None else e.where(F.col("type").isin(*([type_] if isinstance(type_, str) else type_)))

    def successors(self, id_: str, type_: str | None = None) -> DataFrame:
        """(node, type, attrs): one row per edge that leads out."""
        return self.find(source=id_, type_=type_).select(F.col("dst").alias("node"), "type", "attrs")

    def predecessors(self, id_: str, type_: str | None = None) -> DataFrame:
        return self.find(target=id_, type_=type_).select(F.col("src").alias("node"), "type", "attrs")

    def has_node(self, ids: DataFrame) -> DataFrame:
        """ids(id) with ``present``."""
        return ids.join(self.nodes.select("id", F.lit(True).alias("present")), "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))

    def has_edge(self, pairs: DataFrame, type_: str | None = None) -> DataFrame:
        """pairs(src, dst) with ``present``."""
        known = self.find(type_=type_).select("src", "dst").distinct().withColumn("present", F.lit(True))
        return pairs.join(known, ["src", "dst"], "left").select("src", "dst", F.coalesce("present", F.lit(False)).alias("present"))

    def edge_types(self) -> DataFrame:
        return self.edges.select("type").distinct()

    def counts(self) -> DataFrame:
        """(type, n): edges per type, and the nodes and edges under 'nodes' and 'edges'."""
        by = self.edges.groupBy("type").agg(F.count("*").alias("n"))
        total = self.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("type"), "n")
        return by.unionByName(total).unionByName(self.nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("type"), "n"))

    def neighbours(self) -> DataFrame:
        """(node, direction, type, other): every edge from both of its ends."""
        out = self.edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
        return out.unionByName(self.edges.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), "type", F.col("src").alias("other")))

    def node_metrics(self) -> DataFrame:
        """(node, in_degree, out_degree, degree, importance, in_types, out_types): per node its edges, by type as maps; importance is the share of all ends."""
        each = self.neighbours().groupBy("node", "direction", "type").agg(F.count("*").alias("n"))

        def per(d: str) -> Column:
            # as many entries as there are types
            return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("type", "n")))))

        m = each.groupBy("node").agg(
            F.sum(F.when(F.col("direction") == "in", F.col("n")).otherwise(0)).alias("in_degree"), F.sum(F.when(F.col("direction") == "out", F.col("n")).otherwise(0)).alias("out_degree"), F.sum("n").alias("degree"), per("in").alias("in_types"), per("out").alias("out_types")
        )
        total = self.edges.agg((2 * F.count("*")).alias("ends"))
        return m.crossJoin(F.broadcast(total)).select("node", "in_degree", "out_degree", "degree", F.round(F.col("degree") / F.col("ends"), 9).alias("importance"), "in_types", "out_types")  # one row

    # subgraphs

    def subgraph(self, ids: DataFrame) -> PropertyGraph:
        """Induced on ids(id)."""
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")
        return PropertyGraph(self.nodes.join(ids.select("id").distinct(), "id", "left_semi"), e.select(*self.edges.columns))

    def filtered(self, node: Column | None = None, edge: Column | None = None) -> PropertyGraph:
        """By predicates over the columns of nodes and of edges; edges that lose an end go."""
        g = self if node is None else self.subgraph(self.nodes.where(node).select("id"))
        return g if edge is None else PropertyGraph(g.nodes, g.edges.where(edge))

    def of_types(self, *types: str) -> PropertyGraph:
        """The edges of some types with their ends."""
        e = self.edges.where(F.col("type").isin(*types))
        return PropertyGraph(self.nodes.join(G.nodes_of(e).withColumnRenamed("node", "id"), "id", "left_semi"), e)

    def plain(self, *types: str) -> DataFrame:
        """(src, dst) of some types, for the operators of ``graph``."""
        return (self.edges if not types else self.edges.where(F.col("type").isin(*types))).select("src", "dst")

    def related(self, seeds: DataFrame, max_distance: int = 1, types: Sequence[str] = ()) -> DataFrame:
        """(seed, node, distance, path): what lies within a number of edges, either way, with a shortest path."""
        e = self.plain(*types)
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return G.shortest_paths(both, seeds, max_distance).select("seed", "node", (F.size("path") - 1).alias("distance"), "path")

    def paths_between(self, pairs: DataFrame, max_nodes: int = 5, types: Sequence[str] = ()) -> DataFrame:
        """(a, b, path): all simple paths of at most ``max_nodes`` nodes between the given pairs, both ways round: the bound is the operator's."""
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        paths = G.simple_paths(self.plain(*types), both.select(F.col("a").alias("node")).distinct(), max_nodes - 1)
        return paths.select(F.col("path")[0].alias("a"), F.element_at("path", -1).alias("b"), "path").join(both, ["a", "b"], "left_semi")

    def highlighted(self, pairs: DataFrame, max_nodes: int = 5, types: Sequence[str] = ()) -> DataFrame:
        """(src, dst, on_path): all edges (of the types), flagged where a path between a given pair runs over them."""
        paths = self.paths_between(pairs, max_nodes, types)
        steps = paths.select(F.inline(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1)))).toDF("src", "dst").distinct().withColumn("on", F.lit(True))
        return G.distinct_edges(self.plain(*types)).join(steps, ["src", "dst"], "left").select("src", "dst", F.coalesce("on", F.lit(False)).alias("on_path"))

    # drawing

    def visualization(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, links) with label, type, colour and size; type, style and weight."""
        colour = F.create_map(*[F.lit(x) for kv in NODE_COLOUR.items() for x in kv])
        kind = F.coalesce("node_type", node_kind("id"))
        n = self.nodes.select("id", F.element_at(F.split("id", "[.]"), -1).alias("label"), kind.alias("type"), F.coalesce(F.try_element_at(colour, kind), F.lit("#9D9DA1")).alias("colour"))
        links = self.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.when(F.col("type").isin(*DASHED), "dashed").otherwise("solid").alias("style"))
        return n, links

    def export(self, folder: str) -> None:
        """Nodes and links as JSON lines below a folder."""
        n, links = self.visualization()
        n.write.mode("overwrite").json(f"{folder.rstrip('/')}/nodes")
        links.write.mode("overwrite").json(f"{folder.rstrip('/')}/links")


def _inverse_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])


def with_inverse(edges: DataFrame) -> DataFrame:
    """The edges and, where their type has an inverse and no such edge is given, the edge that runs back."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.try_element_at(_inverse_map(), F.col("type")).alias("type"), F.col("attrs")).where("type is not null")
    back = back.withColumn("key", F.col("type")).dropDuplicates(["src", "dst", "type"]).join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return edges.select("src", "dst", "type", "key", "attrs").unionByName(back.select("src", "dst", "type", "key", "attrs"))


def node_kind(id_: str) -> Column:
    """What a name looks like: a dotted one with a capital last is a class, one below a class a method, one in lower case a function or a module."""
    p = F.split(id_, "[.]")
    last, before = F.element_at(p, -1), F.when(F.size(p) > 1, F.element_at(p, -2))
    capital = lambda c: c.rlike("^[A-Z]")
    return F.when(capital(last), "class").when(F.coalesce(capital(before), F.lit(False)), "method").when(F.size(p) > 1, "function").otherwise("module")


def import_edges(records: DataFrame) -> DataFrame:
    """Edges of import records: IMPORTS, with WILDCARD_IMPORT for star imports and MODULE_ALIAS or NAME_ALIAS for renamed ones.

    records: (importer, source, specifier, imported_name, alias, entity, points_to,
    is_relative, is_wildcard, level, line).  Without an importer a record gives
    nothing, without a source neither IMPORTS nor WILDCARD_IMPORT.
    """
    r = records.where("importer is not null").withColumn("wild", F.coalesce("is_wildcard", F.lit(False)))
    empty = F.array().cast("array<struct<dst:string,type:string,key:string,alias:string>>")
    has = F.col("source").isNotNull()

    def one(when: Column, dst: str, type_: str | Column, alias: Column) -> Column:
        t = F.lit(type_) if isinstance(type_, str) else type_
        key = F.concat_ws(":", t, F.coalesce(alias, F.when(t == "IMPORTS", F.col("imported_name"))))
        return F.when(when, F.array(F.struct(F.col(dst).alias("dst"), t.alias("type"), key.alias("key"), alias.alias("alias")))).otherwise(empty)

    none = F.lit(None).cast("string")
    whole = (F.col("specifier") == F.col("imported_name")) & (F.col("entity") == F.col("points_to")) & ~F.coalesce("is_relative", F.lit(False))
    alias_type = F.when(F.coalesce(whole, F.lit(False)), "MODULE_ALIAS").otherwise("NAME_ALIAS")
    aliased = F.col("alias").isNotNull() & ~F.col("wild") & F.col("points_to").isNotNull()
    each = F.concat(one(has, "source", "IMPORTS", none), one(has & F.col("wild"), "source", "WILDCARD_IMPORT", none), one(aliased, "points_to", alias_type, F.col("alias")))
    flat = r.select(F.col("importer").alias("src"), "level", "line", F.inline(each))
    attrs = F.map_filter(F.create_map(F.lit("alias_name"), F.col("alias"), F.lit("level"), F.col("level").cast("string"), F.lit("line"), F.col("line").cast("string")), lambda _, v: v.isNotNull())
    return flat.select("src", "dst", "type", "key", attrs.cast(_MAP).alias("attrs"))


def export_edges(records: DataFrame) -> DataFrame:
    """Edges (module -> target) of export records (module, target, name, is_explicit, is_reexport), keyed by the exported name so that one target may be exported twice; unlinked records give none."""
    attrs = F.create_map(F.lit("is_explicit"), F.coalesce(F.col("is_explicit").cast("string"), F.lit("false")), F.lit("is_reexport"), F.coalesce(F.col("is_reexport").cast("string"), F.lit("false")))
    return records.where("module is not null and target is not null").select(F.col("module").alias("src"), F.col("target").alias("dst"), F.lit("EXPORTS").alias("type"), F.concat(F.lit("EXPORT_"), "name").alias("key"), attrs.cast(_MAP).alias("attrs"))


def package_edges(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known(module), contains(src, dst)) of module(module): every dotted prefix is a known module or namespace package and contains the next."""
    p = F.split("module", "[.]")
    steps = modules.where("module is not null").select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "."))).alias("k", "part"), "module")
    known = steps.select(F.col("part").alias("module")).distinct()
    inner = known.where(F.col("module").contains(".")).select(F.regexp_replace("module", r"\.[^.]*$", "").alias("src"), F.col("module").alias("dst"))
    return known, inner
