"""Deeply nested semi-structured records into flat tables (columnar shredding).

A record is striped into one column group per repeated path.  Each entry of a
group has a repetition level (the depth of the repeated ancestor at which it
starts anew) and a definition level (how many of the repeated ancestors on its
path are really there); the leaves right below a group share its levels, a
present leaf counting one more.  A parent without items leaves one placeholder
entry, so the tables can be put together again from the levels alone: the n-th
entry that begins below its own depth belongs to the n-th entry of the parent.

Paths are found as the data shows them, so recursive shapes (classes within
classes) need no depth bound, and leaves and repeated fields that no schema names
are striped like the others (``shred_tables``, ``shredded_levels``); the key rows of
``shred_results`` need the named ones only.  Shapes that mean the same (object keyed by name,
list of objects, list of names, bare text, text that is JSON again) are made one
before striping.

Defined results: null, empty, truncated or otherwise unreadable cells (nested
deeper than the JSON reader goes, too) give no rows; repeated rows give their rows once; an empty table gives an empty table;
other columns of the input are ignored.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.runtime import spread

UNREADABLE = object()

ROWS = "record_id long, entity string, item_key string, parent_key string"
LEVELS = "record_id long, group_path string, rep array<int>, def array<int>, leaf string, leaf_values array<string>"


class Group:
    """A repeated group of the schema: the leaves right below it that are keys, and repeated fields.

    keyed: what an object in the group's place means: ``"map"`` for name -> item.
    bare: the key of the only item when the whole field is one text.
    """

    def __init__(self, leaves: Iterable[str] = (), *, keyed: bool = False, bare: str | None = None):
        self.leaves = tuple(leaves)
        self.keyed, self.bare = keyed, bare
        self.fields: dict[str, Group] = {}

    def items(self, value: object) -> list[dict]:
        """The field's items as objects; ``""`` holds the key or the text of an item, ``"="`` what a key maps to."""
        if value is None:
            return []
        if isinstance(value, str):
            return [{"": self.bare, "=": value}] if self.bare else []
        if isinstance(value, dict):
            if not self.keyed:
                return [value]
            return [({**v, "": k} if isinstance(v, dict) else {"": k, "=": v}) for k, v in value.items()]
        if isinstance(value, list):
            return [x if isinstance(x, dict) else {"": x} for x in value if x is not None]
        return []


#: What a field that no schema names is: a list or an object of whatever it holds.
ANY = Group([""])


def decoded(cell: str | None) -> object:
    """The JSON value of a cell, with text that is JSON again opened; UNREADABLE if it has none."""
    if cell is None or not cell.strip():
        return UNREADABLE
    try:
        value = json.loads(cell)
    except RecursionError:
        return UNREADABLE
    except ValueError:
        return UNREADABLE if cell.lstrip()[:1] in '{["' else cell
    while isinstance(value, str):
        if value.lstrip()[:1] not in ("{", "[", '"'):
            return value
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return UNREADABLE
    return value


class Stripes:
    """The level sequences of one record: per group path its repetition and definition levels and leaf values.

    whole: stripe the leaves and repeated fields that no schema names as well.
    """

    __slots__ = ("groups", "whole", "loose")

    def __init__(self, whole: bool = False) -> None:
        self.groups: dict[tuple[str, ...], tuple[Group, list[int], list[int], dict[str, list]]] = {}
        self.whole = whole
        self.loose: dict[tuple[str, ...], dict[str, Group]] = {}

    def _open(self, path: tuple[str, ...], group: Group):
        found = self.groups.get(path)
        if found is None:
            rep: list[int] = []
            defn: list[int] = []
            if len(path) > 1:  # parents seen before the path first occurred: placeholders
                parent = self.groups[path[:-1]]
                rep.extend(parent[1][:-1])
                defn.extend(parent[2][:-1])
            found = self.groups[path] = (group, rep, defn, {x: [None] * len(rep) for x in group.leaves})
        return found

    def add(self, path: tuple[str, ...], group: Group, items: list[dict], rep: int) -> None:
        """Stripe the items of a repeated field whose parent entry began at level ``rep``."""
        depth = len(path)
        _, reps, defs, leaves = self._open(path, group)
        for item in items:
            reps.append(rep)
            defs.append(depth)
            fields = group.fields
            if self.whole:
                loose = self.loose.setdefault(path, {})
                for k, v in item.items():
                    if v is not None and k not in fields and k not in leaves:
                        if isinstance(v, (dict, list)):
                            loose[k] = ANY
                        else:
                            leaves[k] = [None] * (len(reps) - 1)
                fields = {**fields, **loose}
            for name, values in leaves.items():
                values.append(item.get(name))
            for name, child in fields.items():
                below = child.items(item.get(name))
                if below:
                    self.add((*path, name), child, below, rep)
                elif (*path, name) in self.groups:
                    self._missing((*path, name), rep, depth)
            rep = depth

    def _missing(self, path: tuple[str, ...], rep: int, defn: int) -> None:
        """One placeholder entry, here and in every group seen below."""
        for p, (_, reps, defs, leaves) in self.groups.items():
            if p[: len(path)] == path:
                reps.append(rep)
                defs.append(defn)
                for values in leaves.values():
                    values.append(None)

    def tables(self) -> Iterator[tuple[tuple[str, ...], Group, list[int], list[bool], dict[str, list]]]:
        """Each group's table rebuilt from its levels: path, schema, parent entry of each entry, whether it is real, leaves."""
        for path, (group, reps, defs, leaves) in self.groups.items():
            depth, at, parents = len(path), -1, []
            for r in reps:
                if r < depth:
                    at += 1
                parents.append(at)
            yield path, group, parents, [d >= depth for d in defs], leaves


SIGNATURE = Group(["", "variant"], keyed=True, bare="full")
PARAMETER = Group(["", "name"], keyed=True)
INHERITED = Group(["", "name", "member_name"], keyed=True)
INHERITED.fields = {"signature": SIGNATURE}
COMPONENT = Group(["", "name", "fully_qualified_name", "parent_fqn"], keyed=True)
COMPONENT.fields = {"parameters": PARAMETER, "signature": SIGNATURE, "inherited_methods": INHERITED, "methods": COMPONENT, "nested_classes": COMPONENT}
EXPORT = Group(["exported_name"])
ALL_VALUE = Group([""])
INTERFACE = Group()
INTERFACE.fields = {"all_values": ALL_VALUE}


def stripe(root: str, group: Group, value: object, whole: bool = False) -> Stripes:
    """Shred one decoded cell below the root path."""
    out = Stripes(whole)
    items = group.items(value)
    if items:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 1_000_000))  # depth is bounded by what the JSON reader took
        try:
            out.add((root,), group, items, 0)
        finally:
            sys.setrecursionlimit(limit)
    return out


def _text(x: object) -> str | None:
    return x if isinstance(x, str) and x else None


def component_keys(stripes: Stripes, module_name: str) -> Iterator[tuple]:
    """(path, group, entity, keys, parent_keys, parents, real, leaves) per group; a null key makes no row."""
    keys: dict[tuple[str, ...], list[str | None]] = {}
    for path, group, parents, real, leaves in stripes.tables():
        above = keys.get(path[:-1])
        mine: list[str | None] = []
        owners: list[str | None] = []
        kind = path[-1]
        if group is COMPONENT:
            kind = "component"
            for key, name, fqn, given, parent, there in zip(leaves[""], leaves["name"], leaves["fully_qualified_name"], leaves["parent_fqn"], parents, real):
                f = outer = None
                if there:
                    outer = above[parent] if above else None
                    f = _text(fqn) or (None if above else _text(key) if isinstance(key, str) and "." in key else None)
                    if f is None and (_text(name) or _text(key)):
                        f = f"{outer or module_name}.{_text(name) or key}"
                mine.append(f)
                owners.append(outer or _text(given) or module_name)
        else:
            kind = {PARAMETER: "parameter", INHERITED: "inherited", SIGNATURE: "inherited_signature" if path[-2:-1] == ("inherited_methods",) else "signature"}.get(group, kind)
            for i, (parent, there) in enumerate(zip(parents, real)):
                owner, k = above[parent] if there and above else None, None
                if owner is not None:
                    if group is PARAMETER:
                        k = _text(leaves["name"][i]) or _text(leaves[""][i])
                    elif group is SIGNATURE:
                        k = _text(leaves["variant"][i]) or _text(leaves[""][i])
                    elif group is INHERITED:
                        k = _text(leaves[""][i]) or _text(leaves["name"][i]) or _text(leaves["member_name"][i])
                    else:
                        k = str(i)
                    if k is not None:
                        k = f"{owner}:{k}"
                mine.append(k)
                owners.append(owner)
        keys[path] = mine
        yield path, group, kind, mine, owners, parents, real, leaves


def component_rows(stripes: Stripes, module_name: str) -> Iterator[tuple[str, str, str]]:
    """(entity, item_key, parent_key) of the components and what hangs on them."""
    for _, _, kind, mine, owners, _, _, _ in component_keys(stripes, module_name):
        for k, owner in zip(mine, owners):
            if k is not None:
                yield kind, k, owner


def result_rows(module_name: str, interface: str | None, components: str | None, exports: str | None) -> set[tuple[str, str, str]]:
    """The distinct rows of one analysed file."""
    out: set[tuple[str, str, str]] = set()
    value = decoded(components)
    if isinstance(value, (dict, list)):
        out.update(component_rows(stripe("components", COMPONENT, value), module_name))
    value = decoded(exports)
    if isinstance(value, dict):
        value = value.get("records")
    if isinstance(value, list):
        for _, _, _, real, leaves in stripe("export_records", EXPORT, value).tables():
            out.update(("export", k, module_name) for k, there in zip(leaves["exported_name"], real) if there and _text(k))
    value = decoded(interface)
    if isinstance(value, dict):
        listed = value.get("all_values")
        if isinstance(listed, list):
            for _, _, _, real, leaves in stripe("all_values", ALL_VALUE, listed).tables():
                out.update(("all_value", k, module_name) for k, there in zip(leaves[""], real) if there and isinstance(k, str))
    return out


def signature_rows(member_name: str | None, cell: str | None) -> set[tuple[str, str, str | None]]:
    """The distinct variants of one member's signature."""
    value = decoded(cell)
    if value is UNREADABLE:
        return set()
    return {
        ("member_signature", k, member_name)
        for _, _, _, real, leaves in stripe("signature", SIGNATURE, value).tables()
        for k, there in ((_text(v) or _text(b), t) for v, b, t in zip(leaves["variant"], leaves[""], real))
        if there and k
    }


def _emit(ids: list[int], rows: list[tuple[str, str, str | None]]) -> pa.RecordBatch:
    entity, item, parent = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(entity, pa.string()), pa.array(item, pa.string()), pa.array(parent, pa.string())],
        names=["record_id", "entity", "item_key", "parent_key"],
    )


def _over(batches: Iterator[pa.RecordBatch], rows_of, chunk: int = 20_000) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    rows: list[tuple] = []
    for batch in batches:
        for key, *cells in zip(*(c.to_pylist() for c in batch.columns)):
            found = rows_of(*cells)
            ids.extend([key] * len(found))
            rows.extend(found)
            if len(rows) >= chunk:
                yield _emit(ids, rows)
                ids, rows = [], []
    yield _emit(ids, rows)


def shred_results(results: DataFrame) -> DataFrame:
    """Flat tables of ``analysis_results`` as rows (record_id, entity, item_key, parent_key).

    Rows without a module_name are run data and give nothing.  Striping and
    rebuilding happen in one Arrow pass over the scan; only the short keys are
    shuffled, for the rows of repeated records, after a map-side distinct.
    """
    read = results.where("module_name is not null").select("result_id", "module_name", "module_interface", "components", "export_records")
    return spread(read).mapInArrow(lambda it: _over(it, result_rows), ROWS).distinct()


def shred_signatures(members: DataFrame) -> DataFrame:
    """The signature variants of ``inherited_members`` in the same four columns."""
    read = members.select("id", "member_name", "signature").where("signature is not null")
    return spread(read).mapInArrow(lambda it: _over(it, signature_rows), ROWS).distinct()


TABLES = "record_id long, source string, entity string, group_path string, entry int, parent_entry int, item_key string, parent_key string, leaf_values map<string,string>"


def _leaf(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)


def table_rows(module_name: str, interface: str | None, components: str | None, exports: str | None) -> Iterator[tuple]:
    """(source, entity, group_path, entry, parent_entry, item_key, parent_key, leaf_values) of one analysed file."""
    for source, group, cell in (("components", COMPONENT, components), ("export_records", EXPORT, exports), ("module_interface", INTERFACE, interface)):
        value = decoded(cell)
        if source == "export_records" and isinstance(value, dict):
            value = value.get("records")
        if not isinstance(value, (dict, list)):
            continue
        for path, g, kind, mine, owners, parents, real, leaves in component_keys(stripe(source, group, value, True), module_name):
            if g is EXPORT:
                kind, mine, owners = "export", [_text(x) for x in leaves["exported_name"]], [module_name] * len(real)
            elif g is ALL_VALUE:
                kind, mine, owners = "all_value", [x if isinstance(x, str) else None for x in leaves[""]], [module_name] * len(real)
            elif source != "components":
                kind = "interface" if g is INTERFACE else path[-1]
                mine, owners = [None] * len(real), [module_name] * len(real)
            for i, there in enumerate(real):
                if there:
                    yield source, kind, ".".join(path), i, parents[i] if len(path) > 1 else None, mine[i], owners[i], {k or "(key)": _leaf(v[i]) for k, v in leaves.items() if v[i] is not None}


def _table_batch(ids: list[int], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 8
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    values = pa.array([list(v.items()) for v in cols[7]], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)], values], names=[c.split()[0] for c in TABLES.replace("map<string,string>", "map").split(", ")])


def shred_tables(results: DataFrame, *entities: str) -> DataFrame:
    """One row per item of every repeated group of the three JSON columns, with all its leaf values (of some entities, if named).

    (record_id, source, group_path, entry) names an item, (record_id, source, the
    path above, parent_entry) its parent; item_key and parent_key are the keys of
    ``shred_results`` where an entity has one.  Repeated records come once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[tuple] = []
        for batch in batches:
            for key, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                found = [r for r in table_rows(*cells) if not entities or r[1] in entities]
                ids.extend([key] * len(found))
                rows.extend(found)
                if len(rows) >= 20_000:
                    yield _table_batch(ids, rows)
                    ids, rows = [], []
        yield _table_batch(ids, rows)

    read = results.where("module_name is not null").select("result_id", "module_name", "module_interface", "components", "export_records")
    return spread(read).mapInArrow(run, TABLES).dropDuplicates(["record_id", "source", "group_path", "entry"])


def entity_table(rows: DataFrame, entity: str, **columns: str) -> DataFrame:
    """The flat table of one entity of ``shred_tables``: its keys and the named leaf values as columns of the given types."""
    leaf = lambda name, kind: F.try_element_at("leaf_values", F.lit(name)).try_cast(kind)
    return rows.where(F.col("entity") == entity).select("record_id", "group_path", "entry", "parent_entry", "item_key", "parent_key", *[leaf(n, k).alias(n.strip("()=") or "value") for n, k in columns.items()])


def shredded_levels(results: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The level sequences themselves, one row per record, group path and leaf of every JSON column
    (and of ``signature`` of inherited members where they are given).

    Repeated records come once.  rep and def are the group's levels; a leaf's own definition level is one more
    where its value is not null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                for source, group, cell in zip(("components", "export_records", "module_interface", "signature"), (COMPONENT, EXPORT, INTERFACE, SIGNATURE), cells):
                    value = decoded(cell)
                    if source == "export_records" and isinstance(value, dict):
                        value = value.get("records")
                    if isinstance(value, (dict, list)) or source == "signature" and isinstance(value, str):
                        for path, (_, rep, defn, leaves) in stripe(source, group, value, True).groups.items():
                            for leaf, values in leaves.items():
                                out.append((key, ".".join(path), rep, defn, leaf or "(key)", [_leaf(x) for x in values]))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["record_id", "group_path", "rep", "def", "leaf", "leaf_values"])

    none = F.lit(None).cast("string")
    read = results.where("module_name is not null").select("result_id", "components", "export_records", "module_interface", none.alias("signature"))
    if members is not None:
        read = read.unionByName(members.where("signature is not null").select(F.col("id").alias("result_id"), none.alias("components"), none.alias("export_records"), none.alias("module_interface"), "signature"))
    return read.mapInArrow(run, LEVELS).dropDuplicates(["record_id", "group_path", "leaf"])


def level_report(results: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Per group path and leaf: entries, real entries, present leaf values and the greatest levels."""
    real = F.expr("size(filter(def, x -> x >= size(split(group_path, '[.]'))))")
    one = shredded_levels(results, members).select(
        "group_path", "leaf", F.size("rep").alias("n"), real.alias("real"), F.expr("size(filter(leaf_values, x -> x is not null))").alias("present"),
        F.array_max("rep").alias("mr"), F.array_max("def").alias("md"),
    )
    return one.groupBy("group_path", "leaf").agg(
        F.sum("n").alias("n_entries"), F.sum("real").alias("n_real"), F.sum("present").alias("n_present"), F.max("mr").alias("max_rep"), F.max("md").alias("max_def")
    )
