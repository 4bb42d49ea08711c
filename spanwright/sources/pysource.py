"""Python source text to rows: components, imports and exports, one pass per file in Arrow batches.

Texts that do not parse give a single row of kind ``error``.  A row's ``detail``
holds what is particular to its kind as JSON.
"""

from __future__ import annotations

import ast
import json
import textwrap
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanwright.runtime import spread

SCHEMA = "seq int, kind string, name string, parent string, start_line int, end_line int, doc string, detail string"


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _parameters(a: ast.arguments) -> list[dict]:
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    out = [{"name": p.arg, "type": _text(p.annotation), "default": _text(d), "kind": "positional" if p in a.posonlyargs else "plain"} for p, d in zip(plain, defaults)]
    if a.vararg:
        out.append({"name": a.vararg.arg, "type": _text(a.vararg.annotation), "default": None, "kind": "vararg"})
    out += [{"name": p.arg, "type": _text(p.annotation), "default": _text(d), "kind": "keyword"} for p, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        out.append({"name": a.kwarg.arg, "type": _text(a.kwarg.annotation), "default": None, "kind": "kwarg"})
    return out


def signature_variants(name: str, parameters: list[dict], returns: str | None) -> dict[str, str]:
    """Spellings of a signature without self and cls, equal parameter lists once: full, without types, defaults,
    the ``/`` and the bare ``*`` (where there are such), and names alone."""
    kept = [p for i, p in enumerate(parameters) if not (i == 0 and p["name"] in ("self", "cls"))]
    star = {"vararg": "*", "kwarg": "**"}
    slash = any(p["kind"] == "positional" for p in kept)
    bare = any(p["kind"] == "keyword" for p in kept) and not any(p["kind"] == "vararg" for p in kept)

    def spell(types: bool, defaults: bool, marks: str) -> list[str]:
        parts = []
        for i, p in enumerate(kept):
            if bare and "*" in marks and p["kind"] == "keyword" and (i == 0 or kept[i - 1]["kind"] != "keyword"):
                parts.append("*")
            s = star.get(p["kind"], "") + p["name"]
            if types and p["type"]:
                s += f": {p['type']}"
            if defaults and p["default"] is not None:
                s += f"={p['default']}"
            parts.append(s)
            if slash and "/" in marks and p["kind"] == "positional" and (i + 1 == len(kept) or kept[i + 1]["kind"] != "positional"):
                parts.append("/")
        return parts

    wanted = [("full", True, True, "/*"), ("no_types", False, True, "/*"), ("no_defaults", True, False, "/*"), ("names", False, False, "")]
    wanted += [("no_slash", True, True, "*"), ("no_types_no_slash", False, True, "*")] if slash else []
    wanted += [("no_asterisk", True, True, "/"), ("no_types_no_asterisk", False, True, "/")] if bare else []
    out: dict[str, str] = {}
    seen: set[tuple] = set()
    for key, types, defaults, marks in wanted:
        parts = spell(types, defaults, marks)
        if tuple(parts) not in seen:
            seen.add(tuple(parts))
            out[key] = f"{name}({', '.join(parts)})" + (f" -> {returns}" if types and returns else "")
    return out


def overload_category(parameters: list[dict]) -> str:
    """primary (takes anything, or three or more parameters that all have defaults), specific (two or more, all of concrete types), else secondary."""
    kinds = {p["kind"] for p in parameters}
    plain = [p for p in parameters if p["kind"] not in ("vararg", "kwarg")]
    if {"vararg", "kwarg"} <= kinds or len(parameters) >= 3 and all(p["default"] is not None for p in plain):
        return "primary"
    concrete = all(p["type"] and "Union" not in p["type"] and "Any" not in p["type"] for p in plain)
    return "specific" if concrete and len(parameters) >= 2 else "secondary"


def specificity(parameters: list[dict]) -> int:
    """How much a signature asks for: typed and required parameters up, variadic ones down."""
    score = sum(10 * bool(p["type"]) + 5 * (p["default"] is None) for p in parameters if p["kind"] not in ("vararg", "kwarg"))
    return score - 15 * sum(p["kind"] in ("vararg", "kwarg") for p in parameters) + 2 * len(parameters)


def _flags(decorators: list[str], in_class: bool) -> dict:
    """What decorators make of a function."""
    last = [d.split("(")[0].rsplit(".", 1)[-1] for d in decorators]
    accessor = next((x for x in ("setter", "deleter") if x in last), "getter" if {"property", "cached_property"} & set(last) else None)
    kind = next((x for x in ("staticmethod", "classmethod") if x in last), None)
    return {"property": accessor, "method_type": {"staticmethod": "static", "classmethod": "class"}.get(kind, "instance" if in_class else None), "abstract": "abstractmethod" in last, "override": "override" in last}


def documentation_names(name: str, flags: dict) -> list[str]:
    """All names that documentation may give a decorated function."""
    out = [name]
    base = name[4:] if flags["property"] == "getter" and name.startswith("get_") else name
    out.append(base)
    if flags["property"]:
        out += ([f"{base}_property"] if flags["property"] == "getter" else []) + [f"{base}_{flags['property']}", f"{base}.{flags['property']}"]
    if flags["method_type"] in ("static", "class"):
        out.append(f"{flags['method_type']}_{name}")
    return list(dict.fromkeys(out))


class _Module:
    """What the names of one module stand for, and which of them are used."""

    def __init__(self, tree: ast.Module):
        self.bound: dict[str, str] = {}
        self.classes: dict[str, list[str]] = {}
        self.defined: set[str] = set()
        self.used: set[str] = set()
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.bound[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    if a.name != "*":
                        self.bound[a.asname or a.name] = "." * node.level + ".".join(x for x in (node.module, a.name) if x)
            elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
                self.used.add(node.id)
            elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
                self.used |= {c.value for c in ast.walk(node.value) if isinstance(c, ast.Constant) and isinstance(c.value, str)}
        self._define(tree.body, "")

    def _define(self, body: list[ast.stmt], scope: str) -> None:
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                own = f"{scope}.{node.name}" if scope else node.name
                self.defined.add(own)
                if isinstance(node, ast.ClassDef):
                    self.classes[own] = [_text(b) for b in node.bases]
                self._define(node.body, own)

    def target(self, call: ast.Call, scope: str | None, cls: str | None) -> tuple[str | None, str]:
        """(what is called, how it was found): names with a leading ``:`` are the module's own."""
        parts, at = [], call.func
        while isinstance(at, ast.Attribute):
            parts.append(at.attr)
            at = at.value
        parts.reverse()
        if isinstance(at, ast.Call) and isinstance(at.func, ast.Name) and at.func.id == "super" and cls and parts:
            bases = self.classes.get(cls) or []
            return (self._name(bases[0].split(".")) + "." + ".".join(parts), "super") if bases else (None, "unresolved")
        if not isinstance(at, ast.Name):
            return None, "unresolved"
        if at.id in ("self", "cls") and parts:
            return (f":{cls}.{parts[-1]}", "self") if cls and len(parts) == 1 else (None, "unresolved")
        if not parts:
            if at.id in self.defined:
                return ":" + at.id, "module"
            if at.id in self.bound:
                return self.bound[at.id], "import"
            while scope:
                if f"{scope}.{at.id}" in self.defined:
                    return f":{scope}.{at.id}", "local"
                scope = scope.rpartition(".")[0]
            return None, "unresolved"
        if at.id in self.bound:
            return ".".join([self.bound[at.id], *parts]), "import"
        if at.id in self.classes:
            return ":" + ".".join([at.id, *parts]), "class"
        return None, "unresolved"

    def _name(self, parts: list[str]) -> str:
        return ".".join([self.bound.get(parts[0], ":" + parts[0]), *parts[1:]])


def _own_calls(node: ast.AST) -> Iterator[ast.Call]:
    """Calls of a body, not those of functions and classes defined in it."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        if isinstance(child, ast.Call):
            yield child
        yield from _own_calls(child)


def _calls(node: ast.AST, scope: str | None, cls: str | None, names: _Module) -> Iterator[tuple]:
    for call in _own_calls(node):
        target, how = names.target(call, scope, cls)
        yield "call", _text(call.func), scope, call.lineno, call.end_lineno, None, {"target": target, "how": how, "args": len(call.args), "kwargs": len(call.keywords)}


def _walk(body: list[ast.stmt], parent: str | None, names: _Module, cls: str | None = None, fallback: bool = False) -> Iterator[tuple]:
    for node in body:
        line, end = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
        if isinstance(node, ast.ClassDef):
            own = f"{parent}.{node.name}" if parent else node.name
            yield "class", node.name, parent, line, end, ast.get_docstring(node), {"bases": [_text(b) for b in node.bases], "base_targets": [names._name(_text(b).split(".")) if not isinstance(b, (ast.Call, ast.Subscript)) else _text(b) for b in node.bases], "decorators": [_text(d) for d in node.decorator_list], "fallback": fallback}
            yield from _walk(node.body, own, names, own)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own = f"{parent}.{node.name}" if parent else node.name
            params = _parameters(node.args)
            decorators = [_text(d) for d in node.decorator_list]
            flags = _flags(decorators, cls == parent and cls is not None)
            detail = {"async": isinstance(node, ast.AsyncFunctionDef), "decorators": decorators, "parameters": params, "returns": _text(node.returns), "signatures": signature_variants(node.name, params, _text(node.returns)), "overload": overload_category(params), "specificity": specificity(params), "names": documentation_names(node.name, flags), "fallback": fallback, **flags}
            yield "function", node.name, parent, line, end, ast.get_docstring(node), detail
            yield from _calls(node, own, cls, names)
            yield from _walk(node.body, own, names, cls)
        elif isinstance(node, ast.Import):
            for a in node.names:
                bound = a.asname or a.name.split(".")[0]
                yield "import", bound, parent, line, end, None, {"module": a.name, "level": 0, "entity": a.name, "alias": a.asname, "wildcard": False, "used": bound in names.used}
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                bound = a.asname or a.name
                yield "import", bound, parent, line, end, None, {"module": node.module, "level": node.level, "entity": a.name, "alias": a.asname, "wildcard": a.name == "*", "used": a.name == "*" or bound in names.used}
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                if isinstance(t, ast.Name):
                    if t.id == "__all__":
                        listed = [e.value for e in node.value.elts if isinstance(e, ast.Constant)] if isinstance(node.value, (ast.List, ast.Tuple)) else None
                        sources = [_text(x.value) for x in ast.walk(node.value) if isinstance(x, ast.Attribute) and x.attr == "__all__"] if node.value is not None else []
                        yield "exports", t.id, parent, line, end, None, {"names": listed, "dynamic": listed is None or isinstance(node, ast.AugAssign), "sources": sources}
                    else:
                        value = node.value if not isinstance(node, ast.AugAssign) else None
                        yield "variable", t.id, parent, line, end, None, {"type": _text(getattr(node, "annotation", None)), "value": _text(value), "scope": "class" if cls and cls == parent else "module" if parent is None else "function"}
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Attribute) and _text(node.value.func.value) == "__all__":
            yield "exports", "__all__", parent, line, end, None, {"names": None, "dynamic": True, "sources": [_text(x.value) for x in ast.walk(node.value) if isinstance(x, ast.Attribute) and x.attr == "__all__"]}
        elif isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
            yield from _walk(node.body, parent, names, cls, fallback)
            for more in ("orelse", "finalbody"):
                yield from _walk(getattr(node, more, []), parent, names, cls, fallback)
            for h in getattr(node, "handlers", []):
                yield from _walk(h.body, parent, names, cls, True)
        if parent is None and not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from _calls(node, None, None, names)


def rows_of(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [("error", type(e).__name__, None, getattr(e, "lineno", None), None, None, {"message": str(e)})]
    return list(_walk(tree.body, None, _Module(tree)))


def instance_attributes(text: str | None) -> list[str]:
    """Public attributes of a class by its source: what its body assigns and what methods assign on ``self``."""
    try:
        tree = ast.parse(textwrap.dedent(text or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found: set[str] = set()
    for node in ast.walk(tree):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else []
        found |= {t.attr for t in targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"}
        if isinstance(node, ast.ClassDef):
            for child in node.body:
                inner = child.targets if isinstance(child, ast.Assign) else [child.target] if isinstance(child, ast.AnnAssign) else []
                found |= {t.id for t in inner if isinstance(t, ast.Name)}
    return sorted(x for x in found if not x.startswith("_"))


def components(files: DataFrame, *keep: str) -> DataFrame:
    """(file_id, keep, SCHEMA) rows of every Python file of (file_id, content, keep); null content gives none.

    Files are parsed where they are scanned; of repeated files the short rows are
    dropped, by file and place (``seq``), so texts are never shuffled.
    """
    read = files.where("content is not null").select("file_id", "content", *keep)
    schema = T.StructType([f for f in read.schema.fields if f.name != "content"]).add("seq", T.IntegerType())
    for name, kind in (x.split() for x in SCHEMA.split(", ")[1:]):
        schema = schema.add(name, T.IntegerType() if kind == "int" else T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        for b in batches:
            at, rows = [], []
            for i, c in enumerate(b.column(1).to_pylist()):
                found = rows_of(c)
                at.extend([i] * len(found))
                rows.extend((k, *r) for k, r in enumerate(found))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            index = pa.array(at, pa.int64())
            kept = [b.column(k).take(index) for k in range(b.num_columns) if k != 1]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, k) for c, k in zip(cols, kinds)], pa.array([json.dumps(x) for x in cols[7]], pa.string())], names=schema.names)

    return spread(read).mapInArrow(run, schema).dropDuplicates(["file_id", "seq"])


def resolve_relative(package: str, level: int, module: str | None) -> str | None:
    """The absolute module of a relative import from a package (PEP 328); None if it leaves the top."""
    if level == 0:
        return module
    parts = package.split(".")
    if level > len(parts):
        return None
    base = parts[: len(parts) - level + 1]
    return ".".join([*base, *([module] if module else [])])
