"""Mending documentation: patches for issues, applying them to JSON documents, approving, rolling back and comparing."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.columns import is_present
from spanwright.operators.evaluation import BUILTIN_PAGE, SEVERITY
from spanwright.operators.relations import first_wins

# fixed values: issue codes whose patch is the code's value as it is
AS_IN_CODE = ["COMP_PARAM_TYPE_MISSING", "COMP_RETURN_TYPE_MISSING", "ACC_PARAM_TYPE_MISMATCH", "ACC_RETURN_TYPE_MISMATCH", "ACC_CLASS_METHOD_SIG_DRIFT"]
NEW_PARAMETER = ["COMP_PARAM_NAME_MISSING", "ACC_PARAM_MISSING_FROM_DOC"]
SIGNATURES = ["COMP_SIGNATURE_MISSING", "ACC_SIGNATURE_DRIFT"]
STRATEGIES = ["db_query", "ast_derived"]


def meets(severity: str | Column, least: str = "medium") -> Column:
    """Is a severity at or above another?"""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return rank[F.col(severity) if isinstance(severity, str) else severity] >= SEVERITY[least]


def best_signature(variants: Column, is_async: Column) -> Column:
    """full, else default, else no_types, else any variant; ``async`` in front of what is."""
    any_ = F.try_element_at(F.array_sort(F.map_values(variants)), F.lit(1))
    s = F.coalesce(*[F.nullif(F.try_element_at(variants, F.lit(k)), F.lit("")) for k in ("full", "default", "no_types")], any_)
    return F.when(is_async & ~F.lower(s).startswith("async"), F.concat(F.lit("async "), s)).otherwise(s)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def patches(issues: DataFrame, truth: DataFrame, least: str = "medium") -> DataFrame:
    """(id, code, json_path, old_value, new_value, strategy): what mends the issues of at least a severity by code or look-up.

    issues: rows of ``issue_rows``; truth: (id, t_async, t_variants).  Unknown
    parameters and unlinked types have no patch; neither have issues without a
    value in the code, nor those that only prose can mend.  new_value is JSON for a new parameter, else a text.
    """
    j = issues.where(meets("severity", least) & F.col("strategy").isin(*STRATEGIES)).join(truth.select("id", "t_async", "t_variants"), "id", "left")
    code, value, old = F.col("code"), F.col("code_value"), F.col("doc_value")
    p = F.from_json("code_value", "struct<name:string,type:string,default:string>")
    said = F.when(p["default"].isNotNull(), F.concat(F.lit("Default: "), p["default"])).otherwise("N/A")
    named = F.coalesce(p["name"], F.lit("<unknown>"))
    new_parameter = F.to_json(F.struct(named.alias("name"), F.coalesce(F.nullif(p["type"], F.lit("")), F.lit("N/A")).alias("type"), said.alias("description"), F.lit("N/A").alias("additional_information")))
    builtin = F.regexp_extract(F.coalesce(value, F.lit("")), "#(\\w+)$", 1)
    at = F.regexp_instr(F.lower(F.coalesce(old, F.lit(""))), F.concat(F.lit(r"\b"), F.lower(builtin), F.lit(r"\b")))
    page = F.concat(F.substring(old, F.lit(1), at - 1), F.substring(old, at, F.length(builtin)), F.lit("("), value, F.lit(")"), F.substring(old, at + F.length(builtin), F.length(old)))
    new = (
        F.when(code.isin(*AS_IN_CODE), F.nullif(value, F.lit("")))
        .when(code.isin(*NEW_PARAMETER), F.when(value.isNotNull(), new_parameter))
        .when(code == "ACC_PARAM_DEFAULT_MISMATCH", F.when(F.nullif(value, F.lit("")).isNotNull(), F.concat(F.lit("Default: "), value, F.lit(".  (corrected; previously: "), F.coalesce(_quoted(old), F.lit("None")), F.lit(")"))))
        .when(code == "MAINT_BUILTIN_NOT_LINKED", F.when((builtin != "") & (at > 0), page))
        .when(code.isin(*SIGNATURES), best_signature(F.col("t_variants"), F.coalesce("t_async", F.lit(False))))
        .when(code == "ACC_ASYNC_MARKER_MISSING", F.when(is_present("doc_value") & ~F.lower(F.ltrim(old)).startswith("async"), F.concat(F.lit("async "), F.ltrim(old))))
    )
    return j.select("id", "code", "json_path", F.col("doc_value").alias("old_value"), new.alias("new_value"), "strategy").where("new_value is not null")


_STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(\d+)\]|\[\?([A-Za-z_]\w*)\s*==\s*'([^']*)'\]")


def set_path(document: dict, path: str, value: object) -> bool:
    """Set what a path leads to (fields, [i], [?key=='value']), in place; objects on the way are made, list items are not.

    A parameter for ``$.parameters`` is appended unless one of its name is there.  False if the path is none or leads nowhere.
    """
    steps = [m.groups() for m in _STEP.finditer(path[1:])] if path.startswith("$") else []
    if not steps or "".join(m[0] for m in _STEP.finditer(path[1:])) != path[1:]:
        return False
    if path == "$.parameters" and isinstance(value, dict):
        known = document.setdefault("parameters", [])
        if any(isinstance(x, dict) and x.get("name") == value.get("name") for x in known):
            return False
        known.append(value)
        return True
    at: object = document
    for i, (field, index, key, wanted) in enumerate(steps):
        last = i == len(steps) - 1
        if field:
            if not isinstance(at, dict):
                return False
            if last:
                at[field] = value
                return True
            at = at.setdefault(field, {})
        elif isinstance(at, list):
            k = int(index) if index else next((n for n, x in enumerate(at) if isinstance(x, dict) and x.get(key) == wanted), -1)
            if not 0 <= k < len(at):
                return False
            if last:
                at[k] = value
                return True
            at = at[k]
        else:
            return False
    return False


def applied(document: str | None, changes: list[tuple[str, str, str | None]]) -> tuple[str | None, int]:
    """(document with the patches applied in order, how many took hold); an unreadable document stays as it is."""
    try:
        doc = json.loads(document) if document else {}
    except (ValueError, RecursionError):
        return document, 0
    if not isinstance(doc, dict):
        return document, 0
    done = 0
    for code, path, value in changes:
        if value is not None:
            done += set_path(doc, path, json.loads(value) if code in NEW_PARAMETER else value)
    return json.dumps(doc, ensure_ascii=False), done


def apply_patches(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents(id, json) with (candidate, n_applied): each document's patches in order of path and code, equal ones once (their number is bounded by the document's issues)."""
    per = found.select("id", "code", "json_path", "new_value").distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("json_path", "code", "new_value"))).alias("changes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, docs, lists = (b.column(k) for k in range(3))
            done = [applied(d, [(c["code"], c["json_path"], c["new_value"]) for c in cs or []]) for d, cs in zip(docs.to_pylist(), lists.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, docs, pa.array([d for d, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=["id", "json", "candidate", "n_applied"])

    return documents.select("id", "json").join(per, "id", "left").select("id", "json", "changes").mapInArrow(run, "id long, json string, candidate string, n_applied int")


def pending(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates that changed something and were not applied yet; done: (id)."""
    return candidates.where("n_applied > 0").join(done.select("id"), "id", "left_anti")


def approved(documents: DataFrame, candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """documents(id, json) with the candidates of ids(id) in the place of what was there."""
    new = candidates.join(ids.select("id").distinct(), "id", "left_semi").select("id", "candidate")
    return documents.join(new, "id", "left").select("id", F.coalesce("candidate", "json").alias("json"))


def rolled_back(documents: DataFrame, originals: DataFrame, ids: DataFrame) -> DataFrame:
    """documents(id, json) with the snapshots of ids(id) put back."""
    old = originals.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("json").alias("old"))
    return documents.join(old, "id", "left").select("id", F.coalesce("old", "json").alias("json"))


def diff(a: str | None, b: str | None) -> str:
    """Unified diff of two JSON documents, keys in order."""
    lines = lambda t: json.dumps(json.loads(t), indent=2, sort_keys=True, ensure_ascii=False).splitlines() if t else []
    return "\n".join(difflib.unified_diff(lines(a), lines(b), "original", "candidate", lineterm=""))


def file_stem(name: str | Column) -> Column:
    """A safe file name for a member."""
    c = F.col(name) if isinstance(name, str) else name
    safe = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_"), "_{2,}", "_")
    return F.when(safe == "", "_").otherwise(safe)


def find_rows(wanted: DataFrame, own: DataFrame, inherited: DataFrame) -> DataFrame:
    """wanted(name) with (kind, id): a member by its name, else an inherited one; the least of equals.

    own: (name, id, tier) as of ``catalog.own_names``; inherited: (name, id).
    """
    both = own.select("name", F.lit("member").alias("kind"), "id", "tier").unionByName(inherited.select("name", F.lit("inherited").alias("kind"), "id", F.lit(9).alias("tier")))
    best = first_wins(both.where("name is not null"), ["name"], ["tier", "id", "kind"]).select("name", "kind", "id")
    return wanted.join(best, "name", "left")


def save_log(spark, folder: str, operation: str, rows: DataFrame) -> None:
    """Append (at, operation, id) of the rows to a log of JSON lines."""
    rows.select(F.current_timestamp().alias("at"), F.lit(operation).alias("operation"), "id").write.mode("append").json(f"{folder.rstrip('/')}/log")


def html_report(total: DataFrame, dimensions: DataFrame, worst: DataFrame) -> str:
    """A page of a library's summary: totals, dimensions, and its worst documents (tens of rows)."""
    def table(df: DataFrame, columns: list[str]) -> str:
        cells = lambda values, tag: "".join(f"<{tag}>{v}</{tag}>" for v in values)
        esc = lambda v: str("" if v is None else v).replace("&", "&amp;").replace("<", "&lt;")
        rows = "".join(f"<tr>{cells([esc(r[c]) for c in columns], 'td')}</tr>" for r in df.select(*columns).collect())
        return f"<table><tr>{cells(columns, 'th')}</tr>{rows}</table>"

    return "<!doctype html><meta charset='utf-8'><title>Documentation quality</title>" + table(total, total.columns) + table(dimensions.orderBy("dimension"), dimensions.columns) + table(worst, ["route", "id", "overall"])


__all__ = ["BUILTIN_PAGE", "apply_patches", "applied", "approved", "best_signature", "diff", "file_stem", "find_rows", "html_report", "meets", "patches", "pending", "rolled_back", "save_log", "set_path"]
