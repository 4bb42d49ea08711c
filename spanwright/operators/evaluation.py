"""Evaluating documentation: completeness, accuracy, readability and maintainability of ``docview`` rows, and their issues.

Metrics are column expressions in the range 0..1; a dimension's score is their
weighted mean.  Issues are an array column of structs that explodes into rows.
Only what needs alignment of texts (signature drift) or parsing (examples) runs
in Python, in Arrow batches, ahead of the expressions that use it.
"""

from __future__ import annotations

import ast
import difflib
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions import types as T
from spanwright.functions.columns import clamp, coalesce_text, is_present, token_count
from spanwright.operators import docview as V

# fixed values: weights of the metrics and of the dimensions, thresholds
COMPLETENESS = {"SigCov": 0.10, "PurpCov": 0.20, "PaC": 0.20, "PTC": 0.15, "PDC": 0.15, "RC": 0.10, "ExC": 0.10}
ACCURACY = {"PCA": 0.10, "PNA": 0.15, "PTC_acc": 0.20, "PDA": 0.15, "RTC": 0.10, "SigDrift": 0.20, "AsyncMarker": 0.05, "DeprecatedMarker": 0.05}
READABILITY = {"text": 0.6, "code": 0.4}
MAINTAINABILITY = {"HD": 0.20, "TXRefC": 0.30, "BTRefC": 0.20, "IXRefC": 0.20, "ITR": 0.10}
OVERALL = {"completeness": 0.35, "accuracy": 0.35, "readability": 0.15, "maintainability": 0.15}
MIN_DESC_TOKENS, MIN_PURPOSE_WORDS, TYPE_SAME, SIG_DRIFT, METHOD_DRIFT, PASSIVE = 3, 8, 0.8, 0.30, 0.4, 0.4
LINKS_LEAST, LINKS_MOST, EXAMPLE_LINES, EXAMPLE_BRANCHES, SINGLE_CHAR, RESTATED = 0.05, 1.0, 30, 5, 0.5, 0.6
SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}
# fixed values: issue codes with dimension, severity and strategy
ISSUES = {
    "COMP_SIGNATURE_MISSING": ("completeness", "high", "ast_derived"), "COMP_PURPOSE_MISSING": ("completeness", "high", "llm"), "COMP_PARAM_NAME_MISSING": ("completeness", "high", "db_query"), "COMP_PARAM_TYPE_MISSING": ("completeness", "high", "db_query"),
    "COMP_PARAM_DESCRIPTION_MISSING": ("completeness", "medium", "llm"), "COMP_RETURN_TYPE_MISSING": ("completeness", "high", "db_query"), "COMP_RETURN_DESCRIPTION_MISSING": ("completeness", "medium", "llm"), "COMP_NO_EXAMPLES": ("completeness", "medium", "llm"),
    "COMP_EXAMPLE_EMPTY": ("completeness", "medium", "llm"), "COMP_CLASS_METHOD_DESC_MISSING": ("completeness", "low", "llm"), "COMP_CLASS_ATTR_DESC_MISSING": ("completeness", "low", "llm"),
    "ACC_PARAM_NAME_UNKNOWN": ("accuracy", "high", "db_query"), "ACC_PARAM_MISSING_FROM_DOC": ("accuracy", "high", "db_query"), "ACC_PARAM_TYPE_MISMATCH": ("accuracy", "medium", "db_query"), "ACC_PARAM_DEFAULT_MISMATCH": ("accuracy", "medium", "db_query"),
    "ACC_RETURN_TYPE_MISMATCH": ("accuracy", "medium", "db_query"), "ACC_SIGNATURE_DRIFT": ("accuracy", "high", "ast_derived"), "ACC_ASYNC_MARKER_MISSING": ("accuracy", "low", "ast_derived"), "ACC_DEPRECATED_NOT_NOTED": ("accuracy", "medium", "llm"),
    "ACC_CLASS_METHOD_NOT_FOUND": ("accuracy", "medium", "manual"), "ACC_CLASS_ATTR_NOT_FOUND": ("accuracy", "medium", "manual"), "ACC_CLASS_METHOD_SIG_DRIFT": ("accuracy", "medium", "ast_derived"),
    "READ_PURPOSE_TOO_TERSE": ("readability", "low", "llm"), "READ_TEXT_GRADE_TOO_HIGH": ("readability", "low", "llm"), "READ_PASSIVE_VOICE_HIGH": ("readability", "low", "llm"), "READ_PARAM_DESC_TYPE_ECHO": ("readability", "low", "llm"),
    "READ_EXAMPLE_NO_EXPLANATION": ("readability", "low", "llm"), "READ_EXAMPLE_SINGLE_CHAR_VAR": ("readability", "low", "llm"), "READ_EXAMPLE_HIGH_COMPLEXITY": ("readability", "low", "llm"), "READ_EXAMPLE_PARSE_FAILED": ("readability", "medium", "manual"),
    "MAINT_NO_HYPERLINKS_IN_SECTION": ("maintainability", "low", "llm"), "MAINT_TYPE_NOT_LINKED": ("maintainability", "medium", "db_query"), "MAINT_INTERNAL_REFERENCE_NOT_LINKED": ("maintainability", "low", "db_query"), "MAINT_BUILTIN_NOT_LINKED": ("maintainability", "low", "db_query"),
    "MAINT_INLINE_TYPE_RESTATEMENT": ("maintainability", "low", "llm"), "MAINT_BROKEN_PLACEHOLDER": ("maintainability", "high", "manual"), "MAINT_OVER_LINKING": ("maintainability", "low", "manual"),
    "FID_UNSUPPORTED_CONTENT": ("fidelity", "high", "manual"), "FID_PARTIAL_SUPPORT": ("fidelity", "medium", "manual"), "FID_SOURCE_OMITTED": ("fidelity", "medium", "manual"), "FID_EMPTY_EXTRACTION": ("fidelity", "high", "manual"),
}
# fixed values: forms of to be, and irregular participles, of the passive
PASSIVE_FORM = r"(?i)\b(?:is|are|was|were|been|being|be)\b\s+(?:[a-z]+ed|written|done|seen|made|known|given|taken|sent|found|set|paid|kept|left|put|run|cut|read|built|brought|caught|told)\b"
WORD = r"[\p{L}\p{N}_]+"
TOKEN_LINK, MARKDOWN_LINK, BARE_URL = r"(\w[\w\.]*)\((https?://[^)\s]+)\)", r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r"(?<![\w(])https?://\S+"
MENTION = r"(?<![\w./])([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]*)"
# fixed values: words that are no mentions
NO_MENTION = ["true", "false", "none", "self", "cls", "args", "kwargs"]
# fixed values: built-in types with the page that documents them
BUILTIN_PAGE = {n: f"https://docs.python.org/3/library/{p}.html#{'None' if n == 'none' else n}" for p, names in (("functions", "int bool float complex object type callable iter"), ("stdtypes", "str list dict tuple set frozenset bytes bytearray"), ("constants", "none")) for n in names.split()}

ISSUE = "array<struct<code:string,section:string,target:string,json_path:string,doc_value:string,code_value:string>>"


def catalogue(spark) -> DataFrame:
    """(code, dimension, severity, strategy): the issue types as a table."""
    return spark.createDataFrame([(k, *v) for k, v in ISSUES.items()], "code string, dimension string, severity string, strategy string")


def yes(c) -> Column:
    return F.coalesce(is_present(c), F.lit(False))


def _one(code: str, section, target=None, path=None, doc=None, code_value=None) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x.cast("string")
    return F.struct(F.lit(code).alias("code"), text(section).alias("section"), text(target).alias("target"), text(path).alias("json_path"), text(doc).alias("doc_value"), text(code_value).alias("code_value"))


def _if(when: Column, *args, **kw) -> Column:
    return F.when(when, F.array(_one(*args, **kw)).cast(ISSUE)).otherwise(F.array().cast(ISSUE))


def _each(items: Column, test, make) -> Column:
    return F.transform(F.filter(items, test), make).cast(ISSUE)


def mean(parts: dict[str, Column], weights: dict[str, float], default: float = 0.0) -> Column:
    """Weighted mean of the metrics that are there (not null), in 0..1; ``default`` if none is."""
    got = [(parts[k], w) for k, w in weights.items() if k in parts]
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in got), F.lit(0.0))
    value = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in got), F.lit(0.0))
    return F.when(total > 0, clamp(value / total, 0.0, 1.0)).otherwise(F.lit(default))


def _param_path(name: Column, field: str = "") -> Column:
    return F.concat(F.lit("$.parameters[?name=='"), name, F.lit("']" + (f".{field}" if field else "")))


def _share(items: Column, test) -> Column:
    """Share of items that pass; 1 for none."""
    n = F.size(items)
    return F.when(n > 0, F.size(F.filter(items, test)) / n).otherwise(F.lit(1.0))


_params = lambda: F.coalesce(F.col("parameters"), V.none(V.PARAMETER))
_truths = lambda: F.coalesce(F.col("t_parameters"), F.array().cast("array<struct<name:string,type:string,default:string>>"))
_class = lambda: F.col("member_type") == "class"
_has = lambda: F.coalesce(F.col("has_truth"), F.lit(False))
_unnamed = lambda p: F.coalesce(F.nullif(p["name"], F.lit("")), F.lit("<unnamed>"))


def doc_names() -> Column:
    return F.array_distinct(F.transform(F.filter(_params(), lambda p: yes(p["name"])), lambda p: p["name"]))


def code_names() -> Column:
    return F.array_distinct(F.transform(_truths(), lambda p: p["name"]))


# completeness


def completeness_metrics() -> dict[str, Column]:
    p, names = _params(), doc_names()
    one = F.lit(1.0)
    by_truth = F.when(F.size(_truths()) > 0, F.size(F.filter(_truths(), lambda t: F.array_contains(names, t["name"]))) / F.size(_truths())).otherwise(one)
    pac = F.when(_has() & F.col("t_type").isin("class", "function", "method"), by_truth).otherwise(F.when(F.size(p) > 0, F.size(names) / F.size(p)).otherwise(one))
    told = lambda x: yes(x["description"]) & (token_count(x["description"]) >= MIN_DESC_TOKENS)
    r = F.col("returns")
    both = (yes(r["type"]).cast("double") + yes(r["description"]).cast("double")) / 2
    return {
        "SigCov": yes("signature").cast("double"), "PurpCov": yes("purpose").cast("double"), "PaC": pac, "PTC": _share(p, lambda x: yes(x["type"])), "PDC": _share(p, told),
        "RC": F.when(_class() | _has() & V.void(), one).otherwise(both), "ExC": F.exists(F.coalesce("examples", V.none(V.EXAMPLE)), lambda e: yes(e["example"])).cast("double"),
    }


def completeness_score(parts: dict[str, Column]) -> Column:
    """Classes return nothing, so the weight of RC goes to their other metrics in equal shares."""
    rest = {k: w for k, w in COMPLETENESS.items() if k != "RC"}
    share = COMPLETENESS["RC"] / len(rest)
    return F.when(_class(), mean(parts, {k: w + share for k, w in rest.items()})).otherwise(mean(parts, COMPLETENESS))


def completeness_issues() -> Column:
    p, names, r = _params(), doc_names(), F.col("returns")
    wants = ~_class() & ~(_has() & V.void())
    examples = F.coalesce(F.col("examples"), V.none(V.EXAMPLE))
    empty = F.filter(F.transform(examples, lambda e, i: F.struct(i.alias("i"), e["example"].alias("x"))), lambda e: ~yes(e["x"]))
    known = lambda x: F.try_element_at(F.filter(_truths(), lambda t: t["name"] == x["name"]), F.lit(1))["type"]
    callable_ = F.col("t_type").isin("class", "function", "method") & _has()
    return F.concat(
        _if(~yes("signature"), "COMP_SIGNATURE_MISSING", "module_member_signature", None, "$.module_member_signature", F.col("signature"), F.col("t_variants")["full"]),
        _if(~yes("purpose"), "COMP_PURPOSE_MISSING", "module_member_description", None, F.when(_class(), "$.module_member_description.purpose").otherwise("$.module_member_description"), F.col("purpose")),
        F.when(callable_, _each(_truths(), lambda t: ~F.array_contains(names, t["name"]), lambda t: _one("COMP_PARAM_NAME_MISSING", "parameters", t["name"], "$.parameters", None, F.to_json(t)))).otherwise(F.array().cast(ISSUE)),
        _each(p, lambda x: ~yes(x["type"]), lambda x: _one("COMP_PARAM_TYPE_MISSING", "parameters", _unnamed(x), _param_path(_unnamed(x), "type"), x["type"], known(x))),
        _each(p, lambda x: ~yes(x["description"]) | (token_count(x["description"]) < MIN_DESC_TOKENS), lambda x: _one("COMP_PARAM_DESCRIPTION_MISSING", "parameters", _unnamed(x), _param_path(_unnamed(x), "description"), x["description"])),
        _if(wants & ~yes(r["type"]), "COMP_RETURN_TYPE_MISSING", "returns", None, "$.returns.type", r["type"], F.col("t_returns")),
        _if(wants & ~yes(r["description"]), "COMP_RETURN_DESCRIPTION_MISSING", "returns", None, "$.returns.description", r["description"]),
        _if(F.size(examples) == F.size(empty), "COMP_NO_EXAMPLES", "examples", None, "$.examples"),
        F.transform(empty, lambda e: _one("COMP_EXAMPLE_EMPTY", "examples", e["i"], F.concat(F.lit("$.examples["), e["i"].cast("string"), F.lit("].example")), e["x"])).cast(ISSUE),
    )


# accuracy


def default_hint(c: str | Column) -> Column:
    """The default a description names (``Default: x``, ``default is 'x'``, ``(default x``), or null."""
    pattern = r"""(?i)default(?:\s*[:=]\s*|\s+is\s+|\s+\()\s*(?:'([^']+)'|"([^"]+)"|([^\s,;\n)]+))"""
    c = coalesce_text(c)
    found = F.coalesce(*[F.nullif(F.regexp_extract(c, pattern, k), F.lit("")) for k in (1, 2, 3)])
    return F.nullif(F.regexp_replace(found, r"""^[ .,;'"]+|[ .,;'"]+$""", ""), F.lit(""))


def same_default(a: Column, b: Column) -> Column:
    """Equal without quotes and in lower case, or as numbers."""
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), r"""^['"]+|['"]+$""", ""))
    x, y = plain(a), plain(b)
    return (x == y) | F.coalesce(x.try_cast("double") == y.try_cast("double"), F.lit(False))


def _matched() -> Column:
    """Documented parameters that the code has, with the code's side (the first of a name)."""
    def pair(name: Column) -> Column:
        d = F.try_element_at(F.filter(_params(), lambda x: x["name"] == name), F.lit(-1))
        t = F.try_element_at(F.filter(_truths(), lambda x: x["name"] == name), F.lit(-1))
        return F.struct(name.alias("name"), d["type"].alias("d_type"), d["description"].alias("d_desc"), t["type"].alias("t_type"), t["default"].alias("t_default"), T.normalize(d["type"]).alias("dn"), T.normalize(t["type"]).alias("tn"))

    return F.transform(F.array_intersect(code_names(), doc_names()), pair)


def with_matches(docs: DataFrame) -> DataFrame:
    """``matched`` beside the document and truth columns, so that it is worked out once."""
    return docs.withColumn("matched", _matched()).withColumn("rn", T.normalize(F.col("returns")["type"])).withColumn("tn", T.normalize("t_returns"))


def accuracy_metrics(drift: str | None = "drift") -> dict[str, Column]:
    """Null for documents without code; needs ``with_matches``, and a drift column unless that is None."""
    one, zero = F.lit(1.0), F.lit(0.0)
    code, doc, m = code_names(), doc_names(), F.col("matched")
    union = F.size(F.array_union(code, doc))
    same_type = lambda x: (~yes(x["t_type"]) & ~yes(x["d_type"])) | T.equivalent(x["tn"], x["dn"], TYPE_SAME)
    with_default = F.filter(m, lambda x: x["t_default"].isNotNull())
    agrees = lambda x: F.coalesce(same_default(x["t_default"], default_hint(x["d_desc"])), F.lit(False))
    told = F.lower(F.concat_ws(" ", "purpose", "info", "notes", "edge_cases"))
    parts = {
        "PCA": F.when(F.size(code) == F.size(doc), one).otherwise(zero), "PNA": F.when(union > 0, F.size(F.array_intersect(code, doc)) / union).otherwise(one), "PTC_acc": _share(m, same_type), "PDA": _share(with_default, agrees),
        "RTC": F.when(_class() | ~(yes("t_returns") | yes(F.col("returns")["type"])) | T.equivalent(F.col("tn"), F.col("rn"), TYPE_SAME), one).otherwise(zero),
        "AsyncMarker": F.when(F.col("t_async") & ~F.lower(coalesce_text("signature")).contains("async"), zero).otherwise(one),
        "DeprecatedMarker": F.when(F.col("t_deprecated") & ~told.contains("deprecat"), zero).otherwise(one),
    }
    if drift:
        parts["SigDrift"] = F.when(F.col(drift).isNull(), one).otherwise(F.greatest(zero, 1.0 - F.col(drift)))
    return {k: F.when(_has(), c) for k, c in parts.items()}


def accuracy_score(parts: dict[str, Column]) -> Column:
    """1 where there is no code to disagree with."""
    return F.when(_has(), mean(parts, ACCURACY)).otherwise(F.lit(1.0))


def accuracy_issues(drift: str | None = "drift") -> Column:
    code, doc, m = code_names(), doc_names(), F.col("matched")
    said = lambda x: default_hint(x["d_desc"])
    wrong_type = lambda x: (yes(x["t_type"]) | yes(x["d_type"])) & ~T.equivalent(x["tn"], x["dn"], TYPE_SAME)
    wrong_default = lambda x: x["t_default"].isNotNull() & said(x).isNotNull() & ~F.coalesce(same_default(x["t_default"], said(x)), F.lit(False))
    told = F.lower(F.concat_ws(" ", "purpose", "info", "notes", "edge_cases"))
    r = F.col("returns")["type"]
    every = [
        _each(_params(), lambda x: yes(x["name"]) & ~F.array_contains(code, x["name"]), lambda x: _one("ACC_PARAM_NAME_UNKNOWN", "parameters", x["name"], _param_path(x["name"]), F.to_json(x))),
        _each(_truths(), lambda t: ~F.array_contains(doc, t["name"]), lambda t: _one("ACC_PARAM_MISSING_FROM_DOC", "parameters", t["name"], "$.parameters", None, F.to_json(t))),
        _each(m, wrong_type, lambda x: _one("ACC_PARAM_TYPE_MISMATCH", "parameters", x["name"], _param_path(x["name"], "type"), x["d_type"], x["t_type"])),
        _each(m, wrong_default, lambda x: _one("ACC_PARAM_DEFAULT_MISMATCH", "parameters", x["name"], _param_path(x["name"], "description"), said(x), x["t_default"])),
        _if(~_class() & (yes("t_returns") | yes(r)) & ~T.equivalent(F.col("tn"), F.col("rn"), TYPE_SAME), "ACC_RETURN_TYPE_MISMATCH", "returns", None, "$.returns.type", r, F.col("t_returns")),
        _if(F.col("t_async") & ~F.lower(coalesce_text("signature")).contains("async"), "ACC_ASYNC_MARKER_MISSING", "module_member_signature", None, "$.module_member_signature", F.col("signature"), F.col("t_variants")["full"]),
        _if(F.col("t_deprecated") & ~told.contains("deprecat"), "ACC_DEPRECATED_NOT_NOTED", "additional_notes", None, "$.additional_notes.supplementary_information"),
    ]
    if drift:
        every.append(_if(F.col(drift) >= SIG_DRIFT, "ACC_SIGNATURE_DRIFT", "module_member_signature", None, "$.module_member_signature", F.col("signature"), F.col("t_variants")["full"]))
    return F.when(_has(), F.concat(*every)).otherwise(F.array().cast(ISSUE))


def normalized_signature(text: str | None) -> str:
    s = re.sub(r"\[[^\]]*\]", "", re.sub(r"\(?https?://\S+\)?", "", text or ""))
    return re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_,()=\s.*\[\]]", "", s)).strip().lower()


def drift_of(documented: str | None, variants: dict[str, str] | None) -> float | None:
    """Least distance (1 - ratio) of a documented signature from the code's variants; None if either is missing."""
    if not documented or not documented.strip() or documented.strip().upper() in ("N/A", "NA", "NONE", "NULL", "TBD") or not variants:
        return None
    known = [variants[k] for k in ("no_types", "default", "full") if variants.get(k)] or list(variants.values())
    a = normalized_signature(documented)
    return min((1 - difflib.SequenceMatcher(None, a, n).ratio() for n in map(normalized_signature, known) if n), default=1.0)


def with_drift(docs: DataFrame) -> DataFrame:
    """``drift`` beside the columns: how far the documented signature is from the code's (null if it cannot be told)."""
    @F.pandas_udf("double")
    def drift(sig: pd.Series, variants: pd.Series) -> pd.Series:
        return pd.Series([drift_of(s, dict(v) if v is not None else None) for s, v in zip(sig, variants)], dtype="float64")

    return docs.withColumn("drift", drift("signature", "t_variants")).withColumn("drift", F.nanvl("drift", F.lit(None).cast("double")))


def class_issues(items: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, code, target): methods and attributes that a class's documentation lists and the class has not, whose
    signature drifted, or which are not described.

    items: (id, kind, name, signature, description); actual: (id, kind, name, variants).
    """
    bare = F.split(F.trim(F.regexp_replace("name", r"\s*\([^)]*\)", "")), r"\s+")[0]
    named = items.where(yes("name")).withColumn("bare", F.when(F.col("kind") == "attribute", bare).otherwise(F.col("name")))
    known = actual.groupBy("id", "kind", F.col("name").alias("bare")).agg(F.max_by("variants", F.to_json("variants")).alias("t_variants"), F.lit(True).alias("there"))
    j = with_drift(named.join(known, ["id", "kind", "bare"], "left").drop("bare"))
    row = lambda df, code, target="name": df.select("id", F.lit(code).alias("code"), F.col(target).alias("target"))
    method = F.col("kind") == "method"
    silent = items.where(~yes("description")).withColumn("name", F.coalesce("name", F.lit("<unnamed>")))
    return (
        row(j.where(method & F.col("there").isNull()), "ACC_CLASS_METHOD_NOT_FOUND")
        .unionByName(row(j.where(~method & F.col("there").isNull()), "ACC_CLASS_ATTR_NOT_FOUND"))
        .unionByName(row(j.where(method & (F.col("drift") >= METHOD_DRIFT)), "ACC_CLASS_METHOD_SIG_DRIFT"))
        .unionByName(row(silent.where(method), "COMP_CLASS_METHOD_DESC_MISSING"))
        .unionByName(row(silent.where(~method), "COMP_CLASS_ATTR_DESC_MISSING"))
    )


# readability


def sentence_texts(text: Column) -> Column:
    """Pieces between a full stop, exclamation or question mark and the white space after it."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def text_metrics(text: Column, grades: bool = False) -> Column:
    """struct<words, sentences, passive, spread, grades>: spread is the population deviation of sentence lengths.

    With ``grades``: Flesch-Kincaid, Coleman-Liau and Fog of texts of fifteen words or more (syllables counted as groups of vowels), else null.
    """
    words = F.regexp_count(text, F.lit(WORD))
    s = sentence_texts(text)
    n = F.greatest(F.size(s), F.lit(1))
    lengths = F.transform(s, lambda x: F.regexp_count(x, F.lit(WORD)).cast("double"))
    total, squares = F.aggregate(lengths, F.lit(0.0), lambda a, b: a + b), F.aggregate(lengths, F.lit(0.0), lambda a, b: a + b * b)
    spread = F.when(F.size(s) > 1, F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))).otherwise(F.lit(0.0))
    out = [words.alias("words"), n.alias("sentences"), (F.regexp_count(text, F.lit(PASSIVE_FORM)) / n).alias("passive"), spread.alias("spread")]
    if grades:
        long = words >= 15
        letters, syllables, hard = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")), F.regexp_count(F.lower(text), F.lit(r"[aeiouy]+")), F.regexp_count(F.lower(text), F.lit(r"\b[^aeiouy\W\d_]*(?:[aeiouy]+[^aeiouy\W\d_]+){2}[aeiouy]"))
        per = words / n
        out += [F.when(long, 0.39 * per + 11.8 * syllables / words - 15.59).alias("fk"), F.when(long, 5.88 * letters / words - 29.6 * n / words - 15.8).alias("cl"), F.when(long, 0.4 * (per + 100.0 * hard / words)).alias("fog")]
    return F.struct(*out)


def section_score(m: Column, grades: bool = False) -> Column:
    """Mean of what each metric gives: 0 or a half off for grades that are too high, up to a half off for too much passive in three sentences or more; 1 if nothing applies."""
    passive = F.when(m["sentences"] >= 3, F.greatest(F.lit(0.0), 1.0 - F.least(F.greatest(m["passive"] - PASSIVE, F.lit(0.0)) * 1.25, F.lit(0.5))))
    parts = [passive]
    if grades:  # fixed values: 18, 16 and 17 are the grades from which a text is too hard
        parts += [F.when(m["fk"] >= 18, 0.0).when(m["fk"] < 18, 1.0), F.when(m["cl"] >= 16, 0.5).when(m["cl"] < 16, 1.0), F.when(m["fog"] >= 17, 0.5).when(m["fog"] < 17, 1.0)]
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / n).otherwise(F.lit(1.0))


def with_sections(docs: DataFrame, grades: bool = False) -> DataFrame:
    """``sections`` as array<struct<label,text,path,m>> with the text metrics of each."""
    every = V.sections()
    return docs.withColumn("sections", F.transform(every, lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text"), s["path"].alias("path"), text_metrics(s["text"], grades).alias("m"))))


def _average(values: Column, empty: float = 1.0) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / n).otherwise(F.lit(empty))


def text_readability(grades: bool = False) -> Column:
    return _average(F.transform(F.col("sections"), lambda s: section_score(s["m"], grades)))


def text_issues(grades: bool = False) -> Column:
    words = F.regexp_count(coalesce_text("purpose"), F.lit(WORD))
    path = F.when(_class(), "$.module_member_description.purpose").otherwise("$.module_member_description")
    every = [
        _if(yes("purpose") & (words < MIN_PURPOSE_WORDS), "READ_PURPOSE_TOO_TERSE", "module_member_description.purpose", None, path, F.col("purpose")),
        _each(F.col("sections"), lambda s: (s["m"]["passive"] >= PASSIVE) & (s["m"]["sentences"] >= 3), lambda s: _one("READ_PASSIVE_VOICE_HIGH", s["label"], None, s["path"], s["text"])),
    ]
    if grades:
        hard = lambda s: F.coalesce((s["m"]["fk"] >= 14) | (s["m"]["cl"] >= 16) | (s["m"]["fog"] >= 17), F.lit(False))
        every.append(_each(F.col("sections"), hard, lambda s: _one("READ_TEXT_GRADE_TOO_HIGH", s["label"], None, s["path"], s["text"])))
    return F.concat(*every)


def _complexity(node: ast.AST) -> int:
    """Branches of a function or class body, one at least."""
    inner = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension, ast.IfExp)
    return 1 + sum(isinstance(n, inner) for n in ast.walk(node)) + sum(len(n.values) - 1 for n in ast.walk(node) if isinstance(n, ast.BoolOp))


def code_metrics(code: str) -> dict:
    """What can be told of an example: lines, indent, identifiers, comments, shown output, whether it parses, branches."""
    fenced = re.match(r"^```(?:python|py|pycon)?\s*\n?(.*?)\n?```$", code.strip(), re.DOTALL)
    code = fenced[1] if fenced else code
    lines = [x for x in code.splitlines() if x.strip()]
    indent = max((len(x) - len(x.lstrip("\t")) if x.startswith("\t") else (len(x) - len(x.lstrip(" \t"))) // 4 for x in lines), default=0)
    out = {"loc": len(lines), "indent": indent, "comments": sum(x.lstrip().startswith("#") for x in lines), "output": bool(re.search(r"(?:^\s*#\s*Output\b|^\s*>>>|^\s*\.\.\.)", code, re.M)), "parses": True, "names": 0, "name_length": 0.0, "single": 0.0, "imports": 0, "branches": 1}
    try:
        tree = ast.parse(re.sub(r"^\s*(?:>>>|\.\.\.)\s?", "", code, flags=re.M))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {**out, "parses": False}
    names = [n.id if isinstance(n, ast.Name) else n.arg if isinstance(n, ast.arg) else n.name for n in ast.walk(tree) if isinstance(n, (ast.Name, ast.arg, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    blocks = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    out |= {"names": len(names), "imports": sum(isinstance(n, (ast.Import, ast.ImportFrom)) for n in ast.walk(tree)), "branches": max(map(_complexity, blocks), default=1)}
    if names:
        out |= {"name_length": sum(map(len, names)) / len(names), "single": sum(len(n) == 1 for n in names) / len(names)}
    return out


EXAMPLE_METRICS = "array<struct<i:int,loc:int,indent:int,comments:int,output:boolean,parses:boolean,names:int,name_length:double,single:double,imports:int,branches:int,explained:boolean>>"


def with_examples(docs: DataFrame) -> DataFrame:
    """``code`` beside the columns: the metrics of each example that is there."""
    @F.pandas_udf(EXAMPLE_METRICS)
    def measure(examples: pd.Series) -> pd.Series:
        warnings.simplefilter("ignore")
        out = []
        for row in examples:
            found = []
            for i, e in enumerate(row if row is not None else ()):
                text, more = e["example"], e["additional_information"]
                if text and text.strip() and text.strip().upper() not in ("N/A", "NA", "NONE", "NULL", "TBD"):
                    found.append({"i": i, **code_metrics(text), "explained": bool(more and more.strip() and more.strip().upper() not in ("N/A", "NA", "NONE", "NULL", "TBD"))})
            out.append(found)
        return pd.Series(out)

    return docs.withColumn("code", measure(F.coalesce("examples", V.none(V.EXAMPLE))))


def example_score(m: Column, branches: bool = False) -> Column:
    """Weighted mean of parsing, names, shown output, comments, indent and length (and branches, where they are to count)."""
    # fixed values: .30 for parsing, .20 for names, .10 for each of the others
    name = F.when((m["name_length"] > 0) & (m["name_length"] < 3), m["name_length"] / 3.0).otherwise(1.0) * F.when(m["single"] > 0, F.greatest(F.lit(0.0), 1.0 - m["single"] * 1.5)).otherwise(1.0)
    over = lambda value, most, per: F.when(value <= most, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (value - most) * per))
    parts = [(0.30, m["parses"].cast("double")), (0.20, name), (0.10, F.when(m["output"], 1.0).otherwise(0.5)), (0.10, F.when(m["comments"] > 0, 1.0).otherwise(0.6)), (0.10, over(m["indent"], 3, 0.2)), (0.10, over(m["loc"], EXAMPLE_LINES, 1 / 30))]
    if branches:
        parts.append((0.10, F.when(m["parses"], over(m["branches"], EXAMPLE_BRANCHES, 0.15)).otherwise(1.0)))
    return sum((s * w for w, s in parts), F.lit(0.0)) / sum(w for w, _ in parts)


def code_readability() -> Column:
    return _average(F.transform(F.col("code"), lambda m: example_score(m)))


def code_issues() -> Column:
    path = lambda m, f="example": F.concat(F.lit("$.examples["), m["i"].cast("string"), F.lit(f"].{f}"))
    c = F.col("code")
    return F.concat(
        _each(c, lambda m: ~m["parses"], lambda m: _one("READ_EXAMPLE_PARSE_FAILED", "examples", m["i"], path(m))),
        _each(c, lambda m: m["single"] >= SINGLE_CHAR, lambda m: _one("READ_EXAMPLE_SINGLE_CHAR_VAR", "examples", m["i"], path(m))),
        _each(c, lambda m: (m["loc"] > EXAMPLE_LINES) | (m["branches"] > EXAMPLE_BRANCHES), lambda m: _one("READ_EXAMPLE_HIGH_COMPLEXITY", "examples", m["i"], path(m))),
        _each(c, lambda m: (m["comments"] == 0) & ~m["output"] & ~m["explained"], lambda m: _one("READ_EXAMPLE_NO_EXPLANATION", "examples", m["i"], path(m, "additional_information"))),
    )


# maintainability


def count_links(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_LINK)) + F.regexp_count(text, F.lit(MARKDOWN_LINK)) + F.regexp_count(text, F.lit(BARE_URL))


def strip_links(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, MARKDOWN_LINK, "$1"), TOKEN_LINK, "$1"), BARE_URL, "")


def mentions(text: Column) -> Column:
    """Distinct dotted or capitalised identifiers of a text outside its links."""
    return F.array_distinct(F.regexp_extract_all(strip_links(text), F.lit(MENTION), 1))


def builtins_in(text: Column) -> Column:
    """Distinct built-in types a text names."""
    known = F.array(*[F.lit(x) for x in BUILTIN_PAGE])
    return F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(coalesce_text(text)), F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"), 1)), known)


def is_linked(text: Column, token: Column) -> Column:
    """Is the token the label of a link in the text?"""
    quoted = F.concat(F.lit(r"\Q"), token, F.lit(r"\E"))
    return F.regexp(text, F.concat(F.lit(r"(?i)\b"), quoted, F.lit(r"\s*\(\s*https?://"))) | F.regexp(text, F.concat(F.lit(r"(?i)\[\s*"), quoted, F.lit(r"\s*\]\s*\(\s*https?://")))


def _typed() -> Column:
    """Parameter and return types that say something, as array<struct<section,name,type,desc,normal>>."""
    row = lambda section, name, t, d: F.struct(F.lit(section).alias("section"), name.alias("name"), t.alias("type"), d.alias("desc"), T.normalize(t).alias("normal"))
    p = F.transform(_params(), lambda x: row("parameters", _unnamed(x), x["type"], x["description"]))
    r = F.array(row("returns", F.lit(None).cast("string"), F.col("returns")["type"], F.col("returns")["description"]))
    return F.filter(F.concat(p, r), lambda x: yes(x["type"]))


def with_links(docs: DataFrame) -> DataFrame:
    """``linked_sections`` and ``typed`` beside the columns; needs ``with_sections``."""
    s = F.transform(F.col("sections"), lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text"), s["path"].alias("path"), count_links(s["text"]).alias("links"), (count_links(s["text"]) / s["m"]["sentences"]).alias("density"), mentions(s["text"]).alias("mentions")))
    return docs.withColumn("linked_sections", s).withColumn("typed", _typed())


def link_density(s: Column) -> Column:
    """Score of one section: 0 with mentions and no link, .6 with more links than sentences, else by how near it comes to the least density."""
    named = F.size(s["mentions"]) > 0
    return F.when(named & (s["links"] == 0), 0.0).when(s["density"] > LINKS_MOST, 0.6).when(~named | (s["density"] >= LINKS_LEAST), 1.0).otherwise(F.least(F.lit(1.0), s["density"] / LINKS_LEAST))


def restates(x: Column) -> Column:
    """Is a description's first sentence mostly its type again, without a link?"""
    first = F.regexp_extract_all(F.lower(F.split(F.trim(x["desc"]), r"\.")[0]), F.lit(r"([a-z_]+)"), 1)
    t = T.tokens(x["normal"])
    return (F.size(t) > 0) & (F.size(first) > 0) & (F.size(F.array_intersect(t, first)) / F.size(t) >= RESTATED) & (count_links(x["desc"]) == 0)


def maintainability_metrics(internal: str | None = None) -> dict[str, Column]:
    """Needs ``with_links``; ``internal`` names a column with IXRefC, which is 1 without."""
    t = F.col("typed")
    named = F.filter(t, lambda x: ~T.is_builtin(x["normal"]))
    built = F.flatten(F.transform(t, lambda x: F.transform(builtins_in(x["type"]), lambda b: F.struct(x["type"].alias("type"), b.alias("b")))))
    described = F.filter(t, lambda x: (x["section"] == "parameters") & yes(x["desc"]))
    return {
        "HD": _average(F.transform(F.col("linked_sections"), link_density)), "TXRefC": _share(named, lambda x: count_links(x["type"]) > 0), "BTRefC": _share(built, lambda x: is_linked(x["type"], x["b"])),
        "IXRefC": F.coalesce(F.col(internal), F.lit(1.0)) if internal else F.lit(1.0), "ITR": _share(described, lambda x: ~restates(x)),
    }


def maintainability_issues() -> Column:
    t, s = F.col("typed"), F.col("linked_sections")
    path = lambda x, f: F.when(x["section"] == "returns", f"$.returns.{f}").otherwise(_param_path(F.coalesce(x["name"], F.lit("")), f))
    named = lambda x: F.size(x["mentions"]) > 0
    bare = F.flatten(F.transform(t, lambda x: F.transform(F.filter(builtins_in(x["type"]), lambda b: ~is_linked(x["type"], b)), lambda b: F.struct(x["section"].alias("section"), x["name"].alias("name"), x["type"].alias("type"), b.alias("b")))))
    pages = F.create_map(*[F.lit(x) for kv in BUILTIN_PAGE.items() for x in kv])
    return F.concat(
        _each(s, lambda x: x["text"].rlike(r"url_placeholder_\d+"), lambda x: _one("MAINT_BROKEN_PLACEHOLDER", x["label"], None, x["path"], x["text"])),
        _each(s, lambda x: named(x) & (x["links"] == 0), lambda x: _one("MAINT_NO_HYPERLINKS_IN_SECTION", x["label"], None, x["path"], x["text"])),
        _each(s, lambda x: ~(named(x) & (x["links"] == 0)) & (x["density"] > LINKS_MOST), lambda x: _one("MAINT_OVER_LINKING", x["label"], None, x["path"], x["text"])),
        _each(t, lambda x: ~T.is_builtin(x["normal"]) & (count_links(x["type"]) == 0), lambda x: _one("MAINT_TYPE_NOT_LINKED", x["section"], x["name"], path(x, "type"), x["type"])),
        F.transform(bare, lambda x: _one("MAINT_BUILTIN_NOT_LINKED", x["section"], x["name"], path(x, "type"), x["type"], pages[x["b"]])).cast(ISSUE),
        _each(t, lambda x: (x["section"] == "parameters") & yes(x["desc"]) & restates(x), lambda x: _one("MAINT_INLINE_TYPE_RESTATEMENT", "parameters", x["name"], path(x, "description"), x["desc"])),
    )


def internal_references(docs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, ixref): the linked share of mentions of known members; (id, section, target): those that are not linked.

    names: (name).  Needs ``with_links``; mentions are joined as rows, a document's one by one.
    """
    each = docs.select("id", F.explode("linked_sections").alias("s")).select("id", "s.label", "s.text", F.explode("s.mentions").alias("name")).where(~F.lower("name").isin(*NO_MENTION))
    hit = each.join(names.select("name").distinct(), "name", "left_semi").withColumn("linked", is_linked(F.col("text"), F.col("name")))
    share = hit.groupBy("id").agg((F.count_if("linked") / F.count("*")).alias("ixref"))
    return share, hit.where("not linked").select("id", F.col("label").alias("section"), F.col("name").alias("target"))


# all of it


def evaluated(docs: DataFrame, names: DataFrame | None = None, grades: bool = False) -> DataFrame:
    """(id, member_type, metrics map, completeness, accuracy, readability, maintainability, overall, issues), one row per document.

    docs: document and truth columns.  Without ``names`` references to other members are not looked up.
    """
    d = with_links(with_sections(with_examples(with_drift(with_matches(docs))), grades))
    internal = None
    if names is not None:
        share, _ = internal_references(d, names)
        d, internal = d.join(share, "id", "left"), "ixref"
    c, a, m = completeness_metrics(), accuracy_metrics(), maintainability_metrics(internal)
    text, code = text_readability(grades), code_readability()
    dims = {"completeness": completeness_score(c), "accuracy": accuracy_score(a), "readability": READABILITY["text"] * text + READABILITY["code"] * code, "maintainability": mean(m, MAINTAINABILITY, 1.0)}
    metrics = F.map_filter(F.create_map(*[x for k, v in {**c, **a, **m, "TextReadability": text, "CodeReadability": code}.items() for x in (F.lit(k), F.round(v, 6))]), lambda k, v: v.isNotNull())
    issues = F.concat(completeness_issues(), accuracy_issues(), text_issues(grades), code_issues(), maintainability_issues())
    scored = d.select("id", "member_type", metrics.alias("metrics"), *[v.alias(k) for k, v in dims.items()], issues.alias("issues"))
    return scored.select("id", "member_type", "metrics", *[F.round(k, 6).alias(k) for k in dims], F.round(mean({k: F.col(k) for k in dims}, OVERALL), 6).alias("overall"), "issues")


def reports(direct: DataFrame, inherited: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Evaluations of members and of inherited members with ``route`` and ``skipped``: an inherited one without code is skipped, all its scores 0."""
    both = direct.withColumn("route", F.lit("direct")).unionByName(inherited.withColumn("route", F.lit("inherited")))
    keyed = both.withColumn("id", F.struct("route", "id"))
    judged = evaluated(keyed.where(_has()).drop("route"), names).withColumn("skipped", F.lit(False))
    zero = F.lit(0.0)
    left_out = keyed.where(~_has()).select("id", "member_type", F.create_map().cast("map<string,double>").alias("metrics"), *[zero.alias(k) for k in (*OVERALL, "overall")], F.array().cast(ISSUE).alias("issues"), F.lit(True).alias("skipped"))
    out = judged.unionByName(left_out)
    return out.select("id.route", "id.id", *[c for c in out.columns if c != "id"])


def issue_rows(found: DataFrame, *keys: str) -> DataFrame:
    """Issues as rows with dimension, severity and strategy from the catalogue."""
    keys = keys or ("id",)
    dims = F.broadcast(catalogue(found.sparkSession))  # a fixed table of 41 rows
    return found.select(*keys, F.inline("issues")).join(dims, "code", "left").select(*keys, "code", "dimension", "severity", "strategy", "section", "target", "json_path", "doc_value", "code_value")


def library_summary(found: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """Aggregates of reports: counts and overall means, means and medians by dimension, issue counts, the best and worst by overall score."""
    live = found.where("not skipped")
    total = found.agg(F.count("*").alias("reports"), F.count_if("skipped").alias("skipped"), F.round(F.avg(F.when(~F.col("skipped"), F.col("overall"))), 6).alias("mean"), F.round(F.median(F.when(~F.col("skipped"), F.col("overall"))), 6).alias("median"))
    each = live.select(F.inline(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("score")) for k in OVERALL])))
    by = each.groupBy("dimension").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.median("score"), 6).alias("median"))
    rows = issue_rows(live)
    return {
        "total": total, "dimensions": by, "codes": rows.groupBy("code").agg(F.count("*").alias("n")), "severities": rows.groupBy("severity").agg(F.count("*").alias("n")),
        "worst": live.orderBy("overall", "route", "id").limit(top), "best": live.orderBy(F.desc("overall"), "route", "id").limit(top),
    }
