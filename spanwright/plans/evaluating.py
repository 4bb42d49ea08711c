"""Queries that evaluate documentation against code, and mend it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions import types as T
from spanwright.operators import catalog as C
from spanwright.operators import docview as V
from spanwright.operators import evaluation as E
from spanwright.operators import maintenance as M
from spanwright.plans.catalogue import cur, inh
from spanwright.plans.registry import CUR, INH, PRESENT, Registry
from spanwright.runtime import written

query = Registry()
P = lambda x: f"coalesce({PRESENT.format(x)}, false)"

#: the documents of inherited members (their stored signature and description) beside the code of their originals
_TRUE = "list_filter(coalesce(c.parameters, []), lambda p: p.name IS NOT NULL AND p.name NOT IN ('self', 'cls'))"
_VIEW = f"""{CUR}, {INH}, dv0 AS (SELECT i.id, i.member_type, {V.signature_sql('i.signature')} AS signature, i.doc_description AS purpose, i.original_member_id FROM inh i),
 dv AS (SELECT dv0.*, {V.parameters_sql('signature')} AS params, nullif(regexp_extract(coalesce(signature, ''), '->\\s*(.+)$', 1), '') AS r_type, c.id IS NOT NULL AS has, c.member_type AS t_type, {_TRUE} AS truths, c.returns.type AS t_returns, coalesce(c.is_async, false) AS t_async, len(list_filter(coalesce(c.decorators, []), lambda x: contains(lower(x), 'deprecated'))) > 0 AS t_deprecated FROM dv0 LEFT JOIN cur c ON c.id = dv0.original_member_id)"""
_VOID = f"(t_type IN ('function', 'method') AND (NOT {P('t_returns')} OR lower(trim(coalesce(t_returns, ''), ' ')) = 'none'))"
_WORDS = "CASE WHEN trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' '), ' ')) END"
_NAMES = f"list_distinct(list_transform(list_filter(params, lambda p: {P('p.name')}), lambda p: p.name))"
_CODES = "list_distinct(list_transform(truths, lambda p: p.name))"


def documents(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Document and truth columns of members as they document themselves, and of inherited members against their originals."""
    c = cur(s, d, "name", "member_type", "docstring", "source_code", "parameters", "returns", "decorators", "is_async")
    t = V.truth(c)
    texts = F.array().cast(V.TEXTS)
    own = F.transform(F.coalesce(F.col("t_parameters"), F.array()), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), F.when(p["default"].isNotNull(), F.concat(F.lit("Default: "), p["default"])).alias("description"))).cast(V.PARAMETER)
    example = F.when(F.col("source_code").isNotNull(), F.array(F.struct(F.col("source_code").alias("example"), F.lit(None).cast("string").alias("additional_information")))).otherwise(F.array()).cast(V.EXAMPLE)
    direct = c.select("id", "member_type", F.col("docstring").alias("purpose"), "returns", "source_code").join(t, "id").select(
        "id", "member_type", F.col("t_variants")["full"].alias("signature"), "purpose", texts.alias("info"), own.alias("parameters"), F.struct(F.col("returns")["type"].alias("type"), F.col("returns")["description"].alias("description")).alias("returns"), example.alias("examples"), texts.alias("notes"), texts.alias("edge_cases"), *V.TRUTH
    )
    return direct, inherited_documents(s, d, t)


def inherited_documents(s, d, t=None):
    texts = F.array().cast(V.TEXTS)
    if t is None:
        t = V.truth(cur(s, d, "name", "member_type", "parameters", "returns", "decorators", "is_async"))
    i = inh(s, d, "member_type", "signature", "doc_description", "original_member_id").withColumn("text", V.signature_text("signature"))
    r = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), r"->\s*(.+)$", 1), F.lit(""))
    doc = i.select("id", "original_member_id", "member_type", F.col("text").alias("signature"), F.col("doc_description").alias("purpose"), texts.alias("info"), V.signature_parameters("text").alias("parameters"), F.struct(r.alias("type"), F.lit(None).cast("string").alias("description")).alias("returns"), F.array().cast(V.EXAMPLE).alias("examples"), texts.alias("notes"), texts.alias("edge_cases"))
    return doc.join(t.withColumnRenamed("id", "original_member_id"), "original_member_id", "left").select(*V.DOC, *V.TRUTH)


@query(f"WITH {_VIEW} SELECT id, signature, array_to_string(list_transform(params, lambda p: p.name || ':' || coalesce(p.type, '-') || ':' || coalesce(p.description, '-')), '|') AS parameters, r_type, has AS has_truth, CASE WHEN has THEN len(truths) END AS n_truths FROM dv")
def document_views(s, d):
    """What the stored signatures of inherited members document, and whether the code is known."""
    x = inherited_documents(s, d)
    p = F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], F.coalesce(p["type"], F.lit("-")), F.coalesce(p["description"], F.lit("-")))), "|")
    return x.select("id", "signature", p.alias("parameters"), F.col("returns")["type"].alias("r_type"), F.coalesce("has_truth", F.lit(False)).alias("has_truth"), F.when(F.col("has_truth"), F.size("t_parameters")).cast("long").alias("n_truths"))


_COMP = f"""cm AS (SELECT id, {P('signature')}::INT::DOUBLE AS SigCov, {P('purpose')}::INT::DOUBLE AS PurpCov,
 CASE WHEN has AND t_type IN ('class', 'function', 'method') THEN CASE WHEN len(truths) > 0 THEN len(list_filter(truths, lambda t: list_contains({_NAMES}, t.name))) / len(truths) ELSE 1.0 END WHEN len(params) > 0 THEN len({_NAMES}) / len(params) ELSE 1.0 END::DOUBLE AS PaC,
 CASE WHEN len(params) > 0 THEN len(list_filter(params, lambda p: {P('p.type')})) / len(params) ELSE 1.0 END::DOUBLE AS PTC, CASE WHEN len(params) > 0 THEN len(list_filter(params, lambda p: {P('p.description')} AND {_WORDS.format('p.description')} >= 3)) / len(params) ELSE 1.0 END::DOUBLE AS PDC,
 CASE WHEN member_type = 'class' OR has AND {_VOID} THEN 1.0 ELSE {P('r_type')}::INT / 2.0 END::DOUBLE AS RC, 0.0::DOUBLE AS ExC FROM dv)"""
_SCORE = "CASE WHEN (SELECT member_type FROM dv WHERE dv.id = cm.id) = 'class' THEN 0 ELSE SigCov * 0.10 + PurpCov * 0.20 + PaC * 0.20 + PTC * 0.15 + PDC * 0.15 + RC * 0.10 + ExC * 0.10 END"


@query(f"WITH {_VIEW}, {_COMP} SELECT id, SigCov AS sig_cov, PurpCov AS purp_cov, round(PaC, 6) AS pac, round(PTC, 6) AS ptc, round(PDC, 6) AS pdc, RC AS rc, ExC AS exc, round(SigCov * 0.10 + PurpCov * 0.20 + PaC * 0.20 + PTC * 0.15 + PDC * 0.15 + RC * 0.10 + ExC * 0.10, 6)::DOUBLE AS score FROM cm")
def completeness(s, d):
    """Seven coverage metrics of inherited members' documentation against their code, and their weighted mean (none is a class)."""
    parts = E.completeness_metrics()
    names = {"SigCov": "sig_cov", "PurpCov": "purp_cov", "PaC": "pac", "PTC": "ptc", "PDC": "pdc", "RC": "rc", "ExC": "exc"}
    return inherited_documents(s, d).select("id", *[F.round(parts[k], 6).alias(v) for k, v in names.items()], F.round(E.completeness_score(parts), 6).alias("score"))


_COMP_ISSUES = f"""ci AS (SELECT id, 'COMP_SIGNATURE_MISSING' AS code, NULL AS target FROM dv WHERE NOT {P('signature')} UNION ALL SELECT id, 'COMP_PURPOSE_MISSING', NULL FROM dv WHERE NOT {P('purpose')} UNION ALL SELECT id, 'COMP_NO_EXAMPLES', NULL FROM dv
 UNION ALL SELECT id, 'COMP_PARAM_NAME_MISSING', t.name FROM (SELECT id, unnest(list_filter(truths, lambda t: NOT list_contains({_NAMES}, t.name))) AS t FROM dv WHERE has AND t_type IN ('class', 'function', 'method'))
 UNION ALL SELECT id, 'COMP_PARAM_TYPE_MISSING', p.name FROM (SELECT id, unnest(params) AS p FROM dv) WHERE NOT {P('p.type')} UNION ALL SELECT id, 'COMP_PARAM_DESCRIPTION_MISSING', p.name FROM (SELECT id, unnest(params) AS p FROM dv) WHERE NOT {P('p.description')} OR {_WORDS.format('p.description')} < 3
 UNION ALL SELECT id, 'COMP_RETURN_TYPE_MISSING', NULL FROM dv WHERE member_type <> 'class' AND NOT (has AND {_VOID}) AND NOT {P('r_type')} UNION ALL SELECT id, 'COMP_RETURN_DESCRIPTION_MISSING', NULL FROM dv WHERE member_type <> 'class' AND NOT (has AND {_VOID}))"""
_SEV = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{v[1]}'" for k, v in E.ISSUES.items()) + " END"


@query(f"WITH {_VIEW}, {_COMP_ISSUES} SELECT id, code, {_SEV} AS severity, target FROM ci")
def quality_issues(s, d):
    """What is missing from the documentation of inherited members."""
    x = inherited_documents(s, d).select("id", E.completeness_issues().alias("issues"))
    return E.issue_rows(x).select("id", "code", "severity", "target")


@query(f"WITH {_VIEW}, {_COMP_ISSUES} SELECT code, {_SEV} AS severity, count(*) AS n FROM ci GROUP BY 1, 2")
def issue_counts(s, d):
    x = inherited_documents(s, d).select("id", E.completeness_issues().alias("issues"))
    return E.issue_rows(x).groupBy("code", "severity").agg(F.count("*").alias("n"))


_EQ = "(CASE WHEN {0} = {1} THEN true WHEN {0} = '' OR {1} = '' THEN false ELSE len(TOK0) > 0 AND len(TOK1) > 0 AND len(list_intersect(TOK0, TOK1)) >= 0.8 * len(list_distinct(list_concat(TOK0, TOK1))) END)".replace("TOK0", T.tokens_sql("{0}")).replace("TOK1", T.tokens_sql("{1}"))
_PLAIN = "lower(regexp_replace(trim({0}, ' '), '^[''\"]+|[''\"]+$', '', 'g'))"
_HINT = """nullif(regexp_replace(coalesce(nullif(regexp_extract(coalesce({0}, ''), '(?i)default(?:\\s*[:=]\\s*|\\s+is\\s+|\\s+\\()\\s*(?:''([^'']+)''|"([^"]+)"|([^\\s,;\\n)]+))', 1), ''), nullif(regexp_extract(coalesce({0}, ''), '(?i)default(?:\\s*[:=]\\s*|\\s+is\\s+|\\s+\\()\\s*(?:''([^'']+)''|"([^"]+)"|([^\\s,;\\n)]+))', 2), ''), nullif(regexp_extract(coalesce({0}, ''), '(?i)default(?:\\s*[:=]\\s*|\\s+is\\s+|\\s+\\()\\s*(?:''([^'']+)''|"([^"]+)"|([^\\s,;\\n)]+))', 3), '')), '^[ .,;''"]+|[ .,;''"]+$', '', 'g'), '')"""
_ACC = f"""mt AS (SELECT id, n, d, t FROM (SELECT id, n, list_filter(params, lambda p: p.name = n)[-1] AS d, list_filter(truths, lambda p: p.name = n)[-1] AS t FROM (SELECT id, params, truths, unnest(list_intersect({_CODES}, {_NAMES})) AS n FROM dv WHERE has))),
 mm AS (SELECT id, {P('t.type')} OR {P('d.type')} AS typed, {T.normalize_sql('t.type')} AS tn, {T.normalize_sql('d.type')} AS dn, t.default AS td, {_HINT.format('d.description')} AS dd FROM mt), mx AS (SELECT id, count(*) AS n, count_if(NOT typed OR {_EQ.format('tn', 'dn')}) AS same, count(td) AS nd, count_if(td IS NOT NULL AND coalesce({_PLAIN.format('td')} = {_PLAIN.format('dd')} OR coalesce(TRY_CAST({_PLAIN.format('td')} AS DOUBLE) = TRY_CAST({_PLAIN.format('dd')} AS DOUBLE), false), false)) AS ag FROM mm GROUP BY 1),
 ac AS (SELECT dv.id, (len({_CODES}) = len({_NAMES}))::INT::DOUBLE AS pca, CASE WHEN len(list_distinct(list_concat({_CODES}, {_NAMES}))) > 0 THEN len(list_intersect({_CODES}, {_NAMES})) / len(list_distinct(list_concat({_CODES}, {_NAMES}))) ELSE 1.0 END::DOUBLE AS pna, coalesce(mx.same / nullif(mx.n, 0), 1.0)::DOUBLE AS ptc_acc, coalesce(mx.ag / nullif(mx.nd, 0), 1.0)::DOUBLE AS pda, NOT ({P('t_returns')} OR {P('r_type')}) AS norets, {T.normalize_sql('t_returns')} AS tn, {T.normalize_sql('r_type')} AS rn, CASE WHEN t_async AND NOT contains(lower(coalesce(signature, '')), 'async') THEN 0.0 ELSE 1.0 END::DOUBLE AS async_marker, CASE WHEN t_deprecated AND NOT contains(lower(coalesce(purpose, '')), 'deprecat') THEN 0.0 ELSE 1.0 END::DOUBLE AS deprecated_marker FROM dv LEFT JOIN mx ON mx.id = dv.id WHERE has)"""


@query(f"WITH {_VIEW}, {_ACC} SELECT id, pca, round(pna, 6) AS pna, round(ptc_acc, 6) AS ptc_acc, round(pda, 6) AS pda, CASE WHEN norets OR {_EQ.format('tn', 'rn')} THEN 1.0 ELSE 0.0 END::DOUBLE AS rtc, async_marker, deprecated_marker FROM ac")
def accuracy_metrics(s, d):
    """How the documentation of inherited members agrees with their code (the metrics that need no alignment of texts)."""
    x = E.with_matches(inherited_documents(s, d).where("has_truth"))
    m = E.accuracy_metrics(None)
    names = {"PCA": "pca", "PNA": "pna", "PTC_acc": "ptc_acc", "PDA": "pda", "RTC": "rtc", "AsyncMarker": "async_marker", "DeprecatedMarker": "deprecated_marker"}
    return x.select("id", *[F.round(m[k], 6).alias(v) for k, v in names.items()])


@query(f"WITH {_VIEW}, {_ACC}, ai AS (SELECT id, 'ACC_PARAM_NAME_UNKNOWN' AS code, n AS target FROM (SELECT id, unnest(list_filter(list_transform(params, lambda p: p.name), lambda n: NOT list_contains({_CODES}, n))) AS n FROM dv WHERE has) UNION ALL SELECT id, 'ACC_PARAM_MISSING_FROM_DOC', n FROM (SELECT id, unnest(list_filter(list_transform(truths, lambda p: p.name), lambda n: NOT list_contains({_NAMES}, n))) AS n FROM dv WHERE has) UNION ALL SELECT id, 'ACC_RETURN_TYPE_MISMATCH', NULL FROM ac WHERE NOT (norets OR {_EQ.format('tn', 'rn')}) UNION ALL SELECT id, 'ACC_ASYNC_MARKER_MISSING', NULL FROM ac WHERE async_marker = 0 UNION ALL SELECT id, 'ACC_DEPRECATED_NOT_NOTED', NULL FROM ac WHERE deprecated_marker = 0) SELECT code, {_SEV} AS severity, count(*) AS n, count(DISTINCT id) AS n_documents FROM ai GROUP BY 1, 2")
def accuracy_issue_counts(s, d):
    """Disagreements of documentation with code by kind (types and defaults of parameters left to accuracy_issues)."""
    x = E.with_matches(inherited_documents(s, d)).select("id", E.accuracy_issues(None).alias("issues"))
    rows = E.issue_rows(x).where("code not in ('ACC_PARAM_TYPE_MISMATCH', 'ACC_PARAM_DEFAULT_MISMATCH')")
    return rows.groupBy("code", "severity").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_documents"))


@query(None)
def accuracy_issues(s, d):
    """All disagreements, drifted signatures among them."""
    x = E.with_drift(E.with_matches(inherited_documents(s, d))).select("id", E.accuracy_issues().alias("issues"))
    return E.issue_rows(x).select("id", "code", "severity", "target", "doc_value", "code_value")


@query(None)
def accuracy(s, d):
    """The weighted mean of all accuracy metrics; 1 where the code is unknown."""
    x = E.with_drift(E.with_matches(inherited_documents(s, d)))
    return x.select("id", F.round("drift", 6).alias("drift"), F.round(E.accuracy_score(E.accuracy_metrics()), 6).alias("score"))


_SENT = "list_filter(string_split(regexp_replace(purpose, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'), ' ') <> '')"
_PASS = E.PASSIVE_FORM
_READ = f"""rd0 AS (SELECT id, docstring AS purpose, len(regexp_extract_all(docstring, '[\\pL\\pN_]+')) AS words, greatest(len({_SENT.replace('purpose', 'docstring')}), 1) AS sentences, list_transform({_SENT.replace('purpose', 'docstring')}, lambda s: len(regexp_extract_all(s, '[\\pL\\pN_]+'))) AS lens, len(regexp_extract_all(docstring, '{_PASS}')) AS pv FROM cur WHERE {P('docstring')}),
 rd AS (SELECT id, words, sentences, pv / sentences AS passive, CASE WHEN len(lens) > 1 THEN list_stddev_pop(lens) ELSE 0.0 END AS spread FROM rd0)"""


@query(f"WITH {CUR}, {_READ} SELECT id, words::INT AS words, sentences::INT AS sentences, round(passive, 6)::DOUBLE AS passive, round(spread, 6)::DOUBLE AS spread, round(CASE WHEN sentences >= 3 THEN greatest(0.0, 1.0 - least(greatest(passive - 0.4, 0) * 1.25, 0.5)) ELSE 1.0 END, 6)::DOUBLE AS score FROM rd")
def readability(s, d):
    """Words, sentences, passive forms per sentence and the spread of sentence lengths of docstrings, with their score."""
    c = cur(s, d, "docstring").where(E.yes("docstring")).select("id", E.text_metrics(F.col("docstring")).alias("m"))
    return c.select("id", "m.words", "m.sentences", F.round("m.passive", 6).alias("passive"), F.round("m.spread", 6).alias("spread"), F.round(E.section_score(F.col("m")), 6).alias("score"))


@query(None)
def readability_grades(s, d):
    """Reading grades of documents' texts of fifteen words or more."""
    from spanwright.runtime import table

    x = table(s, d, "documents").where("text is not null").select("doc_id", E.text_metrics(F.col("text"), True).alias("m"))
    return x.select("doc_id", *[F.round(f"m.{k}", 4).alias(k) for k in ("fk", "cl", "fog")], F.round(E.section_score(F.col("m"), True), 6).alias("score"))


@query(None)
def example_metrics(s, d):
    """What can be told of members' sources as examples, and their score."""
    c = cur(s, d, "source_code").where("source_code is not null").select("id", F.array(F.struct(F.col("source_code").alias("example"), F.lit(None).cast("string").alias("additional_information"))).alias("examples"))
    x = E.with_examples(c).select("id", F.col("code")[0].alias("m")).where("m is not null")
    return x.select("id", "m.loc", "m.indent", "m.parses", "m.branches", F.round("m.single", 6).alias("single"), F.round(E.example_score(F.col("m")), 6).alias("score"))


_TYPED = f"ty AS (SELECT DISTINCT id, coalesce(p.type, '') AS type FROM (SELECT id, unnest(parameters) AS p FROM cur) WHERE {P('p.type')})"
_BUILT = "list_distinct(list_filter(regexp_extract_all(lower(type), '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b', 1), lambda x: x IN (" + ", ".join(f"'{b}'" for b in E.BUILTIN_PAGE) + ")))"


@query(f"WITH {CUR}, t AS (SELECT DISTINCT p.type AS type FROM (SELECT unnest(parameters) AS p FROM cur) WHERE p.type IS NOT NULL), a AS (SELECT type, {T.normalize_sql('type')} AS norm FROM t) SELECT type, norm, array_to_string(list_sort({T.tokens_sql('norm')}), ' ') AS tokens, len({T.tokens_sql('norm')}) > 0 AND len(list_filter({T.tokens_sql('norm')}, lambda x: x NOT IN ({', '.join(repr(b) for b in T.BUILTINS)}))) = 0 AS builtin, array_to_string(list_sort({_BUILT}), ' ') AS names FROM a")
def normalized_types(s, d):
    """Types in one spelling, their tokens, whether they are built in, and the built-in types they name."""
    t = cur(s, d, "parameters").select(F.explode("parameters").alias("p")).select("p.type").where("type is not null").distinct().withColumn("norm", T.normalize("type"))
    return t.select("type", "norm", F.array_join(F.array_sort(T.tokens(F.col("norm"))), " ").alias("tokens"), T.is_builtin(F.col("norm")).alias("builtin"), F.array_join(F.array_sort(E.builtins_in(F.col("type"))), " ").alias("names"))


@query(f"WITH {CUR}, t AS (SELECT id, {T.normalize_sql('p.type')} AS a, {T.normalize_sql('returns.type')} AS b FROM (SELECT id, unnest(parameters) AS p, returns FROM cur)) SELECT id, bool_or({_EQ.format('a', 'b')}) AS same FROM t GROUP BY 1")
def returns_like_a_parameter(s, d):
    """Is a member's return type equivalent to the type of one of its parameters?"""
    x = cur(s, d, "parameters", "returns").select("id", F.explode("parameters").alias("p"), "returns").select("id", T.normalize("p.type").alias("a"), T.normalize("returns.type").alias("b"))
    return x.groupBy("id").agg(F.bool_or(T.equivalent(F.col("a"), F.col("b"))).alias("same"))


@query("WITH m AS (SELECT doc_id, text AS t, len(regexp_extract_all(text, '(\\w[\\w\\.]*)\\((https?://[^)\\s]+)\\)')) + len(regexp_extract_all(text, '\\[([^\\]]+)\\]\\((https?://[^)\\s]+)\\)')) AS made, len(regexp_extract_all(text, '(^|[^\\w(])https?://\\S+')) AS bare FROM documents WHERE text IS NOT NULL) SELECT doc_id, (made + bare)::INT AS n_links, contains(t, 'url_placeholder_') AND regexp_matches(t, 'url_placeholder_[0-9]+') AS placeholder FROM m")
def document_links(s, d):
    """Links of every style in documents, and placeholders left over."""
    from spanwright.runtime import table

    x = table(s, d, "documents").where("text is not null")
    return x.select("doc_id", E.count_links(F.col("text")).alias("n_links"), F.col("text").rlike(r"url_placeholder_\d+").alias("placeholder"))


@query(None)
def maintainability(s, d):
    """Link density, linked types and references, and restated types of inherited members' documentation."""
    names = C.own_names(cur(s, d, "primary_api_name", "all_api_names", "fully_qualified_name")).select("name")
    x = written(E.with_links(E.with_sections(inherited_documents(s, d))), "linked")
    share, _ = E.internal_references(x, names)
    m = E.maintainability_metrics("ixref")
    return x.join(share, "id", "left").select("id", *[F.round(v, 6).alias(k.lower()) for k, v in m.items()], F.round(E.mean(m, E.MAINTAINABILITY, 1.0), 6).alias("score"))


def _reports(s, d) -> DataFrame:
    direct, inherited = documents(s, d)
    names = C.own_names(cur(s, d, "primary_api_name", "all_api_names", "fully_qualified_name")).select("name")
    return E.reports(direct, inherited, names)


@query(None)
def overall_scores(s, d):
    """All four dimensions and their weighted mean of members and inherited members; external ones are skipped."""
    return _reports(s, d).drop("metrics", "issues")


@query(None)
def quality_summary(s, d):
    """Mean and median of each dimension over all reports that were not skipped."""
    return E.library_summary(_reports(s, d))["dimensions"]


_CLS = f"{CUR}, {INH}, it AS (SELECT inheriting_class_id AS id, member_type AS kind0, member_name AS name, doc_description AS description FROM inh WHERE inheriting_class_id IS NOT NULL), mb AS (SELECT DISTINCT parent_id AS id, name FROM cur WHERE parent_id IS NOT NULL AND member_type = 'method'), vb AS (SELECT DISTINCT parent_id AS id, name FROM cur WHERE parent_id IS NOT NULL AND member_type <> 'method')"


@query(f"WITH {_CLS} SELECT code, count(*) AS n FROM (SELECT CASE WHEN kind0 = 'method' THEN 'ACC_CLASS_METHOD_NOT_FOUND' ELSE 'ACC_CLASS_ATTR_NOT_FOUND' END AS code FROM it LEFT JOIN mb ON kind0 = 'method' AND mb.id = it.id AND mb.name = it.name LEFT JOIN vb ON kind0 <> 'method' AND vb.id = it.id AND vb.name = it.name WHERE {P('it.name')} AND mb.id IS NULL AND vb.id IS NULL UNION ALL SELECT CASE WHEN kind0 = 'method' THEN 'COMP_CLASS_METHOD_DESC_MISSING' ELSE 'COMP_CLASS_ATTR_DESC_MISSING' END FROM it WHERE NOT {P('description')}) GROUP BY 1")
def class_cross_references(s, d):
    """What inherited members tell of classes against the members the classes define."""
    i = inh(s, d, "inheriting_class_id", "member_type", "member_name", "signature", "doc_description").where("inheriting_class_id is not null")
    kind = lambda c: F.when(F.col(c) == "method", "method").otherwise("attribute")
    items = i.select(F.col("inheriting_class_id").alias("id"), kind("member_type").alias("kind"), F.col("member_name").alias("name"), V.signature_text("signature").alias("signature"), F.col("doc_description").alias("description"))
    c = cur(s, d, "name", "member_type", "parent_id", "parameters", "returns", "decorators", "is_async")
    actual = c.where("parent_id is not null").select("id", F.col("parent_id").alias("cls"), kind("member_type").alias("kind"), "name").join(V.truth(c).select("id", "t_variants"), "id").select(F.col("cls").alias("id"), "kind", "name", F.col("t_variants").alias("variants"))
    return E.class_issues(items, actual).where("code <> 'ACC_CLASS_METHOD_SIG_DRIFT'").groupBy("code").agg(F.count("*").alias("n"))


_FIX = f"""fx AS (SELECT id, 'COMP_RETURN_TYPE_MISSING' AS code, t_returns AS new_value FROM dv WHERE member_type <> 'class' AND NOT (has AND {_VOID}) AND NOT {P('r_type')} AND t_returns <> '' UNION ALL SELECT id, 'COMP_PARAM_TYPE_MISSING', v FROM (SELECT id, list_filter(truths, lambda t: t.name = p.name)[1].type AS v, p FROM (SELECT id, truths, unnest(params) AS p FROM dv)) WHERE NOT {P('p.type')} AND v <> '' UNION ALL SELECT id, 'ACC_RETURN_TYPE_MISMATCH', t_returns FROM ac JOIN dv USING (id) WHERE NOT (norets OR {_EQ.format('ac.tn', 'ac.rn')}) AND t_returns <> '')"""


def _patches(s, d) -> DataFrame:
    x = E.with_drift(E.with_matches(inherited_documents(s, d)))
    found = E.issue_rows(x.select("id", F.concat(E.completeness_issues(), E.accuracy_issues()).alias("issues")))
    return M.patches(found, x.select("id", "t_async", "t_variants"))


@query(f"WITH {_VIEW}, {_ACC}, {_FIX} SELECT * FROM fx")
def patches(s, d):
    """The types that mend missing and mismatched ones, from the code."""
    x = E.with_matches(inherited_documents(s, d))
    found = E.issue_rows(x.select("id", F.concat(E.completeness_issues(), E.accuracy_issues(None)).alias("issues")))
    made = M.patches(found, x.select("id", "t_async", "t_variants"))
    return made.where("code in ('COMP_RETURN_TYPE_MISSING', 'COMP_PARAM_TYPE_MISSING', 'ACC_RETURN_TYPE_MISMATCH')").select("id", "code", "new_value")


@query(None)
def patch_counts(s, d):
    """Patches of every kind."""
    return _patches(s, d).groupBy("code", "strategy").agg(F.count("*").alias("n"))


def json_documents(s, d) -> DataFrame:
    """(id, json): the documents of inherited members as JSON."""
    x = inherited_documents(s, d)
    return x.select("id", F.to_json(F.struct(F.col("signature").alias("module_member_signature"), F.col("purpose").alias("module_member_description"), "parameters", "returns", "examples")).alias("json"))


@query(None)
def mended_documents(s, d):
    """Documents with their patches applied."""
    return M.apply_patches(json_documents(s, d), _patches(s, d)).select("id", "candidate", "n_applied")


@query(None)
def pending_candidates(s, d):
    """Changed documents that wait for approval after the even ones were approved."""
    done = M.apply_patches(json_documents(s, d), _patches(s, d))
    return M.pending(done, done.where("id % 2 = 0").select("id")).select("id", "n_applied")


QUERIES, ORACLES = query.queries, query.oracles
