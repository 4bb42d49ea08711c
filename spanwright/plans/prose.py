"""Queries on signatures, sections, cross references, grounding and graph vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as X
from spanwright.functions.columns import jaccard, type_tokens
from spanwright.operators import fidelity, graph, sections
from spanwright.operators.evaluation import default_hint
from spanwright.plans.catalogue import _DEPS, cur, inh, module_dependencies
from spanwright.plans.registry import CUR, INH, Registry
from spanwright.runtime import table

query = Registry()


@query("WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\[[^\\]]+\\]\\([^)]+\\)', '', 'g'), '\\s+', ' ', 'g') AS bare, coalesce(text, '') AS t FROM documents) SELECT doc_id, (len(regexp_extract_all(t, '\\[[^\\]]+\\]\\([^)]+\\)')) + len(regexp_extract_all(regexp_replace(t, '\\[[^\\]]+\\]\\([^)]+\\)', '', 'g'), 'https?://\\S+')))::INT AS n_links FROM m")
def link_counts(s, d):
    return table(s, d, "documents").select("doc_id", X.link_count("text").alias("n_links"))


@query(f"WITH {INH} SELECT id, regexp_replace(regexp_replace(lower(coalesce(signature, '')), 'https?://\\S+', '', 'g'), '[\\s\\[\\]''\"`]+', '', 'g') AS norm FROM inh")
def normalized_signatures(s, d):
    return inh(s, d, "signature").select("id", X.normalize_signature("signature").alias("norm"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL) SELECT doc_id, line_no::INT AS line_no, length(regexp_extract(line, '^(#{1,6})\\s+', 1))::INT AS level, trim(regexp_replace(line, '^#{1,6}\\s+', ''), ' ') AS title FROM l WHERE regexp_matches(line, '^#{1,6}\\s+')")
def document_headings(s, d):
    return sections.headings(table(s, d, "documents"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{1,6})\\s+', 1)) AS level FROM l WHERE regexp_matches(line, '^#{1,6}\\s+')), n AS (SELECT doc_id, len(string_split(text, chr(10))) AS k FROM documents) SELECT h.doc_id, h.line_no::INT AS line_no, (SELECT max(p.line_no) FROM h p WHERE p.doc_id = h.doc_id AND p.line_no < h.line_no AND p.level < h.level)::INT AS parent_line, (coalesce(lead(h.line_no) OVER (PARTITION BY h.doc_id ORDER BY h.line_no), n.k) - 1)::INT AS end_line FROM h JOIN n ON n.doc_id = h.doc_id")
def section_tree(s, d):
    return sections.section_tree(table(s, d, "documents")).select("doc_id", "line_no", "parent_line", "end_line")


@query("WITH l AS (SELECT DISTINCT library, doc_id, regexp_replace(lower(trim(x, ' ')), '[0-9]+', '#', 'g') AS line FROM (SELECT library, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)) SELECT library, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_lines(s, d):
    """Lines that three or more documents of a library share."""
    return sections.repeated_lines(table(s, d, "documents"), "library", 3)


@query(f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '{X.IDENTIFIER}'), lambda x: regexp_matches(x, '^([a-z_][A-Za-z0-9_]*([.][A-Za-z0-9_]+)+|([A-Z][a-z0-9]+){{2,}})$'))))::INT AS n_candidates FROM documents WHERE split_part(replace(lower(trim(lang)), '_', '-'), '-', 1) = 'en' AND text IS NOT NULL")
def xref_candidates(s, d):
    """Distinct identifiers that English documents mention, in every spelling of the language (EN, en-XX)."""
    english = F.split(F.translate(F.lower(F.trim("lang")), "_", "-"), "-")[0] == "en"
    return table(s, d, "documents").where(english & F.col("text").isNotNull()).select("doc_id", F.size(X.xref_candidates("text")).alias("n_candidates"))


@query(f"WITH {CUR}, n AS (SELECT DISTINCT name FROM cur WHERE member_type = 'class'), w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(text, '{X.IDENTIFIER}'), lambda x: regexp_matches(x, '^([A-Z][a-z0-9]+){{2,}}$'))) AS name FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n_mentions, count(n.name) AS n_known, round(count(n.name) / count(*), 6)::DOUBLE AS known_share FROM w LEFT JOIN n USING (name) GROUP BY 1")
def internal_xrefs(s, d):
    """Share of a document's CapWord mentions that are classes of the catalogue."""
    names = cur(s, d, "name", "member_type").where("member_type = 'class'").select("name", F.lit(True).alias("known")).distinct()
    w = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(X.capwords("text")).alias("name")).join(names, "name", "left")
    return w.groupBy("doc_id").agg(F.count("*").alias("n_mentions"), F.count("known").alias("n_known"), F.round(F.count("known") / F.count("*"), 6).alias("known_share"))


@query(f"WITH {CUR}, t AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(coalesce(p.type, '')), '[^a-z0-9_]+'), lambda x: x NOT IN ('', 'or', 'and', 'of'))) AS a, list_distinct(list_filter(string_split_regex(lower(coalesce(returns.type, '')), '[^a-z0-9_]+'), lambda x: x NOT IN ('', 'or', 'and', 'of'))) AS b FROM (SELECT id, unnest(parameters) AS p, returns FROM cur)) SELECT id, max(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) ELSE 1.0 END)::DOUBLE AS best FROM t GROUP BY 1")
def type_jaccard(s, d):
    """How close a member's return type comes to the type of one of its parameters."""
    p = cur(s, d, "parameters", "returns").select("id", F.explode("parameters").alias("p"), "returns")
    return p.groupBy("id").agg(F.max(F.round(jaccard(type_tokens(F.col("p.type")), type_tokens(F.col("returns.type"))), 6)).alias("best"))


_HINTED = "SELECT c.id, p.name, coalesce(nullif(trim(p.default, ' '), ''), '?') AS v FROM (SELECT id, unnest(parameters) AS p FROM cur) c WHERE p.default IS NOT NULL AND p.name IS NOT NULL"


@query(f"WITH {CUR}, x AS ({_HINTED}) SELECT id, name, regexp_replace(regexp_replace(v, '^[ .,;''\"]+|[ .,;''\"]+$', '', 'g'), '^$', '') AS documented_default FROM x WHERE regexp_replace(v, '^[ .,;''\"]+|[ .,;''\"]+$', '', 'g') <> '' AND NOT contains(v, ' ') AND NOT contains(v, ')') AND NOT contains(v, ',')")
def documented_defaults(s, d):
    """Defaults read back from descriptions that tell them as "Default: x"."""
    p = cur(s, d, "parameters").select("id", F.explode("parameters").alias("p")).where("p.default is not null and p.name is not null")
    said = p.select("id", "p.name", F.concat(F.lit("What it does. Default: "), F.coalesce(F.nullif(F.trim("p.default"), F.lit("")), F.lit("?"))).alias("text"), F.col("p.default").alias("v"))
    found = said.where("not contains(v, ' ') and not contains(v, ')') and not contains(v, ',')")
    return found.select("id", "name", default_hint("text").alias("documented_default")).where("documented_default is not null")


@query(f"WITH {CUR} SELECT id, round(greatest(0.0, least(0.15, (length(source_code) - 500) / 14500.0 * 0.15)), 6)::DOUBLE AS penalty FROM cur WHERE source_code IS NOT NULL")
def length_penalties(s, d):
    return cur(s, d, "source_code").where("source_code is not null").select("id", X.length_penalty(F.length("source_code")).alias("penalty"))


@query(None)
def grounding(s, d):
    """Is what is stored about inherited members grounded in the original's docstring?"""
    c = cur(s, d, "docstring").select(F.col("id").alias("original_member_id"), F.col("docstring").alias("source"))
    i = inh(s, d, "original_member_id", "doc_description").where("doc_description is not null and original_member_id is not null").join(c, "original_member_id", "left")
    return fidelity.grounding(i.select("id", F.col("doc_description").alias("doc"), "source"))


@query(None)
def omitted_units(s, d):
    """What the docstrings of originals say and the stored descriptions of inherited members leave out."""
    c = cur(s, d, "docstring").select(F.col("id").alias("original_member_id"), F.col("docstring").alias("source"))
    i = inh(s, d, "original_member_id", "doc_description").where("doc_description is not null and original_member_id is not null").join(c, "original_member_id")
    return fidelity.omissions(i.select("id", F.col("doc_description").alias("doc"), "source"))


@query(None)
def signature_drift(s, d):
    """How far stored signatures, whatever variant they give, are from those of the original."""
    from spanwright.operators.evaluation import with_drift
    from spanwright.plans.evaluating import inherited_documents

    return with_drift(inherited_documents(s, d).where("has_truth")).where("drift is not null").select("id", F.round("drift", 6).alias("drift"))


@query(f"WITH {_DEPS}, d AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM deps UNION ALL SELECT dst FROM deps) GROUP BY 1) SELECT node, round(k / (SELECT sum(k) FROM d), 9)::DOUBLE AS importance FROM d")
def node_importance(s, d):
    """Degree over the sum of degrees."""
    deg = graph.degrees(module_dependencies(s, d))
    total = deg.agg(F.sum("degree").alias("all"))
    return deg.crossJoin(F.broadcast(total)).select("node", F.round(F.col("degree") / F.col("all"), 9).alias("importance"))  # one row


QUERIES, ORACLES = query.queries, query.oracles
