"""Queries that load the analysis results, and that match documentation to members."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import ingest as N
from spanwright.plans.catalogue import cur, exps, inh
from spanwright.plans.hierarchies import shredded
from spanwright.plans.linking import _EXPS2, _FACE, _IMPS
from spanwright.plans.registry import CUR, EXPS, INH, Registry
from spanwright.runtime import table, written

query = Registry()


def _rows(s, d):
    """Shredded rows, and the module of each record."""
    names = table(s, d, "analysis_results").where("module_name is not null").groupBy(F.col("result_id").alias("record_id")).agg(F.max("module_name").alias("module"))
    return written(shredded(s, d), "shredded"), names


@query(f"WITH {_FACE}, n AS (SELECT result_id, any_value(module_name) AS module FROM analysis_results WHERE module_name IS NOT NULL GROUP BY 1), x AS (SELECT n.module AS name, n.result_id, coalesce(f.is_init, false) AS is_package, coalesce(f.has_all, false) AS has_all FROM n LEFT JOIN face f ON f.result_id = n.result_id) SELECT name, arg_min(is_package, result_id) AS is_package, arg_min(has_all, result_id) AS has_all FROM x GROUP BY 1")
def ingested_modules(s, d):
    """One module per name, that of the first file."""
    return N.modules(*_rows(s, d)).select("name", "is_package", "has_all")


@query(None)
def ingested_members(s, d):
    """Members of all files by full name, linked to their parents."""
    return N.members(*_rows(s, d)).drop("docstring")


@query(None)
def ingested_signatures(s, d):
    return N.signatures(_rows(s, d)[0])


@query(f"WITH {_EXPS2} SELECT exported_name, is_explicit, count(*) AS n FROM (SELECT module, x->>'exported_name' AS exported_name, coalesce((x->>'is_explicit')::BOOLEAN, false) AS is_explicit FROM xr WHERE json_type(x) = 'OBJECT') WHERE exported_name <> '' GROUP BY 1, 2")
def ingested_exports(s, d):
    """Named export records per name."""
    rows, names = _rows(s, d)
    return N.exports(rows, names, N.members(rows, names)).groupBy("exported_name", "is_explicit").agg(F.count("*").alias("n"))


@query(f"WITH {_IMPS} SELECT spec AS raw_module_specifier, level, count(*) AS n FROM r1 GROUP BY 1, 2")
def ingested_imports(s, d):
    return N.imports(*_rows(s, d)).groupBy("raw_module_specifier", "level").agg(F.count("*").alias("n"))


@query(None)
def ingested_inherited(s, d):
    """Inherited methods by class and name."""
    rows, names = _rows(s, d)
    return N.inherited(rows, N.members(rows, names))


_DOCS = "dc AS (SELECT DISTINCT seq, name, url FROM (SELECT scrape_id AS seq, member_fqn AS name, url FROM scraped_docs UNION ALL SELECT id, original_fqn, doc_description FROM inh UNION ALL SELECT id, inherited_api_name, doc_description FROM inh) WHERE name IS NOT NULL)"
_TIERS = "nm AS (SELECT fully_qualified_name AS name, id, 0 AS tier FROM cur WHERE fully_qualified_name IS NOT NULL UNION ALL SELECT primary_api_name, id, 1 FROM cur WHERE primary_api_name IS NOT NULL UNION ALL SELECT unnest(all_api_names), id, 2 FROM cur), bs AS (SELECT name, arg_min(id, (tier, id)) AS member_id, min(tier) AS tier FROM nm WHERE name IS NOT NULL GROUP BY 1)"


def _documents(s, d):
    """(seq, name, doc_path): pages by what they are about, and stored descriptions by both names of inherited members."""
    i = inh(s, d, "original_fqn", "inherited_api_name", "doc_description")
    pages = table(s, d, "scraped_docs").select(F.col("scrape_id").alias("seq"), F.col("member_fqn").alias("name"), F.col("url").alias("doc_path"))
    return pages.union(i.select("id", "original_fqn", "doc_description")).union(i.select("id", "inherited_api_name", "doc_description")).where("name is not null").distinct()


def _known(s, d):
    return cur(s, d, "fully_qualified_name", "primary_api_name", "all_api_names").withColumn("doc_path", F.lit(None).cast("string"))


@query(f"WITH {CUR}, {INH}, {_DOCS}, {_TIERS} SELECT seq, name, member_id, tier::INT AS tier FROM dc LEFT JOIN bs USING (name)")
def matched_documents(s, d):
    """The member each page documents, by full name, primary name or any public name."""
    return N.matched_documents(_documents(s, d).drop("doc_path"), _known(s, d)).select("seq", "name", "member_id", "tier")


@query(f"WITH {CUR}, {INH}, {_DOCS}, {_TIERS}, p AS (SELECT member_id AS id, arg_max(url, (seq, url)) AS doc_path FROM dc JOIN bs USING (name) WHERE url IS NOT NULL GROUP BY 1) SELECT id, doc_path FROM p")
def documented_paths(s, d):
    """Members that a page was found for, with the last page's address."""
    return N.ingest_documents(_documents(s, d), _known(s, d), ["doc_path"])[0].where("doc_path is not null").select("id", "doc_path")


@query(f"WITH {CUR}, {INH}, {_DOCS}, {_TIERS} SELECT count(member_id) AS updated, count_if(member_id IS NULL) AS not_found FROM dc LEFT JOIN bs USING (name)")
def document_match_counts(s, d):
    return N.ingest_documents(_documents(s, d), _known(s, d), ["doc_path"])[1]


@query(f"WITH {CUR}, {INH}, dc AS (SELECT inherited_api_name AS name, max(doc_description) AS text FROM inh WHERE inherited_api_name IS NOT NULL AND doc_description IS NOT NULL GROUP BY 1), nm AS (SELECT name, min(id) AS id FROM (SELECT inherited_api_name AS name, id FROM inh UNION ALL SELECT unnest(inherited_api_names), id FROM inh) WHERE name IS NOT NULL GROUP BY 1), j AS (SELECT i.id, i.original_member_id AS o, dc.text, c.id IS NOT NULL AS known, coalesce(c.docstring IS NOT NULL AND trim(c.docstring) <> '' AND upper(trim(c.docstring)) NOT IN ('N/A', 'NA', 'NONE', 'NULL', 'TBD'), false) AS documented FROM dc JOIN nm USING (name) JOIN inh i ON i.id = nm.id LEFT JOIN cur c ON c.id = i.original_member_id) SELECT id, max(text) AS doc, 'stored' AS source FROM j WHERE o IS NULL GROUP BY 1 UNION ALL SELECT o, max(text), 'original' FROM j WHERE known AND NOT documented GROUP BY 1")
def inherited_doc_updates(s, d):
    """Documentation of inherited members goes to originals that have none, or stays with external ones."""
    i = inh(s, d, "inherited_api_name", "inherited_api_names", "original_member_id", "doc_description")
    docs = i.where("inherited_api_name is not null and doc_description is not null").select(F.col("inherited_api_name").alias("name"), F.col("doc_description").alias("text"))
    return N.inherited_updates(docs, i, cur(s, d, "docstring"))


@query("SELECT split_part(url, '#', 1) AS container, array_to_string(list_sort(list(DISTINCT member_fqn)), '|') AS names FROM scraped_docs WHERE member_fqn IS NOT NULL AND url IS NOT NULL GROUP BY 1")
def container_names(s, d):
    """The members that each page holds."""
    p = table(s, d, "scraped_docs").select(F.split_part("url", F.lit("#"), F.lit(1)).alias("container"), F.col("member_fqn").alias("name"))
    return N.container_names(p).select("container", F.array_join("names", "|").alias("names"))


_BAD = "NOT regexp_matches(coalesce({0}, ''), '^[\\pL_][\\pL\\pN_]*$')"


@query(f"WITH {CUR}, {EXPS}, {_IMPS}, f AS (SELECT 'duplicate_name' AS rule, fully_qualified_name AS subject FROM cur GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'bad_member_name', fully_qualified_name FROM cur WHERE {_BAD.format('name')} UNION ALL SELECT 'bad_kind', fully_qualified_name FROM cur WHERE member_type NOT IN ('class', 'function', 'method', 'variable') UNION ALL SELECT 'lines_reversed', fully_qualified_name FROM cur WHERE source_end_line < source_start_line UNION ALL SELECT 'bad_export_name', exported_name FROM exps WHERE {_BAD.format('exported_name')} UNION ALL SELECT 'reexport_without_target', exported_name FROM exps WHERE is_reexport AND target_member_id IS NULL UNION ALL SELECT 'bad_level', spec FROM imps WHERE level < 0) SELECT rule, subject, count(*) AS n FROM f GROUP BY 1, 2")
def semantic_issues(s, d):
    """What breaks the rules of the records."""
    from spanwright.plans.linking import import_rows

    m = cur(s, d, "fully_qualified_name", "name", "member_type", "source_start_line", "source_end_line")
    return N.semantic_issues(m, exps(s, d, "exported_name", "is_reexport", "target_member_id"), import_rows(s, d).withColumnRenamed("spec", "raw_module_specifier"))


QUERIES, ORACLES = query.queries, query.oracles
