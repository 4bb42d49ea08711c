"""Queries of the small text helpers, caches and change handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as X
from spanwright.functions import types as T
from spanwright.functions import urls as U
from spanwright.functions.columns import coalesce_text, first_present
from spanwright.operators import catalog as C
from spanwright.operators import docview as V
from spanwright.operators import evaluation as E
from spanwright.operators import extraction as N
from spanwright.operators import maintenance as M
from spanwright.operators import registry as R
from spanwright.plans.catalogue import _DEPS, _NAMES, _all_names, cur, inh, mods, module_dependencies, wanted_names
from spanwright.plans.evaluating import _VIEW, inherited_documents
from spanwright.plans.registry import CUR, INH, MODS, PRESENT, Registry
from spanwright.plans.relations import _SRC, src
from spanwright.runtime import table
from spanwright.sources import files as S
from spanwright.streaming.debounce import invalidated

query = Registry()
_L = "l AS (SELECT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS t FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_L} SELECT starts_with(t, '>>>') OR starts_with(t, '...') OR regexp_matches(t, '^[-*•►▪]\\s+\\w') OR (contains(t, '=') AND (NOT contains(t, '(') OR strpos(t, '=') < strpos(t, '('))) AS code, count(*) AS n FROM l GROUP BY 1")
def code_like_lines(s, d):
    """How many lines of documents look like code or list entries."""
    t = table(s, d, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("t")).select(F.regexp_replace("t", r"^[ \t\r]+|[ \t\r]+$", "").alias("t"))
    return t.groupBy(N.looks_like_code(F.col("t")).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(trim(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\(#page=[0-9]+\\)', '', 'g'), '\\(https?://[^)]*\\)', '', 'g'), '\\(PEP ?3102[^)]*\\)', '', 'g'), '¶', ''), ' ')) AS digest FROM documents")
def texts_without_noise(s, d):
    """Documents without page references, bracketed addresses and pilcrows."""
    return table(s, d, "documents").select("doc_id", F.md5(X.strip_noise_tokens("text")).alias("digest"))


@query(f"WITH {CUR}, c AS (SELECT id, name, member_type, regexp_replace(coalesce(name, ''), '[^A-Za-z0-9_.-]', '_', 'g') AS safe FROM cur), sh AS (SELECT lower(name) AS k FROM cur WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1) SELECT c.id, CASE WHEN sh.k IS NOT NULL THEN safe || '-' || member_type ELSE safe END AS stem, safe AS name FROM c LEFT JOIN sh ON sh.k = lower(c.name)")
def artifact_stems(s, d):
    """File stems of members, with their kind where names differ in case only; and the name read back."""
    c = cur(s, d, "name", "member_type")
    shared = c.where("name is not null").groupBy(F.lower("name").alias("k")).agg(F.count_distinct("name").alias("n")).where("n > 1").select("k", F.lit(True).alias("shared"))
    j = c.withColumn("k", F.lower("name")).join(shared, "k", "left").withColumn("stem", X.artifact_stem("name", "member_type", F.coalesce("shared", F.lit(False))))
    return j.select("id", "stem", X.stem_parts("stem")["name"].alias("name"))


@query(f"WITH {CUR} SELECT id, CASE WHEN {PRESENT.format('docstring')} THEN docstring WHEN {PRESENT.format('primary_api_name')} THEN primary_api_name ELSE fully_qualified_name END AS told, coalesce(docstring, '') AS text FROM cur")
def first_present_texts(s, d):
    """The first of docstring, public name and full name that says something; docstrings with '' for null."""
    return cur(s, d, "docstring", "primary_api_name", "fully_qualified_name").select("id", F.coalesce(first_present("docstring", "primary_api_name"), "fully_qualified_name").alias("told"), coalesce_text("docstring").alias("text"))


@query(f"WITH {INH} SELECT id, regexp_matches(s, '\\(\\s*[^)\\s]') AS has_params, regexp_matches(s, '\\(\\s*((self|cls)\\s*)?\\)') AS no_user_params, regexp_matches(s, '[\\x00-\\x08]') AS control FROM (SELECT id, coalesce(signature, '') AS s FROM inh)")
def signature_flags(s, d):
    x = inh(s, d, "signature")
    return x.select("id", X.signature_has_params("signature").alias("has_params"), X.no_user_params("signature").alias("no_user_params"), F.coalesce("signature", F.lit("")).rlike(r"[\x00-\x08]").alias("control"))


@query(f"WITH {CUR}, p AS (SELECT id, unnest(parameters) AS p FROM cur), q AS (SELECT id, p.default AS a, CASE p.default WHEN '0' THEN '0.0' WHEN 'True' THEN 'true' WHEN '''auto''' THEN 'auto' ELSE 'x' END AS b FROM p WHERE p.default IS NOT NULL) SELECT a, b, count(*) AS n, a IN ('0', 'True', '''auto''') AS same FROM q GROUP BY 1, 2, 4")
def matching_defaults(s, d):
    """Defaults against other spellings of them: numbers, case and quotes do not matter."""
    a = cur(s, d, "parameters").select(F.explode("parameters").alias("p")).select(F.col("p.default").alias("a")).where("a is not null")
    b = a.withColumn("b", F.when(F.col("a") == "0", "0.0").when(F.col("a") == "True", "true").when(F.col("a") == "'auto'", "auto").otherwise("x"))
    return b.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("same", E.same_default(F.col("a"), F.col("b")))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' WHEN json_valid(text) AND regexp_matches(text, '^\\s*[{\\[]') THEN NULL ELSE 'no_json' END AS reason FROM documents")
def retry_reasons(s, d):
    """Documents taken for generated payloads: why each would be asked for again."""
    return table(s, d, "documents").select("doc_id", X.retry_reason("text", F.lit("stop")).alias("reason"))


@query("SELECT result_id, bool_or(coalesce(json_valid(components), false)) AS readable FROM analysis_results GROUP BY 1")
def readable_json(s, d):
    """Which components cells can be read, a fence around them or control characters within allowed for."""
    fenced = F.concat(F.lit("```json\n"), F.col("components"), F.lit("\n```"))
    x = table(s, d, "analysis_results").select("result_id", fenced.alias("c"))
    return x.groupBy("result_id").agg(F.bool_or(F.coalesce(X.tolerant_json("c").isNotNull(), F.lit(False))).alias("readable"))


@query(f"WITH {_SRC}, k AS (SELECT file_id, library, sha256(coalesce(library, '') || chr(1) || coalesce(content, '')) AS cache_key FROM src), c AS (SELECT cache_key FROM k WHERE library = (SELECT min(library) FROM libraries)) SELECT file_id FROM k WHERE cache_key NOT IN (SELECT cache_key FROM c)")
def uncached_files(s, d):
    """Files that a cache of the first library's contents does not hold."""
    k = src(s, d, "library", "content").select("file_id", "library", S.cache_key("library", "content").alias("cache_key"))
    first = table(s, d, "libraries").agg(F.min("library").alias("library"))
    return S.not_cached(k, k.join(F.broadcast(first), "library", "left_semi")).select("file_id")  # one row


@query(f"WITH {_SRC}, q AS (SELECT file_id, library, replace(regexp_replace(file_path, '^(\\./)+', ''), chr(92), '/') AS p FROM src), x AS (SELECT DISTINCT file_id FROM q JOIN (SELECT DISTINCT * FROM exclude_patterns) e USING (library) WHERE CASE WHEN pattern_kind = 'dir' THEN contains('/' || p, '/' || pattern) ELSE regexp_matches(string_split(p, '/')[-1], '^' || replace(replace(pattern, '.', '\\.'), '*', '.*') || '$') END) SELECT file_id FROM q WHERE ends_with(lower(p), '.py') AND file_id NOT IN (SELECT file_id FROM x)")
def watched_files(s, d):
    """Files whose changes matter: Python sources that no pattern leaves out."""
    files = src(s, d, "library", "file_path")
    gone = S.excluded(files, table(s, d, "exclude_patterns")).select("file_id")
    return files.where(F.lower("file_path").endswith(".py")).join(gone, "file_id", "left_anti").select("file_id")


@query(f"WITH RECURSIVE {_DEPS}, {MODS}, f AS (SELECT min(id) AS node FROM mods GROUP BY library), r AS (SELECT node FROM f UNION SELECT e.src FROM r JOIN deps e ON e.dst = r.node) SELECT node FROM r")
def invalidated_modules(s, d):
    """What a change of the first module of every library makes stale, at any distance."""
    changed = mods(s, d, "library").groupBy("library").agg(F.min("id").alias("node"))
    return invalidated(changed, module_dependencies(s, d))


@query(f"WITH {CUR} SELECT library, count(*) AS n, count_if(lower(name) = name) AS lower_case FROM cur WHERE name IS NOT NULL GROUP BY 1")
def name_cases(s, d):
    """How many names of each library are spelt in lower case alone."""
    c = cur(s, d, "library", "name").where("name is not null")
    return c.groupBy("library").agg(F.count("*").alias("n"), F.count_if(F.lower("name") == F.col("name")).alias("lower_case"))


@query("SELECT scrape_id, page_kind, regexp_replace(string_split(split_part(url, '#', 1), '/')[-1], '\\.html?$', '') AS stem, len(list_filter(string_split_regex(lower(regexp_replace(string_split(split_part(url, '#', 1), '/')[-1], '\\.html?$', '')), '[._]'), lambda x: x <> ''))::INT AS n_parts FROM (SELECT DISTINCT scrape_id, page_kind, url FROM scraped_docs WHERE url IS NOT NULL)")
def page_stems(s, d):
    """Names of pages and how many parts they have."""
    u = table(s, d, "scraped_docs").where("url is not null").select("scrape_id", "page_kind", "url").distinct()
    return u.select("scrape_id", "page_kind", U.page_stem("url").alias("stem"), F.size(U.module_parts("url")).alias("n_parts"))


@query(f"WITH {CUR}, t AS (SELECT id, {T.normalize_sql('returns.type')} AS norm, member_type, coalesce(returns.type, '') AS r FROM cur) SELECT id, member_type IN ('function', 'method') AND (trim(r, ' ') = '' OR upper(trim(r, ' ')) IN ('N/A', 'NA', 'NONE', 'NULL', 'TBD')) AS void FROM t")
def void_callables(s, d):
    """Functions and methods that return nothing."""
    from spanwright.operators.docview import void

    return cur(s, d, "member_type", "returns").select("id", F.col("member_type").alias("t_type"), F.col("returns.type").alias("t_returns")).select("id", F.coalesce(void(), F.lit(False)).alias("void"))


@query("SELECT s.library, count(*) AS n, 'python-' || s.library AS second_name FROM (SELECT DISTINCT library, file_id FROM source_files WHERE library IS NOT NULL AND NOT contains(library, '_') AND NOT starts_with(library, 'sk')) s GROUP BY 1")
def library_distributions(s, d):
    """Libraries with sources, and the second likeliest name each is distributed under."""
    n = table(s, d, "source_files").where("library is not null and not contains(library, '_') and not startswith(library, 'sk')").select("library", "file_id").distinct().groupBy("library").agg(F.count("*").alias("n"))
    return n.select("library", "n", R.distribution_names("library")[1].alias("second_name"))


@query(f"WITH {_SRC}, t AS (SELECT library, file_id, regexp_extract(content, '(?m)^name\\s*=\\s*\"([^\"]+)\"', 1) AS name, regexp_extract(content, '(?m)^version\\s*=\\s*\"([^\"]+)\"', 1) AS version, CASE WHEN ends_with(lower(file_path), 'pyproject.toml') THEN 0 ELSE 1 END AS tier FROM src WHERE content IS NOT NULL AND ends_with(lower(file_path), '.toml')) SELECT library, arg_min(name, (tier, file_id)) AS name, arg_min(version, (tier, file_id)) AS version, count(*) AS n FROM t WHERE library IS NOT NULL AND name <> '' AND version <> '' GROUP BY 1")
def project_metadata(s, d):
    """Name and version that each library's packaging files give: the project file's before other tables', the least file of equals."""
    t = src(s, d, "library", "file_path", "content").where("content is not null and library is not null and endswith(lower(file_path), '.toml')")
    return S.project_metadata(t)


@query(f"WITH {CUR}, {INH}, own AS (SELECT primary_api_name AS name, id, 0 AS tier FROM cur WHERE primary_api_name IS NOT NULL UNION ALL SELECT unnest(all_api_names), id, 1 FROM cur UNION ALL SELECT fully_qualified_name, id, 3 FROM cur WHERE fully_qualified_name IS NOT NULL), al AS (SELECT name, 'member' AS kind, id, tier FROM own UNION ALL SELECT inherited_api_name, 'inherited', id, 9 FROM inh), b AS (SELECT name, arg_min(kind || ':' || id, (tier, id, kind)) AS key FROM al WHERE name IS NOT NULL GROUP BY 1), w AS (SELECT DISTINCT name FROM (SELECT member_fqn AS name FROM scraped_docs UNION ALL SELECT original_fqn FROM inh UNION ALL SELECT inherited_api_name FROM inh) WHERE name IS NOT NULL) SELECT w.name, b.key FROM w LEFT JOIN b USING (name)")
def member_keys(s, d):
    """One key per wanted name: member:id, else inherited:id, else null."""
    own = C.own_names(cur(s, d, "primary_api_name", "all_api_names", "fully_qualified_name"))
    found = M.find_rows(wanted_names(s, d), own, inh(s, d, "inherited_api_name").select(F.col("inherited_api_name").alias("name"), "id"))
    return found.select("name", F.when(F.col("id").isNotNull(), F.concat_ws(":", "kind", "id")).alias("key"))


@query(f"WITH {CUR}, {INH}, {_NAMES}, w AS (SELECT DISTINCT name FROM (SELECT member_fqn AS name FROM scraped_docs UNION ALL SELECT original_fqn FROM inh UNION ALL SELECT inherited_api_name FROM inh) WHERE name IS NOT NULL) SELECT count(*) AS n_names, count(tier) AS n_matched, round(count(tier) / count(*), 6)::DOUBLE AS accuracy FROM w LEFT JOIN best USING (name)")
def resolution_accuracy(s, d):
    """The share of wanted names that stand for something known."""
    found = C.resolve(wanted_names(s, d), _all_names(s, d))
    return found.agg(F.count("*").alias("n_names"), F.count("tier").alias("n_matched"), F.round(F.coalesce(F.try_divide(F.count("tier").cast("double"), F.count("*")), F.lit(0.0)), 6).alias("accuracy"))


@query(f"WITH {_VIEW} SELECT id, 'module_member_description' AS label, purpose AS text FROM dv WHERE {PRESENT.format('purpose')} UNION ALL SELECT id, 'parameters[' || p.name || '].description', p.description FROM (SELECT id, unnest(params) AS p FROM dv) WHERE {PRESENT.format('p.description')}")
def document_sections(s, d):
    """The prose of inherited members' documentation, section by section."""
    return inherited_documents(s, d).select("id", F.inline(V.sections())).select("id", "label", "text")


@query(f"WITH {_VIEW} SELECT id FROM dv WHERE NOT coalesce({PRESENT.format('purpose')}, false) AND NOT coalesce({PRESENT.format('signature')}, false)")
def empty_documents(s, d):
    """Inherited members whose documentation says nothing at all."""
    return inherited_documents(s, d).where(V.is_empty()).select("id")


@query(f"WITH {_VIEW} SELECT section, count(*) AS n FROM (SELECT 'module_member_description' AS section FROM dv WHERE {PRESENT.format('purpose')} UNION ALL SELECT 'parameters' FROM (SELECT unnest(params) AS p FROM dv) WHERE {PRESENT.format('p.description')}) GROUP BY 1")
def section_groups(s, d):
    """Sections of documentation by what stands before the first bracket or dot of their label."""
    labels = inherited_documents(s, d).select(F.inline(V.sections()))
    return labels.groupBy(F.regexp_extract("label", r"^([^\[.]*)", 1).alias("section")).agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
