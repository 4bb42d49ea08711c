"""Queries that look for members in documents and pages, and that clean and split texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as X
from spanwright.functions import urls as U
from spanwright.operators import extraction as E
from spanwright.operators import sections as S
from spanwright.plans.catalogue import cur, inh
from spanwright.plans.registry import CUR, INH, Registry
from spanwright.runtime import table, written

query = Registry()

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), lt AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l)"
_CTX = """CASE WHEN regexp_matches(t, '^[-*•►▪]\\s+\\w') THEN -30 ELSE CASE WHEN regexp_matches(t, '(?i)^(class|property)\\s+\\w') THEN 20 WHEN regexp_matches(t, '(?i)^(method|function|attribute)\\s+\\w') THEN 15 WHEN regexp_matches(t, '(?i)^(classmethod|staticmethod)\\s+\\w') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(t, '\\(https?://[^\\s)]+\\)\\s*$') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(t, '\\)\\s*->\\s*\\w') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(t, '\\(#page=[0-9]+\\)\\s*$') THEN -25 ELSE 0 END END"""


def documents(s, d):
    return table(s, d, "documents")


def class_needles(s, d):
    """Needles of the classes: (id, member_type, short, tier, place, needle, needle_norm), by public or full name."""
    c = cur(s, d, "name", "member_type", "primary_api_name", "fully_qualified_name", "parameters").where("member_type = 'class' and name is not null")
    sig = F.concat("name", F.lit("("), F.array_join(F.transform(F.coalesce("parameters", F.array()), lambda p: p["name"]), ", "), F.lit(")"))
    return E.needles(c.select("id", F.coalesce("primary_api_name", "fully_qualified_name").alias("api_name"), "member_type", F.create_map(F.lit("full"), sig).alias("variants")).where("api_name is not null"))


@query(f"WITH {_LINES} SELECT ({_CTX})::INT AS score, count(*) AS n FROM lt GROUP BY 1")
def line_context_scores(s, d):
    """How lines look as definitions, by what surrounds a name."""
    l = documents(s, d).where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    return l.groupBy(E.context_score(F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "")).cast("int").alias("score")).agg(F.count("*").alias("n"))


@query(f"WITH {CUR} SELECT id, fully_qualified_name AS fqn, CASE WHEN starts_with(f, '_') THEN 'private_api' WHEN len(list_filter(p, lambda x: starts_with(x, '_'))) > 0 THEN 'internal_module' WHEN len(list_intersect(p, ['test', 'tests', 'testing'])) > 0 THEN 'test_code' WHEN len(list_intersect(p, ['example', 'examples', 'demo'])) > 0 THEN 'example_code' WHEN (upper(p[-1]) = p[-1] AND regexp_matches(p[-1], '\\p{{Lu}}')) OR starts_with(p[-1], 'TYPE_') THEN 'type_alias_or_constant' ELSE 'unknown' END AS cause FROM (SELECT *, coalesce(fully_qualified_name, '') AS f, string_split(coalesce(fully_qualified_name, ''), '.') AS p FROM cur)")
def failure_causes(s, d):
    return cur(s, d, "fully_qualified_name").select("id", F.col("fully_qualified_name").alias("fqn"), X.failure_cause("fully_qualified_name").alias("cause"))


@query(f"WITH {CUR}, m AS (SELECT id, coalesce(primary_api_name, fully_qualified_name) AS api, string_split(coalesce(primary_api_name, fully_qualified_name), '.')[-1] AS short, array_to_string(list_transform(coalesce(parameters, []), lambda p: p.name), ', ') AS ps FROM cur WHERE member_type = 'class' AND name IS NOT NULL AND coalesce(primary_api_name, fully_qualified_name) IS NOT NULL), k AS (SELECT id, unnest(list_distinct(CASE WHEN ps = '' THEN ['class ' || api, 'class ' || short] ELSE [] END || ['class ' || api || '(' || ps || ')', api || '(' || ps || ')', 'class ' || short || '(' || ps || ')', short || '(' || ps || ')'])) AS needle, 'exact' AS tier FROM m UNION ALL SELECT id, unnest(list_distinct(CASE WHEN ps IN ('', 'self') THEN [short, api] ELSE [api] END)), 'anchor' FROM m) SELECT id, tier, count(*) AS n, min(needle) AS first FROM k GROUP BY 1, 2")
def lexical_needles(s, d):
    """What to look for of each class: exact spellings of its signature, and names."""
    return class_needles(s, d).groupBy("id", "tier").agg(F.count("*").alias("n"), F.min("needle").alias("first"))


def _matches(s, d):
    lines = E.text_lines(documents(s, d))
    names = cur(s, d, "name", "member_type").where("member_type = 'class' and name is not null").groupBy("name").agg(F.min("id").alias("id"))
    found = E.needles(names.select("id", F.col("name").alias("api_name"), F.lit("variable").alias("member_type"), F.lit(None).cast("map<string,string>").alias("variants")))
    return E.line_matches(lines, found)


@query(None)
def best_definition_line(s, d):
    """The line that looks most like the definition of each class name a document holds."""
    return E.best_lines(_matches(s, d)).select("doc_id", "id", "line_no", "score", "tier")


@query(None)
def section_match_scores(s, d):
    """How well documents match the class names they hold: the line, further mentions, the title, mere references."""
    names = cur(s, d, "name", "member_type").where("member_type = 'class' and name is not null").groupBy("name").agg(F.min("id").alias("id"))
    found = E.needles(names.select("id", F.col("name").alias("api_name"), F.lit("variable").alias("member_type"), F.lit(None).cast("map<string,string>").alias("variants")))
    return E.section_scores(documents(s, d), E.best_lines(_matches(s, d)), found).select("doc_id", "id", "score")


@query("SELECT doc_id, NOT (regexp_matches(text, '(?im)^(?:class\\s+)?\\Q' || t || '\\E\\s*\\(') OR regexp_matches(text, '(?im)^\\s*\\Q' || t || '\\E\\s*\\(')) AND (regexp_matches(text, '(?i)see\\s+\\Q' || t || '\\E\\b') OR regexp_matches(text, '(?i)\\Q' || t || '\\E\\s+on\\s+page\\s+[0-9]+')) AS reference_only FROM (SELECT doc_id, text, regexp_extract(text, '([A-Z][a-z]+[A-Z][A-Za-z]+)', 1) AS t FROM documents WHERE text IS NOT NULL) WHERE t <> ''")
def reference_only(s, d):
    """Is the first class name of a document only referred to there?"""
    x = documents(s, d).where("text is not null").withColumn("t", F.regexp_extract("text", r"([A-Z][a-z]+[A-Z][A-Za-z]+)", 1)).where("t <> ''")
    return x.select("doc_id", E.reference_only(F.col("text"), F.col("t")).alias("reference_only"))


@query(None)
def text_windows(s, d):
    """Overlapping windows over whole lines."""
    return E.windows(documents(s, d))


@query(None)
def member_spans(s, d):
    """What each document says of each class name: from its line to before the next one's."""
    best = written(E.best_lines(_matches(s, d)).where("score > 1"), "anchors")
    return E.spans(best, E.text_lines(documents(s, d)))


@query(f"WITH {CUR}, y AS (SELECT a.id, CASE WHEN a.member_type = 'class' THEN CASE WHEN regexp_matches(b.name, '^[A-Z]') OR (bp.name IS NOT NULL AND regexp_matches(b.name, '^[a-z_]')) THEN 'primary' ELSE 'fallback' END WHEN regexp_matches(b.name, '^[A-Z]') THEN 'fallback' WHEN regexp_matches(b.name, '^[a-z_]') AND (p.name IS NULL OR bp.name IS NULL OR bp.name = p.name) THEN 'primary' WHEN regexp_matches(b.name, '^[a-z_]') AND regexp_matches(bp.name, '^[A-Z]') THEN 'never' ELSE 'fallback' END AS kind FROM cur a LEFT JOIN cur p ON p.id = a.parent_id JOIN (SELECT module_id, arg_min(id, (source_start_line, id)) AS first FROM cur WHERE name IS NOT NULL AND source_start_line IS NOT NULL GROUP BY 1) f ON f.module_id = a.module_id JOIN cur b ON b.id = f.first LEFT JOIN cur bp ON bp.id = b.parent_id WHERE a.member_type IN ('class', 'method') AND a.id <> b.id) SELECT * FROM y")
def peer_kinds(s, d):
    """Does the first member of a module stop the text of its classes and methods: at once, in default of others, or never?"""
    c = cur(s, d, "name", "member_type", "parent_id", "module_id", "source_start_line")
    owner = c.select(F.col("id").alias("parent_id"), F.col("name").alias("owner"))
    a = c.where("member_type in ('class', 'method')").join(owner, "parent_id", "left").select("id", "module_id", F.col("member_type").alias("t"), "owner")
    first = c.where("name is not null and source_start_line is not null").groupBy("module_id").agg(F.min_by(F.struct("id", "name", "parent_id"), F.struct("source_start_line", "id")).alias("f")).select("module_id", F.col("f.id").alias("pid"), "f.name", "f.parent_id")
    peers = first.join(owner.withColumnRenamed("owner", "po"), "parent_id", "left").select("module_id", "pid", F.concat_ws(".", "po", "name").alias("peer"))
    return a.join(peers, "module_id").where("pid <> id").select("id", E.peer_kind(F.col("t"), F.col("owner"), F.col("peer")).alias("kind"))


@query("WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT q.vec_id AS query_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM q, embeddings e WHERE q.vec_id <> e.vec_id), g AS (SELECT query_id, avg(s) AS m, stddev_pop(s) + 1e-6 AS d, list_sort(list(s), 'DESC')[1:2] AS t FROM x GROUP BY 1) SELECT query_id, round(m - 0.25 * d, 6)::DOUBLE AS threshold, NOT (t[1] >= m + 0.25 * d AND t[1] - t[2] >= 0.2 * greatest(1e-6, t[1])) AS unsure FROM g")
def score_acceptance(s, d):
    """The least score to take of every twentieth vector's neighbours, and whether the best one stands out."""
    v = table(s, d, "embeddings")
    return E.acceptance(E.score_profile(v, v.where("vec_id % 20 = 0"))).withColumn("threshold", F.round("threshold", 6))


@query(None)
def similar_names(s, d):
    """The three known names most like the name of every twentieth page that is about a member."""
    wanted = table(s, d, "scraped_docs").where("scrape_id % 20 = 0 and member_fqn is not null").select(F.col("member_fqn").alias("name"))
    return E.similar_names(wanted, cur(s, d, "primary_api_name").select(F.col("primary_api_name").alias("name")))


@query(None)
def similar_lines(s, d):
    """The line most like each document's title."""
    x = documents(s, d).where("text is not null and title is not null").select("doc_id", F.col("doc_id").alias("id"), "text", F.col("title").alias("query"), F.col("title").alias("signature"), F.lit("").alias("name"))
    return E.similar_lines(x)


@query(f"WITH {CUR} SELECT id, 'API reference documentation for ' || CASE WHEN member_type = 'method' AND contains(api, '.') THEN 'the ' || short || ' method of ' || string_split(api, '.')[-2] || ' with fully qualified name ' || api ELSE short || ' ' || CASE WHEN member_type IN ('class', 'function', 'method', 'variable') THEN member_type ELSE 'API' END || CASE WHEN contains(api, '.') THEN ' in ' || regexp_replace(api, '\\.[^.]*$', '') || ' with fully qualified name ' || api ELSE '' END END || CASE WHEN length(first) > 10 THEN ' : ' || first ELSE '' END AS q, coalesce(member_type, 'function') || ' with API name ' || api || ' starting ' || CASE WHEN member_type = 'class' THEN 'definition' ELSE 'signature' END || ' line: ' || api || '()' AS sig FROM (SELECT *, string_split(api, '.')[-1] AS short, trim(regexp_extract(ds, '^((?s:.*?))(?:\\.(?:\\s|$)|$)', 1), ' ') AS first FROM (SELECT *, coalesce(primary_api_name, fully_qualified_name) AS api, trim(coalesce(docstring, ''), ' ') AS ds FROM cur)) WHERE api IS NOT NULL")
def semantic_queries(s, d):
    """Texts to look for members by: what they are, and their definition line."""
    c = cur(s, d, "member_type", "primary_api_name", "fully_qualified_name", "docstring").withColumn("api", F.coalesce("primary_api_name", "fully_qualified_name")).where("api is not null")
    none = F.lit(None).cast("string")
    return c.select("id", E.semantic_query(F.col("api"), F.col("member_type"), F.col("docstring"), none).alias("q"), E.signature_query(F.col("api"), F.col("member_type"), none).alias("sig"))


@query(None)
def joined_signatures(s, d):
    """Lines of documents with signatures that run over several lines joined."""
    return E.joined_signatures(E.text_lines(documents(s, d))).where("n_lines > 1")


@query(f"WITH {_LINES} SELECT count_if(regexp_matches(t, '^([-*•►▪]\\s|[0-9]+[.)]\\s|\\([0-9]+\\)\\s|:[a-z_]+:)')) AS list_items, count_if(starts_with(t, '>>>') OR (starts_with(t, '...') AND NOT starts_with(t, '....'))) AS prompts, count_if(starts_with(t, '```')) AS fences, count_if(regexp_matches(t, '^(?:class\\s+)?[A-Za-z_][\\w.]*\\s*\\(') AND NOT (len(regexp_extract_all(t, '\\(')) = len(regexp_extract_all(t, '\\)')) AND regexp_matches(t, '[\\w)]\\s*\\.$') AND NOT (contains(t, '=') AND regexp_matches(t, '[0-9)]\\s*\\.$')) AND NOT regexp_matches(t, '\\w+\\.\\w+\\.$'))) AS signature_starts FROM lt")
def line_kinds(s, d):
    """How many lines of documents are list items, prompts, fences and beginnings of signatures."""
    l = documents(s, d).where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).select(F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("t"))
    t = F.col("t")
    return l.agg(F.count_if(E.list_item(t)).alias("list_items"), F.count_if(t.startswith(">>>") | (t.startswith("...") & ~t.startswith("...."))).alias("prompts"), F.count_if(t.startswith("```")).alias("fences"), F.count_if(E.signature_start(t)).alias("signature_starts"))


# texts with links


@query("WITH m AS (SELECT scrape_id, any_value(scraped_doc) AS t FROM scraped_docs WHERE scraped_doc IS NOT NULL GROUP BY 1) SELECT scrape_id, len(regexp_extract_all(t, '\\((https?://[^)\\s]+|#page=[0-9]+)\\)', 1)) AS n_links, length(regexp_replace(t, '\\((https?://[^)\\s]+|#page=[0-9]+)\\)', '', 'g')) AS n_chars FROM m")
def placeholder_counts(s, d):
    """Links of pages that give way to placeholders, and what else their texts hold."""
    x = table(s, d, "scraped_docs").where("scraped_doc is not null").select("scrape_id", X.with_placeholders("scraped_doc").alias("p")).dropDuplicates(["scrape_id"])
    bare = F.regexp_replace("p.text", r"\(url_placeholder_\d+\)", "")
    return x.select("scrape_id", F.size("p.urls").cast("long").alias("n_links"), F.length(bare).cast("long").alias("n_chars"))


@query("SELECT scrape_id, true AS same FROM scraped_docs WHERE scraped_doc IS NOT NULL GROUP BY 1")
def placeholders_restored(s, d):
    """Does every page come back whole when its placeholders are replaced again?"""
    x = table(s, d, "scraped_docs").where("scraped_doc is not null").select("scrape_id", "scraped_doc", X.with_placeholders("scraped_doc").alias("p"))
    return x.groupBy("scrape_id").agg(F.bool_and(X.restored(F.col("p.text"), F.col("p.urls")) == F.col("scraped_doc")).alias("same"))


_TYPO = "replace(translate(coalesce({0}, ''), '" + "".join(X.PLAIN).replace("'", "''") + "', '" + "".join(X.PLAIN.values()).replace("'", "''") + "'), chr(8230), '...')"


@query(f"WITH m AS (SELECT doc_id, {_TYPO.format('text')} AS a FROM documents), j AS (SELECT doc_id, regexp_replace(regexp_replace(a, '(?i)\\b({X.KEEP_HYPHEN})-\\n[ \\t]*(\\w)', '\\1-\\2', 'g'), '(\\w+)-\\n[ \\t]*(\\w)', '\\1\\2', 'g') AS b FROM m) SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(b, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), ' {{80,}}', ' ', 'g'), '\\t{{20,}}', chr(9), 'g')) AS digest FROM j")
def cleaned_texts(s, d):
    """Documents with plain typography, wrapped words joined and control characters gone."""
    return documents(s, d).select("doc_id", F.md5(X.sanitize(X.joined_words(X.plain_typography("text")))).alias("digest"))


# addresses

_API = "CASE WHEN split_part(url, '#', 2) <> '' THEN replace(split_part(url, '#', 2), '-', '.') ELSE replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://[^/]*/[^/]*', ''), '^/+', ''), '\\.(html?|php|aspx?)$', ''), '^generated[/.]', ''), '^api[/.]', ''), '^reference[/.]', ''), '^_?modules[/.]', ''), '-', '.'), '/', '.') END"


@query(f"WITH u AS (SELECT DISTINCT url FROM scraped_docs WHERE url IS NOT NULL), n AS (SELECT url, {_API} AS n FROM u) SELECT url, nullif(CASE WHEN regexp_matches(n, '^[a-zA-Z_][a-zA-Z0-9_]*(\\.[a-zA-Z_][a-zA-Z0-9_]*)*$') THEN n ELSE array_to_string(list_filter(list_transform(string_split(n, '.'), lambda x: regexp_replace(x, '[^a-zA-Z0-9_]', '', 'g')), lambda x: regexp_matches(x, '^[a-zA-Z_]')), '.') END, '') AS api_name FROM n")
def url_to_api_name(s, d):
    """The name each page's address stands for, below its version's folder."""
    u = table(s, d, "scraped_docs").where("url is not null").select("url").distinct()
    folder = F.regexp_extract(F.regexp_replace("url", r"^https?://[^/]*", ""), r"^(/[^/#?]*)", 1)
    return u.select("url", U.api_name("url", folder).alias("api_name"))


@query("WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/]*/[^/]*)', 1) AS base FROM scraped_docs WHERE url IS NOT NULL), r AS (SELECT url, base, split_part(url, '#', 1) AS page, regexp_replace(split_part(url, '#', 1)[length(base) + 1:], '^/+|/+$', '', 'g') AS rest FROM u) SELECT url, regexp_replace(url, '/+$', '') = base OR lower(rest) = 'api' OR (starts_with(rest, 'api/') AND NOT contains(rest[5:], '/') AND ends_with(lower(rest[5:]), '.html') AND NOT regexp_matches(rest[5:], '^(genindex|modindex|search)')) AS relevant, NOT regexp_matches(split_part(page, '?', 1), '(?i)\\.(png|jpe?g|gif|svg|css|js|zip|gz|pdf|ico|xml|json|txt)$') AS is_page, NOT contains(url, '#') OR (len(regexp_extract_all(url, '#')) = 1 AND contains(split_part(url, '#', 2), '.')) AS well_formed FROM r")
def url_scope_filter(s, d):
    """Which pages are in the scope of each version's api folder."""
    u = table(s, d, "scraped_docs").where("url is not null").select("url").distinct().withColumn("base", F.regexp_extract("url", r"^(https?://[^/]*/[^/]*)", 1))
    return u.select("url", U.is_relevant("url", "base", F.lit("api")).alias("relevant"), U.is_page("url").alias("is_page"), U.well_formed("url").alias("well_formed"))


@query(None)
def anchors_on_pages(s, d):
    """Do the names that pages hold, and methods of them, fit the pages' addresses (without the pages' running marks)?"""
    u = table(s, d, "scraped_docs").where("url is not null and member_fqn is not null").select(F.regexp_replace("url", r"_[0-9a-z]+\.html", ".html").alias("url"), F.explode(F.array(F.col("member_fqn"), F.concat("member_fqn", F.lit(".open")), F.concat("member_fqn", F.lit(".a.b.c")))).alias("member_fqn")).distinct()
    return u.groupBy(U.anchor_fits("url", "member_fqn").alias("fits")).agg(F.count("*").alias("n"))


@query("WITH u AS (SELECT DISTINCT url FROM scraped_docs WHERE url IS NOT NULL), f AS (SELECT split_part(url, '#', 1) AS base, split_part(url, '#', 2) AS frag FROM u), n AS (SELECT base, replace(frag, '-', '.') AS norm, count(DISTINCT frag) AS k, min(frag) AS frag, regexp_replace(string_split(base, '/')[-1], '\\.html?$', '') AS stem FROM f GROUP BY 1, 2, 5) SELECT base || CASE WHEN norm = '' OR norm = stem THEN '' WHEN k > 1 THEN '#' || norm ELSE '#' || frag END AS url FROM n GROUP BY 1")
def deduplicated_urls(s, d):
    """Addresses with one spelling per anchor, without anchors that only repeat the page's name."""
    u = table(s, d, "scraped_docs").where("url is not null").select("url").distinct()
    f = u.select(F.split_part("url", F.lit("#"), F.lit(1)).alias("base"), F.split_part("url", F.lit("#"), F.lit(2)).alias("frag"))
    n = f.groupBy("base", F.translate("frag", "-", ".").alias("norm")).agg(F.count_distinct("frag").alias("k"), F.min("frag").alias("frag"))
    tail = F.when((F.col("norm") == "") | (F.col("norm") == U.page_stem("base")), "").when(F.col("k") > 1, F.concat(F.lit("#"), F.col("norm"))).otherwise(F.concat(F.lit("#"), F.col("frag")))
    return n.select(F.concat("base", tail).alias("url")).distinct()


# sections


def _tree(s, d):
    return S.section_tree(documents(s, d))


_HEADS = "WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{1,6})\\s+', 1)) AS level, trim(regexp_replace(line, '^#{1,6}\\s+', ''), ' ') AS title FROM l WHERE regexp_matches(line, '^#{1,6}\\s+')), p AS (SELECT h.doc_id, h.line_no, h.level, h.title, (SELECT max(q.line_no) FROM h q WHERE q.doc_id = h.doc_id AND q.line_no < h.line_no AND q.level < h.level) AS up FROM h)"


@query(_HEADS + ", w AS (SELECT doc_id, line_no, title AS path, 0 AS hops, up FROM p UNION ALL SELECT w.doc_id, w.line_no, p.title || ' > ' || w.path, w.hops + 1, p.up FROM w JOIN p ON p.doc_id = w.doc_id AND p.line_no = w.up) SELECT doc_id, line_no::INT AS line_no, path FROM w WHERE up IS NULL")
def section_paths(s, d):
    """The titles that lead to each section."""
    return E.title_paths(_tree(s, d)).select("doc_id", "line_no", F.array_join("path", " > ").alias("path"))


@query(None)
def contextual_sections(s, d):
    """Sections as a model is shown them: title path and the first characters."""
    tree = _tree(s, d)
    return E.title_paths(tree).join(E.section_texts(documents(s, d), tree), ["doc_id", "line_no"]).select("doc_id", "line_no", F.concat_ws("\n", F.array_join("path", " > "), "text").alias("text"))


@query(_HEADS + ", t AS (SELECT *, contains(lower(title), 'a') AS hit FROM h), m AS (SELECT doc_id, min(level) AS top FROM t WHERE hit GROUP BY 1), g AS (SELECT t.*, m.top, (SELECT arg_max(q.hit AND q.level = m.top, q.line_no) FROM t q WHERE q.doc_id = t.doc_id AND q.line_no <= t.line_no AND q.level <= m.top) AS under FROM t JOIN m ON m.doc_id = t.doc_id) SELECT doc_id, line_no::INT AS line_no, level::INT AS level, title FROM g WHERE under AND level <= top + 2")
def candidate_sections(s, d):
    """Sections whose title has the letter a, at the least level such titles have, with two levels below."""
    return E.candidate_sections(_tree(s, d), ["a"])


@query("WITH x AS (SELECT DISTINCT library, id, depth AS level, a AS first_page, b AS last_page FROM (SELECT library, id, len(string_split(fully_qualified_name, '.')) AS depth, source_start_line // 50 AS a, source_end_line // 50 AS b FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, md5(coalesce(docstring, '')) DESC, primary_api_name DESC NULLS LAST, doc_format DESC NULLS LAST) AS rn FROM members WHERE id IS NOT NULL) WHERE rn = 1)) WHERE b >= a AND depth IS NOT NULL), g AS (SELECT library, id, level, unnest(range(first_page, last_page + 1)) AS page FROM x), k AS (SELECT library, page, max(level) AS deepest FROM g GROUP BY 1, 2) SELECT DISTINCT id FROM g JOIN k USING (library, page) WHERE level = deepest")
def uncovered_sections(s, d):
    """Members (as sections of their library, over their lines by fifties) that have a stretch no deeper one has."""
    c = cur(s, d, "library", "fully_qualified_name", "source_start_line", "source_end_line")
    x = c.select(F.col("library").alias("doc_id"), "id", F.size(F.split("fully_qualified_name", "[.]")).alias("level"), F.floor(F.col("source_start_line") / 50).alias("first_page"), F.floor(F.col("source_end_line") / 50).alias("last_page")).where("fully_qualified_name is not null and last_page >= first_page")
    return E.not_covered(x).select("id")


@query(f"WITH {CUR}, {INH}, a AS (SELECT id, unnest(list_distinct([fully_qualified_name] || coalesce(all_api_names, []))) AS alias FROM cur), ex AS (SELECT alias, min(id) AS id, true AS exact FROM a WHERE alias IS NOT NULL GROUP BY 1), lw AS (SELECT lower(alias) AS alias, min(id) AS id, false AS exact FROM a WHERE alias IS NOT NULL GROUP BY 1), lo AS (SELECT * FROM lw WHERE alias NOT IN (SELECT alias FROM ex)), q AS (SELECT DISTINCT original_fqn AS name FROM inh WHERE contains(original_fqn, '.') AND NOT starts_with(original_fqn, 'module-')), dr AS (SELECT q.name, ex.id, true AS exact FROM q JOIN ex ON ex.alias = q.name), rs AS (SELECT q.name, i.id, false AS exact FROM q JOIN (SELECT alias, id FROM lo UNION ALL SELECT alias, id FROM ex) i ON i.alias = lower(q.name) WHERE q.name NOT IN (SELECT name FROM dr)) SELECT name, id, exact FROM (SELECT * FROM dr UNION ALL SELECT * FROM rs) WHERE id NOT IN (SELECT id FROM cur WHERE doc_format IS NOT NULL)")
def extraction_list(s, d):
    """The members without documentation that names of inherited members ask for."""
    c = cur(s, d, "fully_qualified_name", "all_api_names", "doc_format")
    index = E.alias_index(c.select("id", F.col("fully_qualified_name").alias("api_name"), F.col("all_api_names").alias("names")))
    asked = inh(s, d, "original_fqn").select(F.col("original_fqn").alias("name"))
    return E.extraction_list(asked, index, c.where("doc_format is not null"))


QUERIES, ORACLES = query.queries, query.oracles
