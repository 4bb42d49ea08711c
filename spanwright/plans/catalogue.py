"""Catalogue queries: projections, look-ups, joins, hierarchies, coverage and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanwright.functions.columns import access_modifier, is_present, module_from_path, segments
from spanwright.operators import catalog as C
from spanwright.plans.registry import CUR, EXPS, INH, MODS, PRESENT, Registry
from spanwright.runtime import table

query = Registry()
DOC = PRESENT.format("docstring")


def mods(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return C.once(table(s, d, "modules"), *columns)


def cur(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return C.current(table(s, d, "members"), *columns)


def exps(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return C.once(table(s, d, "exports"), *columns)


def inh(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return C.once(table(s, d, "inherited_members"), *columns)


@query(f"WITH {MODS} SELECT name AS module FROM mods")
def module_names(s, d):
    return mods(s, d, "name").select(F.col("name").alias("module"))


@query(f"WITH {MODS}, {CUR}, {EXPS} SELECT m.name AS module, m.file_path, m.is_package, coalesce(a.n, 0) AS n_members, coalesce(b.n, 0) AS n_exports FROM mods m LEFT JOIN (SELECT module_id, count(*) n FROM cur GROUP BY 1) a ON a.module_id = m.id LEFT JOIN (SELECT exporter_module_id, count(*) n FROM exps GROUP BY 1) b ON b.exporter_module_id = m.id")
def module_details(s, d):
    a = cur(s, d, "module_id").groupBy(F.col("module_id").alias("id")).agg(F.count("*").alias("n_members"))
    b = exps(s, d, "exporter_module_id").groupBy(F.col("exporter_module_id").alias("id")).agg(F.count("*").alias("n_exports"))
    zero = F.lit(0).cast("long")
    joined = mods(s, d, "name", "file_path", "is_package").join(a, "id", "left").join(b, "id", "left")
    return joined.select(F.col("name").alias("module"), "file_path", "is_package", F.coalesce("n_members", zero).alias("n_members"), F.coalesce("n_exports", zero).alias("n_exports"))


@query(f"WITH {MODS} SELECT name AS package FROM mods WHERE is_package")
def packages(s, d):
    return mods(s, d, "name", "is_package").where("is_package").select(F.col("name").alias("package"))


@query(f"WITH {MODS} SELECT name AS module FROM mods WHERE needs_dynamic_analysis AND NOT dynamic_analysis_attempted")
def modules_needing_dynamic_analysis(s, d):
    return mods(s, d, "name", "needs_dynamic_analysis", "dynamic_analysis_attempted").where("needs_dynamic_analysis and not dynamic_analysis_attempted").select(F.col("name").alias("module"))


@query(f"WITH {MODS}, {CUR} SELECT m.name AS module, c.fully_qualified_name AS fqn, c.member_type FROM cur c JOIN mods m ON m.id = c.module_id")
def members_in_modules(s, d):
    return cur(s, d, "module_id", "fully_qualified_name", "member_type").join(mods(s, d, "name").withColumnRenamed("id", "module_id"), "module_id").select(F.col("name").alias("module"), F.col("fully_qualified_name").alias("fqn"), "member_type")


@query(f"WITH {CUR} SELECT c.id, c.fully_qualified_name AS fqn, p.fully_qualified_name AS parent_fqn, CASE WHEN len(c.all_api_names) > 0 THEN array_to_string(c.all_api_names, '|') ELSE c.fully_qualified_name END AS api_names FROM cur c LEFT JOIN cur p ON p.id = c.parent_id")
def member_details(s, d):
    c = cur(s, d, "fully_qualified_name", "parent_id", "all_api_names")
    p = c.select(F.col("id").alias("parent_id"), F.col("fully_qualified_name").alias("parent_fqn"))
    names = F.when(F.size("all_api_names") > 0, F.array_join("all_api_names", "|")).otherwise(F.col("fully_qualified_name"))
    return c.join(p, "parent_id", "left").select("id", F.col("fully_qualified_name").alias("fqn"), "parent_fqn", names.alias("api_names"))


@query(f"WITH {CUR}, n AS (SELECT primary_api_name AS name, id, 0 AS tier FROM cur WHERE primary_api_name IS NOT NULL UNION ALL SELECT unnest(all_api_names), id, 1 FROM cur) SELECT name, min(tier) AS tier, arg_min(id, tier * 1000000000000 + id) AS id FROM n WHERE name IS NOT NULL GROUP BY name")
def member_by_any_api_name(s, d):
    names = C.own_names(cur(s, d, "primary_api_name", "all_api_names", "fully_qualified_name")).where("tier < 3 and name is not null")
    return names.groupBy("name").agg(F.min(F.struct("tier", "id")).alias("b")).select("name", "b.tier", "b.id")


@query(f"WITH {CUR} SELECT library, member_type, count(*) AS n FROM cur WHERE member_type = 'class' AND fully_qualified_name ILIKE 'vel%' GROUP BY 1, 2")
def members_by_type(s, d):
    """Type equality with a module prefix: ILIKE, as the prefix may name sibling packages too."""
    return cur(s, d, "library", "member_type", "fully_qualified_name").where("member_type = 'class' and fully_qualified_name ilike 'vel%'").groupBy("library", "member_type").agg(F.count("*").alias("n"))


@query(f"WITH {CUR} SELECT id, primary_api_name FROM cur WHERE primary_api_name IS NOT NULL")
def public_members(s, d):
    return cur(s, d, "primary_api_name").where("primary_api_name is not null")


@query(f"WITH {CUR} SELECT id, fully_qualified_name AS fqn FROM cur WHERE name ILIKE '%tile%' OR fully_qualified_name ILIKE '%tile%' OR primary_api_name ILIKE '%tile%' ORDER BY fqn, id LIMIT 10")
def search_members(s, d):
    """Substring search over three names; ten hits, in order of the full name."""
    found = cur(s, d, "name", "fully_qualified_name", "primary_api_name").where("name ilike '%tile%' or fully_qualified_name ilike '%tile%' or primary_api_name ilike '%tile%'")
    return found.select("id", F.col("fully_qualified_name").alias("fqn")).orderBy("fqn", "id").limit(10)


@query(f"WITH {CUR} SELECT split_part(primary_api_name, '.', 1) AS prefix, count(*) AS n FROM cur WHERE primary_api_name LIKE split_part(primary_api_name, '.', 1) || '.%' GROUP BY 1")
def members_by_api_prefix(s, d):
    first = F.split("primary_api_name", "[.]")[0]
    return cur(s, d, "primary_api_name").where(F.col("primary_api_name").startswith(F.concat(first, F.lit(".")))).groupBy(first.alias("prefix")).agg(F.count("*").alias("n"))


@query(f"WITH {CUR} SELECT id, member_type FROM cur WHERE access_modifier = 'public' AND member_type IN ('class', 'function', 'method', 'variable')")
def all_public_members(s, d):
    return cur(s, d, "access_modifier", "member_type").where("access_modifier = 'public' and member_type in ('class', 'function', 'method', 'variable')").select("id", "member_type")


@query(f"WITH {CUR} SELECT id, primary_api_name AS api_name, member_type FROM cur WHERE primary_api_name IS NOT NULL AND NOT {DOC}")
def undocumented_public_api(s, d):
    found = cur(s, d, "primary_api_name", "member_type", "docstring").where(F.col("primary_api_name").isNotNull() & ~F.coalesce(is_present("docstring"), F.lit(False)))
    return found.select("id", F.col("primary_api_name").alias("api_name"), "member_type")


@query(f"WITH {CUR}, {MODS} SELECT m.library, count(*) AS n_documented FROM cur c JOIN mods m ON m.id = c.module_id WHERE {DOC.replace('docstring', 'c.docstring')} GROUP BY 1")
def documented_members(s, d):
    return cur(s, d, "module_id", "docstring").where(is_present("docstring")).join(mods(s, d, "library").withColumnRenamed("id", "module_id"), "module_id").groupBy("library").agg(F.count("*").alias("n_documented"))


@query(f"WITH {CUR} SELECT coalesce(doc_format, 'none') AS doc_format, count(*) AS n FROM cur GROUP BY 1")
def members_by_doc_format(s, d):
    """The literal 'none' stands for a null format."""
    return cur(s, d, "doc_format").groupBy(F.coalesce("doc_format", F.lit("none")).alias("doc_format")).agg(F.count("*").alias("n"))


@query(f"WITH {CUR} SELECT id, CASE doc_format WHEN 'structured' THEN docstring END AS structured, CASE doc_format WHEN 'raw' THEN docstring END AS raw_text FROM cur")
def documentation_by_format(s, d):
    f = F.col("doc_format")
    return cur(s, d, "doc_format", "docstring").select("id", F.when(f == "structured", F.col("docstring")).alias("structured"), F.when(f == "raw", F.col("docstring")).alias("raw_text"))


@query(f"WITH {CUR} SELECT p.id AS class_id, count(*) AS n_children, count_if(c.member_type = 'method') AS n_methods FROM cur c JOIN cur p ON c.parent_id = p.id WHERE p.member_type = 'class' GROUP BY 1")
def class_children(s, d):
    c = cur(s, d, "parent_id", "member_type")
    p = c.where("member_type = 'class'").select(F.col("id").alias("parent_id"))
    return c.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"), F.count_if(F.col("member_type") == "method").alias("n_methods")).join(p, "parent_id").withColumnRenamed("parent_id", "class_id")


@query(f"WITH {INH}, {CUR} SELECT c.id AS class_id, i.member_name, i.is_external FROM inh i JOIN cur c ON c.id = i.inheriting_class_id")
def inherited_members_for_class(s, d):
    classes = cur(s, d, "name").select(F.col("id").alias("class_id"))
    i = inh(s, d, "inheriting_class_id", "member_name", "is_external").select(F.col("inheriting_class_id").alias("class_id"), "member_name", "is_external")
    return i.join(classes, "class_id", "left_semi")


@query(f"WITH {INH}, n AS (SELECT inherited_api_name AS name, id, 0 AS tier FROM inh WHERE inherited_api_name IS NOT NULL UNION ALL SELECT unnest(inherited_api_names), id, 1 FROM inh) SELECT name, min(tier) AS tier, arg_min(id, tier * 1000000000000 + id) AS id FROM n WHERE name IS NOT NULL GROUP BY name")
def inherited_member_by_api_name(s, d):
    i = inh(s, d, "inherited_api_name", "inherited_api_names")
    names = i.where("inherited_api_name is not null").select(F.col("inherited_api_name").alias("name"), "id", F.lit(0).alias("tier")).unionByName(i.select(F.explode("inherited_api_names").alias("name"), "id", F.lit(1).alias("tier")))
    return names.where("name is not null").groupBy("name").agg(F.min(F.struct("tier", "id")).alias("b")).select("name", "b.tier", "b.id")


@query(f"WITH {INH}, {CUR} SELECT i.id, i.original_member_id, c.fully_qualified_name AS original, CASE WHEN c.id IS NOT NULL THEN 'original' ELSE 'stored' END AS doc_source, CASE WHEN c.id IS NOT NULL THEN c.docstring ELSE i.doc_description END AS doc FROM inh i LEFT JOIN cur c ON c.id = i.original_member_id")
def inherited_documentation(s, d):
    """Documentation of inherited members: the original's if it is internal, else what is stored."""
    c = cur(s, d, "fully_qualified_name", "docstring").select(F.col("id").alias("original_member_id"), F.col("fully_qualified_name").alias("original"), "docstring", F.lit(True).alias("hit"))
    return inh(s, d, "original_member_id", "doc_description").join(c, "original_member_id", "left").select("id", "original_member_id", "original", F.when(F.col("hit"), "original").otherwise("stored").alias("doc_source"), F.when(F.col("hit"), F.col("docstring")).otherwise(F.col("doc_description")).alias("doc"))


def wanted_names(s: SparkSession, d: str) -> DataFrame:
    """(name): what scraped pages are about, and what inherited members are called."""
    i = inh(s, d, "original_fqn", "inherited_api_name")
    names = table(s, d, "scraped_docs").select(F.col("member_fqn").alias("name")).union(i.select("original_fqn")).union(i.select("inherited_api_name"))
    return names.where("name is not null").distinct()


_NAMES = "n AS (SELECT primary_api_name AS name, id, 0 AS tier FROM cur WHERE primary_api_name IS NOT NULL UNION ALL SELECT unnest(all_api_names), id, 1 FROM cur UNION ALL SELECT inherited_api_name, id, 2 FROM inh WHERE inherited_api_name IS NOT NULL UNION ALL SELECT unnest(inherited_api_names), id, 2 FROM inh UNION ALL SELECT fully_qualified_name, id, 3 FROM cur WHERE fully_qualified_name IS NOT NULL), best AS (SELECT name, min(tier) AS tier, arg_min(id, tier * 1000000000000 + id) AS id FROM n WHERE name IS NOT NULL GROUP BY name)"


def _all_names(s, d):
    return C.own_names(cur(s, d, "primary_api_name", "all_api_names", "fully_qualified_name")).unionByName(C.inherited_names(inh(s, d, "inherited_api_name", "inherited_api_names"))).where("name is not null")


@query(f"WITH {CUR}, {INH}, {_NAMES}, w AS (SELECT DISTINCT name FROM (SELECT member_fqn AS name FROM scraped_docs UNION ALL SELECT original_fqn FROM inh UNION ALL SELECT inherited_api_name FROM inh) WHERE name IS NOT NULL) SELECT w.name, tier, id, coalesce(CASE tier WHEN 0 THEN 'primary' WHEN 1 THEN 'candidate' WHEN 2 THEN 'inherited' WHEN 3 THEN 'fqn' END, 'not_found') AS match_type FROM w LEFT JOIN best USING (name)")
def resolve_page_names(s, d):
    """Tiered resolution of the names of pages and of inherited members."""
    wanted = wanted_names(s, d)
    kinds = F.coalesce(F.element_at(F.create_map(*[x for k, v in enumerate(("primary", "candidate", "inherited", "fqn")) for x in (F.lit(k), F.lit(v))]), F.col("tier")), F.lit("not_found"))
    return C.resolve(wanted, _all_names(s, d)).select("name", "tier", "id", kinds.alias("match_type"))


@query(f"WITH {CUR}, {INH}, {_NAMES}, w AS (SELECT DISTINCT name FROM (SELECT member_fqn AS name FROM scraped_docs UNION ALL SELECT original_fqn FROM inh UNION ALL SELECT inherited_api_name FROM inh) WHERE name IS NOT NULL) SELECT coalesce(tier, 9) AS tier, count(*) AS n FROM w LEFT JOIN best USING (name) GROUP BY 1")
def match_type_breakdown(s, d):
    wanted = wanted_names(s, d)
    return C.resolve(wanted, _all_names(s, d)).groupBy(F.coalesce("tier", F.lit(9)).alias("tier")).agg(F.count("*").alias("n"))


@query(f"WITH {CUR}, {INH}, a AS (SELECT id, unnest(all_api_names) AS name FROM cur UNION SELECT id, fully_qualified_name FROM cur UNION SELECT original_member_id, inherited_api_name FROM inh WHERE original_member_id IS NOT NULL UNION SELECT original_member_id, unnest(inherited_api_names) FROM inh WHERE original_member_id IS NOT NULL) SELECT id, count(DISTINCT name) AS n_names, min(name) AS first_name FROM a WHERE name IS NOT NULL GROUP BY 1")
def all_api_names(s, d):
    own = cur(s, d, "all_api_names", "fully_qualified_name")
    i = inh(s, d, "original_member_id", "inherited_api_name", "inherited_api_names").where("original_member_id is not null")
    names = own.select("id", F.explode("all_api_names").alias("name")).union(own.select("id", "fully_qualified_name")).union(i.select("original_member_id", "inherited_api_name")).union(i.select("original_member_id", F.explode("inherited_api_names")))
    return names.where("name is not null").distinct().groupBy("id").agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"))


@query(f"WITH {EXPS}, {CUR}, {MODS} SELECT m.name AS module, e.exported_name, coalesce(c.member_type, 'unknown') AS member_type FROM exps e LEFT JOIN cur c ON c.id = e.target_member_id LEFT JOIN mods m ON m.id = e.exporter_module_id")
def public_peers(s, d):
    c = cur(s, d, "member_type").withColumnRenamed("id", "target_member_id")
    m = mods(s, d, "name").select(F.col("id").alias("exporter_module_id"), F.col("name").alias("module"))
    return exps(s, d, "exporter_module_id", "exported_name", "target_member_id").join(c, "target_member_id", "left").join(m, "exporter_module_id", "left").select("module", "exported_name", F.coalesce("member_type", F.lit("unknown")).alias("member_type"))


@query(f"WITH {EXPS}, {MODS} SELECT e.target_member_id AS member_id, count(DISTINCT m.name) AS n_exporters, arg_min(m.name, (len(string_split(m.name, '.')), m.name)) AS first_exporter FROM exps e JOIN mods m ON m.id = e.exporter_module_id WHERE e.target_member_id IS NOT NULL GROUP BY 1")
def exporters_of_member(s, d):
    """Exporting modules of a member; the first is the one with the fewest segments."""
    m = mods(s, d, "name").withColumnRenamed("id", "exporter_module_id")
    e = exps(s, d, "exporter_module_id", "target_member_id").where("target_member_id is not null").join(m, "exporter_module_id")
    best = F.min(F.struct(segments("name").alias("n"), "name"))["name"]
    return e.select("target_member_id", "name").distinct().groupBy(F.col("target_member_id").alias("member_id")).agg(F.count("*").alias("n_exporters"), best.alias("first_exporter"))


_DEPS = f"{EXPS}, {CUR}, deps AS (SELECT DISTINCT e.exporter_module_id AS src, c.module_id AS dst FROM exps e JOIN cur c ON c.id = e.target_member_id WHERE c.module_id <> e.exporter_module_id)"


def module_dependencies(s: SparkSession, d: str) -> DataFrame:
    """(src, dst): module src re-exports a member of module dst."""
    c = cur(s, d, "module_id").select(F.col("id").alias("target_member_id"), F.col("module_id").alias("dst"))
    return exps(s, d, "exporter_module_id", "target_member_id").join(c, "target_member_id").select(F.col("exporter_module_id").alias("src"), "dst").where("src <> dst").distinct()


@query(f"WITH {MODS}, {_DEPS} SELECT a.name AS module, b.name AS depends_on, a.library = b.library AS internal FROM deps JOIN mods a ON a.id = src JOIN mods b ON b.id = dst")
def dependencies(s, d):
    m = mods(s, d, "name", "library")
    a, b = m.toDF("src", "module", "la"), m.toDF("dst", "depends_on", "lb")
    return module_dependencies(s, d).join(a, "src").join(b, "dst").select("module", "depends_on", (F.col("la") == F.col("lb")).alias("internal"))


@query(f"WITH {MODS}, {_DEPS} SELECT dst AS module_id, count(*) AS n_importers FROM deps GROUP BY 1")
def reverse_dependencies(s, d):
    return module_dependencies(s, d).groupBy(F.col("dst").alias("module_id")).agg(F.count("*").alias("n_importers"))


@query(f"WITH {CUR}, a AS (SELECT lower(name) AS k, count(DISTINCT name) AS n FROM cur WHERE name IS NOT NULL GROUP BY 1) SELECT DISTINCT c.name FROM cur c JOIN a ON lower(c.name) = a.k WHERE a.n > 1")
def case_collisions(s, d):
    """Names that differ from another one only in case."""
    return cur(s, d, "name").where("name is not null").select("name").distinct().groupBy(F.lower("name").alias("k")).agg(F.collect_set("name").alias("v")).where(F.size("v") > 1).select(F.explode("v").alias("name"))


@query(f"WITH {CUR}, t AS (SELECT member_type, count(*) AS total, count_if({DOC}) AS documented FROM cur WHERE member_type IN ('class', 'function', 'method') GROUP BY 1 UNION ALL SELECT 'total', count(*), count_if({DOC}) FROM cur) SELECT *, coalesce(round(documented * 100.0 / nullif(total, 0), 4), 0.0)::DOUBLE AS percent FROM t")
def doc_coverage(s, d):
    return C.coverage(cur(s, d, "member_type", "docstring"))


@query(f"WITH {CUR} SELECT count_if(doc_format = 'structured') AS structured, count_if(doc_format = 'raw') AS raw, count_if(doc_format IS NULL) AS none FROM cur")
def format_stats(s, d):
    f = F.col("doc_format")
    return cur(s, d, "doc_format").agg(F.count_if(f == "structured").alias("structured"), F.count_if(f == "raw").alias("raw"), F.count_if(f.isNull()).alias("none"))


@query(f"WITH {CUR}, {MODS}, {EXPS}, {INH} SELECT 'modules' AS what, count(*) AS n FROM mods UNION ALL SELECT 'packages', count_if(is_package) FROM mods UNION ALL SELECT 'members', count(*) FROM cur UNION ALL SELECT 'classes', count_if(member_type = 'class') FROM cur UNION ALL SELECT 'public', count_if(primary_api_name IS NOT NULL) FROM cur UNION ALL SELECT 'exports', count(*) FROM exps UNION ALL SELECT 'linked_exports', count(target_member_id) FROM exps UNION ALL SELECT 'inherited', count(*) FROM inh UNION ALL SELECT 'external', count_if(is_external) FROM inh")
def db_stats(s, d):
    m, c, e, i = mods(s, d, "is_package"), cur(s, d, "member_type", "primary_api_name"), exps(s, d, "target_member_id"), inh(s, d, "is_external")
    return C.counts(
        modules=(m, F.count("*")), packages=(m, F.count_if("is_package")), members=(c, F.count("*")), classes=(c, F.count_if(F.col("member_type") == "class")), public=(c, F.count("primary_api_name")),
        exports=(e, F.count("*")), linked_exports=(e, F.count("target_member_id")), inherited=(i, F.count("*")), external=(i, F.count_if("is_external")),
    )


@query(f"WITH {CUR}, k AS (SELECT id, name, fully_qualified_name AS fqn, row_number() OVER (PARTITION BY name ORDER BY len(string_split(fully_qualified_name, '.')), length(fully_qualified_name), fully_qualified_name) AS rn FROM cur WHERE name IS NOT NULL) SELECT id, name, rn = 1 AS kept FROM k")
def dedup_keep_shortest(s, d):
    """Per name the member with the fewest segments, shortest and first full name is kept, the others are flagged."""
    c = cur(s, d, "name", "fully_qualified_name").where("name is not null")
    f = F.col("fully_qualified_name")
    best = c.groupBy("name").agg(F.min_by("id", F.struct(segments(f), F.length(f), f)).alias("best"))
    return c.join(best, "name").select("id", "name", (F.col("id") == F.col("best")).alias("kept"))


@query(f"WITH {MODS} SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', ''), '/+', '/', 'g'), '\\.(pyi?|mjs|js|json|toml)$', ''), '(^|/)__init__$', '') AS path_key FROM mods WHERE file_path IS NOT NULL")
def module_paths(s, d):
    """Paths in one spelling."""
    return mods(s, d, "file_path").where("file_path is not null").select("id", F.replace(module_from_path("file_path"), F.lit("."), F.lit("/")).alias("path_key"))


@query(f"WITH {CUR} SELECT id, CASE WHEN name LIKE '\\_\\_%' ESCAPE '\\' AND name NOT LIKE '%\\_\\_' ESCAPE '\\' THEN 'private' WHEN name LIKE '\\_%' ESCAPE '\\' AND name NOT LIKE '\\_\\_%' ESCAPE '\\' THEN 'protected' ELSE 'public' END AS modifier FROM cur")
def access_modifiers(s, d):
    return cur(s, d, "name").select("id", access_modifier("name").alias("modifier"))


@query(f"WITH {CUR}, {MODS}, e AS (SELECT c.id, m.name AS module, row_number() OVER (PARTITION BY c.id ORDER BY length(m.name) DESC) AS rn FROM cur c JOIN mods m ON c.fully_qualified_name = m.name OR starts_with(c.fully_qualified_name, m.name || '.') AND m.library = c.library) SELECT c.id, e.module FROM cur c LEFT JOIN (SELECT * FROM e WHERE rn = 1) e USING (id)")
def module_of_entity(s, d):
    """The longest dotted prefix of a full name that is a module."""
    found = C.longest_prefix(cur(s, d, "fully_qualified_name"), mods(s, d, "name"), "fully_qualified_name", "name")
    return found.select("id", F.col("match").alias("module"))


@query(f"WITH {CUR}, s AS (SELECT id, module_id, source_start_line AS a, lead(source_start_line) OVER (PARTITION BY module_id ORDER BY source_start_line, id) AS b, source_end_line AS e FROM cur WHERE member_type = 'class' AND parent_id IS NULL AND source_start_line IS NOT NULL) SELECT id, a AS scope_start, coalesce(b - 1, e) AS scope_end FROM s")
def scope_intervals(s, d):
    """Each top-level class's scope: up to the next class of its module, else to its own end."""
    c = cur(s, d, "module_id", "member_type", "parent_id", "source_start_line", "source_end_line").where("member_type = 'class' and parent_id is null and source_start_line is not null")
    after = F.lead("source_start_line").over(W.partitionBy("module_id").orderBy("source_start_line", "id"))
    return c.select("id", F.col("source_start_line").alias("scope_start"), F.coalesce(after - 1, F.col("source_end_line")).alias("scope_end"))


@query(f"WITH {CUR}, {EXPS}, {MODS}, a AS (SELECT c.id, m.name || '.' || e.exported_name AS api FROM exps e JOIN cur c ON c.id = e.target_member_id JOIN mods m ON m.id = e.exporter_module_id WHERE e.exported_name IS NOT NULL UNION SELECT id, fully_qualified_name FROM cur) SELECT id, arg_min(api, (len(string_split(api, '.')), api)) AS primary_api, count(*) AS n_candidates FROM a GROUP BY 1")
def derived_api_names(s, d):
    """Public names by direct look-up: exporter.name for every export, the full name always; the primary has the fewest segments."""
    m = mods(s, d, "name").select(F.col("id").alias("exporter_module_id"), F.col("name").alias("module"))
    c = cur(s, d, "fully_qualified_name")
    e = exps(s, d, "exporter_module_id", "exported_name", "target_member_id").where("exported_name is not null and target_member_id is not null").join(m, "exporter_module_id").join(c.select(F.col("id").alias("target_member_id")), "target_member_id", "left_semi")
    names = e.select(F.col("target_member_id").alias("id"), F.concat_ws(".", "module", "exported_name").alias("api")).union(c.select("id", "fully_qualified_name")).distinct()
    return names.groupBy("id").agg(F.min(F.struct(segments("api").alias("k"), "api"))["api"].alias("primary_api"), F.count("*").alias("n_candidates"))


@query(f"WITH RECURSIVE {CUR}, t AS (SELECT id, primary_api_name AS api, 0 AS lvl FROM cur WHERE primary_api_name IS NOT NULL AND primary_api_name <> fully_qualified_name AND member_type = 'class' UNION ALL SELECT c.id, t.api || '.' || c.name, t.lvl + 1 FROM t JOIN cur c ON c.parent_id = t.id WHERE t.lvl < 10 AND c.id <> t.id) SELECT id, api FROM t WHERE lvl > 0")
def propagated_api_names(s, d):
    """Children take their parent's public name plus their own, down to ten levels, where the parent has one other than its full name."""
    c = cur(s, d, "primary_api_name", "fully_qualified_name", "member_type", "parent_id", "name")
    level = c.where("primary_api_name is not null and primary_api_name <> fully_qualified_name and member_type = 'class'").select("id", F.col("primary_api_name").alias("api"))
    child = c.where("parent_id is not null and parent_id <> id").select("id", "parent_id", "name")
    out = None
    for _ in range(10):
        level = child.join(level.withColumnRenamed("id", "parent_id"), "parent_id").select("id", F.concat_ws(".", "api", "name").alias("api"))
        out = level if out is None else out.unionByName(level)
    return out


QUERIES, ORACLES = query.queries, query.oracles
