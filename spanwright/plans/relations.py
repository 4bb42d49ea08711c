"""Queries on exports, inheritance, name resolution, integrity and source extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions.columns import access_modifier, module_from_path, name_prefixes, segments
from spanwright.operators import catalog as C
from spanwright.operators import relations as R
from spanwright.plans.catalogue import cur, exps, inh, mods, wanted_names
from spanwright.plans.registry import CUR, EXPS, INH, MODS, Registry
from spanwright.runtime import table
from spanwright.sources import files as S
from spanwright.sources import pysource

query = Registry()


@query(f"WITH {EXPS}, {MODS}, s AS (SELECT DISTINCT exporter_module_id AS module_id, exported_name AS name FROM exps WHERE exported_name IS NOT NULL), d AS (SELECT DISTINCT id AS module_id, unnest(all_exports) AS name FROM mods) SELECT coalesce(s.module_id, d.module_id) AS module_id, coalesce(s.name, d.name) AS name, CASE WHEN s.name IS NOT NULL AND d.name IS NOT NULL THEN 'both' WHEN d.name IS NOT NULL THEN 'dynamic' ELSE 'static' END AS origin FROM s FULL JOIN d ON s.module_id = d.module_id AND s.name = d.name")
def merge_static_dynamic(s, d):
    static = exps(s, d, "exporter_module_id", "exported_name").where("exported_name is not null").select(F.col("exporter_module_id").alias("module_id"), F.col("exported_name").alias("name"))
    return R.merge_exports(static, mods(s, d, "all_exports").select(F.col("id").alias("module_id"), F.explode("all_exports").alias("name")))


@query(f"WITH {EXPS} SELECT exporter_module_id, exported_name, arg_min(id, (CASE WHEN is_wildcard THEN 1 ELSE 0 END, id)) AS id FROM exps WHERE exported_name IS NOT NULL GROUP BY 1, 2")
def expanded_exports(s, d):
    """Exports per module and name: an explicit one before a wildcard's, then the first."""
    e = exps(s, d, "exporter_module_id", "exported_name", "is_wildcard").where("exported_name is not null").withColumn("w", F.when(F.col("is_wildcard"), 1).otherwise(0))
    return R.first_wins(e, ["exporter_module_id", "exported_name"], ["w", "id"]).select("exporter_module_id", "exported_name", "id")


@query(f"WITH {EXPS} SELECT target_member_id, count(DISTINCT exporter_module_id) AS n_exporters, min(exported_name) AS first_name FROM exps WHERE is_reexport AND target_member_id IS NOT NULL GROUP BY 1")
def chain_candidates(s, d):
    e = exps(s, d, "exporter_module_id", "exported_name", "target_member_id", "is_reexport").where("is_reexport and target_member_id is not null")
    return e.groupBy("target_member_id").agg(F.count_distinct("exporter_module_id").alias("n_exporters"), F.min("exported_name").alias("first_name"))


@query(f"WITH {EXPS} SELECT is_explicit, is_reexport, is_wildcard, count(*) AS n, count(target_member_id) AS linked FROM exps GROUP BY 1, 2, 3")
def export_kinds(s, d):
    return exps(s, d, "is_explicit", "is_reexport", "is_wildcard", "target_member_id").groupBy("is_explicit", "is_reexport", "is_wildcard").agg(F.count("*").alias("n"), F.count("target_member_id").alias("linked"))


@query(f"WITH {INH}, {CUR}, i AS (SELECT inheriting_class_id AS class_id, member_name, min(id) AS id FROM inh WHERE inheriting_class_id IS NOT NULL AND member_name IS NOT NULL GROUP BY 1, 2) SELECT i.* FROM i WHERE NOT (starts_with(member_name, '_') AND NOT starts_with(member_name, '__')) AND NOT EXISTS (SELECT 1 FROM cur c WHERE c.parent_id = i.class_id AND c.name = i.member_name)")
def inherited_first_wins(s, d):
    """Inherited members per class: the first provider wins, what the class defines itself shadows it."""
    i = inh(s, d, "inheriting_class_id", "member_name").where("inheriting_class_id is not null and member_name is not null").groupBy(F.col("inheriting_class_id").alias("class_id"), "member_name").agg(F.min("id").alias("id"))
    own = cur(s, d, "parent_id", "name").where("parent_id is not null").select(F.col("parent_id").alias("class_id"), F.col("name").alias("member_name"))
    return R.without_own(i, own).select("class_id", "member_name", "id")


@query(f"WITH {EXPS}, {CUR}, {MODS}, w AS (SELECT e.id AS want_id, e.exported_name AS name, m.name AS module FROM exps e JOIN mods m ON m.id = e.exporter_module_id WHERE e.target_member_id IS NULL AND e.exported_name IS NOT NULL), f AS (SELECT c.id AS def_id, c.name, m.name AS dm FROM cur c JOIN mods m ON m.id = c.module_id WHERE c.parent_id IS NULL), j AS (SELECT w.want_id, f.def_id, CASE WHEN w.module = f.dm THEN 0 WHEN starts_with(w.module || '.', f.dm || '.') THEN 1 WHEN len(string_split(w.module, '.')) = len(string_split(f.dm, '.')) AND array_to_string(string_split(w.module, '.')[:-2], '.') = array_to_string(string_split(f.dm, '.')[:-2], '.') THEN 2 ELSE 3 END AS tier, len(string_split(f.dm, '.')) AS k FROM w JOIN f USING (name)) SELECT want_id, arg_min(def_id, (tier, CASE WHEN tier = 1 THEN -k ELSE 0 END, def_id)) AS def_id, min(tier) AS tier FROM j GROUP BY 1")
def unlinked_export_targets(s, d):
    """For exports without a target, the definition of that name that is nearest to the exporting module."""
    m = mods(s, d, "name")
    want = exps(s, d, "exporter_module_id", "exported_name", "target_member_id").where("target_member_id is null and exported_name is not null").join(m.select(F.col("id").alias("exporter_module_id"), F.col("name").alias("module")), "exporter_module_id").select(F.col("id").alias("want_id"), F.col("exported_name").alias("name"), "module")
    defs = cur(s, d, "name", "module_id", "parent_id").where("parent_id is null").join(m.select(F.col("id").alias("module_id"), F.col("name").alias("module")), "module_id").select(F.col("id").alias("def_id"), "name", "module")
    return R.nearest_definition(want, defs)


@query(f"WITH {CUR}, {MODS}, {EXPS} SELECT 'duplicate_fqn' AS rule, count(*) AS n FROM (SELECT 1 FROM cur WHERE fully_qualified_name IS NOT NULL GROUP BY fully_qualified_name HAVING count(*) > 1) UNION ALL SELECT 'missing_parent', count(*) FROM cur WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM cur) UNION ALL SELECT 'own_parent', count(*) FROM cur WHERE parent_id = id UNION ALL SELECT 'missing_module', count(*) FROM cur WHERE module_id NOT IN (SELECT id FROM mods) UNION ALL SELECT 'lines_reversed', count(*) FROM cur WHERE source_end_line < source_start_line UNION ALL SELECT 'missing_target', count(*) FROM exps WHERE target_member_id IS NOT NULL AND target_member_id NOT IN (SELECT id FROM cur)")
def integrity_report(s, d):
    return R.integrity(cur(s, d, "fully_qualified_name", "parent_id", "module_id", "source_start_line", "source_end_line"), mods(s, d, "name"), exps(s, d, "target_member_id"))


_SRC = "src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY committed_at) AS rn FROM source_files) WHERE rn = 1)"


def src(s, d, *columns):
    return C.once(table(s, d, "source_files"), *columns, key="file_id")


@query(f"WITH {_SRC}, {MODS}, p AS (SELECT file_id, module_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(file_path, chr(92), '/'), '^(\\./)+', ''), '/+', '/', 'g'), '\\.(pyi?|mjs|js|json|toml)$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM src WHERE file_path IS NOT NULL) SELECT file_id, p.module, m.id IS NOT NULL AS known FROM p LEFT JOIN mods m ON m.name = p.module")
def module_of_file(s, d):
    """The dotted module of each source file, and whether the catalogue knows it."""
    p = src(s, d, "file_path").where("file_path is not null").select("file_id", module_from_path("file_path").alias("module"))
    return p.join(mods(s, d, "name").select(F.col("name").alias("module"), F.lit(True).alias("hit")), "module", "left").select("file_id", "module", F.coalesce("hit", F.lit(False)).alias("known"))


@query(f"WITH {_SRC}, q AS (SELECT file_id, library, replace(regexp_replace(file_path, '^(\\./)+', ''), chr(92), '/') AS p FROM src) SELECT DISTINCT file_id, pattern FROM q JOIN (SELECT DISTINCT * FROM exclude_patterns) x USING (library) WHERE CASE WHEN pattern_kind = 'dir' THEN contains('/' || p, '/' || pattern) ELSE regexp_matches(string_split(p, '/')[-1], '^' || replace(replace(pattern, '.', '\\.'), '*', '.*') || '$') END")
def excluded_files(s, d):
    return S.excluded(src(s, d, "library", "file_path"), table(s, d, "exclude_patterns"))


@query(f"WITH {_SRC} SELECT sha256(coalesce(library, '') || chr(1) || coalesce(content, '')) AS cache_key, count(*) AS n FROM src GROUP BY 1")
def cache_keys(s, d):
    """Content keys, and how many files share one."""
    return src(s, d, "library", "content").groupBy(S.cache_key("library", "content").alias("cache_key")).agg(F.count("*").alias("n"))


@query(f"WITH {_SRC}, e AS (SELECT file_id, unnest(errors) AS e FROM src) SELECT e.type AS type, count(*) AS n, count(DISTINCT file_id) AS n_files FROM e GROUP BY 1")
def noted_errors(s, d):
    e = src(s, d, "errors").select("file_id", F.explode("errors").alias("e"))
    return e.groupBy("e.type").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


@query(None)
def source_components(s, d):
    """Components, imports and exports found in Python sources, by library and kind."""
    py = table(s, d, "source_files").where(F.lower("file_path").rlike(r"\.pyi?$"))
    return pysource.components(py, "library").groupBy("library", "kind").agg(F.count("*").alias("n"), F.count("doc").alias("n_documented"))


@query(None)
def import_classes(s, d):
    """Imports by whether their root is the file's own library, another known one, or neither."""
    py = table(s, d, "source_files").where(F.lower("file_path").rlike(r"\.pyi?$"))
    found = pysource.components(py, "library").where("kind = 'import'")
    root = F.split(F.coalesce(F.get_json_object("detail", "$.module"), F.lit("")), "[.]")[0]
    libs = F.broadcast(table(s, d, "libraries").select(F.col("library").alias("root"), F.lit(True).alias("known")))  # a fixed table
    joined = found.select("library", root.alias("root"), F.get_json_object("detail", "$.level").cast("int").alias("level")).join(libs, "root", "left")
    kind = F.when((F.col("level") > 0) | (F.col("root") == F.col("library")), "internal").when(F.col("known"), "other_library").otherwise("external")
    return joined.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {CUR}, u AS (SELECT DISTINCT split_part(url, '#', 1) AS page, regexp_replace(regexp_replace(split_part(url, '#', 1), '^.*/|\\.html?$', '', 'g'), '_[0-9a-z]+$', '') AS stem FROM scraped_docs WHERE url IS NOT NULL), w AS (SELECT id, fully_qualified_name AS f FROM cur WHERE fully_qualified_name IS NOT NULL UNION ALL SELECT -scrape_id, member_fqn || '.open' FROM scraped_docs WHERE member_fqn IS NOT NULL GROUP BY 1, 2), x AS (SELECT id, unnest(range(1, len(string_split(f, '.')) + 1)) AS k, string_split(f, '.') AS p FROM w), h AS (SELECT x.id, k, min(page) AS page FROM x JOIN u ON u.stem = array_to_string(p[1:k], '.') GROUP BY 1, 2) SELECT id, arg_max(page, k) AS page FROM h GROUP BY 1")
def page_of_member(s, d):
    """The page whose stem is the longest dotted prefix of a member's full name (members, and methods of what pages are about, by negative ids)."""
    page = F.split_part("url", F.lit("#"), F.lit(1))
    stem = F.regexp_replace(F.regexp_replace(page, r"^.*/|\.html?$", ""), r"_[0-9a-z]+$", "")
    u = table(s, d, "scraped_docs").where("url is not null").select(page.alias("page"), stem.alias("prefix")).groupBy("prefix").agg(F.min("page").alias("page"))
    below = table(s, d, "scraped_docs").where("member_fqn is not null").select((-F.col("scrape_id")).alias("id"), F.concat("member_fqn", F.lit(".open")).alias("fully_qualified_name")).distinct()
    names = cur(s, d, "fully_qualified_name").where("fully_qualified_name is not null").unionByName(below)
    x = names.select("id", F.explode(name_prefixes("fully_qualified_name")).alias("prefix"))
    return x.join(u, "prefix").groupBy("id").agg(F.max_by("page", segments("prefix")).alias("page"))


@query(f"WITH {CUR}, {INH}, w AS (SELECT DISTINCT want FROM (SELECT member_fqn AS want FROM scraped_docs UNION ALL SELECT original_fqn FROM inh UNION ALL SELECT inherited_api_name FROM inh) WHERE want IS NOT NULL), f AS (SELECT fully_qualified_name AS want, min(id) AS id FROM cur WHERE fully_qualified_name IS NOT NULL GROUP BY 1), i AS (SELECT inherited_api_name AS want, min(id) AS id FROM inh WHERE inherited_api_name IS NOT NULL GROUP BY 1), sh AS (SELECT name, count(*) AS k, min(id) AS id FROM cur WHERE name IS NOT NULL GROUP BY 1) SELECT w.want, CASE WHEN f.id IS NOT NULL THEN 'exact' WHEN i.id IS NOT NULL THEN 'inherited' WHEN sh.k = 1 THEN 'short_name' ELSE 'not_found' END AS class FROM w LEFT JOIN f USING (want) LEFT JOIN i USING (want) LEFT JOIN sh ON sh.name = string_split(w.want, '.')[-1]")
def classify_names(s, d):
    """Exact, inherited, unambiguous short name, or not found."""
    w = wanted_names(s, d).withColumnRenamed("name", "want")
    c = cur(s, d, "fully_qualified_name", "name")
    f = c.where("fully_qualified_name is not null").select(F.col("fully_qualified_name").alias("want"), F.lit(True).alias("f")).distinct()
    i = inh(s, d, "inherited_api_name").where("inherited_api_name is not null").select(F.col("inherited_api_name").alias("want"), F.lit(True).alias("i")).distinct()
    short = c.where("name is not null").groupBy(F.col("name").alias("short")).agg(F.count("*").alias("k"))
    joined = w.join(f, "want", "left").join(i, "want", "left").withColumn("short", F.element_at(F.split("want", "[.]"), -1)).join(short, "short", "left")
    return joined.select("want", F.when(F.col("f"), "exact").when(F.col("i"), "inherited").when(F.col("k") == 1, "short_name").otherwise("not_found").alias("class"))


@query(f"WITH {CUR} SELECT id, len(list_filter(coalesce(decorators, []), lambda x: contains(x, 'deprecated'))) > 0 AS deprecated, is_async, list_contains(coalesce(decorators, []), '@property') AS property_marked FROM cur")
def decorator_flags(s, d):
    deco = F.coalesce("decorators", F.array().cast("array<string>"))
    return cur(s, d, "decorators", "is_async").select("id", F.exists(deco, lambda x: x.contains("deprecated")).alias("deprecated"), "is_async", F.array_contains(deco, "@property").alias("property_marked"))


@query(f"WITH {CUR}, p AS (SELECT id, unnest(parameters) AS p FROM cur) SELECT CASE WHEN p.is_vararg THEN 'vararg' WHEN p.is_kwarg THEN 'kwarg' WHEN p.is_keyword_only THEN 'keyword' WHEN p.is_positional_only THEN 'positional' ELSE 'plain' END AS kind, count(*) AS n, count(p.type) AS typed, count(p.default) AS with_default FROM p GROUP BY 1")
def parameter_kinds(s, d):
    p = cur(s, d, "parameters").select(F.explode("parameters").alias("p")).select("p.*")
    kind = F.when(F.col("is_vararg"), "vararg").when(F.col("is_kwarg"), "kwarg").when(F.col("is_keyword_only"), "keyword").when(F.col("is_positional_only"), "positional").otherwise("plain")
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count("type").alias("typed"), F.count("default").alias("with_default"))


@query(f"WITH {CUR} SELECT access_modifier AS stored, CASE WHEN name LIKE '\\_\\_%' ESCAPE '\\' AND name NOT LIKE '%\\_\\_' ESCAPE '\\' THEN 'private' WHEN name LIKE '\\_%' ESCAPE '\\' AND name NOT LIKE '\\_\\_%' ESCAPE '\\' THEN 'protected' ELSE 'public' END AS derived, count(*) AS n FROM cur GROUP BY 1, 2")
def modifier_agreement(s, d):
    """Stored against derived access modifiers."""
    return cur(s, d, "access_modifier", "name").groupBy(F.col("access_modifier").alias("stored"), access_modifier("name").alias("derived")).agg(F.count("*").alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
