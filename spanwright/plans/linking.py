"""Queries on the analysed files' imports and exports, on definitions, and on what sources call and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.columns import module_from_path, segments
from spanwright.operators import graph as G
from spanwright.operators import inheritance as I
from spanwright.operators import property_graph as PG
from spanwright.operators import registry as R
from spanwright.plans.catalogue import DOC, cur, exps, mods, module_dependencies
from spanwright.functions.columns import is_present
from spanwright.plans.hierarchies import decoded_sql
from spanwright.plans.inheritance import _E, class_edges
from spanwright.plans.registry import CUR, EXPS, MODS, Registry
from spanwright.runtime import table, written
from spanwright.sources import pysource

query = Registry()

_FACE = f"{decoded_sql('module_interface')}, face AS (SELECT result_id, module_name AS module, j, coalesce(json_extract_string(j, '$.is_init_file')::BOOLEAN, false) AS is_init, coalesce(json_extract_string(j, '$.has_all')::BOOLEAN, false) AS has_all FROM d3 WHERE json_type(j) = 'OBJECT')"
_IMPS = f"""{_FACE}, raw AS (SELECT module, is_init, unnest(from_json(json_extract(j, '$.imports'), '["JSON"]')) AS x FROM face WHERE json_type(j, '$.imports') = 'ARRAY'), r1 AS (SELECT module, x->>'raw_module_specifier' AS spec, coalesce((x->>'level')::INT, 0) AS level, string_split(CASE WHEN is_init THEN module WHEN contains(module, '.') THEN regexp_replace(module, '\\.[^.]*$', '') ELSE '' END, '.') AS p FROM raw),
 imps AS (SELECT DISTINCT module, spec, level, CASE WHEN level = 0 THEN spec WHEN len(p) - level + 1 > 0 AND p <> [''] THEN array_to_string(p[1:len(p) - level + 1], '.') || coalesce('.' || nullif(spec, ''), '') END AS source FROM r1)"""
_EXPT = decoded_sql("export_records")
_EXPS2 = f"""{_EXPT}, xl AS (SELECT module_name AS module, CASE json_type(j) WHEN 'OBJECT' THEN json_extract(j, '$.records') ELSE j END AS j FROM d3), xr AS (SELECT module, unnest(from_json(j, '["JSON"]')) AS x FROM xl WHERE json_type(j) = 'ARRAY'),
 xps AS (SELECT DISTINCT module, x->>'exported_name' AS name, x->>'target_item_fqn' AS target, coalesce((x->>'is_explicit')::BOOLEAN, false) AS is_explicit, coalesce(json_extract(x, '$.wildcard_sources'), '[]'::JSON)::VARCHAR AS ws FROM xr WHERE json_type(x) = 'OBJECT')"""


def analysed(s: SparkSession, d: str, column: str) -> DataFrame:
    """(result_id, module, v): one row per analysed file, the cell's JSON as a variant."""
    rows = table(s, d, "analysis_results").where("module_name is not null").select("result_id", F.col("module_name").alias("module"), R.json_value(column).alias("v"))
    return rows.where("v is not null")


def interfaces(s, d):
    """(module, is_init, has_all, v) of readable interfaces."""
    flag = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "boolean"), F.lit(False))
    return analysed(s, d, "module_interface").where("schema_of_variant(v) like 'OBJECT%'").select("result_id", "module", flag("is_init_file").alias("is_init"), flag("has_all").alias("has_all"), "v")


def import_rows(s, d):
    """(module, spec, level, source), distinct."""
    x = interfaces(s, d).select("module", "is_init", F.explode(R.json_items(F.col("v"), "$.imports")).alias("x"))
    r = x.select("module", "is_init", F.try_variant_get("x", "$.raw_module_specifier", "string").alias("spec"), F.coalesce(F.try_variant_get("x", "$.level", "int"), F.lit(0)).alias("level"))
    return r.select("module", "spec", "level", R.resolve_relative(R.package_of("module", F.col("is_init")), F.col("level"), F.col("spec")).alias("source")).distinct()


def export_records(s, d):
    """(module, name, target, is_explicit, sources), distinct."""
    v = F.coalesce(R.json_items(F.col("v"), "$.records"), R.json_items(F.col("v")))
    x = analysed(s, d, "export_records").select("module", F.explode(v).alias("x")).where("schema_of_variant(x) like 'OBJECT%'")
    text = lambda name: F.try_variant_get("x", f"$.{name}", "string")
    sources = F.coalesce(F.try_variant_get("x", "$.wildcard_sources", "array<string>"), F.array().cast("array<string>"))
    return x.select("module", text("exported_name").alias("name"), text("target_item_fqn").alias("target"), F.coalesce(F.try_variant_get("x", "$.is_explicit", "boolean"), F.lit(False)).alias("is_explicit"), sources.alias("sources")).distinct()


@query(f"WITH {_IMPS} SELECT * FROM imps")
def resolved_imports(s, d):
    """Imports of the analysed modules with the module they come from, relative ones resolved."""
    return import_rows(s, d)


@query(f"WITH {_IMPS} SELECT module, source, split_part(source, '.', 1) = split_part(module, '.', 1) AS internal FROM (SELECT DISTINCT module, source FROM imps WHERE source <> '')")
def module_imports(s, d):
    """Distinct modules each module imports, and whether they are of its own package."""
    first = lambda c: F.split(c, "[.]")[0]
    return import_rows(s, d).where("source <> ''").select("module", "source").distinct().withColumn("internal", first("source") == first("module"))


@query(f"WITH {_IMPS} SELECT source AS module, count(DISTINCT module) AS n_importers, min(module) AS first_importer FROM imps WHERE source <> '' GROUP BY 1")
def importers_of_module(s, d):
    return import_rows(s, d).where("source <> ''").groupBy(F.col("source").alias("module")).agg(F.count_distinct("module").alias("n_importers"), F.min("module").alias("first_importer"))


@query(f"WITH {_IMPS} SELECT DISTINCT module AS src, source AS dst, 'IMPORTS' AS type FROM imps WHERE source IS NOT NULL UNION SELECT DISTINCT source, module, 'IMPORTED_BY' FROM imps WHERE source IS NOT NULL")
def import_graph(s, d):
    """Import records as edges, with the edges that run back."""
    none = F.lit(None).cast("string")
    r = import_rows(s, d).select(F.col("module").alias("importer"), "source", F.col("spec").alias("specifier"), none.alias("imported_name"), none.alias("alias"), none.alias("entity"), none.alias("points_to"), (F.col("level") > 0).alias("is_relative"), F.lit(False).alias("is_wildcard"), "level", F.lit(None).cast("int").alias("line"))
    return PG.with_inverse(PG.import_edges(r)).select("src", "dst", "type").distinct()


@query(f"WITH RECURSIVE {_IMPS}, e AS (SELECT DISTINCT module AS src, source AS dst FROM imps WHERE source IS NOT NULL), p AS (SELECT src AS a, dst AS b, [src, dst] AS path FROM e WHERE src <> dst UNION ALL SELECT p.a, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.b WHERE NOT list_contains(p.path, e.dst) AND len(p.path) <= 10) SELECT a, b, array_to_string(arg_min(path, (len(path), path)), ' > ') AS path FROM p GROUP BY 1, 2")
def import_paths(s, d):
    """The shortest chain of imports (ten at most) from every module to each it depends on."""
    e = import_rows(s, d).where("source is not null").select(F.col("module").alias("src"), F.col("source").alias("dst"))
    found = G.shortest_paths(e, e.select(F.col("src").alias("node")), 10)
    return found.select(F.col("seed").alias("a"), F.col("node").alias("b"), F.array_join("path", " > ").alias("path"))


_WILD = f"""{_EXPS2}, own AS (SELECT module, name, min(target) AS target FROM xps WHERE name IS NOT NULL GROUP BY 1, 2), lk AS (SELECT module, source, min(turn) AS turn FROM (SELECT module, json_extract_string(ws::JSON, '$[' || k || ']') AS source, k AS turn FROM (SELECT module, ws, unnest(range(0, json_array_length(ws::JSON)::BIGINT)) AS k FROM xps)) WHERE source <> module GROUP BY 1, 2),
 s1 AS (SELECT lk.module, own.name, arg_min((own.target, lk.source), (lk.turn, lk.source)) AS r FROM own JOIN lk ON lk.source = own.module GROUP BY 1, 2), n1 AS (SELECT s1.module, s1.name, r[1] AS target, r[2] AS provider FROM s1 LEFT JOIN own USING (module, name) WHERE own.module IS NULL),
 s2 AS (SELECT lk.module, n1.name, arg_min((n1.target, lk.source), (lk.turn, lk.source)) AS r FROM n1 JOIN lk ON lk.source = n1.module GROUP BY 1, 2), n2 AS (SELECT s2.module, s2.name, r[1] AS target, r[2] AS provider FROM s2 LEFT JOIN own USING (module, name) LEFT JOIN n1 ON n1.module = s2.module AND n1.name = s2.name WHERE own.module IS NULL AND n1.module IS NULL)"""


@query(f"WITH {_WILD} SELECT module, name, target, module AS provider, 0 AS depth FROM own UNION ALL SELECT *, 1 FROM n1 UNION ALL SELECT *, 2 FROM n2")
def expanded_star_exports(s, d):
    """Exports with what star imports add over two rounds: a module's own names first, then the first source's."""
    x = written(export_records(s, d), "records")
    links = x.select("module", F.posexplode("sources").alias("turn", "source"))
    return R.expanded(x.select("module", "name", "target"), links, 2)


@query(f"WITH {_WILD}, k AS (SELECT module || '.' || name AS name, min(target) AS target FROM own WHERE module || '.' || name <> target GROUP BY 1) SELECT o.module, o.name, o.target, coalesce(k2.target, k.target, o.target) AS final FROM own o LEFT JOIN k ON k.name = o.target LEFT JOIN k k2 ON k2.name = k.target")
def finalized_exports(s, d):
    """Export targets followed through other modules' exports to their definitions."""
    own = export_records(s, d).where("name is not null").groupBy("module", "name").agg(F.min("target").alias("target"))
    own = written(own, "own")
    pointers = own.select(F.concat_ws(".", "module", "name").alias("name"), "target").where("name <> target")
    return R.linked(own, pointers).select("module", "name", "target", "final")


_DEFS = f"{CUR}, {MODS}, defs AS (SELECT f AS fqn, arg_max((m, n, t), (id)) AS r FROM (SELECT c.id, c.fully_qualified_name AS f, m.name AS m, c.name AS n, c.member_type AS t FROM cur c JOIN mods m ON m.id = c.module_id WHERE c.fully_qualified_name IS NOT NULL) GROUP BY 1), df AS (SELECT fqn, r[1] AS module, r[2] AS name, r[3] AS kind FROM defs)"


def definitions(s, d):
    """(fqn, module, name, kind, seq): the registry of definitions, the last of a full name counting."""
    m = mods(s, d, "name").select(F.col("id").alias("module_id"), F.col("name").alias("module"))
    rows = cur(s, d, "fully_qualified_name", "name", "member_type", "module_id").join(m, "module_id").select(F.col("fully_qualified_name").alias("fqn"), "module", "name", F.col("member_type").alias("kind"), F.col("id").alias("seq"))
    return R.register(rows.limit(0), rows)


@query(f"WITH {_DEFS} SELECT * FROM df")
def registered_definitions(s, d):
    return definitions(s, d).select("fqn", "module", "name", "kind")


@query(f"WITH {_DEFS} SELECT name, count(DISTINCT module) AS n_modules, count(*) AS n_definitions, min(module) AS first_module FROM df GROUP BY 1")
def definition_modules(s, d):
    return R.definition_modules(definitions(s, d))


@query(f"WITH {_DEFS} SELECT count(*) AS definitions, count(DISTINCT module) AS modules, count(DISTINCT name) AS names FROM df")
def registry_statistics(s, d):
    return R.statistics(definitions(s, d))


@query(f"WITH {_DEFS} SELECT fqn, module, name, kind FROM df WHERE module NOT IN (SELECT min(name) FROM mods GROUP BY library)")
def definitions_after_removal(s, d):
    """The registry without the first module of every library."""
    gone = mods(s, d, "name", "library").groupBy("library").agg(F.min("name").alias("module"))
    return R.without_module(definitions(s, d), gone).select("fqn", "module", "name", "kind")


@query(f"WITH {_DEFS}, {EXPS}, w AS (SELECT e.id AS want_id, e.exported_name AS name, m.name AS module FROM exps e JOIN mods m ON m.id = e.exporter_module_id WHERE e.exported_name IS NOT NULL), j AS (SELECT w.want_id, f.fqn, CASE WHEN w.module = f.module THEN 0 WHEN starts_with(w.module || '.', f.module || '.') THEN 1 WHEN len(string_split(w.module, '.')) = len(string_split(f.module, '.')) AND array_to_string(string_split(w.module, '.')[:-2], '.') = array_to_string(string_split(f.module, '.')[:-2], '.') THEN 2 ELSE 3 END AS tier, len(string_split(f.module, '.')) AS k FROM w JOIN df f USING (name)) SELECT want_id, arg_min(fqn, (tier, CASE WHEN tier = 1 THEN -k ELSE 0 END, fqn)) AS fqn, min(tier) AS tier FROM j GROUP BY 1")
def full_names_of_exports(s, d):
    """The definition that each export's name means, nearest to the exporting module first."""
    m = mods(s, d, "name").select(F.col("id").alias("exporter_module_id"), F.col("name").alias("module"))
    want = exps(s, d, "exporter_module_id", "exported_name").where("exported_name is not null").join(m, "exporter_module_id").select(F.col("id").alias("want_id"), F.col("exported_name").alias("name"), "module")
    return R.full_names(want, definitions(s, d))


_DET = f"{_FACE}, ms AS (SELECT module, bool_or(has_all) AS has_all FROM face GROUP BY 1), nm AS (SELECT module, unnest(from_json(json_extract(j, '$.all_values'), '[\"VARCHAR\"]')) AS name FROM face WHERE json_type(j, '$.all_values') = 'ARRAY')"


@query(f"WITH {_DET} SELECT DISTINCT n.module, n.name, 'listed' AS how FROM nm n JOIN ms USING (module) WHERE has_all AND n.name IS NOT NULL")
def determined_exports(s, d):
    """What modules with a static list of names export."""
    v = interfaces(s, d)
    modules = v.groupBy("module").agg(F.bool_or("has_all").alias("has_all"), F.flatten(F.collect_list(F.try_variant_get("v", "$.all_values", "array<string>"))).alias("names")).withColumn("is_dynamic", F.lit(False))
    none = v.limit(0).select("module", F.col("module").alias("name"), F.col("module").alias("bound"), F.lit(False).alias("wildcard"))
    found = R.determined_exports(modules, none.select("module", "name"), none.select("module", "bound", "wildcard"))
    return found.where("how = 'listed' and name is not null")


@query(f"WITH {MODS}, p AS (SELECT DISTINCT array_to_string(string_split(name, '.')[1:k], '.') AS module FROM (SELECT name, unnest(range(1, len(string_split(name, '.')) + 1)) AS k FROM mods WHERE name IS NOT NULL)) SELECT p.module, m.name IS NOT NULL AS is_file, CASE WHEN contains(p.module, '.') THEN regexp_replace(p.module, '\\.[^.]*$', '') END AS package FROM p LEFT JOIN (SELECT DISTINCT name FROM mods) m ON m.name = p.module")
def known_modules(s, d):
    """Every module and namespace package that the modules' names imply, with the package that contains it."""
    names = mods(s, d, "name").where("name is not null").select(F.col("name").alias("module"))
    known, inner = PG.package_edges(names)
    files = names.distinct().withColumn("f", F.lit(True))
    return known.join(files, "module", "left").join(inner.select(F.col("dst").alias("module"), F.col("src").alias("package")), "module", "left").select("module", F.coalesce("f", F.lit(False)).alias("is_file"), "package")


@query(f"WITH {MODS} SELECT DISTINCT split_part(name, '.', 1) AS root FROM mods WHERE name IS NOT NULL")
def top_level_packages(s, d):
    return mods(s, d, "name").where("name is not null").select(F.split("name", "[.]")[0].alias("root")).distinct()


@query(f"WITH {_E}, {MODS}, {EXPS}, cm AS (SELECT fully_qualified_name AS f, min(m.name) AS module FROM cur c JOIN mods m ON m.id = c.module_id GROUP BY 1), deps AS (SELECT DISTINCT a.name AS src, b.name AS dst FROM exps x JOIN cur c ON c.id = x.target_member_id JOIN mods a ON a.id = x.exporter_module_id JOIN mods b ON b.id = c.module_id), k AS (SELECT dst AS module, src AS dependent FROM deps UNION SELECT q.module, p.module FROM e JOIN cm p ON p.f = e.src JOIN cm q ON q.f = e.dst) SELECT module, dependent FROM k WHERE module <> dependent")
def dependent_modules(s, d):
    """Modules that import from a module or subclass one of its classes, itself left out."""
    m = mods(s, d, "name")
    deps = module_dependencies(s, d).join(m.toDF("src", "dependent"), "src").join(m.toDF("dst", "module"), "dst").select("module", "dependent")
    homes = cur(s, d, "fully_qualified_name", "module_id").join(m.toDF("module_id", "module"), "module_id").groupBy(F.col("fully_qualified_name").alias("f")).agg(F.min("module").alias("module"))
    kin = class_edges(s, d).join(homes.toDF("src", "dependent"), "src").join(homes.toDF("dst", "module"), "dst").select("module", "dependent")
    return deps.unionByName(kin).where("module <> dependent").distinct()


@query(f"WITH {_E}, {MODS}, b AS (SELECT DISTINCT c.id AS cls, m.name AS module, string_split(i.source_class_fqn, '.')[-1] AS base_name, i.source_class_fqn AS base_fqn FROM inh i JOIN cur c ON c.id = i.inheriting_class_id JOIN mods m ON m.id = c.module_id WHERE i.source_class_fqn IS NOT NULL), l AS (SELECT DISTINCT m.name AS module, c.fully_qualified_name AS fqn FROM cur c JOIN mods m ON m.id = c.module_id), r AS (SELECT DISTINCT split_part(name, '.', 1) AS root FROM mods) SELECT b.cls, b.base_name, CASE WHEN l1.fqn IS NOT NULL THEN l1.fqn ELSE b.base_fqn END AS fqn, CASE WHEN l1.fqn IS NOT NULL OR l2.fqn IS NOT NULL THEN true ELSE r.root IS NOT NULL END AS internal, CASE WHEN l1.fqn IS NOT NULL OR l2.fqn IS NOT NULL THEN 'local' ELSE 'package' END AS how FROM b LEFT JOIN l l1 ON l1.module = b.module AND l1.fqn = b.module || '.' || b.base_name LEFT JOIN l l2 ON l2.module = b.module AND l2.fqn = b.base_fqn LEFT JOIN r ON r.root = split_part(b.base_fqn, '.', 1)")
def classified_bases(s, d):
    """Are the bases of classes defined beside them, or at least within an analysed package?"""
    m = mods(s, d, "name").toDF("module_id", "module")
    c = cur(s, d, "module_id", "fully_qualified_name").join(m, "module_id")
    from spanwright.plans.catalogue import inh

    b = inh(s, d, "inheriting_class_id", "source_class_fqn").where("source_class_fqn is not null").join(c.select(F.col("id").alias("inheriting_class_id"), "module"), "inheriting_class_id")
    b = b.select(F.col("inheriting_class_id").alias("cls"), "module", F.element_at(F.split("source_class_fqn", "[.]"), -1).alias("base_name"), F.col("source_class_fqn").alias("base_fqn")).distinct()
    none = c.limit(0).select("module", F.col("module").alias("bound"), F.col("module").alias("points_to"), F.lit(True).alias("internal"))
    return I.classified_bases(b, c.select("module", F.col("fully_qualified_name").alias("fqn")), none, mods(s, d, "name").select(F.split("name", "[.]")[0].alias("root")).distinct())


# statistics and scores of modules

_STATS = f"""{CUR}, {MODS}, {EXPS}, x AS (SELECT exporter_module_id AS id, count(*) AS export_count, count_if(is_explicit) AS explicit_count, count_if(is_reexport) AS reexport_count FROM exps GROUP BY 1), dp AS (SELECT DISTINCT e.exporter_module_id AS id, b.id AS src, b.library <> a.library AS ext FROM exps e JOIN cur c ON c.id = e.target_member_id JOIN mods b ON b.id = c.module_id JOIN mods a ON a.id = e.exporter_module_id WHERE b.id <> a.id), im AS (SELECT id, count(*) AS import_count, count_if(ext) AS external_count FROM dp GROUP BY 1),
 cm AS (SELECT module_id AS id, count(*) AS component_count, count_if(member_type = 'class') AS class_count, count_if(is_public) AS public_count, count_if({DOC}) AS documented, sum(CASE WHEN source_start_line IS NOT NULL AND source_end_line IS NOT NULL THEN source_end_line - source_start_line + 1 ELSE 0 END)::BIGINT AS loc FROM cur GROUP BY 1),
 st AS (SELECT m.id, m.name AS module, m.is_package AS is_init, coalesce(m.has_all AND NOT coalesce(m.all_is_dynamic, false), false) AS has_all, len(string_split(m.name, '.')) - 1 AS depth, coalesce(export_count, 0) AS export_count, coalesce(explicit_count, 0) AS explicit_count, coalesce(reexport_count, 0) AS reexport_count, coalesce(import_count, 0) AS import_count, coalesce(external_count, 0) AS external_count, coalesce(component_count, 0) AS component_count, coalesce(class_count, 0) AS class_count, coalesce(public_count, 0) AS public_count, coalesce(loc, 0) AS lines_of_code, CASE WHEN coalesce(import_count, 0) > 0 THEN coalesce(export_count, 0) / import_count ELSE coalesce(export_count, 0) END::DOUBLE AS export_import_ratio, coalesce(external_count / nullif(import_count, 0), 0.0)::DOUBLE AS external_import_ratio, coalesce(reexport_count / nullif(export_count, 0), 0.0)::DOUBLE AS reexport_ratio, coalesce(documented / nullif(component_count, 0), 0.0)::DOUBLE AS doc_ratio FROM mods m LEFT JOIN x USING (id) LEFT JOIN im USING (id) LEFT JOIN cm USING (id))"""
_BOUND = f"""{_STATS}, bd AS (SELECT id, module, greatest(0.1, 1.0 + CASE WHEN is_init THEN 5 ELSE 0 END + CASE WHEN export_import_ratio > 1.5 THEN least(export_import_ratio / 2, 3) ELSE 0 END + CASE WHEN external_import_ratio > 0.3 THEN least(external_import_ratio * 2, 2) ELSE 0 END + CASE WHEN reexport_ratio > 0.2 THEN least(reexport_ratio * 3, 3) ELSE 0 END + CASE WHEN has_all THEN 2 ELSE 0 END + CASE WHEN depth <= 1 THEN 2 - depth * 0.5 WHEN depth > 3 THEN -least((depth - 3) * 0.5, 1.5) ELSE 0 END - CASE WHEN len(list_filter(string_split(module, '.'), lambda p: starts_with(p, '_') OR p IN ('impl', 'internal', 'private', 'utils', 'helpers', 'tests', 'examples', 'compat'))) > 0 THEN 3 ELSE 0 END)::DOUBLE AS score FROM st)"""


def statistics(s, d) -> DataFrame:
    """Counts and ratios of every module; what it re-exports from other modules stands for its imports."""
    m = mods(s, d, "name", "library", "is_package", "has_all", "all_is_dynamic")
    x = exps(s, d, "exporter_module_id", "is_explicit", "is_reexport").groupBy(F.col("exporter_module_id").alias("id")).agg(F.count("*").alias("export_count"), F.count_if("is_explicit").alias("explicit_count"), F.count_if("is_reexport").alias("reexport_count"))
    lib = m.select("id", "library")
    dep = module_dependencies(s, d).join(lib.toDF("src", "la"), "src").join(lib.toDF("dst", "lb"), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("import_count"), F.count_if(F.col("la") != F.col("lb")).alias("external_count"))
    c = cur(s, d, "module_id", "member_type", "is_public", "docstring", "source_start_line", "source_end_line").groupBy(F.col("module_id").alias("id")).agg(
        F.count("*").alias("component_count"), F.count_if(F.col("member_type") == "class").alias("class_count"), F.count_if("is_public").alias("public_count"), F.count_if(is_present("docstring")).alias("documented"), F.sum(F.coalesce(F.col("source_end_line") - F.col("source_start_line") + 1, F.lit(0))).alias("lines_of_code")
    )
    counts = ["export_count", "explicit_count", "reexport_count", "import_count", "external_count", "component_count", "class_count", "public_count", "documented", "lines_of_code"]
    j = m.join(x, "id", "left").join(dep, "id", "left").join(c, "id", "left").fillna(0, counts)
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return j.select(
        "id", F.col("name").alias("module"), F.col("is_package").alias("is_init"), F.coalesce(F.col("has_all") & ~F.coalesce("all_is_dynamic", F.lit(False)), F.lit(False)).alias("has_all"), (segments("name") - 1).cast("long").alias("depth"), *[c for c in counts if c != "documented"],
        F.when(F.col("import_count") > 0, part("export_count", "import_count")).otherwise(F.col("export_count").cast("double")).alias("export_import_ratio"), part("external_count", "import_count").alias("external_import_ratio"), part("reexport_count", "export_count").alias("reexport_ratio"), part("documented", "component_count").alias("doc_ratio"),
    )


@query(f"WITH {_STATS} SELECT id, module, depth, export_count, explicit_count, reexport_count, import_count, external_count, component_count, class_count, public_count, lines_of_code, round(export_import_ratio, 6) AS export_import_ratio, round(external_import_ratio, 6) AS external_import_ratio, round(reexport_ratio, 6) AS reexport_ratio, round(doc_ratio, 6) AS doc_ratio FROM st")
def module_statistics(s, d):
    ratios = ["export_import_ratio", "external_import_ratio", "reexport_ratio", "doc_ratio"]
    st = statistics(s, d)
    return st.select(*[c for c in st.columns if c not in (*ratios, "is_init", "has_all")], *[F.round(c, 6).alias(c) for c in ratios])


def boundaries(s, d):
    st = statistics(s, d)
    keys = ("is_init", "export_import_ratio", "external_import_ratio", "reexport_ratio", "has_all")
    return st.select("id", "module", "is_init", R.boundary_score({**{k: F.col(k) for k in keys}, "has_docstring": F.lit(False)}).alias("score"))


@query(f"WITH {_BOUND} SELECT id, module, round(score, 6) AS score FROM bd")
def module_boundary_scores(s, d):
    """How much each module looks like a boundary of the API."""
    return boundaries(s, d).select("id", "module", F.round("score", 6).alias("score"))


_TARGET = "500.0 * (len(p) = 1)::INT - CASE WHEN len(p) > 1 THEN 10.0 * (len(p) - 1) ELSE 0 END + 40.0 * is_package::INT - 200.0 * (len(list_filter(p, lambda q: starts_with(q, '_') OR q IN ('_internal', 'impl', 'private', 'utils', 'helpers', 'compat', 'tests', 'examples'))) > 0)::INT"


@query(f"WITH {EXPS}, {MODS}, x AS (SELECT DISTINCT e.target_member_id AS id, m.name AS module, string_split(m.name, '.') AS p, m.is_package FROM exps e JOIN mods m ON m.id = e.exporter_module_id WHERE e.target_member_id IS NOT NULL), y AS (SELECT id, module, ({_TARGET})::DOUBLE AS score FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, module) AS rn FROM y) SELECT id, module, score FROM z WHERE rn = 1")
def target_module_argmax(s, d):
    """The exporting module that is the best public home of each member; of equals the first by name."""
    m = mods(s, d, "name", "is_package").withColumnRenamed("id", "exporter_module_id")
    e = exps(s, d, "exporter_module_id", "target_member_id").where("target_member_id is not null").join(m, "exporter_module_id")
    scored = e.select(F.col("target_member_id").alias("id"), F.col("name").alias("module"), R.target_score("name", F.col("is_package")).alias("score"))
    return scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "module")).alias("b")).select("id", "b.module", (-F.col("b.s")).alias("score"))


_CHAIN = f"{_BOUND}, ch AS (SELECT DISTINCT c.id AS target, c.fully_qualified_name AS fqn, e.exported_name AS name, dm.module AS dmod, dm.score AS ds, xm.module AS xmod, xm.score AS xs, coalesce(e.is_explicit, false) AS ex, coalesce(e.is_wildcard, false) AS wild, e.exported_name <> c.name AS alias FROM exps e JOIN cur c ON c.id = e.target_member_id JOIN bd dm ON dm.id = c.module_id JOIN bd xm ON xm.id = e.exporter_module_id WHERE dm.id <> xm.id AND e.exported_name IS NOT NULL), sc AS (SELECT target, xmod || '.' || name AS api, greatest(0.1, 19.0 + ds / 10 + xs / 10 * 2 + CASE WHEN ex THEN 2 ELSE 0 END - CASE WHEN wild THEN 2 WHEN alias THEN 0.5 ELSE 0 END + CASE WHEN xs > 7 THEN 5 ELSE 0 END) AS score FROM ch)"


@query(f"WITH {_CHAIN} SELECT target AS id, arg_max(api, (round(score, 9), -length(api))) AS api, round(max(score), 6)::DOUBLE AS score, count(*) AS n_chains FROM (SELECT target, api, max(score) AS score FROM sc GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = count(DISTINCT (round(score, 9), length(api)))")
def best_export_chains(s, d):
    """The best scored chain from a member's module to a re-exporting one, where scores and lengths tell them all apart."""
    b = written(boundaries(s, d).select("id", "module", "score"), "boundaries")
    c = cur(s, d, "name", "module_id").select(F.col("id").alias("target_member_id"), F.col("name").alias("own"), "module_id")
    e = exps(s, d, "exporter_module_id", "exported_name", "target_member_id", "is_explicit", "is_wildcard").where("exported_name is not null").join(c, "target_member_id").where("module_id <> exporter_module_id")
    j = e.join(b.toDF("module_id", "dmod", "ds"), "module_id").join(b.toDF("exporter_module_id", "xmod", "xs"), "exporter_module_id")
    how = F.when(F.coalesce("is_wildcard", F.lit(False)), "wildcard").when(F.col("exported_name") != F.col("own"), "alias").otherwise("plain")
    step = lambda m, sc, ex, h: F.struct(m.alias("module"), sc.alias("boundary"), ex.alias("explicit"), h.alias("how"))
    chain = F.array(step(F.col("dmod"), F.col("ds"), F.lit(False), F.lit("definition")), step(F.col("xmod"), F.col("xs"), F.coalesce("is_explicit", F.lit(False)), how))
    scored = j.select(F.col("target_member_id").alias("id"), F.concat_ws(".", "xmod", "exported_name").alias("api"), chain.alias("chain")).distinct().select("id", "api", R.chain_score("chain").alias("score")).groupBy("id", "api").agg(F.max("score").alias("score"))
    best = scored.groupBy("id").agg(F.max_by("api", F.struct(F.round("score", 9).alias("s"), -F.length("api"))).alias("api"), F.round(F.max("score"), 6).alias("score"), F.count("*").alias("n_chains"), F.count_distinct(F.struct(F.round("score", 9).alias("s"), F.length("api").alias("l"))).alias("k"))
    return best.where("k = n_chains").drop("k")


# sources


def source_rows(s, d):
    py = table(s, d, "source_files").where(F.lower("file_path").rlike(r"\.pyi?$")).withColumn("module", module_from_path("file_path"))
    return pysource.components(py, "library", "module")


@query(None)
def unused_imports(s, d):
    """Names that files import and never use, by library (names in ``__all__`` count as used)."""
    i = source_rows(s, d).where("kind = 'import'")
    unused = F.get_json_object("detail", "$.used") == "false"
    return i.groupBy("library").agg(F.count("*").alias("n_imports"), F.count_if(unused).alias("n_unused"))


@query(None)
def source_call_graph(s, d):
    """(src, dst, n): calls between functions by full names; what cannot be told is left out."""
    c = source_rows(s, d).where("kind = 'call'").select("module", "parent", F.get_json_object("detail", "$.target").alias("t")).where("t is not null")
    level = F.length(F.regexp_extract("t", r"^\.+", 0))
    absolute = F.when(F.col("t").startswith(":"), F.concat(F.col("module"), F.lit("."), F.substring("t", 2, 10_000))).when(level > 0, R.resolve_relative(R.package_of("module", F.lit(False)), level, F.regexp_replace("t", r"^\.+", ""))).otherwise(F.col("t"))
    return c.select(F.concat_ws(".", "module", "parent").alias("src"), absolute.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(None)
def call_resolution(s, d):
    """How the targets of calls were found."""
    c = source_rows(s, d).where("kind = 'call'")
    return c.groupBy("library", F.get_json_object("detail", "$.how").alias("how")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("detail", "$.args").cast("int")).alias("n_args"))


@query(None)
def overload_categories(s, d):
    f = source_rows(s, d).where("kind = 'function'")
    return f.groupBy(F.get_json_object("detail", "$.overload").alias("overload"), F.get_json_object("detail", "$.method_type").alias("method_type")).agg(F.count("*").alias("n"), F.round(F.avg(F.get_json_object("detail", "$.specificity").cast("double")), 6).alias("specificity"))


@query(None)
def source_imports(s, d):
    """Imports of sources by what their root is: the standard library, the file's own library, or another."""
    i = source_rows(s, d).where("kind = 'import'").select("library", F.get_json_object("detail", "$.module").alias("m"), F.get_json_object("detail", "$.level").cast("int").alias("level"))
    kind = F.when((F.col("level") > 0) | (F.split("m", "[.]")[0] == F.col("library")), "own").when(R.is_stdlib("m"), "standard").otherwise("other")
    return i.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT library, list_filter([library, 'python-' || library, 'py' || library, 'Py' || upper(library[1]) || lower(library[2:]), upper(library[1]) || lower(library[2:])], lambda x, i: i = 1 OR i IN (2, 3)) AS names FROM libraries WHERE NOT contains(library, '_') AND NOT starts_with(library, 'sk')")
def distribution_names(s, d):
    """Names under which libraries may be distributed."""
    n = table(s, d, "libraries").where("not contains(library, '_') and not startswith(library, 'sk')")
    return n.select("library", R.distribution_names("library").alias("names"))


QUERIES, ORACLES = query.queries, query.oracles
