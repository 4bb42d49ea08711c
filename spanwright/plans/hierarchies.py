"""Queries of the core's training-data operators: p1 (hierarchies) and p6 (shredding)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import hierarchy, shredding
from spanwright.plans.registry import CUR, MODS
from spanwright.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.member_hierarchy(table(spark, sf_dir, "members"), table(spark, sf_dir, "modules"))
    return found.select("member_id", "root_id", "depth", "n_descendants", "path", "status")


def p1_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per root of a tree: its nodes, greatest depth and the end of its nested-set range."""
    found = hierarchy.member_hierarchy(table(spark, sf_dir, "members"), table(spark, sf_dir, "modules")).where("status = 'tree'")
    return found.groupBy("root_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), F.max("range_end").alias("range_end"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every member of a tree, with their distance."""
    return hierarchy.ancestor_links(hierarchy.member_hierarchy(table(spark, sf_dir, "members"), table(spark, sf_dir, "modules")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = shredding.shred_results(table(spark, sf_dir, "analysis_results"))
    return results.unionByName(shredding.shred_signatures(table(spark, sf_dir, "inherited_members")))


def p6_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.level_report(table(spark, sf_dir, "analysis_results"), table(spark, sf_dir, "inherited_members"))


def shredded(spark: SparkSession, sf_dir: str, *entities: str) -> DataFrame:
    return shredding.shred_tables(table(spark, sf_dir, "analysis_results"), *entities)


def p6_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of components, their values beside their keys."""
    return shredding.entity_table(shredded(spark, sf_dir, "component"), "component", name="string", component_kind="string", docstring="string", line_number="int")


def p6_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.entity_table(shredded(spark, sf_dir, "parameter"), "parameter", **{"type": "string", "default": "string"})


def p6_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with their text, whichever of the shapes they come in."""
    found = shredding.entity_table(shredded(spark, sf_dir, "signature"), "signature", **{"text": "string", "=": "string"})
    return found.select("record_id", "item_key", "parent_key", F.coalesce("text", "value").alias("text"))


def p6_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredding.entity_table(shredded(spark, sf_dir, "export"), "export", exported_name="string", target_item_fqn="string", is_explicit="boolean").select("record_id", "entry", F.col("parent_key").alias("module"), "exported_name", "target_item_fqn", "is_explicit")


def p6_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shredding.entity_table(shredded(spark, sf_dir, "imports"), "imports", raw_module_specifier="string", level="int")
    return found.select("record_id", "entry", F.col("parent_key").alias("module"), "raw_module_specifier", "level")


QUERIES = {f.__name__: f for f in (p1_found, p1_roots, p1_links, p6_found, p6_levels, p6_components, p6_parameters, p6_signatures, p6_exports, p6_imports)}
#: Walks every node's ancestors one by one; cycles are cut at 400 steps, more than the test tables are deep.
_UP = f"""WITH RECURSIVE {CUR}, {MODS}, pre AS (SELECT id, string_split(fully_qualified_name, '.') AS p, unnest(range(1, len(string_split(fully_qualified_name, '.')))) AS k FROM cur),
 named AS (SELECT pre.id, arg_max(f.id, k) AS parent FROM pre JOIN (SELECT fully_qualified_name AS fqn, min(id) AS id FROM cur GROUP BY 1) f ON f.fqn = array_to_string(p[1:k], '.') WHERE f.id <> pre.id GROUP BY 1),
 par AS (SELECT c.id, coalesce(x.id, n.parent) AS parent, coalesce(c.name, '') AS name, c.module_id FROM cur c LEFT JOIN cur x ON x.id = c.parent_id LEFT JOIN named n ON n.id = c.id),
 up AS (SELECT id, parent AS anc, 1 AS d FROM par WHERE parent IS NOT NULL UNION ALL SELECT up.id, par.parent, d + 1 FROM up JOIN par ON par.id = up.anc WHERE par.parent IS NOT NULL AND d < 400),
 loop AS (SELECT DISTINCT id FROM up WHERE id = anc), below AS (SELECT anc AS id, count(DISTINCT id) AS n FROM up WHERE id <> anc GROUP BY 1),
 cyc AS (SELECT up.id, min(up.anc) AS root FROM up JOIN loop ON loop.id = up.anc GROUP BY 1),
 top AS (SELECT up.id, max(d) AS depth, arg_max(anc, d) AS root, string_agg(p.name, '/' ORDER BY d DESC) AS names FROM up JOIN par p ON p.id = up.anc WHERE up.id NOT IN (SELECT id FROM cyc) GROUP BY 1)
"""
_P1 = _UP + """SELECT par.id AS member_id, coalesce(cyc.root, top.root, par.id) AS root_id, CASE WHEN cyc.id IS NOT NULL THEN -1 ELSE coalesce(top.depth, 0) END::INT AS depth, coalesce(below.n, 0) AS n_descendants,
 CASE WHEN cyc.id IS NOT NULL THEN '' ELSE coalesce(m.name, '') || '/' || CASE WHEN top.names IS NULL THEN '' ELSE top.names || '/' END || par.name END AS path,
 CASE WHEN loop.id IS NOT NULL THEN 'on_cycle' WHEN cyc.id IS NOT NULL THEN 'below_cycle' ELSE 'tree' END AS status
FROM par LEFT JOIN cyc ON cyc.id = par.id LEFT JOIN top ON top.id = par.id LEFT JOIN below ON below.id = par.id LEFT JOIN loop ON loop.id = par.id LEFT JOIN par r ON r.id = coalesce(top.root, par.id) LEFT JOIN mods m ON m.id = r.module_id"""
_P1_ROOTS = f"SELECT root_id, count(*) AS n_nodes, max(depth) AS max_depth, count(*) AS range_end FROM ({_P1}) WHERE status = 'tree' GROUP BY 1"

_CELL = "CASE WHEN json_valid({0}) THEN json_extract_string({0}, '$') END"


def decoded_sql(column: str, source: str = "ar") -> str:
    """CTEs that open a cell's JSON, up to three texts deep, as ``j`` of (result_id, module_name, j)."""
    return f"ar AS (SELECT result_id, any_value(module_name) AS module_name, any_value({column}) AS c FROM analysis_results WHERE module_name IS NOT NULL GROUP BY 1), d1 AS (SELECT result_id, module_name, {_CELL.format('c')} AS c FROM {source}), d2 AS (SELECT result_id, module_name, {_CELL.format('c')} AS c FROM d1), d3 AS (SELECT result_id, module_name, CASE WHEN json_valid(c) THEN c::JSON END AS j FROM d2)"


_EXPORTS = f"""WITH {decoded_sql('export_records')}, l AS (SELECT result_id, module_name, CASE json_type(j) WHEN 'OBJECT' THEN json_extract(j, '$.records') ELSE j END AS j FROM d3), x AS (SELECT result_id, module_name, unnest(range(0, json_array_length(j)::BIGINT))::INT AS k, j FROM l WHERE json_type(j) = 'ARRAY')
SELECT result_id AS record_id, k AS entry, module_name AS module, json_extract_string(j, '$[' || k || '].exported_name') AS exported_name, json_extract_string(j, '$[' || k || '].target_item_fqn') AS target_item_fqn, json_extract_string(j, '$[' || k || '].is_explicit')::BOOLEAN AS is_explicit FROM x"""
_IMPORTS = f"""WITH {decoded_sql('module_interface')}, l AS (SELECT result_id, module_name, json_extract(j, '$.imports') AS j FROM d3 WHERE json_type(j) = 'OBJECT'), x AS (SELECT result_id, module_name, unnest(range(0, json_array_length(j)::BIGINT))::INT AS k, j FROM l WHERE json_type(j) = 'ARRAY')
SELECT result_id AS record_id, k AS entry, module_name AS module, json_extract_string(j, '$[' || k || '].raw_module_specifier') AS raw_module_specifier, json_extract_string(j, '$[' || k || '].level')::INT AS level FROM x"""

ORACLES: dict[str, str] = {"p1_found": _P1, "p1_roots": _P1_ROOTS, "p1_links": _UP + "SELECT anc AS ancestor_id, id AS member_id, d::INT AS distance FROM up WHERE id NOT IN (SELECT id FROM cyc)", "p6_exports": _EXPORTS, "p6_imports": _IMPORTS}
