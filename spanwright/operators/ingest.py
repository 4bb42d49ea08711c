"""Loading analysed files and documentation into the catalogue's tables.

Every table is one DataFrame built from the shredded rows of the analysis
results; ids are hashes of the unique names, so loading twice gives the same ids
and foreign keys need no second pass.  Rows of a name that is there already are
left alone (modules, members) or patched (inherited members, documentation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.columns import access_modifier, is_present
from spanwright.operators import catalog as C
from spanwright.operators.shredding import entity_table

#: columns of the tables, for creating them empty
TABLES = {
    "modules": "id long, name string, is_package boolean, has_all boolean, all_is_dynamic boolean, needs_dynamic_analysis boolean",
    "members": "id long, module_id long, name string, fully_qualified_name string, member_type string, parent_id long, docstring string, source_start_line int, access_modifier string",
    "signatures": "member_id long, variant string, signature_text string",
    "exports": "exporter_module_id long, exported_name string, target_member_id long, is_explicit boolean, is_reexport boolean",
    "imports": "importer_module_id long, raw_module_specifier string, level int",
    "inherited_members": "inheriting_class_id long, member_name string, original_member_id long, original_fqn string, is_external boolean",
}


def key(c: str | Column) -> Column:
    """The id of a unique name."""
    return F.xxhash64(c)


def empty_tables(spark) -> dict[str, DataFrame]:
    """All tables, empty: dropping what was and creating the schema anew."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def new_rows(existing: DataFrame, rows: DataFrame, on: str | list[str]) -> DataFrame:
    """``existing`` with the rows whose key is not there yet; the first come wins."""
    return existing.unionByName(rows.join(existing.select(on), on, "left_anti").select(*existing.columns))


def modules(rows: DataFrame, names: DataFrame) -> DataFrame:
    """names(record_id, module) of analysed files and their interfaces: one row per name, that of the least record."""
    face = entity_table(rows, "interface", is_init_file="boolean", has_all="boolean", all_is_dynamic="boolean", needs_dynamic_analysis="boolean")
    no = F.lit(False)
    flags = [F.coalesce(c, no).alias(a) for c, a in (("is_init_file", "is_package"), ("has_all", "has_all"), ("all_is_dynamic", "all_is_dynamic"), ("needs_dynamic_analysis", "needs_dynamic_analysis"))]
    j = names.join(face, "record_id", "left").select("record_id", "module", *flags)
    rest = ["is_package", "has_all", "all_is_dynamic", "needs_dynamic_analysis"]
    return j.groupBy(F.col("module").alias("name")).agg(F.min_by(F.struct(*rest), F.struct("record_id", *rest)).alias("r")).select(key("name").alias("id"), "name", "r.*")


def members(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Components as members, one per full name (the least record's, first entry's), linked to their module and parent."""
    c = entity_table(rows, "component", name="string", component_kind="string", docstring="string", line_number="int").where("item_key is not null").join(names, "record_id")
    short = F.coalesce("name", F.element_at(F.split("item_key", "[.]"), -1))
    picked = c.groupBy(F.col("item_key").alias("fqn")).agg(F.min_by(F.struct("module", short.alias("name"), "component_kind", "docstring", "line_number", "parent_key"), F.struct("record_id", "group_path", "entry")).alias("r")).select("fqn", "r.*")
    known = picked.select(F.col("fqn").alias("parent_key"), key("fqn").alias("parent_id"))
    return picked.join(known, "parent_key", "left").select(
        key("fqn").alias("id"), key("module").alias("module_id"), "name", F.col("fqn").alias("fully_qualified_name"), F.coalesce("component_kind", F.lit("unknown")).alias("member_type"), "parent_id", "docstring", F.col("line_number").alias("source_start_line"), access_modifier("name").alias("access_modifier")
    )


def signatures(rows: DataFrame) -> DataFrame:
    """Signature variants of members, one text per variant."""
    s = entity_table(rows, "signature", **{"text": "string", "=": "string"}).where("item_key is not null")
    text = F.coalesce("text", "value")
    variant = F.substring_index("item_key", ":", -1)
    return s.groupBy(key("parent_key").alias("member_id"), variant.alias("variant")).agg(F.min_by(text, F.struct("record_id", "group_path", "entry")).alias("signature_text"))


def exports(rows: DataFrame, names: DataFrame, known_members: DataFrame) -> DataFrame:
    """Named export records with the member they stand for, null for what is not known; a record without a name gives none."""
    e = entity_table(rows, "export", exported_name="string", target_item_fqn="string", is_explicit="boolean", is_reexport="boolean").where("exported_name is not null and exported_name <> ''").join(names, "record_id")
    ids = known_members.select(F.col("fully_qualified_name").alias("target_item_fqn"), F.col("id").alias("target_member_id"))
    no = F.lit(False)
    return e.join(ids, "target_item_fqn", "left").select(key("module").alias("exporter_module_id"), "exported_name", "target_member_id", F.coalesce("is_explicit", no).alias("is_explicit"), F.coalesce("is_reexport", no).alias("is_reexport"))


def imports(rows: DataFrame, names: DataFrame) -> DataFrame:
    i = entity_table(rows, "imports", raw_module_specifier="string", level="int").join(names, "record_id")
    return i.select(key("module").alias("importer_module_id"), "raw_module_specifier", F.coalesce("level", F.lit(0)).alias("level"))


def inherited(rows: DataFrame, known_members: DataFrame) -> DataFrame:
    """Inherited methods by class and name, later records patching what earlier ones left out."""
    i = entity_table(rows, "inherited", original_fqn="string", is_external="boolean").where("item_key is not null")
    name = F.substring_index("item_key", ":", -1)
    order = F.struct("record_id", "group_path", "entry")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    merged = i.groupBy(F.col("parent_key").alias("cls"), name.alias("member_name")).agg(last("original_fqn"), last("is_external"))
    ids = known_members.select(F.col("fully_qualified_name").alias("original_fqn"), F.col("id").alias("original_member_id"))
    return merged.join(ids, "original_fqn", "left").select(key("cls").alias("inheriting_class_id"), "member_name", "original_member_id", "original_fqn", F.coalesce("is_external", F.lit(False)).alias("is_external"))


def load(rows: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """All tables of a batch of shredded rows; names: (record_id, module)."""
    m = members(rows, names)
    return {"modules": modules(rows, names), "members": m, "signatures": signatures(rows), "exports": exports(rows, names, m), "imports": imports(rows, names), "inherited_members": inherited(rows, m)}


def matched_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(name, ...) with (member_id, tier): by full name first, then by primary and by any other public name; the least id of equals.

    known: (id, fully_qualified_name, primary_api_name, all_api_names).
    """
    names = C.own_names(known).select("name", "id", F.when(F.col("tier") == 3, -1).otherwise(F.col("tier")).alias("tier"))
    best = names.where("name is not null").groupBy("name").agg(F.min(F.struct("tier", "id")).alias("b")).select("name", F.col("b.id").alias("member_id"), (F.col("b.tier") + 1).alias("tier"))
    return docs.join(best, "name", "left")


def ingest_documents(docs: DataFrame, known: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members patched with the fields their documents supply, and (updated, not_found).

    Of several documents for a member the last by ``seq`` that supplies a field
    counts; fields no document supplies keep their value.
    """
    m = matched_documents(docs, known)
    order = F.col("seq")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(order, F.col(f)))).alias("new_" + f) for f in fields]
    new = m.where("member_id is not null").groupBy(F.col("member_id").alias("id")).agg(*last)
    patched = known.join(new, "id", "left").select(*[F.coalesce("new_" + c, c).alias(c) if c in fields else F.col(c) for c in known.columns])
    counts = m.agg(F.count("member_id").alias("updated"), F.count_if(F.col("member_id").isNull()).alias("not_found"))
    return patched, counts


def document_files(spark, folder: str) -> DataFrame:
    """(name, seq, structured) of a folder of JSON documents; the name is the full name a document gives, else its API name, else its file's stem."""
    read = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder)
    stem = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "")
    v = F.try_parse_json("value")
    named = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    return read.where(v.isNotNull()).select(F.coalesce(named("fqn"), named("api_name"), stem).alias("name"), F.xxhash64("_metadata.file_path").alias("seq"), F.col("value").alias("structured"))


def inherited_updates(docs: DataFrame, inherited: DataFrame, members: DataFrame) -> DataFrame:
    """(id, doc, source): what a document that matches an inherited member changes.

    An internal one takes it on its original where that has no documentation yet
    (``original``), an external one keeps it itself (``stored``); raw texts are given whole.
    docs: (name, text); inherited: (id, inherited_api_name, inherited_api_names, original_member_id); members: (id, docstring).
    """
    names = C.inherited_names(inherited).where("name is not null").groupBy("name").agg(F.min("id").alias("id"))
    hit = docs.groupBy("name").agg(F.max("text").alias("text")).join(names, "name").join(inherited.select("id", "original_member_id"), "id")
    bare = members.select(F.col("id").alias("original_member_id"), F.coalesce(is_present("docstring"), F.lit(False)).alias("documented"))
    j = hit.join(bare, "original_member_id", "left")
    stored = j.where("original_member_id is null").select("id", F.col("text").alias("doc"), F.lit("stored").alias("source"))
    original = j.where("not documented").groupBy(F.col("original_member_id").alias("id")).agg(F.max("text").alias("doc")).select("id", "doc", F.lit("original").alias("source"))
    return stored.groupBy("id", "source").agg(F.max("doc").alias("doc")).select("id", "doc", "source").unionByName(original)


def container_names(found: DataFrame) -> DataFrame:
    """(container, names): the names found for each container over all passes, merged and in order (a container's are those of one page)."""
    return found.where("container is not null and name is not null").select("container", "name").distinct().groupBy("container").agg(F.array_sort(F.collect_list("name")).alias("names"))


def semantic_issues(members_: DataFrame, exports_: DataFrame, imports_: DataFrame) -> DataFrame:
    """(rule, subject, n): what breaks the rules of a module's records.

    Full names borne twice, names that are no identifiers, unknown kinds,
    reversed lines, re-exports without a target, negative levels of relative imports.
    """
    ident = r"^[^\W\d]\w*$"
    bad = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(ident)
    row = lambda df, rule, subject: df.select(F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    found = [
        row(members_.groupBy("fully_qualified_name").agg(F.count("*").alias("k")).where("k > 1"), "duplicate_name", "fully_qualified_name"),
        row(members_.where(bad("name")), "bad_member_name", "fully_qualified_name"),
        row(members_.where(~F.col("member_type").isin("class", "function", "method", "variable")), "bad_kind", "fully_qualified_name"),
        row(members_.where("source_end_line < source_start_line"), "lines_reversed", "fully_qualified_name"),
        row(exports_.where(bad("exported_name")), "bad_export_name", "exported_name"),
        row(exports_.where("is_reexport and target_member_id is null"), "reexport_without_target", "exported_name"),
        row(imports_.where("level < 0"), "bad_level", "raw_module_specifier"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("rule", "subject").agg(F.count("*").alias("n"))
