"""Documentation and the code it is about as one row per documented member.

``document`` columns: id, member_type, signature, purpose, info array<string>,
parameters array<struct<name,type,description>>, returns struct<type,description>,
examples array<struct<example,additional_information>>, notes and edge_cases
array<string>.  ``truth`` columns, of the code: has_truth, t_type, t_parameters
array<struct<name,type,default>> without self and cls, t_returns, t_async,
t_deprecated, t_variants map<string,string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.columns import coalesce_text, is_present

DOC = ["id", "member_type", "signature", "purpose", "info", "parameters", "returns", "examples", "notes", "edge_cases"]
TRUTH = ["has_truth", "t_type", "t_parameters", "t_returns", "t_async", "t_deprecated", "t_variants"]
PARAMETER = "array<struct<name:string,type:string,description:string>>"
EXAMPLE = "array<struct<example:string,additional_information:string>>"
TEXTS = "array<string>"
#: the items between commas that are in no brackets (one level deep)
ITEM = r"((?:[^,\[\]()]|\[[^\]]*\]|\([^)]*\))+)"

none = lambda kind: F.array().cast(kind)


def signature_text(cell: str) -> Column:
    """The text of a signature cell: the variant full, else no_types, else default, of an object, a list of variants, or text that is one of these; null if unreadable."""
    s = F.col(cell)
    for _ in range(2):
        s = F.coalesce(F.try_variant_get(F.try_parse_json(s), "$", "string"), s)
    v = F.try_parse_json(s)
    kind = F.schema_of_variant(v)
    order = ("full", "no_types", "default")
    of_map = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in order])
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.try_variant_get(x, "$.variant", "string").alias("k"), F.try_variant_get(x, "$.text", "string").alias("t")))

    def named(k: str) -> Column:
        return F.try_element_at(F.filter(items, lambda x: x["k"] == k), F.lit(1))["t"]

    of_list = F.coalesce(*[named(k) for k in order])
    return F.when(kind.startswith("OBJECT"), of_map).when(kind.startswith("ARRAY"), of_list).when(~s.rlike(r'^\s*[\[{"]'), s)


def signature_sql(x: str) -> str:
    """The same in SQL."""
    s = x
    for _ in range(2):
        s = f"(CASE WHEN json_valid({s}) THEN json_extract_string({s}, '$') ELSE {s} END)"
    pick = ", ".join(f"list_filter(from_json({s}, '[{{\"variant\":\"VARCHAR\",\"text\":\"VARCHAR\"}}]'), lambda q: q.variant = '{k}')[1].text" for k in ("full", "no_types", "default"))
    return f"CASE WHEN json_valid({s}) AND json_type({s}) = 'OBJECT' THEN coalesce(json_extract_string({s}, '$.full'), json_extract_string({s}, '$.no_types'), json_extract_string({s}, '$.default')) WHEN json_valid({s}) AND json_type({s}) = 'ARRAY' THEN coalesce({pick}) WHEN NOT regexp_matches({s}, '^\\s*[\\[{{\"]') THEN {s} END"


def signature_parameters(text: str | Column) -> Column:
    """The parameters a signature spells out; a default is told as ``Default: x``, as documentation does."""
    t = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_extract(coalesce_text(t), r"^[^(]*\((.*)\)", 1)
    items = F.filter(F.transform(F.regexp_extract_all(inner, F.lit(ITEM), 1), lambda x: F.trim(x)), lambda x: x.rlike(r"^\**\s*[A-Za-z_]"))

    def one(x: Column) -> Column:
        found = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
        default = found(r"=\s*(.*)$")
        return F.struct(found(r"^\**\s*([A-Za-z_]\w*)").alias("name"), found(r"^[^:=]*:\s*([^=]*?)\s*(?:=.*)?$").alias("type"), F.when(default.isNotNull(), F.concat(F.lit("Default: "), default)).alias("description"))

    return F.filter(F.transform(items, one), lambda p: ~p["name"].isin("self", "cls")).cast(PARAMETER)


def parameters_sql(text: str) -> str:
    """The same in SQL."""
    items = f"list_filter(list_transform(regexp_extract_all(regexp_extract(coalesce({text}, ''), '^[^(]*\\((.*)\\)', 1), '{ITEM}', 1), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '^\\**\\s*[A-Za-z_]'))"
    default = "nullif(regexp_extract(x, '=\\s*(.*)$', 1), '')"
    each = f"list_transform({items}, lambda x: {{'name': regexp_extract(x, '^\\**\\s*([A-Za-z_]\\w*)', 1), 'type': nullif(regexp_extract(x, '^[^:=]*:\\s*([^=]*?)\\s*(?:=.*)?$', 1), ''), 'description': CASE WHEN {default} IS NOT NULL THEN 'Default: ' || {default} END}})"
    return f"list_filter({each}, lambda p: p.name NOT IN ('self', 'cls'))"


def truth(members: DataFrame) -> DataFrame:
    """Truth columns beside id of (id, name, member_type, parameters, returns, decorators, is_async)."""
    public = F.filter(F.coalesce(F.col("parameters"), F.array()), lambda p: p["name"].isNotNull() & ~p["name"].isin("self", "cls"))
    spelt = lambda p, types: F.concat(F.when(p["is_vararg"], "*").when(p["is_kwarg"], "**").otherwise(""), p["name"], F.when(F.lit(types) & is_present(p["type"]), F.concat(F.lit(": "), p["type"])).otherwise(""), F.when(p["default"].isNotNull(), F.concat(F.lit("="), p["default"])).otherwise(""))
    sig = lambda types: F.concat(F.col("name"), F.lit("("), F.array_join(F.transform(public, lambda p: spelt(p, types)), ", "), F.lit(")"))
    deco = F.coalesce(F.col("decorators"), F.array().cast(TEXTS))
    return members.select(
        "id", F.lit(True).alias("has_truth"), F.col("member_type").alias("t_type"), F.transform(public, lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), p["default"].alias("default"))).alias("t_parameters"), F.col("returns")["type"].alias("t_returns"),
        F.coalesce("is_async", F.lit(False)).alias("t_async"), F.exists(deco, lambda x: F.lower(x).contains("deprecated")).alias("t_deprecated"), F.create_map(F.lit("full"), sig(True), F.lit("no_types"), sig(False)).alias("t_variants"),
    )


def void(t_type: str = "t_type", t_returns: str = "t_returns") -> Column:
    """Is it a function or method that returns nothing?"""
    r = F.lower(F.trim(coalesce_text(F.col(t_returns))))
    return F.col(t_type).isin("function", "method") & (~is_present(t_returns) | (r == "none"))


def sections() -> Column:
    """The prose of a document as array<struct<label,text,path>>, empty texts left out."""
    is_class = F.col("member_type") == "class"
    part = lambda label, text, path: F.struct(label.alias("label"), text.alias("text"), path.alias("path"))
    text = F.lit

    def listed(column: str, label: str, path: str, get=lambda x: x) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array()), lambda x, i: part(F.concat(text(f"{label}["), i.cast("string"), text("]" + (".additional_information" if column == "examples" else ""))), get(x), F.concat(text(f"{path}["), i.cast("string"), text("]" + (".additional_information" if column == "examples" else "")))))

    purpose = F.array(part(F.when(is_class, "module_member_description.purpose").otherwise("module_member_description"), F.col("purpose"), F.when(is_class, "$.module_member_description.purpose").otherwise("$.module_member_description")))
    params = F.transform(F.coalesce(F.col("parameters"), F.array()), lambda p: part(F.concat(text("parameters["), F.coalesce(p["name"], text("?")), text("].description")), p["description"], F.concat(text("$.parameters[?name=='"), F.coalesce(p["name"], text("?")), text("'].description"))))
    returns = F.when(~is_class, F.array(part(text("returns.description"), F.col("returns")["description"], text("$.returns.description")))).otherwise(F.array().cast("array<struct<label:string,text:string,path:string>>"))
    every = F.concat(
        listed("examples", "examples", "$.examples", lambda x: x["additional_information"]), listed("notes", "additional_notes.supplementary_information", "$.additional_notes.supplementary_information"), listed("edge_cases", "additional_notes.edge_cases", "$.additional_notes.edge_cases"),
        purpose, listed("info", "module_member_description.additional_information", "$.module_member_description.additional_information"), params, returns,
    )
    return F.filter(every, lambda s: F.coalesce(is_present(s["text"]), F.lit(False)))


def parsed(documents: DataFrame, kind: str = "member_type") -> DataFrame:
    """(id, member_type, json) as document columns: the class's and the callable's shape of the description told apart by what is there."""
    v = F.try_parse_json("json")
    text = lambda path: F.try_variant_get(v, path, "string")
    get = lambda path, kind: F.coalesce(F.try_variant_get(v, path, kind), none(kind))
    nested = F.schema_of_variant(F.try_variant_get(v, "$.module_member_description", "variant")).startswith("OBJECT")
    purpose = F.when(nested, text("$.module_member_description.purpose")).otherwise(text("$.module_member_description"))
    return documents.select(
        "id", F.col(kind).alias("member_type"), text("$.module_member_signature").alias("signature"), purpose.alias("purpose"), get("$.module_member_description.additional_information", TEXTS).alias("info"), get("$.parameters", PARAMETER).alias("parameters"),
        F.try_variant_get(v, "$.returns", "struct<type:string,description:string>").alias("returns"), get("$.examples", EXAMPLE).alias("examples"), get("$.additional_notes.supplementary_information", TEXTS).alias("notes"), get("$.additional_notes.edge_cases", TEXTS).alias("edge_cases"),
    )


def is_empty() -> Column:
    """Says a document nothing at all?"""
    return ~F.coalesce(is_present("signature"), F.lit(False)) & (F.size(sections()) == 0) & ~F.exists(F.coalesce("parameters", none(PARAMETER)), lambda p: F.coalesce(is_present(p["name"]), F.lit(False))) & ~F.exists(F.coalesce("examples", none(EXAMPLE)), lambda x: F.coalesce(is_present(x["example"]), F.lit(False)))
