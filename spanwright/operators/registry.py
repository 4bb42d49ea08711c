"""Definitions, imports and exports: registering, linking, expanding and resolving them as joins.

Frames: definitions(module, name, fqn, kind, line, seq); imports(module, source,
name, bound, points_to, level, wildcard); exports(module, name, target, ...).
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.columns import col, parts
from spanwright.operators import graph as G
from spanwright.operators.relations import first_wins, nearest_definition

_TEXTS = "array<variant>"


def json_value(cell: str | Column) -> Column:
    """The JSON value of a cell as a variant, with text that is JSON again opened up to three deep; null if unreadable."""
    v = F.try_parse_json(col(cell))
    for _ in range(2):
        v = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return v


def json_items(value: Column, path: str = "$") -> Column:
    """The elements of a list in a variant; null if it is none."""
    return F.try_variant_get(value, path, _TEXTS)


def package_of(module: str | Column, is_init: Column) -> Column:
    """The package a module's relative imports start from: itself if it is one, else its parent."""
    m = col(module)
    return F.when(is_init, m).otherwise(F.when(m.contains("."), F.regexp_replace(m, r"\.[^.]*$", "")).otherwise(F.lit("")))


def resolve_relative(package: Column, level: Column, specifier: Column) -> Column:
    """The absolute module of an import (PEP 328); null if it leads above the top."""
    p = F.split(package, "[.]")
    n = F.when(package == "", 0).otherwise(F.size(p))
    keep = n - level + 1
    base = F.array_join(F.slice(p, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    relative = F.when(keep > 0, F.when(F.coalesce(specifier, F.lit("")) == "", base).otherwise(F.concat_ws(".", base, specifier)))
    return F.when(F.coalesce(level, F.lit(0)) == 0, specifier).otherwise(relative)


def is_stdlib(module: str | Column) -> Column:
    """Does a module belong to the standard library (of the Python that runs this)?"""
    return F.split(col(module), "[.]")[0].isin(*sorted(sys.stdlib_module_names))


def distribution_names(name: str | Column) -> Column:
    """Names a package may be distributed under, likeliest first, none twice in whatever case."""
    n = col(name)
    low = F.lower(n)
    capital = F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substring(n, 2, 1_000)))
    rest = F.substring(n, 3, 1_000)
    none = F.array().cast("array<string>")
    hyphen = F.when(n.contains("_"), F.array(F.replace(n, F.lit("_"), F.lit("-")))).otherwise(none)
    scikit = F.when(n.startswith("sk") & (F.length(n) > 2), F.array(F.concat(F.lit("scikit-"), rest))).otherwise(none)
    names = F.concat(F.array(n), hyphen, scikit, F.array(F.concat(F.lit("python-"), n), F.concat(F.lit("py"), n), F.concat(F.lit("Py"), capital), capital))
    return F.filter(names, lambda x, i: ~F.exists(F.slice(names, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


# definitions


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by full name: the row of the highest ``seq`` counts, the new ones after the old."""
    both = existing.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    rest = [c for c in existing.columns if c != "fqn"]
    return both.where("fqn is not null").groupBy("fqn").agg(F.max_by(F.struct(*rest), F.struct("batch", "seq")).alias("r")).select("fqn", "r.*")


def without_module(definitions: DataFrame, modules: DataFrame) -> DataFrame:
    """Definitions that are not in modules(module)."""
    return definitions.join(modules.select("module"), "module", "left_anti")


def definition_modules(definitions: DataFrame) -> DataFrame:
    """(name, n_modules, n_definitions, first_module): where each simple name is defined."""
    return definitions.groupBy("name").agg(F.count_distinct("module").alias("n_modules"), F.count("*").alias("n_definitions"), F.min("module").alias("first_module"))


def statistics(definitions: DataFrame) -> DataFrame:
    """(definitions, modules, names)."""
    return definitions.agg(F.count("*").alias("definitions"), F.count_distinct("module").alias("modules"), F.count_distinct("name").alias("names"))


def full_names(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """wanted(want_id, name, module) with the full name of the definition that is nearest to the module."""
    d = definitions.select(F.col("fqn").alias("def_id"), "name", "module")
    return nearest_definition(wanted, d).select("want_id", F.col("def_id").alias("fqn"), "tier")


# imports


def classified_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports with ``kind``: what points_to is, a package, a module or a member of ``source``; modules: (module, is_package)."""
    known = modules.select(F.col("module").alias("points_to"), F.when(F.col("is_package"), "package").otherwise("module").alias("known_kind")).dropDuplicates(["points_to"])
    return imports.join(known, "points_to", "left").withColumn("kind", F.coalesce("known_kind", F.lit("member"))).drop("known_kind")


def observed_imports(imports: DataFrame, runtime: DataFrame) -> DataFrame:
    """Static imports of modules that were seen to be imported at run time; modules nothing was seen of keep all of theirs.

    runtime: (module, source).
    """
    seen = runtime.select("module").distinct().withColumn("watched", F.lit(True))
    hit = runtime.select("module", "source").distinct().withColumn("hit", F.lit(True))
    joined = imports.join(seen, "module", "left").join(hit, ["module", "source"], "left")
    return joined.where("watched is null or hit").select(*imports.columns)


# exports


def determined_exports(modules: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, name, how): listed names where ``__all__`` is static, none where it is dynamic, else public definitions and bound imports.

    modules: (module, has_all, is_dynamic, names array<string>).
    """
    public = lambda c: ~F.col(c).startswith("_")
    listed = modules.where("has_all and not is_dynamic").select("module", F.explode("names").alias("name")).distinct().withColumn("how", F.lit("listed"))
    free = modules.where("not has_all").select("module")
    own = definitions.where(public("name")).select("module", "name").distinct().withColumn("how", F.lit("defined"))
    bound = imports.where(~F.col("wildcard") & public("bound")).select("module", F.col("bound").alias("name")).distinct().withColumn("how", F.lit("imported"))
    implicit = own.unionByName(bound).join(free, "module", "left_semi")
    return listed.unionByName(implicit.groupBy("module", "name").agg(F.min("how").alias("how")))


def export_rows(exported: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """exported(module, name) with (target, is_reexport, needs_linking): a definition of the module, else what an import binds, else unlinked."""
    local = definitions.groupBy("module", "name").agg(F.min("fqn").alias("own"))
    bound = imports.where(~F.col("wildcard")).groupBy("module", F.col("bound").alias("name")).agg(F.min("points_to").alias("imported"))
    j = exported.select("module", "name").distinct().join(local, ["module", "name"], "left").join(bound, ["module", "name"], "left")
    return j.select("module", "name", F.coalesce("own", "imported").alias("target"), F.col("own").isNull().alias("is_reexport"), (F.col("own").isNull() & F.col("imported").isNull()).alias("needs_linking"))


def expanded(exports: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """exports(module, name, target) with what star imports add: (module, name, target, provider, depth).

    sources: (module, source, turn), turn being the place of a star import.  A
    name that a module exports itself is kept; of its star imports the first that
    has a name provides it.  Names spread from round to round until none is new
    (or for ``rounds`` rounds), so chains and cycles of star imports are followed to their end.
    """
    from spanwright.runtime import written

    known = written(exports.where("name is not null").groupBy("module", "name").agg(F.min("target").alias("target")).withColumn("provider", F.col("module")).withColumn("depth", F.lit(0)), "exports")
    links = sources.where("module <> source").groupBy("module", "source").agg(F.min("turn").alias("turn"))
    all_, level = [known], 0
    while rounds is None or level < rounds:
        level += 1
        offered = all_[-1].select(F.col("module").alias("source"), "name", "target").join(links, "source")
        best = first_wins(offered.select("module", "name", "turn", "source", "target"), ["module", "name"], ["turn", "source"])
        seen = reduce(DataFrame.unionByName, all_).select("module", "name")
        new = written(best.join(seen, ["module", "name"], "left_anti").select("module", "name", "target", F.col("source").alias("provider"), F.lit(level).alias("depth")), "exports")
        if new.isEmpty():
            break
        all_.append(new)
    return reduce(DataFrame.unionByName, all_)


def linked(exports: DataFrame, pointers: DataFrame) -> DataFrame:
    """exports with ``final``: the target followed through pointers(name, target) to a definition; a broken chain leaves the target as it is."""
    ends = G.pointer_targets(pointers).where("not broken").select(F.col("name").alias("target"), F.col("target").alias("end"))
    return exports.join(ends, "target", "left").withColumn("final", F.coalesce("end", "target")).drop("end")


# scores


def _private(module: str | Column, names: list[str]) -> Column:
    return F.exists(parts(module), lambda p: p.startswith("_") | p.isin(*names))


def target_score(module: str | Column, is_init: Column) -> Column:
    """How good a module is as the public home of a member: the root far before all, shallow before deep, packages before modules, private ones last."""
    # fixed values: 500 for a root, 10 a level, 40 for a package, 200 off for private names
    dots = F.size(parts(module)) - 1
    private = _private(module, ["_internal", "impl", "private", "utils", "helpers", "compat", "tests", "examples"])
    return F.when(dots == 0, 500.0).otherwise(dots * -10.0) + F.when(is_init, 40.0).otherwise(0.0) - F.when(private, 200.0).otherwise(0.0)


def boundary_score(s: dict[str, Column], module: str | Column = "module") -> Column:
    """How much a module looks like a boundary of an API, from its statistics: at least 0.1.

    s: is_init, export_import_ratio, external_import_ratio, reexport_ratio, has_all, has_docstring.
    """
    # fixed values: weights, thresholds and caps
    def capped(ratio: Column, above: float, factor: float, most: float) -> Column:
        return F.when(ratio > above, F.least(ratio * factor, F.lit(most))).otherwise(0.0)

    depth = F.size(parts(module)) - 1
    by_depth = F.when(depth <= 1, 2.0 - depth * 0.5).when(depth > 3, -F.least((depth - 3) * 0.5, F.lit(1.5))).otherwise(0.0)
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    score = flag(s["is_init"], 5.0) + capped(s["export_import_ratio"], 1.5, 0.5, 3.0) + capped(s["external_import_ratio"], 0.3, 2.0, 2.0) + capped(s["reexport_ratio"], 0.2, 3.0, 3.0)
    score = score + flag(s["has_all"], 2.0) + flag(s["has_docstring"], 1.0) + by_depth - flag(_private(module, ["impl", "internal", "private", "utils", "helpers", "tests", "examples", "compat"]), 3.0)
    return F.greatest(F.lit(0.1), score + 1.0)


def chain_score(chain: str | Column) -> Column:
    """Score of an export chain: array of (module, boundary, explicit, how), from the definition to the public end."""
    # fixed values: 20 at the start, half off a step, boundaries weighted by place, bonuses and penalties
    c = col(chain)
    n = F.size(c)
    each = F.transform(c, lambda x, i: x["boundary"] / 10 * (i + 1) / n * 2 + F.when(x["explicit"], 1.0).otherwise(0.0) - F.when(x["how"] == "wildcard", 2.0).when(x["how"] == "alias", 0.5).otherwise(0.0) + F.when(x["module"].endswith("__init__"), 0.5).otherwise(0.0))
    last = F.try_element_at(c, F.lit(-1))
    total = 20.0 - n * 0.5 + F.aggregate(each, F.lit(0.0), lambda a, b: a + b) + F.when(last["boundary"] > 7, 5.0).otherwise(0.0) + F.when(last["explicit"], 1.0).otherwise(0.0)
    return F.when(n > 0, F.greatest(F.lit(0.1), total)).otherwise(F.lit(0.0))


def module_paths(edges: DataFrame, allowed: DataFrame, pairs: DataFrame, max_nodes: int = 10) -> DataFrame:
    """(module, definition, path): simple paths from a public module down to the defining one over import edges, inner modules being re-exporters.

    edges: (src, dst), src imports dst; allowed: (target, module); pairs: (target, module, definition).  The bound is the operator's.
    """
    ok = allowed.select("target", F.col("module").alias("next"))
    level = pairs.where("module <> definition").select("target", "module", "definition", F.array("module").alias("path"), F.col("module").alias("at"))
    done = []
    for _ in range(max_nodes - 1):
        step = level.join(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").where("not array_contains(path, next)").withColumn("path", F.concat("path", F.array("next"))).drop("at")
        done.append(step.where("next = definition").select("target", "module", "definition", "path"))
        level = step.where("next <> definition").join(ok, ["target", "next"], "left_semi").withColumnRenamed("next", "at")
    return reduce(DataFrame.unionByName, done)
