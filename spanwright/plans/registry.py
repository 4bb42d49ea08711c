"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects a module's queries and the SQL that gives the same rows, where there is any."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql:
                self.oracles[function.__name__] = sql
            return function

        return add


#: SQL for the current row of each member, each module and each export once.
CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, md5(coalesce(docstring, '')) DESC, primary_api_name DESC NULLS LAST, doc_format DESC NULLS LAST) AS rn FROM members WHERE id IS NOT NULL) WHERE rn = 1)"
MODS = "mods AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS rn FROM modules WHERE id IS NOT NULL) WHERE rn = 1)"
EXPS = "exps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exported_name) AS rn FROM exports WHERE id IS NOT NULL) WHERE rn = 1)"
INH = "inh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY member_name) AS rn FROM inherited_members WHERE id IS NOT NULL) WHERE rn = 1)"
#: SQL predicate: the text says something.
PRESENT = "({0} IS NOT NULL AND trim({0}) <> '' AND upper(trim({0})) NOT IN ('N/A', 'NA', 'NONE', 'NULL', 'TBD'))"
