"""Every query of the core that has an oracle gives the oracle's rows on the smallest tables."""

import glob
import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

MODULES = [importlib.import_module(name) for name in entry._PLANS]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "null" if v is None else round(v, 5) if isinstance(v, float) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


#: least rows of the queries without SQL on the smallest tables, and what must hold for each row
ROWS = {
    "accuracy": (150, lambda r: 0 <= r.score <= 1 and (r.drift is None or 0 <= r.drift <= 1)),
    "accuracy_issues": (100, lambda r: r.code.startswith("ACC_") and r.severity),
    "anchors_on_pages": (2, lambda r: r.n > 0),
    "best_definition_line": (50, lambda r: r.score > 0 or r.score == -20 or r.line_no >= 0),
    "call_resolution": (1, lambda r: r.how in ("module", "import", "local", "self", "super", "class", "unresolved") and r.n > 0),
    "contextual_sections": (5, lambda r: r.text),
    "example_metrics": (50, lambda r: 0 <= r.score <= 1 and r.loc > 0),
    "grounding": (50, lambda r: r.grounded + r.partial <= r.n_units),
    "import_classes": (1, lambda r: r.n > 0),
    "ingested_inherited": (5, lambda r: r.member_name),
    "ingested_members": (100, lambda r: r.fully_qualified_name and r.id != r.parent_id),
    "ingested_signatures": (50, lambda r: r.variant),
    "joined_signatures": (0, lambda r: r.n_lines > 1),
    "maintainability": (150, lambda r: 0 <= r.score <= 1),
    "member_spans": (0, lambda r: r.end_line >= r.start_line),
    "mended_documents": (150, lambda r: r.candidate and r.n_applied >= 0),
    "omitted_units": (1, lambda r: r.kind in ("omitted", "partial") and r.unit),
    "overall_scores": (900, lambda r: 0 <= r.overall <= 1 and (not r.skipped or r.overall == 0)),
    "overload_categories": (1, lambda r: r.overload in ("primary", "secondary", "specific")),
    "patch_counts": (3, lambda r: r.strategy in ("db_query", "ast_derived")),
    "pending_candidates": (10, lambda r: r.id % 2 == 1 and r.n_applied > 0),
    "p6_components": (200, lambda r: r.item_key and r.parent_key),
    "p6_found": (1000, lambda r: r.entity),
    "p6_levels": (50, lambda r: r.n_present <= r.n_real <= r.n_entries and r.max_rep <= r.max_def),
    "p6_parameters": (200, lambda r: r.item_key is None or r.item_key.startswith(r.parent_key + ":")),
    "p6_signatures": (200, lambda r: r.item_key),
    "quality_summary": (4, lambda r: 0 <= r.mean <= 1 and 0 <= r.median <= 1),
    "readability_grades": (100, lambda r: 0 <= r.score <= 1),
    "section_match_scores": (50, lambda r: r.score <= 250),
    "signature_drift": (100, lambda r: 0 <= r.drift <= 1),
    "similar_lines": (50, lambda r: r.line_no >= 0),
    "similar_names": (1, lambda r: r.score > 60 and r.rank <= 3),
    "source_call_graph": (0, lambda r: r.n > 0),
    "source_components": (5, lambda r: r.n_documented <= r.n),
    "source_imports": (1, lambda r: r.kind in ("own", "standard", "other")),
    "text_windows": (90, lambda r: r.end_char > r.start_char),
    "unused_imports": (1, lambda r: r.n_unused <= r.n_imports),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, small, name):
    least, holds = ROWS[name]
    got = QUERIES[name](spark, small).collect()
    assert len(got) >= least and all(holds(r) for r in got)
