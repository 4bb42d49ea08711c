"""Is what a document says grounded in its source, and what of the source is missing?

Units are sentences of the description.  A unit is grounded if it stands in the
source word for word after normalising, or aligns with it by a ratio of at least
``EXACT``; above ``PARTIAL`` it is partly grounded.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# fixed values: thresholds
EXACT, PARTIAL = 0.995, 0.75


def canonical(text: str | None) -> str:
    """NFKC, plain quotes, wrapped words joined, white space collapsed, lower case."""
    t = unicodedata.normalize("NFKC", text or "").translate(str.maketrans("‘’“”–—", "''\"\"--"))
    return " ".join(re.sub(r"(\w)-\n\s*(\w)", r"\1\2", t).lower().split())


def units(text: str | None) -> list[str]:
    return [u.strip() for u in re.split(r"(?<=[.!?])\s+|\n{2,}", text or "") if u.strip()]


def alignment(unit: str, source: str) -> float:
    """1 for a substring, else the best ratio of the unit with an equally long stretch of the source."""
    if not unit:
        return 1.0
    if unit in source:
        return 1.0
    m = difflib.SequenceMatcher(None, source, unit, autojunk=False).find_longest_match()
    start = max(0, m.a - m.b)
    return difflib.SequenceMatcher(None, source[start : start + len(unit)], unit, autojunk=False).ratio()


def grounding(pairs: DataFrame) -> DataFrame:
    """(id, n_units, grounded, partial, score) of (id, doc, source); an absent source leaves score null, an absent doc has no units."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, doc, source in zip(pdf["id"], pdf["doc"], pdf["source"]):
                us, src = [canonical(u) for u in units(doc)], canonical(source) if isinstance(source, str) else None
                ratios = [alignment(u, src) for u in us] if src is not None else []
                full, part = sum(r >= EXACT for r in ratios), sum(PARTIAL <= r < EXACT for r in ratios)
                rows.append((key, len(us), full, part, round((full + 0.5 * part) / len(us), 6) if us and src is not None else None))
            yield pd.DataFrame(rows, columns=["id", "n_units", "grounded", "partial", "score"]).astype({"score": "Float64"})

    return pairs.select("id", "doc", "source").mapInPandas(run, "id long, n_units long, grounded long, partial long, score double")


# fixed values: looser bounds for what a description leaves out, and the shortest unit that counts
COVERED, HALF_COVERED, LEAST_CHARS = 0.90, 0.55, 12


def omissions(pairs: DataFrame) -> DataFrame:
    """(id, unit_no, unit, kind) of (id, doc, source): sentences of the source that the description leaves out (``omitted``) or
    half covers (``partial``); a null source or description gives none, headings and very short units do not count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, doc, source in zip(pdf["id"], pdf["doc"], pdf["source"]):
                if not isinstance(doc, str) or not isinstance(source, str):
                    continue
                told = canonical(doc)
                for no, unit in enumerate(units(source)):
                    u = canonical(unit)
                    if len(u) >= LEAST_CHARS and not unit.startswith("#"):
                        r = alignment(u, told)
                        if r < COVERED:
                            rows.append((key, no, unit, "partial" if r >= HALF_COVERED else "omitted"))
            yield pd.DataFrame(rows, columns=["id", "unit_no", "unit", "kind"])

    return pairs.select("id", "doc", "source").mapInPandas(run, "id long, unit_no long, unit string, kind string")
