"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, rows: int) -> list:
    """About ``rows`` and at most twice as many rows, picked by the hash of ``key``, on the driver.

    The same ids are picked however the table is laid out; nothing is sorted or
    shuffled, so the texts that are not picked never leave their executors.
    """
    total = df.count()
    if total <= rows:
        return df.collect()  # at most ``rows``
    share = max(1, round(1_000_000 * rows / total))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share).limit(2 * rows).collect()
