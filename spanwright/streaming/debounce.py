"""Debounce of file events, as a batch operator and as a stream.

Within a key (user_id, event_type) an event cancels the one before if it comes
within the quiet period; only the last of a burst fires.  The stream keeps a
session window per key and emits it once the watermark has passed its end, so
events later than the allowed delay are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def debounced(events: DataFrame, quiet: str) -> DataFrame:
    """(user_id, event_type, fired_at, event_id, n_events): one row per burst.

    Bursts are session windows, whose gap is exclusive, so one microsecond is
    added to make events exactly ``quiet`` apart belong together.
    """
    gap = F.session_window("ts", f"{quiet} 1 microsecond")
    out = events.where("ts is not null").groupBy("user_id", "event_type", gap.alias("w")).agg(F.max("ts").alias("fired_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_events"))
    return out.drop("w")


def debounced_stream(spark: SparkSession, folder: str, schema, quiet: str, delay: str) -> DataFrame:
    """The same over a folder of Parquet files as a stream; rows come once no earlier event can."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", delay)
    return debounced(events, quiet)


def invalidated(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): what a change of some nodes makes stale: they and all that depend on them (edges src -> dst: src depends on dst)."""
    from spanwright.operators.graph import bfs

    return changed.select("node").union(bfs(edges, changed, reverse=True).select("node")).distinct()


def apply_changes(current: DataFrame, changes: DataFrame, key: str = "path", when: str = "ts") -> DataFrame:
    """Upsert by key: the latest change wins, rows of kind ``deleted`` go; for use in ``foreachBatch``."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), when).alias("r")).select(key, "r.*")
    kept = current.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("kind <> 'deleted'").select(*current.columns))
