"""Distributed prefix sums: running totals within groups of any size.

Rows are range-sorted by (group, order), so a group may lie over many
partitions and no group is ever gathered in one task.  Each partition sums its
own rows; what the driver sees is one line per partition (its first and last
group and the total of the last group's rows), from which it works out what
each partition's first group has had before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.runtime import shuffle_partitions, written

_SUMMARY = "pid int, first_group long, last_group long, tail double, whole boolean"


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over earlier rows of the same group (exclusive).

    group: a long column without nulls; order: columns giving a total order
    within the group; value: a long column (null counts 0).  The result is a
    written table, so it is the same however often it is read.
    """
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType()), T.StructField("__pid", T.IntegerType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, carry = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            v = batch.column(batch.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            before = np.cumsum(v) - v
            base = before[starts]
            if last is not None and g[0] == last:
                base[0] -= carry
            own = before - np.repeat(base, np.diff(np.r_[starts, len(g)]))
            last, carry = g[-1], int(own[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(np.full(len(g), pid, np.int32))], schema=pa.schema([*batch.schema, pa.field(out, pa.int64()), pa.field("__pid", pa.int32())]))

    placed = written(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).mapInArrow(local, schema), "prefix")
    edges = (
        placed.groupBy("__pid")
        .agg(F.min(group).alias("first_group"), F.max(group).alias("last_group"), F.max_by(F.col(out) + F.coalesce(value, F.lit(0)), F.struct(group, F.col(out), F.coalesce(value, F.lit(0)))).alias("tail"))
        .orderBy("__pid")
        .collect()  # one row per partition
    )
    carried, had, last = {}, 0, None
    for e in edges:
        if e["first_group"] == last and had:
            carried[e["__pid"]] = (e["first_group"], had)
        had = e["tail"] + (had if e["first_group"] == e["last_group"] == last else 0)
        last = e["last_group"]
    if carried:
        extra = F.create_map(*[F.lit(x) for p, (g, c) in carried.items() for x in (p, c)])
        first = F.create_map(*[F.lit(x) for p, (g, _) in carried.items() for x in (p, g)])
        is_first = F.try_element_at(first, F.col("__pid")) == F.col(group)
        placed = placed.withColumn(out, F.col(out) + F.when(is_first, F.try_element_at(extra, F.col("__pid"))).otherwise(F.lit(0)))
    return placed.drop("__pid")
