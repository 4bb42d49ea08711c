"""Filling fixed-capacity containers: conflict-constrained best fit.

Within a bucket of items, open bins are kept in order of their residual space.
An item (largest first) looks for its successor in that order, the tightest bin
that holds it, and goes on until a bin is compatible: each bin carries a bitmap of
the sources in it and one of its duplicate clusters (64 signs, confirmed against
the exact set), so copies of one text never share a container, nor do sources
named as apart.

Buckets are made by hash and bounded in tokens, so no task gets more than its
share whatever the sources' sizes.  What a bucket leaves open (bins less than
``GOOD_FILL`` full) is taken apart and packed again in ever fewer buckets, until
one is left, nothing is loose, or a round leaves as many loose tokens as it found.

Only items longer than the capacity are split: into whole containers and a rest,
which is an item like any other.

Defined results: null and empty texts have no tokens and lie in some container at
no cost; runs with a null or non-positive capacity give nothing; a source in any
spelling is the same source; a run of a source without documents has no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.tokens import source_name
from spanwright.runtime import written

#: Containers per bucket that a task fills at most, about.
BINS_PER_BUCKET = 4000
#: A container filled at least so far is not opened again.
GOOD_FILL = 0.98
_OUT = "run_id int, capacity int, bin_id string, doc_id long, piece_no int, start_token long, n_tokens long, source string, copy_of string, bin_fill long"


def best_fit(sizes: list[int], sources: list[str | None], copies: list[int | None], capacity: int, apart: frozenset[frozenset[str]] = frozenset()) -> list[int]:
    """The bin of each item; items are placed largest first, ties by position."""
    number = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    foes = [0] * len(number)
    for a, b in (tuple(pair) for pair in apart if len(pair) == 2):
        if a in number and b in number:
            foes[number[a]] |= 1 << number[b]
            foes[number[b]] |= 1 << number[a]
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    open_bins: list[tuple[int, int]] = []  # (residual, bin), in order
    has_source: list[int] = []
    cluster_bits: list[int] = []
    clusters: list[set[int]] = []
    out = [0] * len(sizes)
    for k in order:
        size, src, copy = sizes[k], number[sources[k]], copies[k]
        sign, at = 0 if copy is None else 1 << (copy & 63), bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (foes[src] & has_source[b]) and not (cluster_bits[b] & sign and copy in clusters[b]):
                break
            at += 1
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(has_source)
            has_source.append(0)
            cluster_bits.append(0)
            clusters.append(set())
        out[k] = b
        has_source[b] |= 1 << src
        cluster_bits[b] |= sign
        if copy is not None:
            clusters[b].add(copy)
        if room > size:
            insort(open_bins, (room - size, b))
    return out


def _pack_bucket(items: pd.DataFrame, level: int, apart: frozenset) -> pd.DataFrame:
    items = items.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    run, capacity, bucket = int(items["run_id"].iat[0]), int(items["capacity"].iat[0]), int(items["bucket"].iat[0])
    sources = [None if pd.isna(s) else s for s in items["source"]]
    copies = [None if pd.isna(c) else int(c) for c in items["copy_of"]]
    bins = best_fit(items["n_tokens"].tolist(), sources, copies, capacity, apart)
    out = items.drop(columns="bucket")
    out["bin_fill"] = items["n_tokens"].groupby(bins).transform("sum")
    out["bin_id"] = [f"{run}-{level}-{bucket}-{b}" for b in bins]
    return out[["run_id", "capacity", "bin_id", "doc_id", "piece_no", "start_token", "n_tokens", "source", "copy_of", "bin_fill"]]


def _packer(level: int, apart: frozenset):
    return lambda pdf: _pack_bucket(pdf, level, apart)


def packed(sized: DataFrame, runs: DataFrame, apart: frozenset[frozenset[str]] = frozenset()) -> DataFrame:
    """(run_id, bin_id, doc_id, piece_no, start_token, n_tokens, bin_fill): every item's container, for every run."""
    wanted = F.broadcast(runs.where("run_id is not null and capacity > 0").groupBy("run_id").agg(F.max(F.struct("capacity", source_name().alias("run_source"))).alias("r")).select("run_id", "r.*"))  # a fixed table of a few rows
    items = sized.join(wanted, F.col("run_source").isNull() | (F.col("run_source") == F.col("source"))).select("run_id", "capacity", "doc_id", "source", F.col("copy_of").cast("string").alias("copy_of"), "n_tokens")
    long = F.col("n_tokens") > F.col("capacity")
    whole = F.when(long, F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("int")
    items = items.withColumn("whole", whole)
    full = items.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece_no")).select(
        "run_id", "capacity", F.concat_ws("-", F.col("run_id"), F.lit("full"), F.col("doc_id"), F.col("piece_no")).alias("bin_id"), "doc_id", "piece_no",
        (F.col("piece_no").cast("long") * F.col("capacity")).alias("start_token"), F.col("capacity").cast("long").alias("n_tokens"), "source", "copy_of", F.col("capacity").cast("long").alias("bin_fill"),
    )
    rest = items.where("whole = 0 or n_tokens > whole * capacity").select(
        "run_id", "capacity", "doc_id", F.col("whole").alias("piece_no"), (F.col("whole").cast("long") * F.col("capacity")).alias("start_token"), (F.col("n_tokens") - F.col("whole").cast("long") * F.col("capacity")).alias("n_tokens"), "source", "copy_of"
    )
    done, level, before = [full], 0, None
    while True:
        # a bucket holds some BINS_PER_BUCKET containers' tokens and at most 16 times as many items
        load = rest.groupBy("run_id").agg(F.greatest(F.ceil(F.sum("n_tokens") / (F.first("capacity") * F.lit(BINS_PER_BUCKET))), F.ceil(F.count("*") / F.lit(16 * BINS_PER_BUCKET)), F.lit(1)).alias("n_buckets"), F.sum("n_tokens").alias("loose"))
        found = load.collect()  # one row per run
        loads, loose = {r[0]: int(r[1]) for r in found}, {r[0]: int(r[2] or 0) for r in found}
        if not loads:
            break
        buckets = F.create_map(*[F.lit(x) for kv in loads.items() for x in kv])[F.col("run_id")]
        salted = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(level)), buckets).cast("long"))
        result = written(salted.groupBy("run_id", "bucket").applyInPandas(_packer(level, apart), _OUT), "packed")
        last = loose == before or all(n == 1 for n in loads.values())
        before = loose
        good = F.lit(True) if last else (F.col("bin_fill") >= GOOD_FILL * F.col("capacity")) | F.col("run_id").isin([r for r, n in loads.items() if n == 1])
        done.append(result.where(good))
        if last:
            break
        rest = result.where(~good).select(*rest.columns)
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("run_id", "bin_id", "doc_id", "piece_no", "start_token", "n_tokens", "bin_fill")


def packing_report(sized: DataFrame, runs: DataFrame, apart: frozenset[frozenset[str]] = frozenset()) -> DataFrame:
    """(run_id, capacity, n_docs, n_tokens, n_bins, least_bins, fill): least_bins is the bound by tokens alone."""
    placed = packed(sized, runs, apart)
    capacities = runs.groupBy("run_id").agg(F.max("capacity").alias("capacity"))
    bins = placed.groupBy("run_id", "bin_id").agg(F.sum("n_tokens").alias("used"))
    per_run = bins.groupBy("run_id").agg(F.count("*").alias("n_bins"), F.sum("used").alias("n_tokens"))
    docs = placed.select("run_id", "doc_id").distinct().groupBy("run_id").agg(F.count("*").alias("n_docs"))
    return per_run.join(docs, "run_id").join(F.broadcast(capacities), "run_id").select(
        "run_id", "capacity", "n_docs", "n_tokens", "n_bins", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6).alias("fill")
    )
