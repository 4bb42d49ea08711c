"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by source and
key, and distributed prefix sums of their tokens tell each one where it stands in
its source.  A mix takes a source's documents floor(budget / size) times whole and
once more those that stand before the rest of the budget, so a source's total
misses its budget by half a document at most, unless ``max_repeats`` ends it.

A source's budget is its weight's share of the weights' sum, times total_factor,
times the tokens of all documents (whatever their source).  What a source lacks is
not given to others; the shares reached are reported.

Defined results: documents without a source belong to no mix but count in the
total; empty texts have no tokens and are taken with their neighbours; a source
without documents, a null or negative weight, or max_repeats below 1 gives
nothing; of repeated target rows the greatest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.tokens import source_name
from spanwright.operators.prefix import prefix_sums
from spanwright.runtime import written


def _targets(targets: DataFrame) -> DataFrame:
    once = targets.where("mix_id is not null and source is not null").groupBy("mix_id", source_name().alias("source")).agg(
        F.max(F.struct(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("total_factor", F.lit(0.0)).alias("total_factor"))).alias("t")
    )
    sums = once.groupBy("mix_id").agg(F.sum("t.w").alias("all_w"))
    share = F.when(F.col("all_w") > 0, F.col("t.w") / F.col("all_w")).otherwise(F.lit(0.0))
    return once.join(sums, "mix_id").select("mix_id", "source", share.alias("target_share"), F.col("t.max_repeats").alias("max_repeats"), F.col("t.total_factor").alias("total_factor"))


def _plan(sized: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets with budgets, whole epochs and the rest; documents with their place in their source)."""
    stats = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    wanted = _targets(targets)  # a fixed table of a few rows
    plan = wanted.join(F.broadcast(stats.join(F.broadcast(wanted.select("source").distinct()), "source")), "source", "left").crossJoin(F.broadcast(total))  # one total
    budget = F.round(F.col("target_share") * F.col("total_factor") * F.col("all_tokens")).cast("long")
    size = F.coalesce("size", F.lit(0).cast("long"))
    whole = F.when(size > 0, F.floor(F.col("budget") / size)).otherwise(F.lit(0))
    plan = plan.withColumn("budget", budget).withColumn("whole", F.least(whole, F.col("max_repeats")).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.col("budget") - F.col("whole") * size).otherwise(F.lit(0)).cast("long"))
    sources = wanted.select("source").distinct().withColumn("source_no", F.xxhash64("source"))
    used = sized.join(F.broadcast(sources), "source").select("source", "source_no", F.xxhash64("doc_id", F.lit("mix")).alias("key"), "doc_id", "n_tokens")
    return plan, prefix_sums(used, "source_no", ["key", "doc_id"], "n_tokens", "before").select("source", "doc_id", "n_tokens", "before")


def mixed_documents(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, doc_id, n_uses, n_tokens): each document a mix uses and how often."""
    plan, placed = _plan(sized, targets)
    extra = (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    uses = F.col("whole") + F.when(extra, 1).otherwise(0)
    joined = placed.join(F.broadcast(plan.where("budget > 0 and max_repeats > 0").select("mix_id", "source", "whole", "rest")), "source")  # a few rows
    return joined.select("mix_id", "doc_id", "source", uses.alias("n_uses"), "n_tokens").where("n_uses > 0")


def mix_report(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, budget, n_docs, max_uses, tokens, actual_share) for every target row."""
    drawn = written(mixed_documents(sized, targets), "mix").groupBy("mix_id", "source").agg(F.count("*").alias("n_docs"), F.max("n_uses").alias("max_uses"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("tokens"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    wanted = _targets(targets).crossJoin(F.broadcast(total))  # one total
    wanted = wanted.withColumn("budget", F.round(F.col("target_share") * F.col("total_factor") * F.col("all_tokens")).cast("long"))
    joined = wanted.join(drawn, ["mix_id", "source"], "left")
    sums = drawn.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    zero = F.lit(0).cast("long")
    return joined.join(sums, "mix_id", "left").select(
        "mix_id", "source", F.round("target_share", 6).alias("target_share"), "budget", F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("max_uses", zero).alias("max_uses"), F.coalesce("tokens", zero).alias("tokens"),
        F.round(F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("actual_share"),
    )
