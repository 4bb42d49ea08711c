"""Queries of the llm operators; ``__spark_entry__`` adds them if this subpackage is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import boilerplate, docpairs, mixing, origin, packing, sentences, tokens, validity
from spanwright.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_lines(table(spark, sf_dir, "scraped_docs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.invalid_files(table(spark, sf_dir, "source_files"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.invalid_rates(table(spark, sf_dir, "source_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.foreign_files(*(table(spark, sf_dir, t) for t in ("source_files", "libraries", "exclude_patterns")))


def p4_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin.validation(*(table(spark, sf_dir, t) for t in ("source_files", "libraries", "exclude_patterns")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf_dir, "source_files"), with_text=False)


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf_dir, "source_files"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(tokens.sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_runs"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(tokens.sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_runs"))


def p7_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: containers, and those that hold both of the two sources that were to be kept apart (the first two by name): none."""
    sized = tokens.sized_documents(table(spark, sf_dir, "documents"))
    two = [r[0] for r in sized.where("source is not null").select("source").distinct().orderBy("source").limit(2).collect()]  # two names
    apart = frozenset({frozenset(two)}) if len(two) == 2 else frozenset()
    placed = packing.packed(sized, table(spark, sf_dir, "pack_runs"), apart)
    own = sized.select("doc_id", "source")
    bins = placed.join(own, "doc_id").groupBy("run_id", "bin_id").agg(F.count_distinct(F.when(F.col("source").isin(*two), F.col("source"))).alias("of_two"))
    return bins.groupBy("run_id").agg(F.count("*").alias("n_bins"), F.count_if(F.col("of_two") > 1).alias("n_mixed"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(tokens.sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(tokens.sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_rates, p4_found, p4_validation, p5_found, p5_pairs, p7_pack, p7_report, p7_apart, p8_mix, p8_shares, p9_found)}
ORACLES: dict[str, str] = {}
