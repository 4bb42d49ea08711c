"""Lexical and vector search over texts: needles, lines, windows, rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.functions.columns import col, occurrences


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): one row per line; null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def needle_hits(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """(doc_id, needle, n): documents that hold a needle as a whole word, and how often.

    Words of the documents are joined to the needles, so the cost follows the
    words there are and not documents times needles.
    """
    words = docs.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z_0-9]*)"), 1)).alias("needle"))
    return words.join(needles.select("needle").distinct(), "needle", "left_semi").groupBy("doc_id", "needle").agg(F.count("*").alias("n"))


def density(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, hits, per_1000): occurrences of a literal per thousand characters."""
    n = occurrences("text", F.lit(needle))
    return docs.select("doc_id", n.alias("hits"), F.coalesce(F.round(F.try_divide(n * 1000.0, F.length("text")), 6), F.lit(0.0)).alias("per_1000"))


def query_blocks(queries: DataFrame, size: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of a stated query set in blocks of ``size``, in order of their ids; a block is what a task is sent.

    The ids come over once; each block is then read by its range of ids.
    """
    ids = [r[0] for r in queries.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").toLocalIterator()]
    for at in range(0, max(1, len(ids)), size):
        part = ids[at : at + size]
        rows = queries.where(F.col("vec_id").between(part[0], part[-1]) & F.col("embedding").isNotNull()).select("vec_id", "embedding").dropDuplicates(["vec_id"]).orderBy("vec_id").collect() if part else []  # at most ``size``
        q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))
        norm = np.linalg.norm(q, axis=1, keepdims=True) if len(rows) else q
        yield np.array([r[0] for r in rows], np.int64), np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): exact k nearest by cosine of a stated query set against all vectors.

    The query set is sent to all tasks in blocks; each task keeps the k best of its
    rows per query before anything is shuffled.  Vectors without an id or values take no part.
    """
    out = None
    for ids, unit in query_blocks(queries):

        def best(frames: Iterator[pd.DataFrame], ids=ids, unit=unit) -> Iterator[pd.DataFrame]:
            scores = np.full((len(ids), 0), -np.inf)
            found = np.zeros((len(ids), 0), np.int64)
            for pdf in frames:
                if not len(pdf) or not len(ids):
                    continue
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                sims = np.round(unit @ np.divide(x, n, out=np.zeros_like(x), where=n > 0).T, 9)
                vec = np.broadcast_to(pdf["vec_id"].to_numpy(), sims.shape)
                sims[vec == ids[:, None]] = -np.inf  # a vector is no neighbour of itself
                scores, found = np.hstack([scores, sims]), np.hstack([found, vec])
                order = np.lexsort((found, -scores), axis=1)[:, :k]
                scores, found = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
            kept = np.isfinite(scores)
            rows = np.broadcast_to(ids[:, None], scores.shape)
            yield pd.DataFrame({"query_id": rows[kept], "vec_id": found[kept], "score": scores[kept]})

        part = vectors.where("embedding is not null and vec_id is not null").select("vec_id", "embedding").mapInPandas(best, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
