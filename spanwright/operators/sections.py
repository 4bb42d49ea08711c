"""Documents as section trees, fenced code, and the text between anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanwright.operators.textsearch import lines


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title) of Markdown headings outside fenced code."""
    l = lines(docs).withColumn("fence", F.col("line").rlike(r"^\s*```").cast("int"))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    open_ = l.withColumn("inside", F.sum("fence").over(w) % 2)
    mark = F.regexp_extract("line", r"^(#{1,6})\s+", 1)
    return open_.where("inside = 0").select("doc_id", "line_no", F.length(mark).alias("level"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title")).where("level > 0")


def section_tree(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title, parent_line, end_line): the parent is the nearest earlier heading of a lower level.

    Six levels at most, so the nearest one per level is carried in six running columns.
    """
    h = headings(docs)
    w = W.partitionBy("doc_id").orderBy("line_no")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    for k in range(1, 6):
        h = h.withColumn(f"l{k}", F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(before))
    up = F.greatest(*[F.when(F.col("level") > k, F.col(f"l{k}")) for k in range(1, 6)])
    total = docs.where("text is not null").select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    nxt = F.lead("line_no").over(w)
    return h.withColumn("parent_line", up).withColumn("next", nxt).join(total, "doc_id").select("doc_id", "line_no", "level", "title", "parent_line", (F.coalesce("next", "n_lines") - 1).alias("end_line"))


def fenced_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_code): lines inside code fences."""
    l = lines(docs).withColumn("fence", F.col("line").rlike(r"^\s*```").cast("int"))
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return l.withColumn("inside", F.sum("fence").over(w) % 2).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.when((F.col("inside") == 1) & (F.col("fence") == 0), 1).otherwise(0)).alias("n_code"))


def repeated_lines(docs: DataFrame, group: str, least: int) -> DataFrame:
    """(group, line, n): lines that stand in at least so many documents of a group: headers, footers and the like."""
    each = docs.where("text is not null").select(group, "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    norm = F.regexp_replace(F.lower(F.trim("line")), "[0-9]+", "#")
    return each.select(group, "doc_id", norm.alias("line")).where("line <> ''").distinct().groupBy(group, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
