"""Readers and writers: source trees, JSON, CSV, Parquet, JSON lines; content-keyed caches."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.columns import module_from_path
from spanwright.runtime import shuffle_partitions


def source_tree(spark: SparkSession, folder: str, glob: str = "*.py", exclude: str | None = None, partitions: int | None = None) -> DataFrame:
    """(path, module, content, n_bytes) of the files below a folder or URI, read whole by the executors.

    ``exclude`` is a regex on the path.  Spark's own file sources skip names that
    begin with an underscore, ``__init__.py`` among them, so only the listing (names,
    no contents) is made here, as Spark's would be made on the driver.
    """
    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), os.path.abspath(folder))
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, glob)]
    listed = spark.createDataFrame([(n,) for n in names if not (exclude and re.search(exclude, n))], "path string").repartition(partitions or shuffle_partitions(spark))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([path[len(root.rstrip("/")) + 1 :]]), pa.array([data.decode("utf-8", "replace")]), pa.array([len(data)], pa.int64())], names=["path", "inside", "content", "n_bytes"])

    return listed.mapInArrow(read, "path string, inside string, content string, n_bytes long").select("path", module_from_path("inside").alias("module"), "content", "n_bytes")


def excluded(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file_id, pattern): files under a pattern of their own library; the patterns are a fixed table."""
    p = F.replace(F.regexp_replace("file_path", r"^(\./)+", ""), F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(p, "/"), -1)
    like = F.concat(F.lit("^"), F.replace(F.replace(F.col("pattern"), F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))
    hit = F.when(F.col("pattern_kind") == "dir", F.concat(F.lit("/"), p).contains(F.concat(F.lit("/"), F.col("pattern")))).otherwise(F.regexp(name, like))
    return files.join(F.broadcast(patterns.distinct()), "library").where(hit).select("file_id", "pattern").distinct()  # a fixed table


def project_metadata(tables: DataFrame) -> DataFrame:
    """(library, name, version, n) of packaging tables (library, file_id, file_path, content): what a project file says before what others say."""
    field = lambda name: F.regexp_extract("content", rf'(?m)^{name}\s*=\s*"([^"]+)"', 1)
    t = tables.select("library", "file_id", field("name").alias("name"), field("version").alias("version"), F.when(F.lower("file_path").endswith("pyproject.toml"), 0).otherwise(1).alias("tier")).where("name <> '' and version <> ''")
    return t.groupBy("library").agg(F.min_by(F.struct("name", "version"), F.struct("tier", "file_id")).alias("r"), F.count("*").alias("n")).select("library", "r.name", "r.version", "n")


def cache_key(*cols: str):
    """sha-256 of the columns' texts."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def not_cached(files: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Files whose content is not in the cache yet."""
    return files.join(cache.select(key).distinct(), key, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat CSV with a header; nested columns are written as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def append_new(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet: write-once snapshots."""
    return df.join(existing.select(key), key, "left_anti").dropDuplicates([key])
