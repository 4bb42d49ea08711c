"""Session helpers: tables, the shared folder, cutting lineage, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spanwright", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the defaults that tests and benchmarks use."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it has less than half as many partitions, as small files of one row group have.

    Larger inputs, whose scan already fills the cores, pass through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made if driver and executors are one
    machine (tests, a laptop); on a cluster that would lose rows, so it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spanwright-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    Unlike executor-local copies the table survives the loss of any executor, and
    unlike an RDD checkpoint it is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanwright/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanwright_path = path
    return out


def written_view(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table made by ``written``, which ``discard`` can still delete."""
    out = df.select(*columns)
    out._spanwright_path = df._spanwright_path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._spanwright_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file; the folder is $SPANWRIGHT_TOKENIZERS or /opt/tokenizers."""
    return os.path.join(os.environ.get("SPANWRIGHT_TOKENIZERS", "/opt/tokenizers"), name)
