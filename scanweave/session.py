"""Session settings, shared storage and input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 128 << 20
MIN_SPLITS = "spark.sql.files.minPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Settings the engine relies on; all are session settings."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Whole files go through Arrow batches: keep a batch well below executor memory.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    }.items():
        spark.conf.set(key, value)
    return spark


def deal_splits(spark: SparkSession) -> SparkSession:
    """Read tables in at least four splits a core, unless the session sets a number.

    Matching takes seconds per megabyte and core: with one or two splits of 128 MB a core, most
    cores would wait for the last ones.  Larger tables have more splits anyhow.
    """
    if spark.conf.get(MIN_SPLITS, None) is None:
        spark.conf.set(MIN_SPLITS, str(4 * spark.sparkContext.defaultParallelism))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the storage the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to this machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = os.path.join(tempfile.gettempdir(), "scanweave")
    return f"{base.rstrip('/')}/{_run_name(spark)}/{uuid.uuid4().hex}"


def _run_name(spark: SparkSession) -> str:
    """All folders of an application lie in one folder."""
    return f"scanweave-{spark.sparkContext.applicationId}"


def drop_run(spark: SparkSession) -> None:
    """Delete every intermediate table this application has written; results that read them end with it."""
    from pyarrow import fs

    where = shared_dir(spark).rpartition("/")[0]
    system, path = fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write a result once to shared storage and read it back.

    Cuts the lineage, so that several uses do not repeat the scan, and survives the
    loss of executors.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small table that arrived in few file splits.

    The size is checked: an input large enough to fill the cores is left alone, since
    moving its content would cost more than it gains.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size < cores * SPLIT_BYTES else df
