"""Row numbers and top lists that do not gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def number_within(rows: DataFrame, group: list[str], order: list[str], name: str, facts: DataFrame | None = None) -> DataFrame:
    """``row_number`` over ``group`` in ``order``, for groups of any size.

    The rows are moved once: range-partitioned by group and order, which splits a large
    group over many tasks, sorted, and written.  A row's place in its file is then known;
    one row per group and file says at which number the group begins there.  These few
    rows, with the columns of ``facts`` (one row per group) if given, are joined once.
    """
    path = shared_dir(rows.sparkSession)
    rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).write.parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    stored = stored.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    pieces = stored.groupBy(*group, "_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("int")
    earlier = Window.partitionBy(*group).orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    begins = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    if facts is not None:
        begins = begins.join(facts, group)
    numbered = stored.join(begins, [*group, "_file"])
    return numbered.withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def first_rows(rows: DataFrame, group: list[str], order: list[str | Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered.  Spark limits each group map-side
    before the shuffle, so at most ``k`` rows per group and task travel."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn(name, number).where(F.col(name) <= k)
