"""Shared pieces: stored intermediate tables, bounded filters, joins with hot keys, pickling."""

from __future__ import annotations

import ctypes
import sys
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.membership import maybe_member  # noqa: F401  (for the operators)
from ..session import configure, materialize, shared_dir

# A key with more than one in so many rows is joined by broadcast; fewer than this
# many keys can hold that share, however large the table is.
HOT_SHARE = 1024

store = materialize
new_folder = shared_dir


def release_memory() -> None:
    """Return what numpy and Arrow have freed to the system; the C library keeps small pieces otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # absent outside glibc
    if trim is not None:
        trim(0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ship(*modules: ModuleType) -> None:
    """Send functions of these modules to executors by value: they need no copy of the package."""
    for module in modules:
        cloudpickle.register_pickle_by_value(module)


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """Join ``facts``, one row per key with the number of its rows in ``count``, to ``rows``.

    Keys with more than 1/1024 of the rows, at most 1023 of them, are joined by broadcast:
    their rows are not moved.  The others go through an ordinary join.  Keys are not null;
    ``rows`` and ``facts`` are stored tables, as both are read twice.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    share = max(total // HOT_SHARE, 1)
    hot = facts.where(F.col(count) > share)
    by_broadcast = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return by_broadcast.unionByName(rest.join(facts.where(F.col(count) <= share), keys, how))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the row's place in ``order``, from 0, without sorting in one task.

    Rows are cut into ranges; each range is numbered by itself and starts where the ranges
    before it end.  Only one count per range meets in one task.
    """
    ranges = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges = store(ranges)
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    placed = ranges.withColumn("_at", inside).join(F.broadcast(starts), "_range")  # one row per range
    return placed.withColumn(name, F.col("_start") + F.col("_at") - 1).drop("_start", "_at", "_range")


def map_batches(rows: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches that stay small when texts are long."""
    configure(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``docs`` in the struct ``_row``, beside ``extra`` ones, whatever they are called."""
    return docs.select(F.struct(F.col("*")).alias("_row"), *[c.alias(name) for name, c in extra.items()])


def text_hash(column: str) -> Column:
    return F.xxhash64(text_of(column))


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id and ``text_hash`` are in ``dropped(id, hash)``, a stored table.

    Only rows that may be dropped are moved; the others pass in place.
    """
    rows = packed(docs, _id=F.col(id_col), _hash=text_hash(text_col))
    keys = [F.col("_id"), F.col("_hash")]
    marked = maybe_member(rows, keys, dropped, [F.col("id"), F.col("hash")], "_maybe")
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash"))
    tested = marked.where("_maybe").join(dropped, same, "left_anti")
    return marked.where("NOT _maybe").unionByName(tested).select("_row.*")
