"""The ``files`` table: ``(repo_id, path, content, size)``."""

from __future__ import annotations

from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_utf8
from ..operators.file_filters import WALK_SKIP
from ..session import materialize, shared_dir
from . import tree_reader

cloudpickle.register_pickle_by_value(tree_reader)

_LISTED = "repo_id STRING, path STRING, is_dir BOOLEAN, size BIGINT, modified BIGINT"
# Entries one task lists before it hands on the directories that are left.
LIST_BUDGET = 20_000
# Bytes of content one task reads, about.
READ_BYTES = 64 << 20


def list_tree(
    spark: SparkSession, root: str, prune: bool = True, repos: DataFrame | None = None, tasks: int | None = None,
    budget: int = LIST_BUDGET,
) -> DataFrame:
    """``(repo_id, path, size, modified)`` of all files below ``root``, as a stored table.

    Spark's own file sources leave out names that start with a dot, which here are some of the
    most telling files, so directories are listed in tasks, in rounds.  A task walks down from
    its directories until it has listed ``budget`` entries; what is left is dealt out anew in the
    next round, so one huge directory, however deep, is walked by many tasks.  Skipped
    directories are not entered, and links are not followed.  The repositories are the
    directories in ``root``, or the names in ``repos(repo_id)``, which spares listing it.
    """
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    function = tree_reader.lister(root, WALK_SKIP if prune else [], budget)
    if repos is None:
        frontier = materialize(spark.createDataFrame([("", "")], "repo_id STRING, path STRING").mapInPandas(function, _LISTED))
    else:
        frontier = materialize(repos.selectExpr("repo_id", "'' AS path", "true AS is_dir", "0L AS size", "0L AS modified").distinct())
    rounds = [frontier]
    while not (todo := rounds[-1].where("is_dir")).isEmpty():
        rounds.append(materialize(todo.repartition(tasks, "repo_id", "path").mapInPandas(function, _LISTED)))
    listed = reduce(DataFrame.unionAll, rounds).where("NOT is_dir")
    return listed.select("repo_id", "path", "size", F.timestamp_micros("modified").alias("modified"))


def write_listing(spark: SparkSession, listing: DataFrame, log: str, version: int) -> None:
    """Store ``listing`` as a version of ``log``, in part files that hold about ``READ_BYTES`` of content each."""
    listing = materialize(listing)
    size = listing.agg(F.sum("size")).first()[0] or 0
    parts = max(size // READ_BYTES + 1, min(spark.sparkContext.defaultParallelism, 64))
    dealt = listing.repartition(int(parts), "repo_id", "path")
    dealt.write.mode("overwrite").parquet(f"{log}/version={version}")


def take_snapshot(spark: SparkSession, root: str, log: str, prune: bool = True, at: Column | None = None) -> int | None:
    """Write what has changed below ``root`` since the last snapshot as the next version of ``log``.

    A file is changed if its size or time is; one that is there no more is listed as gone.  The
    whole listing is kept beside, to be compared with the next.  Returns the version's number,
    or nothing if there is no change.  A snapshot that broke off is written anew.
    """
    done = tree_reader.finished_versions(log)
    version = done[-1] + 1 if done else 0
    full = f"{log}/full/snapshot={version}"
    list_tree(spark, root, prune).write.mode("overwrite").parquet(full)
    now = spark.read.parquet(full).withColumn("gone", F.lit(False))
    if done:
        before = spark.read.parquet(f"{log}/full/snapshot={version - 1}").withColumn("gone", F.lit(True))
        same = ["repo_id", "path", "size", "modified"]
        changed = now.join(before.select(same), same, "left_anti")
        left = before.join(now.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
        now = changed.unionByName(left)
    now = materialize(now.withColumn("taken", at if at is not None else F.current_timestamp()))
    if done and now.isEmpty():
        return None
    write_listing(spark, now, log, version)
    return version


def _source(reader, root: str, log: str, max_bytes: int | None):
    reader = reader.format("repository_files").option("root", root).option("log", log)
    return reader if max_bytes is None else reader.option("maxBytes", str(max_bytes))


def read_directory(
    spark: SparkSession, root: str, max_bytes: int | None = None, prune: bool = True, tasks: int | None = None,
    repos: DataFrame | None = None,
) -> DataFrame:
    """Repositories kept as sub-directories of ``root``, on any file system.

    The tree is listed by :func:`list_tree`; a data source then reads the listing's parts, so
    planning does not depend on the number of files.  Files that cannot be read, and larger
    files than ``max_bytes``, have null content: :func:`unread` tells them.
    """
    spark.dataSource.register(tree_reader.RepositoryFiles)
    log = shared_dir(spark)
    write_listing(spark, list_tree(spark, root, prune, repos, tasks).withColumn("gone", F.lit(False)), log, 0)
    read = _source(spark.read, root, log, max_bytes).load()
    return read.select("repo_id", "path", decode_utf8(F.col("content")).alias("content"), "size")


def follow_directory(spark: SparkSession, root: str, log: str, max_bytes: int | None = None) -> DataFrame:
    """The snapshots of ``log`` as a stream of file versions ``(repo_id, commit_ts, path, content)``.

    A file that is gone has null content.  The time of a version is that of its snapshot, so a
    file that is put back with an older time is a later version all the same.  Content is read
    when its version is processed: of a file changed since, it may be the later one already,
    which the next snapshot lists again.
    """
    spark.dataSource.register(tree_reader.RepositoryFiles)
    rows = _source(spark.readStream, root, log, max_bytes).load()
    return rows.select("repo_id", F.col("taken").alias("commit_ts"), "path", decode_utf8(F.col("content")).alias("content"))


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``files(repo_id, path, content)`` below ``root``, which all executors can reach; returns how many."""
    written = files.select("repo_id", "path", "content").mapInPandas(tree_reader.tree_writer(root), "n BIGINT")
    return written.agg(F.sum("n")).first()[0] or 0


def unread(files: DataFrame) -> DataFrame:
    """``(repo_id, path, size)`` of listed files without content."""
    return files.where("content IS NULL").select("repo_id", "path", "size")


def from_table(table: DataFrame) -> DataFrame:
    """Files from a table with ``repo_id``, ``path`` and text or binary ``content``."""
    binary = dict(table.dtypes)["content"] == "binary"
    content = decode_utf8(F.col("content")) if binary else F.col("content")
    size = F.col("size") if "size" in table.columns else F.octet_length("content")
    return table.select("repo_id", "path", content.alias("content"), size.cast("bigint").alias("size"))
