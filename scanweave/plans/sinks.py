"""Writing results."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import number_within
from . import document_writer

cloudpickle.register_pickle_by_value(document_writer)

# Blocks in a volume of a document.
VOLUME_BLOCKS = 4096


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The fact table, partitioned by severity so that reports can skip the rest."""
    findings.write.mode(mode).partitionBy("severity").parquet(path)


def write_documents(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of text per repository, in order.

    Blocks are range-partitioned in reading order, so the part files of a folder, in
    the order of their names, are the document; a long document spans several."""
    order = [c for c in ("repo_id", "section", "part", "block") if c in blocks.columns]
    ordered = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.col("repo_id"), F.col("text").alias("value")).write.mode(mode).partitionBy("repo_id").text(path)


def write_json_lines(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    findings.write.mode(mode).json(path)


def write_files(blocks: DataFrame, folder: str, name: str = "report.md", separator: str = "\n", volume_blocks: int = VOLUME_BLOCKS) -> None:
    """One finished file per repository, ``<repository>/report.md``; further volumes are ``report.2.md`` and so on.

    ``blocks`` are those of :mod:`.documents`; each is followed by ``separator``.  A volume is
    written by one task, a long document by many.  The files appear all at once, see
    :mod:`.document_writer`; those of the last finished write are the ones :func:`read_files` reads.
    Earlier writes stay until their folders are deleted.
    """
    order = [c for c in ("section", "part", "block") if c in blocks.columns]
    # A null id is written as "\\0", whose folder is "%00": the numbering joins by it.
    named = blocks.select(F.coalesce("repo_id", F.lit("\0")).alias("repo_id"), *order, "text")
    placed = number_within(named, ["repo_id"], order, "place")
    rows = placed.select("repo_id", F.expr(f"CAST((place - 1) div {volume_blocks} + 1 AS BIGINT)").alias("volume"), "place", "text")
    rows = rows.repartition("repo_id", "volume").sortWithinPartitions("repo_id", "volume", "place").drop("place")
    blocks.sparkSession.dataSource.register(document_writer.RepositoryDocuments)
    options = {"folder": folder, "name": name, "separator": separator}
    rows.write.format(document_writer.FORMAT).mode("append").options(**options).save()


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(repository, volume, content)`` of the last finished write; ``repository`` is the name of its folder."""
    run = document_writer.current_run(folder)
    if run is None:
        return spark.createDataFrame([], "repository STRING, volume BIGINT, content BINARY")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run)
    parts = F.split("path", "/")
    volume = F.regexp_extract(F.get(parts, F.size(parts) - 1), r"\.(\d+)\.[^.]*$", 1)
    volume = F.when(volume == "", F.lit(1)).otherwise(volume).cast("bigint")
    return files.select(F.get(parts, F.size(parts) - 2).alias("repository"), volume.alias("volume"), "content")
