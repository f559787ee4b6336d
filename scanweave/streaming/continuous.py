"""Continuous scanning: file versions arrive, findings leave.

The scan of a file needs nothing but the file, so on a stream it holds no state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.file_filters import in_project, not_ignored, scannable
from ..operators.matching import scan_lines
from ..operators.suppression import active_findings, as_findings
from ..operators.suppression import drop_accepted as _drop_accepted
from ..plans import corpus
from ..plans.report import gate, severity_counts
from ..rules.catalog import Rule, builtin_rules, rules_frame
from ..session import configure, deal_splits, shared_dir


def scan_stream(
    versions: DataFrame, rules: tuple[Rule, ...] | None = None, facts: DataFrame | None = None, ignores: DataFrame | None = None
) -> DataFrame:
    """Findings with the ``commit_ts`` of the file version they were found in.

    ``versions`` is ``(repo_id, commit_ts, path, content)``.  ``facts`` are the stored
    profiles of the repositories, as :func:`~scanweave.operators.profile.profile` gives
    them: only rules of active domains apply then.  Without it all given rules apply.
    ``ignores`` is a static table of globs; findings in files they cover are left out.
    """
    spark = deal_splits(configure(versions.sparkSession))
    rules = builtin_rules() if rules is None else rules
    path = F.col("path")
    wanted = versions.where(in_project(path) & scannable(path, F.octet_length("content").cast("bigint")))
    hits = scan_lines(wanted, rules, keep=["repo_id", "commit_ts", "path"])
    if ignores is not None:
        hits = not_ignored(hits, ignores)
    if facts is not None:
        return active_findings(hits, rules_frame(spark, rules), facts, "commit_ts")
    described = hits.join(F.broadcast(rules_frame(spark, rules)), F.col("rule_no") == F.col("rule_order"))
    return as_findings(described, "commit_ts")


def first_within(findings: DataFrame, delay: str = "1 day") -> DataFrame:
    """A finding repeated by a later version of its file is passed on once."""
    return findings.withWatermark("commit_ts", delay).dropDuplicatesWithinWatermark(["repo_id", "id", "file", "line"])


def per_window(findings: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Findings per time window and severity; later rows than ``delay`` are dropped."""
    window = F.window("commit_ts", length, slide or length)
    counted = findings.withWatermark("commit_ts", delay).groupBy(window.alias("w"), "severity").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "severity", "n")


def drop_accepted(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Anti-join of the stream with a static baseline."""
    return _drop_accepted(findings, baseline)


def gate_batches(findings: DataFrame, write: Callable[[DataFrame, int], None], configs: DataFrame | None = None):
    """A stream writer that applies the gate to every micro-batch and hands over its rows."""
    return findings.writeStream.foreachBatch(lambda batch, no: write(gate(severity_counts(batch), configs), no))


def gate_once(findings: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """The gate of every micro-batch of what is there, ``batch`` being its number."""
    base = shared_dir(findings.sparkSession)

    def write(rows: DataFrame, no: int) -> None:
        # A batch that is repeated after a failure replaces what it wrote before.
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={no}")

    query = gate_batches(findings, write, configs).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return findings.sparkSession.read.parquet(f"{base}/out")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, into files in the shared folder, and read them back."""
    base = shared_dir(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def corpus_history(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """The whole corpus, settings files included, as a stream of versions in so many micro-batches.

    A third of the files had an earlier version with more findings, and every repository had a
    file that is gone now; versions arrive in no order."""
    files = corpus.files(spark, sf_dir).select("repo_id", "path", "content")
    first, second = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp").alias("commit_ts") for d in (1, 2))
    earlier = files.where(F.pmod(F.hash("path"), F.lit(3)) == 0).select(
        "repo_id", first, "path", F.concat("content", F.lit("\neval(x)\nprint(x)\n<?php eval($x);")).alias("content")
    )
    gone = files.select("repo_id").distinct().select("repo_id", F.inline(F.array(
        F.struct(first, F.lit("src/gone.py").alias("path"), F.lit("eval(x)").alias("content")),
        F.struct(second, F.lit("src/gone.py").alias("path"), F.lit(None).cast("string").alias("content")),
    )))
    now = files.select("repo_id", second, "path", "content")
    # A file is one task or more: every micro-batch has enough of them for all cores.
    where, parts = shared_dir(spark), batches * max(5, 2 * spark.sparkContext.defaultParallelism)
    now.unionByName(earlier).unionByName(gone).repartition(parts, "path", "commit_ts").write.parquet(where)
    schema = "repo_id string, commit_ts timestamp, path string, content string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-parts // batches)).parquet(where)


def corpus_versions(spark: SparkSession, sf_dir: str, copies: int = 1, sentinel: bool = False) -> DataFrame:
    """Documents and pages as a stream of file versions, one of each per minute.

    ``copies`` versions of each file arrive a minute apart.  With ``sentinel`` one
    file far in the future follows, which closes all windows before it."""
    configure(spark)

    def arriving(name: str) -> DataFrame:
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")

    files = corpus.plant(arriving("documents")).select("repo_id", F.col("doc_id").alias("minute"), "path", "content")
    files = files.unionByName(corpus.as_files(arriving("pages")).withColumnRenamed("page_id", "minute"))
    start = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(minute AS INT), 0)"
    times = [f"{start} + INTERVAL {i} MINUTES" for i in range(copies)]
    if sentinel:
        times.append(f"IF(minute = 1, {start} + INTERVAL 100 YEARS, NULL)")
    seen = F.expr(f"explode(filter(array({', '.join(times)}), t -> t IS NOT NULL))")
    return files.select("repo_id", seen.alias("commit_ts"), "path", "content")
