"""What is open now: the findings of the latest version of every file, kept on a stream.

Each file version is matched in its row and becomes one narrow row with the finding keys that
the settings leave; versions without findings are rows too, for they close what was open.  The
state is keyed by repository and path and holds the latest version's time and keys, so a
repository of any size is spread over all tasks.  A version later than the one known emits what
it opens and what it closes; an earlier one that arrives late changes nothing.  Of two versions
with the same time the one with the greater content digest counts, so the outcome does not
depend on how versions fall into micro-batches.

Counts per repository follow from these changes.  A micro-batch writes its changes and the new
totals under its own number; a batch repeated after a failure starts again from the totals
before it and writes the same tables once more, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import finding_key
from ..functions.text import sql_string
from ..operators.file_filters import ignore_patterns, in_project, scannable
from ..operators.matching import file_hits
from ..operators.suppression import MISSING_TESTS, join_repo_facts
from ..plans.report import category_matrix, gate, owasp_coverage, severity_counts
from ..rules.catalog import CORE_DOMAINS, Rule, builtin_rules, rules_frame
from ..session import configure, shared_dir

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# A finding of a file is one number: the rule's place, then 32 bits of the line.
_LINE_BITS = 32
VERSION = "repo_id string, path string, commit_ts timestamp, digest bigint, keys array<bigint>, codes array<string>"
CHANGE = "repo_id string, path string, commit_ts timestamp, opened boolean, rule_no int, line int, code string"


def version_findings(
    versions: DataFrame, rules: tuple[Rule, ...] | None = None, facts: DataFrame | None = None,
    ignores: DataFrame | None = None, baseline: DataFrame | None = None, multiline: bool = False, active: str | None = None,
) -> DataFrame:
    """One row per file version, :data:`VERSION`: the findings that count in it.

    ``versions`` is ``(repo_id, commit_ts, path, content)``; null content says that the file is
    gone.  ``facts`` (profiles), ``ignores`` and ``baseline`` are static tables as in a batch
    scan.  A change of theirs shows in a file from its next version on.  ``active`` names a column
    of ``versions`` with a bit per domain, as for :func:`~scanweave.operators.matching.scan_lines`:
    rules of other domains are not tried, also if the settings change while the stream is followed.
    """
    configure(versions.sparkSession)
    rules = builtin_rules() if rules is None else rules
    path, size = F.col("path"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
    # A file that is not scanned any more has no findings; its content is not matched.
    wanted = in_project(path) & scannable(path, size)
    rows = versions.withColumns({
        "digest": F.xxhash64("content"), "content": F.when(wanted, F.coalesce("content", F.lit(""))).otherwise(F.lit(""))
    })
    rows = rows.withColumn("wanted", wanted)
    keep = ["repo_id", "path", "commit_ts", "digest", "wanted"]
    # Findings travel without the lines around them, which are not kept.
    found = file_hits(rows, rules, keep, multiline=multiline, active=active, context=False)
    counted = F.when(F.col("wanted"), F.col("hits")).otherwise(F.slice("hits", 1, 0))
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    id_of = lambda h: F.element_at(ids, h["rule_no"] + 1)
    if facts is not None:
        about = facts.select("repo_id", "security_domains", "has_tests")
        found = join_repo_facts(found, about, ["path"], "left")
        domains = F.when(F.size("security_domains") > 0, F.col("security_domains")).otherwise(F.array(*map(F.lit, CORE_DOMAINS)))
        domain_of = F.expr(f"array({', '.join(sql_string(r.domain) for r in rules)})")
        tested = F.coalesce("has_tests", F.lit(False))
        counted = F.filter(counted, lambda h: F.array_contains(domains, F.element_at(domain_of, h["rule_no"] + 1)) & ~((id_of(h) == MISSING_TESTS) & tested))
    if ignores is not None:
        found = join_repo_facts(found, ignore_patterns(ignores), ["path"], "left")
        covered = F.coalesce(F.rlike(path, F.col("_ignored")), F.lit(False))
        counted = F.when(covered, F.slice("hits", 1, 0)).otherwise(counted)
    if baseline is not None:
        found = found.join(_accepted(baseline), ["repo_id", "path"], "left")
        key = lambda h: finding_key(id_of(h), path, h["line"])
        counted = F.filter(counted, lambda h: ~F.coalesce(F.array_contains("accepted", key(h)), F.lit(False)))
    keyed = F.transform(counted, lambda h: F.struct(
        (F.shiftleft(h["rule_no"].cast("bigint"), _LINE_BITS) + h["line"]).alias("key"), h["code"].alias("code")
    ))
    found = found.select("repo_id", "path", "commit_ts", "digest", keyed.alias("f"))
    return found.select("repo_id", "path", "commit_ts", "digest", F.col("f.key").alias("keys"), F.col("f.code").alias("codes"))


def _accepted(baseline: DataFrame) -> DataFrame:
    """``(repo_id, path, accepted)``: a file's accepted keys; a key is ``id:file:line``."""
    file = F.regexp_extract("finding_key", r"(?s)\A[^:]*:(.*):[^:]*\z", 1)
    return baseline.select("repo_id", file.alias("path"), "finding_key").groupBy("repo_id", "path").agg(F.collect_set("finding_key").alias("accepted"))


def _latest_version():
    """The processor; a class of its own scope goes to executors by value, which need no copy of this package."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class LatestVersion(StatefulProcessor):
        def init(self, handle) -> None:
            self.known = handle.getValueState("known", "at bigint, digest bigint, keys array<bigint>")

        def handleInputRows(self, key, rows, timerValues):
            newest = max(rows, key=lambda r: (r.at, r.digest))
            before = self.known.get() if self.known.exists() else None
            if before is not None and (before[0], before[1]) >= (newest.at, newest.digest):
                return
            had = set(before[2]) if before is not None else set()
            codes = dict(zip(newest.keys, newest.codes))
            self.known.update((newest.at, newest.digest, sorted(codes)))
            changed = [(k, False) for k in had - codes.keys()] + [(k, True) for k in codes.keys() - had]
            for found, opened in sorted(changed):
                yield Row(
                    repo_id=key[0], path=key[1], at=newest.at, opened=opened, rule_no=found >> 32,
                    line=found & 0xFFFFFFFF, code=codes.get(found),
                )

        def close(self) -> None:
            pass

    return LatestVersion()


def changes(found: DataFrame) -> DataFrame:
    """What each version opens and closes, :data:`CHANGE`, from the stream of :func:`version_findings`.

    A version without a time is older than all others.
    """
    at = F.coalesce(F.unix_micros("commit_ts"), F.lit(-(1 << 62)))
    timed = found.select("repo_id", "path", at.alias("at"), "digest", "keys", "codes")
    made = timed.groupBy("repo_id", "path").transformWithState(
        _latest_version(), CHANGE.replace("commit_ts timestamp", "at bigint"), "Update", "none"
    )
    when = F.when(F.col("at") > -(1 << 62), F.timestamp_micros("at"))
    return made.select("repo_id", "path", when.alias("commit_ts"), "opened", "rule_no", "line", "code")


class CurrentFindings:
    """Follows a stream of file versions into tables under ``base``: changes and totals per micro-batch.

    ``checkpoint`` keeps offsets and state; the state store is RocksDB, since the state grows
    with the number of files.
    """

    def __init__(self, spark: SparkSession, rules: tuple[Rule, ...] | None = None, base: str | None = None):
        self.spark, self.base = spark, base or shared_dir(spark)
        self.rules = rules_frame(spark, builtin_rules() if rules is None else rules).select(
            F.col("rule_order").alias("rule_no"), F.col("rule_id").alias("id"), "severity", "category", "name", "owasp"
        )

    def follow(self, found: DataFrame, trigger: dict | None = None):
        """Start a query over :func:`version_findings`; ``trigger`` is that of a stream writer."""
        before = self.spark.conf.get(STATE_STORE, None)
        self.spark.conf.set(STATE_STORE, ROCKSDB)
        try:
            writer = changes(found).writeStream.outputMode("update").foreachBatch(self.write)
            return writer.option("checkpointLocation", f"{self.base}/state").trigger(**(trigger or {"availableNow": True})).start()
        finally:
            self.spark.conf.set(STATE_STORE, before) if before else self.spark.conf.unset(STATE_STORE)

    def write(self, batch: DataFrame, no: int) -> None:
        """Store one micro-batch; the same number again gives the same tables again."""
        described = batch.join(F.broadcast(self.rules), "rule_no")  # the rules are part of the plan
        described.write.mode("overwrite").parquet(f"{self.base}/changes/batch={no}")
        stored = self.spark.read.parquet(f"{self.base}/changes/batch={no}")
        step = F.when(F.col("opened"), 1).otherwise(-1)
        delta = stored.groupBy("repo_id", "severity", "category", "owasp").agg(F.sum(step).alias("n"))
        last = self._last_total(below=no)
        if last is not None:
            delta = last.unionByName(delta).groupBy("repo_id", "severity", "category", "owasp").agg(F.sum("n").alias("n"))
        delta.where("n != 0").write.mode("overwrite").parquet(f"{self.base}/totals/{no:012d}")

    def _numbers(self, kind: str) -> list[str]:
        """Names of the folders written so far: one per micro-batch, listed by the driver's file system client."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{kind}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        done = [s.getPath() for s in system.listStatus(path)]
        marks = [p for p in done if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.getName() for p in marks)

    def _last_total(self, below: int | None = None) -> DataFrame | None:
        names = [n for n in self._numbers("totals") if below is None or int(n) < below]
        return self.spark.read.parquet(f"{self.base}/totals/{names[-1]}") if names else None

    def totals(self) -> DataFrame:
        """``(repo_id, severity, category, owasp, n)``: open findings after the last finished micro-batch."""
        last = self._last_total()
        none = "repo_id string, severity string, category string, owasp string, n bigint"
        return self.spark.createDataFrame([], none) if last is None else last

    def all_changes(self) -> DataFrame:
        """All changes of finished micro-batches, with ``id``, ``severity`` and ``batch``."""
        names = self._numbers("changes")
        if not names:
            empty = f"{CHANGE}, id string, severity string, category string, name string, owasp string, batch int"
            return self.spark.createDataFrame([], empty)
        return self.spark.read.option("basePath", f"{self.base}/changes").parquet(*[f"{self.base}/changes/{n}" for n in names])

    def open_findings(self) -> DataFrame:
        """``(repo_id, path, id, line, severity)``: opened and not closed since."""
        step = F.when(F.col("opened"), 1).otherwise(-1)
        kept = self.all_changes().groupBy("repo_id", "path", "id", "line", "severity").agg(F.sum(step).alias("n"))
        return kept.where("n > 0").drop("n")

    def gate(self, repos: DataFrame, configs: DataFrame | None = None) -> DataFrame:
        """The gate of every repository of ``repos``, also those without findings, from the running totals."""
        return gate(self.severity_counts(repos), configs)

    # The report's counts, kept up to date: each is an aggregate of the totals, not of findings.

    def severity_counts(self, repos: DataFrame | None = None) -> DataFrame:
        return severity_counts(self.totals(), repos, weight="n")

    def category_matrix(self) -> DataFrame:
        return category_matrix(self.totals(), weight="n")

    def owasp_coverage(self, repos: DataFrame) -> DataFrame:
        return owasp_coverage(self.totals(), repos, weight="n")
