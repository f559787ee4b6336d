"""The current findings on a stream against a batch scan of the last versions."""

import random

import pytest
from pyspark.sql import functions as F

from scanweave import full_scan
from scanweave.plans.report import category_matrix, gate, owasp_coverage, severity_counts
from scanweave.schemas import BASELINE, CONFIGS, IGNORES
from scanweave.sources.settings import with_defaults
from scanweave.streaming.current import CurrentFindings, version_findings

LINES = ["eval(x)", "print(x)", "password = 'hunter2222'", "x = 1", "", "except:", "os.system(cmd + x)"]
DAY = "2024-01-01 {:02d}:00:00"


def history(seed=3):
    rng = random.Random(seed)
    rows = []
    for no in range(40):
        path = f"{rng.choice(['src', 'lib', 'generated', 'vendor'])}/{no}.py"
        for hour in sorted(rng.sample(range(20), rng.randrange(1, 5))):
            content = None if rng.random() < 0.15 else "\n".join(rng.choices(LINES, k=rng.randrange(6)))
            rows.append((rng.choice(["big", "big", "small"]) if no % 9 else "none", DAY.format(hour), path, content))
    rows += [("tie", DAY.format(1), "a.py", "eval(x)"), ("tie", DAY.format(1), "a.py", "print(x)"), ("tie", DAY.format(1), "a.py", None)]
    rows += [("same", DAY.format(2), "a.py", "print(x)")] * 3
    rng.shuffle(rows)
    return rows


def last_versions(rows, spark):
    """The last version of each file; of equal times the greater digest."""
    df = spark.createDataFrame(rows, "repo_id STRING, ts STRING, path STRING, content STRING").withColumn("digest", F.xxhash64("content"))
    latest = {}
    for r in df.collect():
        key = (r.repo_id, r.path)
        latest[key] = max(latest.get(key, ("", 0, None)), (r.ts, r.digest, r.content), key=lambda x: x[:2])
    return [(*key, content) for key, (_, _, content) in latest.items() if content is not None]


@pytest.fixture(scope="module")
def settings(spark):
    configs = with_defaults(spark.createDataFrame(
        [("big", None, "HIGH", None, None, None, None, None), ("small", None, "LOW", None, ["code_quality"], None, None, None)], CONFIGS))
    ignores = spark.createDataFrame([("big", "generated/"), ("tie", "*.md"), ("small", "lib/[0-4]*")], IGNORES)
    return configs, ignores


def stream_of(spark, rows, batches, folder):
    for i in range(batches):
        df = spark.createDataFrame(rows[i::batches], "repo_id STRING, ts STRING, path STRING, content STRING")
        df.select("repo_id", F.to_timestamp("ts").alias("commit_ts"), "path", "content").coalesce(1).write.mode("append").parquet(folder)
    schema = "repo_id STRING, commit_ts TIMESTAMP, path STRING, content STRING"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def outcome(now, about, configs):
    found = {(r.repo_id, r.path, r.id, r.line) for r in now.open_findings().collect()}
    totals = {(r.repo_id, r.severity, r.category, r.owasp): r.n for r in now.totals().collect()}
    reports = [now.severity_counts(about), now.category_matrix(), now.owasp_coverage(about)]
    return found, totals, {tuple(r) for r in now.gate(about, configs).collect()}, [as_set(r) for r in reports]


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 5])
def test_equal_to_a_batch_scan(spark, make_files, settings, tmp_path, batches):
    rows, (configs, ignores) = history(), settings
    files = make_files(last_versions(rows, spark))
    everything = full_scan(files, configs=configs, ignores=ignores)
    first = sorted((r.repo_id, f"{r.id}:{r.file}:{r.line}") for r in everything.findings.collect())[::7]
    baseline = spark.createDataFrame(first, BASELINE)
    expected = full_scan(files, configs=configs, ignores=ignores, baseline=baseline)
    stream = stream_of(spark, rows, batches, str(tmp_path / "in"))
    now = CurrentFindings(spark, base=str(tmp_path / "now"))
    found = version_findings(stream, facts=expected.profile, ignores=ignores, baseline=baseline)
    query = now.follow(found)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == batches
    got, totals, gates, reports = outcome(now, expected.profile, configs)
    wanted = expected.findings.collect()
    assert got == {(r.repo_id, r.file, r.id, r.line) for r in wanted} and len(got) > 10
    assert gates == {tuple(r) for r in gate(severity_counts(expected.findings, expected.profile), configs).collect()}
    assert sum(totals.values()) == len(wanted)
    full = [severity_counts(expected.findings, expected.profile), category_matrix(expected.findings), owasp_coverage(expected.findings, expected.profile)]
    assert reports == [as_set(r) for r in full]
    assert {g[2] for g in gates} == {True, False}
    # A micro-batch that is repeated after a failure writes the same tables again.
    last = max(int(n.partition("=")[2]) for n in now._numbers("changes"))
    batch = spark.read.parquet(f"{now.base}/changes/batch={last}").select("repo_id", "path", "commit_ts", "opened", "rule_no", "line", "code")
    now.write(spark.createDataFrame(batch.collect(), batch.schema), last)
    assert outcome(now, expected.profile, configs) == (got, totals, gates, reports)


def test_nothing_yet(spark, tmp_path):
    now = CurrentFindings(spark, base=str(tmp_path / "now"))
    repos = spark.createDataFrame([("r",)], "repo_id STRING")
    assert now.open_findings().count() == 0
    assert [tuple(r) for r in now.gate(repos).collect()] == [("r", "CRITICAL", True, "")]


def test_a_late_older_version_changes_nothing(spark, tmp_path):
    rows = [("r", DAY.format(5), "a.py", "print(x)"), ("r", DAY.format(1), "a.py", "eval(x)\neval(y)")]
    now = CurrentFindings(spark, base=str(tmp_path / "now"))
    now.follow(version_findings(stream_of(spark, rows, 2, str(tmp_path / "in")))).awaitTermination()
    assert {(r.id, r.line) for r in now.open_findings().collect()} == {("CQ-003", 1)}
    assert now.all_changes().count() == 1
