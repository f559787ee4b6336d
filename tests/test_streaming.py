from pyspark.sql import functions as F

from scanweave.schemas import BASELINE
from scanweave.streaming import continuous as cs

SCHEMA = "repo_id STRING, commit_ts TIMESTAMP, path STRING, content STRING"


def versions(spark, tmp_path, batches):
    """A stream with one file, and so one micro-batch, per list of rows."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "repo_id STRING, ts STRING, path STRING, content STRING")
        df.select("repo_id", F.to_timestamp("ts").alias("commit_ts"), "path", "content").coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    stream = versions(spark, tmp_path, [[("r", "2024-01-01 10:00:00", "a.py", "eval(x)\nprint(x)")], [("r", "2024-01-01 11:00:00", "vendor/a.py", "eval(x)")]])
    found = cs.run_once(cs.scan_stream(stream)).collect()
    assert {(r.id, r.line, str(r.commit_ts)) for r in found} == {
        ("A03-003", 1, "2024-01-01 10:00:00"), ("A03-004", 1, "2024-01-01 10:00:00"), ("CQ-003", 2, "2024-01-01 10:00:00")}


def test_stored_profiles_select_domains(spark, tmp_path):
    stream = versions(spark, tmp_path, [[("r", "2024-01-01 10:00:00", "a.py", "eval(x)\nprint(x)"), ("s", "2024-01-01 10:00:00", "a.py", "print(x)")]])
    facts = spark.createDataFrame([("r", ["code_quality"], False), ("s", ["core"], False)], "repo_id STRING, security_domains ARRAY<STRING>, has_tests BOOLEAN")
    found = cs.run_once(cs.scan_stream(stream, facts=facts)).collect()
    assert {(r.repo_id, r.id) for r in found} == {("r", "CQ-003")}


def test_repeats_are_passed_on_once(spark, tmp_path):
    row = ("r", "2024-01-01 10:00:00", "a.py", "eval(x)")
    stream = versions(spark, tmp_path, [[row], [(row[0], "2024-01-01 10:30:00", *row[2:])]])
    assert cs.run_once(cs.first_within(cs.scan_stream(stream))).count() == 2


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    one = lambda t: [("r", f"2024-01-{t}", "a.py", "print(x)")]
    stream = versions(spark, tmp_path, [one("01 10:10:00") + one("01 10:50:00") + one("01 12:00:00"), one("09 00:00:00"), one("09 00:01:00"), one("09 00:02:00"), one("01 10:20:00"), one("20 00:00:00")])
    rows = cs.run_once(cs.per_window(cs.scan_stream(stream), "1 hour")).collect()
    got = {(str(r.window_start), r.severity): r.n for r in rows}
    assert got == {("2024-01-01 10:00:00", "LOW"): 2, ("2024-01-01 12:00:00", "LOW"): 1, ("2024-01-09 00:00:00", "LOW"): 3}


def test_sliding_windows(spark, tmp_path):
    stream = versions(spark, tmp_path, [[("r", "2024-01-01 10:10:00", "a.py", "print(x)")], [("r", "2024-01-09 10:10:00", "a.py", "print(x)")]])
    rows = cs.run_once(cs.per_window(cs.scan_stream(stream), "1 hour", "30 minutes")).collect()
    assert {str(r.window_start) for r in rows} == {"2024-01-01 09:30:00", "2024-01-01 10:00:00"}


def test_baseline_and_gate_per_batch(spark, tmp_path):
    stream = versions(spark, tmp_path, [[("r", "2024-01-01 10:00:00", "a.py", "eval(x)")], [("s", "2024-01-01 10:00:00", "a.py", "print(x)")]])
    accepted = spark.createDataFrame([("r", "A03-004:a.py:1")], BASELINE)
    out = str(tmp_path / "gate")
    writer = cs.gate_batches(cs.drop_accepted(cs.scan_stream(stream), accepted), lambda rows, no: rows.write.mode("append").parquet(out))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.repo_id, r.passed, r.details) for r in spark.read.parquet(out).collect()} == {
        ("r", False, "Security gate failed at CRITICAL: 1 CRITICAL"), ("s", True, "")}


def test_ignored_files_leave_no_findings(spark, tmp_path):
    at = "2024-01-01 10:00:00"
    paths = ["a.py", "generated/a.py", "x/generated/a.py", "lib/a.rb", "lib/deep/b.py", "keep.py", "a+b/c.py", "aab/c.py"]
    stream = versions(spark, tmp_path, [[("r", at, p, "print(x)") for p in paths] + [("s", at, "a.py", "print(x)")]])
    globs = spark.createDataFrame([("r", g) for g in ("generated/", "/a.py", "lib/deep", "a+b/", "*.rb")], "repo_id STRING, glob STRING")
    found = cs.run_once(cs.scan_stream(stream, ignores=globs)).collect()
    assert {(r.repo_id, r.file) for r in found} == {("r", "x/generated/a.py"), ("r", "keep.py"), ("r", "aab/c.py"), ("s", "a.py")}
