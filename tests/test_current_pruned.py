"""The stream of current findings: rules of inactive domains are not tried, and narrow rows travel."""

import pytest

from scanweave.operators.matching import file_hits
from scanweave.operators.pruning import with_active
from scanweave.schemas import IGNORES
from scanweave.streaming import continuous
from scanweave.streaming.current import version_findings

CODE = "import os\neval(x)\npassword = 'hunter2222'\nprint(x)\n"
ROWS = [
    ("web", "2024-01-01", "src/a.py", CODE), ("web", "2024-01-02", "generated/a.py", CODE), ("web", "2024-01-01", ".env", "A=1"),
    ("none", "2024-01-01", "a.py", CODE), ("unknown", "2024-01-01", "a.js", "eval(x)"), (None, "2024-01-01", "a.py", CODE),
    ("web", "2024-01-03", "src/a.py", None), ("web", "2024-01-01", "src/a.py", CODE), ("web", "2024-01-01", None, CODE),
]


def test_pruned_versions_have_the_same_findings(spark):
    versions = spark.createDataFrame(ROWS, "repo_id STRING, ts STRING, path STRING, content STRING").selectExpr(
        "repo_id", "to_timestamp(ts) AS commit_ts", "path", "content"
    )
    facts = spark.createDataFrame(
        [("web", ["web", "secrets"], True), ("none", [], False)], "repo_id STRING, security_domains ARRAY<STRING>, has_tests BOOLEAN"
    )
    ignores = spark.createDataFrame([("web", "generated/")], IGNORES)
    key = lambda df: sorted(map(repr, df.collect()))
    plain = key(version_findings(versions, facts=facts, ignores=ignores))
    pruned = version_findings(with_active(versions, facts, ignores), facts=facts, ignores=ignores, active="active")
    assert key(pruned) == plain and any("keys=[" in r and "keys=[]" not in r for r in plain)


def test_hits_without_the_lines_around_them(spark):
    files = spark.createDataFrame([("r", "a.py", CODE), ("r", ".env", "A=1")], "repo_id STRING, path STRING, content STRING")
    whole = file_hits(files).selectExpr("path", "transform(hits, h -> struct(h.rule_no, h.line, h.code)) AS hits")
    narrow = file_hits(files, context=False)
    assert narrow.schema["hits"].dataType.elementType.names == ["rule_no", "line", "code"]
    assert sorted(map(repr, narrow.select("path", "hits").collect())) == sorted(map(repr, whole.collect()))


@pytest.mark.parametrize("batches", [1, 3])
def test_every_micro_batch_of_the_history_has_files_for_all_cores(spark, monkeypatch, batches):
    files = spark.createDataFrame([(f"r{i % 3}", f"src/{i}.py", CODE) for i in range(400)], "repo_id STRING, path STRING, content STRING")
    monkeypatch.setattr(continuous.corpus, "files", lambda *_: files)
    seen = []
    history = continuous.corpus_history(spark, "", batches).select("path", "_metadata.file_name")
    query = history.writeStream.foreachBatch(
        lambda b, no: seen.append((b.select("file_name").distinct().count(), b.count()))
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [s for s in seen if s[1]]
    assert len(seen) == batches and all(n >= 1.5 * spark.sparkContext.defaultParallelism for n, _ in seen)  # a few files may be empty
    assert sum(rows for _, rows in seen) > 400
