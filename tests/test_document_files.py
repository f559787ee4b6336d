import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scanweave.plans import document_writer, sinks

BLOCKS = "repo_id STRING, section INT, block LONG, text STRING"


def blocks(spark, sizes):
    rows = [(repo, 1 + b % 3, b // 3, f"{repo} {b} é") for repo, n in sizes.items() for b in range(n)]
    return spark.createDataFrame(rows, BLOCKS).repartition(5), sorted(rows, key=lambda r: (str(r[0]), r[1], r[2]))


def test_one_finished_file_or_several_volumes(spark, tmp_path):
    sizes = {"a/b": 3, "..": 1, "long": 1000, "x" * 300: 2, None: 2, "": 1, "r é+%": 5}
    table, rows = blocks(spark, sizes)
    sinks.write_files(table, str(tmp_path), volume_blocks=64)
    run = Path(document_writer.current_run(str(tmp_path)))
    for repo, n in sizes.items():
        folder = run / document_writer.folder_name(repo)
        names = [f"report.{v}.md" if v > 1 else "report.md" for v in range(1, (n - 1) // 64 + 2)]
        assert sorted(p.name for p in folder.iterdir()) == sorted(names)
        assert "".join((folder / x).read_text() for x in names) == "".join(r[3] + "\n" for r in rows if r[0] == repo)
    assert {p.name for p in run.iterdir()} == {document_writer.folder_name(r) for r in sizes}
    read = sinks.read_files(spark, str(tmp_path)).groupBy("repository").agg(F.max("volume").alias("v"), F.sum(F.octet_length("content")).alias("n"))
    assert {r.repository: r.v for r in read.collect()} == {document_writer.folder_name(r): (n - 1) // 64 + 1 for r, n in sizes.items()}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    table, _ = blocks(spark, {f"r{i}": 40 for i in range(30)})
    sinks.write_files(table, str(tmp_path))
    before = document_writer.current_run(str(tmp_path))
    broken = table.where("repo_id != 'r7'").unionByName(table.where("repo_id = 'r7'").withColumn("text", F.lit("x")))
    original = document_writer._Writer.write

    def failing(self, iterator):
        def rows():
            for batch in iterator:
                yield batch
                if "r7" in batch.column("repo_id").to_pylist():
                    raise ValueError("lost")

        return original(self, rows())

    document_writer._Writer.write = failing
    try:
        with pytest.raises(Exception, match="lost"):
            sinks.write_files(broken, str(tmp_path))
    finally:
        document_writer._Writer.write = original
    assert document_writer.current_run(str(tmp_path)) == before
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(["_CURRENT", Path(before).name])
    assert sinks.read_files(spark, str(tmp_path)).count() == 30


def test_later_writes_replace_and_empty_ones_too(spark, tmp_path):
    assert sinks.read_files(spark, str(tmp_path)).count() == 0
    sinks.write_files(blocks(spark, {"a": 2, "b": 2})[0], str(tmp_path), "f.json", "")
    table = spark.createDataFrame([("a", 1, 0, json.dumps({"n": 1}))], BLOCKS)
    sinks.write_files(table, str(tmp_path), "f.json", "")
    assert [(r.repository, r.volume, json.loads(bytes(r.content))) for r in sinks.read_files(spark, str(tmp_path)).collect()] == [("a", 1, {"n": 1})]
    sinks.write_files(table.where("false"), str(tmp_path))
    assert sinks.read_files(spark, str(tmp_path)).count() == 0
