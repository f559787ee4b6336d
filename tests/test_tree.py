"""Directory trees: listing in rounds, the batch and the stream reader."""

import os

import pytest
from pyspark.sql import functions as F

from scanweave.sources import tree_reader
from scanweave.sources.files import follow_directory, list_tree, read_directory, take_snapshot, unread, write_listing, write_tree
from scanweave.streaming.continuous import run_once
from scanweave.streaming.current import CurrentFindings, version_findings


@pytest.fixture()
def wide(tmp_path):
    """One repository whose ``src`` has 10,000 directories, and a deep small one."""
    src = tmp_path / "tree" / "big" / "src"
    src.mkdir(parents=True)
    for i in range(10_000):
        (src / f"d{i}").mkdir()
        (src / f"d{i}" / "a.py").write_bytes(b"x")
    deep = tmp_path / "tree" / "small" / "/".join(f"l{i}" for i in range(30))
    deep.mkdir(parents=True)
    (deep / "b.py").write_bytes(b"print(1)")
    return str(tmp_path / "tree")


def test_a_huge_directory_is_listed_by_many_tasks(spark, wide, monkeypatch):
    rounds = []
    plain = tree_reader.lister

    def spying(root, skip, budget):
        run = plain(root, skip, budget)

        def noted(batches):
            from pyspark import TaskContext

            for out in run(batches):
                out["modified"] = TaskContext.get().partitionId()  # which task listed it
                yield out

        rounds.append(budget)
        return noted

    monkeypatch.setattr(tree_reader, "lister", spying)
    listed = list_tree(spark, wide, tasks=16, budget=500).withColumn("task", F.unix_micros("modified"))
    assert listed.count() == 10_001 == listed.select("repo_id", "path").distinct().count()
    by_task = {r.task: r.n for r in listed.where("repo_id = 'big'").groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert len(by_task) >= 8 and max(by_task.values()) < 3000


def test_listing_does_not_depend_on_the_budget(spark, wide):
    few = {tuple(r) for r in list_tree(spark, wide, tasks=3, budget=7 * 1000).collect()}
    many = {tuple(r) for r in list_tree(spark, wide, tasks=8).collect()}
    assert few == many and len(few) == 10_001


def test_links_names_and_unreadable_files(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "r" / "src").mkdir(parents=True)
    (root / "r" / "src" / "é ü.py").write_text("print(1)")
    (root / "r" / "src" / "empty").write_text("")
    (root / "r" / ".env").write_text("A=1")
    (root / "r" / ".git").mkdir()
    (root / "r" / ".git" / "config").write_text("x")
    os.symlink(root / "r" / "src", root / "r" / "again")
    os.symlink(root / "r" / ".env", root / "r" / "link.py")
    (root / "bare").mkdir()
    files = read_directory(spark, str(root))
    assert {(r.repo_id, r.path, r.content) for r in files.collect()} == {("r", "src/é ü.py", "print(1)"), ("r", "src/empty", ""), ("r", ".env", "A=1")}
    assert unread(read_directory(spark, str(root), max_bytes=5)).collect()[0].path == "src/é ü.py"
    named = spark.createDataFrame([("r",), ("absent",)], "repo_id STRING")
    assert read_directory(spark, str(root), repos=named).count() == 3
    assert read_directory(spark, str(root / "bare")).count() == 0


def test_partitions_follow_the_size(spark, tmp_path, monkeypatch):
    from scanweave.sources import files as fs

    monkeypatch.setattr(fs, "READ_BYTES", 10_000)
    rows = spark.range(100).selectExpr("concat('r', id % 3) AS repo_id", "concat('src/', id, '.py') AS path", "repeat('x', 2000) AS content")
    assert write_tree(rows, str(tmp_path / "tree")) == 100
    read = read_directory(spark, str(tmp_path / "tree"))
    assert read.rdd.getNumPartitions() >= 15
    assert read.agg(F.sum("size")).first()[0] == 200_000


def test_stream_of_snapshots(spark, tmp_path):
    root, log = str(tmp_path / "tree"), str(tmp_path / "log")
    put = lambda rows: write_tree(spark.createDataFrame(rows, "repo_id STRING, path STRING, content STRING"), root)
    day = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    put([("r", "a.py", "eval(x)"), ("r", "b.py", "print(x)"), ("s", "src/c.py", "x = 1")])
    assert take_snapshot(spark, root, log, at=day(1)) == 0
    now = CurrentFindings(spark, base=str(tmp_path / "now"))

    def follow():
        now.follow(version_findings(follow_directory(spark, root, log))).awaitTermination()
        return {(r.repo_id, r.path, r.id) for r in now.open_findings().collect()}

    assert follow() == {("r", "a.py", "A03-003"), ("r", "a.py", "A03-004"), ("r", "b.py", "CQ-003")}
    assert take_snapshot(spark, root, log) is None
    os.remove(f"{root}/r/a.py")
    put([("s", "src/c.py", "print(x)  # more")])
    assert take_snapshot(spark, root, log, at=day(2)) == 1
    assert follow() == {("r", "b.py", "CQ-003"), ("s", "src/c.py", "CQ-003")}
    put([("r", "a.py", "print(1)")])
    os.utime(f"{root}/r/a.py", (1, 1))  # put back with an older time
    assert take_snapshot(spark, root, log, at=day(3)) == 2
    assert follow() == {("r", "a.py", "CQ-003"), ("r", "b.py", "CQ-003"), ("s", "src/c.py", "CQ-003")}
    # A new query from the beginning takes all versions, with the content that is there by now.
    rows = run_once(follow_directory(spark, root, log)).collect()
    assert {r.content for r in rows if r.path == "a.py"} == {None, "print(1)"}
    assert len(rows) == 6 and sum(r.content is None for r in rows) == 1


def test_batches_of_content_are_small(spark, tmp_path):
    """A worker holds few megabytes of content at a time, however much its part of the listing names."""
    root, log = tmp_path / "tree", str(tmp_path / "log")
    for no in range(16):
        (root / "r" / str(no)).mkdir(parents=True)
        (root / "r" / str(no) / "a.py").write_bytes(b"x" * (3 << 20))
    write_listing(spark, list_tree(spark, str(root)).withColumn("gone", F.lit(False)), log, 0)
    reader = tree_reader.TreeReader({"root": str(root), "log": log})
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in batches) == 16
    assert max(b.nbytes for b in batches) < 8 << 20
