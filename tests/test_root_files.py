"""Settings files name the first document of a repository; only that one's lines are counted."""

from pyspark.sql import functions as F

from scanweave.functions.text import split_lines
from scanweave.plans import corpus

ROWS = [
    (1, "a", "x\ny\nz"), (1, "a", "x\ny"), (3, "a", "x"), (121, "a", ""), (7, None, "p\nq"), (None, "b", "q"), (5, "b", None),
    (9, "c", "u\r\nv\x0bw"), (41, "d", "k"),
]


def test_the_first_document_decides_also_with_repeated_and_null_keys(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id BIGINT, source STRING, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    files = corpus.root_files(spark, str(tmp_path))
    got = sorted(files.collect(), key=str)
    # As it was made before: the lines of every document were counted.
    docs = corpus._documents(spark, str(tmp_path)).withColumn("line", F.size(split_lines(F.col("text"))) + 1)
    first = {r.repo_id: r.f for r in docs.groupBy("repo_id").agg(F.min(F.struct("doc_id", "rule_id", "path", "line")).alias("f")).collect()}
    assert {r.repo_id for r in got} == set(first) and len(first) == 5 and first["a-0"].line == 3
    for r in got:
        f = first[r.repo_id]
        if r.path == ".security_baseline.json":
            listed = ":".join(str(x) for x in (f.rule_id, f.path, f.line) if x is not None)
            accepted = f'"id": "{f.rule_id}", "file": "{f.path}", "line": {f.line}}}' if f.doc_id % 3 == 1 else listed
            assert f.path is None or accepted in r.content
    plan = files._jdf.queryExecution().optimizedPlan().toString()
    split_at, joined_at = plan.index("split("), plan.index("least#")
    assert split_at < plan.index("Join Inner", split_at) and joined_at >= 0  # lines are counted above the join
