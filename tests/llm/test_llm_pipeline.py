from collections import Counter

import duckdb
import pytest
SMALL = "/root/testdata/sf0.001"

import corpus_pipeline
from scanweave.llm import common, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    table = duckdb.connect()
    for t in ("documents", "pages"):
        table.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = table.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[i] for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_secrets", "op7_mixing", "op9_sharding"])
def test_query_has_a_row_per_document(spark, name):
    docs = common.read(spark, SMALL, "documents")
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = common.read(spark, SMALL, "documents")
    columns, before = docs.columns, {(r.doc_id, r.text) for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "sharding",
    ]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.store(stage(spark, docs, SMALL))
        rows = docs.collect()
        assert docs.columns == columns and {(r.doc_id, r.text) for r in rows} <= before
        before = {(r.doc_id, r.text) for r in rows}
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0.5 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == sizes[-1] and {r.shard for r in last.collect()} <= set(range(8))


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, SMALL).collect() == []
        assert stage(spark, odd_docs, SMALL).columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SMALL).collect() == []
