import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from scanweave.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Share by weight; what is above three times a size is shared again among the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]] if total else []
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    rows = []
    for name, docs in (("a", 900), ("b", 300), ("ä", 5), ("c", 40), (None, 100), ("d", 700)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.choice([1, 5, 30, 30, 200]))) + (name,) for i in range(docs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in mixing.mix_words(docs).collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, source in rows:
        sizes[source] += len(text.split())
        taken[source] += got[i].taken
        assert got[i].size == len(text.split()) and got[i].taken % got[i].size == 0 and got[i].taken <= 3 * got[i].size
    targets = brute_targets(sizes)
    for i, _, source in rows:
        assert got[i].source_size == sizes[source]
        assert got[i].target == pytest.approx(targets[source])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(200 if sizes[source] > 2000 else 0.3 * target, 0.01 * target)
    # Another layout, the same mix.
    again = {r.doc_id: r.taken for r in mixing.mix_words(docs.repartition(1)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_small_chunks_make_a_deep_tree_with_the_same_total(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "one" if i % 4 else "two") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    decided = mixing.round_copies(mixing.store(mixing.sized(docs)), chunk=8)
    totals = decided.groupBy("_source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.count("*"))
    assert decided.count() == 4000
    assert all(abs(r.taken - r.target) <= 7 for r in totals.collect())


def test_odd_rows(odd_docs, odd_rows):
    got = mixing.mix_words(odd_docs).collect()
    assert len(got) == len(odd_rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted(
        (r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in odd_rows
    )
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    copies = {(r.doc_id, r.size): r.copies for r in got}
    assert mixed.count() == sum(r.copies for r in got) and max(copies.values()) <= 3


def test_empty_table(no_docs):
    assert mixing.mix_words(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def test_joins_of_the_units_are_not_repeated(spark):
    """The units that are left are stored; the plan of the result holds only joins of what follows."""
    docs = spark.createDataFrame([(i, "ab c" * (i % 7 + 1), f"s{i % 3}") for i in range(900)], "doc_id LONG, text STRING, source STRING")
    plan = mixing.mix_words(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0
