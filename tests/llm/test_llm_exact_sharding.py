import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from scanweave.llm import common, exact_dedup, sharding


def expected_groups(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in sorted(ids, key=lambda v: (v is not None, v or 0), reverse=True):
            out[(i, keep, len(ids), left > 0, hashlib.sha256(text.encode()).hexdigest())] += 1
            left -= 1
    return out


def test_exact_duplicates_equal_brute_force(odd_docs, odd_rows):
    got = exact_dedup.exact_duplicates(odd_docs, digest_all=True).collect()
    assert Counter(tuple(r) for r in got) == expected_groups(odd_rows)


def test_short_prefix_only_means_more_full_hashes(odd_docs, odd_rows):
    got = exact_dedup.exact_duplicates(odd_docs, prefix_chars=1).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(tuple(r) for r in got) == _without_digest(expected_groups(odd_rows))


def _without_digest(groups):
    out = Counter()
    for key, n in groups.items():
        out[key[:4]] += n
    return out


def test_empty_table(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).collect() == []
    assert sharding.assign_shards(no_docs)[0].collect() == []


def test_full_hash_is_taken_only_where_length_and_prefix_recur(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "abc"), (4, "aa")], "doc_id long, text string")
    hashed = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_duplicates(docs).collect()}
    assert hashed[1] == hashed[4] == hashlib.sha256(b"aa").hexdigest()
    assert hashed[2] is None and hashed[3] is None


def test_beginnings_are_hashed_only_where_the_length_recurs(spark, monkeypatch):
    rows = [(i, "x" * i) for i in range(1, 300)] + [(500, "y" * 40), (501, "y" * 41), (502, "x" * 41)]
    stored = []
    monkeypatch.setattr(exact_dedup, "store", lambda t: stored.append(common.store(t)) or stored[-1])
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lengths, repeated = stored[0], stored[1]
    assert sorted(r[0] for r in lengths.collect()) == [40, 41] and [r._length for r in repeated.collect()] == [41]
    assert got[41].keep_id == got[502].keep_id == 502 and got[501].group_size == 1 and len(got) == len(rows)


def test_shards_hold_all_rows_gapless_and_near_equal_bytes(odd_docs, odd_rows):
    records, versions = sharding.assign_shards(odd_docs, shards=4, slots=64)
    rows = records.collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert {r.version for r in versions.collect()} == {0, 1}
    assert versions.count() == 128


def test_slot_with_many_rows_is_numbered_in_parts(spark):
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    records = sharding.assign_shards(docs, shards=2, slots=16)[0].collect()
    assert len({(r.shard, r.slot) for r in records}) == 6000 and {r.slot for r in records} == set(range(6000))


def test_rebalancing_moves_few_slots_and_growing_only_to_the_new_shard():
    sizes = [(i * 7919) % 1000 + 1 for i in range(512)]
    first = [i % 8 for i in range(512)]
    balanced = sharding.rebalance(first, sizes, 8)
    loads = [sum(s for s, o in zip(sizes, balanced) if o == k) for k in range(8)]
    assert max(loads) - min(loads) <= 0.001 * sum(loads) / 8
    assert sum(a != b for a, b in zip(first, balanced)) < 100
    assert sharding.rebalance(balanced, sizes, 8) == balanced
    grown = sharding.grow(balanced, sizes, 8)
    assert all(b == 8 for a, b in zip(balanced, grown) if a != b)
    new = sum(s for s, o in zip(sizes, grown) if o == 8)
    assert abs(new - sum(sizes) / 9) < 0.05 * sum(sizes) / 9
