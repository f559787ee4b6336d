import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F
from scanweave.llm import fingerprints, golay, simhash
from scanweave.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """``prints``: id to fingerprint; the smallest id reachable over links of 3 bits or fewer."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_golay_code_is_perfect_and_keys_meet():
    table = golay.error_patterns()
    assert (table[:, 0] >= 0).all() and set((table >= 0).sum(axis=1)) == {1, 6}
    keys = golay.segment_keys(16)
    values = np.arange(1 << 16)
    for bit in range(16):
        other = keys[values ^ (1 << bit)]
        shared = (keys[:, :, None] == other[:, None, :]) & (keys >= 0)[:, :, None]
        assert shared.any(axis=(1, 2)).all()


def test_fingerprints_within_three_bits_share_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 5000, dtype=np.int64)
    b = a.copy()
    for _ in range(3):
        b ^= np.left_shift(np.int64(1), rng.integers(0, 64, len(b)))
    table = golay.segment_keys(16)
    found = []
    for prints in (a, b):
        row, key = fingerprints.fuzzy_keys(prints, table)
        sets = [set() for _ in a]
        for r, k in zip(row.tolist(), key.tolist()):
            sets[r].add(k)
        found.append(sets)
    assert all(x & y for x, y in zip(*found))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 10, 100, 800]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            if copy and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(["X", "y", "É"])
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    components = brute_components(prints)
    assert got == {i: (prints[i], components[i]) for i, _ in rows}
    assert len(set(components.values())) < len(rows)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(components.values())


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", 100)
    assert fingerprints.fingerprint(text) == whole == brute_fingerprint(text.decode())


def test_keys_with_many_nodes_are_cut_into_blocks(spark):
    nodes = spark.range(300).select(F.col("id").alias("node"), (F.col("id") * 0x1000000).alias("fp"))
    nodes = simhash.store(nodes)
    prints = {r.node: r.fp for r in nodes.collect()}
    links = simhash.fingerprint_links(nodes, block=16)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert {i: roots.get(i, i) for i in prints} == brute_components(prints)


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.node, r.root) for r in connected_components(links).collect()} == {(i, 0) for i in range(1, 201)}


def test_odd_and_no_rows(odd_docs, odd_rows, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    assert all(r.fp & (2**64 - 1) == 0 for r in got if r.hash == got[0].hash and r.fp == 0)
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sum(i is None for i in ids) == 3
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in got if r.component_id is not None})
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.drop_near_duplicates(no_docs).collect() == []
