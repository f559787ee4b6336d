import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from scanweave.llm import periodic_runs, queries, tandem

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def brute_runs(words):
    """Every period is tried by itself: stretches of equal words that far apart."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # periods ascend: the first is the smallest
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def sequences():
    rng = random.Random(5)
    out = [[], [1], [1] * 5, [1] * 6, [1] * 400, [1, 2] * 200, [1, 1, 2] * 90 + [3] + [1, 2, 1, 2] * 20]
    for _ in range(800):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            root = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(1, 9))]
            parts += (root * rng.choice([1, 1, 2, 3, 4, 5, 9]))[: rng.randrange(1, 60)]
        out.append(parts)
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    return [*out, b]


def test_runs_equal_brute_force():
    everything = sequences()
    for words in everything:
        got = list(zip(*(c.tolist() for c in tandem.maximal_runs(np.array(words, dtype=np.int64)))))
        assert got == brute_runs(words), words


def test_suffix_array_and_common_prefixes():
    for words in sequences()[:200]:
        symbols = np.array(words, dtype=np.int64)
        order, levels = tandem.suffix_levels(symbols)
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        lcp = tandem.common_prefixes(order, levels)
        for p in range(1, len(words)):
            x, y = words[order[p - 1]:], words[order[p]:]
            assert lcp[p] == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_many_long_runs_in_reasonable_time():
    words = np.array([0] * 200_000 + [1, 2, 3] * 50_000, dtype=np.int64)
    got = list(zip(*(c.tolist() for c in tandem.maximal_runs(words))))
    assert got == [(0, 200_000, 1), (200_000, 150_000, 3)]


@pytest.fixture(scope="module")
def run_docs(spark):
    rows = [(i, " ".join(f"w{x}" for x in words)) for i, words in enumerate(sequences())]
    rows += [(None, "a b " * 9), (None, None), (9000, None), (9001, ""), (9002, "\u00a0 \u2003\x1c " * 8), rows[4], rows[4]]
    rows += [(9003, "x\ty\n\x0bx \x0c y\r" * 6)]
    return spark.createDataFrame([(*r, 1, "s", "x") for r in rows], "doc_id long, text string, starts int, id string, collapsed string").repartition(3)


def test_tables_equal_brute_force(spark, run_docs, monkeypatch):
    rows = run_docs.collect()
    expected = []
    for r in rows:
        words = WORD.findall(r["text"] or "")
        runs = brute_runs(words)
        expected.append((r["doc_id"], [x[0] for x in runs], [x[1] for x in runs], [x[2] for x in runs], brute_collapsed(words, runs)))
    got = [tuple(r) for r in periodic_runs.find_runs(run_docs).collect()]
    key = lambda r: (str(r[0]), r[4])
    assert sorted(got, key=key) == sorted(expected, key=key)
    out = periodic_runs.collapse_runs(run_docs)
    assert out.columns == run_docs.columns
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    for r, e in zip(rows, expected):
        assert (r["doc_id"], e[4] if e[1] else r["text"]) in texts


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert periodic_runs.find_runs(odd_docs).count() == odd_docs.count()
    assert periodic_runs.find_runs(no_docs).count() == 0
    assert periodic_runs.collapse_runs(no_docs).columns == no_docs.columns


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op12_periodic_runs(spark, SMALL).collect()
    assert len(out) == len(docs) and sum(r["n_runs"] > 0 for r in out) > 10
    for r in out:
        words = planted(r["doc_id"], WORD.findall(docs[r["doc_id"]] or ""))
        if len(words) > 1500 and not r["n_runs"]:
            continue  # the plain search is quadratic
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *longest)
        assert r["runs_sha256"] == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == sha256(brute_collapsed(words, runs).encode()).hexdigest()
