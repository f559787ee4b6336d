import random

import numpy as np
from scanweave.llm import decontaminate, walks


def slow_distance(item, words):
    """Least edit distance between the item and any stretch of the words, by the textbook table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, words, count, vocabulary):
    words = list(words)
    for _ in range(count):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.5:
            words[at] = rng.choice(vocabulary)
        elif kind < 0.75 and len(words) > 2:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words


def corpus(seed=3, items=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "er", "on", "é") for b in ("an", "re", "ti", "ou", "es") for c in ("", "in", "ha", "st", "ly")]
    bench = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 70)))) for n in range(items)]
    return rng, vocabulary, bench


def test_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(100):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        words = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        assert walks.best_distance(np.array(item, dtype=np.uint32), np.array(words, dtype=np.uint32)) == slow_distance(item, words)


def test_recall_against_brute_force(spark):
    rng, vocabulary, bench = corpus()
    docs = []
    for number, text in bench:
        for rate in (0, 0.05, 0.1, 0.2):
            words = text.split()
            copy = edited(rng, words, int(rate * len(words)), vocabulary)
            around = [[rng.choice(vocabulary) for _ in range(rng.randrange(60))] for _ in range(2)]
            shown = " ".join(around[0] + copy + around[1])
            docs.append((len(docs), shown.upper() + "!!" if len(docs) % 5 == 0 else shown.replace(" ", " - ", 3)))
    for _ in range(100):
        docs.append((len(docs), " ".join(rng.choice(vocabulary) for _ in range(200))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(bench + [(900, "too short an item"), (901, None), (None, bench[0][1])], "item_id long, text string")
    found = decontaminate.contaminated(frame, benchmark).collect()
    got = {(r.id, r.item_id): r.distance for r in found if r.item_id is not None}
    expected = {}
    symbols = [(i, walks.symbols(t)) for i, t in docs]
    for number, text in bench:
        item = walks.symbols(text)
        for i, words in symbols:
            if len(set(item.tolist()) - set(words.tolist())) <= int(0.2 * len(item)):
                distance = slow_distance(item.tolist(), words.tolist())
                if distance <= int(0.2 * len(item)):
                    expected[(i, number)] = distance
    assert set(got) <= set(expected)
    assert len(got) >= 0.9 * len(expected)
    exact = {k for k, d in expected.items() if d == 0}
    assert exact <= set(got) and all(got[k] == 0 for k in exact)
    # In blocks, the same.
    blocks = decontaminate.contaminated(frame, benchmark, block=7).collect()
    assert sorted(blocks, key=str) == sorted(found, key=str)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame, benchmark).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_copies_changed_in_one_stretch_are_found():
    rng, vocabulary, _ = corpus()
    some = lambda count: [rng.choice(vocabulary) for _ in range(count)]
    for least, most in ((8, 16), (16, 32), (32, 70), (70, 100), (100, 500)):
        bench = [some(rng.randrange(least, most)) for _ in range(40)]
        index = walks.Index([(n, " ".join(item)) for n, item in enumerate(bench)])
        for part in (0, 0.5, 1):
            texts, begins = [], []
            for item in bench:
                count = int(0.2 * len(item))
                at = int(part * (len(item) - count))
                begins.append(rng.randrange(60))
                texts.append(" ".join(some(begins[-1]) + item[:at] + some(count) + item[at + count:] + some(60)))
            found = {(t, n): (distance, place) for t, n, _, distance, place in walks.batch_matches(index, texts, 0.2)}
            assert sum((n, n) in found for n in range(len(bench))) >= 0.9 * len(bench), (least, part)
            assert all(found[n, n][0] <= int(0.2 * len(item)) for n, item in enumerate(bench) if (n, n) in found)
        exact = walks.batch_matches(index, [" ".join(some(n) + item + some(9)) for n, item in enumerate(bench)], 0.2)
        assert {(n, n, len(item), 0, n) for n, item in enumerate(bench)} <= set(exact)


def test_items_under_eight_words_equal_brute_force():
    rng, vocabulary, long_items = corpus(items=5)
    few = vocabulary[:12]
    bench = [(n, " ".join(rng.choice(few) for _ in range(count))) for n, count in enumerate([1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7] * 3)]
    texts = ["", few[0]] + [" ".join(rng.choice(few) for _ in range(rng.randrange(40))) for _ in range(150)] + [long_items[0][1]]
    expected = set()
    for t, text in enumerate(texts):
        words = walks.symbols(text)
        for n, item in ((n, walks.symbols(i)) for n, i in bench):
            distance = slow_distance(item.tolist(), words.tolist())
            if distance <= int(0.2 * len(item)):
                expected.add((t, n, distance))
    index = walks.Index([*bench, (900, ""), *((n + 1000, i) for n, i in long_items)])
    found = walks.batch_matches(index, texts, 0.2)
    assert {(t, n, d) for t, n, _, d, _ in found if n < 900} == expected and len(expected) > 300
    for t, n, count, distance, place in found:
        words = walks.symbols(texts[t])
        if n < 900 and distance == 0:
            at = [i for i in range(len(words)) if np.array_equal(words[i:i + count], walks.symbols(bench[n][1]))]
            assert place == at[0]
    assert (len(texts) - 1, 1000, len(walks.symbols(long_items[0][1])), 0, 0) in found


def test_parts_hold_all_items():
    items = [(n, " ".join(["w"] * count)) for n, count in enumerate([3, 3, 50, 0, 4, 9])]
    parts = list(decontaminate._parts(items, 10))
    assert [item for part in parts for item in part] == items and [len(part) for part in parts] == [2, 1, 2, 1]


def test_long_texts_are_walked_in_slices(monkeypatch):
    rng, vocabulary, bench = corpus(items=5)
    index = walks.Index(bench)
    text = " ".join(rng.choice(vocabulary) for _ in range(4000)) + " " + bench[3][1]
    whole = walks.batch_matches(index, [text, "", bench[1][1]], 0.2)
    monkeypatch.setattr(walks, "PIECE", 300)
    monkeypatch.setattr(walks, "WALKERS", 16)
    assert walks.batch_matches(index, [text, "", bench[1][1]], 0.2) == whole
    assert {(t, n) for t, n, *_ in whole} >= {(0, 3), (2, 1)}


def test_odd_and_no_rows(spark, odd_docs, odd_rows, no_docs):
    text = odd_rows[20][1]
    benchmark = spark.createDataFrame([(1, " ".join(text.split()[:12])), (1, " ".join(text.split()[:12])), (2, "")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r[1] != text for r in odd_rows)
    assert decontaminate.contaminated(no_docs, benchmark).collect() == []
    assert decontaminate.contaminated(odd_docs, benchmark.limit(0)).collect() == []
