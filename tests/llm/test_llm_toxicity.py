import random
import zlib

import numpy as np
from scanweave.llm import subwords, toxicity

BAD = ["grobnak", "swindik", "fulmorex", "trazzling"]


def made(count, seed=5):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "ha", "ti", "es", "ing", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 2, 3])))
    docs, labels = [], []
    for i in range(count):
        words = [word() for _ in range(rng.choice([20, 60, 200]))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(1 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = made(1500)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    # Labels of held-out rows are turned round: a model that reads them would fail below.
    seen = [(i, q, t if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - t) for i, q, t in labels]
    marks = spark.createDataFrame(seen + [(None, 1, 1), (3, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, marks)
    got = {r.doc_id: r for r in toxicity.score_rows(frame, model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    caught = [got[i].predicted for i in held if truth[i]]
    wrong = [got[i].predicted for i in held if not truth[i]]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.05 * len(wrong)
    again = toxicity.fit(frame.repartition(2), marks)
    assert np.array_equal(model.weights, again.weights) and model.scale == again.scale
    spelled = spark.createDataFrame([(1, "the grobnakk"), (2, "a swwindik here"), (3, "fulmorexes"), (4, "the other"), (5, "")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score_rows(spelled, model).collect()}
    assert min(scores[1], scores[2], scores[3]) > max(scores[4], scores[5]) and max(scores[4], scores[5]) < 0.5


def test_pieces_do_not_change_the_score(monkeypatch):
    rng = np.random.default_rng(0)
    weights = rng.normal(size=subwords.BUCKETS).astype(np.float32)
    text = (" ".join(f"wörd{i % 50}, x{i}!" for i in range(3000))).encode()
    whole = subwords.top_logit(text, weights, 0.1)
    bags = subwords.bags(text)
    assert np.isclose(whole, 0.1 + max((weights[b] * c).sum() / (c.sum() + subwords.PRIOR) for b, c in bags))
    monkeypatch.setattr(subwords, "PIECE_BYTES", 500)
    # A window cut by a piece may count a word again that both parts have: here all differ but fifty.
    assert abs(subwords.top_logit(text, weights, 0.1) - whole) < 0.2


def test_odd_and_no_rows(spark, odd_docs, odd_rows, no_docs):
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs, marks)
    got = toxicity.score_rows(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns
    assert toxicity.drop_toxic(odd_docs, model).count() == sum(1 - r.predicted for r in got)
    empty = toxicity.fit(no_docs, marks.limit(0))
    assert toxicity.score_rows(no_docs, empty).collect() == []
    assert all(r.score == 0.5 for r in toxicity.score_rows(odd_docs, empty).collect())
