import random
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from scanweave.llm import bpe, merges, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return merges.WordBpe(bpe.read_vocabulary(PATH))


def plain_merge(own, symbols):
    """The leftmost pair of lowest rank, looked for anew each time."""
    symbols = list(symbols)
    while True:
        ranks = [(own.rank[a << 20 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 20 | b in own.rank]
        if not ranks:
            return symbols
        rank, i = min(ranks)
        symbols[i:i + 2] = [own.made[rank]]


def test_merges_equal_plain_search(own):
    rng = random.Random(1)
    for _ in range(2000):
        word = "".join(rng.choice("aaabcdeinorst") for _ in range(rng.randrange(1, 25))).encode()
        symbols = [own.inside[b] for b in word[:-1]] + [own.last[word[-1]]]
        assert own.merge(list(symbols)) == plain_merge(own, symbols)


def test_odd_texts_equal_the_library(library, own):
    rng = random.Random(2)
    letters = "aAbB éÉéΣσςİßẞǅLL12３ 　\x1c\x1d\x85.,!'’\U0001f600한가글Ƛ\U00016ea0͘� \t\n\r"
    extra = ["", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "'s", "'LL ", "x" * 40, "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) + rng.choice(extra) + rng.choice(letters) for _ in range(4000)]
    for text in [*texts, "", "x" * 30_000, "ab" * 20_000 + "!" * 5000]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(own.encode(text)) == ids, repr(text)[:200]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_remembering_changes_nothing(own, monkeypatch):
    texts = [" ".join(f"word{i % 50} Other{i % 37}, tail" for i in range(k, k + 200)) for k in range(5)]
    expected = [list(own.encode(t)) for t in texts]
    monkeypatch.setattr(merges, "REMEMBERED", 7)
    few = merges.WordBpe(bpe.read_vocabulary(PATH))
    assert [list(few.encode(t)) for t in texts] == expected
    assert len(few.words) <= 7 and len(few.older_chunks) <= 7


def test_encode_and_decode_tables(spark, library, odd_docs, no_docs):
    tokens = bpe.encode(odd_docs, PATH)
    assert tokens.columns == [*odd_docs.columns, "ids"]
    out = bpe.decode(tokens, PATH).collect()
    assert len(out) == odd_docs.count()
    for row in out:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(tokens, PATH)
    nulls = tokens.limit(1).withColumn("ids", F.lit(None).cast("array<int>"))
    assert bpe.decode(nulls, PATH).first()["decoded"] == ""


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        merges.WordBpe(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


def test_query_equals_the_library(spark, library):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op11_bpe(spark, SMALL).collect()
    assert len(out) == len(rows)
    for row in out:
        ids = library.encode(rows[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
