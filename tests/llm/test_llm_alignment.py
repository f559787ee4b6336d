import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
from scanweave.llm import queries, token_alignment, token_spans
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, SentencePieceProcessor(model_file=B)


def brute_tokens(libraries, text):
    """``[(id, bytes)]`` of both sides, or nothing where they do not spell the text."""
    if not text:
        return [], []
    tokenizer, model = libraries
    letters = token_spans.byte_letters()
    a = [(i, bytes(letters[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        is_byte = len(piece) == 6 and piece.startswith("<0x")
        b.append((i, bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(libraries, texts):
    """Per text (n_a, n_b, groups, links), and what is asked of the links."""
    per_text = []
    for text in texts:
        a, b = (spans(t) for t in brute_tokens(libraries, text))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (a, b)))
            low = cut
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        per_text.append((len(a), len(b), groups, links))
    counts = Counter(link for *_, links in per_text for link in links)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for n_a, n_b, groups, links in per_text:
        digest = sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, len(groups), len(links), digest, sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)))
    return out


def odd_texts():
    rng = random.Random(4)
    letters = "aabcde éß한글\U0001f600​▁  \t\n\x00<>|0123456789"
    words = ["the", "of", "<|endoftext|>", "</s>", "<0x41>", "naïve", "ﬁ", "x" * 50, "  ", " ", "İ"]
    texts = ["".join(rng.choice([rng.choice(letters), rng.choice(words)]) for _ in range(rng.randrange(25))) for _ in range(300)]
    return [*texts, "", None, " ", "one", "one", "one two one two " * 30, "▁"]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.mark.parametrize("frequent", [1 << 18, 4])
def test_statistics_equal_brute_force(spark, libraries, monkeypatch, frequent):
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    monkeypatch.setattr(token_spans, "BLOCK_CHARS", 200)
    texts = odd_texts()
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, pairs int").repartition(4)
    got = sorted((tuple([r["id"], *(r[c] for c in COLUMNS)]) for r in token_alignment.link_statistics(docs, A, B).collect()), key=str)
    expected = [(r[0], *e) for r, e in zip(rows, brute(libraries, [r[1] for r in rows]))]
    assert got == sorted(expected, key=str)
    assert sum(e[1] > 0 for e in expected) > 100 and sum(e[1] == 0 for e in expected) > 5


def test_ranks_equal_the_library():
    with open(A, encoding="utf-8") as file:
        source = file.read()
    ranks, library = token_spans.ByteLevel(source), token_spans.ByteLevel(source, by_ranks=False)
    assert ranks.ranks is not None and library.ranks is None
    rng = random.Random(6)
    letters = "aAbé ß한\U0001f600  \t\n\r\x0b\x1c\x85\u00a0 \u2028\u3000'sStTrReElLdDmMvV12３.,!\x00\u0301\U00016ea0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += [chr(c) + "a " + chr(c) + "1" for c in range(0x20, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += [" " * 200_000 + "a", "\n" * 50_000, "x" * 100_000, "<|endoftext|>", ""]
    for low in range(0, len(texts), 500):
        part = texts[low:low + 500]
        for text, a, b in zip(part, ranks.encode(part), library.encode(part)):
            assert a == b, repr(text)[:100]
    other = source.replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false')
    assert token_spans.ByteLevel(other).ranks is None


def test_groups_are_listed_whole(spark, libraries):
    texts = ["one two", "İstanbul naïve 한글", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: r for r in token_alignment.aligned(docs, A, B).collect()}
    for i, text in enumerate(texts):
        a, b = (spans(t) for t in brute_tokens(libraries, text))
        listed = found[i]["groups"]
        assert (sha256(listed.encode()).hexdigest() if a else "") == found[i]["groups_sha256"]
        assert [x for g in listed.split(";") if g for x in g.split("|")[0].split(",")] == [str(i) for i, _, _ in a]
        assert [x for g in listed.split(";") if g for x in g.split("|")[1].split(",")] == [str(i) for i, _, _ in b]


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert token_alignment.link_statistics(odd_docs, A, B).count() == odd_docs.count()
    assert token_alignment.link_statistics(no_docs, A, B).count() == 0


def test_query_equals_brute_force(spark, libraries):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_token_alignment(spark, SMALL).collect()}
    counts = brute_fast(libraries, [t for _, t in docs])
    assert out == {i: e for (i, _), e in zip(docs, counts)}


def brute_fast(libraries, texts):
    """:func:`brute` with the links found byte by byte."""
    per_text = []
    for text in texts:
        a, b = (spans(t) for t in brute_tokens(libraries, text))
        of_b = [k for k, (_, s, e) in enumerate(b) for _ in range(s, e)]
        links = sorted({(k, of_b[x]) for k, (_, s, e) in enumerate(a) for x in range(s, e)})
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, x, y = [], 0, 0
        for cut in cuts:
            here_a, here_b = [], []
            while x < len(a) and a[x][2] <= cut:
                here_a.append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= cut:
                here_b.append(str(b[y][0]))
                y += 1
            groups.append(",".join(here_a) + "|" + ",".join(here_b))
        per_text.append((len(a), len(b), groups, [(a[i][0], b[j][0]) for i, j in links]))
    counts = Counter(link for *_, links in per_text for link in links)
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (n_a, n_b, len(groups), len(links), sha256(";".join(groups).encode()).hexdigest() if n_a else "",
         sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
        for n_a, n_b, groups, links in per_text
    ]
