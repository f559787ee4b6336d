import random
from collections import defaultdict

from pyspark.sql import functions as F
from scanweave.llm import common, line_dedup, line_hashes, suffix_dedup


def brute_lines(rows):
    """``rows``: (id, hash, text); dropped lines by comparing every line with all earlier ones."""
    places = []
    for number, code, text in set(rows):
        for line, content in enumerate((text or "").split("\n") if text is not None else []):
            if content.split():
                places.append(((number is None, number or 0, code, line), number, tuple(content.split())))
    places.sort(key=lambda p: p[0])
    first, out = {}, {}
    for place, number, words in places:
        key = (number, place[2], place[3])
        if words in first:
            out[key] = ("exact", first[words][1], first[words][0][3])
            continue
        first[words] = (place, number)
        for other, (at, owner) in first.items():
            close = max(len(words), len(other)) >= 5 and line_hashes.within_one_edit(" ".join(words).encode(), " ".join(other).encode())
            if other != words and close:
                out[key] = ("near", owner, at[3])
                break
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(["a", "b", "c", "dd", "é"]) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 7, 8])))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(200)]
    rows += [(7, None), (None, "a b c dd a b"), (None, "a b c dd a b a"), (5, "x\n\n  a   b c dd a b \r\n"), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = [tuple(r) for r in docs.select("doc_id", common.text_hash("text"), "text").collect()]
    got = {(r.id, r.hash, r.line): (r.kind, r.first_id, r.first_line) for r in line_dedup.dropped_lines(docs).collect()}
    assert got == brute_lines(hashed) and {k for k, *_ in got.values()} == {"exact", "near"}
    cleaned = {(r.doc_id, r.hash): r.text for r in line_dedup.drop_repeated_lines(docs.withColumn("hash", common.text_hash("text"))).collect()}
    for number, code, text in hashed:
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (number, code, i) not in got)
        assert cleaned[(number, code)] == kept


def test_query_counts_lines_of_a_null_id(spark, tmp_path):
    from scanweave.llm import queries

    rows = [(1, "a b c d e f\nx"), (None, "a b c d e f\na b c d e g"), (2, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.dropped) for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 0, 0, ""), None: (2, 1, 1, "0:exact:1:0,1:near:1:0"), 2: (1, 0, 0, "")}


def test_one_edit():
    yes = [("a b c", "a b c"), ("a b c", "a x c"), ("a b c", "a c"), ("a c", "a b c"), ("", "a"), ("a a b", "a b")]
    no = [("a b c", "x b y"), ("a b", "a b c d"), ("a b c", "b c d"), ("a b c d", "a c b d")]
    assert all(line_hashes.within_one_edit(x.encode(), y.encode()) for x, y in yes)
    assert not any(line_hashes.within_one_edit(x.encode(), y.encode()) for x, y in no)


def test_odd_and_no_rows_lines(odd_docs, no_docs):
    hashed = [tuple(r) for r in odd_docs.select("doc_id", common.text_hash("text"), "text").collect()]
    got = {(r.id, r.hash, r.line): (r.kind, r.first_id, r.first_line) for r in line_dedup.dropped_lines(odd_docs).collect()}
    assert got == brute_lines(hashed)
    cleaned = line_dedup.drop_repeated_lines(odd_docs)
    assert cleaned.columns == odd_docs.columns and cleaned.count() == len(hashed)
    assert line_dedup.dropped_lines(no_docs).collect() == []


def brute_passages(rows):
    seen, docs = defaultdict(set), {}
    for number, text in rows:
        if text is not None:
            docs[(number, text)] = text.split()
    for doc, words in docs.items():
        for j in range(len(words) - 49):
            seen[tuple(words[j:j + 50])].add(doc)
    least = lambda values: min((v for v in values if v is not None), default=None)
    out = set()
    for doc, words in docs.items():
        spans = []
        for j in range(len(words) - 49):
            owners = seen[tuple(words[j:j + 50])]
            if len(owners) > 1:
                first = least(o[0] for o in owners)
                if spans and j < spans[-1][1]:
                    spans[-1] = (spans[-1][0], j + 50, least((spans[-1][2], first)))
                else:
                    spans.append((j, j + 50, first))
        out |= {(doc[0], *s) for s in spans}
    return out


def passages(docs):
    return {tuple(r) for r in suffix_dedup.repeated_passages(docs).select("id", "start", "stop", "first_id").collect()}


def test_passages_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (40, 49, 50, 51, 60, 90, 200, 51, 52, 75)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += [rng.choice(words) for _ in range(rng.choice([0, 3, 20, 80]))]
            part = list(rng.choice(shared))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "x"
            text += part if rng.random() < 0.7 else []
        rows.append((i, " ".join(text)))
    rows += [(500, "a " * 300), (501, "a " * 120), (502, None), (None, " ".join(shared[5] + shared[6])), (503, "")]
    rows += [(i + 1000, rows[i][1]) for i in range(5)] + [rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = passages(docs)
    assert got == brute_passages(rows) and len(got) > 50


def test_odd_and_no_rows_passages(odd_docs, odd_rows, no_docs):
    assert passages(odd_docs) == brute_passages([r[:2] for r in odd_rows])
    assert passages(no_docs) == set()


def test_passages_of_the_small_tables(spark):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", F.col("text")).collect()]
    assert passages(docs) == brute_passages(rows)
