import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns, named like those that operators use inside.
CLASHING = ["id", "hash", "size", "target", "_id", "_text", "_row", "label", "key", "n", "h", "p", "weight", "_source", "first", "shard"]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows."""
    rng = random.Random(1)
    words = [f"wörd{i}" for i in range(300)] + ["the", "of"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    texts = [base, base, base, "", None, "\n \t", "one", "one two", "ONE two", text(60_000), "x" * 200_000, "a " * 3000]
    texts += [text(rng.randrange(1, 150)) + "\n" + text(9) for _ in range(60)]
    rows = [(i, t, "en", rng.choice(["s1", "s1", "s2", "é", None]), None) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (None, base, None, None, None)]
    return rows + [rows[0], rows[0], rows[5], rows[20]] + [(30, "the same id", "en", "s2", 1)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    schema = COLUMNS + "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(["x"] * len(CLASHING))) for r in odd_rows], schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
