import fnmatch
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from scanweave.functions.globs import glob_regex
from scanweave.functions.paths import file_name, prefixes, suffix
from scanweave.functions.text import LINE_BREAK, decode_utf8, drop_last_empty, strip
from scanweave.operators.matching import with_lines
from scanweave.sources.files import from_table, read_directory


def test_lines_equal_splitlines(spark):
    random.seed(3)
    alphabet = ["a", "b ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", " ", " ", "é"]
    texts = ["", "\n", "a", "a\n", "\n\n"] + ["".join(random.choices(alphabet, k=random.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", drop_last_empty(F.split("t", LINE_BREAK, -1)).alias("l"))
    for r in df.collect():
        assert r.l == r.t.splitlines(), repr(r.t)


def test_strip_equals_python(spark):
    texts = ["", " a ", "　a ", "\x1f\x1ca\x85\n", "a​ ", " ", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", strip(F.col("t")).alias("s"))
    assert all(r.s == r.t.strip() for r in df.collect())


def test_decoding_drops_bad_bytes_only(spark):
    raw = [b"plain", b"a\xffb", b"\xe2\x82", "é�".encode(), "é�".encode() + b"\xc3", b"\xf0\x9f\x98\x80x", b"\xed\xa0\x80y", b""]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "b BINARY").select("b", decode_utf8(F.col("b")).alias("t"))
    for r in df.collect():
        assert r.t == bytes(r.b).decode("utf-8", "ignore"), bytes(r.b)


def test_names_and_suffixes(spark):
    paths = ["a/b.PY", ".env", "a/.env", "x.tar.gz", "noext", "a.b/c", "end.", "..x", "a/prod.env", "Dockerfile"]
    df = spark.createDataFrame([(p,) for p in paths], "p STRING")
    df = df.select("p", file_name(F.col("p")).alias("n")).withColumn("s", suffix(F.col("n")))
    for r in df.collect():
        assert r.n == pathlib.PurePosixPath(r.p).name
        dot = r.n.rfind(".")
        assert r.s == (r.n[dot:].lower() if 0 < dot < len(r.n) - 1 else "")


def test_prefixes(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("x",)], "p STRING").select("p", prefixes(F.col("p")).alias("x"))
    assert {r.p: r.x for r in df.collect()} == {"a/b/c.py": ["a/", "a/b/"], "x": []}


def test_globs_equal_fnmatch(spark):
    random.seed(5)
    globs = ["*.md", "a*b", "a?c", "[ab]*", "[!a]b", "a[", "a]", "[]]", "x.y", "(a)", "a+b", "*", "**/x", "[a-c]?", "a\\b", "^a$", "[^a]", "docs/*.py"]
    globs += ["".join(random.choices("ab*?[]!/.-", k=random.randint(1, 6))) for _ in range(150)]
    paths = ["a", "b", "ab", "abc", "a/b", "a/b/c.md", "x.y", "xzy", "(a)", "a+b", "docs/a.py", "docs/x/a.py", "]", "[", "a]", "^a$", "a.b", "-", "a-b", "!b"]
    paths += ["".join(random.choices("ab/.-]", k=random.randint(1, 5))) for _ in range(60)]
    g = spark.createDataFrame([(x,) for x in sorted(set(globs))], "g STRING").select("g", glob_regex(F.col("g")).alias("r"))
    p = spark.createDataFrame([(x,) for x in sorted(set(paths))], "p STRING")
    got = {(r.g, r.p) for r in g.join(p, F.rlike("p", F.col("r"))).collect()}
    assert got == {(a, b) for a in set(globs) for b in set(paths) if fnmatch.fnmatchcase(b, a)}


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.py").write_bytes(b"print(1)\n\xff")
    (tmp_path / "one" / "big.txt").write_bytes(b"x" * 500_001)
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / ".env").write_text("A=1")
    (tmp_path / "two" / "node_modules").mkdir()
    (tmp_path / "two" / "node_modules" / "x.js").write_text("x")
    (tmp_path / "two" / ".github" / "workflows").mkdir(parents=True)
    (tmp_path / "two" / ".github" / "workflows" / "a.yml").write_text("on:")
    (tmp_path / "loose.txt").write_text("not in a repository")
    return str(tmp_path)


EXPECTED = {
    ("one", "src/a.py"): ("print(1)\n", 10), ("one", "big.txt"): ("x" * 500_001, 500_001), ("two", ".env"): ("A=1", 3),
    ("two", ".github/workflows/a.yml"): ("on:", 3),
}


def test_read_directory(spark, tree):
    got = {(r.repo_id, r.path): (r.content, r.size) for r in read_directory(spark, tree).collect()}
    assert got == EXPECTED
    assert read_directory(spark, tree, prune=False).count() == 5


def test_read_directory_with_a_limit(spark, tree):
    got = {(r.repo_id, r.path): (r.content, r.size) for r in read_directory(spark, tree, max_bytes=500_000).collect()}
    assert got == {**EXPECTED, ("one", "big.txt"): (None, 500_001)}


def test_files_from_binary_table(spark):
    table = spark.createDataFrame([("r", "a.py", bytearray(b"x\xff"))], "repo_id STRING, path STRING, content BINARY")
    row = from_table(table).collect()[0]
    assert (row.content, row.size) == ("x", 2)
    assert with_lines(from_table(table)).collect()[0].lines == ["x"]
