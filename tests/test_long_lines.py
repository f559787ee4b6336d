"""Lines of a megabyte are matched by every rule, in bounded time."""

import time

from pyspark.sql import functions as F

from scanweave.functions.words import candidate_lines_udf
from scanweave.operators.matching import scan_lines, unscanned
from scanweave.rules.catalog import builtin_rules
from scanweave.rules.examples import EXAMPLES

RULES = {r.rule_id: r for r in builtin_rules()}


def long_files(size):
    """Per rule a file whose only line is ``size`` characters of prose, then the rule's example."""
    filler = "plain words, some (in brackets) and a = term; " * (size // 46 + 1)
    rows = []
    for rule_id, (tail, hit, *_) in EXAMPLES.items():
        rule = RULES[rule_id]
        if not rule.file_check and "\n" not in hit:
            rows.append((rule_id, "x" + tail if not tail.startswith("/") else "x" + tail, filler[:size] + " " + hit))
    return rows


def test_a_megabyte_line_per_rule(spark, make_files):
    rows = long_files(1_000_000)
    short = long_files(40)
    tried = make_files(rows).repartition(16, "repo_id")
    start = time.perf_counter()
    got = {(r.repo_id, r.rule_no) for r in scan_lines(tried).select("repo_id", "rule_no").distinct().collect()}
    assert time.perf_counter() - start < 240
    same = {(r.repo_id, r.rule_no) for r in scan_lines(make_files(short)).select("repo_id", "rule_no").distinct().collect()}
    numbers = {r.rule_id: i for i, r in enumerate(builtin_rules())}
    own = {(rule_id, numbers[rule_id]) for rule_id, _, _ in rows}
    # A rule that hits its example behind a short line hits it behind a long one.
    assert own & same <= got and len(own & same) > 0.5 * len(own)


def test_nothing_is_left_out_unless_asked(spark, make_files):
    files = make_files([("r", "a.py", "x" * 3000 + "\nok"), ("r", "b.py", "y" * 600_000), ("r", "c.py", "short")])
    assert unscanned(files).collect() == []
    parts = {(r.path, r.reason, r.lines, r.bytes) for r in unscanned(files, 2000, 500_000).collect()}
    assert parts == {("a.py", "line length", 1, 3000), ("b.py", "file size", None, 600_000)}


def test_word_search_without_the_library(spark):
    patterns = tuple(r.pattern for r in builtin_rules() if not r.file_check)
    text = "\n".join(hit for _, hit, *_ in EXAMPLES.values()).lower()
    rows = spark.createDataFrame([(text,), ("",), (None,), ("eval(x)\n" * 50,)], "text string")
    both = rows.select(candidate_lines_udf(patterns)(F.col("text")).alias("a"), candidate_lines_udf(patterns, library=False)(F.col("text")).alias("b"))
    assert all(r.a == r.b for r in both.collect())
