"""What keeps the match of a file cheap, with the same result."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from scanweave.functions.regex import NO_SPACE, java_line_pattern, to_java
from scanweave.functions.text import fold_sql, split_lines
from scanweave.functions.words import candidate_lines_udf, clauses_of
from scanweave.operators.matching import GROUP, _line_numbers, scan_lines
from scanweave.rules.catalog import builtin_rules
from scanweave.session import MIN_SPLITS, deal_splits

RULES = {r.rule_id: r for r in builtin_rules()}


def test_lines_are_split_as_before_and_without_the_regex_where_it_is_not_needed(spark):
    random.seed(5)
    alphabet = ["a", "é", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", " ", " "]
    texts = [None, "", "\n", "a\r\r\nb", "a\r\n", "\n\r"] + ["".join(random.choices(alphabet, k=random.randint(0, 9))) for _ in range(800)]
    old = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for r in rows.select("t", split_lines(F.col("t")).alias("new"), F.split("t", old, -1).alias("old")).collect():
        assert r.new == r.old, repr(r.t)


def test_digits_are_asked_for_before_looking_around(spark):
    pattern = RULES["CQ-021"].pattern
    assert java_line_pattern(pattern).startswith(r"(?imu)(?=[\p{Nd}])")
    for other in (r"^(a|\d)", r"\d+a", r"\b\d*a", r"\b\w\d", r"(?<!a)(\d|b)"):
        assert java_line_pattern(other) == "(?imu)" + to_java(other)
    random.seed(7)
    texts = ["".join(random.choices("12 .-'\"a_٣4é", k=random.randint(0, 8))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for r in rows.select("t", F.rlike("t", F.lit(java_line_pattern(pattern))).alias("new"), F.rlike("t", F.lit("(?imu)" + to_java(pattern))).alias("old")).collect():
        assert r.new == r.old, repr(r.t)


def test_words_are_found_in_text_of_any_case(spark):
    patterns = tuple(r.pattern for r in builtin_rules() if not r.file_check)
    texts = ["EVAL(x)\nPaſſword = 'x'", "TOKEN: ab\r\nPRİNT(x)", "ÉVAL(ıf ", "key\x85KEY é", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    search = candidate_lines_udf(patterns)
    got = rows.select("t", search(F.col("t")).alias("new"), search(F.expr(fold_sql("t"))).alias("old")).collect()
    assert all(r.new == r.old for r in got) and any(r.new for r in got)


def test_text_that_is_no_utf8_is_matched(spark):
    rows = spark.createDataFrame([("r", "a.py", bytearray(b"\xff\xc3\nEVAL(user_input)\n\xe2"))], "repo_id STRING, path STRING, b BINARY")
    hits = scan_lines(rows.select("repo_id", "path", F.col("b").cast("string").alias("content")))
    assert {(r.line, r.code) for r in hits.collect()} == {(2, "EVAL(user_input)")}


def test_the_file_is_not_folded_in_sql(spark, make_files):
    plan = scan_lines(make_files([("r", "a.py", "eval(x)")]))._jdf.queryExecution().executedPlan().toString()
    assert "lower(content" not in plan and "translate(content" not in plan


def test_words_are_tested_before_suffixes():
    sql = _line_numbers(builtin_rules())
    no, rule = next((i, r) for i, r in enumerate(builtin_rules()) if not r.file_check and r.suffixes and clauses_of(r.pattern))
    assert f"struct({no} AS rule_no, CASE WHEN get(candidates, {no}) IS NOT NULL AND (ext IN (" in sql


def test_tables_are_read_in_several_splits_a_core_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(MIN_SPLITS, None)
    try:
        spark.conf.unset(MIN_SPLITS)
        deal_splits(spark)
        assert spark.conf.get(MIN_SPLITS) == str(4 * spark.sparkContext.defaultParallelism)
        spark.conf.set(MIN_SPLITS, "3")
        deal_splits(spark)
        assert spark.conf.get(MIN_SPLITS) == "3"
    finally:
        spark.conf.unset(MIN_SPLITS) if before is None else spark.conf.set(MIN_SPLITS, before)


def test_spaces_are_asked_for_by_one_range_first(spark):
    pattern = RULES["CQ-020"].pattern
    assert java_line_pattern(pattern) == "(?imu)" + NO_SPACE + to_java(pattern)
    for other in (r"\s*a", r"(\s|a)b", r"\bfor\s", r"^\s+a", r"[\sa]b", r"\S\s"):
        assert java_line_pattern(other) == "(?imu)" + to_java(other)
    random.seed(11)
    spaces = "\t\x1f \xa0   　"
    texts = ["".join(random.choices(spaces + "aſ", [9] * len(spaces) + [1, 1], k=random.randint(0, 45))) + random.choice(["if ", "FOR\t", "tr", "a"]) for _ in range(900)]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    new, old = (F.rlike("t", F.lit(p)) for p in (java_line_pattern(pattern), "(?imu)" + to_java(pattern)))
    got = rows.select("t", new.alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old for r in got) and 50 < sum(r.old for r in got) < 850


def test_a_group_of_rules_without_words_in_the_file_is_passed_over(spark, make_files):
    """No rule is lost at the edges of a group, nor one that asks for no word."""
    sql = _line_numbers(builtin_rules())
    searched = {i // GROUP for i, r in enumerate(builtin_rules()) if not r.file_check and clauses_of(r.pattern)}
    assert sql.count("exists(slice(candidates, ") == len(searched)
    bound = [r for r in builtin_rules() if not r.file_check][: 2 * GROUP + 1]
    rules = tuple(replace(r, rule_id=f"X-{i}", pattern=f"word{i:03}x", negative_pattern=None, langs=(".py",)) for i, r in enumerate(bound))
    rules += (replace(rules[0], rule_id="X-any", pattern=r"^\s*\d"),)
    files = make_files([("r", f"{i}.py", f"a\nword{i:03}X") for i in range(len(bound))] + [("r", "no.py", "a\n\n 7"), ("r", "all.py", " ".join(f"word{i:03}x" for i in range(len(bound))))])
    hits = {(r.path, r.rule_no, r.line) for r in scan_lines(files, rules).collect()}
    assert hits == {(f"{i}.py", i, 2) for i in range(len(bound))} | {("all.py", i, 1) for i in range(len(bound))} | {("no.py", len(bound), 3)}
