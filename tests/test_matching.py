import random
import re

import pytest
from brute import FLAGS, hits as brute_hits
from pyspark.sql import functions as F

from scanweave.functions.regex import java_line_pattern, required_words, to_java
from scanweave.operators.matching import scan_lines
from scanweave.rules.catalog import builtin_rules, merge_rules, rules_frame
from scanweave.rules.examples import DEAD_RULES, EXAMPLES

RULES = builtin_rules()
ODD_LINES = [
    "paſſword = 'abcdefgh12'", "toKen == x", "DİSABLED ... PRİNT(x)", "prınt(x)", "x = 25", "é25", "２５ ＝ ２６", "x\x1f= 5", "\x1fprint (x)",
    "md5é", "émd5", "md5²", "ámd5", "print (x)", "  print(x)", "import json​", "password = 'admin'",
    "'http://'http://localhost", "\"http://localhost\" \"http://x\"", "yaml.load(a, Loader=yaml.SafeLoader) yaml.load(b)",
    "new Intent()  .setClass", ".then(a).catch(b).then(c)", "wait 100 2 1 0 33", "x.25", "-100 -25", "f'{user}' ", "{prompt", "{user",
]


def spark_hits(frame, rules=RULES, **options):
    names = [r.rule_id for r in rules]
    return {(r.repo_id, r.path, names[r.rule_no], r.line, r.code, r.context) for r in scan_lines(frame, rules, **options).collect()}


def example_path(rule_id):
    tail = EXAMPLES[rule_id][0]
    return f"x/{rule_id}{tail}"


def test_catalogue_shape():
    by_domain = {}
    for r in RULES:
        by_domain.setdefault(r.domain, []).append(r)
    assert {d: len(v) for d, v in by_domain.items() if d != "secrets"} == {
        "core": 42, "code_quality": 17, "web": 19, "mobile": 24, "embedded": 22, "pipeline": 27, "ai_ml": 20,
    }
    built = [r for r in RULES if r.domain != "secrets"]
    assert sum(r.negative_pattern is not None for r in built) == 51
    assert [sum(r.severity == s for r in built) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")] == [47, 72, 40, 12]
    assert len({r.rule_id for r in RULES}) == len(RULES)
    assert all(r.description and r.fix for r in RULES)


def test_examples_hit_and_near_misses_do_not(make_files):
    rows = []
    for rule_id, (_, hit, miss, *cancel) in EXAMPLES.items():
        rows.append(("hit", example_path(rule_id), hit))
        rows.append(("miss", example_path(rule_id), miss))
        if cancel:
            rows.append(("cancelled", example_path(rule_id), hit + "\n" + cancel[0]))
    found = {(h[0], h[1], h[2]) for h in spark_hits(make_files(rows))}
    for rule in RULES:
        path = example_path(rule.rule_id)
        if not rule.file_check:
            assert (("hit", path, rule.rule_id) in found) == (rule.rule_id not in DEAD_RULES), rule.rule_id
            assert ("miss", path, rule.rule_id) not in found, rule.rule_id
            assert ("cancelled", path, rule.rule_id) not in found, rule.rule_id
    assert found == {(h[0], h[1], h[2]) for h in brute_hits(RULES, rows)} | {(r, "x/SEC-010/.env", "SEC-010") for r in ("hit", "miss")}


@pytest.mark.parametrize("automaton", [True, False])
def test_all_rules_equal_python_on_mixed_text(spark, make_files, automaton):
    """All rules against prose, example lines and odd characters, in random order."""
    random.seed(7)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    pool = [line for t in texts for line in t.splitlines()][:400] + ODD_LINES * 4 + ["x" * 1994 + " md5(x", "x" * 1995 + " md5(x"]
    pool += [line for e in EXAMPLES.values() for line in e[1:]]
    tails = sorted({e[0] for e in EXAMPLES.values()} | {".py", ".js", ".ts", ".c", ".java", ".yml"})
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " "]
    rows = []
    for i, tail in enumerate(tails * 3):
        text = "".join(random.choice(pool) + random.choice(breaks) for _ in range(60))
        rows.append((f"r{i % 5}", f"d/{i}{tail}", text))
    got = {h for h in spark_hits(make_files(rows), automaton=automaton) if h[3] > 0}
    assert len(got) > 300
    assert got == brute_hits(RULES, rows)


def test_negative_window_is_four_before_and_five_after(make_files):
    hit, cancel = EXAMPLES["WEB-005"][1], EXAMPLES["WEB-005"][3]
    rows = []
    for offset in (-6, -5, -4, -1, 0, 1, 4, 5, 6):
        lines = [""] * 15
        lines[7] = hit
        lines[7 + offset] = (lines[7 + offset] + " " + cancel).strip()
        rows.append(("r", f"{offset}.rb", "\n".join(lines)))
    found = {int(h[1].removesuffix(".rb")) for h in spark_hits(make_files(rows)) if h[2] == "WEB-005"}
    assert found == {-6, -5, 6}


def test_file_name_rule_shows_the_start_of_the_file(make_files):
    text = "A=1\r\nB=2\rC=3\n" + "\r\n" * 150 + "end"
    rows = [("r", ".env", text), ("r", "x/.ENV.local", "Z=1"), ("r", "my.env", "Z=1"), ("r", ".environment", "Z=1")]
    rule = next(r for r in RULES if r.file_check)
    got = {(h[1], h[3], h[4], h[5]) for h in spark_hits(make_files(rows), (rule,))}
    shown = text.replace("\r\n", "\n").replace("\r", "\n")[:200]
    assert got == {(".env", 0, ".env file detected", shown), ("x/.ENV.local", 0, ".env file detected", "Z=1")}


def test_required_words_are_in_every_match():
    pool = [line for e in EXAMPLES.values() for line in e[1:]] + ODD_LINES
    for rule in RULES:
        clauses = required_words(rule.pattern)
        for line in pool:
            match = re.search(rule.pattern, line, FLAGS)
            if match:
                text = match.group().translate(str.maketrans("ſKıİ", "skii")).lower()
                assert all(any(w in text for w in c) for c in clauses), (rule.rule_id, line, clauses)


def test_pattern_translation(spark):
    lines = spark.createDataFrame([(x,) for x in ["a[b", "a&&b", "x{2}", "xx", "{,3}", "aß", "a b", "ab]"]], "t STRING")
    for pattern in [r"[[]", r"[&&]", r"x{2}", r"x{1,}", "{user", r"[]]", r"[^]a]", r"\w{2}\b", r"(?P<k>a)(?P=k)?", r"b\Z", r"[\s\]]"]:
        got = {r.t for r in lines.where(F.col("t").rlike(java_line_pattern(pattern))).collect()}
        assert got == {r.t for r in lines.collect() if re.search(pattern, r.t, FLAGS)}, (pattern, to_java(pattern))


def test_user_rules_are_checked_and_merged(spark, make_files):
    own = dict(rule_id="MY-1", domain="web", category="c", name="n", severity="HIGH", pattern="needle", description="d", fix="f")
    bad = [{**own, "rule_id": "MY-2", "pattern": "(x"}, {**own, "rule_id": "MY-3", "pattern": ""}, own,
           {**own, "rule_id": "MY-4", "domain": "other"}, {**own, "rule_id": "MY-5", "pattern": "(?(1)a|b)(x)"}]
    rules, rejected = merge_rules(spark, [own, *bad])
    assert len(rules) == len(RULES) + 1
    assert [r.rule_id for r in rejected.orderBy("position").collect()] == ["MY-2", "MY-3", "MY-1", "MY-4", "MY-5"]
    found = spark_hits(make_files([("r", "any.thing", "a needle")]), rules)
    assert {h[2] for h in found} == {"MY-1"}
    assert rules_frame(spark, rules).count() == len(rules)


def test_scan_is_one_narrow_stage(make_files):
    plan = scan_lines(make_files([("r", "a.py", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_files_are_matched_once(make_files):
    """No filter repeats the expressions that make the hits, in which lines would be split anew per element."""
    found = scan_lines(make_files([("r", "a.py", "eval(x)\n\nprint(x)")])).where("line > 0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bArrowEvalPython\b", plan)) == 1
    assert plan.count("split(content") == 1
    assert sorted({r.line for r in found.collect()}) == [1, 3]
