"""Every distinct content matched once: the same hits as matching every file."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanweave.operators import distinct_content, matching
from scanweave.operators.pruning import with_active
from scanweave.rules.catalog import CORE_DOMAINS, DOMAINS, builtin_rules
from scanweave.rules.examples import EXAMPLES, MULTILINE_EXAMPLES

RULES = builtin_rules()


def rows():
    out = []
    for no, (rule_id, (tail, hit, *_)) in enumerate(EXAMPLES.items()):
        text = f"first\n{hit}\n"
        out += [(f"r{k}", f"d{no}/{k}{tail}", text) for k in range(1 + no % 4)]
        out += [("other", f"x/{no}.txt", text), ("other", f"x/{no}.py", text)]
    out += [("r0", "a/.env", "A=1"), ("r1", "b/.env", "A=1"), ("r1", "b/plain", "A=1"), ("r0", "Dockerfile", "USER root"), ("r1", "x/other", "USER root")]
    out += [(f"r{i % 5}", f"copy/{i}.py", "eval(x)\nprint(y)") for i in range(300)]  # a third of all files
    out += [("r0", "empty.py", ""), ("r1", "empty.py", "")]
    out += [("r2", f"m{i}{tail}", hit) for i, (tail, hit, *_) in enumerate(MULTILINE_EXAMPLES.values())]
    return out


def listed(hits):
    return Counter((r.repo_id, r.path, r.rule_no, r.line, r.code, r.context) for r in hits.collect())


@pytest.mark.parametrize("share", [1024, 8])
def test_equal_to_matching_every_file(make_files, monkeypatch, share):
    monkeypatch.setattr(distinct_content, "HOT_SHARE", share)
    files = make_files(rows())
    expected = listed(matching.scan_lines(files, RULES, multiline=True))
    assert listed(distinct_content.scan_distinct(files, RULES, multiline=True)) == expected
    assert max(expected.values()) == 1 and len(expected) > 900


def test_active_domains_are_part_of_the_key(spark, make_files):
    facts = spark.createDataFrame([("r0", CORE_DOMAINS[:1]), ("other", DOMAINS)], "repo_id STRING, security_domains ARRAY<STRING>")
    files = with_active(make_files(rows()), facts)
    assert listed(distinct_content.scan_distinct(files, RULES, active="active")) == listed(matching.scan_lines(files, RULES, active="active"))


def test_copies_are_matched_once(make_files, monkeypatch):
    seen = []
    plain = distinct_content.scan_lines

    def spying(files, *args, **options):
        seen.append(files.count())
        return plain(files, *args, **options)

    monkeypatch.setattr(distinct_content, "scan_lines", spying)
    texts = [f"eval(x{i})\n" for i in range(30)]
    files = make_files([(f"r{k}", f"{i}.py", t) for k in range(10) for i, t in enumerate(texts)])
    assert distinct_content.scan_distinct(files, RULES).count() == matching.scan_lines(files, RULES).count()
    assert seen == [30]


def test_repeated_rows_nulls_and_empty_tables(spark, make_files):
    files = make_files([("r", "a.py", "eval(x)"), ("r", "a.py", "eval(x)"), ("r", "a.py", "print(x)")])
    odd = files.union(spark.createDataFrame([("r", "b.py", None, 0), (None, "c.py", "print(x)", 8), ("r", None, "print(x)", 8)], files.schema))
    got = Counter((r.repo_id, r.path, RULES[r.rule_no].rule_id) for r in distinct_content.scan_distinct(odd, RULES).collect())
    assert got == {("r", "a.py", "A03-003"): 2, ("r", "a.py", "A03-004"): 2, ("r", "a.py", "CQ-003"): 1, (None, "c.py", "CQ-003"): 1}
    assert distinct_content.scan_distinct(odd.where("false"), RULES).count() == 0
