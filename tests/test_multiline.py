"""Matches over several lines against Python's own regexes on the whole content."""

import random
import re

from brute import FLAGS

from scanweave import scan
from scanweave.functions.regex import names_line_break
from scanweave.operators.matching import scan_lines
from scanweave.rules.catalog import builtin_rules
from scanweave.rules.examples import DEAD_RULES, EXAMPLES, MULTILINE_EXAMPLES

RULES = tuple(r for r in builtin_rules() if names_line_break(r.pattern))


def brute(files):
    """A hit per line that matches; matches over several lines among what is left of the text."""
    out = set()
    for repo, path, text in files:
        lines = text.splitlines()
        for rule in RULES:
            if not any(path.endswith(x) for x in rule.suffixes):
                continue
            main, negative = re.compile(rule.pattern, FLAGS), rule.negative_pattern and re.compile(rule.negative_pattern, FLAGS)
            alone = [bool(main.search(t)) for t in lines]
            joined = "\n".join("\ufdd1" if a else t for a, t in zip(alone, lines))
            starts = {joined.count("\n", 0, m.start()) + 1 for m in main.finditer(joined)} | {i + 1 for i, a in enumerate(alone) if a}
            for n in starts:
                if not (negative and negative.search("\n".join(lines[max(0, n - 5) : n + 5]))):
                    out.add((repo, path, rule.rule_id, n))
    return out


def found(frame, **options):
    return [(r.repo_id, r.path, RULES[r.rule_no].rule_id, r.line) for r in scan_lines(frame, RULES, **options).collect()]


def texts():
    rng = random.Random(7)
    pieces = [x for _, hit, miss, cancel in MULTILINE_EXAMPLES.values() for x in (hit, miss, cancel)]
    pieces += [EXAMPLES["CQ-010"][1], EXAMPLES["PIPE-022"][1], "", "", "prose", "except:", "permissions:", "\ufdd0", "  - name: b", "pass", "{}\n\n"]
    for no in range(400):
        parts = [rng.choice(pieces) for _ in range(rng.randrange(1, 12))]
        text = "".join(p + rng.choice(["\n", "\n", "\r\n", "\n\n\n\n\n\n\n\n", " ", "\u2028"]) for p in parts)
        yield "r", f"src/{no}{rng.choice(['.py', '.yml', '.yaml', '.c', '.js'])}", text


def test_ten_rules_are_written_for_several_lines():
    assert {r.rule_id for r in RULES} == {*DEAD_RULES, "CQ-010", "PIPE-022"} == set(MULTILINE_EXAMPLES)
    assert not any(map(names_line_break, [r"a[^\n]b", r"a\s+b", r"a(?!\n)b", r"(?<=\n)b"]))
    assert all(map(names_line_break, ["a\nb", r"a(x|y\n)b", r"a(?:\n)*b", r"a[ \n]b"]))


def test_hits_equal_python(make_files):
    rows = list(texts())
    got = found(make_files(rows), multiline=True)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert {x[2] for x in got} == {r.rule_id for r in RULES}


def test_examples_miss_and_cancel(make_files):
    rows = []
    for rule_id, (tail, hit, miss, cancel) in MULTILINE_EXAMPLES.items():
        rows += [("hit", f"{rule_id}{tail}", "first\n" + hit), ("miss", f"{rule_id}{tail}", miss)]
        rows += [("cancelled", f"{rule_id}{tail}", hit + "\n" + cancel)] if cancel else []
    got = set(found(make_files(rows), multiline=True))
    lines = {r[2]: r[3] for r in got if r[0] == "hit" and r[1].startswith(r[2])}
    assert lines == {rule_id: 4 if rule_id == "A09-002" else 2 for rule_id in MULTILINE_EXAMPLES}
    assert not [r for r in got if r[0] != "hit" and r[1].startswith(r[2])]


def test_silent_without_the_option_and_with_parity(make_files):
    rows = [("r", f"src/{rule_id}{tail}", hit) for rule_id, (tail, hit, *_) in MULTILINE_EXAMPLES.items()]
    files = make_files(rows)
    assert not found(files)
    ids = lambda **o: {r.id for r in scan(files, RULES, **o).findings.collect()}
    assert ids(multiline=True, parity=True) == set() == ids()
    assert {"A01-001", "A09-002", "CQ-010"} <= ids(multiline=True)


def test_long_lines_can_be_left_out(make_files):
    files = make_files([("r", "a.py", "except Exception:" + " " * 3000 + "\n    pass\nexcept Exception:\n    pass")])
    assert [r[3] for r in found(files, multiline=True) if r[2] == "CQ-010"] == [1, 3]
    assert [r[3] for r in found(files, multiline=True, max_line_chars=2000) if r[2] == "CQ-010"] == [3]


def test_many_matches_in_one_file(make_files):
    files = make_files([("r", "a.py", "except Exception:\n    pass\n" * 20_000)])
    assert sum(r[2] == "CQ-010" for r in found(files, multiline=True)) == 20_000
