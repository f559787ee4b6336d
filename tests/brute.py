"""The expected findings, computed plainly with Python's own regexes."""

import re

FLAGS = re.IGNORECASE | re.MULTILINE


def hits(rules, files):
    """``{(repo_id, path, rule_id, line, code, context)}`` for rows (repo_id, path, text)."""
    out = set()
    compiled = [(r, re.compile(r.pattern, FLAGS), r.negative_pattern and re.compile(r.negative_pattern, FLAGS)) for r in rules]
    for repo, path, text in files:
        lines = text.splitlines()
        name = path.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        ext = name[dot:].lower() if 0 < dot < len(name) - 1 else ""
        for rule, main, negative in compiled:
            if rule.file_check or (rule.langs is not None and ext not in rule.suffixes and name not in rule.names):
                continue
            for i, line in enumerate(lines):
                if not main.search(line):
                    continue
                if negative and negative.search("\n".join(lines[max(0, i - 4) : i + 6])):
                    continue
                context = "\n".join(
                    f"{'>>>' if k == i else '   '} {k + 1:4d}: {lines[k]}" for k in range(max(0, i - 3), min(len(lines), i + 4))
                )
                out.add((repo, path, rule.rule_id, i + 1, line.strip()[:200], context))
    return out
