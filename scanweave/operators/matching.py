"""Rules against lines.

Each file is one row and is matched inside that row: the literal regexes of the
catalogue become one expression over the file's lines, and what comes out is an
array of small hit structs.  Nothing that carries file content is ever joined,
grouped or shuffled, so the scan is a single pass over the corpus, and the same
expression runs on a stream.

Before a regex runs, the file must have one of the rule's suffixes or names, and the
line must hold the words the regex requires; those are searched for all rules at
once.

Rules written for several lines never match a single one.  With ``multiline`` they are also
matched against the file's lines joined by line feeds.  The joined text gets a mark before
every match, and a match's line is the line that holds its mark: one regex pass and one
split, however many matches there are.  A line that matches by itself is a hit of its own and
is masked before, so no match reaches over it and nothing is found twice.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, suffix
from ..functions.regex import SPACE, java_line_pattern, java_name_pattern, names_line_break
from ..functions.text import drop_last_empty, fold_sql, snippet_sql, split_lines, sql_string, window_sql
from ..functions.words import candidate_lines_sql, candidate_lines_udf, clauses_of
from ..rules.catalog import DOMAINS, Rule, builtin_rules

# With ``parity`` longer lines are not matched; findings show this much code.
PARITY_LINE_CHARS = 2000
CODE_CHARS = 200
# Characters that no text may hold: before a match over several lines, and in place of a masked line.
MARK, MASK = "\ufdd0", "\ufdd1"
# Rules whose words are looked up together, before each by itself.
GROUP = 12


def with_lines(files: DataFrame) -> DataFrame:
    """Add ``name``, ``ext`` and ``lines`` to ``files``."""
    split = files.withColumn("lines", split_lines(F.col("content")))
    return (
        split.withColumn("lines", drop_last_empty(F.col("lines")))
        .withColumn("name", file_name(F.col("path")))
        .withColumn("ext", suffix(F.col("name")))
    )


def scan_lines(
    files: DataFrame, rules: tuple[Rule, ...] | None = None, keep: list[str] | None = None, automaton: bool = True,
    max_line_chars: int | None = None, multiline: bool = False, active: str | None = None,
) -> DataFrame:
    """Match line rules and file-name rules against ``files(repo_id, path, content)``.

    One output row per hit: the ``keep`` columns of the file, then ``rule_no`` (the
    rule's place in ``rules``), ``line``, ``code`` and ``context``.  Required
    words are searched in an Arrow batch function, or with ``automaton=False`` in SQL.
    ``max_line_chars`` leaves out longer lines; see :func:`unscanned` for what that costs.
    With ``multiline``, rules that ask for a line feed are matched over several lines too; their
    ``line`` is the first one.  ``active`` names a column with a bit per domain, as
    :func:`~scanweave.operators.pruning.with_active` adds it: rules of other domains are not tried.
    """
    keep = keep or ["repo_id", "path"]
    found = file_hits(files, rules, keep, automaton, max_line_chars, multiline, active)
    # Not ``explode``: it brings a filter on the size of ``hits``, which moves below the expressions that
    # make them.  All of them would run twice, and a file would be split anew for every line that is tried.
    hits = found.select(*keep, F.explode_outer("hits").alias("hit")).where("hit IS NOT NULL")
    return hits.select(*keep, "hit.rule_no", "hit.line", "hit.code", "hit.context")


def file_hits(
    files: DataFrame, rules: tuple[Rule, ...] | None = None, keep: list[str] | None = None, automaton: bool = True,
    max_line_chars: int | None = None, multiline: bool = False, active: str | None = None, context: bool = True,
) -> DataFrame:
    """One row per file, also without hits: the ``keep`` columns and ``hits``, an array of what :func:`scan_lines` lists.

    Without ``context`` the lines around a hit are neither made nor listed.
    """
    rules = builtin_rules() if rules is None else rules
    keep = keep or ["repo_id", "path"]
    patterns = tuple("" if r.file_check else r.pattern for r in rules)
    numbered = "transform(lines, (t, i) -> i + 1)"
    if max_line_chars is not None:
        numbered = f"filter(transform(lines, (t, i) -> IF(char_length(t) <= {max_line_chars}, i + 1, 0)), n -> n > 0)"

    if active is not None and automaton:  # without an active domain nothing of the content is used
        files = files.withColumn("content", F.expr(f"CASE WHEN {active} <> 0 THEN content END"))
    prepared = with_lines(files).withColumns({"low": F.expr(fold_sql("content")), "short": F.expr(numbered)})
    text = F.make_valid_utf8("content")  # Python reads no other; it folds the text itself
    if automaton and active is not None:
        bits = tuple(domain_bit(r.domain) for r in rules)
        candidates = candidate_lines_udf(patterns, max_line_chars, bits=bits)(text, F.col(active))
    elif automaton:
        candidates = candidate_lines_udf(patterns, max_line_chars)(text)
    else:
        candidates = F.expr(candidate_lines_sql("low", "short", patterns))
    matched = prepared.withColumn("candidates", candidates).withColumn("matched", F.expr(_line_numbers(rules, active)))
    if multiline:
        matched = matched.withColumn("matched", F.concat("matched", F.expr(_first_lines(rules, max_line_chars, active))))
    return matched.select(*keep, F.expr(_hit_structs(rules, active, context)).alias("hits"))


def unscanned(files: DataFrame, max_line_chars: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """``(repo_id, path, reason, lines, bytes)``: what these limits leave out of ``files``."""
    parts = []
    if max_file_bytes is not None:
        large = files.where(F.col("size") > max_file_bytes)
        parts.append(large.select("repo_id", "path", F.lit("file size").alias("reason"), F.lit(None).cast("bigint").alias("lines"), F.col("size").alias("bytes")))
    if max_line_chars is not None:
        rest = files if max_file_bytes is None else files.where(F.col("size") <= max_file_bytes)
        long = F.filter("lines", lambda t: F.char_length(t) > max_line_chars)
        size = F.aggregate("long", F.lit(0).cast("bigint"), lambda s, t: s + F.octet_length(t))
        rows = with_lines(rest).withColumn("long", long).where(F.size("long") > 0)
        parts.append(rows.select("repo_id", "path", F.lit("line length").alias("reason"), F.size("long").cast("bigint").alias("lines"), size.alias("bytes")))
    if not parts:
        return files.where("false").selectExpr("repo_id", "path", "'' AS reason", "0L AS lines", "0L AS bytes")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def domain_bit(domain: str) -> int:
    return 1 << DOMAINS.index(domain)


def _applies(rule: Rule, active: str | None = None) -> str:
    return _if_active(rule, active, _bound_to(rule))


def _if_active(rule: Rule, active: str | None, test: str) -> str:
    return test if active is None else f"({active} & {domain_bit(rule.domain)}L) <> 0 AND ({test})"


def _bound_to(rule: Rule) -> str:
    if rule.langs is not None and not rule.langs:
        return "false"  # bound to no file at all
    tests = []
    if rule.suffixes:
        tests.append(f"ext IN ({', '.join(map(sql_string, rule.suffixes))})")
    if rule.names:
        tests.append(f"name IN ({', '.join(map(sql_string, rule.names))})")
    return " OR ".join(tests) or "true"


@lru_cache(maxsize=8)
def _line_numbers(rules: tuple[Rule, ...], active: str | None = None) -> str:
    """``array<struct<rule_no, ns>>``: per rule with hits, the numbers of its lines."""
    groups: dict[tuple, list[tuple[int, str]]] = {}
    for no, rule in enumerate(rules):
        if rule.file_check:
            continue
        searched = bool(clauses_of(rule.pattern))
        row = f"struct({no} AS rule_no, CASE WHEN {_worth_trying(no, rule, active)} THEN {_matching_lines(no, rule)} END AS ns)"
        groups.setdefault((no // GROUP, searched), []).append((no, row))
    none = "CAST(array() AS ARRAY<STRUCT<rule_no: INT, ns: ARRAY<INT>>>)"
    parts = []
    for (_, searched), rows in groups.items():
        found = f"filter(array({', '.join(row for _, row in rows)}), r -> size(r.ns) > 0)"
        if searched:  # a file has words of few rules: the others are passed over a group at a time
            first, last = rows[0][0], rows[-1][0]
            found = f"CASE WHEN exists(slice(candidates, {first + 1}, {last - first + 1}), c -> c IS NOT NULL) THEN {found} ELSE {none} END"
        parts.append(found)
    return f"concat({', '.join(parts)})" if parts else none


def _worth_trying(no: int, rule: Rule, active: str | None) -> str:
    """:func:`_applies` for files that hold the words: most files lack them, and that is the cheaper test."""
    if not clauses_of(rule.pattern):
        return _applies(rule, active)
    return _if_active(rule, active, f"get(candidates, {no}) IS NOT NULL AND ({_bound_to(rule)})")


def _matching_lines(no: int, rule: Rule) -> str:
    tried = f"get(candidates, {no})" if clauses_of(rule.pattern) else "short"
    numbers = f"filter({tried}, n -> element_at(lines, n) RLIKE {sql_string(java_line_pattern(rule.pattern))})"
    return _not_cancelled(numbers, rule)


@lru_cache(maxsize=8)
def _first_lines(rules: tuple[Rule, ...], max_line_chars: int | None = None, active: str | None = None) -> str:
    """As :func:`_line_numbers`, of matches that reach over several lines: their first lines."""
    per_rule = []
    too_long = f"char_length(t) > {max_line_chars} OR " if max_line_chars is not None else ""
    for no, rule in enumerate(rules):
        if rule.file_check or not names_line_break(rule.pattern):
            continue
        pattern = sql_string(java_line_pattern(rule.pattern))
        words = " AND ".join("(" + " OR ".join(f"contains(low, {sql_string(w)})" for w in c) + ")" for c in clauses_of(rule.pattern))
        free = f"transform(lines, t -> IF({too_long}t RLIKE {pattern}, '{MASK}', translate(t, '{MARK}{MASK}', '\ufffd\ufffd')))"
        marked = f"split(regexp_replace(array_join({free}, '\\n'), {pattern}, '{MARK}$0'), '\\n', -1)"
        numbers = f"filter(transform({marked}, (t, i) -> IF(contains(t, '{MARK}'), i + 1, 0)), n -> n > 0)"
        per_rule.append(
            f"struct({no} AS rule_no, CASE WHEN ({_applies(rule, active)}) AND {words or 'true'} THEN {_not_cancelled(numbers, rule)} END AS ns)"
        )
    if not per_rule:
        return "CAST(array() AS ARRAY<STRUCT<rule_no: INT, ns: ARRAY<INT>>>)"
    return f"filter(array({', '.join(per_rule)}), r -> size(r.ns) > 0)"


def _not_cancelled(numbers: str, rule: Rule) -> str:
    if rule.negative_pattern:
        near = f"array_join({window_sql('lines', 'n', 4, 5)}, '\\n')"
        cancel = f"{near} RLIKE {sql_string(java_line_pattern(rule.negative_pattern))}"
        numbers = f"filter({numbers}, n -> NOT {cancel})"
    return numbers


def _hit_structs(rules: tuple[Rule, ...], active: str | None = None, context: bool = True) -> str:
    code = f"substring({_strip_sql('element_at(lines, n)')}, 1, {CODE_CHARS})"
    around = f", {snippet_sql('lines', 'n')} AS context" if context else ""
    hit = f"struct(m.rule_no AS rule_no, n AS line, {code} AS code{around})"
    line_hits = f"flatten(transform(matched, m -> transform(m.ns, n -> {hit})))"
    # The start of the file as text: every line break written as a line feed.
    head = f"substring(regexp_replace(substring(content, 1, {2 * CODE_CHARS}), '\\\\r\\\\n?', '\\n'), 1, {CODE_CHARS})"
    start = f", {head} AS context" if context else ""
    by_name = [
        f"CASE WHEN ({_applies(rule, active)}) AND name RLIKE {sql_string(java_name_pattern(rule.pattern))} THEN "
        f"struct({no} AS rule_no, 0 AS line, '.env file detected' AS code{start}) END"
        for no, rule in enumerate(rules)
        if rule.file_check
    ]
    if not by_name:
        return line_hits
    return f"concat({line_hits}, filter(array({', '.join(by_name)}), h -> h IS NOT NULL))"


def _strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, {sql_string(rf'\A[{SPACE}]+|[{SPACE}]+\z')}, '')"
