"""The registered queries once more, as SQL for another engine (DuckDB).

Used to check results; built from the same fixed values, but from none of the
DataFrame code.  RE2 has no look-around, so thirteen patterns are restated here.
"""

from __future__ import annotations

from ..functions.regex import names_line_break
from ..operators import file_filters as ff
from ..operators import profile as pr
from ..rules.catalog import CORE_DOMAINS, DOMAINS, OPTIONAL_DOMAINS, builtin_rules
from ..sources.settings import CONFIG_FILES
from . import corpus as co
from .report import OWASP_TOP_10

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def strings(items: list[str]) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def among(items: list[str]) -> str:
    return "(" + ", ".join(map(q, items)) + ")"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q('(?im)' + pattern)})"


def _some_tail(before: str, tail: str) -> str:
    """Does ``before`` occur somewhere with ``tail`` not following it?"""
    parts = f"string_split_regex(line, {q('(?im)' + before)})[2:]"
    return f"len(list_filter({parts}, lambda p: NOT {matches('p', '^' + tail)})) > 0"


def _nothing_after(before: str, later: str) -> str:
    """Does the last ``before`` have no ``later`` behind it?"""
    rest = f"regexp_extract(line, {q('(?im).*(?:' + before + ')(.*)$')}, 1)"
    return f"({matches('line', before)} AND NOT {matches(rest, later)})"


# Look-around patterns, restated as conditions on ``line``.
RESTATED = {
    "A02-005": _some_tail(r"""["\']http://""", r"(localhost|127\.0\.0\.1|0\.0\.0\.0|::1)"),
    "A04-002": _nothing_after(r"request\.json\[|request\.form\[|req\.body\.|params\[|query\[", "validate|schema|sanitize"),
    "A08-003": _nothing_after(r"yaml\.load\s*\(", r"Loader=yaml\.SafeLoader|Loader=yaml\.BaseLoader"),
    "CQ-012": "(" + _some_tail(r"\.then\s*\([^)]*\)", r"\s*\.catch") + " OR " + _nothing_after(r"\basync\s+function\b", "try") + ")",
    "CQ-021": matches("line", r"""(^|[^"\'.\w])(\d\d|[02-9]\d\d|\d[1-9]\d|\d\d[1-9]|\d{4,})\b"""),
    "WEB-004": _some_tail(r"""@app\.route\(["\']/(?:api)?/""", "v[0-9]"),
    "MOB-011": _nothing_after(r"Intent\(\)", "setPackage|setClass"),
    "EMB-041": "false",  # needs a line break
    "EMB-031": _some_tail(r"=\s*malloc\s*\([^;]+;", r"\s*(if|assert)"),
    "PIPE-041": matches("line", r"registry\.npmjs\.org|pypi\.org|--index-url\s+|npm install.*--registry"),
    "AIML-010": _nothing_after(r"(?:torch\.load|pickle\.load|tf\.saved_model\.load|joblib\.load)\s*\(", "trusted|local"),
    "AIML-011": _nothing_after(r"torch\.load\s*\(", r"weights_only\s*=\s*True"),
}
RESTATED_NEGATIVE = {
    "PIPE-002": "len(list_filter(string_split_regex(near, '(?im)USER\\s+')[2:], "
    "lambda p: " + matches("p", r"^\w") + " AND NOT " + matches("p", "^(root|0)") + ")) > 0",
}


def _applies(rule) -> str:
    tests = ([f"ext IN {among(rule.suffixes)}"] if rule.suffixes else []) + ([f"name IN {among(rule.names)}"] if rule.names else [])
    return "(" + " OR ".join(tests) + ")" if tests else "true"


def _main(rule) -> str:
    return RESTATED.get(rule.rule_id) or matches("line", rule.pattern)


def _negative(rule) -> str:
    return RESTATED_NEGATIVE.get(rule.rule_id) or matches("near", rule.negative_pattern)


def _hits_sql() -> str:
    rules = list(enumerate(builtin_rules()))
    cases = ", ".join(f"CASE WHEN {_applies(r)} AND {_main(r)} THEN {i} END" for i, r in rules if not r.file_check)
    negative = " ".join(f"WHEN {i} THEN {_negative(r)}" for i, r in rules if r.negative_pattern)
    return f"""
      SELECT *, coalesce(CASE rule_no {negative} END, false) AS cancelled FROM (
        SELECT *, array_to_string(lines[greatest(n - 4, 1):n + 5], chr(10)) AS near FROM (
          SELECT *, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule_no FROM (
            SELECT *, lines[n] AS line FROM (
              SELECT repo_id, path, name, ext, lines, unnest(range(1, len(lines) + 1)) AS n FROM scanned
            )
          )
        )
      )"""


# The one rule over several lines with a look-ahead: what it looks for, then what must not follow.
SPANNING = {"EMB-041": (r"xSemaphoreTake\s*\(.*\).*\n", "xSemaphoreGive")}


def _spanning_hits_sql() -> str:
    """Matches over several lines: their line is the number of line feeds before them, and one.

    A match is found by what stands between matches; lines that match by themselves part the
    text, so no match reaches over them.
    """
    parts = []
    for i, r in enumerate(r for r in builtin_rules() if names_line_break(r.pattern)):
        pattern, not_next = SPANNING.get(r.rule_id, (r.pattern, None))
        p = q("(?im)" + pattern)
        alone = "false" if not_next else f"regexp_matches(t, {p})"
        joined = f"array_to_string(list_transform(lines, lambda t: CASE WHEN {alone} THEN chr(1) ELSE t END), chr(10))"
        feeds = "(length({0}) - length(replace({0}, chr(10), '')))".format
        before = f"list_sum(list_transform(pieces[1:k], lambda t: {feeds('t')})) + coalesce(list_sum(list_transform(found[1:k - 1], lambda t: {feeds('t')})), 0)"
        over = f"""SELECT *, CAST(1 + {before} AS BIGINT) AS n, len(found[k]) > 0 AS real FROM (
            SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (
              SELECT repo_id, path, lines, string_split_regex(joined, {p}) AS pieces, regexp_extract_all(joined, {p}) AS found
              FROM (SELECT repo_id, path, lines, {joined} AS joined FROM ml_scanned WHERE {_applies(r)})))"""
        after = f"AND NOT contains(lower(coalesce(lines[n + 1], '')), {q((not_next or '').lower())})" if not_next else ""
        near = "array_to_string(lines[greatest(n - 4, 1):n + 5], chr(10))"
        cancel = f"AND NOT regexp_matches({near}, {q('(?im)' + r.negative_pattern)})" if r.negative_pattern else ""
        parts.append(f"SELECT DISTINCT repo_id, path, lines, {q(r.rule_id)} AS id, n FROM ({over}) WHERE real {after} {cancel}")
        if not not_next:
            single = f"SELECT repo_id, path, lines, unnest(range(1, len(lines) + 1)) AS n FROM ml_scanned WHERE {_applies(r)}"
            parts.append(f"SELECT repo_id, path, lines, {q(r.rule_id)}, n FROM ({single}) WHERE regexp_matches(lines[n], {p}) {cancel}")
    return " UNION ALL ".join(parts)


def _architecture_rows() -> list[tuple]:
    rows = []
    for i, (arch, signals) in enumerate(pr.ARCHITECTURES.items()):
        for s in signals + (pr.WEARABLE_WORDS if arch == "wearable" else []):
            low = s.lower()
            rows.append((i, arch, s, low, "true" if low.startswith(".") and "/" not in low else "false"))
    return [(i, a, s, low, flag == "true") for i, a, s, low, flag in rows]


def _framework_rows() -> list[tuple]:
    return [(i, s, f) for i, (s, f) in enumerate(pr.FRAMEWORKS.items())]


def _starts(column: str, items: list[str]) -> str:
    return " OR ".join(f"starts_with({column}, {q(i)})" for i in items)


def _has(column: str, items: list[str]) -> str:
    return " OR ".join(f"contains({column}, {q(i)})" for i in items)


def _config_sql(files: str = "files") -> str:
    """JSON settings are read as JSON; the one YAML text of the corpus is stated."""
    order = " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(CONFIG_FILES))
    text = lambda k: f"json_extract_string(j, '$.{k}')"
    names = lambda k: f"coalesce(CAST(json_extract(j, '$.{k}') AS VARCHAR[]), [])"
    yaml = (
        '{"fail_threshold": "HIGH", "include_domains": ["web", "ai_ml"], "ignore_patterns": ["*.js", "docs/", "a\\tb.txt"], '
        '"dependency_audit": {"enabled": false}, "baseline_file": ".security_baseline.json"}'
    )
    return f"""
      SELECT repo_id, config_path, coalesce({text('fail_threshold')}, 'CRITICAL') AS fail_threshold,
        {names('include_domains')} AS include_domains, {names('exclude_domains')} AS exclude_domains,
        {names('ignore_patterns')} AS ignore_patterns, {text('baseline_file')} AS baseline_file,
        coalesce(CAST(json_extract(j, '$.dependency_audit.enabled') AS BOOLEAN), true) AS audit_enabled,
        coalesce(CAST(json_extract(j, '$.dependency_audit.tools') AS VARCHAR[]), ['pip-audit', 'npm-audit', 'osv-scanner']) AS audit_tools
      FROM (SELECT DISTINCT repo_id FROM {files}) LEFT JOIN (
        SELECT repo_id, path AS config_path,
          TRY_CAST(CASE WHEN ends_with(path, '.json') THEN content ELSE {q(yaml)} END AS JSON) AS j
        FROM {files} WHERE path IN {among(CONFIG_FILES)}
        QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY CASE path {order} END) = 1
      ) USING (repo_id)"""


def _fnmatch(path: str, glob: str) -> str:
    """Glob test by regex; the corpus uses ``*``, ``?`` and plain sets only."""
    escaped = f"replace(replace(replace({glob}, '.', '\\.'), '*', '.*'), '?', '.')"
    return f"regexp_matches({path}, '(?s)^(' || {escaped} || ')(/.*)?$')"


def _kept_sql(files: str) -> str:
    return f"""
      SELECT *, lower(path) AS lpath, lower(name) AS lname, '/' || lower(array_to_string(dirs, '/')) AS ldir,
        lower(regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1)) AS ext
      FROM (SELECT *, string_split(path, '/')[1:-2] AS dirs, string_split(path, '/')[-1] AS name FROM {files})
      WHERE len(list_filter(dirs, lambda x: x IN {among(ff.WALK_SKIP)} OR (starts_with(x, '.') AND x NOT IN ('.github', '.gitlab')))) = 0"""


def _scanned_sql(kept: str) -> str:
    return f"""
      SELECT *, CASE WHEN s[-1] = '' THEN s[1:-2] ELSE s END AS lines
      FROM (SELECT *, string_split_regex(content, {q(LINE_BREAK)}) AS s FROM {kept})
      WHERE len(list_filter(dirs, lambda x: x IN {among(ff.SCAN_SKIP)})) = 0
        AND ext NOT IN {among(ff.BINARY_SUFFIXES)} """


_R = builtin_rules()

PARTS: dict[str, tuple[list[str], str]] = {
    "plants": ([], f"SELECT * FROM ({values(co.plants())}) AS t(no, rule_id, tail, planted)"),
    "docs": (["plants"], f"""
      SELECT doc_id AS d, source || '-' || ((doc_id // 20) % 6) AS repo_id, rule_id, text, planted,
        {strings(co.DIRECTORIES)}[CAST(doc_id % {len(co.DIRECTORIES)} AS INT) + 1] || '/' || doc_id || tail AS path
      FROM documents JOIN plants ON no = doc_id % {len(co.plants())}"""),
    "roots": (["docs"], f"""
      SELECT *, rule_id || ':' || path || ':' || line AS k FROM (
        SELECT repo_id, d, rule_id, path, len(string_split_regex(text, {q(LINE_BREAK)})) + 1 AS line FROM docs
        QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY d) = 1)"""),
    "files": (["docs", "roots"], f"""
      SELECT *, strlen(content) AS size FROM (
        SELECT repo_id, path, text || chr(10) || planted AS content FROM docs
        UNION ALL
        SELECT regexp_extract(url, 'https?://([^/]+)', 1),
          'site/' || page_id || '/' || {strings(co.PAGE_NAMES)}[CAST(page_id % {len(co.PAGE_NAMES)} AS INT) + 1],
          html || {q(co.PAGE_LINES)} FROM pages
        UNION ALL
        SELECT repo_id, {strings(co.MANIFEST_NAMES)}[CAST(d % 4 AS INT) + 1], {strings(co.MANIFEST_TEXTS)}[CAST(d % 3 AS INT) + 1] FROM roots
        UNION ALL SELECT repo_id, '.securityignore', {q(co.IGNORE_TEXT)} FROM roots WHERE d % 3 = 0
        UNION ALL SELECT repo_id, '.security-agent.json', {strings(co.CONFIG_TEXTS)}[CAST((d // 4) % {len(co.CONFIG_TEXTS)} AS INT) + 1] FROM roots WHERE d % 4 = 1
        UNION ALL SELECT repo_id, '.security-agent.yml', {q(co.YAML_TEXT)} FROM roots WHERE d % 4 = 2
        UNION ALL SELECT repo_id, '.security_baseline.json', CASE d % 3
            WHEN 0 THEN '{{"accepted_findings": ["' || k || '", "X-1:none.py:1"]}}'
            WHEN 1 THEN '{{"accepted_findings": [{{"id": "' || rule_id || '", "file": "' || path || '", "line": ' || line || '}}]}}'
            ELSE '["' || k || '"]' END
          FROM roots WHERE d % 2 = 1)"""),
    "kept": (["files"], _kept_sql("files")),
    "scanned": (["kept"], _scanned_sql("kept")),
    "ml_plants": ([], f"SELECT * FROM ({values(co.multiline_plants())}) AS t(no, rule_id, tail, planted)"),
    "ml_files": (["ml_plants"], f"""
      SELECT *, strlen(content) AS size FROM (
        SELECT source || '-' || ((doc_id // 20) % 6) AS repo_id, text || chr(10) || planted AS content,
          {strings(co.DIRECTORIES)}[CAST(doc_id % {len(co.DIRECTORIES)} AS INT) + 1] || '/' || doc_id || tail AS path
        FROM documents JOIN ml_plants ON no = doc_id % {len(co.multiline_plants())})"""),
    "ml_kept": (["ml_files"], _kept_sql("ml_files")),
    "ml_scanned": (["ml_kept"], _scanned_sql("ml_kept")),
    "rules": ([], f"""SELECT * FROM ({values([
        (i, r.rule_id, r.domain, r.category, r.name, r.severity, r.description, r.fix, r.owasp, r.cwe, r.negative_pattern is not None)
        for i, r in enumerate(_R)
      ])}) AS t(rule_no, id, domain, category, name, severity, description, fix, owasp, cwe, has_negative)"""),
    "raw_hits": (["scanned"], _hits_sql()),
    "hits": (["raw_hits"], f"""
      SELECT repo_id, path, rule_no, CAST(n AS INT) AS line,
        substring(regexp_replace(regexp_replace(line, '^[{SPACE}]+', ''), '[{SPACE}]+$', ''), 1, 200) AS code,
        array_to_string(list_transform(range(greatest(n - 3, 1), least(n + 3, len(lines)) + 1),
          lambda i: printf('%s %4d: ', CASE WHEN i = n THEN '>>>' ELSE '   ' END, i) || lines[i]), chr(10)) AS context
      FROM raw_hits WHERE NOT cancelled
      UNION ALL
      SELECT repo_id, path, {next(i for i, r in enumerate(_R) if r.file_check)}, 0, '.env file detected',
        substring(regexp_replace(substring(content, 1, 400), '\\r\\n?', chr(10), 'g'), 1, 200)
      FROM scanned WHERE regexp_matches(name, '(?i)^\\.env(\\.(local|dev|development|prod|production|staging))?$')"""),
    "framework_rows": ([], f"SELECT * FROM ({values(_framework_rows())}) AS t(ord, sig, fw)"),
    "frameworks": (["kept", "framework_rows"], f"""
      SELECT repo_id, list(fw ORDER BY o) AS frameworks FROM (
        SELECT repo_id, fw, min(o) AS o FROM (
          SELECT repo_id, fw, ord AS o FROM kept JOIN framework_rows ON name = sig OR lname = sig
          UNION ALL SELECT repo_id, 'Kubernetes', 1000 FROM kept WHERE contains(ldir, 'kubernetes') OR contains(ldir, '/k8s')
          UNION ALL SELECT repo_id, 'Terraform', 1001 FROM kept WHERE contains(ldir, 'terraform')
          UNION ALL SELECT repo_id, 'Helm', 1002 FROM kept WHERE contains(ldir, 'helm')
        ) GROUP BY repo_id, fw) GROUP BY repo_id"""),
    "architecture_rows": ([], f"SELECT * FROM ({values(_architecture_rows())}) AS t(ord, arch, sig, low, as_suffix)"),
    "architectures": (["kept", "architecture_rows"], """
      SELECT repo_id, list(arch ORDER BY ord) AS arch_types FROM (
        SELECT DISTINCT repo_id, arch, ord FROM kept JOIN architecture_rows
          ON (as_suffix AND (name = sig OR lname = low OR ext = low)) OR (NOT as_suffix AND contains(lpath, low))
      ) GROUP BY repo_id"""),
    "language_rows": ([], f"SELECT * FROM ({values(list(pr.LANGUAGES.items()))}) AS t(suffix, lang)"),
    "language_counts": (["kept", "language_rows"], """
      SELECT repo_id, lang, count(*) AS n, min(path) AS first_path FROM kept JOIN language_rows ON ext = suffix GROUP BY repo_id, lang"""),
    "languages": (["language_counts"], """
      SELECT repo_id, lang, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, first_path) AS pos FROM language_counts
      QUALIFY pos <= 10"""),
    "flags": (["kept", "files"], f"""
      SELECT repo_id, count(*) AS total_files,
        bool_or(lname IN {among(pr.WEB_NAMES)} OR {_starts('lpath', pr.WEB_STARTS)}) AS web_files,
        bool_or(lname IN {among(pr.PIPELINE_NAMES)} OR {_starts('lpath', pr.PIPELINE_STARTS)} OR {_has('lpath', pr.PIPELINE_PARTS)}) AS pipeline_files,
        bool_or(lname IN {among(pr.AI_NAMES)}) AS ai_files,
        bool_or(starts_with(lpath, 'tests/') OR starts_with(lpath, 'test/') OR contains(lpath, '/tests/') OR starts_with(lname, 'test_')
          OR {' OR '.join(f"ends_with(lname, {q(e)})" for e in pr.TEST_ENDS)}) AS has_tests
      FROM kept GROUP BY repo_id"""),
    "packages": (["files"], f"""
      SELECT repo_id, bool_or({_has('lower(content)', pr.AI_PACKAGES)}) AS ai_packages FROM files
      WHERE path IN {among(pr.MANIFESTS)} GROUP BY repo_id"""),
    "configs": (["files"], _config_sql()),
    "domains": (["flags", "frameworks", "architectures", "packages", "configs"], f"""
      SELECT repo_id, total_files, has_tests, frameworks, arch_types,
        list_filter({strings(DOMAINS)}, lambda x: list_contains(found, x)) AS security_domains,
        list_filter({strings(OPTIONAL_DOMAINS)}, lambda x: NOT list_contains(found, x)) AS skipped_domains
      FROM (
        SELECT *, list_filter(list_concat({strings(CORE_DOMAINS)}, [
            CASE WHEN list_contains(arch_types, 'web') OR web_files
              OR len(list_filter(frameworks, lambda x: lower(x) IN {among(pr.WEB_FRAMEWORKS)})) > 0 THEN 'web' END,
            CASE WHEN len(list_filter(arch_types, lambda x: x IN {among(pr.MOBILE_ARCHITECTURES)})) > 0 THEN 'mobile' END,
            CASE WHEN list_contains(arch_types, 'embedded') THEN 'embedded' END,
            CASE WHEN list_contains(arch_types, 'devops') OR pipeline_files THEN 'pipeline' END,
            CASE WHEN list_contains(arch_types, 'ai_ml') OR ai_files OR ai_packages THEN 'ai_ml' END], include_domains),
            lambda x: x IS NOT NULL AND NOT list_contains(exclude_domains, x)) AS found
        FROM (
          SELECT repo_id, total_files, has_tests, web_files, pipeline_files, ai_files, coalesce(ai_packages, false) AS ai_packages,
            coalesce(frameworks, []) AS frameworks, coalesce(arch_types, ['cli']) AS arch_types,
            coalesce(include_domains, []) AS include_domains, coalesce(exclude_domains, []) AS exclude_domains
          FROM flags LEFT JOIN frameworks USING (repo_id) LEFT JOIN architectures USING (repo_id)
            LEFT JOIN packages USING (repo_id) LEFT JOIN configs USING (repo_id)))"""),
    "ignores": (["files", "configs"], f"""
      SELECT repo_id, replace(t, chr(92), '/') AS "glob" FROM (
        SELECT repo_id, trim(unnest(string_split_regex(content, {q(LINE_BREAK)})), ' ' || chr(9)) AS t FROM files WHERE path = '.securityignore')
      WHERE t <> '' AND NOT starts_with(t, '#')
      UNION ALL SELECT repo_id, unnest(ignore_patterns) FROM configs"""),
    "ignored": (["kept", "ignores"], f"""
      SELECT DISTINCT repo_id, path FROM kept JOIN (SELECT repo_id, ltrim("glob", '/') AS g FROM ignores) USING (repo_id)
      WHERE CASE WHEN ends_with(g, '/') THEN starts_with(path, g) ELSE {_fnmatch('path', 'g')} END"""),
    "baseline": (["files", "configs"], """
      SELECT DISTINCT repo_id, CASE WHEN json_type(e) = 'OBJECT'
          THEN (e->>'$.id') || ':' || (e->>'$.file') || ':' || (e->>'$.line') ELSE e->>'$' END AS finding_key FROM (
        SELECT repo_id, unnest(CAST(CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE json_extract(j, '$.accepted_findings') END AS JSON[])) AS e
        FROM (SELECT f.repo_id, CAST(f.content AS JSON) AS j FROM files f JOIN configs c ON f.repo_id = c.repo_id AND f.path = c.baseline_file))"""),
    "active": (["hits", "domains", "rules"], """
      SELECT h.repo_id, r.id, r.category, r.name, r.severity, r.description, r.fix, h.path AS file, h.line, h.code, h.context, r.owasp, r.cwe,
        h.rule_no, CASE r.severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS rank,
        r.id || ':' || h.path || ':' || h.line AS finding_key
      FROM hits h JOIN rules r USING (rule_no) JOIN domains d ON h.repo_id = d.repo_id
      WHERE list_contains(d.security_domains, r.domain) AND NOT (r.id = 'CQ-050' AND d.has_tests)"""),
    "static_findings": (["active", "ignored"], """
      SELECT a.* FROM active a LEFT JOIN ignored i ON a.repo_id = i.repo_id AND a.file = i.path WHERE i.path IS NULL"""),
    "findings": (["static_findings", "baseline"], """
      SELECT s.* FROM static_findings s LEFT JOIN baseline b ON s.repo_id = b.repo_id AND s.finding_key = b.finding_key
      WHERE b.finding_key IS NULL"""),
    "queue": (["findings"], """
      SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY rank, file, rule_no, line) AS position,
        row_number() OVER (PARTITION BY repo_id, severity ORDER BY file, rule_no, line) AS ordinal,
        row_number() OVER (PARTITION BY repo_id ORDER BY file, rule_no, line) AS seq,
        count(*) OVER (PARTITION BY repo_id) AS total FROM findings"""),
    "counts": (["findings", "domains"], """
      SELECT repo_id, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
        coalesce(low, 0) AS low, coalesce(info, 0) AS info, coalesce(total, 0) AS total
      FROM domains LEFT JOIN (SELECT repo_id, count(*) FILTER (severity = 'CRITICAL') AS critical,
          count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
          count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info, count(*) AS total
        FROM findings GROUP BY repo_id) USING (repo_id)"""),
    "owasp": (["findings", "domains"], f"""
      SELECT d.repo_id, o.owasp, o.name, coalesce(c, 0) AS findings,
        CASE WHEN c > 0 THEN '⚠️ ' || c || ' issue(s) found' ELSE '✅ No issues detected' END AS status
      FROM domains d CROSS JOIN ({values(list(OWASP_TOP_10.items()))}) AS o(owasp, name)
      LEFT JOIN (SELECT repo_id, owasp, count(*) AS c FROM findings WHERE owasp <> '' GROUP BY 1, 2) f
        ON f.repo_id = d.repo_id AND f.owasp = o.owasp"""),
    "matrix": (["findings"], """
      SELECT repo_id, category, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
        count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
        count(*) FILTER (rank < 4) AS total FROM findings GROUP BY 1, 2"""),
}

# Parts that several others read: computed once.
ONCE = {"files", "kept", "scanned", "ml_files", "ml_kept", "ml_scanned", "raw_hits", "hits", "domains", "findings", "queue"}


def sql(final: str, *needs: str) -> str:
    """``final`` with the parts it needs put before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in PARTS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({PARTS[n][1]})" for n in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final

# --- the queries ----------------------------------------------------------------

_AUDIT = """
  SELECT 'order-' || l_orderkey AS repo_id, l_orderkey AS o, l_partkey AS pk, p_name AS p, l_returnflag AS rf, l_linestatus AS ls,
    l_quantity AS qty, l_linenumber AS ln, l_linenumber || '.' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS version,
    CAST(round(l_tax * 100) AS INT) % 3 AS cnt,
    CASE l_linenumber % 3 WHEN 0 THEN 'pip-audit' WHEN 1 THEN 'npm-audit' ELSE 'osv-scanner' END AS tool
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
PARTS["audit_rows"] = ([], _AUDIT)
PARTS["audit_ok"] = (["audit_rows"], "SELECT * FROM audit_rows WHERE qty NOT IN (50, 7, 9)")


def _dependency(tool: str, label: str, rows: str, version: str, vuln: str, text: str, fix: str, file: str, severity: str = "'HIGH'") -> str:
    return f"""SELECT repo_id, o, '{tool}' AS id, p || ' vulnerable dependency' AS name, {severity} AS severity,
        {text} || ' (' || {vuln} || ', installed: ' || {version} || ')' AS description, {fix} AS fix, {file} AS file, p AS code,
        '{label} reported ' || p || ' ' || {version} || ': ' || {vuln} AS context, 'A06:2021' AS owasp, 'CWE-1104' AS cwe,
        'Dependency Security' AS category
      FROM ({rows})"""


PARTS["pip"] = (["audit_ok"], _dependency(
    "DEP-PIP-AUDIT", "pip-audit", "SELECT *, unnest(range(1, cnt + 1)) AS i FROM audit_ok WHERE tool = 'pip-audit'", "version",
    "'PYSEC-' || pk || '-' || i", "CASE WHEN rf <> 'A' THEN 'issue in ' || p ELSE 'Python dependency vulnerability detected.' END",
    "CASE WHEN ls = 'O' THEN version || ', 9.9' ELSE 'Upgrade to a non-vulnerable version.' END", "'requirements.txt'"))
PARTS["npm"] = (["audit_ok"], _dependency(
    "DEP-NPM-AUDIT", "npm audit", "SELECT * FROM audit_ok WHERE tool = 'npm-audit'", "'unknown'",
    "CASE rf WHEN 'A' THEN 'minimist' WHEN 'N' THEN CAST(pk AS VARCHAR) ELSE 'unknown' END",
    "CASE WHEN rf <> 'A' THEN 'flaw in ' || p ELSE 'Node dependency vulnerability detected.' END",
    "CASE WHEN ls = 'O' THEN 'take 2.0' ELSE 'Run npm audit fix where safe.' END", "'package.json'",
    "['CRITICAL', 'HIGH', 'MEDIUM', 'MEDIUM', 'LOW', 'HIGH'][CAST(ln % 6 AS INT) + 1]"))
PARTS["osv"] = (["audit_ok"], _dependency(
    "DEP-OSV-SCANNER", "osv-scanner", "SELECT *, unnest(range(1, cnt + 1)) AS i FROM audit_ok WHERE tool = 'osv-scanner'", "version",
    "'OSV-' || pk || '-' || i", "CASE WHEN rf <> 'A' THEN 'issue in ' || p ELSE 'Dependency vulnerability detected by OSV.' END",
    "'Upgrade to a fixed version listed by OSV.'", "CASE WHEN rf = 'N' THEN 'sub/pom.xml' ELSE 'dependency manifest' END"))
PARTS["problems"] = (["audit_rows"], """
  SELECT repo_id, o, tool, 'DEP-TOOL-MISSING-' || replace(upper(t), ' ', '-') AS id, t || ' not installed' AS name, 'INFO' AS severity,
    t || ' is not available, so dependency audit for ' || m || ' was skipped.' AS description,
    'Install ' || t || ' in CI or disable it in .security-agent.yml.' AS fix, m AS file, '' AS code, '' AS context,
    'A06:2021' AS owasp, '' AS cwe, 'Dependency Security' AS category
  FROM (SELECT *, CASE tool WHEN 'pip-audit' THEN 'pip-audit' ELSE 'npm audit' END AS t,
      CASE tool WHEN 'pip-audit' THEN 'requirements.txt' ELSE 'package.json' END AS m FROM audit_rows
    WHERE qty = 50 AND tool <> 'osv-scanner')
  UNION ALL
  SELECT repo_id, o, tool, 'DEP-TOOL-ERROR-' || replace(upper(t), ' ', '-'), t || ' failed', 'INFO',
    t || ' could not complete dependency audit.', 'Review tool installation and manifest validity.', 'dependency manifest', '',
    CASE WHEN ls = 'O' THEN 'tool broke' ELSE 'Invalid JSON output' END, 'A06:2021', '', 'Dependency Security'
  FROM (SELECT *, CASE tool WHEN 'npm-audit' THEN 'npm audit' ELSE tool END AS t FROM audit_rows WHERE qty = 7)""")
_REPO = "'src' || (o % 20) || '-' || (o % 6)"
PARTS["selected"] = (["configs", "files"], """
  SELECT repo_id, tool FROM (SELECT repo_id, unnest(audit_tools) AS tool FROM configs WHERE audit_enabled) c
  WHERE tool = 'osv-scanner' OR EXISTS (SELECT 1 FROM files f WHERE f.repo_id = c.repo_id
    AND f.path = CASE tool WHEN 'pip-audit' THEN 'requirements.txt' ELSE 'package.json' END)""")
PARTS["arrivals"] = (["docs", "kept"], """
  SELECT repo_id, path, d FROM docs
  UNION ALL SELECT repo_id, path, CAST(string_split(path, '/')[2] AS BIGINT) FROM kept WHERE starts_with(path, 'site/')""")
PARTS["stream_hits"] = (["raw_hits", "arrivals", "rules", "scanned"], """
  SELECT h.repo_id, d.d, h.path AS file, CAST(h.n AS INT) AS line, r.id, r.severity FROM raw_hits h
  JOIN arrivals d ON h.repo_id = d.repo_id AND h.path = d.path JOIN rules r USING (rule_no) WHERE NOT h.cancelled
  UNION ALL
  SELECT s.repo_id, d.d, s.path, 0, 'SEC-010', 'HIGH' FROM scanned s JOIN arrivals d ON s.repo_id = d.repo_id AND s.path = d.path
  WHERE s.name = '.env'""")

_DEP = "repo_id, id, name, severity, description, fix, file, code, context, owasp, cwe"
_JOINED = "array_to_string({0}, ', ') AS {0}"


def _joined(*names: str) -> str:
    return ", ".join(_JOINED.format(n) for n in names)


_GATE = """SELECT repo_id, fail_threshold, details = '' AS passed,
    CASE WHEN details = '' THEN '' ELSE 'Security gate failed at ' || fail_threshold || ': ' || details END AS details FROM (
  SELECT repo_id, fail_threshold, array_to_string(list_filter([
      CASE WHEN critical > 0 THEN critical || ' CRITICAL' END, CASE WHEN high > 0 AND t >= 1 THEN high || ' HIGH' END,
      CASE WHEN medium > 0 AND t >= 2 THEN medium || ' MEDIUM' END, CASE WHEN low > 0 AND t >= 3 THEN low || ' LOW' END,
      CASE WHEN info > 0 AND t >= 4 THEN info || ' INFO' END], lambda x: x IS NOT NULL), ', ') AS details
  FROM (SELECT *, CASE fail_threshold WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 0 END AS t FROM ({0})))"""
_LOOK = ["A02-005", "A04-002", "A08-003", "CQ-012", "CQ-021", "WEB-004", "MOB-011", "EMB-031", "EMB-041", "PIPE-002", "PIPE-041", "AIML-010", "AIML-011"]
_MARK = "CASE severity WHEN 'CRITICAL' THEN '🔴' WHEN 'HIGH' THEN '🟠' WHEN 'MEDIUM' THEN '🟡' WHEN 'LOW' THEN '🔵' ELSE '⚪' END"
_LINE = "replace({0}, '\\n', chr(10))"


def _n(text: str) -> str:
    """A literal in which line breaks are allowed."""
    return q(text)


_CARD = (
    "'### ' || ordinal || '. ' || name || " + _n("\n\n| Field | Value |\n|-------|-------|\n| **ID** | `")
    + " || id || " + _n("` |\n| **File** | `") + " || file || ':' || line || " + _n("` |\n| **Category** | ") + " || category || ' |' || "
    + "CASE WHEN cwe <> '' THEN " + _n("\n| **CWE** | [") + " || cwe || '](https://cwe.mitre.org/data/definitions/' || replace(cwe, 'CWE-', '') || '.html) |' ELSE '' END || "
    + "CASE WHEN owasp <> '' THEN " + _n("\n| **OWASP** | ") + " || owasp || ' |' ELSE '' END || "
    + _n("\n\n**Description:**\n") + " || description || " + _n("\n\n**Vulnerable Code:**\n```\n") + " || context || "
    + _n("\n```\n\n**Remediation:**\n") + " || fix || " + _n("\n\n---")
)


def _report_sql() -> str:
    from . import documents as d
    from .registered import CLOCK

    row = lambda no, text, src: f"SELECT repo_id, {no} AS section, '' AS part, 0::BIGINT AS block, {text} AS text FROM {src}"
    header = (
        _n("# Security & Code Review Report\n\n> **Project:** `") + " || repo_id || "
        + _n(f"`\n> **Scan Date:** {CLOCK}\n> **Agent:** scanweave\n> **Total Findings:** ") + " || total || " + _n("\n\n---")
    )
    summary = (
        _n("\n## Executive Summary\n\n| Severity | Count |\n|----------|-------|\n| 🔴 CRITICAL | ") + " || critical || "
        + _n(" |\n| 🟠 HIGH | ") + " || high || " + _n(" |\n| 🟡 MEDIUM | ") + " || medium || " + _n(" |\n| 🔵 LOW | ") + " || low || "
        + _n(" |\n| **Total** | **") + " || total || " + _n("** |\n\n**Overall Risk Level: ") + f" || {_RISK} || '**' || "
        + "CASE WHEN critical > 0 THEN " + _n("\n\n> ⚠️ **") + " || critical || ' CRITICAL issue(s) require immediate attention before any deployment.**' ELSE '' END"
    )
    ticked = lambda c, empty: f"coalesce(nullif(array_to_string(list_transform({c}, lambda x: '`' || x || '`'), ', '), ''), '{empty}')"
    fields = {
        "Project Name": "repo_id", "Total Files Scanned": "total_files", "Primary Language": "'`' || primary_language || '`'",
        "Languages": "langs", "Frameworks": ticked("frameworks[1:8]", "None detected"), "Architecture Types": ticked("arch_types", ""),
        "Active Scan Domains": ticked("security_domains", "None"), "Skipped Domains": ticked("skipped_domains", "None"),
        "Config": "coalesce(config_path, 'Default config')", "Fail Threshold": "'`' || coalesce(fail_threshold, 'CRITICAL') || '`'",
    }
    overview = _n("\n## Project Overview\n\n| Property | Value |\n|----------|-------|") + " || " + " || ".join(
        _n(f"\n| **{k}** | ") + f" || {v} || ' |'" for k, v in fields.items()
    )
    source = """(SELECT d.*, c.config_path, c.fail_threshold, coalesce(l.primary_language, 'Unknown') AS primary_language, coalesce(l.langs, '') AS langs
      FROM domains d LEFT JOIN configs c USING (repo_id) LEFT JOIN (
        SELECT repo_id, max(lang) FILTER (pos = 1) AS primary_language,
          array_to_string(list('`' || lang || '` (' || n || ' files)' ORDER BY pos) FILTER (pos <= 6), ', ') AS langs
        FROM languages GROUP BY repo_id) l USING (repo_id))"""
    nl = "chr(10)"
    matrix = (
        _n("\n## Findings by Category\n\n| Category | Critical | High | Medium | Low | Total |\n|----------|----------|------|--------|-----|-------|\n")
        + f" || string_agg('| ' || category || ' | ' || critical || ' | ' || high || ' | ' || medium || ' | ' || low || ' | **' || total || '** |', {nl} ORDER BY category)"
    )
    owasp = (
        _n("\n## OWASP Top 10 (2021) Coverage\n\n| # | Category | Findings | Status |\n|---|----------|----------|--------|\n")
        + f" || string_agg('| ' || owasp || ' | ' || name || ' | ' || findings || ' | ' || status || ' |', {nl} ORDER BY owasp)"
    )
    place = "'- **[' || id || ']** `' || file || ':' || line || '` — ' || name"
    advice = (
        _n("\n## Recommendations\n") + " || coalesce(" + _n("\n### Immediate Actions (Before Next Deploy)\n\n") + " || now, '') || coalesce("
        + _n("\n\n### Short-term Actions (This Sprint)\n\n") + " || soon, '') || " + _n("\n" + d.PRACTICES)
    )
    advised = f"""(SELECT repo_id, now, soon FROM domains LEFT JOIN (SELECT repo_id,
        string_agg({place} || ': ' || substring(fix, 1, 100) || '...', {nl} ORDER BY ordinal) FILTER (severity = 'CRITICAL' AND ordinal <= 10) AS now,
        string_agg({place}, {nl} ORDER BY ordinal) FILTER (severity = 'HIGH' AND ordinal <= 10) AS soon
      FROM queue GROUP BY repo_id) USING (repo_id))"""
    footer = _n(f"\n---\n\n## About This Report\n\nGenerated by **scanweave** on {CLOCK}.\n\n{d.NOTICE}")
    return " UNION ALL ".join([
        row(1, header, "counts"), row(2, summary, "counts"), row(3, overview, source), row(4, matrix, "matrix GROUP BY repo_id"),
        row(10, owasp, "owasp GROUP BY repo_id"), row(11, advice, advised), row(12, footer, "domains"),
    ])


_RISK = "CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 3 THEN 'HIGH' WHEN high > 0 OR medium > 5 THEN 'MEDIUM' ELSE 'LOW' END"


def _summary_sql() -> str:
    names = lambda c: f"coalesce(nullif(array_to_string({c}, ', '), ''), 'none')"
    counts = " || ".join(_n(f"\n| {s} | ") + f" || {s.lower()} || ' |'" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))
    return f"""SELECT repo_id, {_n("## scanweave" + chr(10) * 2 + "Total findings: **")} || total || {_n("**" + chr(10) + "Active domains: `")} || {names('security_domains')}
        || {_n("`" + chr(10) + "Skipped domains: `")} || {names('skipped_domains')} || {_n("`" + chr(10) * 2 + "| Severity | Count |" + chr(10) + "|---|---:|")} || {counts}
        || coalesce({_n(chr(10) * 2 + "### Top Findings" + chr(10) * 2 + "| Severity | Finding | Location |" + chr(10) + "|---|---|---|" + chr(10))} || top, '') || chr(10) AS text
      FROM domains JOIN counts USING (repo_id) LEFT JOIN (
        SELECT repo_id, string_agg('| ' || severity || ' | ' || name || ' | `' || file || ':' || line || '` |', chr(10) ORDER BY position) AS top
        FROM queue WHERE position <= 20 GROUP BY repo_id) USING (repo_id)"""


def _listing_sql() -> str:
    head = _n("\n\n| Severity | ID | Name | File | Line |\n|----------|-----|------|------|------|")
    return f"""
      SELECT DISTINCT repo_id, '' AS part, 0::BIGINT AS block, {_n(chr(10) + "## All Findings by Category" + chr(10))} AS text FROM queue
      UNION ALL SELECT repo_id, category, 0, CASE WHEN category = min(category) OVER (PARTITION BY repo_id) THEN '' ELSE chr(10) END
        || '### ' || category || {head} FROM (SELECT DISTINCT repo_id, category FROM queue)
      UNION ALL SELECT repo_id, category, position, '| ' || {_MARK} || ' ' || severity || ' | `' || id || '` | ' || name || ' | `' || file || '` | ' || line || ' |' FROM queue
      UNION ALL SELECT DISTINCT repo_id, chr(1114111), 0, '' FROM queue"""


def _json_sql() -> str:
    info = """struct_pack(name := d.repo_id, languages := coalesce(l.languages, MAP {}), primary_language := coalesce(l.first, 'Unknown'),
        frameworks := frameworks, arch_types := arch_types, security_domains := security_domains, skipped_domains := skipped_domains,
        total_files := total_files, security_config := cfg)"""
    cfg = """struct_pack(config_path := config_path, fail_threshold := fail_threshold, include_domains := include_domains,
        exclude_domains := exclude_domains, baseline_file := baseline_file,
        dependency_audit := struct_pack(enabled := audit_enabled, tools := audit_tools))"""
    fields = ["id", "category", "name", "severity", "description", "fix", "file", "line", "code", "context", "owasp", "cwe"]
    finding = "struct_pack(" + ", ".join(f"{f} := {f}" for f in fields) + ")"
    severities = "struct_pack(" + ", ".join(f'"{s}" := {s.lower()}' for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")) + ")"
    return f"""
      SELECT d.repo_id, 1 AS section, 0::BIGINT AS block, '{{"project_info":' || CAST(to_json({info}) AS VARCHAR) || ',"config":'
        || CASE WHEN cfg IS NULL THEN '{{}}' ELSE CAST(to_json(cfg) AS VARCHAR) END || ',"findings":[' AS text
      FROM domains d LEFT JOIN (SELECT repo_id, {cfg} AS cfg FROM configs) c USING (repo_id) LEFT JOIN (
        SELECT repo_id, map_from_entries(list((lang, n) ORDER BY pos)) AS languages, max(lang) FILTER (pos = 1) AS first
        FROM languages GROUP BY repo_id) l USING (repo_id)
      UNION ALL SELECT repo_id, 2, seq, CASE WHEN seq = 1 THEN '' ELSE ',' END || CAST(to_json({finding}) AS VARCHAR) FROM queue
      UNION ALL SELECT repo_id, 3, 0, '],"total":' || total || ',"by_severity":' || CAST(to_json({severities}) AS VARCHAR) || '}}' FROM counts"""


def oracle() -> dict[str, str]:
    listed = lambda ids: among(list(ids))
    secrets = [r.rule_id for r in _R if r.domain == "secrets" and not r.file_check]
    own_rule = r"(^|\s)(the|les|und)\s+[a-z]+[.,]"
    hit = "SELECT h.repo_id, h.path, r.id, h.line{0} FROM hits h JOIN rules r USING (rule_no) WHERE {1}"
    applies = " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, count(*) FILTER ({_applies(r)}) AS n_files FROM scanned" for r in _R)
    return {
        "severity_counts": sql("SELECT * FROM counts", "counts"),
        "risk_level": sql(f"SELECT repo_id, critical, high, medium, low, total, {_RISK} AS risk_level FROM counts", "counts"),
        "category_matrix": sql("SELECT * FROM matrix", "matrix"),
        "owasp_coverage": sql("SELECT * FROM owasp", "owasp"),
        "fail_gate": sql(_GATE.format("SELECT c.*, coalesce(f.fail_threshold, 'CRITICAL') AS fail_threshold FROM counts c LEFT JOIN configs f USING (repo_id)"), "counts", "configs"),
        "project_files": sql("SELECT repo_id, path, size FROM kept", "kept"),
        "scannable_files": sql("SELECT repo_id, path FROM scanned", "scanned"),
        "text_lines": sql("SELECT repo_id, path, name, ext, len(lines) AS n_lines, CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS BIGINT) AS n_chars FROM scanned", "scanned"),
        "rule_applicability": sql(f"SELECT * FROM ({applies}) WHERE n_files > 0", "scanned"),
        "configs": sql(f"SELECT repo_id, config_path, fail_threshold, {_joined('include_domains', 'exclude_domains', 'ignore_patterns')}, baseline_file, audit_enabled, {_joined('audit_tools')} FROM configs", "configs"),
        "ignore_globs": sql("SELECT * FROM ignores", "ignores"),
        "baseline_keys": sql("SELECT * FROM baseline", "baseline"),
        "ignored_files": sql("SELECT * FROM ignored", "ignored"),
        "language_counts": sql("SELECT * FROM language_counts", "language_counts"),
        "top_languages": sql("SELECT repo_id, pos, lang, n FROM languages", "languages"),
        "primary_language": sql("SELECT repo_id, coalesce(lang, 'Unknown') AS primary_language, total_files FROM flags LEFT JOIN (SELECT * FROM languages WHERE pos = 1) USING (repo_id)", "flags", "languages"),
        "frameworks": sql(f"SELECT repo_id, array_to_string(coalesce(frameworks, []), ', ') AS frameworks FROM flags LEFT JOIN frameworks USING (repo_id)", "flags", "frameworks"),
        "arch_types": sql("SELECT repo_id, array_to_string(coalesce(arch_types, ['cli']), ', ') AS arch_types FROM flags LEFT JOIN architectures USING (repo_id)", "flags", "architectures"),
        "manifest_packages": sql("SELECT * FROM packages", "packages"),
        "domains": sql(f"SELECT repo_id, {_joined('security_domains', 'skipped_domains')} FROM domains", "domains"),
        "test_presence": sql("SELECT repo_id, has_tests FROM flags", "flags"),
        "multiline_hits": sql(f"""SELECT repo_id, path, id, CAST(n AS INT) AS line,
            substring(regexp_replace(regexp_replace(lines[n], '^[{SPACE}]+', ''), '[{SPACE}]+$', ''), 1, 200) AS code,
            array_to_string(list_transform(range(greatest(n - 3, 1), least(n + 3, len(lines)) + 1),
              lambda i: printf('%s %4d: ', CASE WHEN i = n THEN '>>>' ELSE '   ' END, i) || lines[i]), chr(10)) AS context
          FROM ({_spanning_hits_sql()})""", "ml_scanned"),
        "tree_files": sql("SELECT repo_id, path, size, sha256(content) AS content_sha256 FROM kept", "kept"),
        "line_hits": sql(hit.format("", "h.line > 0"), "hits", "rules"),
        "distinct_content_hits": sql(hit.format("", "h.line > 0"), "hits", "rules"),
        "negative_context": sql("SELECT id, count(*) AS matched, count(*) FILTER (NOT cancelled) AS kept FROM raw_hits JOIN rules USING (rule_no) WHERE has_negative GROUP BY id", "raw_hits", "rules"),
        "lookaround_rules": sql(hit.format("", f"r.id IN {listed(_LOOK)}"), "hits", "rules"),
        "file_name_rules": sql(hit.format(", h.code, h.context", "r.id = 'SEC-010'"), "hits", "rules"),
        "page_hits": sql("SELECT repo_id, id, count(*) AS n FROM hits JOIN rules USING (rule_no) WHERE starts_with(path, 'site/') GROUP BY 1, 2", "hits", "rules"),
        "secrets_hits": sql(hit.format(", h.code", f"r.id IN {listed(secrets)}"), "hits", "rules"),
        "context_snippets": sql(hit.format(", h.code, h.context", "true"), "hits", "rules"),
        "config_problems": sql(f"""SELECT repo_id, path, 'not valid JSON, or a value of another type' AS reason FROM files
          WHERE path = '.security-agent.json' AND NOT json_valid(content)""", "files"),
        "unscanned_parts": sql("""
          SELECT repo_id, path, 'file size' AS reason, CAST(NULL AS BIGINT) AS lines, CAST(size AS BIGINT) AS bytes FROM scanned WHERE size > 500000
          UNION ALL SELECT repo_id, path, 'line length', CAST(len(long) AS BIGINT), CAST(list_sum(list_transform(long, lambda x: strlen(x))) AS BIGINT) FROM (
            SELECT repo_id, path, list_filter(lines, lambda x: length(x) > 2000) AS long FROM scanned WHERE size <= 500000) WHERE len(long) > 0""", "scanned"),
        "rejected_rules": sql("""SELECT t.rule_id, t.reason, (SELECT nullif(count(*), 0) FROM scanned s WHERE list_contains(t.langs, s.ext)) AS n_files
          FROM (VALUES ('X-002', 'bad pattern: missing ), unterminated subpattern at position 0', ['.py', '.go']),
            ('A01-001', 'id already in use', []), ('X-003', 'unknown domain nowhere', []),
            ('X-005', 'langs is not a list of suffixes and file names', []), ('X-006', 'unknown severity GRAVE', []),
            ('X-007', 'slow pattern: exponential time: a text leads round a loop in two ways', ['.js']),
            ('X-008', 'slow pattern: time grows with power 5 of a line''s length', ['.java', '.py'])) AS t(rule_id, reason, langs)""", "scanned"),
        "user_rules": sql(f"""SELECT id, count(*) AS n FROM hits JOIN rules USING (rule_no) GROUP BY id
          UNION ALL SELECT 'X-001', sum(len(list_filter(lines, lambda x: {matches('x', own_rule)})))::BIGINT FROM scanned WHERE ext IN ('.py', '.js', '.java')""", "hits", "rules", "scanned"),
        "findings": sql("SELECT repo_id, id, category, name, severity, description, fix, file, line, code, context, owasp, cwe FROM static_findings", "static_findings"),
        "findings_dedup": sql("SELECT repo_id, id, count(*) AS n FROM static_findings GROUP BY 1, 2", "static_findings"),
        "missing_tests": sql("SELECT repo_id, id, file, line FROM active WHERE id = 'CQ-050'", "active"),
        "baseline_antijoin": sql("SELECT repo_id, id, file, line FROM findings", "findings"),
        "suppressed_counts": sql("SELECT s.repo_id, count(*) AS suppressed FROM static_findings s JOIN baseline b ON s.repo_id = b.repo_id AND s.finding_key = b.finding_key GROUP BY 1", "static_findings", "baseline"),
        "min_severity": sql("SELECT repo_id, severity, count(*) AS n FROM findings WHERE rank <= 1 GROUP BY 1, 2", "findings"),
        "category_listing": sql("SELECT repo_id, category, position, severity, id, name, file, line FROM queue", "queue"),
        "review_queue": sql("SELECT repo_id, position, total, ordinal, severity, id, file, line FROM queue", "queue"),
        "top_critical": sql("SELECT repo_id, ordinal AS n, id, file, line, name, substring(fix, 1, 100) AS fix FROM queue WHERE severity = 'CRITICAL' AND ordinal <= 10", "queue"),
        "top_high": sql("SELECT repo_id, ordinal AS n, id, file, line, name FROM queue WHERE severity = 'HIGH' AND ordinal <= 10", "queue"),
        "top20": sql("SELECT repo_id, position AS n, severity, name, file, line FROM queue WHERE position <= 20", "queue"),
        "finding_cards": sql(f"SELECT repo_id, severity, ordinal, {_CARD} AS text FROM queue", "queue"),
        "report_text": sql(_report_sql(), "counts", "domains", "configs", "languages", "matrix", "owasp", "queue"),
        "report_listing": sql(_listing_sql(), "queue"),
        "job_summary": sql(_summary_sql(), "domains", "counts", "queue"),
        "findings_json": sql(_json_sql(), "domains", "configs", "languages", "queue", "counts"),
        "report_files": sql(f"""SELECT repo_id, volume, strlen(string_agg(text, '' ORDER BY section, block)) AS n_bytes,
            sha256(string_agg(text, '' ORDER BY section, block)) AS sha256
          FROM (SELECT *, (row_number() OVER (PARTITION BY repo_id ORDER BY section, block) - 1) // 100 + 1 AS volume FROM ({_json_sql()}))
          GROUP BY repo_id, volume""", "domains", "configs", "languages", "queue", "counts"),
        "pip_audit": sql(f"SELECT {_DEP} FROM pip", "pip"),
        "npm_audit": sql(f"SELECT {_DEP} FROM npm", "npm"),
        "osv_audit": sql(f"SELECT {_DEP} FROM osv", "osv"),
        "audit_problems": sql(f"SELECT {_DEP} FROM problems", "problems"),
        "audit_selection": sql(f"SELECT s.repo_id, s.tool, count(*) AS n FROM (SELECT {_REPO} AS repo_id, tool FROM audit_rows) a JOIN selected s ON a.repo_id = s.repo_id AND a.tool = s.tool GROUP BY 1, 2", "audit_rows", "selected"),
        "dependency_union": sql(f"""
          SELECT repo_id, category, severity, count(*) AS n FROM (
            SELECT repo_id, category, severity FROM active
            UNION ALL SELECT s.repo_id, category, severity FROM (
              SELECT {_REPO} AS repo_id, 'pip-audit' AS tool, category, severity, id, file FROM pip
              UNION ALL SELECT {_REPO}, 'npm-audit', category, severity, id, file FROM npm
              UNION ALL SELECT {_REPO}, 'osv-scanner', category, severity, id, file FROM osv
              UNION ALL SELECT {_REPO}, tool, category, severity, id, file FROM problems) a
            JOIN selected s ON a.repo_id = s.repo_id AND a.tool = s.tool
            WHERE NOT (a.id = 'DEP-OSV-SCANNER' AND a.file = 'sub/pom.xml')
          ) GROUP BY 1, 2, 3""", "active", "pip", "npm", "osv", "problems", "selected"),
        "stream_scan": sql("SELECT repo_id, id, file, line, severity FROM stream_hits", "stream_hits"),
        "stream_dedup": sql("SELECT repo_id, id, count(*) AS n FROM stream_hits GROUP BY 1, 2", "stream_hits"),
        "stream_hourly": sql("""SELECT date_trunc('hour', TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d AS BIGINT))) AS window_start, severity, count(*) AS n
          FROM stream_hits GROUP BY 1, 2""", "stream_hits"),
        "stream_sliding": sql("""SELECT window_start, severity, count(*) AS n FROM (
            SELECT severity, unnest([w, w - INTERVAL 2 HOURS, w - INTERVAL 4 HOURS]) AS window_start FROM (
              SELECT severity, time_bucket(INTERVAL 2 HOURS, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d AS BIGINT)), TIMESTAMP '2024-01-01 00:00:00') AS w FROM stream_hits)
          ) GROUP BY 1, 2""", "stream_hits"),
        "severity_heads": sql(f"""SELECT DISTINCT repo_id, CAST(5 + rank AS INT) AS section,
            chr(10) || '## ' || {_MARK} || ' ' || severity || ' Severity Findings' || chr(10) AS text FROM queue WHERE rank < 4""", "queue"),
        "stream_gate": sql(_GATE.format("SELECT c.*, coalesce(f.fail_threshold, 'CRITICAL') AS fail_threshold FROM counts c LEFT JOIN configs f USING (repo_id)"), "counts", "configs"),
        "stream_categories": sql("SELECT * FROM matrix", "matrix"),
        "stream_owasp": sql("SELECT * FROM owasp", "owasp"),
        "stream_current": sql("SELECT repo_id, file, id, line, severity FROM findings", "findings"),
    }
