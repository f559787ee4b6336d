"""Secret scan: three patterns, and sliding-window entropy over candidate strings.

Candidates are runs of at least 20 token characters.  A candidate's characters put it in a
class with an alphabet and an entropy bound; digits or letters of one case, with other
token characters or without, are in none.  Hexadecimal pieces of a candidate with other
characters are classed by themselves too.  A window of 20 characters slides over it: counts
per symbol and the sum of c * log2(c) are updated for the character that enters and the one
that leaves, so a step costs the same wherever it is.  Windows at or above the bound merge
into spans, unless they overlap something allow-listed (identifiers, checksums,
placeholders, alphabets in order).

Spans count code points, end exclusive.  Texts never leave their row: no shuffle, no Python.

Defined cases: a null or empty text has no spans; a repeated row gives its result again;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE, MIN_ACCESS = 6, 20

TOKEN = "A-Za-z0-9+/_=-"
WINDOW = 20
CANDIDATE = rf"(?<![{TOKEN}])[{TOKEN}]{{{WINDOW},}}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Kind, pattern of the whole candidate, symbols, least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdefABCDEF", 3.0),
    ("entropy_alnum", r"^(?=.*[0-9])(?=.*[a-zA-Z])([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER + _UPPER, 3.6),
    ("entropy_mixed", r"^(?=.*[A-Z])(?=.*[a-z]).*$", _UPPER + _LOWER + _DIGITS + "+/_=-", 3.9),
    (
        "entropy_symbols", r"^(?=.*[0-9])(?=.*[a-zA-Z])(?=.*[+/_=-])([0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$",
        _DIGITS + _LOWER + _UPPER + "+/_=-", 3.6,
    ),
)
# Between other characters of a candidate.
PIECE = rf"(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])([0-9a-f]{{{WINDOW},}}|[0-9A-F]{{{WINDOW},}})(?![A-Za-z0-9])"
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i)(example|placeholder|changeme|dummy|sample|xxxxxx)",
    # With its digest, hexadecimal or base64.
    r"(?i)^(md5[-_=]([0-9a-f]{32}|[a-z0-9+/]{22}|[a-z0-9+/]*)|sha1[-_=]([0-9a-f]{40}|[a-z0-9+/]{27}|[a-z0-9+/]*)"
    r"|sha256[-_=]([0-9a-f]{64}|[a-z0-9+/]{43}|[a-z0-9+/]*)|sha384[-_=]([0-9a-f]{96}|[a-z0-9+/]{64}|[a-z0-9+/]*)"
    r"|sha512[-_=]([0-9a-f]{128}|[a-z0-9+/]{86}|[a-z0-9+/]*))={0,2}",
    r"(?i)(abcdefghijklmnop|0123456789abcdef)",
)
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))

_SPAN = "ARRAY<STRUCT<start: INT, ord: INT, stop: INT>>"
_SPAN_TEXT = "ARRAY<STRUCT<start: INT, ord: INT, stop: INT, m: STRING>>"
# Matches of a text are numbered in blocks of so many.
BLOCK = 64


def _literal(text: str) -> str:
    """A string literal that reads back as ``text``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, ord_: int, keep: str = "true", extra: str = "''", text: str = "text", with_text: bool = False) -> str:
    """Spans of the pattern in ``text``: the gaps between matches tell where they are.

    ``keep`` tests a match, ``i.`0` ``, and what ``extra`` has beside it, ``i.`2` ``; ``with_text``
    adds the match as ``m``.  Matches are taken in blocks: the widths of the blocks say where
    each begins, and an array that grows by one match at a time never gets longer than a block.
    """
    p, kind = _literal(pattern), _SPAN_TEXT if with_text else _SPAN
    found = f"arrays_zip(regexp_extract_all({text}, {p}, 0), transform(split({text}, {p}, -1), g -> char_length(g)), {extra})"
    blocks = f"transform(sequence(0, (size(f) - 1) div {BLOCK}), k -> slice(f, k * {BLOCK} + 1, {BLOCK}))"
    width = "aggregate(b, 0, (u, i) -> u + i.`1` + coalesce(char_length(i.`0`), 0))"
    begins = f"aggregate(blocks, array(0), (t, b) -> concat(t, array(element_at(t, -1) + {width})))"
    held = ", 'm', i.`0`" if with_text else ""
    after = "s.at + i.`1` + char_length(i.`0`)"
    span = f"named_struct('start', s.at + i.`1`, 'ord', {ord_}, 'stop', {after}{held})"
    step = (
        "CASE WHEN i.`0` IS NULL THEN s ELSE named_struct("
        f"'at', {after}, 'spans', IF({keep}, concat(s.spans, array({span})), s.spans)) END"
    )
    spans = f"aggregate(b, named_struct('at', get(begins, k), 'spans', CAST(array() AS {kind})), (s, i) -> {step}, s -> s.spans)"
    # Wrapped in arrays of one, so that each is computed once.
    spans = f"transform(array({begins}), begins -> flatten(transform(blocks, (b, k) -> {spans})))[0]"
    spans = f"transform(array({found}), f -> transform(array({blocks}), blocks -> {spans})[0])[0]"
    return f"CASE WHEN {text} RLIKE {p} THEN {spans} ELSE CAST(array() AS {kind}) END"


def _windows(symbols: str, bound: float, at: str = "0") -> str:
    """``array<struct<a, b>>``: merged windows of ``chars`` with at least ``bound`` bits.

    ``chars`` begins at ``at`` of the candidate; windows that overlap a span of ``v.allowed`` are left out.
    """
    w, n = WINDOW, len(symbols)
    total = lambda c: f"IF({c} > 1, {c} * log2({c}), 0D)"
    # enter and leave are symbol numbers; leave is -1 while the window fills.
    enter = f"instr({_literal(symbols)}, get(chars, i)) - 1"
    leave = f"IF(i >= {w}, instr({_literal(symbols)}, get(chars, i - {w})) - 1, -1)"
    one = "named_struct('a', s.a, 'b', s.b)"
    counts = "transform(s.counts, (c, k) -> c + IF(k = t.enter, 1, 0) - IF(k = t.leave, 1, 0))"
    more, less = "get(s.counts, t.enter)", "get(s.counts, t.leave)"
    moved = (
        f"IF(t.enter = t.leave, s.total, s.total + {total(f'({more} + 1)')} - {total(more)} "
        f"+ IF(t.leave < 0, 0D, {total(f'({less} - 1)')} - {total(less)}))"
    )
    high = f"i >= {w - 1} AND log2({w}) - u.total / {w} >= {bound} - 1e-9 AND NOT exists(v.allowed, z -> z.start <= i + {at} AND z.stop > i + {at} - {w - 1})"
    closes = f"{high} AND s.b >= 0 AND s.b < i - {w - 1}"
    step = (
        f"transform(array(named_struct('enter', {enter}, 'leave', {leave})), t -> "
        f"transform(array(named_struct('counts', {counts}, 'total', CAST({moved} AS DOUBLE))), u -> named_struct("
        f"'counts', u.counts, 'total', u.total, "
        f"'a', IF({high}, IF(s.b >= i - {w - 1}, s.a, i - {w - 1}), s.a), 'b', IF({high}, i + 1, s.b), "
        f"'done', IF({closes}, concat(s.done, array({one})), s.done)))[0])[0]"
    )
    start = (
        f"named_struct('counts', array_repeat(0, {n}), 'total', 0D, 'a', -1, 'b', -1, "
        "'done', CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>))"
    )
    return (
        f"aggregate(sequence(0, size(chars) - 1), {start}, (s, i) -> {step}, "
        f"s -> IF(s.b >= 0, concat(s.done, array({one})), s.done))"
    )


def _entropy_spans() -> str:
    """Spans of high entropy in ``text``, of all classes."""
    empty = "CAST(array() AS ARRAY<STRING>)"
    allowed = f"concat({', '.join(_matches(a, 0, 'true', empty, 'm') for a in ALLOWED)})"
    none = "CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>)"
    spans = []
    for no, (_, shape, symbols, bound) in enumerate(CLASSES):
        earlier = "".join(f" AND NOT v.m RLIKE {_literal(c[1])}" for c in CLASSES[:no])
        in_class = f"v.m RLIKE {_literal(shape)}{earlier}"
        # The characters are split once, by wrapping them in an array of one.
        windows = f"transform(array(split(v.m, '')), chars -> {_windows(symbols, bound)})[0]"
        here = f"IF({in_class}, {windows}, {none})"
        spans.append(f"transform({here}, z -> named_struct('start', c.start + z.a, 'ord', {3 + no}, 'stop', c.start + z.b))")
    _, shape, symbols, bound = CLASSES[0]
    windows = f"transform(array(split(p.m, '')), chars -> {_windows(symbols, bound, 'p.start')})[0]"
    moved = "named_struct('start', c.start + p.start + z.a, 'ord', 3, 'stop', c.start + p.start + z.b)"
    pieces = f"flatten(transform({_matches(PIECE, 0, 'true', empty, 'v.m', True)}, p -> transform({windows}, z -> {moved})))"
    spans.append(f"IF(v.m RLIKE {_literal(shape)}, CAST(array() AS {_SPAN}), {pieces})")
    of_candidate = (
        f"transform(transform(array(c.m), m -> named_struct('m', m, 'allowed', {allowed})), "
        f"v -> concat({', '.join(spans)}))[0]"
    )
    return f"flatten(transform(candidates, c -> {of_candidate}))"


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (by default ``doc_id``) and ``spans(start, ord, stop)`` of each row.

    ``ord`` is the place of the span's kind in ``KINDS``; spans are sorted by start, then kind.
    """
    keep = keep or ["doc_id"]
    values = f"regexp_extract_all(text, {_literal(ASSIGN)}, 2)"
    base = [
        _matches(ASSIGN, 0, f"char_length(i.`2`) >= {MIN_VALUE}", values),
        _matches(ACCESS, 1, f"char_length(i.`0`) >= {MIN_ACCESS}", "CAST(array() AS ARRAY<STRING>)"),
        _matches(HEX, 2, "true", "CAST(array() AS ARRAY<STRING>)"),
    ]
    rows = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], text_of(text_col).alias("text"))
    rows = rows.withColumn("candidates", F.expr(_matches(CANDIDATE, 0, "true", "CAST(array() AS ARRAY<STRING>)", with_text=True)))
    spans = F.concat(*map(F.expr, base), F.expr(_entropy_spans()))
    return rows.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], F.array_sort(spans).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["ord"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
