"""Text expressions: decoding, line splitting, stripping, case folding, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SPACE

# Fixed value: the line boundaries of Python's str.splitlines.
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"
# The boundaries left when line feeds, alone or after a carriage return, are taken away.
_RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

_REPLACEMENT, _KEEP = "\ufffd", "\U0010ffff"


def decode_utf8(content: Column) -> Column:
    """Bytes to text, dropping undecodable bytes but keeping real U+FFFD characters."""
    text = content.cast("string")
    kept = F.replace(text, F.lit(_REPLACEMENT), F.lit(_KEEP))
    cleaned = F.replace(F.make_valid_utf8(kept), F.lit(_REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(cleaned, F.lit(_KEEP), F.lit(_REPLACEMENT)))


def split_lines(text: Column) -> Column:
    """``split`` at every :data:`LINE_BREAK`.

    The regex takes far longer than anything else that reads the whole text, so it is only used
    where there are other breaks than line feeds and carriage returns before them.
    """
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    rare = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(c)) for c in _RARE_BREAKS])
    return F.when(rare, F.split(text, LINE_BREAK, -1)).otherwise(F.split(plain, "\n", -1))


def drop_last_empty(parts: Column) -> Column:
    """A final line break ends the last line; it does not start another one."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Strip every Unicode space from both ends (``trim`` only strips blanks)."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def fold_sql(expr: str) -> str:
    """Lower case in which every character that matches an ASCII letter when case is
    ignored has become that letter (long s, Kelvin sign, dotted and dotless i)."""
    odd = "\u017f\u212a\u0131\u0130"
    found = " OR ".join(f"contains({expr}, '{c}')" for c in odd)
    return f"lower(CASE WHEN {found} THEN translate({expr}, '{odd}', 'skii') ELSE {expr} END)"


def sql_string(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def window_sql(lines: str, n: str, before: int, after: int) -> str:
    """The lines from n-before to n+after that exist, n counted from 1."""
    start = f"greatest({n} - {before}, 1)"
    return f"slice({lines}, {start}, {n} + {after} + 1 - {start})"


def snippet_sql(lines: str, n: str) -> str:
    """Three lines either side, numbered, with the line itself marked."""
    row = (
        f"(t, i) -> format_string('%s %4d: %s', IF(greatest({n} - 3, 1) + i = {n}, '>>>', '   '), "
        f"greatest({n} - 3, 1) + i, t)"
    )
    return f"array_join(transform({window_sql(lines, n, 3, 3)}, {row}), '\\n')"
