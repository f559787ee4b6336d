"""The small YAML subset of a settings file, turned into JSON text.

Two levels are enough: ``key: value``, ``key:`` followed by ``- item`` lines, and
``key:`` followed by indented ``child: value`` lines.  A settings file is a few
lines long, so the work stays inside its row, in string and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, strip


def _quoted(text: Column) -> Column:
    """A JSON string, with all that JSON wants escaped."""
    return F.regexp_replace(F.to_json(F.array(text)), r"\A\[|\]\z", "")


def _scalar(text: Column) -> Column:
    """JSON text of one plain value."""
    text = strip(text)
    low = F.lower(text)
    plain = F.regexp_replace(text, r"""\A["']+|["']+\z""", "")
    return F.when(low.isin("true", "false"), low).when(low.isin("null", "none"), F.lit("null")).otherwise(_quoted(plain))


def _value(text: Column) -> Column:
    """JSON text of a value, which may be an inline list."""
    text = strip(text)
    inner = strip(F.regexp_replace(text, r"\A\[|\]\z", ""))
    items = F.concat(F.lit("["), F.array_join(F.transform(F.split(inner, ","), _scalar), ","), F.lit("]"))
    listed = F.when(inner == "", F.lit("[]")).otherwise(items)
    return F.when(text.startswith("[") & text.endswith("]"), listed).otherwise(_scalar(text))


def _pair(line: Column) -> tuple[Column, Column]:
    key = strip(F.substring_index(line, ":", 1))
    return key, strip(F.regexp_replace(line, r"(?s)\A[^:]*:", ""))


def _member(key: Column, value: Column) -> Column:
    return F.concat(_quoted(key), F.lit(":"), value)


def yaml_to_json(content: Column) -> Column:
    lines = F.filter(
        F.split(content, LINE_BREAK, -1), lambda x: (strip(x) != "") & ~strip(x).startswith("#")
    )
    # Each block is a top-level line followed by its indented lines, joined again.
    text = F.array_join(lines, "\n")
    blocks = F.filter(F.split(text, r"\n(?=[^ \t])"), lambda b: F.contains(F.substring_index(b, "\n", 1), F.lit(":")))

    def block(b: Column) -> Column:
        key, value = _pair(F.substring_index(b, "\n", 1))
        children = F.transform(F.slice(F.split(b, "\n"), F.lit(2), F.size(F.split(b, "\n"))), strip)
        items = F.filter(children, lambda c: c.startswith("- "))
        pairs = F.filter(children, lambda c: ~c.startswith("- ") & F.contains(c, F.lit(":")))
        as_list = F.concat(F.lit("["), F.array_join(F.transform(items, lambda c: _value(F.substr(c, F.lit(3)))), ","), F.lit("]"))
        as_object = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda c: _member(_pair(c)[0], _value(_pair(c)[1]))), ","), F.lit("}"))
        nested = F.when(F.size(items) > 0, as_list).otherwise(as_object)
        return _member(key, F.when(value != "", _value(value)).otherwise(nested))

    return F.concat(F.lit("{"), F.array_join(F.transform(blocks, block), ","), F.lit("}"))
