"""Runs of words that repeat with a period: found, listed and collapsed.

A text is worked on in its row, together with others of its batch.  A suffix array over the
words is made by doubling; neighbours' common prefixes cut it into intervals.  Two suffixes of
an interval of depth d that start d words apart are a square that the next word does not
continue: for every interval the suffixes of its smaller children look up, in the inverse
array, whether the suffix d words on, or back, lies in the interval's other part.  Squares are
rotated to the left and merged into runs.  That is n log n steps in a text of n words, all of
them on arrays; nothing is shuffled.

A run is a stretch with smallest period q that no neighbouring word continues, of six words
and four periods at least.

Defined cases: a null text counts as empty and has no runs; a text of one word repeated is one
run; repeated rows and null ids give their row again; an empty table gives an empty result;
other columns are ignored by :func:`find_runs` and pass in :func:`collapse_runs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tandem
from .common import map_batches, packed, ship, text_of

ship(tandem)

_RUNS = "starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the runs as three lists by start, then period, and ``collapsed``: the words that no
    run repeats after its first period, joined by blanks."""
    return map_batches(_texts(docs, id_col, text_col), tandem.run_batches(False), f"id long, {_RUNS}")


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every run cut down to its first period; texts without runs stay as they are."""
    rows = packed(docs, text=text_of(text_col))
    kind = rows.schema["_row"].dataType.simpleString()
    found = map_batches(rows, tandem.run_batches(False), f"id {kind}, {_RUNS}")
    text = F.when(F.size("starts") > 0, F.col("collapsed")).otherwise(F.col("id")[text_col])
    return found.select(*[text.alias(c) if c == text_col else F.col("id")[c].alias(c) for c in docs.columns])


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant_tails: bool = False) -> DataFrame:
    """``id, n_runs``, the longest run and digests of all runs and of the collapsed text.

    With ``plant_tails`` a tenth of the texts, chosen by their id, are read with a tail that
    repeats, which makes runs of known place in any table.
    """
    numbers = "id long, n_runs long, start long, length long, period long, exponent_milli long"
    made = f"{numbers}, runs_sha256 string, collapsed_sha256 string"
    return map_batches(_texts(docs, id_col, text_col), tandem.digest_batches(plant_tails), made)
