"""Texts to token ids and back, by byte-pair merges in rank order.

A text is cut into words as the vocabulary file says; the bytes of a word are a doubly linked
list of symbols, and a queue of merge ranks joins the best neighbours first; entries whose
symbols have changed since are skipped.  So a word of a million letters takes n log n steps.
Ids become text again by concatenating the vocabulary's strings.  A text is worked on in its
row: nothing is shuffled, and a worker remembers a bounded number of words.

Defined cases: a null text counts as empty and has no ids; ids that are null give an empty
text; the string of an added token is that token; repeated rows and null ids give their row
again; an empty table gives an empty result; other columns pass unchanged in :func:`encode`
and :func:`decode`, which refuse a name that is taken, and are left out of :func:`digests`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merges
from .common import map_batches, packed, ship, text_of

ship(merges)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text: a few megabytes, sent to executors with the function."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _beside(rows: DataFrame, function, column, made: str, kind: str) -> DataFrame:
    if made in rows.columns:
        raise ValueError(f"there is a column {made} already")
    kept = packed(rows, _in=column)
    out = map_batches(kept, function, f"_row {kept.schema['_row'].dataType.simpleString()}, {made} {kind}")
    return out.select("_row.*", made)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>``; ``vocabulary`` is the path of the file."""
    return _beside(docs, merges.encode_batches(read_vocabulary(vocabulary)), text_of(text_col), "ids", "array<int>")


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", made: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids in the column ``made``."""
    return _beside(tokens, merges.decode_batches(read_vocabulary(vocabulary), made), F.col(ids_col), made, "string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded, then decoded from the ids."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    made = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(texts, merges.digest_batches(read_vocabulary(vocabulary)), made)
