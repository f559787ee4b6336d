"""Benchmark decontamination: random-walk embeddings, bit-sampling keys, exact edit distance.

Items and texts become sequences of words, folded to lower case and without punctuation.
An item is found where a stretch of a text is within ``RATE`` edits per word of it (words
inserted, deleted or replaced).  Items are indexed by keys sampled from the steps of walks
that start at places along their whole length; texts are walked from every fourth word and
only stretches that share a key are compared.  Exact copies always share all keys; of
synthetic copies with 20 % of their words edited, spread or in one stretch at the beginning,
middle or end, 0.9 or more are found.

Items are taken in blocks of ``BLOCK_ITEMS``, and these in parts of ``PART_WORDS`` words; a
part's index is bounded and goes to the tasks, each of which reads whole texts.  More items
mean more passes, not a larger index.

Items with fewer than 8 words are too short to walk.  They are cut into one piece more than
edits are allowed (below 5 words none is), whole pieces are looked up at every word of the
texts, and all copies are found: an item of one common word is found in every text with it.

Defined cases: null texts and items are empty and match nothing; an item that occurs again in a text is
reported once, at its best place; equal items are all reported; a repeated row gives its
result again; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import walks
from .common import map_batches, numbered, ship, store, text_hash, text_of, without

RATE = 0.2
BLOCK_ITEMS = 5000
PART_WORDS = 1 << 18

ship(walks)


def _search(index: walks.Index, rate: float):
    names = ["item_id", "item_words", "distance", "position"]

    def run(batches):
        for batch in batches:
            found = walks.batch_matches(index, batch.column(2).to_pylist(), rate)
            row = pa.array([m[0] for m in found], type=pa.int64())
            values = [pa.array([m[i] for m in found], type=pa.int64()) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *values], names=["id", "hash", *names])

    return run


def _parts(items: list[tuple[int, str]], most: int):
    """The items in lists of about ``most`` words; a longer item is in a list of its own."""
    part, size = [], 0
    for item in items:
        count = len(walks.symbols(item[1]))
        if part and size + count > most:
            yield part
            part, size = [], 0
        part.append(item)
        size += count
    if part:
        yield part


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", rate: float = RATE, block: int = BLOCK_ITEMS,
) -> DataFrame:
    """``(id, hash of the text, item_id, item_words, distance, position)``, a row per text and item found."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text_of(item_text_col).alias("words"))
    items = numbered(items, [F.col("item").asc_nulls_first(), F.col("words")], "_no").withColumn("_block", F.floor(F.col("_no") / block))
    items = store(items)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("hash"), text_of(text_col).alias("text"))
    blocks = items.agg(F.max("_block")).first()[0]
    found = None
    for no in range((-1 if blocks is None else blocks) + 1):
        # At most ``block`` items.
        own = items.where(F.col("_block") == no).select("item", "words").collect()
        for items_of_part in _parts([(r.item, r.words) for r in own], PART_WORDS):
            index = walks.Index(items_of_part, rate)
            if not len(index.keys):
                continue
            schema = "id long, hash long, item_id long, item_words long, distance long, position long"
            part = map_batches(texts, _search(index, rate), schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        nothing = F.lit(None).cast("long")
        names = ("item_id", "item_words", "distance", "position")
        return texts.where("false").select("id", "hash", *[nothing.alias(n) for n in names])
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all others stay as they are."""
    found = contaminated(docs, benchmark, id_col, text_col)
    return without(docs, store(found.select("id", "hash").distinct()), id_col, text_col)
