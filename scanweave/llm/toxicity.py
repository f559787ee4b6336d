"""Toxicity scores from subword-bag embeddings with a linear softmax.

The model is fitted on a bounded sample of labelled rows, ``MAX_ROWS`` at most and none
longer than ``MAX_BYTES``: the tasks that read the texts reduce them to hashed n-grams, and
the fit itself, in numpy, runs on what is left of them.  Scoring reads every whole text, in
windows; a text's score is that of its worst window, on a curve fitted to a quarter of the
sample that was not trained on.  One number per n-gram bucket, 1 MB, goes to the executors.

Defined cases: a null or empty text has the score of a text without words; labels that are
null or for unknown ids are ignored, a row labelled twice is toxic if either label says so;
without labelled rows of both kinds every score is the share of toxic ones; a repeated row
gives its result again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import subwords
from .common import map_batches, packed, release_memory, ship, text_of

MAX_ROWS = 4096
MAX_BYTES = 1 << 14
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

ship(subwords)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    scale: float
    shift: float


def held_out(id_col: str) -> Column:
    """Whether a row is kept for testing; rows without an id are not."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def _slices(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The byte strings of a column as numbers, in the memory they arrived in."""
    found = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        cuts = np.frombuffer(offsets, dtype=np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        found += [values[a:b].view(kind) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return found


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
) -> Model:
    """Train on rows of ``labels`` that are not held out, chosen by a hash of their id."""
    model = _fit(docs, labels, label_col, id_col, text_col, max_rows, max_bytes)
    release_memory()  # the sample and what the training made of it
    return model


def _fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_rows: int, max_bytes: int) -> Model:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    order = F.xxhash64("_id")
    # At most max_rows rows, so they may be broadcast; the texts stay where they are.
    chosen = known.orderBy(order, "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("text"))
    sample = texts.where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "_id")
    # An id that occurs again stays one row.
    sample = sample.groupBy("_id", "label").agg(F.min("text").alias("text")).select(order.alias("key"), "label", "text")
    table = map_batches(sample, subwords.bag_batches, "key long, label int, bucket binary, count binary").toArrow()
    keys, targets = table.column("key").to_numpy(), table.column("label").to_numpy().astype(np.int64)
    windows = list(zip(_slices(table.column("bucket"), np.int32), _slices(table.column("count"), np.uint8)))
    del table
    # Sorted by key, so that the fit does not depend on the order in which tasks ended.
    order_of = sorted(range(len(windows)), key=lambda i: (int(keys[i]), windows[i][0].tobytes()))
    if len(set(targets.tolist())) < 2:
        share = float(np.clip(targets.mean(), 1e-3, 1 - 1e-3)) if len(targets) else 0.5
        return Model(np.zeros(subwords.BUCKETS, dtype=np.float32), float(np.log(share / (1 - share))), 1.0, 0.0)
    trained = [i for i in order_of if keys[i] % 4 != 0]
    weights, bias = subwords.train([windows[i] for i in trained], targets[trained])
    return Model(weights, bias, *_curve(windows, keys, targets, order_of, weights, bias))


def _curve(windows, keys, targets, order_of, weights, bias) -> tuple[float, float]:
    top: dict[int, tuple[float, int]] = {}
    for i in order_of:
        if keys[i] % 4 == 0:
            bucket, count = windows[i]
            logit = bias + float((weights[bucket] * count).sum() / (int(count.sum()) + subwords.PRIOR))
            key = int(keys[i])
            top[key] = (max(logit, top[key][0]) if key in top else logit, int(targets[i]))
    if not top:
        return 1.0, 0.0
    return subwords.calibrate(np.array([x for x, _ in top.values()]), np.array([y for _, y in top.values()]))


def score(model: Model, text: Column) -> Column:
    """The probability of each text, 0 to 1."""
    weights, bias, scale, shift = model.weights, model.bias, model.scale, model.shift

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            logits = np.array([subwords.top_logit(bytes(t), weights, bias) for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(scale * logits + shift, -50, 50))))

    return probability(text.cast("binary"))


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` and ``predicted``."""
    scored = docs.select(id_col, held_out(id_col).alias("held_out"), score(model, text_of(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all others stay as they are."""
    scored = packed(docs, _score=score(model, text_of(text_col)))
    return scored.where(F.col("_score") < threshold).select("_row.*")
