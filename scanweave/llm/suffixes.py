"""Suffixes retained at minimiser positions, with the stretch of text that each speaks for.

A suffix is retained where the hash of its first ``PREFIX`` words is the least among the
starts inside some passage of ``PASSAGE`` words, so the choice depends on the content only and any
two equal passages retain a suffix at the same word.  The passages that choose the same
suffix overlap; together they are its stretch, left and right of the suffix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .line_hashes import BASE, INVERSE, _mix, _powers, word_hashes

PASSAGE = 50
PREFIX = 25
CHUNK_BYTES = 1 << 20


def _chunks(texts: list[bytes]):
    group, size = [], 0
    for no, text in enumerate(texts):
        group.append(no)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def retained(texts: list[bytes], passage: int = PASSAGE, prefix: int = PREFIX) -> dict[str, np.ndarray]:
    """Of all texts, by retained suffix: its text, prefix hash, stretch, and hashes of the stretch's passages."""
    data = b"\n".join(texts)
    begin, _, words = word_hashes(np.frombuffer(data, dtype=np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(begin, ends - 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], last])))
    count = len(words)
    empty = np.zeros(0, dtype=np.int64)
    if count < passage:
        return {"text": empty, "prefix": empty, "start": empty, "passages": empty, "stretch": empty, "hashes": empty}
    up, down = _powers(BASE, count), _powers(INVERSE, count)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * up[:count], dtype=np.uint64)])

    def hashes(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * down[start]

    at = np.arange(count - prefix + 1)
    grams = _mix(hashes(at, at + prefix), 3)
    # Where a passage fits into its text, the starts of all prefixes inside it are compared.
    starts = np.flatnonzero(owner[: count - passage + 1] == owner[passage - 1:])
    least = np.lib.stride_tricks.sliding_window_view(grams, passage - prefix + 1).argmin(axis=1)
    chosen = starts + least[starts]
    new = np.ones(len(starts), dtype=bool)
    # Passages of one text that choose the same suffix begin at neighbouring words.
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    begins, suffix = starts[first], chosen[first]
    text_begin = np.concatenate([[0], last[:-1]])
    return {
        "text": owner[begins], "prefix": grams[suffix], "start": begins - text_begin[owner[begins]], "passages": size,
        "stretch": _mix(hashes(begins, begins + size - 1 + passage), size, suffix - begins),
        "hashes": _mix(hashes(starts, starts + passage), 4),
    }


def suffix_batches(with_passages: bool):
    """``(doc, id, text)`` to rows of retained suffixes."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for group in _chunks(texts):
                found = retained([texts[i] for i in group])
                row = pa.array(np.array(group, dtype=np.int64)[found["text"]])
                doc = batch.column("doc").take(row)
                if not with_passages:
                    yield pa.RecordBatch.from_arrays([pa.array(found["prefix"]), doc], names=["prefix", "doc"])
                    continue
                offsets = np.concatenate([[0], np.cumsum(found["passages"])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found["hashes"]))
                numbers = [pa.array(found[n].astype(np.int32)) for n in ("start", "passages")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["prefix"]), doc, batch.column("id").take(row), *numbers, pa.array(found["stretch"]), lists],
                    names=["prefix", "doc", "id", "start", "passages", "stretch", "hashes"],
                )

    return run
