"""Hashes of lines, of their halves, and of the lines left by deleting one word, in numpy.

A line's hash is a polynomial over the hashes of its words, modulo 2**64.  With sums from
the left at hand, the hash of any stretch and of the line without any one word are one
subtraction and one product each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Fixed odd numbers, so that they have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, count: int) -> np.ndarray:
    return np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(0, count), base, dtype=np.uint64))])


def _mix(values: np.ndarray, *tags) -> np.ndarray:
    for tag in tags:
        values = (values ^ (np.asarray(tag, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
        values = values ^ (values >> np.uint64(29))
    return values.view(np.int64)


def word_hashes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first byte, end byte, hash)`` of every word between white space."""
    inside = ~_SPACE[chars]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begin):
        return begin, end, np.zeros(0, dtype=np.uint64)
    lengths = end - begin
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = _powers(1099511628211, int(lengths.max()))
    summed = np.add.reduceat((chars[inside].astype(np.uint64) + np.uint64(1)) * powers[place], np.cumsum(lengths) - lengths)
    return begin, end, (summed ^ (summed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


class Lines:
    """The lines of some joined texts: words of line i are ``first[i]`` up to ``last[i]``."""

    def __init__(self, data: bytes):
        chars = np.frombuffer(data, dtype=np.uint8)
        self.breaks = np.flatnonzero(chars == 10)
        begin, _, self.words = word_hashes(chars)
        line = np.searchsorted(self.breaks, begin)
        self.count = len(self.breaks) + 1
        sizes = np.bincount(line, minlength=self.count)
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes
        self.n = sizes
        most = int(sizes.max()) if len(sizes) else 0
        self.up, self.down = _powers(BASE, most + 1), _powers(INVERSE, most + 1)
        weighted = self.words * self.up[np.arange(len(self.words)) - self.first[line]]
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(weighted, dtype=np.uint64)])

    def stretch(self, start: np.ndarray, stop: np.ndarray, lines=slice(None)) -> np.ndarray:
        """Hash of words ``start`` up to ``stop`` of each line, as if they were a line."""
        first = self.first[lines]
        return (self.sums[first + stop] - self.sums[first + start]) * self.down[start]

    def hashes(self) -> np.ndarray:
        return _mix(self.stretch(np.zeros_like(self.n), self.n), self.n)

    def halves(self) -> list[np.ndarray]:
        """Keys of which two lines within one edit share one, by side; 0 where there is none.

        Of a line of n words: its halves, and the halves it would have, had it one word less.
        """
        n, none = self.n, np.zeros_like(self.n)
        half, less = n // 2, np.maximum(n - 1, 0) // 2
        prefix, suffix = self.stretch(none, half), self.stretch(half, n)
        other_prefix, other_suffix = self.stretch(none, less), self.stretch(np.minimum(less + 1, n), n)
        even = n % 2 == 0
        return [
            _mix(prefix, half, 1), _mix(suffix, n - half, 2),
            np.where(even, _mix(other_prefix, less, 1), _mix(other_suffix, np.maximum(n - 1 - less, 0), 2)),
        ]


def _joined(texts: list[bytes]):
    """Texts in groups of about ``CHUNK_BYTES``, each joined by line breaks: ``(numbers, joined)``."""
    group, size = [], 0
    for no, text in enumerate(texts):
        group.append(no)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield group, b"\n".join(texts[i] for i in group)
            group, size = [], 0
    if group:
        yield group, b"\n".join(texts[i] for i in group)


def line_batches(batches):
    """``(id, hash, text)`` to one row per line."""
    names = ["id", "hash", "line", "words", "h", "half1", "half2", "half3"]
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for group, data in _joined(texts):
            lines = Lines(data)
            per_text = np.array([texts[i].count(b"\n") + 1 for i in group])
            owner = np.repeat(np.array(group), per_text)
            number = np.arange(lines.count) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            at = pa.array(owner)
            columns = [number.astype(np.int32), lines.n.astype(np.int32), lines.hashes(), *lines.halves()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns)], names=names)


def text_batches(least: int):
    """``(text)`` to ``(h, text)`` of every line of at least ``least`` words."""

    def run(batches):
        for batch in batches:
            for _, data in _joined(batch.column(0).to_pylist()):
                lines = Lines(data)
                wanted = np.flatnonzero(lines.n >= least)
                split = data.split(b"\n")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.hashes()[wanted]), pa.array([split[i] for i in wanted.tolist()], type=pa.binary())], names=["h", "text"]
                )

    return run


def variant_batches(least: int):
    """Lines ``(h, text)`` to ``(key, deleted, h)``: the line itself (-1) and without each one word.

    A line is shortened if it has ``least`` words or more.
    """

    def run(batches):
        for batch in batches:
            for group, data in _joined(batch.column(1).to_pylist()):
                lines = Lines(data)
                own = batch.column(0).take(pa.array(group)).to_numpy()
                none = np.zeros_like(lines.n)
                whole = _mix(lines.stretch(none, lines.n), lines.n)
                which = np.repeat(np.arange(lines.count), np.where(lines.n >= least, lines.n, 0))
                n = lines.n[which]
                deleted = np.arange(len(which)) - np.repeat(np.cumsum(n_ := np.where(lines.n >= least, lines.n, 0)) - n_, n_)
                before = lines.stretch(np.zeros_like(n), deleted, which)
                after = lines.stretch(deleted + 1, n, which) * lines.up[deleted]
                key = np.concatenate([whole, _mix(before + after, n - 1)])
                place = np.concatenate([np.full(lines.count, -1), deleted]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(place), pa.array(np.concatenate([own, own[which]]))], names=["key", "deleted", "h"]
                )

    return run


def within_one_edit(a: bytes, b: bytes) -> bool:
    """Whether one word inserted, deleted or replaced, or nothing, makes the lines equal."""
    x, y = a.split(), b.split()
    if abs(len(x) - len(y)) > 1:
        return False
    same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    rest_x, rest_y = x[same:], y[same:]
    return rest_x[len(x) >= len(y):] == rest_y[len(y) >= len(x):]


def verified_batches(batches):
    """Keeps the links ``(h, first, a, b)`` whose texts are within one edit."""
    for batch in batches:
        kept = [within_one_edit(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
        yield batch.select(["h", "first"]).filter(pa.array(kept, type=pa.bool_()))
