"""Maximal runs in sequences of words, from an enhanced suffix array: arrays only, no tree nodes."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words worked on together, unless one text has more.
BLOCK_WORDS = 1 << 18
MIN_LENGTH, MIN_EXPONENT = 6, 4


def suffix_levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by doubling, and per level the rank of every place by its next 2^level symbols.

    A rank is the first place of its group in the suffix array.  Symbols of one sequence are
    unknown to the others, so a suffix that ends never equals another.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    starts = np.flatnonzero(np.diff(symbols[order], prepend=symbols[order[0]] - 1)) if n else np.empty(0, np.int64)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, np.diff(starts, append=n)).astype(np.int32)
    levels, width = [rank], 1
    open_at = _in_groups(starts, n)
    while len(open_at):
        rank = levels[-1]
        places = order[open_at]
        ahead = places + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1).astype(np.int64)
        key = rank[places].astype(np.int64) << 32 | (second + 1)
        sorting = np.argsort(key, kind="stable")
        places, key = places[sorting], key[sorting]
        order[open_at] = places
        heads = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        sizes = np.diff(heads, append=len(key))
        new = rank.copy()
        new[places] = np.repeat(open_at[heads], sizes).astype(np.int32)
        levels.append(new)
        open_at = open_at[np.repeat(sizes > 1, sizes)]
        width *= 2
    return order, levels


def _in_groups(starts: np.ndarray, n: int) -> np.ndarray:
    sizes = np.diff(starts, append=n)
    return np.flatnonzero(np.repeat(sizes > 1, sizes))


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many symbols the suffixes at places p-1 and p of the suffix array share, 0 for the first."""
    n = len(order)
    lcp = np.zeros(n, np.int32)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1 if n else np.empty(0, np.int64)
    left, right, known = order[at - 1].copy(), order[at].copy(), np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        inside = (left < n) & (right < n)
        same = np.zeros(len(at), bool)
        same[inside] = rank[left[inside]] == rank[right[inside]]
        step = same.astype(np.int64) << level
        left, right, known = left + step, right + step, known + step
    lcp[at] = known
    return lcp


def intervals(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the boundaries ``at``: first and last place of the interval whose depth is ``lcp[at]``.

    Of equal boundaries the first one takes what is on its left, so that every pair of
    suffixes is parted by exactly one boundary.  Found by halving over sliding minima.
    """
    minima, longest = [lcp], int(np.diff(np.flatnonzero(lcp == 0), append=len(lcp)).max(initial=1))
    while 1 << len(minima) <= longest:
        half, last = 1 << (len(minima) - 1), minima[-1]
        minima.append(np.minimum(last, np.concatenate([last[half:], np.zeros(min(half, len(last)), last.dtype)])))
    depth, n = lcp[at], len(lcp)
    first, after = at.copy(), at + 1  # boundaries first+1..at have at least this depth; so have at..after-1
    for level in range(len(minima) - 1, -1, -1):
        width, low = 1 << level, minima[level]
        back = first - width
        ok = back >= 0
        ok[ok] = low[back[ok]] > depth[ok]
        first = np.where(ok, back, first)
        ok = after + width <= n
        ok[ok] = low[after[ok]] >= depth[ok]
        after = np.where(ok, after + width, after)
    return first - 1, after - 1


def branching_squares(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares xx that the symbol after them does not continue.

    Two suffixes parted at a boundary of depth d share exactly d symbols.  For every boundary
    the suffixes of its smaller side are taken: one of them and its neighbour d places on,
    or d back, make such a square if the neighbour is on the other side.
    """
    n = len(order)
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    first, last = intervals(lcp, at)
    left_smaller = at - first <= last - at + 1
    low, high = np.where(left_smaller, first, at), np.where(left_smaller, at - 1, last)
    other_low, other_high = np.where(left_smaller, at, first), np.where(left_smaller, last, at - 1)
    starts, periods = [], []
    sizes = high - low + 1
    ends = np.cumsum(sizes)
    cut = 0
    while cut < len(at):  # some boundaries at a time: their smaller sides may be many
        base = ends[cut - 1] if cut else 0
        stop = max(int(np.searchsorted(ends, base + 4 * BLOCK_WORDS, "right")), cut + 1)
        size = sizes[cut:stop]
        which = np.repeat(np.arange(cut, stop), size)
        suffix = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which]]
        depth = lcp[at[which]].astype(np.int64)
        for first_of in (suffix, suffix - depth):
            partner = suffix + depth if first_of is suffix else first_of
            ok = (partner >= 0) & (partner < n)
            where = place[partner[ok]]
            ok[ok] = (where >= other_low[which[ok]]) & (where <= other_high[which[ok]])
            starts.append(first_of[ok])
            periods.append(depth[ok])
        cut = stop
    return np.concatenate(starts), np.concatenate(periods)


def maximal_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of the runs of ``MIN_LENGTH`` symbols and
    ``MIN_EXPONENT`` periods at least, by start, then period.

    Squares are rotated to the left as far as the period holds, and the runs with the same
    end that lie in one another's period are merged.
    """
    order, levels = suffix_levels(symbols)
    lcp = common_prefixes(order, levels)
    del levels
    start, period = branching_squares(order, lcp)
    # A run of four periods has two more periods before its last square.
    need = np.maximum((MIN_EXPONENT - 2) * period, MIN_LENGTH - 2 * period)
    for part in (1, 2, 4):  # some of the symbols that must agree, before all are looked at
        ok = start - need >= 0
        there = (start - np.maximum(need // part, 1))[ok]
        ok[ok] = symbols[there] == symbols[there + period[ok]]
        start, period, need = start[ok], period[ok], need[ok]
    end = start + 2 * period
    found: list[tuple[int, int, int]] = []
    by_end = np.lexsort((period, end))
    last_end, runs_here = -1, []
    for s, q, e in zip(start[by_end].tolist(), period[by_end].tolist(), end[by_end].tolist()):
        if e != last_end:
            last_end, runs_here = e, []
        if any(q % p == 0 and first <= s for first, p in runs_here):
            continue  # a square of several periods of a run that is known
        first = _rotate_left(symbols, s, q)
        if e - first >= max(MIN_LENGTH, MIN_EXPONENT * q):
            runs_here.append((first, q))
            found.append((first, e - first, q))
    found.sort(key=lambda r: (r[0], r[2]))
    columns = np.array(found, dtype=np.int64).reshape(-1, 3)
    return columns[:, 0], columns[:, 1], columns[:, 2]


def _rotate_left(symbols: np.ndarray, start: int, period: int) -> int:
    """The smallest place from which on, up to ``start``, symbols a period apart are equal."""
    width = 16
    while start > 0:
        low = max(0, start - width)
        differ = np.flatnonzero(symbols[low:start] != symbols[low + period:start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, width = low, 2 * width
    return 0


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """``(a, p)`` if the words from ``a`` on are to repeat the ``p`` words there."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has; only the six blanks of ASCII part words."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    words, of = words.filter(full), of.filter(full).to_numpy(zero_copy_only=False)
    return words, np.bincount(of, minlength=len(texts)).astype(np.int64)


def run_batches(plant_tails: bool):
    """Batches ``(id, text)`` become rows with the text's runs and the words that stay.

    ``starts, lengths, periods`` are lists; ``collapsed`` is the text without what a run repeats.
    """

    def blocks(batch):
        size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        low, held = 0, 0
        for i, s in enumerate(size.tolist()):
            if held and held + s > 4 * BLOCK_WORDS:
                yield batch.slice(low, i - low)
                low, held = i, 0
            held += s
        if low < batch.num_rows:
            yield batch.slice(low)

    def run(batches):
        for batch in batches:
            for block in blocks(batch):
                yield _block_runs(block, plant_tails)

    return run


def _block_runs(block: pa.RecordBatch, plant_tails: bool) -> pa.RecordBatch:
    ids, texts = block.column(0), block.column(1).fill_null("")
    words, counts = _words(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = int(bounds[-1])
    source = np.arange(total)
    if plant_tails:
        for doc, (low, n) in zip(ids.to_pylist(), zip(bounds[:-1].tolist(), counts.tolist())):
            tail = repeated_tail(doc, n)
            if tail:
                a, p = tail
                source[low + a:low + n] = low + a + np.arange(n - a) % p
    coded = words.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    symbols = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[source]
    owner = np.repeat(np.arange(len(counts)), counts)
    start, length, period = maximal_runs(symbols + owner * (len(coded.dictionary) + 1))
    # What a run has after its first period goes: +1 where such a stretch begins, -1 after it.
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    kept_words = words.take(pa.array(source[kept]))
    kept_bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    of_doc = np.searchsorted(start, bounds, "left")
    offset = np.repeat(bounds[:-1], np.diff(of_doc))
    lists = lambda values: pa.LargeListArray.from_arrays(pa.array(of_doc, pa.int64()), pa.array(values, pa.int64())).cast(pa.list_(pa.int64()))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept_bounds, pa.int64()), kept_words), pa.scalar(" ", pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [ids, lists(start - offset), lists(length), lists(period), collapsed.cast(pa.string())],
        ["id", "starts", "lengths", "periods", "collapsed"],
    )


def digest_batches(plant_tails: bool):
    """As :func:`run_batches`, with the longest run and digests in place of lists and texts."""
    find = run_batches(plant_tails)

    def run(batches):
        for found in find(batches):
            rows = []
            for doc, starts, lengths, periods, text in zip(*(c.to_pylist() for c in found.columns)):
                runs = list(zip(starts, lengths, periods))
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((doc, len(runs), *longest, sha256(listed.encode()).hexdigest(), sha256(text.encode()).hexdigest()))
            numbers, digests = ["n_runs", "start", "length", "period", "exponent_milli"], ["runs_sha256", "collapsed_sha256"]
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], found.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:6]), *(pa.array(c, pa.string()) for c in columns[6:])]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *numbers, *digests])

    return run
