"""Random-walk embedding of word sequences, bit-sampling keys, and exact edit distances.

The embedding of Chakraborty, Goldenberg and Koucky reads a sequence with a pointer: at
step j it writes the word under the pointer, and a random function of j and the word says
whether the pointer moves.  Sequences at small edit distance meet again soon after an edit
and from there write the same words, so their embeddings are close in Hamming distance.
A key samples a few steps of an embedding; several keys are taken from several embeddings.
"""

from __future__ import annotations

import re

import numpy as np

MIN_WORDS = 8
STRIDE = 4
EMBEDDINGS = 3
KEYS = 10
SAMPLED = 4
# Items of this many words or more, the steps from which their keys are sampled.
CLASSES = ((8, 8), (16, 20), (32, 44))
TESTED = 48
PIECE = 1 << 18
WALKERS = 1 << 15
# Bits of the table of keys, and slots for each key in between.
_TABLE_BITS = (19, 24)
_SLOTS = 32

_SPACE = re.compile(r"\s")
_FOLD = np.array([c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def _random(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_STEPS = _random(EMBEDDINGS * CLASSES[-1][1], 11).reshape(EMBEDDINGS, -1)


def _samples() -> list[list[np.ndarray]]:
    """By class, the steps that each key samples, one from each part of the walk."""
    rng = np.random.default_rng(12)
    part = lambda steps, i: rng.integers(steps * i // SAMPLED, steps * (i + 1) // SAMPLED)
    return [[np.array([part(steps, i) for i in range(SAMPLED)]) for _ in range(KEYS)] for _, steps in CLASSES]


_SAMPLED = _samples()


def symbols(text: str) -> np.ndarray:
    """A number from 1 up for each word; letters are folded to lower case, other characters separate."""
    found, start = [], 0
    text = text.lower()
    while start < len(text):
        cut = _SPACE.search(text, start + PIECE) if start + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        chars = _FOLD[np.frombuffer(text[start:end].encode("utf-8", "replace") + b" ", dtype=np.uint8)]
        start = end
        inside = chars != 32
        begin = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        if not len(begin):
            continue
        lengths = np.diff(np.append(begin, len(chars)))
        place = np.arange(len(chars) - begin[0]) - np.repeat(begin - begin[0], lengths)
        powers = np.cumprod(np.full(int(lengths.max()), 1099511628211, dtype=np.uint64))
        summed = np.add.reduceat(chars[begin[0]:] * powers[place] * inside[begin[0]:], begin - begin[0])
        summed = (summed ^ (summed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((summed >> np.uint64(32)).astype(np.uint32) | np.uint32(1))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def walk_keys(words: np.ndarray, starts: np.ndarray, classes: list[int]):
    """For each embedding and class and key: ``(number of the key, keys of all starts)``.

    ``words`` ends in zeros, which pointers do not leave.
    """
    steps = max(CLASSES[c][1] for c in classes)
    last = len(words) - 1
    for e in range(EMBEDDINGS):
        pointer = starts.copy()
        made = {(c, k): np.zeros(len(starts), dtype=np.uint64) for c in classes for k in range(KEYS)}
        for step in range(steps):
            here = words[pointer].astype(np.uint64)
            mixed = here * _STEPS[e, step]
            high = mixed >> np.uint64(17)
            for (c, k), key in made.items():
                if step in _SAMPLED[c][k]:
                    key *= np.uint64(0x9E3779B97F4A7C15)
                    key ^= high
            pointer = np.minimum(pointer + (mixed >> np.uint64(63)).astype(pointer.dtype), last)
        for (c, k), key in made.items():
            number = (e * len(CLASSES) + c) * KEYS + k
            yield number, (key + np.uint64(number)) * np.uint64(0xD6E8FEB86659FD93)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct rows in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows


def class_of(count: int) -> int:
    return max(c for c, (least, _) in enumerate(CLASSES) if count >= least)


def walk_starts(count: int, c: int) -> list[int]:
    """Words of an item of ``count`` words at which it is walked with class ``c``.

    ``STRIDE`` in a row make a place that no text's walks miss; places are half a walk apart,
    the last one as near the end as a walk fits.
    """
    span = CLASSES[c][1] // 2
    last = max(0, count - span)
    places = [*range(0, last, max(STRIDE, span // 2)), max(0, last - STRIDE + 1)]
    return sorted({o for at in places for o in range(at, min(at + STRIDE, count))})


def stretch_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A key for every ``size`` words in a row."""
    keys = np.full(max(0, len(words) - size + 1), size, dtype=np.uint64)
    for i in range(size):
        keys = (keys ^ words[i:len(words) - size + 1 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys * np.uint64(0xD6E8FEB86659FD93)


def pieces(count: int, rate: float) -> list[tuple[int, int]]:
    """``(first word, words)`` of the pieces of a short item: one more than the edits allowed, so one is left whole."""
    many = min(int(rate * count) + 1, count)
    cuts = [count * i // many for i in range(many + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Index:
    """The keys of a block of items, each walked from places along its whole length.

    Texts are then walked from every ``STRIDE``-th word only: one of these meets one of
    the walks of each place at the same word of the item.  So a copy is a candidate if any
    of its places is close enough, wherever its other words were changed.

    Items under ``MIN_WORDS`` words are too short to walk: their pieces are looked up at every
    word of a text, which finds all copies within ``rate`` edits per word.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float = 0.2):
        known = [(no, symbols(text)) for no, text in items]
        known = [(no, words) for no, words in known if len(words)]
        self.items = known
        self.distinct = [frozenset(words.tolist()) for _, words in known]
        keys, owners, offsets = [], [], []
        walked = [class_of(len(w)) if len(w) >= MIN_WORDS else None for _, w in known]
        self.classes = sorted(set(walked) - {None})
        padding = np.zeros(CLASSES[-1][1] + 1, dtype=np.uint32)
        for c in self.classes:
            joined, starts, owner, offset, at = [], [], [], [], 0
            for i in (i for i, own in enumerate(walked) if own == c):
                words = known[i][1]
                own = walk_starts(len(words), c)
                starts += [at + o for o in own]
                owner += [i] * len(own)
                offset += own
                joined += [words, padding]
                at += len(words) + len(padding)
            owner, offset = np.array(owner, dtype=np.int32), np.array(offset, dtype=np.int32)
            for _, key in walk_keys(np.concatenate(joined), np.array(starts, dtype=np.int64), [c]):
                keys.append(key)
                owners.append(owner)
                offsets.append(offset)
        short = [(i, at, size) for i, own in enumerate(walked) if own is None for at, size in pieces(len(known[i][1]), rate)]
        self.sizes = sorted({size for _, _, size in short})
        if short:
            keys.append(np.concatenate([stretch_keys(known[i][1][at:at + size], size) for i, at, size in short]))
            owners.append(np.array([i for i, _, _ in short], dtype=np.int32))
            offsets.append(np.array([at for _, at, _ in short], dtype=np.int32))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owners = np.concatenate(owners)[order] if keys else np.zeros(0, dtype=np.int32)
        self.offsets = np.concatenate(offsets)[order] if keys else np.zeros(0, dtype=np.int32)
        self.bits = min(max(_TABLE_BITS[0], (_SLOTS * len(self.keys)).bit_length()), _TABLE_BITS[1])
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[_slot(self.keys, self.bits)] = True
        # Each item's distinct words, those in the fewest items first, as numbers in the vocabulary.
        each = [np.fromiter(d, dtype=np.uint32, count=len(d)) for d in self.distinct]
        flat = np.concatenate([np.zeros(0, dtype=np.uint32), *each])
        self.vocabulary, code, often = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(each)), [len(d) for d in each])
        self.codes = code[np.lexsort((code, often[code], owner))]
        self.ends = np.cumsum([len(d) for d in each], dtype=np.int64)
        self.lengths = np.array([len(w) for _, w in known], dtype=np.int64)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct ``(item, word where it would begin, word where the walk began)`` of shared keys."""
        padded = np.concatenate([words, np.zeros(1, dtype=np.uint32)])
        found = []

        def look_up(keys, starts):
            at = np.flatnonzero(self.table[_slot(keys, self.bits)])
            if not len(at):
                return
            first = np.searchsorted(self.keys, keys[at], "left")
            here = self.keys[np.minimum(first, len(self.keys) - 1)] == keys[at]
            at, first = at[here], first[here]
            count = np.searchsorted(self.keys, keys[at], "right") - first
            which = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(starts[at], count)
            found.append(np.stack([self.owners[which], start - self.offsets[which], start], axis=1))

        if self.classes:
            for low in range(0, len(words), WALKERS * STRIDE):
                starts = np.arange(low, min(len(words), low + WALKERS * STRIDE), STRIDE, dtype=np.int64)
                for _, keys in walk_keys(padded, starts, self.classes):
                    look_up(keys, starts)
        for size in self.sizes:
            keys = stretch_keys(words, size)
            look_up(keys, np.arange(len(keys), dtype=np.int64))
        return _distinct(np.concatenate(found)) if found else np.zeros((0, 3), dtype=np.int64)


def plausible(index: Index, words: np.ndarray, hits: np.ndarray, low: np.ndarray, high: np.ndarray, rate: float) -> np.ndarray:
    """Which hits may hold their item: no more of its ``TESTED`` rarest words are missing than edits are allowed.

    ``low`` and ``high`` bound the text of each hit.
    """
    at = np.searchsorted(index.vocabulary, words)
    known = np.flatnonzero(index.vocabulary[np.minimum(at, len(index.vocabulary) - 1)] == words)
    width = len(words) + 1
    places = np.sort(at[known] * width + known)
    owner, length = hits[:, 0], index.lengths[hits[:, 0]]
    allowed = (rate * length).astype(np.int64)
    low = np.maximum(low, hits[:, 1] - allowed)
    high = np.minimum(high, hits[:, 1] + length + allowed)
    missing = np.zeros(len(hits), dtype=np.int64)
    begins = np.concatenate([[0], index.ends[:-1]])
    left = np.flatnonzero(high - low >= length - allowed)
    for tested in range(TESTED):
        own = begins[owner[left]] + tested
        some = own < index.ends[owner[left]]
        rows, code = left[some], index.codes[own[some]].astype(np.int64) * width
        first = np.searchsorted(places, code + low[rows])
        found = first < len(places)
        found[found] = places[first[found]] < (code + high[rows])[found]
        missing[rows] += ~found
        left = left[missing[left] <= allowed[left]]
    return left


def _distances(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    """By number of words, the least word edit distance between ``item`` and a stretch that ends there."""
    width = len(words) + 1
    across = np.arange(width)
    row = np.zeros(width, dtype=np.int64)
    for i, word in enumerate(item.tolist(), 1):
        step = np.empty(width, dtype=np.int64)
        step[0] = i
        step[1:] = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        row = np.minimum.accumulate(step - across) + across
    return row


def best_distance(item: np.ndarray, words: np.ndarray) -> int:
    """The least word edit distance between ``item`` and any stretch of ``words``."""
    return int(_distances(item, words).min())


def best_place(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """The least distance, and the first word of the earliest stretch at it."""
    row = _distances(item[::-1], words[::-1])[::-1]
    return int(row.min()), int(row.argmin())


def verified(index: Index, words: np.ndarray, hits: np.ndarray, rate: float) -> list[tuple[int, int, int, int]]:
    """``(item, words, distance, first word)`` of the items that ``words`` holds, each at its best place."""
    best: dict[int, tuple[int, int]] = {}
    for owner, begin in hits.tolist():
        # Places are in order: after a whole copy no other is better.
        if best.get(owner, (1, 0))[0] == 0:
            continue
        item = index.items[owner][1]
        allowed = int(rate * len(item))
        region = words[max(0, begin - allowed): max(0, begin + len(item) + allowed)]
        # Every word of the item that the region lacks costs an edit.
        if len(region) < len(item) - allowed or len(index.distinct[owner].difference(region.tolist())) > allowed:
            continue
        distance, place = best_place(item, region)
        found = (distance, max(0, begin - allowed) + place)
        if found[0] <= allowed and found < best.get(owner, (allowed + 1, 0)):
            best[owner] = found
    return [(index.items[o][0], len(index.items[o][1]), *found) for o, found in sorted(best.items())]


def batch_matches(index: Index, texts: list[str], rate: float) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, words, distance, first word)``; texts are walked together."""
    out, gap = [], np.zeros(1, dtype=np.uint32)
    group: list[tuple[int, np.ndarray]] = []

    def flush():
        joined = np.concatenate([x for _, words in group for x in (words, gap)])
        begins = np.cumsum([0] + [len(words) + 1 for _, words in group])
        hits = index.candidates(joined)
        text = np.searchsorted(begins, hits[:, 2], "right") - 1
        likely = plausible(index, joined, hits, begins[text], begins[text + 1] - 1, rate)
        hits, text = hits[likely], text[likely]
        order = np.argsort(text, kind="stable")
        cuts = np.flatnonzero(np.diff(text[order])) + 1
        for own in np.split(order, cuts):
            if len(own):
                no, words = group[text[own[0]]]
                own_hits = _distinct(hits[own, :2] - np.array([0, begins[text[own[0]]]]))
                out.extend((no, *m) for m in verified(index, words, own_hits, rate))
        group.clear()

    size = 0
    for no, text in enumerate(texts):
        words = symbols(text)
        if len(words):
            group.append((no, words))
            size += len(words)
        if size > WALKERS * STRIDE:
            flush()
            size = 0
    if group:
        flush()
    return out
