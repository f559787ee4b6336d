"""Subword-bag embeddings averaged into a linear softmax, in numpy.

A text is cut into windows of words.  A window's features are the hashed character n-grams
of its words, word edges included; their embeddings are averaged and a linear softmax gives
the window's class.  Embeddings and softmax are trained together.  After training only each
feature's share of the logit is needed, one number per bucket.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
WINDOW_WORDS = 128
PIECE_BYTES = 1 << 20
# Zero vectors in every average: a window of few words cannot be decided by noise.
PRIOR = 100

# Letters, digits and all bytes beyond ASCII make words; A-Z count as a-z.
_FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)], dtype=np.uint8
)
_EDGE = re.compile(rb"[\x00-\x20]")


def pieces(text: bytes):
    """The text in pieces cut at white space, so that no array gets large."""
    start = 0
    while start < len(text):
        cut = _EDGE.search(text, start + PIECE_BYTES) if start + PIECE_BYTES < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def features(piece: bytes, first_word: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """``(window, bucket)`` of every n-gram, and the number of the next word."""
    chars = np.empty(len(piece) + 2, dtype=np.uint8)
    chars[0] = chars[-1] = 32
    chars[1:-1] = _FOLD[np.frombuffer(piece, dtype=np.uint8)]
    edge = chars == 32
    starts = np.zeros(len(chars), dtype=np.int32)
    starts[1:] = edge[:-1] & ~edge[1:]
    word = np.cumsum(starts, dtype=np.int32)
    edges = np.cumsum(edge, dtype=np.int32)
    # Of equal words of a window, the first counts.
    begin = np.flatnonzero(starts)
    first = np.zeros(len(begin) + 1, dtype=bool)
    if len(begin):
        powers = np.cumprod(np.full(len(chars), 1099511628211, dtype=np.uint64))
        summed = np.add.reduceat(chars * powers[np.arange(len(chars)) - begin[np.maximum(word, 1) - 1]] * ~edge, begin)
        window_of = (np.arange(len(begin)) + first_word) // WINDOW_WORDS
        key = (summed >> np.uint64(20)) ^ (window_of.astype(np.uint64) << np.uint64(44))
        first[np.unique(key, return_index=True)[1]] = True
    windows, buckets = [], []
    code = chars.astype(np.uint32)
    grams = code
    for size in range(2, max(SIZES) + 1):
        grams = grams[:-1] * np.uint32(16777619) + code[size - 1:]
        if size not in SIZES or not len(grams):
            continue
        # No edge strictly inside: none among the characters after the first and before the last.
        at = np.flatnonzero(edges[size - 2: len(chars) - 1] == edges[: len(chars) - size + 1])
        at = at[first[word[at + 1] - 1]]
        mixed = (grams[at] ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        buckets.append(((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32))
        windows.append((word[at + 1] - 1 + first_word) // WINDOW_WORDS)
    if not windows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), first_word
    return np.concatenate(windows), np.concatenate(buckets), first_word + int(word[-1])


def bags(text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, counts)`` of every window of a text."""
    seen, word = [], 0
    for piece in pieces(text):
        window, bucket, word = features(piece, word)
        seen.append(window.astype(np.int64) * BUCKETS + bucket)
    if not seen:
        return []
    values, counts = np.unique(np.concatenate(seen), return_counts=True)
    cuts = np.flatnonzero(np.diff(values // BUCKETS)) + 1
    return [
        ((v % BUCKETS).astype(np.int32), c.astype(np.int32)) for v, c in zip(np.split(values, cuts), np.split(counts, cuts)) if len(v)
    ]


def top_logit(text: bytes, weights: np.ndarray, bias: float) -> float:
    """The highest logit of any window; the bias alone for a text without words."""
    sums, counts, word = np.zeros(0), np.zeros(0), 0
    for piece in pieces(text):
        window, bucket, word = features(piece, word)
        if len(window):
            n = int(window.max()) + 1
            if n > len(sums):
                sums, counts = np.pad(sums, (0, n - len(sums))), np.pad(counts, (0, n - len(counts)))
            low = int(window.min())
            sums[low:n] += np.bincount(window - low, weights=weights[bucket], minlength=n - low)
            counts[low:n] += np.bincount(window - low, minlength=n - low)
    filled = counts > 0
    return bias + (float((sums[filled] / (counts[filled] + PRIOR)).max()) if filled.any() else 0.0)


def calibrate(logits: np.ndarray, labels: np.ndarray, weight: float = 5.0, steps: int = 50) -> tuple[float, float]:
    """``(scale, shift)`` of the logistic curve from a text's top logit to its label, by Newton steps.

    A text has many windows, so its top logit is higher than a window's; rows that were not
    trained on tell by how much.  Toxic rows, which are rare, count ``weight`` times.  Without
    both labels the logits stay as they are.
    """
    if len(np.unique(labels)) < 2:
        return 1.0, 0.0
    x = np.stack([np.clip(logits, -20, 20), np.ones(len(logits))], axis=1)
    each = np.where(labels == 1, weight, 1.0)
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (each * (p - labels)) + np.array([1e-2, 1e-2]) * (at - [1.0, 0.0])
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        at -= np.clip(move, -1, 1)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, seen: int = 60_000, batch: int = 64,
    rate: float = 0.5, seed: int = 0, start_sq: float = 1e-3,
) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax together; returns ``(logit share by bucket, bias)``.

    Windows pass in mini-batches, at least three times each and ``seen`` of them in all.
    """
    epochs = max(3, round(seen / max(1, len(rows))))
    rng = np.random.default_rng(seed)
    embed = (rng.random((BUCKETS, dim), dtype=np.float32) - 0.5) / dim
    out = (rng.random((dim, 2), dtype=np.float32) - 0.5) * 2
    bias = np.log(np.maximum(np.bincount(labels, minlength=2), 1) / max(1, len(labels))).astype(np.float32)
    embed_sq, out_sq, bias_sq = np.full(BUCKETS, start_sq, dtype=np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            picked = order[start:start + batch]
            lengths = np.array([len(rows[i][0]) for i in picked])
            bucket = np.concatenate([rows[i][0] for i in picked])
            share = np.concatenate([rows[i][1] / (float(rows[i][1].sum()) + PRIOR) for i in picked]).astype(np.float32)
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            mean = np.add.reduceat(embed[bucket] * share[:, None], begins, axis=0)
            logits = mean @ out + bias
            logits -= logits.max(axis=1, keepdims=True)
            error = np.exp(logits)
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(picked)), labels[picked]] -= 1.0
            to_mean = error @ out.T
            # One gradient per bucket of the batch: occurrences are summed after sorting.
            sort = np.argsort(bucket, kind="stable")
            same = np.flatnonzero(np.concatenate([[True], np.diff(bucket[sort]) > 0]))
            unique = bucket[sort][same]
            grad = np.add.reduceat((np.repeat(to_mean, lengths, axis=0) * share[:, None])[sort], same, axis=0)
            embed_sq[unique] += (grad ** 2).mean(axis=1)
            embed[unique] -= rate * grad / np.sqrt(embed_sq[unique])[:, None]
            grad_out, grad_bias = mean.T @ error, error.sum(axis=0)
            out_sq += grad_out ** 2
            out -= rate * grad_out / np.sqrt(out_sq)
            bias_sq += grad_bias ** 2
            bias -= 0.1 * rate * grad_bias / np.sqrt(bias_sq)
    toward = out[:, 1] - out[:, 0]
    return (embed @ toward).astype(np.float32), float(bias[1] - bias[0])


def bag_batches(batches):
    """``(key, label, text)`` to one row per window; numbers travel as bytes."""
    for batch in batches:
        keys, labels, found = [], [], []
        for key, label, text in zip(*(column.to_pylist() for column in batch.columns)):
            windows = bags(text)
            keys += [key] * len(windows)
            labels += [label] * len(windows)
            found += [(bucket.tobytes(), count.astype(np.uint8).tobytes()) for bucket, count in windows]
        packed_bags = [pa.array([w[i] for w in found], type=pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, type=pa.int64()), pa.array(labels, type=pa.int32()), *packed_bags], names=["key", "label", "bucket", "count"]
        )
