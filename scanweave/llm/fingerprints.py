"""SimHash fingerprints, their fuzzy keys, and the links among fingerprints that share a key."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 3
HASH_SEED = 42
BLOCK_BYTES = 1 << 20
SEGMENTS, SEGMENT_BITS = 4, 16
DISTANCE = 3

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(text: bytes):
    """Words of ``text``, a block at a time; bytes are split and lower-cased as ASCII."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + BLOCK_BYTES) if start + BLOCK_BYTES < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end].lower().split()
        start = end


def fingerprint(text: bytes) -> int:
    """The 64 majority bits over the hashes of all shingles, repeats included."""
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _word_blocks(text):
        words = tail + words
        hashes = np.array(
            [digest(b" ".join(s), HASH_SEED) for s in zip(words, words[1:], words[2:])], dtype="<u8"
        )
        if len(hashes):
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(SHINGLE - 1):]
    if not total:
        if not tail:
            return 0
        return digest(b" ".join(tail), HASH_SEED)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > total))


def fingerprint_batches(batches):
    """``(id, text, hash)`` to ``(id, hash, fp)``, as signed numbers."""
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], names=["id", "hash", "fp"])


def fuzzy_keys(prints: np.ndarray, codewords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` pairs: each key is one whole segment and a codeword near the next one.

    If two fingerprints differ in at most 3 bits, some segment is equal in both and the next
    one differs in at most one bit: were the one after every equal segment worse, two
    different segments would hold at least two errors each, or a third of the bits differ.
    """
    segments = [(prints.view(np.uint64) >> np.uint64(SEGMENT_BITS * i)).astype(np.int64) & 0xFFFF for i in range(SEGMENTS)]
    rows, keys = [], []
    for i, whole in enumerate(segments):
        near = codewords[segments[(i + 1) % SEGMENTS]]
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((i << 28) | (whole[row] << 12) | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def key_batches(codewords: np.ndarray):
    def run(batches):
        for batch in batches:
            node, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, key = fuzzy_keys(prints, codewords)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(prints[row])], names=["key", "node", "fp"])

    return run


def group_links(group: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within ``distance`` inside groups of equal, adjacent numbers.

    All pairs of a group are compared, those of all groups at once: rows with the row one
    below, two below, and so on.  Of the pairs found, one that closes a ring is left out.
    """
    parent = np.arange(len(group))
    left, right, step = [], [], 1

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    while step < len(group):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        at = np.flatnonzero(same)
        close = np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= distance
        at = at[close]
        while True:  # flatten the trees, then drop pairs that are connected already
            flat = parent[parent]
            if (flat == parent).all():
                break
            parent = flat
        at = at[parent[at] != parent[at + step]]
        for i in at.tolist():
            a, b = root(i), root(i + step)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
        step += 1
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def link_batches(batches):
    """Rows ``(key, a, b, node, fp)`` sorted by the first three, to links ``(u, v)`` of nodes.

    Rows of a group may span batches: the last group of a batch waits for the next one.
    """
    rest = None

    def links(table):
        keys = [table.column(c).to_numpy() for c in ("key", "a", "b")]
        node, prints = table.column("node").to_numpy(), table.column("fp").to_numpy()
        new = np.zeros(len(node), dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        i, j = group_links(np.cumsum(new), prints)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        last = table.num_rows - 1
        differs = np.zeros(table.num_rows, dtype=bool)
        for c in ("key", "a", "b"):
            column = table.column(c).to_numpy()
            differs |= column != column[last]
        ends = np.flatnonzero(differs)
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield links(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield links(rest)
