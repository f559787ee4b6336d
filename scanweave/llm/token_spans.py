"""Tokens of two vocabularies as byte spans of one text, and how these spans meet."""

from __future__ import annotations

import json
import os
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa

# Characters handed to the tokenizers together, unless one text has more.
BLOCK_CHARS = 1 << 20
# A pair of ids in one number: the id of the second vocabulary is the remainder.
PAIR_BASE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The byte for which each printable character stands in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


_LONG_SPACE = re.compile(r"\s{10000}")

# Fixed value: how a byte-level tokenizer that uses its regex cuts a text before the merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Vocabulary A: the JSON text of a byte-level file; a text is encoded after a blank.

    A plain file, whose merges make its ids in ascending order, is encoded by ranks where the
    worker has that library, in a third of the time; tests compare it with the other library
    over all characters.  Other files, and workers without it, take the other library.
    """

    def __init__(self, source: str, by_ranks: bool = True):
        letters, spec = byte_letters(), json.loads(source)
        entries = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.ranks = self._by_ranks(spec, entries) if by_ranks else None
        self.source, self.tokenizer = source, None
        entries |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.entries = [entries.get(i, b"") for i in range(max(entries) + 1)]

    @staticmethod
    def _by_ranks(spec: dict, entries: dict[int, bytes]):
        model, cut = spec["model"], spec["pre_tokenizer"]
        made = [model["vocab"].get("".join(pair)) for pair in model["merges"]]
        plain = (
            model["type"] == "BPE" and not spec["normalizer"] and cut["type"] == "ByteLevel" and cut["use_regex"]
            and not cut["add_prefix_space"] and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"]
            and not model["ignore_merges"] and not model["byte_fallback"] and made == list(range(256, 256 + len(made)))
            and len({entries[i] for i in entries}) == len(entries) == 256 + len(made)
        )
        if not plain:
            return None
        try:
            from tiktoken import Encoding
        except ImportError:
            return None
        return Encoding("a", pat_str=CUTS, mergeable_ranks={raw: i for i, raw in entries.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return self._by_library(texts)
        # The rank library's pattern engine gives up on very long white space.
        return [self._by_library([t])[0] if _LONG_SPACE.search(t) else self.ranks.encode_ordinary(" " + t) for t in texts]

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.source)
            self.tokenizer.encode_special_tokens = True
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Vocabulary B: the bytes of a model file with byte fallback, which puts a blank first itself."""

    def __init__(self, source: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=source)

        def entry(i: int) -> bytes:
            if self.model.is_byte(i):
                return bytes([int(self.model.id_to_piece(i)[3:-1], 16)])
            return self.model.id_to_piece(i).replace("▁", " ").encode()

        self.entries = [entry(i) for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For intervals in the order of their starts: the number of the group of each.

    A group breaks where a start reaches the greatest end so far.
    """
    if not len(start):
        return np.empty(0, np.int64)
    reach = np.maximum.accumulate(end)
    return np.cumsum(np.concatenate([[False], start[1:] >= reach[:-1]]))


def overlaps(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an interval of A and one of B that share a byte; each side ascends and has no gaps inside a text."""
    low = np.searchsorted(end_b, start_a, "right")
    high = np.searchsorted(start_b, end_a, "left")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(start_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + low[a]


class Aligner:
    def __init__(self, source_a: str, source_b: bytes):
        self.a, self.b = ByteLevel(source_a), Pieces(source_b)
        self.width_a = np.array([len(e) for e in self.a.entries], np.int64)
        self.width_b = np.array([len(e) for e in self.b.entries], np.int64)
        # How an id is written before another of its side, and as the last of its side.
        self.written_a = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.width_a))], dtype=object)
        self.written_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.width_b))], dtype=object)

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Per text the columns of :data:`ALIGNED`."""
        texts = [t or "" for t in texts]
        all_a, all_b = [], []
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            whole = b" " + text.encode()
            fits = text and b"".join(map(self.a.entries.__getitem__, a)) == whole == b"".join(map(self.b.entries.__getitem__, b))
            all_a.append(np.array(a if fits else [], np.int64))
            all_b.append(np.array(b if fits else [], np.int64))
        ids_a, ids_b = np.concatenate(all_a), np.concatenate(all_b)
        # Texts lie one after the other on one line of bytes; both sides tile it.
        end_a, end_b = np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b])
        start_a, start_b = end_a - self.width_a[ids_a], end_b - self.width_b[ids_b]
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
        by_start = np.lexsort((side, start))
        group = np.empty(len(start), np.int64)
        group[by_start] = coalesce(start[by_start], end[by_start])
        group_a, group_b = group[:len(ids_a)], group[len(ids_a):]
        link_a, link_b = overlaps(start_a, end_a, start_b, end_b)
        pairs = ids_a[link_a] * PAIR_BASE + ids_b[link_b]
        # Ids in the order of groups, A before B.
        last = lambda g: np.concatenate([g[1:] != g[:-1], [True]]) if len(g) else np.empty(0, bool)
        written = np.concatenate([
            self.written_a[ids_a + len(self.width_a) * last(group_a)], self.written_b[ids_b + len(self.width_b) * last(group_b)]
        ])
        written = written[np.lexsort((start, side, group))]
        cut_a = np.cumsum([0, *map(len, all_a)])
        cut_b = np.cumsum([0, *map(len, all_b)])
        cut_links = np.searchsorted(link_a, cut_a, "left")
        out = {name: [] for name in ALIGNED.names}
        for i in range(len(texts)):
            a0, a1, b0, b1 = cut_a[i], cut_a[i + 1], cut_b[i], cut_b[i + 1]
            distinct, counts = np.unique(pairs[cut_links[i]:cut_links[i + 1]], return_counts=True)
            out["n_a"].append(a1 - a0)
            out["n_b"].append(b1 - b0)
            out["n_groups"].append(group_a[a1 - 1] - group_a[a0] + 1 if a1 > a0 else 0)
            out["n_links"].append(cut_links[i + 1] - cut_links[i])
            listed = "".join(written[a0 + b0:a1 + b1].tolist())[:-1]
            out["groups_sha256"].append(sha256(listed.encode()).hexdigest() if a1 > a0 else "")
            out["groups"].append(listed)
            out["pairs"].append(distinct)
            out["times"].append(counts.astype(np.int32))
        return out


ALIGNED = pa.schema([
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
])


def align_batches(source_a, source_b, made: list[str]):
    """Batches whose last column is a text: it becomes the columns ``made`` of :data:`ALIGNED`.

    The sources are broadcast variables, or objects with the same ``value``.
    """

    def blocks(texts):
        low, held = 0, 0
        for i, text in enumerate(texts):
            size = len(text or "")
            if held and held + size > BLOCK_CHARS:
                yield low, i
                low, held = i, 0
            held += size
        if low < len(texts):
            yield low, len(texts)

    def run(batches):
        aligner = Aligner(source_a.value, source_b.value)
        for batch in batches:
            n = batch.num_columns - 1
            texts = batch.column(n).to_pylist()
            for low, high in blocks(texts):
                found = aligner.align(texts[low:high])
                kept = [batch.column(k).slice(low, high - low) for k in range(n)]
                columns = [pa.array(found[name], ALIGNED.field(name).type) for name in made]
                yield pa.RecordBatch.from_arrays([*kept, *columns], [*batch.schema.names[:n], *made])

    return run
