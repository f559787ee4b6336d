"""Byte-pair encoding with word ends, by a queue of merge ranks over a linked list of symbols."""

from __future__ import annotations

import json
import unicodedata
from array import array
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex

# Distinct words whose ids a worker remembers, twice over: those of late, and those before.
REMEMBERED = 1 << 17
# Longer words are encoded each time they occur: remembering them would not be bounded.
REMEMBERED_CHARS = 64

_SPACE = regex.compile(r"\p{White_Space}+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(moved.get(b, b)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file: lower case, white space dropped, word ends marked.

    ``source`` is the file's JSON text.  Files of another make are refused.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]] if spec["normalizer"] else []
        cuts = spec["pre_tokenizer"].get("pretokenizers", [])
        split, letters = cuts if len(cuts) == 2 else ({}, {})
        made_otherwise = (
            model["type"] != "BPE" or split.get("type") != "Split" or steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed"
            or not split["invert"] or letters["type"] != "ByteLevel" or letters["use_regex"] or spec["decoder"]
            or spec["post_processor"] or model["byte_fallback"] or model["unk_token"] or model["ignore_merges"]
        )
        if made_otherwise:
            raise ValueError("not a byte-level BPE file with word ends, as this encoder reads them")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.text_of = {i: t for t, i in vocabulary.items()}
        # Pairs of symbols: rank and what they become.  Ids are below 2^20.
        self.rank, self.made = {}, []
        for rank, (left, right) in enumerate(model["merges"]):
            self.rank[vocabulary[left] << 20 | vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        letter = byte_letters()
        self.inside = [vocabulary.get(c) for c in letter]
        self.last = [vocabulary.get(c + end) for c in letter]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of.update({i: t for t, i in added.items()})
        self.special = added
        longest_first = sorted(added, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.pattern = split["pattern"]["Regex"]
        self.pieces = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}"))
        # Two generations of what is remembered; the older is dropped when the younger is full.
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.older_words, self.older_chunks = {}, {}
        self.library = None

    def merge(self, symbols: list[int]) -> list[int]:
        """Join neighbours, lowest rank first and of equal ranks the leftmost, until no pair has a rank."""
        n = len(symbols)
        rank, made = self.rank, self.made
        # An entry is rank and place in one number; places are below 2^40.
        queue = [r << 40 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place = (1 << 40) - 1
        while queue:
            entry = heappop(queue)
            i = entry & place
            symbol = symbols[i]
            if symbol < 0:
                continue  # swallowed by its left neighbour
            j = after[i]
            if j >= n:
                continue
            now, new = rank.get(symbol << 20 | symbols[j]), made[entry >> 40]
            if now is None or made[now] != new:
                continue  # stale: one of the two has changed since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(new << 20 | symbols[k])
                if r is not None:
                    heappush(queue, r << 40 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] << 20 | new)
                if r is not None:
                    heappush(queue, r << 40 | h)
        return [s for s in symbols if s >= 0]

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of the splitting pattern, in lower case."""
        found = self.words.get(piece)
        if found is not None:
            return found
        found = self.older_words.get(piece)
        if found is None:
            raw = piece.encode()
            symbols = [self.inside[b] for b in raw[:-1]]
            symbols.append(self.last[raw[-1]])
            found = tuple(self.merge([s for s in symbols if s is not None]))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.words) >= REMEMBERED:
                self.older_words, self.words = self.words, {}
            self.words[piece] = found
        return found

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of text without white space."""
        found = self.older_chunks.get(chunk)
        if found is None:
            pieces = [chunk.lower()] if chunk.isalpha() and chunk.isascii() else self.cut(chunk)
            found = self.word(pieces[0]) if len(pieces) == 1 else tuple(i for piece in pieces for i in self.word(piece))
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self.chunks) >= REMEMBERED:
                self.older_chunks, self.chunks = self.chunks, {}
            self.chunks[chunk] = found
        return found

    def cut(self, chunk: str) -> list[str]:
        """The pieces of the splitting pattern, in lower case.

        Text with characters that Python's Unicode tables do not know is cut by the library
        itself, whose tables are of another version.
        """
        if chunk.isascii():
            return self.pieces.findall(chunk.lower())
        text = unicodedata.normalize("NFC", chunk)
        if any(unicodedata.category(c) == "Cn" for c in text):
            if self.library is None:
                from tokenizers import Regex, normalizers, pre_tokenizers

                self.library = normalizers.Lowercase(), pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
            lower, split = self.library
            return [piece for piece, _ in split.pre_tokenize_str(lower.normalize_str(text))]
        return self.pieces.findall(text.replace("Σ", "σ").lower())  # no final sigma, as in the library

    def encode(self, text: str) -> array:
        """Ids of a whole text; the strings of added tokens are those tokens."""
        ids = array("I")
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                continue
            # Python's own split also cuts at four control characters that are no white space here.
            known = self.chunks
            for chunk in _SPACE.split(part) if _SEPARATORS.search(part) else part.split():
                found = known.get(chunk)
                ids.extend(self.chunk(chunk) if found is None else found)
        return ids

    def decode(self, ids) -> str:
        """The vocabulary's strings of ``ids``, a blank between two."""
        return " ".join(map(self.text_of.__getitem__, ids))


def _with(batch, n_kept: int, **columns) -> pa.RecordBatch:
    names = [*batch.schema.names[:n_kept], *columns]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_kept)), *columns.values()], names)


def encode_batches(source: str):
    """Batches whose last column is a text: it becomes ``ids array<int>``."""

    def run(batches):
        bpe = WordBpe(source)
        for batch in batches:
            n = batch.num_columns - 1
            yield _with(batch, n, ids=pa.array([bpe.encode(t.as_py() or "") for t in batch.column(n)], pa.list_(pa.int32())))

    return run


def decode_batches(source: str, made: str):
    """Batches whose last column is ``ids``: it becomes a text named ``made``."""

    def run(batches):
        bpe = WordBpe(source)
        for batch in batches:
            n = batch.num_columns - 1
            yield _with(batch, n, **{made: pa.array([bpe.decode(i.as_py() or ()) for i in batch.column(n)], pa.string())})

    return run


def digest_batches(source: str):
    """Batches whose last column is a text: it is encoded, its ids are decoded, and both are digested."""

    def run(batches):
        bpe = WordBpe(source)

        for batch in batches:
            n, counts, of_ids, of_text = batch.num_columns - 1, [], [], []
            for text in batch.column(n):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                of_text.append(sha256(bpe.decode(ids).encode()).hexdigest())
            yield _with(batch, n, n_tokens=pa.array(counts, pa.int64()), ids_sha256=pa.array(of_ids, pa.string()), decoded_sha256=pa.array(of_text, pa.string()))

    return run
