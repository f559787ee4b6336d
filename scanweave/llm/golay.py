"""The perfect binary Golay code [23, 12, 7], used as a fuzzy hash of bit segments.

Every 23-bit word is within distance 3 of exactly one codeword.  A word's keys are all
codewords within distance 4: one if the nearest is at distance 2 or less, six if it is at
distance 3.  If two words differ in at most one bit, the nearest codeword of the one is
within distance 4 of the other, so they share a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

# Fixed value: the generator polynomial, highest power first.
GENERATOR = 0b101011100011
LENGTH, DATA_BITS = 23, 12
CHECK_BITS = LENGTH - DATA_BITS
MOST_KEYS = 6


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words, as polynomials, by the generator."""
    rest = words.astype(np.int64)
    for power in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where((rest >> power) & 1 == 1, rest ^ (GENERATOR << (power - CHECK_BITS)), rest)
    return rest


def error_patterns() -> np.ndarray:
    """By syndrome, the patterns of weight 4 or less that have it; -1 where there are fewer than six."""
    patterns = [0]
    for weight in range(1, 5):
        patterns += [sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)]
    patterns = np.array(patterns, dtype=np.int64)
    of = syndromes(patterns)
    table = np.full((1 << CHECK_BITS, MOST_KEYS), -1, dtype=np.int64)
    filled = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    for pattern, syndrome in zip(patterns.tolist(), of.tolist()):
        # Weight 4 beside weight 2 or less cannot share a syndrome: codewords differ in 7 bits.
        table[syndrome, filled[syndrome]] = pattern
        filled[syndrome] += 1
    return table


def segment_keys(bits: int) -> np.ndarray:
    """By value of a segment of up to 23 bits, the numbers of its codewords, -1 for none."""
    words = np.arange(1 << bits, dtype=np.int64)
    errors = error_patterns()[syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS).astype(np.int32)
