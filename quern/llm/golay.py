"""The perfect binary Golay code [23, 12, 7]: any 23-bit word is within 3 bits of exactly one of 4096 codewords."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


_OF_MESSAGE = np.array([_remainder(m << CHECKS) for m in range(1 << (LENGTH - CHECKS))], np.uint32)
_ERRORS = np.zeros(1 << CHECKS, np.uint32)
for _n in (1, 2, 3):
    for _bits in combinations(range(LENGTH), _n):
        _e = sum(1 << b for b in _bits)
        _ERRORS[_remainder(_e)] = _e


def decode(words: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each word."""
    words = words.astype(np.uint32)
    syndrome = (words & ((1 << CHECKS) - 1)) ^ _OF_MESSAGE[words >> CHECKS]
    return (words ^ _ERRORS[syndrome]) >> CHECKS


def near(words: np.ndarray, bits: int) -> np.ndarray:
    """For each word the codeword indices of itself and of all words one of its first `bits` bits away, as columns.

    Two words at distance 1 have each other's decoding in their sets; two at distance 2 share that of a word between.
    """
    flips = np.array([0, *(1 << b for b in range(bits))], np.uint32)
    return decode(words.astype(np.uint32)[:, None] ^ flips[None, :])


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row: (row number, value)."""
    rows = np.sort(rows, axis=1)
    first = np.ones(rows.shape, bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    at, column = np.nonzero(first)
    return at, rows[at, column]
