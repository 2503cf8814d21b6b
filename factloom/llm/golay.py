"""The binary Golay code [23,12,7] on arrays: nearest-codeword indices, and those of all vectors one bit away."""

from __future__ import annotations

import itertools

import numpy as np

#: The generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 and the code's lengths.
GENERATOR = 0b101011100011
LENGTH, DIMENSION, CHECKS = 23, 12, 11


def _remainder(value: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if value >> bit & 1:
            value ^= GENERATOR << (bit - CHECKS)
    return value


def _tables() -> tuple[np.ndarray, np.ndarray]:
    parity = np.array([_remainder(m << CHECKS) for m in range(1 << DIMENSION)], np.uint32)
    errors = np.zeros(1 << CHECKS, np.uint32)
    for weight in range(1, 4):  # the code is perfect: each syndrome has one error of weight 3 at most
        for bits in itertools.combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            errors[_remainder(error)] = error
    return parity, errors


PARITY, ERRORS = _tables()


def index(vectors: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within distance 3 of each 23-bit vector."""
    vectors = np.asarray(vectors, np.uint32)
    syndrome = (vectors & np.uint32((1 << CHECKS) - 1)) ^ PARITY[vectors >> np.uint32(CHECKS)]
    return (vectors ^ ERRORS[syndrome]) >> np.uint32(CHECKS)


def nearby(vectors: np.ndarray, bits: int = LENGTH) -> np.ndarray:
    """(n, 6) indices of the codewords of each vector and of its neighbours in the lowest `bits` bits; -1 pads.

    Six suffice: vectors next to one at distance 3 from its codeword fall to that codeword or five others.
    """
    vectors = np.asarray(vectors, np.uint32)
    flips = np.array([0, *(1 << b for b in range(bits))], np.uint32)
    found = np.sort(index(vectors[:, None] ^ flips[None, :]).astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]
