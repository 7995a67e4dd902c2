"""Elias-Fano lists of ascending numbers: the low bits of each packed, the high ones in unary.

A list of ``n`` numbers up to ``most`` takes about ``n * (2 + log2(most / n))`` bits, and any one of them
is found without unpacking the others.
"""

from __future__ import annotations

import numpy as np

#: Bits set in each byte.
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def low_bits(n: int, most: int) -> int:
    """How many bits of each number are packed as they are."""
    return max(0, (most // n).bit_length() - 1) if n else 0


def encode(numbers: np.ndarray, most: int) -> bytes:
    """The list of ``numbers``, ascending and at most ``most``: low bits first, then the unary part from the next byte on."""
    n = len(numbers)
    if not n:
        return b""
    numbers = np.asarray(numbers, np.int64)
    width = low_bits(n, most)
    low = ((numbers[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    unary = np.zeros(n + (most >> width) + 1, np.uint8)
    unary[(numbers >> width) + np.arange(n)] = 1
    return np.packbits(low.ravel(), bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()


def select(listed: bytes, n: int, most: int, place: int) -> int:
    """The number at ``place`` (from 0) of an encoded list."""
    if not 0 <= place < n:
        raise IndexError(place)
    width = low_bits(n, most)
    begin = (n * width + 7) // 8
    raw = np.frombuffer(listed, np.uint8)
    upto = np.cumsum(_SET[raw[begin:]])
    byte = int(np.searchsorted(upto, place + 1))
    missing = place - (int(upto[byte - 1]) if byte else 0)
    bits = int(raw[begin + byte])
    for _ in range(missing):
        bits &= bits - 1
    high = 8 * byte + (bits & -bits).bit_length() - 1 - place
    first, last = place * width, (place + 1) * width
    low = int.from_bytes(listed[first // 8 : (last + 7) // 8], "little") >> first % 8 & (1 << width) - 1
    return high << width | low
