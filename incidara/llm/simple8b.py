"""Simple-8b: word-aligned coding of token ids.

Each 64-bit word has a selector in its top four bits; the other 60 hold as many ids as the selector
says, low bits first.  Selector 0 is the escape: the next word holds one id of over 60 bits.  Ids
are coded in blocks of ``BLOCK``; a block begins with a new word, and the offsets of the blocks'
first words let every block be decoded apart, all of them at once by numpy.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Fixed values of the format: ids in a word by selector; bits of each follow from the 60 there are.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = 60 // COUNTS

_SMALL = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if ids.size and int(ids.max()) < len(_SMALL):
        return _SMALL[ids]
    edges = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.searchsorted(edges, ids.ravel(), side="right").astype(np.uint8).reshape(ids.shape)


def _selectors(widths: np.ndarray) -> np.ndarray:
    """For each place of each block, the selector of the word that would begin there."""
    length = widths.shape[1]
    best = np.zeros(widths.shape, np.uint8)
    peak, span = widths, 1
    for count in sorted(set(COUNTS[1:].tolist())):
        while span < count:  # the greatest width among the next `span` ids, one id further each time
            nxt = peak.copy()
            nxt[:, : length - span] = np.maximum(peak[:, : length - span], widths[:, span:])
            peak, span = nxt, span + 1
        selector = int(np.flatnonzero(COUNTS[1:] == count)[0]) + 1
        fits = peak <= BITS[selector]
        if count > 1 and not fits.any():
            break
        np.putmask(best, fits, selector)
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the offset of each block's first word."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, BLOCK), np.uint64)
    padded.reshape(-1)[:n] = ids
    held = np.full(blocks, BLOCK, np.int64)
    held[-1] = n - (blocks - 1) * BLOCK
    widths = _widths(padded)
    widths.reshape(-1)[n:] = 64  # what fills the last block up is in no word
    selectors = _selectors(widths)
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):  # all blocks go forward together, a word at a time
        here = at[live]
        chosen = selectors[live, here]
        steps.append((live, here, chosen))
        at[live] = here + COUNTS[chosen]
        live = live[at[live] < held[live]]
    block = np.concatenate([s[0] for s in steps])
    order = np.argsort(block, kind="stable")
    block, place, chosen = block[order], np.concatenate([s[1] for s in steps])[order], np.concatenate([s[2] for s in steps])[order]
    room = 1 + (chosen == 0)
    where = np.cumsum(room) - room
    words = np.zeros(int(room.sum()), np.uint64)
    for selector in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == selector)
        if not selector:
            words[where[mine] + 1] = padded[block[mine], place[mine]]
            continue
        bits, value = int(BITS[selector]), np.full(len(mine), selector << 60, np.uint64)
        for k in range(int(COUNTS[selector])):
            column = place[mine] + k
            inside = column < BLOCK
            value[inside] |= padded[block[mine][inside], column[inside]] << np.uint64(k * bits)
        words[where[mine]] = value
    firsts = where[np.searchsorted(block, np.arange(blocks))]
    return words, firsts.astype(np.uint32)


def decode(words: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids again."""
    words = np.asarray(words, np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():  # a raw word follows an escape; raw words are never escapes themselves
        starts = np.zeros(len(words) + 1, bool)
        for at in np.flatnonzero(selector == 0).tolist():
            starts[at + 1] |= not starts[at]
        raw = starts[:-1]
    counts = np.where(raw, 0, COUNTS[selector])
    block = np.zeros(len(words), np.int64)
    block[firsts[1:]] = 1
    block = np.cumsum(block)
    before = np.cumsum(counts) - counts
    inside = before - before[firsts][block]  # place in the block of each word's first id
    held = np.minimum(BLOCK, n - block * BLOCK)
    counts = np.minimum(counts, held - inside)
    counts[raw] = 0
    out = np.zeros(n, np.uint64)
    begin = block * BLOCK + inside
    for s in np.unique(selector[~raw]).tolist():
        mine = np.flatnonzero((selector == s) & ~raw)
        if not s:
            out[begin[mine]] = words[mine + 1]
            continue
        bits = int(BITS[s])
        mask = np.uint64((1 << bits) - 1)
        for k in range(int(COUNTS[s])):
            some = mine[counts[mine] > k]
            out[begin[some] + k] = (words[some] >> np.uint64(k * bits)) & mask
    return out
