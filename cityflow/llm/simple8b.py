"""Simple-8b coding of non-negative integers in 64-bit words, in numpy.

A word has a 4-bit selector and 60 bits of payload: ``SLOTS[selector]`` values of equal width.
Selector 15 stands for 120 zeros, selector 0 is an escape: its payload is the place of a value of
more than 60 bits in a list kept behind the words. Values come in blocks of ``BLOCK``; a word
never crosses a block, so blocks are decoded independently from their word offsets.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Fixed values of the format: how many values a word of each selector holds.
SLOTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120])
WIDTH = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
PAD = int(SLOTS.max())


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, or one more where a value of over 53 bits rounds up."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _selectors(width: np.ndarray) -> np.ndarray:
    """For each place of each (padded) block, the selector of a word that would begin there."""
    n = width.shape[1] - PAD
    most = {1: width}

    def reach(c: int) -> np.ndarray:
        """The largest width among c values from each place on."""
        if c not in most:
            half = max(k for k in most if k < c)
            half = half if 2 * half >= c else (reach((c + 1) // 2), (c + 1) // 2)[1]
            a = most[half]
            b = np.zeros_like(a)
            b[:, : a.shape[1] - (c - half)] = a[:, c - half :]
            most[c] = np.maximum(a, b)
        return most[c]

    chosen = np.zeros((width.shape[0], n), np.uint8)
    for selector in sorted(range(1, 16), key=lambda s: SLOTS[s]):
        fits = reach(int(SLOTS[selector]))[:, :n] <= WIDTH[selector]
        np.copyto(chosen, np.uint8(selector), where=fits)
    return chosen


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, escaped values) of an array of unsigned integers."""
    values = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + PAD), np.uint64)
    filled = np.zeros(blocks * BLOCK, np.uint64)
    filled[:n] = values
    grid[:, :BLOCK] = filled.reshape(blocks, BLOCK)
    chosen = _selectors(_bits(grid))
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    begins, lane, at = np.zeros((blocks, BLOCK), bool), np.arange(blocks), np.zeros(blocks, np.int64)
    while len(lane):  # all blocks step from word to word together
        begins[lane, at] = True
        at = at + SLOTS[chosen[lane, at]]
        going = at < size[lane]
        lane, at = lane[going], at[going]
    row, col = np.nonzero(begins)
    selector, place, flat = chosen[row, col], row * grid.shape[1] + col, grid.reshape(-1)
    words = selector.astype(np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            words[own] |= np.arange(len(own), dtype=np.uint64) << np.uint64(4)
        elif WIDTH[s]:
            held, at = words[own], place[own]
            for j in range(SLOTS[s]):
                held |= flat[at + j] << np.uint64(4 + j * WIDTH[s])
            words[own] = held
    escaped = flat[place[selector == 0]]
    offsets = np.searchsorted(row, np.arange(blocks)).astype(np.uint32)
    return words, offsets, escaped


def decode(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n values; every word is placed on its own, from its block's offset."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words & np.uint64(15)).astype(np.int64)
    ends = np.cumsum(SLOTS[selector])
    before = ends - SLOTS[selector]
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets.astype(np.int64), len(words))))
    place = before - before[offsets.astype(np.int64)][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            out[place[own]] = escaped[(words[own] >> np.uint64(4)).astype(np.int64)]
        elif WIDTH[s]:
            mask, held, to, end = np.uint64((1 << int(WIDTH[s])) - 1), words[own], place[own], limit[own]
            for j in range(SLOTS[s]):
                inside = to + j < end  # all but the last word of a block
                value = (held >> np.uint64(4 + j * WIDTH[s])) & mask
                out[(to + j)[inside]] = value[inside]
    return out
