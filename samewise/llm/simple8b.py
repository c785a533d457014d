"""Simple-8b word-aligned coding of unsigned integers, vectorised both ways.

A 64-bit word holds a selector in its four top bits and, from the lowest bit on, as many values of one
width as 60 bits hold. Selector 0 stands for 240 zeros; selector 1 is an escape: the whole next word is
one value of over 60 bits. Values are coded in blocks of 256 that start at a word of their own, so blocks
are packed side by side, and any of them can be decoded alone from its word offset.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
ZEROS, ESCAPE = 0, 1
ZERO_RUN = 240
#: Fixed by the coding: values a word holds and their width in bits, for selectors 2 to 15.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PER_WORD = np.concatenate([[ZERO_RUN, 1], COUNTS])


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and, last, of the end). No values: no words."""
    v = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(v) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = len(v) - BLOCK * (blocks - 1)
    flat = np.zeros((blocks, BLOCK + ZERO_RUN), np.uint64)  # zeros after a block fit any word
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[: len(v)] = v
    flat[:, :BLOCK] = padded.reshape(blocks, BLOCK)

    bits = np.zeros(flat.shape, np.uint8)
    bits[:, :BLOCK] = np.frexp(flat[:, :BLOCK].astype(np.float64))[1]
    spans = {1: bits}
    for k in (2, 4, 8, 16, 32, 64, 128):  # the most bits of any of the next k values
        half = spans[k // 2]
        wide = half.copy()
        np.maximum(half[:, : -(k // 2)], half[:, k // 2 :], out=wide[:, : -(k // 2)])
        spans[k] = wide

    def most(n: int) -> np.ndarray:
        k = 1 << (n.bit_length() - 1)
        return np.maximum(spans[k][:, :BLOCK], spans[k][:, n - k : n - k + BLOCK])

    pick = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        pick[most(int(COUNTS[s])) <= WIDTHS[s]] = s + 2
    pick[most(ZERO_RUN) == 0] = ZEROS

    at, rows, starts, chosen, steps = np.zeros(blocks, np.int64), [], [], [], []
    live = np.arange(blocks)
    step = 0
    while len(live):  # one word of every block that has values left
        s = pick[live, at[live]]
        rows.append(live)
        starts.append(at[live])
        chosen.append(s)
        steps.append(np.full(len(live), step))
        at[live] += _PER_WORD[s]
        live = live[at[live] < lengths[live]]
        step += 1
    row, start, sel = np.concatenate(rows), np.concatenate(starts), np.concatenate(chosen)
    order = np.lexsort((np.concatenate(steps), row))
    row, start, sel = row[order], start[order], sel[order]
    takes = 1 + (sel == ESCAPE)
    place = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(sel == s + 2)
        for j in range(COUNTS[s]):
            words[place[mine]] |= flat[row[mine], start[mine] + j] << np.uint64(j * WIDTHS[s])
    far = np.flatnonzero(sel == ESCAPE)
    words[place[far] + 1] = flat[row[far], start[far]]
    per_block = np.bincount(row, takes, blocks).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of ``encode``'s result."""
    if not n:
        return np.empty(0, np.uint64)
    words = np.ascontiguousarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):  # a word after an escape has no selector
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    sel = sel[heads]
    block = np.searchsorted(offsets, heads, "right") - 1
    count = _PER_WORD[sel]
    before = np.cumsum(count) - count
    first = np.searchsorted(heads, offsets[:-1])
    inside = before - before[first][block]
    size = np.full(len(offsets) - 1, BLOCK)
    size[-1] = n - BLOCK * (len(size) - 1)
    count = np.minimum(count, size[block] - inside)
    to = block * BLOCK + inside
    out = np.zeros(n, np.uint64)
    for s in range(len(COUNTS)):
        mine = np.flatnonzero(sel == s + 2)
        if len(mine):
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(COUNTS[s]):
                some = mine if j == 0 else mine[count[mine] > j]
                out[to[some] + j] = (words[heads[some]] >> np.uint64(j * WIDTHS[s])) & mask
    far = np.flatnonzero(sel == ESCAPE)
    out[to[far]] = words[heads[far] + 1]
    return out
