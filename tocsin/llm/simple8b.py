"""Simple-8b coding of ids: a selector in the top four bits of a 64-bit word says how many ids share its other sixty.

Ids are cut into blocks of BLOCK; every block begins a new word, so blocks decode on their own and a table of block
offsets gives each one's place. An id of sixty bits or more is escaped: a word of selector ESCAPE, then the id itself.
Both directions work on all blocks at once, one array operation per step, not one per id.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Ids in a word and bits of each, for selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
#: So many ids are the union of two runs of the first number, the second one that far on.
HALVES = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (3, 2), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30)}
U = np.uint64
#: By an id's bits, the index in BITS of the narrowest field that holds it; 14: escape. The same by the id, where it is small.
WIDTH = np.searchsorted(BITS, np.arange(66)).astype(np.uint8)
NEED = WIDTH[np.frexp(np.arange(1 << 16, dtype=np.float64))[1]]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the offset among them of each block (one more at the end)."""
    ids = np.asarray(ids)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, U), np.zeros(1, np.uint64)
    top = int(ids.max())
    wide = BLOCK + COUNTS[0]  # zeros after a block's end fit any width
    grid = np.zeros((blocks, wide), U if top >> 32 else np.uint32)
    flat = np.zeros(blocks * BLOCK, grid.dtype)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    if top < len(NEED):
        need = NEED[grid]
    else:  # the exponent may be one too large for ids of over 53 bits, which costs a bit and loses nothing
        need = WIDTH[np.frexp(grid.astype(np.float64))[1]]
    grid = grid.ravel()
    widest = {1: need}  # by count: the most that the next so many ids need
    selector = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in range(len(COUNTS), 0, -1):  # from one id a word to sixty; what fits one selector fits all after it
        count = COUNTS[s - 1]
        if count > 1:
            of, by = HALVES[count]
            x = widest[of]
            widest[count] = y = x.copy()
            np.maximum(x[:, :-by], x[:, by:], out=y[:, :-by])
        fits = widest[count][:, :BLOCK] < s
        if not fits.any():
            break
        selector -= fits
    step = np.array([0, *COUNTS, 1], np.int64)[selector]
    size = np.full(blocks, BLOCK, np.int64)
    size[-1] = n - (blocks - 1) * BLOCK
    lanes, at, rows, cols, turns = np.arange(blocks), np.zeros(blocks, np.int64), [], [], []
    while len(lanes):  # one word of every unfinished block
        rows.append(lanes)
        cols.append(at)
        turns.append(np.full(len(lanes), len(turns)))
        at = at + step[lanes, at]
        left = at < size[lanes]
        lanes, at = lanes[left], at[left]
    row, col = np.concatenate(rows), np.concatenate(cols)
    ends = np.cumsum(np.bincount(row, minlength=blocks))
    order = np.empty(len(row), np.int64)
    order[np.concatenate([[0], ends[:-1]])[row] + np.concatenate(turns)] = np.arange(len(row))
    row, col = row[order], col[order]
    s = selector[row, col]
    width = 1 + (s == ESCAPE)
    place = np.concatenate([[0], np.cumsum(width)])
    words = np.zeros(place[-1], U)
    cell = row * wide + col
    for k in np.flatnonzero(np.bincount(s)):
        of = np.flatnonzero(s == k)
        at, word = cell[of], np.full(len(of), int(k) << 60, U)
        if k == ESCAPE:
            words[place[of] + 1] = grid[at]
        else:
            for i in range(COUNTS[k - 1]):
                word |= grid[at + i].astype(U) << U(i * BITS[k - 1])
        words[place[of]] = word
    first = np.concatenate([np.flatnonzero(np.diff(row, prepend=-1)), [len(row)]])
    return words, place[first].astype(np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encode()'s words and block offsets."""
    out = np.zeros(n, U)
    if not n:
        return out
    words = np.asarray(words, U)
    head = np.ones(len(words), bool)
    s = (words >> U(60)).astype(np.uint8)
    if (s == ESCAPE).any():  # the word after an escape is an id; a run of such words alternates
        for i in np.flatnonzero(s == ESCAPE):
            if head[i]:
                head[i + 1] = False
    at = np.flatnonzero(head)
    s = s[at]
    count = np.array([0, *COUNTS, 1], np.int64)[s]
    block = np.searchsorted(np.asarray(offsets, np.int64), at, side="right") - 1
    run = np.cumsum(count) - count
    first = np.flatnonzero(np.diff(block, prepend=-1))
    start = run - np.repeat(run[first], np.diff([*first, len(at)])) + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for k in np.unique(s):
        of = np.flatnonzero(s == k)
        if k == ESCAPE:
            out[start[of]] = words[at[of] + 1]
            continue
        w, bits = words[at[of]], BITS[k - 1]
        for i in range(COUNTS[k - 1]):
            to = start[of] + i
            there = to < end[of]
            out[to[there]] = ((w >> U(i * bits)) & U((1 << bits) - 1))[there]
    return out
