"""Simple-8b word-aligned coding of non-negative integers, vectorised over blocks."""

from __future__ import annotations

import numpy as np

# fixed values of the code: values per 64-bit word for each selector, and bits per value
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
_PAD = 60


def _padded(n: int) -> np.ndarray:
    """Index of each of n values in the padded layout of blocks."""
    k = np.arange(n)
    return k + (k // BLOCK) * _PAD


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): offsets[b] is the first word of block b of 1024 values.

    A word has its selector in the top four bits and as many of the next values as fit; a word never
    crosses a block's end, where missing values are written as 0.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    wide = np.zeros(blocks * (BLOCK + _PAD), np.uint64)
    wide[_padded(n)] = values
    select = np.full(len(wide), len(BITS) - 1, np.uint8)
    for s in range(len(BITS) - 2, -1, -1):
        fits = wide < np.uint64(1 << int(BITS[s]))
        run, width = fits, 1
        while width < COUNTS[s]:
            step = min(width, int(COUNTS[s]) - width)
            run = run & np.concatenate([run[step:], np.ones(step, bool)])
            width += step
        select[run] = s
    at = np.arange(blocks) * (BLOCK + _PAD)
    stop = at + BLOCK
    stop[-1] = at[-1] + n - (blocks - 1) * BLOCK
    order, places = [], []
    live = np.arange(blocks)
    while len(live):
        places.append(at[live])
        order.append(live)
        at[live] += COUNTS[select[at[live]]]
        live = live[at[live] < stop[live]]
    places, order = np.concatenate(places), np.concatenate(order)
    places = np.sort(places)
    words = np.zeros(len(places), np.uint64)
    chosen = select[places]
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        for k in range(int(COUNTS[s])):
            words[here] |= wide[places[here] + k] << np.uint64(k * int(BITS[s]))
        words[here] |= np.uint64(int(s) << 60)
    per_block = np.bincount(order, minlength=blocks)
    return words, np.cumsum(per_block) - per_block


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of pack(). Blocks are independent; all words of a selector are read at once."""
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    done = np.cumsum(counts) - counts
    per_block = np.diff(np.append(offsets, len(words)))
    block = np.repeat(np.arange(len(offsets)), per_block)
    places = done - done[offsets][block] + block * (BLOCK + _PAD)
    wide = np.zeros(len(offsets) * (BLOCK + _PAD), np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            wide[places[here] + k] = (words[here] >> np.uint64(k * int(BITS[s]))) & mask
    return wide[_padded(n)]


def pack_ids(ids: np.ndarray) -> dict:
    """Pack token ids as frequency ranks; ids seen only once are escapes.

    book holds the ids by falling frequency (ties: ascending), rank r is coded as r + 1, and code 0 is
    an escape whose id is the next one in escapes.
    """
    known, inverse, n = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((known, -n))
    order = order[n[order] > 1]
    code_of = np.zeros(len(known), np.uint64)
    code_of[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
    codes = code_of[inverse]
    words, offsets = pack(codes)
    return {
        "n_ids": len(ids),
        "book": known[order].astype("<u4").tobytes(),
        "escapes": ids[codes == 0].astype("<u4").tobytes(),
        "offsets": offsets.astype("<u4").tobytes(),
        "words": words.astype("<u8").tobytes(),
    }


def unpack_ids(n_ids: int, book: bytes, escapes: bytes, offsets: bytes, words: bytes) -> np.ndarray:
    codes = unpack(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4").astype(np.int64), n_ids)
    table = np.concatenate([np.zeros(1, np.uint32), np.frombuffer(book, "<u4")])
    ids = table[codes.astype(np.int64)]
    ids[codes == 0] = np.frombuffer(escapes, "<u4")
    return ids
