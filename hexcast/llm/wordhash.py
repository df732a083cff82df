"""Hashes of the words and word shingles of many texts at once, as array operations.

Words are runs of characters other than white space, lower-cased. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TOP = 0x3001
_WHITE = np.array([chr(c).isspace() for c in range(_TOP)] + [False])
_NO_WORD = np.array([not chr(c).isalnum() for c in range(_TOP)] + [False])
GROUP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            out = np.full(2 * n, self.base, np.uint64)
            out[0] = 1
            self.table = np.multiply.accumulate(out)
        return self.table[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)
_FIRST, _SECOND = _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


def pieces(texts: list[str], size: int = GROUP) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of (pieces, owners) of about size characters; long texts are cut at blanks."""
    held, owners, n = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > size and (cut := text.find(" ", at + size)) != -1:
                end = cut
            held.append(text[at:end])
            owners.append(k)
            n += end - at
            at = end
            if n >= size:
                yield held, owners
                held, owners, n = [], [], 0
    if held:
        yield held, owners


def slices(batches, column: str = "text", chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The batches' rows in slices of about this many characters, so that arrays per word stay small."""
    for batch in batches:
        if len(batch):
            group = np.cumsum(batch[column].str.len().to_numpy()) // chars
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.iloc[a:b]


def word_spans(joined: str, gaps: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, past the last, hash) of each word of a text; gaps marks the characters between words."""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ink = ~gaps[np.minimum(code, _TOP)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ink, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * _UP.upto(len(code)), out=total[1:])
    down = _DOWN.upto(len(code) + 1)
    return first, last, mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def word_hashes(texts: list[str], letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes in order, and the number of words of each text.

    With letters_only, words are runs of letters and digits, and punctuation is left out.
    """
    counts, out = np.zeros(len(texts), np.int64), []
    for held, owners in pieces([t.lower() for t in texts]):
        first, _, hashed = word_spans("\n".join(held), _NO_WORD if letters_only else _WHITE)
        ends = np.cumsum([len(p) + 1 for p in held])
        owner = np.searchsorted(ends, first, "right")
        np.add.at(counts, owners, np.bincount(owner, minlength=len(held)))
        out.append(hashed)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def sequence_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's whole word sequence."""
    start = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(start, counts)
    most = int(counts.max(initial=0))
    out = []
    for powers in (_FIRST, _SECOND):
        total = np.zeros(len(words) + 1, np.uint64)
        if len(words):
            np.cumsum(words * powers.upto(most)[place], out=total[1:])
        out.append(mix(total[start + counts] - total[start] + counts.astype(np.uint64)))
    return out[0], out[1]


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words, and their number for each text.

    A text with fewer words has one shingle of all of them; a text without words has none.
    """
    start = np.cumsum(counts) - counts
    n = len(words)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        odd = np.uint64(((_BASE * (2 * k + 1)) | 1) & (2**64 - 1))
        part = words * odd
        part ^= part >> np.uint64(32)
        if n > k:
            total[: n - k] += part[k:] * odd
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    long = np.repeat(counts >= size, counts)
    place = np.arange(n) - np.repeat(start, counts)
    keep = long & (place < np.repeat(counts - size + 1, counts))
    short = np.flatnonzero((counts > 0) & (counts < size))
    keep[start[short]] = True
    if len(short):
        whole = sequence_hashes(words, counts)[0]
        total[start[short]] = whole[short]
    return mix(total[keep]), number
