"""Whole-text token ids from public tokenizer files, with a cache of pre-tokens.

A text is cut into the pre-tokens of the tokenizer's own pattern with array operations over code
points, pre-tokens are looked up by a 64-bit hash, and only unseen ones go to the tokenizers library.
Texts that hold apostrophes, control characters, code points from U+0250 on or the name of a special token go
to the library whole and unchanged. Only files with one of the two layouts in LAYOUTS are accepted.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

# fixed values: classes of code points in the tokenizers' patterns
LETTER, NUMBER, OTHER, BLANK, SPACE, RARE, END = range(7)
_TOP = 0x250
_WHITE = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0}


def _code_class(c: int) -> int:
    if c == 0x20:
        return BLANK
    if c in _WHITE:
        return SPACE
    kind = unicodedata.category(chr(c))
    if c == 0x27 or kind in ("Cc", "Cn"):
        return RARE
    return {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)


# fixed values: the settings of the two kinds of tokenizer file whose pre-tokens are cut here
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
LAYOUTS = {
    "byte": (None, {**_BYTES, "use_regex": True}, None),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {**_BYTES, "use_regex": False}]},
        "</w>",
    ),
}
CLASSES = np.array([_code_class(c) for c in range(_TOP)] + [RARE], np.uint8)
#: the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_SIGNS = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_MIX = np.random.default_rng(17).integers(1, 2**63, _TOP + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def special_names(path: str, kind: str) -> list[str]:
    """The special tokens of a tokenizer file; ValueError unless the file has the layout of this kind."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = found["model"]
    layout = (found.get("normalizer"), found.get("pre_tokenizer"), model.get("end_of_word_suffix"))
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    added = found.get("added_tokens", [])
    bare = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    if kind not in LAYOUTS or layout != LAYOUTS[kind] or model["type"] != "BPE" or not plain or not bare:
        raise ValueError(f"{path} is not a tokenizer file of the kind {kind!r}")
    return [t["content"] for t in added]


class TokenIds:
    """Token ids of texts, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    kind: "byte" (byte-level pattern) or "word" (lower-cased words). With special_as_text the names of special
    tokens in a text are ordinary text (the library's encode_special_tokens, as these files are documented);
    without it they become the special ids.
    """

    GROUP = 1 << 18  # characters handled at a time
    SLOTS = 21  # log2 of the cache's hash slots
    ENTRIES = 600_000  # pre-tokens kept before the cache starts anew

    def __init__(self, path: str, kind: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.special = special_names(path, kind)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.model = self.library.model
        self.kind = kind
        self._grow(self.GROUP + 1)
        self._forget()

    def _grow(self, n: int) -> None:
        self.up, self.down = powers(_BASE, n), powers(_INVERSE, n)

    def _forget(self) -> None:
        self.keys = np.zeros(1 << self.SLOTS, np.uint64)
        self.entry = np.zeros(1 << self.SLOTS, np.int32)
        self.start = np.zeros(self.ENTRIES, np.int64)
        self.length = np.zeros(self.ENTRIES, np.int64)
        self.ids = np.zeros(4 * self.ENTRIES, np.uint32)
        self.n_entries = self.n_ids = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order (uint32), and the number of ids of each text."""
        counts, out = np.zeros(len(texts), np.int64), []
        pieces: list[str] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if pieces:
                ids, n = self._group(pieces)
                out.append(ids)
                np.add.at(counts, owners, n)
            pieces.clear()
            owners.clear()
            held = 0

        for k, text in enumerate(texts):
            if any(name in text for name in self.special):
                flush()
                own = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                out.append(own)
                counts[k] = len(own)
                continue
            at = 0
            while at < len(text):
                end = self._cut(text, at)
                pieces.append(text[at:end])
                owners.append(k)
                held += end - at
                at = end
                if held >= self.GROUP:
                    flush()
        flush()
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts

    def _cut(self, text: str, at: int) -> int:
        """Where a long text may be cut: before a blank between two other characters."""
        if len(text) - at <= self.GROUP:
            return len(text)
        end = text.find(" ", at + self.GROUP)
        while end != -1 and (end + 1 >= len(text) or text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.find(" ", end + 1)
        return len(text) if end == -1 else end

    def _group(self, whole: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [p.lower() for p in whole] if self.kind == "word" else whole
        joined = "\0".join(pieces) + "\0"
        code = np.minimum(np.frombuffer(joined.encode("utf-32-le"), np.uint32), _TOP)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1) - 1
        kinds = CLASSES[code]
        kinds[ends] = END
        if (kinds == RARE).any():
            return self._with_rare(whole, kinds, ends)
        first, last = self._spans(kinds)
        if len(code) >= len(self.up):
            self._grow(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_MIX[code] * self.up[: len(code)], out=total[1:])
        hashed = (total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64)
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        hashed |= np.uint64(1)  # never the empty key
        entry = self._entries(joined, first, last, hashed)
        lengths = self.length[entry]
        stop = np.cumsum(lengths)
        n = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.repeat(self.start[entry] - stop + lengths, lengths) + np.arange(n)]
        owner = np.searchsorted(ends, first)
        return ids, np.bincount(owner, lengths, len(pieces)).astype(np.int64)

    def _with_rare(self, pieces, kinds, ends) -> tuple[np.ndarray, np.ndarray]:
        begins = np.concatenate([[0], ends[:-1] + 1])
        rare = np.add.reduceat(kinds == RARE, begins) > 0
        done = {}
        if common := [p for p, x in zip(pieces, rare, strict=True) if not x]:
            ids, n = self._group(common)
            done = dict(zip(np.flatnonzero(~rare).tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True))
        for k in np.flatnonzero(rare).tolist():
            done[k] = np.array(self.library.encode(pieces[k], add_special_tokens=False).ids, np.uint32)
        each = [done[k] for k in range(len(pieces))]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _spans(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last positions of the pre-tokens."""
        before = np.concatenate([[END], kinds[:-1]]).astype(np.uint8)
        white = (kinds == BLANK) | (kinds == SPACE)
        white_before = (before == BLANK) | (before == SPACE)
        if self.kind == "word":
            starts = np.where(white, ~white_before, (kinds != before) | (kinds == NUMBER))
        else:
            ink_after = np.concatenate([~white[1:] & (kinds[1:] != END), [False]])
            # a blank before ink belongs to it; other white space before ink stands alone
            starts = np.where(white, ink_after | ~white_before, (kinds != before) & (before != BLANK))
        starts |= kinds == END
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(kinds))
        keep = kinds[first] != END
        if self.kind == "word":
            keep &= ~white[first]
        return first[keep], last[keep]

    def _entries(self, joined: str, first, last, hashed) -> np.ndarray:
        slot = (hashed >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        entry = self.entry[slot]
        missed = np.flatnonzero(self.keys[slot] != hashed)
        if not len(missed):
            return entry
        new, where, inverse = np.unique(hashed[missed], return_index=True, return_inverse=True)
        at = missed[where]
        words = [joined[a:b] for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)]
        coded = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(BYTE_SIGNS))] for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for x in coded for i in x), np.uint32, int(sizes.sum()))
        if self.n_entries + len(new) > len(self.start) or self.n_ids + len(flat) > len(self.ids):
            if self.n_entries:
                self._forget()
                return self._entries(joined, first, last, hashed)
            self.start, self.length = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
            self.ids = np.zeros(len(flat), np.uint32)
        a, b = self.n_entries, self.n_entries + len(new)
        self.start[a:b] = self.n_ids + np.cumsum(sizes) - sizes
        self.length[a:b] = sizes
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_entries, self.n_ids = b, self.n_ids + len(flat)
        entry[missed] = a + inverse
        self.keys[slot[at]] = new
        self.entry[slot[at]] = np.arange(a, b, dtype=np.int32)
        return entry


_CODERS: dict[tuple, TokenIds] = {}


def token_ids(path: str, kind: str, special_as_text: bool = True) -> TokenIds:
    """The last coder used is kept between the batches and tasks of a Python worker."""
    wanted = (path, kind, special_as_text)
    if wanted not in _CODERS:
        _CODERS.clear()
        _CODERS[wanted] = TokenIds(*wanted)
    return _CODERS[wanted]
