"""Byte-level BPE's pre-split of texts into words, vectorised, and a bounded memory of words' ids.

The split is that of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
found left to right: runs of letters, of numbers, of white space and of all else, where one space
joins the run after it, and an apostrophe on its own takes a contraction's letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_OTHER, _LETTER, _NUMBER, _SPACE, _SPECIAL = range(5)
#: The white space of the pattern's \s: fixed values.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16, which Python's tables may not have yet: fixed values.
_LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """The kind of every code point."""
    global _kinds
    if _kinds is None:
        first = np.fromiter((b"LN".find(unicodedata.category(chr(c))[0].encode()) + 1 for c in range(0x110000)), np.uint8, 0x110000)
        for ranges, kind in ((_LETTERS_16, _LETTER), (_NUMBERS_16, _NUMBER)):
            for a, b in ranges:
                first[a : b + 1] = kind
        first[_WHITE] = _SPACE
        _kinds = first
    return _kinds


def split(buf: np.ndarray, offsets: np.ndarray, specials: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the words of all texts, and the words of each text as n + 1 offsets.  Words
    tile their text.  A special token's string is a word of its own, and texts end around it."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    whole = buf.tobytes().decode("utf-8", "surrogatepass")
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    kind = kinds()[c]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, offsets)] = True
    edge[n] = True
    for special in specials:
        at = whole.find(special)
        while at >= 0:
            end = at + len(special)
            if not edge[at + 1 : end].any():  # not across two texts
                kind = kind.copy() if not kind.flags.owndata else kind
                kind[at:end] = _SPECIAL
                edge[[at, end]] = True
            at = whole.find(special, end)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]) | edge[:-1])
    end = np.append(start[1:], n)
    k, alone = kind[start], edge[start]  # alone: nothing of the same text stands before
    cut = np.zeros(n + 1, bool)
    cut[start] = True
    joins = (k != _SPACE) & (k != _SPECIAL) & ~alone
    s = start[joins]
    s = s[c[s - 1] == 0x20]
    cut[s], cut[s - 1] = False, True
    space = (k == _SPACE) & ~edge[end]
    cut[end[space] - 1] = True
    one = (k == _OTHER) & (end - start == 1) & (c[start] == 0x27) & cut[start] & ~edge[end]
    one[-1:] = False
    one[:-1] &= k[1:] == _LETTER
    i = np.flatnonzero(one)
    if len(i):
        a, stop = start[i] + 1, end[i + 1]
        x, y = c[a], c[np.minimum(a + 1, n - 1)]
        is_one = np.isin(x, [ord(ch) for ch in "stmd"])
        is_two = (a + 1 < stop) & (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
        took = np.where(is_one, 1, np.where(is_two, 2, 0))
        a, stop, took = a[took > 0], stop[took > 0], took[took > 0]
        cut[a] = False
        inside = a + took < stop
        cut[(a + took)[inside]] = True
    at = lead[np.flatnonzero(cut[:n])]
    return at, np.searchsorted(at, offsets)


class WordIds:
    """Ids of texts: each distinct word is encoded once while it is remembered.

    encode gets a list of words as bytes and returns their ids one after another and the number of
    ids of each.  Words are told apart by their bytes.  After `most` words the older half of the
    memory goes."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], specials: tuple[str, ...] = (), most: int = 500_000):
        self.encode, self.specials, self.most = encode, specials, most
        self.index: dict[bytes, int] = {}
        self.start, self.flat, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _forget(self) -> None:
        half = len(self.index) // 2
        at = int(self.start[half])
        self.index = {w: i - half for w, i in self.index.items() if i >= half}
        self.start = self.start[half:] - at
        self.flat = self.flat[at : self.used].copy()
        self.used = len(self.flat)

    def _learn(self, words: list[bytes]) -> None:
        ids, sizes = self.encode(words)
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need, 1 << 16), np.uint32)])
        self.flat[self.used : need] = ids
        base = len(self.start) - 1
        self.index.update(zip(words, range(base, base + len(words)), strict=True))
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes)])
        self.used = need

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and n + 1 offsets into them."""
        at, first = split(buf, offsets, self.specials)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(at, len(buf))
        wide = len(buf) >= 1 << 31
        words = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(at), [None, pa.py_buffer(ends if wide else ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.index) > self.most:
            self._forget()
        new = [w for w in distinct if w not in self.index]
        if new:
            self._learn(new)
        entry = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        a = self.start[entry]
        size = self.start[entry + 1] - a
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(a - total[:-1], size)]
        return ids, total[first]
