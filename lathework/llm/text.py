"""Words and word bags shared by the text operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np

_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\W_]+")
_LETTERS = np.zeros(256, np.uint64)
for _c in range(256):
    if _c > 127 or chr(_c).isalnum():
        _LETTERS[_c] = ord(chr(_c).lower()) if _c < 128 else _c
#: Of the ASCII bytes, letters in lower case and digits stay, all others become blanks.
_ASCII_WORDS = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
#: An odd base and its inverse modulo 2^64: a word's hash is its polynomial in the base, wherever it stands.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits after NFKC and lower-casing; none for null."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_ASCII_WORDS).decode().split()
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def bag_overlap(a: Counter, b: Counter) -> float:
    """Words shared by two bags over the words in either; 0 for two empty bags."""
    if len(a) > len(b):
        a, b = b, a
    shared = sum(min(n, b[w]) for w, n in a.items() if w in b)
    either = sum(a.values()) + sum(b.values()) - shared
    return shared / either if either else 0.0


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def order_in_documents(doc: np.ndarray, h: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """The order by ascending doc, by count if given, and by h, as np.lexsort has it but for equals.

    doc and count: whole numbers from 0. All three are sorted as one number of 64 bits, with as much of h as it holds;
    where that isn't all, ties are sorted once more.
    """
    if not len(doc):
        return np.empty(0, np.int64)
    keys = [doc] if count is None else [doc, count]
    bits = [max(int(x.max()).bit_length(), 1) for x in keys]
    if sum(bits) > 63:
        return np.lexsort((h, *keys[::-1]))
    lead = np.zeros(len(doc), np.uint64)
    for x, b in zip(keys, bits):
        lead = lead << np.uint64(b) | x.astype(np.uint64)
    one = lead << np.uint64(64 - sum(bits)) | h >> np.uint64(sum(bits))
    order = np.argsort(one)
    one, full = one[order], h[order]
    same = one[1:] == one[:-1]
    if (same & (full[1:] != full[:-1])).any():
        tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        order[tied] = order[tied][np.lexsort((full[tied], one[tied]))]
    return order


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _plain(text: str | None) -> bytes:
    if not text:
        return b""
    if text.isascii():
        return text.encode()
    return _GAP.sub(" ", unicodedata.normalize("NFKC", text).lower()).encode()


class Words:
    """The words of a batch of texts as one row of 64-bit hashes, in order.

    hashes: of each word. doc: the position of its text. start: each text's first word, and the end.
    The words are those of words(); only the hashing runs over bytes, for all texts at once.
    """

    def __init__(self, texts: list[str | None], plain=_plain):
        raw = list(map(plain, texts))
        self._data = data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        letter = _LETTERS[data]
        inside = letter > 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        begin, end = self._begin, self._end = edge[0::2], edge[1::2]
        up, down = powers(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter * up[:-1], dtype=np.uint64)])
        self.hashes = mix((total[end] - total[begin]) * down[begin])
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        bound = np.concatenate([[0], np.cumsum(sizes)])
        self.start = np.searchsorted(begin, bound)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.start))
        self._occurrences = None

    def word(self, k: int) -> bytes:
        """The k-th word's letters in lower case."""
        return self._data[self._begin[k] : self._end[k]].tobytes().lower()

    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of the n-th occurrence of each word, sorted: a bag as a set."""
        if self._occurrences is not None:
            return self._occurrences
        order = order_in_documents(self.doc, self.hashes)
        doc, h = self.doc[order], self.hashes[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
        at = np.arange(len(h))
        nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(h) else at
        self._occurrences = doc, mix(h + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return self._occurrences

    def bags(self) -> np.ndarray:
        """A hash of each text's bag of words, whatever their order."""
        doc, h = self.occurrences()
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        return mix(total[self.start[1:]] - total[self.start[:-1]])


#: Buckets of a bag's outline; a count of TOP stands for TOP or more.
BUCKETS, TOP = 64, 255


def outlines(w: Words) -> np.ndarray:
    """Of each text, its words counted by hash bucket: the sum of the lesser counts of two texts bounds the words they share."""
    n = len(w.start) - 1
    at = w.doc * BUCKETS + (w.hashes >> np.uint64(58)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * BUCKETS), TOP).astype(np.uint8).reshape(n, BUCKETS)


def may_overlap(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Where outlines a and b of na and nb words leave an overlap of the threshold possible; never wrong the other way."""
    need = np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)
    full = ((a == TOP) & (b == TOP)).any(axis=1)
    return (np.minimum(na, nb) >= need) & (full | (np.minimum(a, b).sum(axis=1, dtype=np.int64) >= need))
