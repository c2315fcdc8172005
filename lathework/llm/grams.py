"""Canonical order of documents' words, and the columns of the document by word incidence matrix that pairs must share."""

from __future__ import annotations

import numpy as np

from .text import Words, order_in_documents

#: Counters of the word-count sketch: its size, whatever the corpus holds.
SKETCH = 1 << 20


def slots(w: Words) -> np.ndarray:
    return (w.hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def occurrence_slots(w: Words) -> np.ndarray:
    """Sketch slots of all occurrences, so that the sketch counts texts."""
    return (w.occurrences()[1] & np.uint64(SKETCH - 1)).astype(np.int64)


def canonical(w: Words, count: np.ndarray):
    """(document, occurrence, count, rank): each document's word occurrences in one order for all documents, rarest first.

    The order goes by ``count``, the sketch of occurrences, then by hash; rank is the place in the document.
    """
    doc, h = w.occurrences()
    seen = count[occurrence_slots(w)]
    order = order_in_documents(doc, h, seen)
    doc, h, seen = doc[order], h[order], seen[order]
    return doc, h, seen, _rank(doc)


def prefixes(w: Words, count: np.ndarray, threshold: float):
    """(document, column, count) of each document's rarest n - ceil(threshold * n) + 1 word occurrences.

    Two texts whose overlap reaches the threshold share at least threshold * n of either's n words. So of their common
    occurrences the first in canonical order is among these of both.
    """
    doc, h, seen, rank = canonical(w, count)
    n = w.sizes()[doc]
    keep = rank < n - np.ceil(threshold * n - 1e-9) + 1
    return doc[keep], h[keep], seen[keep]


def _rank(sorted_key: np.ndarray) -> np.ndarray:
    """Position within its run of equal keys."""
    if not len(sorted_key):
        return np.empty(0, np.int64)
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    at = np.arange(len(sorted_key))
    return at - np.maximum.accumulate(np.where(first, at, 0))
