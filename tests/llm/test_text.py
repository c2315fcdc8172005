import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lathework.llm.grams import SKETCH, canonical, occurrence_slots, prefixes
from lathework.llm.text import Words, bag_overlap, may_overlap, order_in_documents, outlines, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBß éÉé١1_-.,\n“”x", max_size=30)), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_hashed_words_are_the_words(texts):
    w = Words(texts)
    bags = [words(t) for t in texts]
    assert w.sizes().tolist() == [len(b) for b in bags]
    flat = [x for b in bags for x in b]
    seen = dict(zip(flat, w.hashes.tolist()))
    assert [seen[x] for x in flat] == w.hashes.tolist() and len(set(seen.values())) == len(seen)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_bag_hashes_forget_order_only(texts):
    bags = [Counter(words(t)) for t in texts]
    keys = Words(texts).bags().tolist()
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert (keys[a] == keys[b]) == (bags[a] == bags[b])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgh ", max_size=60), min_size=2, max_size=5), st.sampled_from([0.3, 0.7, 0.75, 1.0]))
def test_the_bound_never_discards_a_pair_that_reaches_the_threshold(texts, threshold):
    w = Words(texts)
    o, n = outlines(w), w.sizes()
    for a in range(len(texts)):
        for b in range(len(texts)):
            if n[a] and n[b] and bag_overlap(Counter(words(texts[a])), Counter(words(texts[b]))) >= threshold:
                assert may_overlap(o[a : a + 1], n[a : a + 1], o[b : b + 1], n[b : b + 1], threshold)[0]


def test_the_bound_holds_for_counts_past_the_top():
    long = "w " * 3000
    w = Words([long, long + "v"])
    assert may_overlap(outlines(w)[:1], w.sizes()[:1], outlines(w)[1:], w.sizes()[1:], 0.9)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgh ", max_size=60), min_size=2, max_size=5), st.sampled_from([0.3, 0.7, 0.75, 1.0]))
def test_texts_that_reach_the_threshold_share_a_column(texts, threshold):
    w = Words(texts)
    count = np.bincount(occurrence_slots(w), minlength=SKETCH)
    doc, column, _ = prefixes(w, count, threshold)
    of = [set(column[doc == k].tolist()) for k in range(len(texts))]
    for a in range(len(texts)):
        for b in range(len(texts)):
            if words(texts[a]) and bag_overlap(Counter(words(texts[a])), Counter(words(texts[b]))) >= threshold:
                assert of[a] & of[b]


def test_canonical_order_is_rarest_first_and_forgets_the_texts_order():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(20)) + f" rare{k // 2}" for k in range(6)]
    texts[1] = " ".join(sorted(texts[0].split()))
    w = Words(texts)
    count = np.bincount(occurrence_slots(w), minlength=SKETCH)
    doc, h, seen, rank = canonical(w, count)
    for k in range(6):
        assert (np.diff(seen[doc == k]) >= 0).all() and rank[doc == k].tolist() == list(range(w.sizes()[k]))
    assert h[doc == 0].tolist() == h[doc == 1].tolist()


def test_the_order_in_documents_is_lexsorts_whatever_the_ties():
    rng = np.random.default_rng(4)
    for size, docs, most in [(0, 1, 1), (1, 1, 1), (500, 1, 3), (4000, 900, 1 << 24), (4000, 7, 1 << 30), (200, 1 << 40, 1 << 40)]:
        doc = np.sort(rng.integers(0, docs, size))
        count = rng.integers(0, most, size)
        # the same upper bits, and the same numbers, again and again
        h = rng.integers(0, 4, size).astype(np.uint64) << np.uint64(62) | rng.integers(0, 40, size).astype(np.uint64)
        for keys in [(h, doc), (h, count, doc), (h, count.astype(np.float32), doc)]:
            got, expected = order_in_documents(doc, h, keys[1] if len(keys) == 3 else None), np.lexsort(keys)
            assert sorted(got.tolist()) == list(range(size)) and all((k[got] == k[expected]).all() for k in keys)
