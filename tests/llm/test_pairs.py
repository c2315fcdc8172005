"""Near duplicates and cross-split overlaps against brute force, with every kind of awkward row."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm.cross_split import cross_split_overlaps, overlap_report
from lathework.llm.near_dup import duplicate_groups, expand, link_counts, near_classes, near_duplicates, product
from lathework.llm.text import bag_overlap, words

SCHEMA = "collection string, id string, text string, copies string"


def corpus(seed=3, groups=25, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for k in range(rng.choice([1, 1, 2, 3])):
            edited = list(base)
            for _ in range(rng.choice([0, 2, 5, 9, 14])):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [edited[at], "extra"]])
            if rng.random() < 0.5:
                cut = rng.randrange(10, 50)
                edited = edited[cut:] + edited[:cut]
            rows.append((rng.choice(["c", "p"]), f"id{len(rows):03d}", " ".join(edited), "clash"))
    return rows


def brute(rows, threshold, least):
    held = {(c, i, t) for c, i, t, *_ in rows if c is not None and i is not None and t is not None and len(words(t)) >= least}
    out = set()
    for a, b in combinations(sorted(held), 2):
        if a[0] == b[0] and a[1] != b[1] and bag_overlap(Counter(words(a[2])), Counter(words(b[2]))) >= threshold:
            out.add((a[0], *sorted((a[1], b[1]))))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    copies = [("c", f"copy{k}", rows[0][2], None) for k in range(4)]
    odd = [("c", None, rows[0][2], None), ("c", "null", None, None), ("c", "empty", "", None), (None, "x", rows[0][2], None), ("c", "long", "tail " * 60_000, None), ("c", "long2", "tail " * 59_000, None), rows[1], rows[1]]
    rows = [*rows, *copies, *odd]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 0.7, 50)
    assert ("c", "long", "long2") in got and len(got) > 20


def test_copies_beyond_the_first_are_linked_through_their_head(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [("c", f"k{i:02d}", text, "") for i in range(12)] + [("c", "z", text.replace("word7 ", ""), "")]
    got = {tuple(r)[1:] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), expand_copies=3).collect()}
    first = {f"k{i:02d}" for i in range(3)}
    assert {p for p in got if "z" in p} == {(k, "z") for k in first}
    assert {p for p in got if "z" not in p} == set(combinations(sorted(first), 2)) | {("k00", f"k{i:02d}") for i in range(3, 12)}


def test_only_copies_of_one_text_are_spared(spark):
    listed = [f"word{i}" for i in range(60)]
    turned = [" ".join(listed[k:] + listed[:k]) for k in range(6)]
    rows = [("c", f"t{k}", t, "") for k, t in enumerate(turned)] + [("c", f"copy{k}", turned[0], "") for k in range(5)]
    rows += [("c", f"z{k}", " ".join(listed[k + 1 :]), "") for k in range(3)] + [("c", "t1", turned[2] + " more", ""), ("p", "t1", turned[1], "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    full = brute(rows, 0.7, 50)
    near, members = near_classes(docs)
    pairs = expand(near, members, 3)
    got = {tuple(r) for r in pairs.collect()}
    spared = {"copy3", "copy4", "t0"}
    assert got <= full and {p for p in full if not spared & set(p)} == {p for p in got if not spared & set(p)}
    assert ("c", "copy0", "t0") in got and len([p for p in got if "copy4" in p]) == 1
    degree = Counter(i for c, *ends in full for i in ends)
    groups = {(r["collection"], r["id"]): r["links"] for r in duplicate_groups(docs, pairs, link_counts(near, members)).collect()}
    assert groups == {("c", i): degree[i] for c, i, *_ in rows if c == "c"} | {("p", "t1"): 0}


def test_a_hot_column_is_split_into_blocks_without_losing_pairs(spark):
    text = lambda k: "the same long opening that everyone begins with here " + " ".join(f"u{k // 2}x{j}" for j in range(50)) + f" odd{k % 2}"
    rows = [("c", f"k{k:03d}", text(k), "") for k in range(60)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), block=8).collect()}
    assert got == brute(rows, 0.7, 50) and len(got) == 30


@pytest.mark.parametrize("block", [8, 512])
def test_pairs_without_a_common_gram_are_found(spark, block):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(70)]
        for k in range(3):
            edited = list(base)
            for at in rng.sample(range(70), rng.choice([4, 8, 11])):
                edited[at] = rng.choice(vocabulary)
            # no order of words is shared
            rng.shuffle(edited)
            rows.append((rng.choice("cp"), f"id{g}-{k}", " ".join(edited), ""))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert got == brute(rows, 0.7, 50) and len(got) > 10


def test_dense_product_shuffles_each_document_once_whatever_the_blocks(spark, monkeypatch):
    from lathework.llm import near_dup

    rng = random.Random(11)
    rows = [("c", f"id{k:03d}", " ".join(f"w{rng.randrange(300)}" for _ in range(60)), None) for k in range(240)]
    one = near_dup.cut(spark.createDataFrame(rows, SCHEMA).selectExpr("collection", "xxhash64(id) as key", "60 as n", "repeat('x', 64) as outline", "20 as level", "cast(substring(repeat(id, 12), 1, 60) as binary) as columns").withColumn("outline", F.col("outline").cast("binary")))
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled(rows_of_a_block):
        monkeypatch.setattr(near_dup, "DENSE_ROWS", rows_of_a_block)
        before = sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(k) for k in range(x.size())])(store.executorList(True)))
        near_dup.dense_product(one, 0.7).write.format("noop").mode("overwrite").save()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(k) for k in range(x.size())])(store.executorList(True))) - before

    assert shuffled(6) < 2 * shuffled(1000)


def test_dense_product_finds_all_pairs_between_and_within_its_blocks(spark, monkeypatch):
    from lathework.llm import near_dup

    monkeypatch.setattr(near_dup, "DENSE_ROWS", 20)
    monkeypatch.setattr(near_dup, "TILE", 8)
    rows = [("c", f"k{k:03d}", " ".join(f"v{j}" for j in range(60 + k % 12)), "") for k in range(100)]
    rows = [(c, i, t + f" own{i}", x) for c, i, t, x in rows]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), block=8).collect()}
    assert got == brute(rows, 0.7, 50) and len(got) == 100 * 99 // 2


def phrased(rng, texts, phrases=120, each=9):
    """Texts of whole phrases, whose words so occur together, some of them twice."""
    listed = [" ".join(f"p{p}x{j // 2}" for j in range(each)) for p in range(phrases)]
    return [" ".join(rng.choice(listed) for _ in range(8)) + f" own{k}" for k in range(texts)]


def test_words_that_occur_together_share_columns_so_few_are_multiplied():
    from lathework.llm.grams import SKETCH, occurrence_slots
    from lathework.llm.near_dup import dense_columns
    from lathework.llm.text import Words

    w = Words(phrased(random.Random(5), 600))
    slot, n = occurrence_slots(w), w.sizes()
    count = np.bincount(slot, minlength=SKETCH)
    place, width = dense_columns(count, 600, w, 0.7)
    assert width == 96 and place.min() == -1 and place.max() < width and (place[slot] >= 0).all()
    held = np.bincount(w.occurrences()[0] * width + place[slot], minlength=600 * width).reshape(-1, width)
    product = np.sqrt(held) @ np.sqrt(held).T
    for i, j in combinations(range(0, 600, 12), 2):
        assert product[i, j] >= np.minimum(held[i], held[j]).sum() - 1e-9
    assert (product >= 0.7 / 1.7 * np.add.outer(n, n)).mean() < 0.02


@pytest.mark.parametrize("worth", [1e-4, -1.0])
def test_the_number_of_columns_decides_no_pair(spark, monkeypatch, worth):
    from lathework.llm import near_dup

    # below zero no number is worth it, so that the most columns are taken
    monkeypatch.setattr(near_dup, "WORTH", worth)
    rng = random.Random(8)
    rows = [(rng.choice("cp"), f"id{k:03d}", t, None) for k, t in enumerate(phrased(rng, 150))]
    rows += [(c, f"{i}-{k}", " ".join(rng.sample(t.split(), len(t.split()) - 3 * k)) + " tail" * k, None) for c, i, t, _ in rows[:40] for k in range(3)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), block=2).collect()}
    assert got == brute(rows, 0.7, 50) and len(got) > 60


def test_few_finds_every_place():
    from lathework.llm.near_dup import few

    rng = np.random.default_rng(3)
    for size, share in [(0, 0.5), (7, 0.5), (64, 0.0), (4099, 0.001), (4099, 0.4)]:
        mask = rng.random(size) < share
        assert few(mask).tolist() == np.flatnonzero(mask).tolist()


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(spark.createDataFrame([("c", "a", None, ""), ("c", "b", "short", "")], SCHEMA)).count() == 0


def test_cross_split_overlaps_equal_brute_force(spark):
    rows = [(f"t{i}", t, "x") for i, (_, _, t, _) in enumerate(corpus(5, size=40))]
    rng = random.Random(9)
    train, evaluation = [], []
    for i, t, _ in rows:
        if rng.random() < 0.6:
            train.append((i, t, "x"))
        else:
            evaluation.append((rng.choice(["validation", "other"]), i, t, "s"))
    evaluation += [("validation", "same", train[0][1], "s"), ("validation", "same", train[0][1], "s"), ("validation", "null", None, "s"), ("validation", None, train[0][1], "s"), ("validation", "blank", " - ", "s"), ("validation", "long", "w1 w2 w3 " * 20_000, "s")]
    train += [("again", train[0][1], "x"), ("none", None, "x"), ("blank", "...", "x"), ("long", "w1 w2 w3 " * 20_000 + "w4", "x"), train[1]]
    got = {(r["field"], r["id"], r["train_id"]) for r in cross_split_overlaps(spark.createDataFrame(train, "id string, text string, split string"), spark.createDataFrame(evaluation, "field string, id string, text string, source string")).collect()}
    expected = {(f, i, j) for f, i, t, _ in evaluation for j, u, _ in train if i and t and u and words(t) and bag_overlap(Counter(words(t)), Counter(words(u))) >= 0.75}
    assert got == expected and len(got) > 5


def test_a_prefix_that_many_suffixes_share_counts_as_much_as_any(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(33)]
    variants = []
    for k in range(60):
        edited = list(base)
        for at in rng.sample(range(33), 3):
            edited[at] = f"r{rng.randrange(40)}"
        variants.append((f"v{k}", " ".join(edited)))
    train = spark.createDataFrame(variants[:30], "id string, text string")
    evaluation = spark.createDataFrame([("f", i, t) for i, t in variants[30:]], "field string, id string, text string")
    found = lambda block: {tuple(r)[:3] for r in cross_split_overlaps(train, evaluation, block=block).collect()}
    few, all_ = found(4), found(10_000)
    assert few == all_ and len(all_) > 50


def test_reordered_prompts_are_found(spark):
    rng = random.Random(6)
    train, evaluation = [], []
    for k in range(60):
        own = [f"w{rng.randrange(120)}" for _ in range(30)]
        turned = list(own)
        turned[rng.randrange(30)] = "other"
        rng.shuffle(turned)
        train.append((f"t{k}", " ".join(own)))
        evaluation.append(("f", f"e{k}", " ".join(turned)))
    got = {(r["id"], r["train_id"], r["covered"]) for r in cross_split_overlaps(spark.createDataFrame(train, "id string, text string"), spark.createDataFrame(evaluation, "field string, id string, text string")).collect()}
    shared = lambda t, u: (Counter(words(t)) & Counter(words(u))).total()
    assert got == {(i, j, shared(t, u)) for _, i, t in evaluation for j, u in train if bag_overlap(Counter(words(t)), Counter(words(u))) >= 0.75} and len(got) >= 60


@pytest.mark.parametrize("block", [7, 4096])
def test_prompts_of_one_template_all_meet(spark, block):
    text = lambda k: f"please write one short poem about own{k}"
    train = spark.createDataFrame([(f"t{k}", text(f"a{k}")) for k in range(40)], "id string, text string")
    evaluation = spark.createDataFrame([("f", f"e{k}", text(f"b{k}")) for k in range(30)], "field string, id string, text string")
    assert cross_split_overlaps(train, evaluation, block=block).count() == 1200


def test_overlap_report_counts_records_and_pairs(spark):
    train = spark.createDataFrame([("a", "one two three four five six seven"), ("b", "one two three four five six seven")], "id string, text string")
    evaluation = spark.createDataFrame([("v", "e", "one two three four five six seven", "s"), ("v", "f", "nothing of the kind at all", None)], "field string, id string, text string, source string")
    got = {(r["source"], r["records"], r["overlapping"], r["pairs"]) for r in overlap_report(cross_split_overlaps(train, evaluation), evaluation).collect()}
    assert got == {("s", 1, 1, 2), (None, 1, 0, 0)}
    assert cross_split_overlaps(train.limit(0), evaluation).count() == 0 and cross_split_overlaps(train, evaluation.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 100])
def test_product_finds_all_pairs_of_a_column(spark, block):
    from lathework.llm.text import Words, outlines

    text = "a b c d e f g h"
    w = Words([text])
    rows = [(k, 1, 10, 8, bytearray(outlines(w)[0].tobytes())) for k in range(10)]
    df = spark.createDataFrame(rows, "key long, gram long, size long, n int, outline binary")
    got = {tuple(r) for r in product(df, 0.7, block).select(F.col("a"), F.col("b")).collect()}
    assert got == set(combinations(range(10), 2))


def test_groups_follow_links_and_keep_single_records(spark):
    docs = spark.createDataFrame([("c", i, "") for i in "abcde"] + [("c", "a", "again"), ("c", None, "")], "collection string, id string, group string")
    pairs = spark.createDataFrame([("c", "a", "b"), ("c", "b", "c")], "collection string, id_a string, id_b string")
    got = {r["id"]: (r["group"], r["links"]) for r in duplicate_groups(docs, pairs).collect()}
    assert got["a"][0] == got["b"][0] == got["c"][0] and len({g for g, _ in got.values()}) == 3
    assert [got[i][1] for i in "abcde"] == [1, 2, 1, 0, 0]
