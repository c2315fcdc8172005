"""Packing, mixing and languages."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lathework.llm import tokens
from lathework.llm.language import code, decide, identify, mixture, sentences
from lathework.llm.mixing import mix, plan, source_name
from lathework.llm.packing import best_fit, improve, pack, packing_report


def test_local_search_never_overfills_and_never_adds_bins():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([10, 50, 97])
        sizes = [rng.randrange(1, capacity) for _ in range(rng.randrange(1, 80))]
        first = best_fit(sizes, capacity)
        bins = improve([list(b) for b in first], sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(0 < sum(sizes[i] for i in b) <= capacity for b in bins) and len(bins) <= len(first)
        assert sum(sum(sizes[i] for i in b) ** 2 for b in bins) >= sum(sum(sizes[i] for i in b) ** 2 for b in first)


def test_local_search_finds_what_best_fit_misses():
    # best fit leaves 6+5 | 4+4+3 | 3; exchanged, two bins of capacity 13 hold 25
    sizes = [6, 5, 4, 4, 3, 3]
    assert len(best_fit(sizes, 13)) == 3 and len(improve(best_fit(sizes, 13), sizes, 13)) == 2


def test_packing_is_whole_tight_and_unsplit(spark):
    rng = random.Random(7)
    sizes = [(i, rng.choice([0, 5, 12, 300, rng.randrange(1, 200)]), "x") for i in range(3000)]
    df = spark.createDataFrame(sizes, "id long, tokens long, kind string")
    kinds = spark.createDataFrame([("small", 64), ("large", 256), ("none", 0), (None, 9), ("small", 64)], "kind string, capacity int")
    rows = pack(df, kinds, group=500).collect()
    for kind, capacity in (("small", 64), ("large", 256)):
        own = [r for r in rows if r["kind"] == kind]
        parts, bins = defaultdict(dict), defaultdict(int)
        for r in own:
            assert r["piece"] not in parts[r["id"]]
            parts[r["id"]][r["piece"]] = r["size"]
            if r["container"] is not None:
                bins[r["container"]] += r["size"]
        for i, t, _ in sizes:
            assert sum(parts[i].values()) == t and len(parts[i]) == max(1, math.ceil(t / capacity))
        assert max(bins.values()) <= capacity
        least = math.ceil(sum(t for _, t, _ in sizes) / capacity)
        assert len(bins) <= least * 1.01 + 2
    assert {r["kind"] for r in packing_report(spark.createDataFrame(rows, "kind string, capacity int, container string, id long, piece int, size int")).collect()} == {"small", "large"}
    assert pack(df.limit(0), kinds).count() == 0 and pack(df, kinds.limit(0)).count() == 0


def test_mixing_meets_shares_within_caps(spark):
    rng = random.Random(11)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(0, 900), "x") for i in range(4000)]
    sizes = spark.createDataFrame(docs, "id long, source string, tokens long, mix_id string")
    targets = [("m", "a", 0.5, 2), ("m", "b", 0.4, 5), ("m", "gone", 0.1, 3), ("n", "c", 1.0, 3), ("o", "gone", 1.0, 1)]
    copies, shares = mix(sizes, spark.createDataFrame(targets, "mix_id string, source string, share double, cap int"))
    got = {(r["mix_id"], r["source"]): r for r in shares.collect()}
    assert got["m", "a"]["actual_share"] == pytest.approx(0.5 / 0.9, abs=2e-3) and got["m", "b"]["actual_share"] == pytest.approx(0.4 / 0.9, abs=2e-3)
    assert got["m", "gone"]["tokens"] == 0 and got["o", "gone"]["actual_share"] == 0.0
    assert got["n", "c"]["most"] == 3 and got["n", "c"]["copies"] == 3 * sum(1 for _, s, t, _ in docs if s == "c" and t > 0)
    caps = {(m, s): c for m, s, _, c in targets}
    own = {i: (s, t) for i, s, t, _ in docs}
    for r in copies.collect():
        assert 0 < r["copies"] <= caps[r["mix_id"], r["source"]] and own[r["id"]] == (r["source"], r["tokens"])
        assert r["copies"] in (math.floor(r["rate"] + 1e-6), math.floor(r["rate"]) + 1)
    assert mix(sizes.limit(0), spark.createDataFrame(targets, "mix_id string, source string, share double, cap int"))[0].count() == 0


def test_plans_and_names(spark):
    p = plan({("m", "a"): 100, ("m", "b"): 10}, [{"mix_id": "m", "source": "a", "share": 0.5, "cap": 1}, {"mix_id": "m", "source": "b", "share": 0.5, "cap": 2}])
    assert p["m", "a"]["goal"] == p["m", "b"]["goal"] == 20
    raw = [" Brief_Desk ", "brief desk", "BRIEF-DESK"]
    assert {r["s"] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(source_name(F.col("x")).alias("s")).collect()} == {"brief-desk"}


def test_token_sizes_round_trip(spark):
    texts = [(1, "Hello  world, où <|endoftext|> 123"), (2, None), (3, ""), (4, "word " * 20_000)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: r["tokens"] for r in tokens.token_sizes(df, ["id"]).collect()}
    e = tokens.encoding()
    assert got[2] == got[3] == 0 and got[4] >= 20_000
    ids = e.encode_ordinary(texts[0][1])
    assert got[1] == len(ids) and e.decode(ids) == texts[0][1]


SAMPLES = {
    "en": "The {a} asked for help with the {b} because the {c} is softer than it looks. We kept this since every {b} needs the {c} before the weekend.",
    "de": "Der {a} bat um Hilfe für den {b}, denn der {c} ist weicher als er aussieht. Wir behalten das, weil jeder {b} den {c} vor dem Wochenende braucht.",
    "fr": "Le {a} a demandé de l'aide pour le {b}, car le {c} est plus doux qu'il ne paraît. Nous gardons cela puisque chaque {b} veut le {c} avant la fin.",
}


def corpus(n=240):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["tav", "pell", "ros", "lin", "gar", "mer"]) for _ in range(2))
    text = lambda l: SAMPLES[l].format(a=word(), b=word(), c=word())
    rows, truth = [], {}
    for i in range(n):
        own = rng.choice(list(SAMPLES))
        langs = [own] if i % 6 else [own, rng.choice([l for l in SAMPLES if l != own])]
        body = " ".join(text(l) for l in langs)
        rows.append((i, body.upper() if i % 11 == 0 else body, rng.choice([own, own, own, None, "en"])))
        truth[i] = set(langs)
    return rows, truth


def test_languages_of_whole_and_mixed_documents(spark):
    rows, truth = corpus()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 5", None), (1003, "The help asked for it (“der Wein”) because the rest is softer than it looks. " * 500, "en")]
    df = spark.createDataFrame([*rows, *odd], "id long, text string, code string")
    got = {r["id"]: r for r in identify(df).collect()}
    found = {i: {x["language"] for x in got[i]["languages"] if x["sentences"]} for i in truth}
    assert sum(found[i] == truth[i] for i in truth) >= 0.97 * len(truth)
    for i in (1000, 1001):
        assert got[i]["languages"] == [] and got[i]["segments"] == []
    assert [x["language"] for x in got[1003]["languages"]] == ["en"]
    for r in got.values():
        assert sum(x["share"] for x in r["languages"]) == pytest.approx(1.0, abs=1e-6) or not r["languages"]
        assert all(0 <= x["confidence"] <= 1 + 1e-9 for x in (*r["languages"], *r["segments"]))


def test_languages_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "Some text here.", None)], "id long, text string, code string")
    assert identify(df).first()["languages"] == [] and identify(df.limit(0)).count() == 0


def test_notations_and_sentences(spark):
    raw = {"en-GB": "en", "English": "en", "fr_FR": "fr", "POR": "pt", "n/a": None, "??": None, "": None, None: None, "und": None, "NL ": "nl", "Español": "es"}
    got = {r["x"]: r["c"] for r in spark.createDataFrame([(x,) for x in raw], "x string").withColumn("c", code(F.col("x"))).collect()}
    assert got == raw
    assert sentences('One is 7.5 long. Two!\n{"a": "Three here.", "b": "Four."}') == ["One is 7.5 long.", "Two!", ' "Three here."', ' "Four."'] or len(sentences("One. Two!")) == 2


def test_one_language_needs_no_mixture():
    import numpy as np

    rng = np.random.default_rng(2)
    score = rng.normal(0, 30, size=(60, 3))
    doc = np.sort(rng.integers(0, 20, size=60))
    words = rng.integers(3, 12, size=60)
    for k in range(0, 20, 2):
        score[doc == k, 1] += 400
    share, pick, _ = decide(score, doc, 20, words, 7.0)
    _, full, post = mixture(score, doc, 20, words, 7.0)
    has = np.isin(np.arange(20), doc)
    assert np.allclose(share[has], full[has], atol=1e-3) and (pick == post.argmax(axis=1)).all()
