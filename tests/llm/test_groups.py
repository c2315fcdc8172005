"""Components, splits and consensus."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from lathework.llm.components import components
from lathework.llm.consensus import discover, latest
from lathework.llm.grouped_split import assign_splits, related, scenario_words


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (None, 3), (7, None), (2, 1), (1, 2)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == union_find(edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_scenario_words(spark):
    raw = [" Scenario Autumn_Lantern--Supper ", "autumn/lantern supper", "SCENARIO", "", None, "scenario-b-2"]
    got = [r["w"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(scenario_words(F.col("x")).alias("w")).collect()]
    assert got == ["autumn-lantern-supper", "autumn-lantern-supper", None, None, None, "b-2"]


def test_splits_keep_related_records_and_meet_shares(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, f"s{rng.randrange(400)}", "hot" if i % 3 == 0 else f"t{i}"]), f"e{rng.randrange(1500)}", rng.choice(["x", "y", None]), "clash") for i in range(2000)]
    rows += [rows[0], (None, "s1", "e1", "x", ""), (1, "s9", "e2", "y", "")]
    df = spark.createDataFrame(rows, "slot long, s string, e string, family string, component_name string")
    members = related(df, "slot", ["s", "e"])
    edges = [(("r", r[0]), (k, v)) for r in rows if r[0] is not None for k, v in (("s", r[1]), ("e", r[2])) if v is not None] + [(("r", r[0]), ("r", r[0])) for r in rows if r[0] is not None]
    groups = defaultdict(set)
    for (k, x), root in union_find(edges).items():
        if k == "r":
            groups[root].add(x)
    found = defaultdict(set)
    for r in members.collect():
        found[r["component"]].add(r["slot"])
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in found.values()}
    families = df.where("slot is not null").groupBy("slot").agg(F.min("family").alias("stratum"))
    split = {r["slot"]: r["split"] for r in assign_splits(members.join(families, "slot")).collect()}
    assert len(split) == 2000 and all(len({split[x] for x in g}) == 1 for g in found.values())


def test_splits_of_even_groups_are_near_their_shares(spark):
    members = spark.range(5000).select(F.col("id").alias("slot"), (F.col("id") / 3).cast("long").alias("component"), F.concat(F.lit("f"), (F.col("id") / 3).cast("long") % 4).alias("stratum"), F.lit("old").alias("split"), F.lit(1).alias("n"))
    per = defaultdict(lambda: defaultdict(int))
    for r in assign_splits(members).collect():
        per[r["stratum"]][r["split"]] += 1
    for counts in per.values():
        n = sum(counts.values())
        for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            assert abs(counts[name] / n - share) < 0.01
    assert assign_splits(members.limit(0)).count() == 0


def claims(spark, seed=5, items=400):
    rng = random.Random(seed)
    truth = {f"i{k}": rng.randrange(1, 4) for k in range(items)}
    care = {f"good{k}": 0.93 for k in range(4)} | {f"bad{k}": 0.0 for k in range(5)} | {"rare": 0.5}
    rows = []
    for item, t in truth.items():
        who = rng.sample([a for a in care if a != "rare"], 5) + (["rare"] if item in ("i1", "i2") else [])
        for a in who:
            rows.append((item, a, float(t if rng.random() < care[a] else rng.randrange(1, 4))))
    return truth, rows


def test_consensus_beats_the_majority_and_orders_annotators(spark):
    truth, rows = claims(spark)
    items, annotators = discover(spark.createDataFrame(rows, "item string, annotator string, value double").withColumn("w", F.lit("clash")), 2.0)
    got = {r["item"]: r for r in items.collect()}
    right = sum(got[i]["value"] == t for i, t in truth.items())
    votes = defaultdict(lambda: defaultdict(int))
    for i, _, v in rows:
        votes[i][v] += 1
    majority = sum(max(sorted(votes[i]), key=lambda v: votes[i][v]) == t for i, t in truth.items())
    assert right > majority and right >= 0.93 * len(truth)
    reliability = {r["annotator"]: r["reliability"] for r in annotators.collect()}
    assert min(v for a, v in reliability.items() if a.startswith("good")) > max(v for a, v in reliability.items() if a.startswith("bad"))
    assert reliability["rare"] < min(v for a, v in reliability.items() if a.startswith("good"))
    assert all(0 < r["agreement"] <= 1 and 0 < r["support"] <= 1 + 1e-9 for r in got.values())


def test_consensus_of_ties_single_labels_and_nothing(spark):
    rows = [("tie", "a", 1.0), ("tie", "b", 3.0), ("one", "a", 2.0), ("same", "a", 1.0), ("same", "b", 1.0)]
    got = {r["item"]: r["value"] for r in discover(spark.createDataFrame(rows, "item string, annotator string, value double"), 2.0)[0].collect()}
    assert got["one"] == 2.0 and got["same"] == 1.0 and got["tie"] in (1.0, 3.0)
    items, annotators = discover(spark.createDataFrame([], "item string, annotator string, value double"), 2.0)
    assert items.count() == 0 and annotators.count() == 0


def test_the_latest_valid_value_counts(spark):
    rows = [("p", "a", 1, 1, "x"), ("p", "a", 3, 2, "x"), ("p", "a", None, 3, "x"), ("p", None, 2, 1, "x"), (None, "a", 2, 1, "x"), ("p", "b", 2, None, "x"), ("p", "b", 1, 0, "x")]
    df = spark.createDataFrame(rows, "blind string, who string, v int, at int, item string")
    assert {tuple(r) for r in latest(df.drop("item"), "blind", "who", "v", ["at"]).collect()} == {("p", "a", 3.0), ("p", "b", 1.0)}
