import datetime as dt
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.functions import hooks
from lathework.functions.text import word_tokens
from lathework.operators import allocation as A
from lathework.operators import contracts as C
from lathework.operators import evaluation as E
from lathework.operators import retrieval as R
from lathework.operators import sampling as S
from lathework.operators import training as T
from lathework.sources import jsonl
from lathework.streaming import attempts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_schedule_has_the_fixed_order(spark):
    df = S.schedule(spark.createDataFrame([("p1",), ("p2",)], "prompt_id string"), ["A", "B", "C", "D"], 1, 20260714)
    got = [(r["prompt_id"], r["system_id"]) for r in sorted(df.collect(), key=lambda r: r["attempt_index"])]
    assert got == [("p1", "C"), ("p2", "B"), ("p1", "D"), ("p1", "A"), ("p1", "B"), ("p2", "C"), ("p2", "D"), ("p2", "A")]
    assert S.derived(20260714, "execution-order") == 17625029341685692511 and S.derived(0, "execution-order") == 1107510439186287908


def test_audit_and_stratified_samples_have_fixed_values(spark):
    ids = spark.createDataFrame([(f"heldout-v1-{i:03d}",) for i in range(1, 61)], "id string")
    got = [r["id"] for r in S.smallest(ids, S.hash_order("contamination-audit-v1", 20260715, F.col("id")), 6).collect()]
    assert [i[-3:] for i in got] == ["048", "007", "058", "041", "027", "017"]
    packets = [(f"{s}-{x}-{i}", s, x) for s in "ABCD" for x in ("target_use", "cross_domain", "robustness") for i in range(3)]
    chosen = S.stratified(spark.createDataFrame(packets, "id string, system string, slice string"), "id", "system", "slice", 2, 6, 20260715, "human-response-calibration-v1")
    assert {r["id"] for r in chosen.collect() if r["system"] == "A"} == {"A-target_use-1", "A-target_use-0", "A-cross_domain-1", "A-cross_domain-0", "A-robustness-2", "A-robustness-0"}
    short = S.stratified(spark.createDataFrame(packets[:3] + packets[9:12], "id string, system string, slice string"), "id", "system", "slice", 2, 6, 20260715)
    assert {(r["system"], r["phase"]) for r in short.collect()} == {("A", 1), ("A", 2), ("B", 1), ("B", 2)}


def test_counterbalance_shows_each_system_first_in_half(spark):
    ids = spark.createDataFrame([(f"heldout-v1-{i:03d}",) for i in range(1, 61)], "id string")
    got = S.counterbalance(ids, "id", "B", "C", 20260715).groupBy("response_a").count()
    assert rows(got) == [("B", 30), ("C", 30)]


def test_hash_rank_is_the_rank_of_one_sort(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") % 3).cast("string")))
    got = S.hash_rank(df, F.sha2(F.col("id").cast("string"), 256), "id", ["g"])
    per = {}
    for r in got.collect():
        per.setdefault(r["g"], []).append((r["position"], r["id"]))
    import hashlib

    for v in per.values():
        order = sorted((hashlib.sha256(str(i).encode()).hexdigest(), i) for _, i in v)
        assert [i for _, i in sorted(v)] == [i for _, i in order] and [p for p, _ in sorted(v)] == list(range(1, len(v) + 1))


def test_violations_keep_the_rules_order_and_count_unknown_as_broken(spark):
    df = spark.createDataFrame([(1, 5), (None, 0), (3, None)], "a int, b int")
    got = C.violations(df, {"a_set": F.col("a").isNotNull(), "b_positive": F.col("b") > 0})
    assert [r["violations"] for r in got.collect()] == [[], ["a_set", "b_positive"], ["b_positive"]]
    with pytest.raises(ValueError):
        C.assert_none(got)


def test_coverage_quotas_and_combinations(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 1)], "k string, n int")
    registry = spark.createDataFrame([("k", "x"), ("k", "y")], "dimension string, value string")
    assert rows(C.coverage(df, {"k": F.col("k")}, registry)) == [("k", "null", 1), ("k", "x", 2), ("k", "y", 0)]
    target = spark.createDataFrame([("x", 2), ("z", 1)], "k string, wanted long")
    assert sorted(map(str, rows(C.quota_gaps(df.where("k is not null"), target, ["k"])))) == ["('z', 1, 0, -1)"]
    assert rows(C.missing_combinations(df.where("k is not null").unionByName(spark.createDataFrame([("y", 1)], "k string, n int")), ["k", "n"])) == [("y", 2)]
    assert C.missing_combinations(df.limit(0), ["k", "n"]).count() == 0


def test_overlays_differences_and_keys(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    amended = spark.createDataFrame([("c", 3, "a"), ("d", 4, None)], "id string, v int, old string")
    assert rows(C.overlay(base, amended, "id", "old")) == [("b", 2), ("c", 3), ("d", 4)]
    twice = base.unionByName(base.limit(1))
    assert C.multiset_difference(twice, base).count() == 1
    assert rows(C.key_differences(base, spark.createDataFrame([("b",), ("z",), (None,)], "id string"), "id")) == [("a", "right"), ("z", "left")]


def test_chains_runs_and_reviews(spark):
    t = lambda s: dt.datetime(2031, 1, 1, 0, 0, s)
    events = spark.createDataFrame([("u", 1, "draft", t(1)), ("u", 2, "accepted", t(3)), ("u", 3, "edit", t(2)), ("u", 4, "edit", t(4)), ("v", 5, "draft", t(1))], "k string, o int, kind string, at timestamp")
    assert rows(C.chain_report(events, "k", ["o"], "kind", "at", ["accepted"])) == [("u", 4, 2, 1, 1, "edit"), ("v", 1, 0, 0, 0, "draft")]
    runs = spark.createDataFrame([("r", 1), ("r", 3), ("r", 3), (None, 1)], "run string, i int")
    assert rows(C.run_report(runs, "run", "i")) == [("r", 3, 3, 1, 1)]
    reviews = spark.createDataFrame([("a", 1, "allow"), ("a", 2, "allow"), ("b", 1, "allow"), ("b", 2, "reject"), ("c", 1, "allow"), ("c", 2, "reject"), ("c", 3, "reject")], "s string, stage int, d string")
    assert [(r["s"], r["outcome"]) for r in C.adjudicate(reviews, "s", "d", "stage").orderBy("s").collect()] == [("a", "allow"), ("b", "open"), ("c", "reject")]


def test_ledger_chains_and_finds_breaks(spark):
    entries = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y"), ("d", 1, None)], "chain string, o int, content string")
    got = C.ledger(entries, "chain", "o", "content")
    assert C.ledger_breaks(got, "chain", "o").where("expected != previous_sha256").count() == 0
    broken = got.withColumn("previous_sha256", F.when(F.col("o") == 2, F.lit("f" * 64)).otherwise(F.col("previous_sha256")))
    assert C.ledger_breaks(broken, "chain", "o").where("expected != previous_sha256").count() == 1


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(40)], "id long, vector array<double>")
    got = R.vector_neighbours(df.where("id < 5").withColumnRenamed("id", "qid"), df, 3, block=2)
    for q in range(5):
        score = v @ v[q] / np.maximum(np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]), 1e-12)
        best = sorted((i for i in range(40) if i not in (q, 7)), key=lambda i: (-round(score[i], 6), i))[:3]
        assert [r["id"] for r in got.where(f"qid = {q}").orderBy("rank").collect()] == best
    assert R.vector_neighbours(df.limit(0).withColumnRenamed("id", "qid"), df, 3).count() == 0
    texts = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "x"), (4, None)], "id int, text string")
    near = R.jaccard_neighbours(texts.withColumnRenamed("id", "qid"), texts, word_tokens(F.col("text")), 2)
    assert rows(near.where("qid = 1").select("id", "shared", "score")) == [(1, 3, 1.0), (2, 2, round(2 / 3, 6))]


def test_as_of_takes_the_last_at_or_before(spark):
    t = lambda s: dt.datetime(2031, 1, 1, 0, 0, s)
    left = spark.createDataFrame([("l1", "k", t(5)), ("l2", "k", t(1)), ("l3", None, t(5)), ("l4", "k", None)], "id string, k string, at timestamp")
    right = spark.createDataFrame([("k", t(2), 10), ("k", t(5), 11), ("k", t(6), 12), (None, t(1), 13)], "k string, at timestamp, slot int")
    got = {r["id"]: (r["last"], r["earlier"]) for r in R.as_of(left, right, "k", "at", "slot").collect()}
    assert got == {"l1": (11, 2), "l2": (None, 0), "l3": (None, 0), "l4": (None, 0)}


def test_three_valued_decisions(spark):
    df = spark.createDataFrame(list(itertools.product([True, False, None], repeat=2)), "a boolean, b boolean")
    got = {(r["a"], r["b"]): r["d"] for r in df.withColumn("d", R.decide(F.col("a"), F.col("b"))).collect()}
    assert got[True, True] == "reject" and got[True, False] == "allow" and got[False, None] == "uncertain" and got[False, False] == "allow"


def test_kappa_rates_and_pairs(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (1, 2), (3, 1), (9, 1)], "a int, b int")
    a, b = [1, 2, 3, 1, 3], [1, 2, 3, 2, 1]
    observed = sum(abs(x - y) for x, y in zip(a, b)) / 5
    chance = sum(abs(x - y) for x in a for y in b) / 25
    got = E.weighted_kappa(pairs, "a", "b", 1, 3).first()
    assert got["n"] == 5 and got["kappa"] == pytest.approx(1 - observed / chance, abs=1e-6)
    assert E.weighted_kappa(pairs.where("a = 2"), "a", "b", 1, 3).first()["kappa"] is None
    scores = spark.createDataFrame([("p", "B", 1), ("p", "C", 2), ("q", "B", 3), ("r", "A", 1)], "p string, s string, v int")
    assert rows(E.pairwise_outcomes(scores, "p", "s", "v", "B", "C")) == [("B by default", 1), ("C", 1), ("neither", 1)]
    assert rows(E.rates(spark.createDataFrame([("x", True), ("x", None)], "k string, h boolean"), ["k"], F.col("h")).select("k", "n", "hits", "rate")) == [("x", 2, 1, 0.5)]


def test_allocation_hits_the_target_and_covers(spark):
    records = [(f, f"{f}{g}", [g % 3]) for f in "AB" for g in range(6) for _ in range(1 + g % 2)]
    df = spark.createDataFrame(records, "family string, grp string, labels array<int>")
    groups = A.group_table(df, "family", "grp", "labels")
    assert A.mixed_groups(df, "family", "grp").count() == 0
    chosen = A.choose(A.family_states(groups, 4, 2, 7), 4, 0b111)
    size = {r["group"]: (r["records"], r["covered"]) for r in groups.collect()}
    for gs in chosen.values():
        assert sum(size[g][0] for g in gs) == 4
    covered = 0
    for gs in chosen.values():
        for g in gs:
            covered |= size[g][1]
    assert covered == 0b111
    with pytest.raises(ValueError):
        A.choose(A.family_states(groups, 4, 2, 7), 4, 0b1111)
    picks = A.greedy_cover(spark.createDataFrame([("F", "a", ["x"]), ("F", "b", ["x", "y"]), ("F", "c", ["z"])], "family string, id string, labels array<string>"), "family", "id", "labels", 2, 7)
    assert rows(picks) == [("F", "b", 1), ("F", "c", 2)]


def test_training_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    spans = T.content_spans(F.array(F.lit("ab"), F.lit("cde")))
    assert [tuple(s) for s in one(spans)] == [(0, 2), (2, 5)]
    tokens = F.array(F.struct(F.lit(0).alias("begin"), F.lit(1).alias("end")), F.struct(F.lit(3).alias("begin"), F.lit(4).alias("end")))
    assert one(T.span_weights(tokens, F.slice(spans, 2, 1), 2.0, 1.0)) == [1.0, 2.0]
    ids = F.array(*map(F.lit, (1, 2, 3)))
    assert one(T.label_mask(ids, F.lit(2))) == [-100, -100, 3]
    df = spark.createDataFrame([("a", [1], [1]), ("b", [1, 2, 3], [-100, 2, 3])], "id string, ids array<int>, labels array<int>")
    got = T.batches(df, F.sha2("id", 256), "id", 2).orderBy("id").collect()
    assert got[0]["ids"] == [1, 0, 0] and got[0]["labels"] == [1, -100, -100] and got[0]["attention"] == [1, 0, 0] and got[1]["attention"] == [1, 1, 1]


def test_jsonl_scan_and_sinks(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_bytes(b'{"a":1,"b":"\xc3\xa9"}\n{"a":2,"b":null}\n')
    bad.write_bytes(b'\xef\xbb\xbf{"a": 1}\r\n\n{"a":1,"a":2}\n[1]')
    assert rows(jsonl.scan_lines(spark, str(good)).select("line", "problem")) == [(1, None), (2, None)]
    problems = {(r["line"], r["problem"]) for r in jsonl.scan_lines(spark, str(bad)).collect()}
    assert {(0, "byte order mark"), (0, "carriage return"), (0, "no final line feed"), (2, "blank line"), (4, "not an object")} <= problems
    assert [r["b"] for r in jsonl.read_records(spark, str(good), "a int, b string").orderBy("line").collect()] == ["é", None]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(2,), (1,)], "a int")
    jsonl.write_once(df, out, ["a"])
    with pytest.raises(Exception):
        jsonl.write_once(df, out)
    assert rows(jsonl.pending(df, spark.createDataFrame([(2,)], "a int"), ["a"])) == [(1,)]
    assert jsonl.tree_digest(spark, str(tmp_path / "good.jsonl")).first()["files"] == 1


def test_streaming_counts_each_attempt_once(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    line = {"run_id": "r", "attempt_index": 0, "system_id": "A", "recorded_at": "2031-01-01T00:00:00Z", "raw_output": "{}"}
    (folder / "1.json").write_text("\n".join(json.dumps(x) for x in (line, line, line | {"attempt_index": 1, "raw_output": "{"})))
    query = attempts.to_memory(attempts.windowed_summary(attempts.read_attempts(spark, str(folder))), "summary")
    query.awaitTermination(120)
    got = spark.table("summary").collect()
    assert [(r["attempts"], r["json_valid"], r["schema_valid"]) for r in got] == [(2, 1, 0)]


def test_hooks_run_once_for_each_text(spark):
    df = spark.createDataFrame([("a",), ("a",), ("bb",), (None,)], "t string")
    got = hooks.apply_distinct(df, "t", lambda b, k: b.assign(n=b["t"].str.len() * k), "t string, n long", setup=lambda: 2)
    assert sorted((r["t"] or "", r["n"]) for r in got.collect()) == [("", None), ("a", 2), ("a", 2), ("bb", 4)]


def test_digests_do_not_depend_on_partitions(spark):
    lines = spark.range(100).select(F.col("id"), F.concat(F.lit("x"), "id").alias("line"))
    assert C.collection_digest(lines, "id", "line", 10).first() == C.collection_digest(lines.repartition(7), "id", "line", 10).first()


def test_bootstrap_of_cases_resamples_every_case(spark, tmp_path):
    import hashlib

    from lathework.queries import evaluation

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    cases = {f"cal-{k:09d}": "x" * (k * k) for k in range(1, 61)}
    rows = [*cases.items(), ("cal-000000003", "x"), ("cal-000000099", None), (None, "y" * 9999)]
    spark.createDataFrame(rows, "case_id string, candidate_prompt string").write.parquet(f"{tmp_path}/contamination_calibration.parquet")
    got = {r["draw"]: r["mean"] for r in evaluation.paired_bootstrap_cases(spark, str(tmp_path)).collect()}
    lengths = [len(cases[c]) for c in sorted(cases, key=sha)]
    expected = {d: sum(lengths[int(sha(f"20260715|{d}|{s}")[:15], 16) % 60] for s in range(60)) / 60 for d in range(200)}
    assert got.keys() == expected.keys() and all(abs(got[d] - expected[d]) < 1e-5 for d in got)
