import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lathework.functions.prompts import assembled, local_seed
from lathework.functions.strictjson import checked_response
from lathework.functions.text import word_tokens
from lathework.operators import allocation as A
from lathework.operators import contracts as C
from lathework.operators import records as R
from lathework.operators import retrieval as N
from lathework.operators import sampling as S
from lathework.sources import files as X
from lathework.sources.jsonl import tree_digest

EXAMPLE = "example_id string, user_prompt string, assistant_response struct<title:string,ingredients:array<struct<amount:double,unit:string,name:string>>,method:array<string>,garnish:string>, metadata struct<intent_family:string,coverage_slice:string,input_form:string,complexity:string,complexity_sources:array<string>,constraint_bearing:boolean,robustness_role:string,topic:string,task_subtype:string,user_goal:string,requested_task_or_artefact:string,scenario_summary:string,important_constraints:array<string>>, provenance struct<authoring_batch_id:string,initial_draft_source:string,initial_draft_model_id:string,model_revision_used:boolean,material_human_edit:boolean>, split string, pilot_member boolean"


def example(id_="e-1", **changes):
    r = {"title": "A Title", "ingredients": [{"amount": 1.0, "unit": "ml", "name": "calm"}] * 3, "method": ["Stir.", "Serve."], "garnish": "Salt"}
    m = {"intent_family": "creative_generation", "coverage_slice": "breadth", "input_form": "question", "complexity": "standard", "complexity_sources": [], "constraint_bearing": False, "robustness_role": None, "topic": "t", "task_subtype": "idea_generation", "user_goal": "g", "requested_task_or_artefact": "a", "scenario_summary": "s", "important_constraints": []}
    p = {"authoring_batch_id": "b", "initial_draft_source": "human", "initial_draft_model_id": None, "model_revision_used": False, "material_human_edit": False}
    row = {"example_id": id_, "user_prompt": "Why?", "assistant_response": r, "metadata": m, "provenance": p, "split": "train", "pilot_member": False}
    for k, v in changes.items():
        for part in (row, r, m, p):
            if k in part:
                part[k] = v
    return row


def test_rules_name_what_a_record_breaks(spark):
    rows = [
        example("ok"), example("blank", user_prompt=" Why?"), example("null", user_prompt=None), example("few", ingredients=[]), example("minus", ingredients=[{"amount": -1.0, "unit": "ml", "name": "calm"}] * 3),
        example("role", coverage_slice="robustness"), example("subtype", task_subtype="shortening"), example("pilot", pilot_member=True, split=None), example("model", initial_draft_source="frontier_model", initial_draft_model_id="x/Qwen2.5-1.5B-INSTRUCT/"),
        example("constraint", constraint_bearing=True, complexity="composed", complexity_sources=["ordinary_content_constraint"], important_constraints=["c"]), example("long", user_prompt="w" * 200_000),
    ]
    df = spark.createDataFrame(rows, EXAMPLE).withColumn("violation", F.lit("clash"))
    got = {r["example_id"]: r["violations"] for r in C.violations(df, R.example_rules()).collect()}
    assert got == {
        "ok": [], "blank": ["prompt_trimmed"], "null": ["prompt_trimmed"], "few": ["ingredient_count"], "minus": ["amounts_positive"], "role": ["robustness"], "subtype": ["subtype"], "pilot": ["pilot_in_train"],
        "model": ["model_allowed"], "constraint": [], "long": [],
    }
    assert C.violations(df.limit(0), R.example_rules()).count() == 0


def test_content_identity_is_sorted_canonical_json(spark):
    rows = [example("a", title='Café "x" / y', initial_draft_model_id=None), example("b", method=[])]
    df = spark.createDataFrame(rows, EXAMPLE)
    got = {r["example_id"]: r["j"] for r in df.select("example_id", R.content_json(df, ["split", "pilot_member"]).alias("j")).collect()}
    for row in rows:
        content = {k: v for k, v in row.items() if k not in ("split", "pilot_member")}
        assert got[row["example_id"]] == json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_predicates(spark):
    df = spark.createDataFrame([('{"b":1,"c":2}', "2031-01-02T03:04:05Z", "x" * 64), ("[1]", "2031-01-02T03:04:05+00:00", "a" * 64), (None, "2031-02-30T00:00:00Z", None)], "raw string, at string, d string")
    missing, unexpected = R.closed_keys(F.col("raw"), ["a", "b"])
    got = [tuple(r) for r in df.select(missing, unexpected, R.utc_instant(F.col("at")).isNotNull(), R.utc_instant(F.col("at"), F.lit(dt.datetime(2030, 1, 1))).isNotNull(), R.sha256_digest(F.col("d"))).collect()]
    assert got == [(["a"], ["c"], True, False, False), (None, None, False, False, True), (None, None, False, False, None)]


def test_any_row_is_checked(spark):
    raw = ['{"a":' + "9" * 5000 + "}", "[" * 2000 + "]" * 2000, '{"a":"\\ud800"}', '{"a":1e400}', "[" * 300_000, '{"a":1}', None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", checked_response("t").alias("c")).collect()}
    assert [got[i]["json_valid"] for i in range(8)] == [True, True, True, True, False, True, False, False]
    assert got[0]["canonical"] == raw[0] and got[1]["canonical"] == raw[1] and got[2]["canonical"] == raw[2] and got[3]["canonical"] is None
    assert got[6]["failure_labels"] == ["generation_failure"]


def test_quotas_registries_chains_and_schedules(spark):
    df = spark.createDataFrame([("f", "x")] * 3 + [("f", None), ("g", "x"), ("g", "z")], "a string, b string")
    got = {tuple(r) for r in C.crossed_quotas(df, {"cross": (["a", "b"], {("f", "x"): (1, 2), ("f", None): (1, 1), ("g", "y"): (1, 5)}), "one": (["a"], {("f",): (4, 4), ("g",): (0, 9)})}).collect()}
    assert got == {("cross", "f|x", 3, 1, 2), ("cross", "g|x", 1, 0, 0), ("cross", "g|z", 1, 0, 0), ("cross", "g|y", 0, 1, 5)}
    assert {tuple(r) for r in C.concentration(df, {"b": F.col("b")}, 3).collect()} == {("b", "x", 4)}
    assert C.outside_registry(df, spark.createDataFrame([("f", "x"), ("g", "x")], "a string, b string"), ["a", "b"]).count() == 2
    chain = spark.createDataFrame([("1", None, "t"), ("2", "1", "t"), ("3", "1", "t"), ("4", "9", "t"), ("5", "5", "t"), ("6", "7", "t"), ("7", None, "u")], "id string, prior string, target string")
    assert {tuple(r) for r in C.linked_chain(chain, "id", "prior", "target").collect()} == {("2", "shared"), ("3", "shared"), ("4", "missing"), ("5", "itself"), ("6", "other target")}
    expected, actual = spark.createDataFrame([("p", 1), ("p", 2)], "k string, i int"), spark.createDataFrame([("p", 1), ("p", 1), ("q", 1)], "k string, i int")
    assert {tuple(r) for r in C.expected_differences(expected, actual, ["k", "i"]).collect()} == {("p", 2, "missing"), ("p", 1, "repeated"), ("q", 1, "unexpected")}


def test_ledger_breaks_are_those_alone(spark):
    sound = C.ledger(spark.createDataFrame([("c", i, f"x{i}") for i in range(4)], "chain string, o int, content string"), "chain", "o", "content")
    assert C.ledger_breaks(sound, "chain", "o").count() == 0
    forged = sound.withColumn("content", F.when(F.col("o") == 2, "other").otherwise(F.col("content")))
    assert [(r["o"], r["problem"]) for r in C.ledger_breaks(forged, "chain", "o").collect()] == [(2, "entry")]


def test_blocks_find_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(N, "CORPUS_BLOCK", 17)
    rng = random.Random(3)
    texts = [(f"i{k:03d}", " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(1, 7))) + " the", rng.choice(["g", "h", None]), rng.choice([1, 2, 3, None])) for k in range(60)]
    corpus = spark.createDataFrame([*texts, ("none", None, "g", 1), ("blank", "", "g", 1)], "id string, text string, group string, at int")
    queries = corpus.where("id < 'i010'").withColumnRenamed("id", "qid")
    mask = {"all": (N._none, lambda q, c: True), "earlier": (N.earlier, lambda q, c: c[0] < q[0]), "group": (N.same_group, lambda q, c: c[0] != q[0] and q[2] is not None and q[2] == c[2]), "before": (N.authored_before, lambda q, c: q[3] is not None and c[3] is not None and c[3] < q[3])}
    for fn, test in mask.values():
        near = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in N.jaccard_neighbours(queries, corpus, word_tokens(F.col("text")), 3, eligible=fn).collect()}
        ratio = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in N.lexical_neighbours(queries, corpus, 3, eligible=fn).collect()}
        for q in texts[:10]:
            a = set(q[1].split())
            j = sorted(((-round(len(a & set(c[1].split())) / len(a | set(c[1].split())), 6), c[0]) for c in texts if test(q, c) and a & set(c[1].split())))[:3]
            t = sorted(((-round(N.token_ratio(q[1], c[1]), 6), c[0]) for c in texts if test(q, c) and N.token_ratio(q[1], c[1]) > 0))[:3]
            assert [near[q[0], k + 1] for k in range(len(j))] == [(i, -s) for s, i in j] and (q[0], len(j) + 1) not in near
            assert [ratio[q[0], k + 1] for k in range(len(t))] == [(i, -s) for s, i in t]
    assert N.jaccard_neighbours(queries.limit(0), corpus, word_tokens(F.col("text")), 3).count() == 0
    assert N.lexical_neighbours(queries, corpus.limit(0), 3).count() == 0
    found = N.jaccard_neighbours(queries, corpus, word_tokens(F.col("text")), 1)
    assert tuple(N.recall_at(found, queries.select("qid", F.col("qid").alias("id"))).first())[:2] == (11, 10)


def test_lexical_neighbours_computes_no_ratio_pair_by_pair(spark, monkeypatch):
    rng = random.Random(4)
    words = ["a", "the", "plan", "picnic", "garden", "fence", "straße", "日本", "e\u0301t\u00e9", "😀", "x" * 300, "19", "9"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    queries = [(f"q{i}", text(rng.choice([0, 1, 4, 9, 40]))) for i in range(12)]
    corpus = [(f"c{i:03d}", text(rng.choice([0, 1, 3, 8, 30, 200]))) for i in range(90)] + [("same", queries[-1][1]), ("other", "zzz qqq")]
    expected = {}
    for q, a in queries:
        rated = sorted((-round(N.token_ratio(a, b), 6), c) for c, b in corpus if N.token_ratio(a, b) > 0)[:4]
        expected |= {(q, rank): (c, -s) for rank, (s, c) in enumerate(rated, 1)}

    def slow(a, b):
        raise AssertionError("a pair's ratio computed alone")

    monkeypatch.setattr(N, "token_ratio", slow)
    monkeypatch.setattr(N, "LEXICAL_BITS", 4000, raising=False)
    got = N.lexical_neighbours(spark.createDataFrame(queries, "qid string, text string"), spark.createDataFrame(corpus, "id string, text string"), 4)
    assert {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in got.collect()} == expected


def test_metadata_neighbours_count_fields(spark):
    rows = spark.createDataFrame([("a", ["X"], ["p", "q"]), ("b", ["x "], ["q"]), ("c", [None], [""]), ("d", None, ["p"]), ("b", ["z"], ["p"])], "id string, f array<string>, g array<string>")
    got = [(r["qid"], r["id"], r["score"], r["rank"]) for r in N.metadata_neighbours(rows.where("id = 'a'").withColumnRenamed("id", "qid"), rows, ["f", "g"], 5).orderBy("rank").collect()]
    assert got == [("a", "a", 2, 1), ("a", "b", 2, 2), ("a", "d", 1, 3)]


def test_samples_and_covers_are_those_of_whole_groups(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice("uv"), rng.choice("pqrs"), sorted({rng.choice("abcde") for _ in range(3)})) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, g string, s string, labels array<string>")
    key = lambda i: hashlib.sha256(f"stratified-v1|1|{i}".encode()).hexdigest()
    for group in "uv":
        mine = sorted((key(i), i, s) for i, g, s, _ in rows if g == group)
        first = [i for st in "pqrs" for _, i, s in [x for x in mine if x[2] == st][:3]]
        rest = [i for _, i, _ in mine if i not in first][: max(0, 20 - len(first))]
        got = {r["id"] for r in S.stratified(df, "id", "g", "s", 3, 20, 1).where(F.col("g") == group).collect()}
        assert got == set(first) | set(rest)
        picked = [r["id"] for r in A.greedy_cover(df, "g", "id", "labels", 6, 5).where(F.col("family") == group).orderBy("pick").collect()]
        left, seen, expected = sorted((A.priority(5, i), i, frozenset(l)) for i, g, _, l in rows if g == group), set(), []
        while len(expected) < 6:
            best = min(left, key=lambda x: (-len(x[2] - seen), x[0], x[1]))
            left.remove(best)
            seen |= best[2]
            expected.append(best[1])
        assert picked == expected


def test_prompts_and_seeds(spark):
    df = spark.createDataFrame([([("q1", "a1"), ("q2", "a2")], "18446744073709551615"), ([], "5")], "shots array<struct<request:string,answer:string>>, seed string")
    got = [tuple(r) for r in df.select(assembled(F.lit("Do."), F.col("shots"), F.lit("End.")), local_seed(F.col("seed"))).collect()]
    assert got == [("Do.\n\nBEGIN EXAMPLES\n\nEXAMPLE 1\nRequest: q1\nAnswer: a1\n\nEXAMPLE 2\nRequest: q2\nAnswer: a2\n\nEND EXAMPLES\n\nEnd.", (2**64 - 1) % (2**31 - 1)), ("Do.\n\nEnd.", 5)]


def test_declared_files(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode() if isinstance(text, str) else text)
        return str(p)

    assert X.strict_json_file(spark, put("a.json", '{"a": 1}'))[1] == hashlib.sha256(b'{"a": 1}').hexdigest()
    assert list(X.canonical_object(spark, put("b.json", '{"a":"b"}\n'))) == ["a"]
    for name, text in (("c.json", '{"a": 1}\n'), ("d.json", '{"a":1}'), ("e.json", "[1]\n"), ("f.json", b"\xff"), ("g.json", '{"a":1,"a":2}\n')):
        with pytest.raises(X.Refused):
            X.canonical_object(spark, put(name, text))
    toml = put("x.toml", "a = 1\n[b]\nc = true\n")
    assert X.toml_config(spark, toml, {"a": 1, "b": {"c": True}})["a"] == 1
    for wrong in ({"a": 1.0, "b": {"c": True}}, {"a": 1, "b": {"c": 1}}, {"a": 1}):
        with pytest.raises(X.Refused):
            X.toml_config(spark, toml, wrong)
    assert X.instruction_text(spark, put("t.txt", "Do it.\nNow.\n")) == "Do it.\nNow."
    for name, text in (("u.txt", "Do it."), ("v.txt", "Do it.\n\n"), ("w.txt", "Do\r\n"), ("y.txt", " Do\n"), ("z.txt", "\n")):
        with pytest.raises(X.Refused):
            X.instruction_text(spark, put(name, text))
    lines = ['{"metadata":{"k":1},"prompt":"p","prompt_id":"a"}', '{"prompt":"p","prompt_id":"b"}', '{"prompt":" ","prompt_id":"c"}', '{"prompt":"p"}', '{"other":1,"prompt":"p","prompt_id":"d"}', '{"prompt":"p","prompt_id":"b"}', '{"prompt":"p","prompt_id":"/"}']
    got = [(r["prompt_id"], r["metadata"], r["problem"]) for r in X.prompt_set(spark, put("p/prompts.jsonl", "\n".join(lines) + "\n")).orderBy("line").collect()]
    assert got == [("a", '{"k":1}', None), ("b", "{}", "repeated identifier"), ("c", "{}", "blank prompt"), (None, "{}", "missing key"), ("d", "{}", "unexpected key"), ("b", "{}", "repeated identifier"), ("/", "{}", "bad identifier")]
    for b, n in (("batch-02", 2), ("batch-01", 3)):
        put(f"{b}/candidates.jsonl", "".join(f'{{"b":"{b}","n":"{k}"}}\n' for k in range(n)))
    got = [(r["ord"], r["batch"], r["line"]) for r in X.batches(spark, str(tmp_path / "batch-*" / "candidates.jsonl")).orderBy("ord").collect()]
    assert got == [(1, "batch-01", 1), (2, "batch-01", 2), (3, "batch-01", 3), (4, "batch-02", 1), (5, "batch-02", 2)]


def test_folders_appear_and_change_as_a_whole(spark, tmp_path):
    target = str(tmp_path / "bundle")
    X.publish(spark, {"one": spark.range(3), "two": spark.range(1)}, target)
    assert spark.read.json(f"{target}/one").count() == 3 and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(X.Refused):
        X.publish(spark, {"one": spark.range(1)}, target)
    before = tree_digest(spark, f"{target}/one").first()["sha256"]
    with pytest.raises(X.Refused):
        X.replace_if(spark, spark.range(9), f"{target}/one", "0" * 64)
    X.replace_if(spark, spark.range(9), f"{target}/one", before)
    assert spark.read.json(f"{target}/one").count() == 9 and sorted(p.name for p in (tmp_path / "bundle").iterdir()) == ["one", "two"]
    swapped = tmp_path / "s"
    for n, (x, y) in enumerate((("1", "2"), ("2", "1"))):
        for folder, text in (("a", x), ("b", y)):
            (swapped / str(n) / folder).mkdir(parents=True)
            (swapped / str(n) / folder / "same.txt").write_text(text)
    assert len({tree_digest(spark, str(swapped / str(n))).first()["sha256"] for n in (0, 1)}) == 2


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from lathework.sources.jsonl import scan_lines

    folder = tmp_path / "many"
    folder.mkdir()
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 3)):
        (folder / name).write_text("".join(json.dumps({"f": name, "k": str(k)}, separators=(",", ":")) + "\n" for k in range(1, n + 1)))
    (folder / "c.jsonl").write_bytes(b'{"k":"1"}\n\xff\n{"k":"3"}')
    (folder / "d.jsonl").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = scan_lines(spark, str(folder))
        rows = [(r["path"].rsplit("/", 1)[-1], r["line"], json.loads(r["raw"])["k"] if r["raw"] else None, r["problem"]) for r in got.collect()]
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(str(n) == k for f, n, k, p in rows if p is None) and len([r for r in rows if r[3] is None]) == 4005
    assert {r for r in rows if r[3]} == {("c.jsonl", 2, None, "not UTF-8"), ("c.jsonl", 0, None, "no final line feed")}
