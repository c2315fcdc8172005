import json
import random

import pytest

from lathework.llm.answers import asked_language, dissect, ends_open, final_word, says_nothing, script
from lathework.llm.pair_defects import defects, pair_defects
from lathework.llm.truncation import cuts, endings, examined, limits, truncated, truncation_rates

RECIPE = {
    "title": "The Quiet Hour",
    "ingredients": [{"amount": 2, "unit": "parts", "name": "a calm opening line"}],
    "method": ["Stir the plan with the calendar until it turns clear, because the first draft may be clumsy.", "Serve the rest beside the window and let the guests taste it first."],
    "garnish": "A small reward",
}
PROMPT = "How should the shop assistant prepare the garden fence when there are many tickets and the limit is ten minutes?"


@pytest.mark.parametrize("nothing", [None, "", " \n", "...", "N/A", "null", "[no output]", "{}", '""', "```json\n```", '{"title": "", "ingredients": [], "method": [""], "garnish": null}', "  ", "- -"])
def test_nothing_said_is_empty_and_nothing_else(nothing):
    assert defects(PROMPT, nothing) == ["empty"]


@pytest.mark.parametrize(
    "sound",
    [
        json.dumps(RECIPE),
        json.dumps(RECIPE, indent=2),
        "```json\n" + json.dumps(RECIPE) + "\n```",
        "Certainly. " + json.dumps(RECIPE) + "\nCheers",
        str(RECIPE),
        json.dumps(RECIPE).replace('"method"', "method"),
        json.dumps(RECIPE, indent=2).replace("\n  ],", "\n  ,],"),
        "Take two parts of the plan. Stir it with the calendar until it is clear, and serve it beside the window.\n- A small reward in the garden",
        json.dumps(RECIPE | {"method": [*RECIPE["method"], "Declining the meeting is allowed; I am unable to come is a full sentence, and rest counts as progress."]}),
    ],
)
def test_sound_answers_in_odd_forms_have_no_defect(sound):
    assert defects(PROMPT, sound) == [] and endings(PROMPT, sound)[0] is False


@pytest.mark.parametrize(
    "refusal",
    ["I'm sorry, but I can't help with that.", "Sorry, that is not something I can assist with.", "Je ne peux pas répondre à cette question.", "Das kann ich leider nicht beantworten.", "No puedo ayudar con eso.", "Não posso ajudar com isso.", "Daar kan ik helaas niet mee helpen.", json.dumps({"title": "Closed", "ingredients": [], "method": ["I must decline: it goes against my guidelines."], "garnish": ""})],
)
def test_refusals_in_many_languages(refusal):
    assert "refusal" in defects(None, refusal)


def test_copies_and_languages():
    assert defects(PROMPT, PROMPT.lower()) == ["copied_prompt"]
    assert defects(PROMPT, "You asked: " + PROMPT) == ["copied_prompt"]
    assert defects(PROMPT, json.dumps({"title": PROMPT, "ingredients": [], "method": [], "garnish": ""})) == ["copied_prompt"]
    assert defects(PROMPT, PROMPT + "\n\n" + json.dumps(RECIPE)) == []
    german = "Rühre den Plan mit dem Kalender, bis er klar wird, und serviere ihn dann neben dem Fenster, weil die Gäste nicht warten."
    assert defects(PROMPT, german) == ["other_language"]
    assert defects("Answer in German: " + PROMPT, german) == []
    assert defects("Please reply in Spanish. " + PROMPT, json.dumps(RECIPE)) == ["other_language"]
    assert asked_language("Antworte auf Englisch: warum?") == "en" and asked_language("Is the exam in German hard?") is None
    assert defects(PROMPT, "Смешайте план с календарём, пока он не станет ясным, и подайте его у окна.") == ["other_language"]


def test_scripts_are_told_apart_pairwise():
    russian = "Смешайте план с календарём, пока он не станет ясным, и подайте его у окна."
    chinese = "把计划和日历一起搅拌，直到它变得清楚，然后在窗边端上来。"
    japanese = "計画をカレンダーと混ぜて、はっきりするまで待ってください。"
    assert [script(t) for t in (russian, chinese, japanese, PROMPT, "Ελάτε να πιούμε καφέ", "42")] == ["cyrillic", "han", "kana", "latin", "greek", None]
    for own, other in ((russian, chinese), (chinese, japanese), (japanese, russian), (russian, PROMPT), (PROMPT, chinese)):
        assert "other_language" in defects(own, other)
    for own in (russian, chinese, japanese):
        assert "other_language" not in defects(own + own, own)


@pytest.mark.parametrize(
    "refusal",
    ["Mi dispiace, ma non posso aiutarti con questo.", "Przepraszam, nie mogę pomóc w tej sprawie.", "Tyvärr kan jag inte hjälpa dig med det.", "Beklager, det kan jeg desværre ikke hjælpe med."],
)
def test_refusals_in_every_language_that_is_told_apart(refusal):
    assert "refusal" in defects(PROMPT, refusal)


def test_short_answers_show_their_language_by_their_words():
    assert defects(PROMPT, "Das ist nicht gut und wird auch nicht besser.") == ["other_language"]
    assert defects(PROMPT, "Ice and lime.") == []


def test_every_cut_has_its_evidence(spark):
    rows = packets(spark) + [("half", "a", PROMPT, json.dumps(RECIPE)[:90], "")]
    df = spark.createDataFrame(rows, "id string, source string, prompt string, text string, clash string")
    got = [tuple(r) for r in cuts(examined(df)).collect()]
    assert {(p, k, n) for i, p, k, n, _ in got if i.startswith("cut")} == {("limit", "method", 100)} and all(p < 0.01 for i, *_, p in got if i != "half")
    assert [x for x in got if x[0] == "half"] == [("half", "transfer", "text", 90, None)]
    assert final_word("word " + "." * 500) == "word" and final_word("...") == ""


def test_cuts_are_seen_in_structure_prose_and_transfer():
    whole = json.dumps(RECIPE, indent=2)
    for at in range(5, len(whole) - 3, 17):
        assert endings(PROMPT, whole[:at])[0], whole[:at]
    assert endings(PROMPT, "Take two parts of the plan. Stir it with the cal")[0]
    assert endings(PROMPT, "Take two parts. Stir it with the calend�")[0]
    assert endings(PROMPT, "Take two parts of the plan. Stir it with the calen…")[0]
    assert not endings(PROMPT, "Take two parts of the plan. Stir it well...")[0]
    assert not endings(PROMPT, "Take two parts of the plan. Stir it well 🍸")[0]
    assert not endings(PROMPT, PROMPT.lower().rstrip("?"))[0]
    assert ends_open("no end") and not ends_open("an end.") and not ends_open("")


def test_dissect_keeps_keys_and_escapes():
    a = dissect('say {"a": "x\\"y", "b": ["p", "q\\u00e9"]} end')
    assert a.values == [("a", 'x"y'), ("b", "p"), ("b", "qé")] and a.closed and a.before == "say " and a.after == " end"
    assert dissect("plain").closed is None and dissect('{"a": "b').open_value
    assert says_nothing(dissect('{"title": " "}')) and not says_nothing(dissect('{"ti'))


def packets(spark):
    rows = []
    for i in range(600):
        steps = ["Stir the plan " + "very " * (i % 40) + "well and let it rest beside the old window for a while.", "Serve it."]
        text = json.dumps(RECIPE | {"method": steps})
        rows.append((f"ok{i}", "a" if i % 2 else "b", PROMPT, text, "clash"))
    for i in range(60):
        long = "Stir the plan " + "very " * (i % 20 + 10) + "well and let it rest beside the old window for a while, then go on and on."
        rows.append((f"cut{i}", "b", PROMPT, json.dumps(RECIPE | {"method": [long[:100], "Serve it."]}), "clash"))
    return rows


def test_limits_are_found_by_their_hazards_and_only_there(spark):
    rows = packets(spark)
    odd = [("null", "a", PROMPT, None, ""), (None, "a", PROMPT, "x", ""), ("empty", "a", PROMPT, "", ""), ("nosource", None, PROMPT, json.dumps(RECIPE), ""), ("noprompt", "a", None, json.dumps(RECIPE), ""), ("long", "a", PROMPT, "All is well. " * 30_000, ""), rows[0]]
    df = spark.createDataFrame([*rows, *odd], "id string, source string, prompt string, text string, clash string")
    got = {r["id"] for r in truncated(df).collect()}
    assert got == {f"cut{i}" for i in range(60)}
    rates = {r["source"]: (r["texts"], r["cut"]) for r in truncation_rates(df, spark.createDataFrame([(i,) for i in got], "id string")).collect()}
    assert rates["b"] == (360, 60) and rates["a"][1] == 0 and rates[None] == (1, 0)


def test_no_limits_without_a_spike(spark):
    rng = random.Random(4)
    ends = spark.createDataFrame([("s", "k", int(rng.gauss(120, 25)), rng.random() < 0.25) for _ in range(4000)], "source string, kind string, length int, open boolean")
    assert limits(ends).count() == 0
    assert limits(ends.limit(0)).count() == 0
    spiked = ends.unionByName(spark.createDataFrame([("s", "k", 110, True)] * 200, ends.schema))
    assert {(r["source"], r["length"]) for r in limits(spiked).collect()} == {("s", 110), (None, 110)}


def test_pair_defects_rows(spark):
    rows = [("a", PROMPT, None, 1), ("b", PROMPT, "I can't help with that.", 1), ("b", PROMPT, "I can't help with that.", 1), ("c", None, json.dumps(RECIPE), 1), (None, PROMPT, "", 1), ("d", PROMPT, json.dumps(RECIPE)[:90], 1)]
    df = spark.createDataFrame(rows, "id string, prompt string, response string, extra int")
    got = sorted(tuple(r) for r in pair_defects(df, spark.createDataFrame([("d",)], "id string")).collect())
    assert got == [("a", "empty"), ("b", "refusal"), ("d", "truncated")]
    assert pair_defects(df.limit(0), spark.createDataFrame([], "id string")).count() == 0
