"""Texts cut off by field limits or in transfer.

Of every text, and of every string value inside it, the length and the way it ends are noted. Where far more texts of a
source end open at one length than the neighbouring lengths' hazards let expect, with the false discoveries among all
lengths controlled, that length is a limit, and open endings there are cuts. A cut in transfer falls on any length, which
no hazard shows; so away from limits what can't be sound counts: a structure that never closes, prose that stops inside a
sentence, or a mark left by a broken transfer. Every cut carries the evidence it was found by.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import cut
from .answers import Answer, dissect, ends_open, final_word, is_item, last_line, says_nothing
from .pair_defects import copies, defects
from .text import words

WHOLE = "text"
_SCHEMA = "id string, source string, length int, broken boolean, defects array<string>, ends array<struct<kind string, length int, open boolean, last string, apart boolean, value long>>"


def endings(prompt: str | None, text: str, a: Answer | None = None) -> tuple[bool, list[tuple]]:
    """(broken, ends): whether the text can't be whole, and kind, length, openness, last word, setting and value's hash of each ending.

    ``apart``: nothing beside the ending says how such texts end here. Else its siblings do, by final punctuation.
    """
    a = a or dissect(text)
    body = text.rstrip()
    if not body or says_nothing(a):
        return False, []
    # what is broken shows limits too
    stopped = [(WHOLE, len(text), True, final_word(body), False, _hash(text))]
    if body[-1] == "�" or a.closed is False:
        return True, stopped
    ends: list[tuple] = []
    if a.closed is None:
        line = last_line(body)
        opened, apart = ends_open(body), is_item(body) or (line != body and len(words(line)) <= 4)
        if opened and not apart:
            if prompt and copies(words(body), words(prompt)) and len(words(body)) >= 0.95 * len(words(prompt)):
                return False, []
            return True, stopped
        return False, [(WHOLE, len(text), opened, final_word(body), apart, _hash(text))]
    ends.append((WHOLE, len(text), False, "", True, _hash(text)))
    siblings: dict[str, list[str]] = {}
    for k, v in a.values:
        siblings.setdefault(k, []).append(v)
    for k, vs in siblings.items():
        closed_ones = sum(bool(v.strip()) and not ends_open(v) for v in vs)
        for v in vs:
            if v.strip():
                if v.rstrip()[-1] == "�" or (v.rstrip()[-1] == "…" and ends_open(v)):
                    return True, []
                ends.append((k, len(v), ends_open(v), final_word(v), closed_ones == 0, _hash(v)))
    return False, ends


def _hash(text: str) -> int:
    return zlib.crc32(text.encode(errors="replace"))


def limits(ends: DataFrame, reach: int = 5, least_ratio: float = 3.0, rate: float = 0.01) -> DataFrame:
    """``source, kind, length`` at which endings are open far more often than at the ``reach`` lengths on either side.

    ends: ``source, kind, length, open``. The hazard of a length is the share of the texts at least as long that end
    open there. The expected number comes from the neighbours' hazards (with half an ending added), its upper tail from
    Chernoff's bound on the Poisson distribution, and of all lengths tested those stay whose tails pass Benjamini and
    Hochberg at ``rate``. Besides, the number must be ``least_ratio`` times the expected. Lengths are tested within each
    source and, for texts without one, over all.
    """
    per = ends.groupBy("source", "kind", "length").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("stops"))
    over = per.groupBy("kind", "length").agg(F.sum("n").alias("n"), F.sum("stops").alias("stops")).withColumn("source", F.lit(None).cast("string"))
    both = per.where("source is not null").unionByName(over)
    w = Window.partitionBy("source", "kind").orderBy("length")
    risk = F.sum("n").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = w.rangeBetween(-reach, reach)
    hazards = both.withColumn("risk", risk).withColumns({"near_stops": F.sum("stops").over(near) - F.col("stops"), "near_risk": F.sum("risk").over(near) - F.col("risk")})
    expected = (F.col("near_stops") + 0.5) / F.greatest(F.col("near_risk"), F.col("risk")) * F.col("risk")
    tested = hazards.withColumn("expected", expected).where("stops > 0")
    tail = F.when(F.col("stops") > F.col("expected"), F.exp(F.col("stops") - F.col("expected") + F.col("stops") * F.log(F.col("expected") / F.col("stops")))).otherwise(1.0)
    tested = tested.withColumn("p", tail).withColumn("tests", F.count("*").over(Window.partitionBy("kind")))
    # only tails below the rate can pass, so only those are ranked
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("p", "source", "length"))
    ranked = tested.where(F.col("p") <= rate).withColumn("bound", F.lit(rate) * rank / F.col("tests"))
    cutoff = F.max(F.when(F.col("p") <= F.col("bound"), F.col("p"))).over(Window.partitionBy("kind"))
    return ranked.withColumn("cutoff", cutoff).where((F.col("p") <= F.col("cutoff")) & (F.col("stops") >= least_ratio * F.col("expected"))).select("source", "kind", "length", "stops", "expected", "p")


def examined(texts: DataFrame, rules: bool = True) -> DataFrame:
    """``id, source, length, broken, defects, ends`` of every row with an id, from one reading of each answer: what endings() and, with ``rules``, pair_defects.defects() say.

    texts: ``id, source, prompt, text``; further columns are ignored. The rows are written to the shared folder.
    """

    def scan(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("length", pa.int32()), ("open", pa.bool_()), ("last", pa.string()), ("apart", pa.bool_()), ("value", pa.int64())]))
        names = ("kind", "length", "open", "last", "apart", "value")
        for batch in batches:
            rows = batch.to_pydict()
            broken, ends, found = [], [], []
            for p, t in zip(rows["prompt"], rows["text"]):
                a = None if t is None else dissect(t)
                b, e = (False, []) if t is None else endings(p, t, a)
                broken.append(b)
                ends.append([dict(zip(names, x)) for x in e])
                found.append(defects(p, t, a) if rules else [])
            length = [None if t is None else len(t) for t in rows["text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["id"], pa.string()), pa.array(rows["source"], pa.string()), pa.array(length, pa.int32()), pa.array(broken, pa.bool_()), pa.array(found, pa.list_(pa.string())), pa.array(ends, kind)],
                ["id", "source", "length", "broken", "defects", "ends"],
            )

    return cut(texts.where("id is not null").select("id", "source", "prompt", "text").mapInArrow(scan, _SCHEMA))


def cuts(seen: DataFrame, known: int = 3) -> DataFrame:
    """``id, path, kind, length, p`` of every cut in the rows of examined().

    path ``limit``: an open ending of the kind at a length whose hazard is significant, p its tail. path ``transfer``: a
    text that can't be whole, of its length, without p; such texts at a limit have both rows. An open ending at a limit is
    a cut unless nothing in the text shows how its kind ends and either its last word ends at least ``known`` texts of the
    kind at other lengths, or the same value ends so many there and a fiftieth of all that end open there, as the few
    values of an enumeration do.
    """
    ends = seen.select("id", "source", F.explode("ends").alias("e")).select("id", "source", "e.*")
    found = cut(limits(ends.select("source", "kind", "length", "open")))
    at = ends.where("open").join(found.select(F.col("source").alias("s"), F.col("kind").alias("k"), F.col("length").alias("l"), "p"), F.expr("kind = k and length = l and s <=> source"))
    at = at.groupBy("id", "kind", "length", "last", "apart", "value").agg(F.min("p").alias("p"))
    places = found.select("kind", "length").distinct().withColumn("limit", F.lit(True))
    elsewhere = ends.join(places, ["kind", "length"], "left").where("limit is null")
    finals = elsewhere.groupBy("kind", "last").agg(F.count("*").alias("n")).where(F.col("n") >= known).select("kind", "last")
    per = at.groupBy("kind", "length", "value").agg(F.count("*").alias("n"))
    common = per.withColumn("all", F.sum("n").over(Window.partitionBy("kind", "length"))).where((F.col("n") >= known) & (F.col("n") * 50 >= F.col("all"))).select("kind", "length", "value")
    apart = at.where("apart").join(finals, ["kind", "last"], "left_anti").join(common, ["kind", "length", "value"], "left_anti")
    limited = at.where("not apart").unionByName(apart.select(*at.columns)).select("id", F.lit("limit").alias("path"), "kind", "length", "p")
    broken = seen.where("broken").select("id", F.lit("transfer").alias("path"), F.lit(WHOLE).alias("kind"), "length", F.lit(None).cast("double").alias("p"))
    return limited.unionByName(broken).distinct()


def truncated(texts: DataFrame, known: int = 3) -> DataFrame:
    """``id`` of the texts that were cut; see cuts().

    texts: ``id, source, prompt, text``; further columns are ignored. Null ids and texts and texts that say nothing are
    not cut; texts without a source go by the limits over all; repeated rows count once; an empty table gives none.
    """
    return cuts(examined(texts, rules=False), known).select("id").distinct()


def truncation_rates(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``source, texts, cut, share`` by source (null is one): how often each truncates."""
    all_ = texts.where("id is not null").select("id", "source").distinct()
    flagged = ids.select("id", F.lit(1).alias("hit"))
    return all_.join(flagged, "id", "left").groupBy("source").agg(F.count("*").alias("texts"), F.count("hit").alias("cut"), (F.count("hit") / F.count("*")).alias("share"))
