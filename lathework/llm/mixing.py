"""Mixing sources to target weights by entropy balancing.

Each document of a source gets a rate, how often it is used on average: the one nearest in entropy to one common rate
for all that meets the source's token target and never passes its cap. The solution is a logistic tilt in the document's
length, and its dual one convex problem for each source, solved by Newton steps over all sources at once. Rates are
rounded to copies by one hash for each document against a threshold that makes the tokens come out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import Cuts

#: Cells of a source's rounding offsets, twice in a row: the second time inside one cell.
CELLS = 2048


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, no outer blanks, '-' for '_' and inner blanks."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)[_\s]+", "-"))


def plan(available: dict[tuple[str, str], int], targets: list[dict]) -> dict[tuple[str, str], dict]:
    """For each (mix, source) its share among the sources that have tokens, and its token goal.

    The total of a mix is the largest at which every such source can meet its share within its cap. Sources without
    tokens or with a cap of nothing can't contribute; the others keep their proportions.
    """
    out = {}
    mixes: dict[str, list[dict]] = {}
    for t in targets:
        mixes.setdefault(t["mix_id"], []).append(t)
    for mix, rows in mixes.items():
        usable = [t for t in rows if available.get((mix, t["source"]), 0) * t["cap"] > 0 and t["share"] > 0]
        given = sum(t["share"] for t in usable)
        total = min((available[mix, t["source"]] * t["cap"] * given / t["share"] for t in usable), default=0.0)
        for t in rows:
            share = t["share"] / given if t in usable else 0.0
            out[mix, t["source"]] = {**t, "reachable": share, "goal": share * total}
    return out


def balance(counts: DataFrame, goals: dict[tuple[str, str], dict], total: dict[tuple[str, str], int], rounds: int = 40, tolerance: float = 1e-9) -> dict[tuple[str, str], float]:
    """The tilt of each (mix, source): Newton steps on the duals, each one aggregation over ``counts`` (mix_id, source, tokens, n).

    A rate is cap / (1 + exp(-(base + tilt * tokens / mean))). Goals within a millionth of cap times the tokens there are
    need no tilt: all documents are used at the cap.
    """
    live = {k: g for k, g in goals.items() if 0 < g["goal"] < g["cap"] * total[k] * (1 - 1e-6)}
    tilt, low, high = {k: 0.0 for k in live}, {k: -700.0 for k in live}, {k: 700.0 for k in live}
    left = dict(live)
    for _ in range(rounds):
        if not left:
            break
        params = counts.sparkSession.createDataFrame([(*k, g["base"], float(g["cap"]), g["mean"], tilt[k]) for k, g in left.items()], "mix_id string, source string, base double, cap double, mean double, tilt double")
        x = F.col("tokens") / F.col("mean")
        # as many parameter rows as there are targets
        rows = counts.join(F.broadcast(params), ["mix_id", "source"]).withColumn("x", x).withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("base") + F.col("tilt") * F.col("x"))))))
        sums = rows.groupBy("mix_id", "source").agg(F.sum(F.col("n") * F.col("cap") * F.col("p") * F.col("tokens")).alias("got"), F.sum(F.col("n") * F.col("cap") * F.col("p") * (1 - F.col("p")) * F.col("tokens") * F.col("x")).alias("slope")).collect()
        for r in sums:
            k = (r["mix_id"], r["source"])
            off = r["got"] - left[k]["goal"]
            if abs(off) <= tolerance * left[k]["goal"] + 0.01:
                del left[k]
                continue
            (high if off > 0 else low)[k] = tilt[k]
            step = tilt[k] - off / r["slope"] if r["slope"] > 0 else math.inf
            # the dual is convex, so the root lies between the bounds; a step past them is halved instead
            tilt[k] = step if low[k] < step < high[k] else (low[k] + high[k]) / 2
    return tilt


def mix(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, shares).

    sizes: ``id, source, tokens``, sources in one spelling (source_name), ids unique; targets: a bounded table ``mix_id,
    source, share, cap``. copies: ``mix_id, source, id, tokens, rate, copies`` for every document used at least once.
    shares: a row for each target: ``mix_id, source, target_share, max_repeats, documents, available_tokens, copies,
    tokens, actual_share, most``. Null sources and documents without tokens are in no mix. Where a listed source has no
    documents, its share stays zero and the others keep their proportions to each other.
    """
    spark = sizes.sparkSession
    cuts = Cuts(spark)
    wanted = [{"mix_id": r["mix_id"], "source": r["source"], "share": float(r["share"]), "cap": int(r["cap"])} for r in targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).collect()]
    listed = spark.createDataFrame([(t["mix_id"], t["source"]) for t in wanted], "mix_id string, source string")
    docs = cuts.cut(sizes.select("source", "id", "tokens").where("tokens > 0").join(F.broadcast(listed), "source").select("mix_id", "source", "id", "tokens"))
    counts = cuts.cut(docs.groupBy("mix_id", "source", "tokens").agg(F.count("*").alias("n")))
    have = {(r["mix_id"], r["source"]): r for r in counts.groupBy("mix_id", "source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("tokens")).alias("t")).collect()}
    goals = plan({k: r["t"] for k, r in have.items()}, wanted)
    per_mix: dict[str, float] = {}
    for k, r in have.items():
        per_mix[k[0]] = per_mix.get(k[0], 0) + r["t"]
    for k, g in goals.items():
        if k in have:
            common = sum(x["goal"] for j, x in goals.items() if j[0] == k[0]) / per_mix[k[0]]
            start = min(max(common / max(g["cap"], 1), 1e-6), 1 - 1e-6)
            g["base"], g["mean"] = math.log(start / (1 - start)), have[k]["t"] / have[k]["n"]
    goals = {k: g for k, g in goals.items() if k in have}
    tilt = balance(counts, goals, {k: r["t"] for k, r in have.items()})
    params = spark.createDataFrame(
        [(*k, float(g["cap"]), float(g.get("base", 0.0)), float(g.get("mean", 1.0)), tilt.get(k), float(g["goal"])) for k, g in goals.items()],
        "mix_id string, source string, cap double, base double, mean double, tilt double, goal double",
    )
    at = F.col("base") + F.col("tilt") * F.col("tokens") / F.col("mean")
    rate = F.when(F.col("goal") <= 0, 0.0).when(F.col("tilt").isNull(), F.col("cap")).otherwise(F.col("cap") / (1 + F.exp(-at)))
    u = F.pmod(F.xxhash64("id", "mix_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = docs.join(F.broadcast(params), ["mix_id", "source"]).withColumn("rate", rate).withColumn("floor", F.floor("rate")).withColumn("v", u - (F.col("rate") - F.col("floor")))
    rated = cuts.cut(rated.select("mix_id", "source", "id", "tokens", "rate", "floor", "v", "cap", "goal"))
    # a document gets one copy more where v is below its source's threshold; v is at least -1 and below 1
    short = {(r["mix_id"], r["source"]): r["goal"] - r["t"] for r in rated.groupBy("mix_id", "source").agg(F.first("goal").alias("goal"), F.sum(F.col("floor") * F.col("tokens")).alias("t")).collect()}
    span = {k: (-1.0, 1.0) for k in short}
    for last in (False, True):
        edges = spark.createDataFrame([(*k, a, b) for k, (a, b) in span.items()], "mix_id string, source string, a double, b double")
        cell = F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * CELLS).cast("int")
        # at most CELLS rows for each target come to the driver
        inside = rated.where("rate > floor and floor < cap").join(F.broadcast(edges), ["mix_id", "source"]).where("v >= a and v < b").groupBy("mix_id", "source", cell.alias("cell")).agg(F.sum("tokens").alias("t")).collect()
        cells: dict[tuple, dict[int, int]] = {}
        for r in inside:
            cells.setdefault((r["mix_id"], r["source"]), {})[r["cell"]] = r["t"]
        for k, (a, b) in span.items():
            width, c = (b - a) / CELLS, 0
            # in the end to the nearest: the cell that passes the goal counts if half of it is missing
            while c < CELLS - 1 and short[k] >= cells.get(k, {}).get(c, 0) * (0.5 if last else 1.0):
                short[k] -= cells.get(k, {}).get(c, 0)
                c += 1
            span[k] = (a + c * width, a + (c + 1) * width)
    bars = spark.createDataFrame([(*k, a) for k, (a, _) in span.items()], "mix_id string, source string, bar double")
    extra = F.when((F.col("rate") > F.col("floor")) & (F.col("floor") < F.col("cap")) & (F.col("v") < F.col("bar")), 1).otherwise(0)
    used = rated.join(F.broadcast(bars), ["mix_id", "source"]).withColumn("copies", (F.col("floor") + extra).cast("int"))
    copies = used.where("copies > 0").select("mix_id", "source", "id", "tokens", F.round("rate", 6).alias("rate"), "copies")
    return copies, _shares(spark, copies, wanted, have)


def _shares(spark, copies: DataFrame, wanted: list[dict], have: dict) -> DataFrame:
    rows = [(t["mix_id"], t["source"], t["share"], t["cap"], have[k]["n"] if k in have else 0, have[k]["t"] if k in have else 0) for t in wanted for k in [(t["mix_id"], t["source"])]]
    base = spark.createDataFrame(rows, "mix_id string, source string, target_share double, max_repeats int, documents long, available_tokens long")
    got = copies.groupBy("mix_id", "source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return base.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").select(
        "mix_id", "source", "target_share", "max_repeats", "documents", "available_tokens", zero("copies"), zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"), zero("most")
    )
