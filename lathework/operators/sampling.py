"""Seeded orders, schedules and samples: everything sorts by a digest of namespace, seed and identity."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import derive_seed, hash_order, json_string

#: Runs of equal leading hex digits that are counted apart when ranks are found: a fixed number.
PREFIX = 3


def hash_rank(df: DataFrame, key: Column, tie: str, by: list[str] | None = None) -> DataFrame:
    """df with ``position``, its rank from 1 in the order of the digest ``key`` and then ``tie``, within ``by``.

    Ranks come from counts of the digests' leading digits, at most 16^PREFIX rows a group, and ranks inside equal leading
    digits; no task sorts the whole table.
    """
    by = by or []
    keyed = df.withColumn("__k", key).withColumn("__p", F.substring("__k", 1, PREFIX))
    counts = keyed.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*by, F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__k", tie))
    ranked = keyed.withColumn("__r", inside)
    on = ranked["__p"].eqNullSafe(counts["__p"])
    for b in by:
        on = on & ranked[b].eqNullSafe(counts[b])
    return ranked.join(counts, on).select(*[ranked[c] for c in df.columns], (F.col("__r") + F.col("__ahead")).cast("long").alias("position"))


def schedule(prompts: DataFrame, systems: list[str], repeats: int, seed: int, prompt: str = "prompt_id") -> DataFrame:
    """``prompt, system_id, repeat_index, generation_seed, attempt_index``: every prompt with every system and repeat, in seeded order from 0.

    The order's key is the digest of canonical JSON with a seed of its own, drawn from ``seed``; an attempt's generation
    seed depends on prompt and repeat only, so that systems are paired. Prompts hold no control characters.
    """
    order_seed = derived(seed, "execution-order")
    each = F.array(*[F.struct(F.lit(s).alias("system_id"), F.lit(r).alias("repeat_index")) for s in systems for r in range(repeats)])
    rows = prompts.select(prompt).distinct().select(prompt, F.explode(each).alias("x")).select(prompt, "x.*")
    name, system, repeat = json_string(F.col(prompt)), json_string(F.col("system_id")), F.col("repeat_index").cast("string")
    key = F.sha2(F.concat(F.lit('{"namespace":"execution-order-key","parts":[' + str(order_seed) + ","), F.concat_ws(",", name, system, repeat), F.lit("]}")), 256)
    rows = rows.withColumns({"generation_seed": derive_seed("generation", F.lit(str(seed)), name, repeat), "__id": F.concat_ws("\u0000", prompt, "system_id", repeat)})
    ranked = hash_rank(rows, key, "__id")
    return ranked.select(prompt, "system_id", "repeat_index", "generation_seed", (F.col("position") - 1).alias("attempt_index"))


def derived(seed: int, namespace: str) -> int:
    """derive_seed of one number, on the driver."""
    text = '{"namespace":"' + namespace + '","parts":[' + str(seed) + "]}"
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def smallest(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the smallest digests: a sample that depends on nothing but seed and identities."""
    return df.orderBy(key).limit(n)


def stratified(df: DataFrame, id_: str, group: str, stratum: str, each: int, total: int, seed: int, namespace: str = "stratified-v1") -> DataFrame:
    """``id, group, stratum, phase``: ``each`` rows of every stratum of a group, then filled to ``total`` within the group, in seeded order.

    A group with too few rows stays short; none is filled from another. phase is 1 for the strata's rows, 2 for the fill.
    """
    key = hash_order(namespace, seed, F.col(id_).cast("string"))
    rows = df.select(id_, group, stratum).withColumn("__k", key)
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group, stratum).orderBy("__k"))).withColumn("phase", F.when(F.col("__r") <= each, 1).otherwise(2))
    # no stratum fills a group with more than total rows, so only so many of each meet in the group's window
    first = first.where(F.col("__r") <= max(each, total))
    ranked = first.withColumn("__t", F.row_number().over(Window.partitionBy(group).orderBy("phase", "__k")))
    return ranked.where((F.col("phase") == 1) | (F.col("__t") <= total)).select(id_, group, stratum, "phase")


def counterbalance(pairs: DataFrame, id_: str, first: str, second: str, seed: int) -> DataFrame:
    """``id, position, response_a, response_b``: in seeded order the first half shows ``first`` first, the rest ``second``."""
    ranked = hash_rank(pairs.select(id_).distinct(), hash_order("pairwise-order-v1", seed, F.col(id_).cast("string")), id_)
    n = F.broadcast(ranked.agg(F.floor(F.count("*") / 2).alias("half")))
    early = F.col("position") <= F.col("half")
    return ranked.withColumn("one", F.lit(1)).join(n.withColumn("one", F.lit(1)), "one").select(id_, "position", F.when(early, F.lit(first)).otherwise(F.lit(second)).alias("response_a"), F.when(early, F.lit(second)).otherwise(F.lit(first)).alias("response_b"))


def resample_by_hash(n: int, draws: int, seed: int, draw: Column, slot: Column) -> Column:
    """Which of n rows a slot of a draw takes, from 0: the leading bits of a digest modulo n."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), slot.cast("string")), 256), 1, 15), 16, 10).cast("long")
    return F.pmod(bits, F.lit(n)).cast("int")


def bootstrap_means(values: DataFrame, id_: str, value: str, draws: int, seed: int) -> DataFrame:
    """``draw, mean``: means of ``draws`` resamples, each of as many rows as values has, drawn by digests.

    values: one row for each ``id_``. Rows are numbered in the order of the digest of ``id_``; slots find them by a join,
    so that only the number of rows comes to the driver.
    """
    n = values.count()
    if not n:
        return values.sparkSession.createDataFrame([], "draw long, mean double")
    ranked = hash_rank(values, F.sha2(F.col(id_).cast("string"), 256), id_).select("position", F.col(value).alias("__y"))
    slots = values.sparkSession.range(draws * n).select(F.expr(f"id div {n}").alias("draw"), F.expr(f"id % {n}").alias("__s"))
    drawn = slots.select("draw", (resample_by_hash(n, draws, seed, F.col("draw"), F.col("__s")) + 1).cast("long").alias("position"))
    return drawn.join(ranked, "position").groupBy("draw").agg(F.round(F.avg("__y"), 6).alias("mean"))


def bootstrap_indices(n: int, draws: int, seed: int) -> np.ndarray:
    """draws by n row numbers from the standard generator, the same for all measures of one n and seed."""
    rng = random.Random(seed)
    return np.array([[rng.randrange(n) for _ in range(n)] for _ in range(draws)], np.int32)


def paired_bootstrap(differences: DataFrame, order: str, columns: list[str], draws: int = 10_000, seed: int = 20260715, level: float = 0.95) -> DataFrame:
    """``measure, estimate, low, high``: percentile intervals of the means of paired differences.

    A bounded table of pairs (a held-out set) comes to the driver in its order, as the generator's draws are defined over it.
    """
    rows = differences.orderBy(order).select(*columns).toPandas()
    n = len(rows)
    if not n:
        return differences.sparkSession.createDataFrame([], "measure string, estimate double, low double, high double")
    index = bootstrap_indices(n, draws, seed)
    tail = (1 - level) / 2
    out = []
    for c in columns:
        v = rows[c].to_numpy(dtype=float)
        means = v[index].mean(axis=1)
        out.append((c, float(v.mean()), float(np.quantile(means, tail)), float(np.quantile(means, 1 - tail))))
    return differences.sparkSession.createDataFrame(out, "measure string, estimate double, low double, high double")
