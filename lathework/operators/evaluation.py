"""Evaluation analytics: rates, agreement, pairwise outcomes, structural summaries and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate, wilson


def rates(df: DataFrame, by: list[str], hit: Column, digits: int = 6) -> DataFrame:
    """``by, n, hits, rate, low, high``: a rate with its Wilson interval; unknown hits are misses."""
    per = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return per.select(*by, "n", "hits", F.round(rate(F.col("hits"), F.col("n")), digits).alias("rate"), F.round(low, digits).alias("low"), F.round(high, digits).alias("high"))


def weighted_kappa(pairs: DataFrame, a: str, b: str, low: int, high: int, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """``by, n, kappa``: linearly weighted agreement of two scores from low to high; pairs with another score are left out, null where chance leaves no room.

    From the table of the scores' pairs, so whatever the rows, one small group each.
    """
    by = by or []
    valid = pairs.where(F.col(a).between(low, high) & F.col(b).between(low, high))
    cells = valid.groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    gathered = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.abs(F.col("x") - F.col("y"))).alias("d"), F.collect_list(F.struct("x", "y", "c")).alias("t"))
    chance = "aggregate(t, 0D, (s, p) -> s + aggregate(t, 0D, (u, q) -> u + cast(p.c as double) * q.c * abs(p.x - q.y)))"
    return gathered.select(*by, "n", F.round(F.expr(f"1 - d / nullif({chance} / n, 0D)"), digits).alias("kappa"))


def pairwise_outcomes(scores: DataFrame, prompt: str, system: str, value: str, one: str, two: str) -> DataFrame:
    """``outcome, n``: for each prompt which of two systems has the higher mean value; without a value on either side mechanical or neither."""
    mean = lambda s: F.round(F.avg(F.when(F.col(system) == s, F.col(value))), 6)
    per = scores.groupBy(prompt).agg(mean(one).alias("x"), mean(two).alias("y"))
    outcome = (
        F.when(F.col("x").isNull() & F.col("y").isNull(), "neither").when(F.col("y").isNull(), f"{one} by default").when(F.col("x").isNull(), f"{two} by default").when(F.col("x") > F.col("y"), one).when(F.col("x") < F.col("y"), two).otherwise("tie")
    )
    return per.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def structural_summary(checked: DataFrame, by: str) -> DataFrame:
    """``by, attempts, completed, json_valid, schema_valid`` and ``labels``, how often each failure label occurs; a row may have several."""
    base = checked.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if(~F.array_contains("failure_labels", "generation_failure")).alias("completed"), F.count_if("json_valid").alias("json_valid"), F.count_if("schema_valid").alias("schema_valid"))
    labels = checked.select(by, F.explode("failure_labels").alias("label")).groupBy(by, "label").agg(F.count("*").alias("n"))
    maps = labels.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    return base.join(maps, base[by].eqNullSafe(maps[by]), "left").select(base["*"], F.coalesce("labels", F.create_map().cast("map<string,bigint>")).alias("labels"))


def ranking(candidates: DataFrame, gates: Column, order: list[Column]) -> DataFrame:
    """Candidates that pass all gates, by the order's columns; a report of a few candidates."""
    return candidates.where(gates).orderBy(*order)
