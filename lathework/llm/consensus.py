"""Consensus from several annotators' labels by confidence-aware truth discovery.

An annotator's weight is the lower bound of its precision: the chi-squared quantile of its number of labels over the sum
of their squared distances to the consensus, so that few labels earn little trust, however well they fit. Consensus
labels and weights are found in turn: the label of an item is the one with the least weighted distance to all its labels.
An annotator is measured against the consensus of the others, as one who outweighs all else would only ever agree with
what they themselves decide.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import Cuts
from ..plans.skew import join_hot

#: Added to an annotator's summed distance, so that perfect agreement has a finite weight.
FLOOR = 0.5


def chi2_lower(n: Column, z: float = -1.959964) -> Column:
    """The chi-squared quantile for n degrees of freedom at the normal quantile z, by Wilson and Hilferty."""
    c = F.lit(2.0) / (9.0 * n)
    return n * F.pow(F.greatest(1 - c + z * F.sqrt(c), F.lit(0.05)), 3)


def latest(scores: DataFrame, item: str, annotator: str, value: str, order: list[str]) -> DataFrame:
    """``item, annotator, value``: each annotator's last valid value of each item, by the ``order`` columns (nulls first); nulls are no values."""
    ranked = Window.partitionBy("item", "annotator").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    rows = scores.where(F.col(value).isNotNull() & F.col(item).isNotNull() & F.col(annotator).isNotNull())
    rows = rows.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), F.col(value).cast("double").alias("value"), *order)
    return rows.withColumn("rank", F.row_number().over(ranked)).where("rank = 1").select("item", "annotator", "value")


def discover(claims: DataFrame, span: float, rounds: int = 60, settled: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) from ``claims`` with item, annotator and a numeric value, one row for each annotator of an item; other columns are ignored.

    items: ``item, value, annotators, agreement, support``: the consensus (the weighted median, so one of the values
    given; of equals the one more annotators gave, then the smaller), how many gave a value, the share of them that gave
    this one, and the share of the weight. annotators: ``annotator, labels, distance, weight, reliability``: reliability
    is one minus the upper bound of the root of the mean squared distance, as a share of ``span``, the widest distance
    possible. An empty table gives two empty ones.

    item and annotator may be structs, as of field and name, so that several fields are solved in one go; the values of
    each are then given as shares of its own span. Rounds go on until no weight moves by more than ``settled`` of itself;
    that ``rounds`` don't get there is warned of. An annotator with a
    large part of all labels is split over tasks by join_hot; items' labels are summed by value before they are gathered.
    """
    cuts = Cuts(claims.sparkSession)
    claims = cuts.cut(claims.select("item", "annotator", "value"))
    total = claims.count()
    weights = cuts.cut(claims.groupBy("annotator").agg(F.count("*").alias("n")).withColumns({"m": F.lit(0).cast("long"), "d": F.lit(0.0), "w": F.lit(1.0)}))
    for _ in range(rounds):
        held = weighted(claims, weights, total)
        others = F.expr("transform(v, x -> struct(aggregate(v, 0D, (s, y) -> s + (y.w - if(y.value = value, w, 0D)) * abs(y.value - x.value)) as cost, if(x.value = value, 1, 0) - x.c as fewer, x.value as value))")
        away = held.join(gathered(held), "item").where("annotators > 1").withColumn("truth", F.array_min(others)["value"])
        measured = away.groupBy("annotator").agg(F.count("*").alias("m"), F.sum(F.pow((F.col("value") - F.col("truth")) / span, 2)).alias("d"))
        # who never met another keeps the weight of nobody's trust
        new = weights.select("annotator", "n").join(measured, "annotator", "left").fillna({"m": 0, "d": 0.0})
        new = cuts.cut(new.withColumn("w", chi2_lower(F.greatest("m", F.lit(1)).cast("double")) / (F.col("d") + FLOOR)))
        moved = new.select("annotator", F.col("w").alias("now")).join(weights, "annotator").agg(F.max(F.abs(F.col("now") / F.col("w") - 1)).alias("m")).first()["m"]
        weights = new
        cuts.drop(1, keep=1)
        if moved is None or moved <= settled:
            break
    else:
        warnings.warn(f"weights still moved by {moved:.4f} after {rounds} rounds", stacklevel=2)
    bound = F.sqrt(F.least(F.lit(1.0), (F.col("d") + FLOOR) / chi2_lower(F.greatest("m", F.lit(1)).cast("double"))))
    annotators = weights.select("annotator", F.col("n").alias("labels"), F.col("d").alias("distance"), F.col("w").alias("weight"), (1 - bound).alias("reliability"))
    return consensus(weighted(claims, weights, total)), annotators


def weighted(claims: DataFrame, weights: DataFrame, total: int) -> DataFrame:
    return join_hot(claims, weights.select("annotator", "n", "w"), "annotator", "n", max(1, total))


def gathered(held: DataFrame) -> DataFrame:
    """``item, v, all_w, annotators``: each item's different values with their weight and number, as many entries as there are."""
    votes = held.groupBy("item", "value").agg(F.sum("w").alias("w"), F.count("*").alias("c"))
    return votes.groupBy("item").agg(F.collect_list(F.struct("value", "w", "c")).alias("v"), F.sum("w").alias("all_w"), F.sum("c").alias("annotators"))


def consensus(held: DataFrame) -> DataFrame:
    cost = F.expr("transform(v, x -> struct(aggregate(v, 0D, (s, y) -> s + y.w * abs(y.value - x.value)) as cost, -x.c as fewer, x.value as value, x.w as w, x.c as c))")
    best = gathered(held).withColumn("best", F.array_min(cost))
    return best.select("item", "best.value", "annotators", (F.col("best.c") / F.col("annotators")).alias("agreement"), (F.col("best.w") / F.col("all_w")).alias("support"))
