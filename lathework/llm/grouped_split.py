"""Splits that keep related records together: components over shared entities, hashed into proportional ranges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import cut
from ..plans.skew import join_hot
from .components import components

SPLITS = ("train", "validation", "test")
#: Hash buckets whose running totals come to one task: a fixed number for each stratum.
BUCKETS = 1024
#: Components above this share of a stratum's records are placed one by one; there are fewer than 1 / LARGE of them.
LARGE = 1 / 200


def scenario_words(scenario: Column) -> Column:
    """A scenario id's lower-cased runs of letters and digits joined by '-', a leading 'scenario' set aside; null if none are left."""
    runs = F.regexp_extract_all(F.lower(scenario), F.lit(r"([\p{L}\p{N}]+)"), 1)
    runs = F.when(F.get(runs, F.lit(0)) == "scenario", F.slice(runs, 2, 1_000_000)).otherwise(runs)
    return F.when(F.size(runs) > 0, F.array_join(runs, "-"))


def node(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.xxhash64(F.lit(kind), value.cast("string")))


def related(records: DataFrame, record: str, entities: list[str]) -> DataFrame:
    """``record, component``: records share a component if any of the entity columns link them, also through others.

    Null records are left out, null entities link nothing; a record repeated with other entities links those too. Stars
    run over the distinct pairs of entities that records join, not over the records, of which one entity may hold many;
    only a record with several rows or without entities is a node of its own.
    """
    rows = records.where(F.col(record).isNotNull()).select(record, *entities).distinct()
    own = node("record", F.col(record))
    several = Window.partitionBy(record)
    nodes = F.array_compact(F.array(*[node(e, F.col(e)) for e in entities]))
    held = rows.select(record, nodes.alias("nodes")).withColumn("rows", F.count("*").over(several))
    alone = (F.col("rows") > 1) | (F.size("nodes") == 0)
    held = cut(held.select(record, F.when(alone, F.concat(F.array(own), F.col("nodes"))).otherwise(F.col("nodes")).alias("nodes")))
    first = F.get("nodes", F.lit(0))
    found = components(held.select(first.alias("u"), F.explode("nodes").alias("v")))
    keys = held.select(record, first.alias("node")).distinct()
    # an entity may hold a large part of all records
    sides = keys.groupBy("node").agg(F.count("*").alias("n")).join(found, "node")
    return join_hot(keys, sides, "node", "n", keys.count()).select(record, "component")


def assign_splits(members: DataFrame, shares: tuple[float, ...] = (0.8, 0.1, 0.1), names: tuple[str, ...] = SPLITS) -> DataFrame:
    """``record columns, split`` from ``members`` with ``component`` and ``stratum`` columns; whole components stay together.

    A component counts in full for the stratum most of its records have (ties: the greater name; null is a stratum). In
    each stratum components are ordered by hash and laid along a line of their sizes; where a component's middle falls
    decides its split, so that each range is as long as its share. Components above LARGE of a stratum, fewer than 1 /
    LARGE of them, would overshoot a range; they are placed first, largest first, each where most is still missing, and
    the ranges are those of what is then left. A split column that is there already is replaced.
    """
    columns = [c for c in members.columns if c not in ("split", "component")]
    sizes = members.groupBy("component", "stratum").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("component").agg(F.sum("n").alias("n"), F.max_by(F.coalesce("stratum", F.lit("")), F.struct("n", F.coalesce("stratum", F.lit("")))).alias("stratum"))
    whole = whole.withColumn("h", F.pmod(F.xxhash64("component", F.lit("split")), F.lit(1 << 40)))
    totals = whole.groupBy("stratum").agg(F.sum("n").alias("total"))
    whole = cut(whole.join(totals, "stratum"))
    big = F.col("n") > F.col("total") * LARGE
    miss = [f"left_{k}" for k in range(len(shares))]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        left = [float(frame["total"].iloc[0]) * s for s in shares]
        out = []
        for r in frame.sort_values(["n", "h", "component"], ascending=[False, True, True]).itertuples(index=False):
            k = max(range(len(shares)), key=lambda i: (left[i] / shares[i] if shares[i] else float("-inf"), -i))
            left[k] -= r.n
            out.append((r.stratum, r.component, names[k]))
        placed = pd.DataFrame(out, columns=["stratum", "component", "split"])
        for k, x in enumerate(left):
            placed[miss[k]] = x
        return placed

    schema = "stratum string, component long, split string, " + ", ".join(f"{m} double" for m in miss)
    # fewer than 1 / LARGE rows for each stratum by the definition of big
    first = cut(whole.where(big).groupBy("stratum").applyInPandas(place, schema))
    missing = first.groupBy("stratum").agg(*[F.first(m).alias(m) for m in miss])
    full = [F.coalesce(m, F.col("total") * s) for m, s in zip(miss, shares)]
    edges, at = [], F.lit(0.0)
    for x in full:
        # a split that has too much already gets nothing
        at = at + F.greatest(F.lit(0.0), x)
        edges.append(at)
    bounds = totals.join(missing, "stratum", "left").select("stratum", *[e.alias(f"edge_{k}") for k, e in enumerate(edges)])
    bucketed = whole.where(~big).withColumn("bucket", F.floor(F.col("h") / F.lit((1 << 40) // BUCKETS)).cast("int"))
    buckets = bucketed.groupBy("stratum", "bucket").agg(F.sum("n").alias("in_bucket"))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket").join(bounds, "stratum")
    inner = Window.partitionBy("stratum", "bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    laid = bucketed.join(buckets, ["stratum", "bucket"]).withColumn("middle", F.col("ahead") + F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("n") / 2)
    choice = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        choice = F.when(F.col("middle") < F.col(f"edge_{i}"), names[i]).otherwise(choice)
    placed = whole.select("component", "n").join(laid.select("component", choice.alias("split")).unionByName(first.select("component", "split")), "component")
    rows = members.select(*columns, "component")
    return join_hot(rows, placed, "component", "n", rows.count()).select(*columns, "split")
