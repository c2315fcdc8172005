"""Exact group-isolated allocation of small planned collections: subsets of groups that hit a size and cover labels.

Families are solved apart, each in a task of its own: a dynamic programme over (records, covered labels) that keeps, of
all choices of groups with the same state, the one first in seeded order. The few states of all families are combined on
the driver, whose work depends on the numbers of families, labels and the target, not on the records.
"""

from __future__ import annotations

import hashlib
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = "family string, records int, covered long, chosen array<string>"


def priority(seed: int, group: str) -> str:
    return hashlib.sha256(f"group-allocation|{seed}|{group}".encode()).hexdigest()


def group_table(records: DataFrame, family: str, group: str, labels: str) -> DataFrame:
    """``family, group, records, covered``: size and label bits of every group. labels: an array of numbers from 0 to 62."""
    return records.groupBy(F.col(family).alias("family"), F.col(group).alias("group")).agg(F.count("*").cast("int").alias("records"), F.expr(f"bit_or(aggregate({labels}, 0L, (m, l) -> m | shiftleft(1L, cast(l as int))))").alias("covered"))


def mixed_groups(records: DataFrame, family: str, group: str) -> DataFrame:
    """Groups whose records belong to more than one family, which no isolated allocation can place."""
    return records.groupBy(group).agg(F.countDistinct(family).alias("families")).where("families > 1")


def family_states(groups: DataFrame, target: int, slack: int, seed: int) -> DataFrame:
    """Of each family every reachable (records, covered) with at most target + slack records, and the groups that reach it."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(frame.itertuples(index=False), key=lambda r: (priority(seed, r.group), r.group))
        states: dict[tuple[int, int], tuple[int, ...]] = {(0, 0): ()}
        for k, r in enumerate(rows):
            for (n, mask), chosen in list(states.items()):
                state = (n + int(r.records), mask | int(r.covered))
                taken = (*chosen, k)
                if state[0] <= target + slack and (state not in states or taken < states[state]):
                    states[state] = taken
        out = [(frame["family"].iloc[0], n, mask, [rows[k].group for k in chosen]) for (n, mask), chosen in sorted(states.items())]
        return pd.DataFrame(out, columns=["family", "records", "covered", "chosen"])

    return groups.groupBy("family").applyInPandas(solve, STATES)


def choose(states: DataFrame, target: int, required: int) -> dict[str, list[str]]:
    """One state for each family, so that together all required labels are covered, as near the target as can be.

    Radii around the target grow until a combination covers all; of those the one with the least largest deviation, then
    the least total, then the first groups. An error if even all states don't cover the labels.
    """
    by_family: dict[str, list] = {}
    for r in states.collect():
        by_family.setdefault(r["family"], []).append((abs(r["records"] - target), r["covered"], tuple(r["chosen"])))
    families = sorted(by_family)
    for radius in range(max((d for rows in by_family.values() for d, *_ in rows), default=0) + 1):
        near = []
        for f in families:
            best: dict[int, tuple] = {}
            for d, mask, chosen in by_family[f]:
                if d <= radius and (mask not in best or (d, chosen) < best[mask]):
                    best[mask] = (d, chosen)
            near.append([(d, m, c) for m, (d, c) in best.items()])
        if not all(near):
            continue
        # covered labels so far: the best choice for each mask, family by family
        reached: dict[int, tuple] = {0: (0, 0, ())}
        for options in near:
            following: dict[int, tuple] = {}
            for (mask, (worst, total, picks)), (d, m, c) in product(reached.items(), options):
                entry = (max(worst, d), total + d, (*picks, c))
                if mask | m not in following or entry < following[mask | m]:
                    following[mask | m] = entry
            reached = following
        full = [e for mask, e in reached.items() if mask & required == required]
        if full:
            return dict(zip(families, map(list, min(full)[2])))
    raise ValueError("the required labels can't be covered")


def greedy_cover(records: DataFrame, family: str, id_: str, labels: str, size: int, seed: int) -> DataFrame:
    """``family, id, pick``: in each family, one record after another that adds most new labels, then first in seeded order.

    Of records with the same labels only the first ``size`` can be picked, so a family's task holds so many for each of its
    different sets of labels, whatever the records.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        left = sorted(((priority(seed, i), i, frozenset(l)) for i, l in zip(frame[id_], frame[labels])))
        seen: set = set()
        out = []
        while left and len(out) < size:
            best = min(left, key=lambda x: (-len(x[2] - seen), x[0], x[1]))
            left.remove(best)
            seen |= best[2]
            out.append((frame[family].iloc[0], best[1], len(out) + 1))
        return pd.DataFrame(out, columns=["family", "id", "pick"])

    key = F.sha2(F.concat_ws("|", F.lit("group-allocation"), F.lit(str(seed)), F.col(id_).cast("string")), 256)
    same = Window.partitionBy(family, F.array_join(F.array_sort(F.array_distinct(labels)), "\u0000")).orderBy(key, id_)
    few = records.select(family, id_, labels).withColumn("__r", F.row_number().over(same)).where(F.col("__r") <= size).drop("__r")
    return few.groupBy(family).applyInPandas(pick, "family string, id string, pick int")
