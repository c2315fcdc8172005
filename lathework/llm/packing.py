"""Filling containers of fixed capacity with items, by swap-based local search.

Items are dealt by hash into groups of bounded size. In each, bins are filled best fit, largest item first; then bins
with room exchange items, one for one or two for one, or hand one over, whenever that raises the sum of squared fills,
so that fuller bins fill up and the emptiest bins empty. What is left in bins that still have room is dealt anew into
fewer groups, until one group remains, so that each round hands on only the bins its groups could not fill; or until a
round no longer lowers their number, when the emptiest are searched once more together.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import Cuts

#: Bins that give in one pass of the search, and passes at most.
DONORS, PASSES = 24, 40
#: A round that lowers a kind's open bins by less than this share is its last but one.
STALL = 0.02


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set where some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fit = free >> s
        if fit:
            r = s + ((fit & -fit).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            b, r = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        r -= s
        room[r].append(b)
        free |= 1 << r
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """The bins after the local search; never more of them."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    for _ in range(PASSES):
        loose = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b))
        if len(loose) < 2 or sum(capacity - fill[b] for b in loose) < capacity:
            break
        changed = False
        for t in reversed(loose):
            gap = capacity - fill[t]
            # the emptiest bins give, and only to bins at least as full as themselves
            givers = [b for b in loose[: DONORS + 1] if b != t and bins[b] and fill[b] <= fill[t]][:DONORS]
            pool = sorted((sizes[i], i, b) for b in givers for i in bins[b])
            while gap > 0 and pool:
                move = _move(bins[t], sizes, gap, pool)
                if move is None:
                    break
                out, into = move
                for s, i, b in into:
                    pool.remove((s, i, b))
                    bins[b].remove(i)
                    bins[t].append(i)
                    fill[b] -= s
                    fill[t] += s
                if out is not None:
                    b = into[0][2]
                    bins[t].remove(out)
                    bins[b].append(out)
                    fill[t] -= sizes[out]
                    fill[b] += sizes[out]
                    insort(pool, (sizes[out], out, b))
                changed = True
                gap = capacity - fill[t]
        if not changed:
            break
    return [b for b in bins if b]


def _move(target: list[int], sizes: list[int], gap: int, pool: list[tuple]) -> tuple | None:
    """The move into a fuller bin that leaves it least room: (item given back or None, items taken), or none that raises the squares.

    An item alone, one for a smaller one, or two of one bin for a smaller one; givers are no fuller, so every gain of
    the target's fill raises the sum of squares.
    """
    best, gain = None, 0
    k = bisect_right(pool, (gap, float("inf"), 0)) - 1
    if k >= 0 and pool[k][0] > 0:
        best, gain = (None, [pool[k]]), pool[k][0]
    if gain == gap:
        return best
    for out in target:
        s = sizes[out]
        k = bisect_right(pool, (s + gap, float("inf"), 0)) - 1
        if k >= 0 and pool[k][0] - s > gain:
            best, gain = (out, [pool[k]]), pool[k][0] - s
            if gain == gap:
                return best
    by_bin: dict[int, list[tuple]] = {}
    for x in pool:
        by_bin.setdefault(x[2], []).append(x)
    for out in target:
        most = sizes[out] + gap
        for xs in by_bin.values():
            lo, hi = 0, len(xs) - 1
            while lo < hi:
                both = xs[lo][0] + xs[hi][0]
                if both > most:
                    hi -= 1
                    continue
                if both - sizes[out] > gain:
                    best, gain = (out, [xs[lo], xs[hi]]), both - sizes[out]
                    if gain == gap:
                        return best
                lo += 1
    return best


def pieces(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """``kind, capacity, id, piece, size``: every item, and of those longer than a capacity each full part and the rest."""
    kinds = sorted({r["kind"]: r["capacity"] for r in capacities.where("kind is not null and capacity > 0").orderBy("kind", "capacity").collect()}.items())
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(c)).alias("capacity")) for k, c in kinds]) if kinds else F.array().cast("array<struct<kind string, capacity int>>")
    rows = sizes.select("id", "tokens", F.explode(each).alias("k")).select("id", "tokens", "k.*")
    parts = F.when(F.col("tokens") > 0, F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("piece", F.explode(parts))
    return rows.select("kind", "capacity", "id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))


def pack(sizes: DataFrame, capacities: DataFrame, group: int = 4000) -> DataFrame:
    """``kind, capacity, container, id, piece, size``: every piece of every item in a container of each kind.

    sizes: ``id, tokens``, ids unique; capacities: ``kind, capacity``, a bounded table (one row for each kind; capacities
    under one are left out). An item longer than a capacity is split into full parts and a rest, no other is split; the
    parts' order is ``piece``. Items without tokens take no room and have a null container. Equal sizes are told apart by
    id and piece, so the result doesn't depend on the order of rows. ``group`` bounds the pieces packed in one task.
    """
    cuts = Cuts(sizes.sparkSession)
    all_ = cuts.cut(pieces(sizes, capacities))
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("piece").cast("string"))
    whole = F.when(F.col("size") == F.col("capacity"), F.concat_ws("/", "kind", key))
    done = all_.where("size = 0 or size = capacity").withColumn("container", whole)
    rest = all_.where("size > 0 and size < capacity")
    columns = ["kind", "capacity", "container", "id", "piece", "size"]
    done = done.select(*columns)
    schema = "kind string, capacity int, container string, id long, piece int, size int, room int"

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        capacity, size = int(frame["capacity"].iloc[0]), frame["size"].tolist()
        bins = improve(best_fit(size, capacity), size, capacity)
        name, room = [""] * len(size), [0] * len(size)
        for n, b in enumerate(bins):
            left = capacity - sum(size[i] for i in b)
            for i in b:
                name[i], room[i] = f"{key[0]}/{key[2]}-{key[1]}-{n}", left
        return frame.assign(container=name, room=room)[["kind", "capacity", "container", "id", "piece", "size", "room"]]

    # a row for each kind, and kinds are few
    left = {r["kind"]: r["n"] for r in rest.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    bins, round_ = {}, 0
    while left:
        groups = F.create_map(*[x for k, n in left.items() for x in (F.lit(k), F.lit(max(1, -(-n // group))))])
        dealt = rest.withColumn("r", F.lit(round_)).withColumn("g", F.pmod(F.xxhash64("id", "piece", F.lit(round_)), groups[F.col("kind")]).cast("int"))
        packed = cuts.cut(dealt.groupBy("kind", "g", "r").applyInPandas(fill, schema))
        single = [k for k, n in left.items() if n <= group]
        open_ = packed.where((F.col("room") > 0) & ~F.col("kind").isin(single))
        done = done.unionByName(packed.where((F.col("room") == 0) | F.col("kind").isin(single)).select(*columns))
        now = {r["kind"]: r for r in open_.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("container").alias("bins")).collect()}
        # a kind whose open bins a round hardly lowers is packed once more, its emptiest bins together, and ends
        stuck = [k for k, r in now.items() if k in bins and r["bins"] > bins[k] * (1 - STALL)]
        if stuck:
            done = done.unionByName(_emptiest(cuts, open_.where(F.col("kind").isin(stuck)), group, fill, schema, columns))
        rest = open_.where(~F.col("kind").isin(stuck)).select("kind", "capacity", "id", "piece", "size")
        left = {k: r["n"] for k, r in now.items() if k not in stuck}
        bins = {k: now[k]["bins"] for k in left}
        round_ += 1
    return done


def _emptiest(cuts: Cuts, open_: DataFrame, group: int, fill, schema: str, columns: list[str]) -> DataFrame:
    """The open bins, of each kind the emptiest, with ``group`` pieces in all, packed anew together."""
    per = open_.groupBy("kind", "container").agg(F.sum("size").alias("held"), F.count("*").alias("pieces"))
    # every bin has a piece at least, so no more than ``group`` bins of a kind can take part
    first = per.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("held", "container"))).where(F.col("k") <= group)
    taken = first.withColumn("upto", F.sum("pieces").over(Window.partitionBy("kind").orderBy("k"))).where(F.col("upto") <= group).select("kind", "container")
    rows = open_.join(taken.withColumn("again", F.lit(True)), ["kind", "container"], "left")
    again = rows.where("again").select("kind", "capacity", "id", "piece", "size").withColumns({"g": F.lit(-1), "r": F.lit(-1)})
    packed = cuts.cut(again.groupBy("kind", "g", "r").applyInPandas(fill, schema))
    return rows.where("again is null").select(*columns).unionByName(packed.select(*columns))


def packing_report(packed: DataFrame) -> DataFrame:
    """``kind, capacity, containers, tokens, least, fill``: least is the number no packing can undercut, fill the share of room used."""
    per = packed.where("container is not null").groupBy("kind", "capacity").agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
    return per.withColumns({"least": F.ceil(F.col("tokens") / F.col("capacity")), "fill": F.round(F.col("tokens") / F.col("capacity") / F.col("containers"), 6)})
