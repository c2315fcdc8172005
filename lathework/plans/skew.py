"""Joins that survive a key which holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows; so there are at most 1 / SHARE hot keys.
SHARE = 1 / 500


def join_hot(rows: DataFrame, sides: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with sides, which has one row for each key and, in ``weight``, how many of ``total`` rows have it.

    Hot keys are joined by a broadcast of at most 1 / SHARE rows, all others by a shuffle on the key. Every key of rows
    must be in sides.
    """
    limit = max(1.0, total * SHARE)
    hot = F.broadcast(sides.where(F.col(weight) > limit).drop(weight))
    cold = sides.where(F.col(weight) <= limit).drop(weight)
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(sides.where(F.col(weight) > limit).select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)
