"""Semi-joins against a key sketch of bounded size, so that a wide side need not be shuffled whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in the smallest and the largest sketch; beyond the rows the largest can tell apart, none is used.
LEAST, MOST = 1 << 12, 1 << 19


def sketch_filter(df: DataFrame, key: Column, needed: DataFrame, needed_key: Column, keys: int = 1 << 20) -> DataFrame:
    """Rows of df whose 64-bit key may be among needed; keeps every row whose key is, and few others.

    keys: a bound of the number of needed keys, from a count; the sketch has eight bits for each. Its broadcast has at most
    MOST rows of 16 bytes by construction; where that is too few for the keys, all rows of df stay, for the join that
    follows to decide.
    """
    if keys > MOST * 32:
        return df
    words = LEAST
    while words * 8 < keys and words < MOST:
        words *= 2
    shift = words.bit_length() - 1
    bit = f"shiftleft(1L, cast(pmod(shiftright(__k, {shift}), 64) as int))"
    slot = F.pmod(F.col("__k"), F.lit(words)).cast("int")
    bits = needed.select(needed_key.alias("__k")).select(slot.alias("__slot"), F.expr(bit).alias("__bit")).groupBy("__slot").agg(F.expr("bit_or(__bit)").alias("__bits"))
    keyed = df.withColumn("__k", key).withColumn("__slot", slot)
    joined = keyed.join(F.broadcast(bits), "__slot")
    return joined.where(F.expr(f"(__bits & {bit}) != 0")).drop("__k", "__slot", "__bits")
