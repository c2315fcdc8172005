"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile at 97.5 %.
Z = 1.959963984540054


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of a rate; null for no trials."""
    s, m = successes.cast("double"), n.cast("double")
    p = s / m
    middle, scale = p + Z * Z / (2 * m), 1 + Z * Z / m
    half = Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))
    return F.when(n > 0, (middle - half) / scale), F.when(n > 0, (middle + half) / scale)


def rate(successes: Column, n: Column) -> Column:
    return F.when(n > 0, successes.cast("double") / n)


def summary(value: Column, digits: int = 6) -> list[Column]:
    """count, mean, median, quartiles (linear between ranks) and sample deviation (0 for one value)."""
    v = value.cast("double")
    q = lambda p: F.round(F.percentile(v, p), digits)
    return [
        F.count(v).alias("n"),
        F.round(F.avg(v), digits).alias("mean"),
        q(0.5).alias("median"),
        q(0.25).alias("q1"),
        q(0.75).alias("q3"),
        F.round(F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)), digits).alias("sd"),
    ]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; null where either has no length, an error where their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return checked / F.nullif(size, F.lit(0.0))
