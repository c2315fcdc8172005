"""Exact overlaps of pairs of texts."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import cut
from ..plans.sketch import sketch_filter
from .text import words


def shared_words(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n_texts: int) -> DataFrame:
    """``a, b, na, nb, shared``: the words of either text of each pair and those they share, each as often as both have it.

    pairs: ``a, b``, keys of classes of texts with the same words; classes: ``key, exact``, the hashes of a class's texts;
    texts: ``exact, text``, ``n_texts`` rows. A class stands for any of its texts, as all have the same words.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    held = sketch_filter(classes, F.col("key"), ends, F.col("key"), n_texts).groupBy("key").agg(F.min("exact").alias("exact"))
    near = sketch_filter(texts, F.col("exact"), held, F.col("exact"), n_texts).groupBy("exact").agg(F.first("text").alias("text"))
    found = cut(held.join(near, "exact").select("key", "text"))

    @F.pandas_udf("struct<na long, nb long, shared long>")
    def count(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t in zip(x, y):
            a, b = Counter(words(s)), Counter(words(t))
            rows.append((a.total(), b.total(), (a & b).total()))
        return pd.DataFrame(rows, columns=["na", "nb", "shared"], dtype="int64")

    a = found.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    b = found.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", count("text_a", "text_b").alias("c")).select("a", "b", "c.*")
