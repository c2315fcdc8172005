"""Where models plug in: callables given by the caller, run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def apply_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """fn over every batch; setup runs once for each task, and its result is fn's second argument. A model loads in setup."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if setup is None:
            yield from map(fn, batches)
        else:
            state = setup()
            yield from (fn(b, state) for b in batches)

    return df.mapInPandas(run, schema)


def apply_distinct(df: DataFrame, text: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """fn over the distinct texts only, joined back to all rows: what is costly runs once for each text."""
    done = apply_batches(df.select(text).where(df[text].isNotNull()).distinct(), fn, schema, setup)
    return df.join(done, text, "left")
