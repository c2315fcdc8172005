"""Training data preparation: messages, spans, label masks, batches and weighted means of losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The label that a loss leaves out.
IGNORED = -100


def chat_messages(system: str, user: Column, assistant: Column) -> Column:
    """system, user and assistant turns as an array of role and content."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant))


def content_spans(parts: Column) -> Column:
    """begin and end of every part where the parts are joined without anything between them; end is past the last character."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(acc, part):
        end = acc["at"] + F.length(part)
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("begin"), end.alias("end")))).alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def span_weights(tokens: Column, spans: Column, inside: float, outside: float) -> Column:
    """Of each token (begin, end) the inside weight if it overlaps any span, else the outside weight."""
    return F.transform(tokens, lambda t: F.when(F.exists(spans, lambda s: (t["begin"] < s["end"]) & (t["end"] > s["begin"])), F.lit(inside)).otherwise(F.lit(outside)))


def label_mask(ids: Column, prompt_tokens: Column) -> Column:
    """Token ids with the prompt's replaced by IGNORED; a prompt longer than the ids is an error."""
    masked = F.concat(F.array_repeat(F.lit(IGNORED), prompt_tokens), F.slice(ids, prompt_tokens + 1, F.greatest(F.size(ids) - prompt_tokens, F.lit(0))))
    return F.when(prompt_tokens <= F.size(ids), masked).otherwise(F.raise_error(F.lit("the prompt has more tokens than the record")).cast("array<int>"))


def pad(values: Column, width: Column, fill) -> Column:
    """values, filled at the right to the width."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0))))


def batches(records: DataFrame, order: Column, tie: str, size: int, ids: str = "ids", labels: str = "labels", padding: int = 0) -> DataFrame:
    """records with ``batch`` (from 0, in the order of the digest ``order``) and ids, labels and ``attention`` padded to their batch's width."""
    from .sampling import hash_rank

    ranked = hash_rank(records, order, tie).withColumn("batch", F.floor((F.col("position") - 1) / size))
    width = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    wide = ranked.withColumn("width", width)
    return wide.withColumns({"attention": pad(F.transform(F.col(ids), lambda _: F.lit(1)), F.col("width"), 0), ids: pad(F.col(ids), F.col("width"), padding), labels: pad(F.col(labels), F.col("width"), IGNORED)})


def token_weighted_mean(loss: Column, tokens: Column) -> Column:
    return F.sum(loss * tokens) / F.sum(tokens)


def weighted_loss(loss: Column, weight: Column) -> Column:
    """The mean by active weight; an error where no weight is active."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(loss * weight) / total).otherwise(F.raise_error(F.lit("no weight is active")).cast("double"))
