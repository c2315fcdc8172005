"""Training data preparation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import hash_order
from ..operators import training as T
from . import query, read


@query(
    """with c as (select distinct example_id, user_prompt, array_to_string(assistant_response.method, chr(10)) as answer from candidates where lower(trim(split)) = 'train')
    select example_id, t.role as role, sha256(t.content) as content_sha256, len(t.content) as characters from c, unnest([{'role': 'system', 'content': ''}, {'role': 'user', 'content': user_prompt}, {'role': 'assistant', 'content': answer}]) as u(t)"""
)
def chat_messages(spark, d):
    """Turns of every train example, with digests of their contents."""
    c = read(spark, d, "candidates").where(F.lower(F.trim("split")) == "train").select("example_id", "user_prompt", F.array_join("assistant_response.method", "\n").alias("answer")).distinct()
    m = c.select("example_id", F.explode(T.chat_messages("", F.col("user_prompt"), F.col("answer"))).alias("m"))
    return m.select("example_id", "m.role", F.sha2("m.content", 256).alias("content_sha256"), F.length("m.content").cast("long").alias("characters"))


@query("select l_returnflag as flag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) as mean_loss from lineitem group by 1")
def token_weighted_loss(spark, d):
    """Means of losses weighted by tokens, with prices and quantities in their places."""
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(T.token_weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("mean_loss"))


@query(
    """with a as (select distinct example_id, assistant_response as r from candidates)
    select example_id, cast(2 + coalesce(len(r.ingredients), 0) + coalesce(len(r.method), 0) as int) as parts,
    cast(coalesce(len(r.title), 0) + coalesce(len(r.garnish), 0) + 2 * (coalesce(list_sum(list_transform(r.ingredients, lambda x: coalesce(len(x.name), 0))), 0) + coalesce(list_sum(list_transform(r.method, lambda x: coalesce(len(x), 0))), 0)) as double) as weight from a"""
)
def span_weights(spark, d):
    """The weight of every example's answer, one character a token: its ingredient names and steps count double, title and garnish once."""
    a = F.col("assistant_response")
    names = F.transform(F.coalesce(a["ingredients"], F.array().cast("array<struct<amount:double,unit:string,name:string>>")), lambda i: F.coalesce(i["name"], F.lit("")))
    content = F.concat(names, F.coalesce(a["method"], F.array().cast("array<string>")))
    edge = lambda x: F.array(F.coalesce(x, F.lit("")))
    r = read(spark, d, "candidates").select("example_id", F.concat(edge(a["title"]), content, edge(a["garnish"])).alias("parts")).where("parts is not null").distinct()
    spans = r.withColumn("spans", T.content_spans(F.col("parts")))
    tokens = F.transform(F.sequence(F.lit(0), F.greatest(F.length(F.array_join("parts", "")), F.lit(1)) - 1), lambda i: F.struct(i.alias("begin"), (i + 1).alias("end")))
    weights = T.span_weights(tokens, F.slice("spans", F.lit(2), F.size("spans") - 2), 2.0, 1.0)
    return spans.select("example_id", F.size("spans").alias("parts"), F.aggregate(weights, F.lit(0.0), lambda a, b: a + b).alias("weight"))


@query(
    """with c as (select distinct example_id, user_prompt as p from candidates where lower(trim(split)) = 'train' and user_prompt is not null),
    k as (select example_id, len(string_split(p, ' ')) as n, cast(floor((row_number() over (order by sha256(concat_ws('|', 'batch-v1', '7', example_id)), example_id) - 1) / 8) as bigint) as batch from c)
    select example_id, batch, cast(max(n) over (partition by batch) as int) as width, cast(n - least(n, 3) as int) as active from k"""
)
def padded_batches(spark, d):
    """Batches of eight of the train prompts' characters as ids: widths and active labels."""
    c = read(spark, d, "candidates").where(F.lower(F.trim("split")) == "train").select("example_id", "user_prompt").where("user_prompt is not null").distinct()
    ids = F.transform(F.split("user_prompt", " "), lambda w: F.abs(F.hash(w)) % 1000)
    rows = c.select("example_id", ids.alias("ids")).withColumn("labels", T.label_mask(F.col("ids"), F.least(F.size("ids"), F.lit(3))))
    padded = T.batches(rows, hash_order("batch-v1", 7, F.col("example_id")), "example_id", 8)
    return padded.select("example_id", F.col("batch").cast("long").alias("batch"), F.size("ids").alias("width"), F.size(F.filter("labels", lambda x: x != T.IGNORED)).alias("active"))
