"""Leakage, held-out audit, selections and first decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators.contracts import latest_by
from ..operators.retrieval import earlier, jaccard_neighbours
from . import query, read

#: Token overlap from which a neighbour is flagged.
FLAG = 0.65
_TOKENS = "list_distinct(regexp_extract_all(lower(user_prompt), '[a-z0-9]+'))"
_NUMBER = "try_cast(regexp_extract(example_id, '(\\d+)$', 1) as bigint)"


@query(
    f"""with c as (select distinct example_id, {_TOKENS} as t from candidates where user_prompt is not null), q as (select * from c where {_NUMBER} % 100 = 0),
    s as (select q.example_id, c.example_id as nearest, round(len(list_intersect(q.t, c.t)) / len(list_distinct(list_concat(q.t, c.t))), 6) as score from q join c on c.example_id < q.example_id where len(list_intersect(q.t, c.t)) > 0)
    select *, score >= {FLAG} as flagged from s qualify row_number() over (partition by example_id order by score desc, nearest) = 1"""
)
def heldout_audit_flags(spark, d):
    """For every hundredth example the nearest prompt among earlier examples, flagged from an overlap on."""
    c = read(spark, d, "candidates").where("user_prompt is not null").select(F.col("example_id").alias("id"), F.col("user_prompt").alias("text")).distinct()
    asked = c.where(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 100 == 0).withColumnRenamed("id", "qid")
    near = jaccard_neighbours(asked, c, word_tokens(F.col("text")), 1, eligible=earlier)
    return near.select(F.col("qid").alias("example_id"), F.col("id").alias("nearest"), "score", (F.col("score") >= FLAG).alias("flagged"))


@query(
    """with s as (select scenario_id, lower(trim(split)) as split from candidates where scenario_id is not null and split is not null)
    select scenario_id, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'validation') as validation from s group by 1 having count(distinct split) > 1"""
)
def scenario_leakage(spark, d):
    """Scenarios whose examples lie in more than one split."""
    s = read(spark, d, "candidates").where("scenario_id is not null and split is not null").select("scenario_id", F.lower(F.trim("split")).alias("split"))
    per = s.groupBy("scenario_id").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "validation").alias("validation"), F.countDistinct("split").alias("k"))
    return per.where("k > 1").drop("k")


_DIMENSIONS = ("underlying_answer_quality", "metaphorical_coherence", "recipe_style_execution")


@query(" union all ".join(f"select '{c}' as dimension, count(*) as scheduled, count(*) filter (where {c} between 1 and 3) as resolved, count(*) filter (where {c} between 2 and 3) as acceptable, round(count(*) filter (where {c} between 2 and 3) / count(*), 6) as end_to_end, round(count(*) filter (where {c} between 2 and 3) / nullif(count(*) filter (where {c} between 1 and 3), 0), 6) as conditional from scores" for c in _DIMENSIONS))
def dimension_acceptability(spark, d):
    """Each dimension's acceptable scores, over all and over resolved ones; one pass for all dimensions."""
    each = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("v")) for c in _DIMENSIONS])
    rows = read(spark, d, "scores").select(F.explode(each).alias("x")).select("x.*")
    per = rows.groupBy("dimension").agg(F.count("*").alias("scheduled"), F.count_if(F.col("v").between(1, 3)).alias("resolved"), F.count_if(F.col("v").between(2, 3)).alias("acceptable"))
    return per.withColumns({"end_to_end": F.round(F.col("acceptable") / F.col("scheduled"), 6), "conditional": F.round(F.try_divide("acceptable", "resolved"), 6)})


@query(" union all ".join(f"select '{c}' as dimension, {c} as score, count(*) as n from scores group by 2" for c in _DIMENSIONS))
def dimension_distribution(spark, d):
    """How often each score occurs in each dimension, valid or not."""
    each = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("score")) for c in _DIMENSIONS])
    return read(spark, d, "scores").select(F.explode(each).alias("x")).groupBy("x.dimension", "x.score").agg(F.count("*").alias("n"))


@query("select blind_id, score_id as first_score, full_qualitative_pass as first_pass from scores qualify row_number() over (partition by blind_id order by ingested_at nulls last, score_id) = 1")
def first_decision_wins(spark, d):
    """The first score that arrived for each packet."""
    s = read(spark, d, "scores").select("blind_id", "score_id", "full_qualitative_pass", "ingested_at")
    return latest_by(s, ["blind_id"], [F.col("ingested_at").asc_nulls_last(), F.col("score_id").asc()]).select("blind_id", F.col("score_id").alias("first_score"), F.col("full_qualitative_pass").alias("first_pass"))


@query(
    """with m as (select distinct blind_id, system_id, source_run_id from identity_mapping where source_run_id is not null), s as (select system_id, source_run_id, count(*) filter (where full_qualitative_pass) as passes, count(*) as n from m join scores using (blind_id) group by 1, 2)
    select system_id, arg_max(source_run_id, {'a': passes, 'b': -n, 'c': source_run_id}) as selected, max(passes) as passes from s group by 1"""
)
def prompt_version_selection(spark, d):
    """Of every system the run with most passes, then fewest scores."""
    m = read(spark, d, "identity_mapping").where("source_run_id is not null").select("blind_id", "system_id", "source_run_id").distinct()
    s = m.join(read(spark, d, "scores").select("blind_id", "full_qualitative_pass"), "blind_id").groupBy("system_id", "source_run_id").agg(F.count_if("full_qualitative_pass").alias("passes"), F.count("*").alias("n"))
    return s.groupBy("system_id").agg(F.max_by("source_run_id", F.struct("passes", -F.col("n"), "source_run_id")).alias("selected"), F.max("passes").alias("passes"))


@query("select example_id, slot_id, row_number() over (partition by example_id order by planned_at nulls last, slot_id) - 1 as attempt, cast(floor((row_number() over (partition by example_id order by planned_at nulls last, slot_id) - 1) / 2) as bigint) as chunk from (select distinct example_id, slot_id, planned_at from production_matrix where example_id is not null)")
def attempts_within_slot(spark, d):
    """Number and chunk of two of each slot among those planned for its example."""
    w = Window.partitionBy("example_id").orderBy(F.col("planned_at").asc_nulls_last(), "slot_id")
    rows = read(spark, d, "production_matrix").where("example_id is not null").select("example_id", "slot_id", "planned_at").distinct()
    n = F.row_number().over(w) - 1
    return rows.select("example_id", "slot_id", n.cast("long").alias("attempt"), F.floor(n / 2).alias("chunk"))


@query(
    """with s as (select distinct scenario_id, metadata.intent_family as f from candidates where scenario_id is not null), m as (select distinct scenario_id, intent_family as f from production_matrix where scenario_id is not null)
    select coalesce(s.scenario_id, m.scenario_id) as scenario_id, coalesce(s.f, m.f) as family, case when s.scenario_id is null then 'matrix' else 'examples' end as only_in from s full join m on s.scenario_id = m.scenario_id and s.f = m.f where s.scenario_id is null or m.scenario_id is null"""
)
def matrix_differences(spark, d):
    """Scenario and family pairs that only the examples or only the matrix has."""
    s = read(spark, d, "candidates").where("scenario_id is not null").select("scenario_id", F.col("metadata.intent_family").alias("family")).distinct().withColumn("s", F.lit(1))
    m = read(spark, d, "production_matrix").where("scenario_id is not null").select("scenario_id", F.col("intent_family").alias("family")).distinct().withColumn("m", F.lit(1))
    both = s.join(m, (s["scenario_id"] == m["scenario_id"]) & (s["family"] == m["family"]), "full_outer")
    return both.where("s is null or m is null").select(F.coalesce(s["scenario_id"], m["scenario_id"]).alias("scenario_id"), F.coalesce(s["family"], m["family"]).alias("family"), F.when(F.col("s").isNull(), "matrix").otherwise("examples").alias("only_in"))


@query(
    """with m as (select distinct blind_id, prompt_id, system_id from identity_mapping), q as (select prompt_id, system_id, avg(case when underlying_answer_quality between 1 and 3 then underlying_answer_quality end) as v from m join scores using (blind_id) group by 1, 2),
    d as (select prompt_id, max(v) filter (where system_id = 'C') - max(v) filter (where system_id = 'B') as d from q group by 1)
    select count(d) as pairs, round(avg(d), 6) as mean, round(stddev_samp(d), 6) as sd, count(*) filter (where d > 0) as better, count(*) filter (where d < 0) as worse from d"""
)
def paired_difference(spark, d):
    """Differences of two systems' mean scores on the same prompts."""
    m = read(spark, d, "identity_mapping").select("blind_id", "prompt_id", "system_id").distinct()
    s = read(spark, d, "scores").select("blind_id", F.when(F.col("underlying_answer_quality").between(1, 3), F.col("underlying_answer_quality")).alias("v"))
    per = m.join(s, "blind_id").groupBy("prompt_id").agg(F.avg(F.when(F.col("system_id") == "C", F.col("v"))).alias("c"), F.avg(F.when(F.col("system_id") == "B", F.col("v"))).alias("b"))
    x = per.select((F.col("c") - F.col("b")).alias("d"))
    return x.agg(F.count("d").alias("pairs"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_samp("d"), 6).alias("sd"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"))
