"""Retrieval queries: a stated query set, every row whose number is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize, phrases, word_tokens
from ..operators import retrieval as R
from . import norm_sql, query, read

#: Every hundredth row asks.
STEP = 100


def _cases(spark, d):
    return read(spark, d, "contamination_calibration").where("candidate_prompt is not null").select(F.col("case_id").alias("qid"), F.col("candidate_prompt").alias("text")).distinct()


def _prompts(spark, d):
    return read(spark, d, "candidates").where("user_prompt is not null").select(F.col("example_id").alias("id"), F.col("user_prompt").alias("text")).distinct()


def _asking(key: str):
    return F.regexp_extract(key, r"(\d+)$", 1).cast("long") % STEP == 0


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(
    f"""with q as (select distinct case_id as qid, {_TOKENS.format('candidate_prompt')} as t from contamination_calibration where candidate_prompt is not null and try_cast(regexp_extract(case_id, '(\\d+)$', 1) as bigint) % {STEP} = 0),
    c as (select distinct example_id as id, {_TOKENS.format('user_prompt')} as t from candidates where user_prompt is not null),
    s as (select qid, id, len(list_intersect(q.t, c.t)) as shared, round(len(list_intersect(q.t, c.t)) / len(list_distinct(list_concat(q.t, c.t))), 6) as score from q, c where len(list_intersect(q.t, c.t)) > 0)
    select qid, id, shared, score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 5"""
)
def prompt_jaccard_top5(spark, d):
    """The five candidate prompts nearest by tokens to every hundredth calibration prompt."""
    return R.jaccard_neighbours(_cases(spark, d).where(_asking("qid")), _prompts(spark, d), word_tokens(F.col("text")), 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with c as (select doc_id as id, {_TOKENS.format('text')} as t from documents where text is not null), q as (select id as qid, t from c where id % {STEP} = 0),
    s as (select qid, id, len(list_intersect(q.t, c.t)) as shared, round(len(list_intersect(q.t, c.t)) / len(list_distinct(list_concat(q.t, c.t))), 6) as score from q, c where len(list_intersect(q.t, c.t)) > 0)
    select qid, id, shared, score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 5"""
)
def document_jaccard_top5(spark, d):
    """The five documents nearest by tokens to every hundredth document, itself among them."""
    docs = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return R.jaccard_neighbours(docs.where(F.col("id") % STEP == 0).withColumnRenamed("id", "qid"), docs, word_tokens(F.col("text")), 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with q as (select distinct case_id as qid, {norm_sql('candidate_prompt')} as k from contamination_calibration where candidate_prompt is not null),
    c as (select distinct example_id as id, {norm_sql('user_prompt')} as k from candidates where user_prompt is not null) select distinct qid, id from q join c using (k) where k != ''"""
)
def prior_exact_matches(spark, d):
    """Calibration prompts that are candidate prompts, but for case and white space."""
    return R.exact_matches(_cases(spark, d), _prompts(spark, d))


_SHINGLES = f"regexp_extract_all({norm_sql('x')}, '[a-z0-9]+(?:''[a-z0-9]+)?')"


@query(
    f"""with a as (select distinct case_id, candidate_prompt as x from contamination_calibration where candidate_prompt is not null), b as (select distinct user_prompt as x from candidates where user_prompt is not null),
    sa as (select distinct case_id, array_to_string(w[i : i + 7], ' ') as s from (select case_id, {_SHINGLES} as w from a) t, unnest(generate_series(1, len(w) - 7)) as g(i) where len(w) >= 8),
    sb as (select distinct array_to_string(w[i : i + 7], ' ') as s from (select {_SHINGLES} as w from b) t, unnest(generate_series(1, len(w) - 7)) as g(i) where len(w) >= 8)
    select case_id, count(*) as shared from sa semi join sb using (s) group by case_id"""
)
def eight_gram_overlap(spark, d):
    """How many eight-word phrases of each calibration prompt occur in candidate prompts."""
    asked = phrases(_cases(spark, d), ["qid"], "text", 8, "s")
    return asked.join(phrases(_prompts(spark, d), [], "text", 8, "s"), "s", "left_semi").groupBy(F.col("qid").alias("case_id")).agg(F.count("*").alias("shared"))


_FIELDS = {"topic": "metadata.topic", "goal": "metadata.user_goal", "artefact": "metadata.requested_task_or_artefact", "summary": "metadata.scenario_summary"}


@query(
    f"""with m as (select distinct example_id as id, f, {norm_sql('v')} as v from (select example_id, unnest([{{'f': 'topic', 'v': [metadata.topic]}}, {{'f': 'goal', 'v': [metadata.user_goal]}}, {{'f': 'artefact', 'v': [metadata.requested_task_or_artefact]}},
        {{'f': 'summary', 'v': [metadata.scenario_summary]}}, {{'f': 'constraints', 'v': metadata.important_constraints}}]) as x from candidates) t, (select x.f as f, unnest(x.v) as v)),
    k as (select * from m where v is not null and v != ''), s as (select a.id as qid, b.id, count(distinct a.f) as score from k a join k b using (f, v) where try_cast(regexp_extract(a.id, '(\\d+)$', 1) as bigint) % {STEP} = 0 group by 1, 2)
    select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 5"""
)
def metadata_top5(spark, d):
    """The five examples that share most metadata fields with every hundredth example, itself among them."""
    fields = {k: F.array(F.col(v)) for k, v in _FIELDS.items()} | {"constraints": F.col("metadata.important_constraints")}
    rows = read(spark, d, "candidates").select(F.col("example_id").alias("id"), *[c.alias(k) for k, c in fields.items()])
    return R.metadata_neighbours(rows.where(_asking("id")).withColumnRenamed("id", "qid"), rows, list(fields), 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with s as (select q.vec_id as qid, e.vec_id as id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings q, embeddings e where q.vec_id % {STEP} = 0 and q.vec_id != e.vec_id)
    select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 5"""
)
def semantic_top5(spark, d):
    """The five vectors nearest to every hundredth vector."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.vector_neighbours(e.where(F.col("id") % STEP == 0).withColumnRenamed("id", "qid"), e, 5).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with q as (select distinct case_id as qid, {norm_sql('candidate_prompt')} as k, regexp_extract_all({norm_sql('candidate_prompt')}, '[a-z0-9]+(?:''[a-z0-9]+)?') as w from contamination_calibration where candidate_prompt is not null),
    c as (select distinct example_id as id, {norm_sql('user_prompt')} as k, regexp_extract_all({norm_sql('user_prompt')}, '[a-z0-9]+(?:''[a-z0-9]+)?') as w from candidates where user_prompt is not null),
    sq as (select distinct qid, array_to_string(w[i : i + 11], ' ') as s from q, unnest(generate_series(1, len(w) - 11)) as g(i) where len(w) >= 12),
    sc as (select distinct id, array_to_string(w[i : i + 11], ' ') as s from c, unnest(generate_series(1, len(w) - 11)) as g(i) where len(w) >= 12),
    sig as (select qid, id, 'exact' as f from q join c using (k) where k != '' union select qid, id, 'phrase' from sq join sc using (s))
    select qid, id, string_agg(f, ',' order by f) as signals from sig group by qid, id"""
)
def merged_signals(spark, d):
    """Calibration prompts and candidate prompts that are equal or share a twelve-word phrase, with all signals."""
    q, c = _cases(spark, d), _prompts(spark, d)
    shared = phrases(q, ["qid"], "text", 12, "s").join(phrases(c, ["id"], "text", 12, "s"), "s")
    return R.merge_signals({"exact": R.exact_matches(q, c), "phrase": shared.select("qid", "id").distinct()})


@query(
    """select case when a is null or b is null or c is null then 'uncertain' when a and b and c then 'reject' else 'allow' end as decision, count(*) as n
    from (select underlying_answer_quality >= 2 as a, metaphorical_coherence >= 2 as b, full_qualitative_pass as c from scores) group by 1"""
)
def collision_decision(spark, d):
    """Three-valued decisions over the scores."""
    a, b, c = F.col("underlying_answer_quality") >= 2, F.col("metaphorical_coherence") >= 2, F.col("full_qualitative_pass")
    return read(spark, d, "scores").groupBy(R.decide(a, b, c).alias("decision")).agg(F.count("*").alias("n"))


@query(
    """with l as (select distinct example_id, scenario_id, recorded_at from candidates), r as (select scenario_id as k, planned_at as t, slot_id from production_matrix where scenario_id is not null and planned_at is not null)
    select l.example_id, l.scenario_id, count(r.slot_id) as earlier, arg_max(r.slot_id, {'t': r.t, 's': r.slot_id}) as last_slot from l left join r on r.k = l.scenario_id and r.t <= l.recorded_at group by l.example_id, l.scenario_id, l.recorded_at"""
)
def eligible_as_of(spark, d):
    """For every example the slots of its scenario planned before it was recorded: how many, and the last one."""
    left = read(spark, d, "candidates").select("example_id", "scenario_id", "recorded_at").distinct()
    right = read(spark, d, "production_matrix").select("scenario_id", F.col("planned_at").alias("recorded_at"), "slot_id")
    return R.as_of(left, right, "scenario_id", "recorded_at", "slot_id").select("example_id", "scenario_id", "earlier", F.col("last").alias("last_slot"))


@query()
def case_token_ratio(spark, d):
    """Token ratio and sequence ratio of the two prompts of every calibration case, and the flag they raise."""
    k = read(spark, d, "contamination_calibration").select("case_id", "existing_prompt", "candidate_prompt").distinct().where("existing_prompt is not null and candidate_prompt is not null")
    a, b = normalize(F.col("existing_prompt")), normalize(F.col("candidate_prompt"))
    scored = k.select("case_id", F.round(R.token_ratios(a, b), 6).alias("token_ratio"), F.round(R.sequence_ratios(a, b), 6).alias("sequence_ratio"))
    return scored.withColumn("flagged", F.col("sequence_ratio") >= 0.82)
