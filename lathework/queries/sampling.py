"""Seeded schedules and samples, and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import derive_seed, hash_order
from ..operators import allocation as A
from ..operators import sampling as S
from . import query, read

SEED = 20260715


_ORDER_SEED = S.derived(SEED, "execution-order")


@query(
    f"""with p as (select distinct case_id as prompt_id from contamination_calibration), e as (select prompt_id, s as system_id, r as repeat_index from p, (select unnest(['A', 'B', 'C', 'D']) as s), (select unnest([0, 1]) as r))
    select prompt_id, system_id, repeat_index, cast(('0x' || left(sha256('{{"namespace":"generation","parts":[{SEED},"' || prompt_id || '",' || repeat_index || ']}}'), 16))::ubigint as varchar) as generation_seed,
    row_number() over (order by sha256('{{"namespace":"execution-order-key","parts":[{_ORDER_SEED},"' || prompt_id || '","' || system_id || '",' || repeat_index || ']}}'), prompt_id, system_id, repeat_index) - 1 as attempt_index from e"""
)
def schedule_attempts(spark, d):
    """Four systems twice over every calibration case, in seeded order, with generation seeds as text."""
    prompts = read(spark, d, "contamination_calibration").select(F.col("case_id").alias("prompt_id"))
    return S.schedule(prompts, ["A", "B", "C", "D"], 2, SEED).withColumn("generation_seed", F.col("generation_seed").cast("string"))


@query("""select distinct example_id, cast(('0x' || left(sha256('{"namespace":"generation","parts":[20260714,"' || example_id || '",1]}'), 16))::ubigint as varchar) as seed from candidates""")
def generation_seeds(spark, d):
    """A 64-bit unsigned seed of every example, as text."""
    seed = derive_seed("generation", F.lit("20260714"), F.concat(F.lit('"'), "example_id", F.lit('"')), F.lit("1"))
    return read(spark, d, "candidates").select("example_id").distinct().select("example_id", seed.cast("string").alias("seed"))


@query(f"select doc_id from documents order by sha256(concat_ws('|', 'accepted-audit-v1', '{SEED}', cast(doc_id as varchar))) limit 6")
def audit_sample6(spark, d):
    """Six documents to audit: the sample is the feature."""
    return S.smallest(read(spark, d, "documents"), hash_order("accepted-audit-v1", SEED, F.col("doc_id").cast("string")), 6).select("doc_id")


_STRATA = f"""with k as (select doc_id, kind, source, sha256(concat_ws('|', 'stratified-v1', '{SEED}', cast(doc_id as varchar))) as k from documents),
    f as (select *, case when row_number() over (partition by kind, source order by k) <= 2 then 1 else 2 end as phase from k), t as (select *, row_number() over (partition by kind order by phase, k) as t from f)
    select doc_id, kind, source, phase from t where phase = 1 or t <= 60"""


@query(_STRATA)
def calibration_stratified(spark, d):
    """Two documents of every source of a kind, then filled to 60 within the kind."""
    return S.stratified(read(spark, d, "documents"), "doc_id", "kind", "source", 2, 60, SEED)


@query(
    f"""with p as (select distinct case_id from contamination_calibration), r as (select case_id, row_number() over (order by sha256(concat_ws('|', 'pairwise-order-v1', '{SEED}', case_id)), case_id) as position, count(*) over () as n from p)
    select case_id, position, case when position <= floor(n / 2) then 'B' else 'C' end as response_a, case when position <= floor(n / 2) then 'C' else 'B' end as response_b from r"""
)
def pair_counterbalance(spark, d):
    """Which of two systems each case shows first: either half the cases."""
    return S.counterbalance(read(spark, d, "contamination_calibration"), "case_id", "B", "C", SEED)


@query(f"select blind_id, 'packet-' || left(sha256(concat_ws('|', 'blind-v1', '{SEED}', blind_id)), 12) as packet_id from (select distinct blind_id from packets)")
def blind_packets(spark, d):
    """Blind names of the packets, from a digest."""
    return read(spark, d, "packets").select("blind_id").distinct().select("blind_id", F.concat(F.lit("packet-"), F.substring(hash_order("blind-v1", SEED, F.col("blind_id")), 1, 12)).alias("packet_id"))


@query()
def pilot_greedy(spark, d):
    """Eight examples of every intent family that cover most metadata labels."""
    m = read(spark, d, "candidates").where("metadata.intent_family is not null")
    labels = F.array_compact(F.array(F.concat(F.lit("slice:"), "metadata.coverage_slice"), F.concat(F.lit("form:"), "metadata.input_form"), F.concat(F.lit("complexity:"), "metadata.complexity"), F.concat(F.lit("topic:"), "metadata.topic"), F.concat(F.lit("subtype:"), "metadata.task_subtype")))
    rows = m.select("example_id", F.col("metadata.intent_family").alias("family"), labels.alias("labels")).dropDuplicates(["example_id"])
    return A.greedy_cover(rows, "family", "example_id", "labels", 8, SEED)
