"""Coverage, quotas, overlays, chains and run logs over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.render import packet_name, rendered
from ..functions.strictjson import checked_response
from ..operators import contracts as C
from ..operators.evaluation import structural_summary
from . import query, read

_DIMENSIONS = {
    "intent_family": "metadata.intent_family",
    "coverage_slice": "metadata.coverage_slice",
    "input_form": "metadata.input_form",
    "complexity": "metadata.complexity",
    "robustness_role": "metadata.robustness_role",
    "topic": "metadata.topic",
}
_LATEST = "(select * from candidates qualify row_number() over (partition by example_id order by ingested_at desc nulls last) = 1)"


def _latest(spark, d):
    return C.latest_by(read(spark, d, "candidates"), ["example_id"], [F.col("ingested_at").desc_nulls_last()])


@query(" union all ".join(f"select '{k}' as dimension, coalesce(cast({v} as varchar), 'null') as value, count(*) as n from {_LATEST} group by 2" for k, v in _DIMENSIONS.items()))
def coverage_report(spark, d):
    """Examples by every value of six dimensions, each example counted once."""
    return C.coverage(_latest(spark, d), {k: F.col(v) for k, v in _DIMENSIONS.items()})


@query(
    f"""select metadata.intent_family as family, metadata.coverage_slice as slice, metadata.input_form as form, count(*) as n from {_LATEST}
    group by grouping sets ((metadata.intent_family, metadata.coverage_slice), (metadata.intent_family, metadata.input_form), (metadata.intent_family))"""
)
def coverage_grouping_sets(spark, d):
    """Examples by family and slice, family and form, and family."""
    m = _latest(spark, d).select(F.col("metadata.intent_family").alias("family"), F.col("metadata.coverage_slice").alias("slice"), F.col("metadata.input_form").alias("form"))
    return m.groupingSets([["family", "slice"], ["family", "form"], ["family"]], "family", "slice", "form").agg(F.count("*").alias("n"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")


@query(
    f"""with t as (select unnest([{', '.join(f"'{p}'" for p in _PRIORITIES)}]) as priority, 3000 as wanted), a as (select o_orderpriority as priority, count(*) as n from orders group by 1)
    select priority, cast(coalesce(wanted, 0) as bigint) as wanted, coalesce(n, 0) as n, coalesce(n, 0) - cast(coalesce(wanted, 0) as bigint) as gap from t full join a using (priority) where coalesce(n, 0) != coalesce(wanted, 0)"""
)
def quota_violations(spark, d):
    """Order priorities whose counts miss a quota of 3,000."""
    target = spark.createDataFrame([(p, 3000) for p in _PRIORITIES], "priority string, wanted long")
    return C.quota_gaps(read(spark, d, "orders").select(F.col("o_orderpriority").alias("priority")), target, ["priority"])


@query("select b as p_brand, s as p_size from (select distinct p_brand as b from part), (select distinct p_size as s from part) where (b, s) not in (select (p_brand, p_size) from part)")
def coverage_matrix_missing(spark, d):
    """Combinations of brand and size without a part."""
    return C.missing_combinations(read(spark, d, "part"), ["p_brand", "p_size"])


_NAME = "trim(regexp_replace(lower(regexp_extract(evaluator, '^([^,;]*)', 1)), '\\s+', ' ', 'g'))"


@query(
    f"""with s as (select *, {_NAME} as name from scores), k as (select *, row_number() over (partition by blind_id, name order by recorded_at desc nulls last, score_id desc) as r from s)
    select name, count(*) as kept, count(*) filter (where full_qualitative_pass) as passes from k where r = 1 group by name"""
)
def amendment_overlay(spark, d):
    """Scores by evaluator after every score an evaluator later replaced has left."""
    name = F.trim(F.regexp_replace(F.lower(F.regexp_extract("evaluator", r"^([^,;]*)", 1)), r"\s+", " "))
    s = read(spark, d, "scores").select("score_id", "blind_id", name.alias("name"), "full_qualitative_pass", "recorded_at")
    last = C.latest_by(s, ["blind_id", "name"], [F.col("recorded_at").desc_nulls_last(), F.col("score_id").desc()])
    # the last score amends all before it
    before = s.join(last.select("blind_id", "name", F.col("score_id").alias("last_id")), ["blind_id", "name"]).where("score_id != last_id")
    amendments = last.join(before.select("blind_id", "name", F.col("score_id").alias("replaces")), ["blind_id", "name"]).select(*s.columns, "replaces")
    active = C.overlay(s, amendments, "score_id", "replaces").dropDuplicates(["score_id"])
    return active.groupBy("name").agg(F.count("*").alias("kept"), F.count_if("full_qualitative_pass").alias("passes"))


@query("select blind_id, count(*) - 1 as extra from identity_mapping group by mapping_schema_version, blind_id, source_label, source_run_id, attempt_index, prompt_id, system_id, raw_output_sha256 having count(*) > 1")
def projection_equality(spark, d):
    """Rows a mapping has more often than its distinct projection."""
    m = read(spark, d, "identity_mapping")
    more = C.multiset_difference(m, m.distinct()).where("side = 'left'").drop("side")
    return more.groupBy(*more.columns).agg(F.count("*").alias("extra")).select("blind_id", "extra")


@query("with p as (select distinct blind_id from packets), m as (select distinct blind_id from identity_mapping) select coalesce(p.blind_id, m.blind_id) as blind_id, case when p.blind_id is null then 'left' else 'right' end as lacks from p full join m on p.blind_id = m.blind_id where p.blind_id is null or m.blind_id is null")
def blind_key_differences(spark, d):
    """Packets without mapping and mappings without packet."""
    return C.key_differences(read(spark, d, "packets"), read(spark, d, "identity_mapping"), "blind_id")


@query("select distinct p.blind_id, m.raw_output_sha256 is null as unknown from packets p join identity_mapping m using (blind_id) where m.raw_output_sha256 is distinct from sha256(p.candidate_response)")
def digest_mismatches(spark, d):
    """Packets whose response isn't the one their mapping's digest names, or names none."""
    p, m = read(spark, d, "packets").select("blind_id", F.sha2("candidate_response", 256).alias("own")), read(spark, d, "identity_mapping").select("blind_id", "raw_output_sha256")
    return p.join(m, "blind_id").where(~F.col("raw_output_sha256").eqNullSafe(F.col("own"))).select("blind_id", F.col("raw_output_sha256").isNull().alias("unknown")).distinct()


_EVENTS = """with o as (select user_id, event_type, ts, event_id, coalesce(max(cast(event_type = 'purchase' as int)) over (w rows between unbounded preceding and 1 preceding), 0) as late,
    coalesce(cast(lag(event_type) over w = event_type as int), 0) as same, coalesce(cast(lag(ts) over w > ts as int), 0) as back from events window w as (partition by user_id order by {}))
    select user_id, count(*) as events, cast(sum(late) as bigint) as after_terminal, cast(sum(same) as bigint) as repeats, cast(sum(back) as bigint) as reversals, arg_max(event_type, {}) as last from o group by user_id"""


@query(_EVENTS.format("ts, event_id", "{'a': ts, 'b': event_id}"))
def event_chain_violations(spark, d):
    """Each user's chain of events by time: what follows a purchase, repeats its predecessor, and the last kind."""
    return C.chain_report(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "ts", ["purchase"])


@query(_EVENTS.format("event_id", "event_id"))
def event_log_order(spark, d):
    """The same chains in the order of the log, where time may step back."""
    return C.chain_report(read(spark, d, "events"), "user_id", ["event_id"], "event_type", "ts", ["purchase"])


@query(
    """with p as (select source_run_id, attempt_index, count(*) as c from identity_mapping where source_run_id is not null and attempt_index is not null group by 1, 2)
    select source_run_id, cast(sum(c) as bigint) as attempts, cast(max(attempt_index) as bigint) as expected, cast(max(attempt_index) - count(*) as bigint) as missing, cast(sum(case when c > 1 then 1 else 0 end) as bigint) as repeated from p group by 1"""
)
def run_inspection(spark, d):
    """Missing and repeated attempts of every run."""
    return C.run_report(read(spark, d, "identity_mapping"), "source_run_id", "attempt_index")


@query("select sha256(text) as identity, count(distinct lang) as values from documents where text is not null group by 1 having count(distinct lang) > 1")
def asset_history_conflicts(spark, d):
    """Texts that occur under more than one language label."""
    return C.conflicting_identities(read(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("identity"), "lang"), "identity", "lang")


@query(
    """with r as (select user_id, case when event_type = 'click' then 1 when event_type = 'view' then 2 when event_type = 'signup' then 3 end as stage, case when value >= 50 then 'reject' else 'allow' end as decision from events),
    p as (select user_id, min(case when stage = 1 then decision end) as "primary", min(case when stage = 2 then decision end) as second, min(case when stage = 3 then decision end) as adjudicated from r group by 1)
    select *, case when "primary" = second then "primary" else coalesce(adjudicated, 'open') end as outcome from p"""
)
def review_adjudication(spark, d):
    """Two reviews and an adjudication of every user, made of their events."""
    stage = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "signup", 3)
    rows = read(spark, d, "events").select("user_id", stage.alias("stage"), F.when(F.col("value") >= 50, "reject").otherwise("allow").alias("decision"))
    return C.adjudicate(rows, "user_id", "decision", "stage")


@query(
    """with s as (select unnest([{'k': 'candidates', 'p': user_prompt}]) as x from candidates union all select {'k': 'packets', 'p': user_prompt} from packets union all select {'k': 'calibration', 'p': candidate_prompt} from contamination_calibration)
    select x.k as collection, count(*) as rows, count(distinct x.p) as prompts from s group by 1"""
)
def mixed_schema_union(spark, d):
    """Prompts of three collections with different columns, by collection."""
    parts = [
        read(spark, d, "candidates").select(F.lit("candidates").alias("collection"), "user_prompt"),
        read(spark, d, "packets").select(F.lit("packets").alias("collection"), "user_prompt"),
        read(spark, d, "contamination_calibration").select(F.lit("calibration").alias("collection"), F.col("candidate_prompt").alias("prompt")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("collection").agg(F.count("*").alias("rows"), F.countDistinct(F.coalesce("prompt", "user_prompt")).alias("prompts"))


@query(
    """with b as (select cast(floor(n_nationkey / 4) as int) as b, sha256(string_agg(n_nationkey || '|' || n_name || chr(10), '' order by n_nationkey)) as d, count(*) as n from nation group by 1)
    select cast(sum(n) as bigint) as lines, sha256(string_agg(d, '' order by b)) as sha256 from b"""
)
def nation_digest(spark, d):
    """The digest of the nations in order, by blocks of four."""
    lines = read(spark, d, "nation").select("n_nationkey", F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    return C.collection_digest(lines, "n_nationkey", "line", block=4)


def _checked(spark, d):
    p = read(spark, d, "packets").select("blind_id", "candidate_response").distinct()
    return p.select("blind_id", checked_response("candidate_response").alias("c")).select("blind_id", "c.*")


@query()
def strict_json_validation(spark, d):
    """Every packet's response: strict JSON or not, the contract kept or not, all failure labels in order."""
    return _checked(spark, d).select("blind_id", "json_valid", "schema_valid", F.array_join("failure_labels", ",").alias("labels"), "characters", "ingredients", "method_steps")


@query(
    """with p as (select distinct blind_id, candidate_response as r from packets), j as (select blind_id, r, coalesce(json_valid(r) and not regexp_matches(r, ',\\s*[]}]'), false) as json_valid from p),
    o as (select *, case when json_valid then json(r) end as j from j)
    select blind_id, json_valid, len(r) as characters, case when json_type(j, '$.ingredients') = 'ARRAY' then cast(json_array_length(j, '$.ingredients') as int) end as ingredients,
    case when json_type(j, '$.method') = 'ARRAY' then cast(json_array_length(j, '$.method') as int) end as method_steps from o"""
)
def response_shapes(spark, d):
    """Whether each response is strict JSON, and how many ingredients and steps it lists."""
    return _checked(spark, d).select("blind_id", "json_valid", "characters", "ingredients", "method_steps")


@query()
def structural_report(spark, d):
    """Strict and contract validity and label counts by source."""
    m = read(spark, d, "identity_mapping").groupBy("blind_id").agg(F.min(F.lower(F.trim("source_label"))).alias("source"))
    rows = structural_summary(_checked(spark, d).join(m, "blind_id", "left"), "source")
    return rows.withColumn("labels", F.to_json("labels"))


@query(
    """with recursive s as (select batch_id, slot_id, min(example_id) as content from production_matrix where batch_id is not null and slot_id is not null group by 1, 2),
    o as (select *, row_number() over (partition by batch_id order by slot_id) as r from s),
    c as (select batch_id, slot_id, content, r, repeat('0', 64) as previous_sha256, sha256(repeat('0', 64) || '|' || coalesce(content, '')) as entry_sha256 from o where r = 1
        union all select o.batch_id, o.slot_id, o.content, o.r, c.entry_sha256, sha256(c.entry_sha256 || '|' || coalesce(o.content, '')) from c join o on o.batch_id = c.batch_id and o.r = c.r + 1)
    select batch_id, slot_id, content, previous_sha256, entry_sha256 from c"""
)
def ledger_chain(spark, d):
    """A hash chain over the slots of every batch of the production matrix."""
    slots = read(spark, d, "production_matrix").where("slot_id is not null and batch_id is not null").groupBy("batch_id", "slot_id").agg(F.min("example_id").alias("content"))
    return C.ledger(slots, "batch_id", "slot_id", "content")


@query()
def rendered_packets(spark, d):
    """Digests of every response's reading form and similarity view."""
    p = read(spark, d, "packets").where("candidate_response is not null").select("blind_id", "candidate_response").distinct()
    r = p.select("blind_id", rendered("candidate_response").alias("r"))
    return r.select("blind_id", F.sha2("r.reading", 256).alias("reading_sha256"), F.sha2("r.view", 256).alias("view_sha256"))


@query("select blind_id, prompt_id, 'qual-packet-v1-' || left(sha256(concat_ws('|', 'qualitative-packet-v1', system_id, prompt_id, blind_id)), 24) as packet_id from (select distinct blind_id, prompt_id, system_id from identity_mapping where system_id is not null and prompt_id is not null)")
def packet_names(spark, d):
    """Names of judgment packets, from system, prompt and response."""
    m = read(spark, d, "identity_mapping").where("system_id is not null and prompt_id is not null").select("blind_id", "prompt_id", "system_id").distinct()
    return m.select("blind_id", "prompt_id", packet_name("qual-packet-v1", "qualitative-packet-v1", F.col("system_id"), F.col("prompt_id"), F.col("blind_id")).alias("packet_id"))
