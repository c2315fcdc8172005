"""Records against their contract, crossed quotas, content identity, manifests and prompt assembly over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.prompts import assembled, local_seed
from ..functions.text import derive_seed, digest, normalize, word_tokens
from ..operators import contracts as C
from ..operators import records as R
from ..operators import retrieval as N
from . import norm_sql, query, read

_SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_LATEST = "(select * from {} qualify row_number() over (partition by {} order by ingested_at desc nulls last) = 1)"


def _latest(spark, d, table, key):
    return C.latest_by(read(spark, d, table), [key], [F.col("ingested_at").desc_nulls_last()])


def _names(xs):
    return ", ".join(f"'{x}'" for x in xs)


def _trimmed(x):
    return rf"(not regexp_matches({x}, '^{_SPACE}|{_SPACE}$') and {x} != '')"


def _every(xs, test):
    return f"(len(list_filter({xs}, lambda x: coalesce({test}, false))) = len({xs}))"


def _slot_sql(m=""):
    """records.slot_rules in SQL."""
    s, k = f"{m}complexity_sources", f"{m}important_constraints"
    pairs = ", ".join(f"({m}intent_family = '{f}' and {m}task_subtype in ({_names(ss)}))" for f, ss in R.SUBTYPES.items()).replace("), (", ") or (")
    return {
        "family": f"{m}intent_family in ({_names(R.SUBTYPES)})",
        "subtype": pairs,
        "slice": f"{m}coverage_slice in ({_names(R.SLICES)})",
        "form": f"{m}input_form in ({_names(R.FORMS)})",
        "complexity": f"{m}complexity in ({_names(R.COMPLEXITIES)})",
        "sources": f"{_every(s, f'x in ({_names(R.SOURCES)})')} and len({s}) = len(list_distinct({s}))",
        "robustness": f"case when {m}coverage_slice = 'robustness' then {m}complexity = 'composed' and list_contains({s}, 'robustness_pressure') and coalesce({m}robustness_role in ({_names(R.ROLES)}), false) else {m}robustness_role is null and not list_contains({s}, 'robustness_pressure') end",
        "standard": f"case when {m}complexity = 'standard' then len({s}) = 0 and not {m}constraint_bearing and len({k}) = 0 else len({s}) > 0 end",
        "constraint": f"case when {m}constraint_bearing then {m}complexity = 'composed' and list_contains({s}, 'ordinary_content_constraint') and len({k}) > 0 else len({k}) = 0 end",
        "constraints_trimmed": _every(k, _trimmed("x")),
        "summary_trimmed": _trimmed(f"{m}scenario_summary"),
    }


def _violations_sql(rules):
    return "array_to_string(list_filter([" + ", ".join(f"case when coalesce({ok}, false) then null else '{name}' end" for name, ok in rules.items()) + "], lambda x: x is not null), ',')"


_ID = "regexp_full_match({}, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}')"
_MODELS = sorted({x for m in R.PROHIBITED_MODELS for x in (m.lower(), m.rsplit("/", 1)[-1].lower())})
_A, _P = "assistant_response", "provenance"
_EXAMPLE_SQL = {
    "id": _ID.format("example_id"),
    "prompt_trimmed": _trimmed("user_prompt"),
    "title_trimmed": _trimmed(f"{_A}.title"),
    "garnish_trimmed": _trimmed(f"{_A}.garnish"),
    "method_trimmed": _every(f"{_A}.method", _trimmed("x")),
    "ingredients_trimmed": _every(f"{_A}.ingredients", f"{_trimmed('x.unit')} and {_trimmed('x.name')}"),
    "amounts_positive": _every(f"{_A}.ingredients", "x.amount > 0"),
    "ingredient_count": f"len({_A}.ingredients) between 3 and 8",
    "method_count": f"len({_A}.method) between 2 and 5",
    "pilot_in_train": rf"case when pilot_member then coalesce(lower(regexp_replace(split, '^{_SPACE}+|{_SPACE}+$', '', 'g')) = 'train', false) else true end",
    "draft_model": f"case when {_P}.initial_draft_source = 'human' then {_P}.initial_draft_model_id is null else coalesce({_trimmed(f'{_P}.initial_draft_model_id')}, false) end",
    "model_allowed": f"not coalesce(lower({_P}.initial_draft_model_id) in ({_names(_MODELS)}) or lower(regexp_extract({_P}.initial_draft_model_id, '([^/]*)/*$', 1)) in ({_names(_MODELS)}), false)",
    **_slot_sql("metadata."),
    "goal_trimmed": _trimmed("metadata.user_goal"),
    "artefact_trimmed": _trimmed("metadata.requested_task_or_artefact"),
}


@query(f"select distinct example_id, {_violations_sql(_EXAMPLE_SQL)} as violations from candidates where {_violations_sql(_EXAMPLE_SQL)} != ''")
def example_violations(spark, d):
    """Examples that break a rule of their contract, and all rules they break, in order."""
    rows = C.violations(read(spark, d, "candidates"), R.example_rules())
    return rows.where(F.size("violations") > 0).select("example_id", F.array_join("violations", ",").alias("violations")).distinct()


@query(f"select distinct slot_id, {_violations_sql(_slot_sql())} as violations from production_matrix where {_violations_sql(_slot_sql())} != ''")
def slot_violations(spark, d):
    """Planned slots that break a rule of their metadata."""
    rows = C.violations(read(spark, d, "production_matrix"), R.slot_rules())
    return rows.where(F.size("violations") > 0).select("slot_id", F.array_join("violations", ",").alias("violations")).distinct()


_ATTEMPT_SQL = {
    "blind_id": _ID.format("m.blind_id"),
    "run": _ID.format("source_run_id"),
    "prompt": _ID.format("prompt_id"),
    "system": "system_id in ('A', 'B', 'C', 'D')",
    "index": "attempt_index >= 0",
    "digest_form": "regexp_full_match(raw_output_sha256, '[0-9a-f]{64}')",
    "digest": "raw_output_sha256 = sha256(output)",
}


@query(f"select distinct m.blind_id, source_run_id, {_violations_sql(_ATTEMPT_SQL)} as violations from identity_mapping m left join (select distinct blind_id, candidate_response as output from packets) p on p.blind_id = m.blind_id where {_violations_sql(_ATTEMPT_SQL)} != ''")
def attempt_violations(spark, d):
    """Attempts that break a rule of their record, the digest of the output as stored among them."""
    outputs = read(spark, d, "packets").select("blind_id", F.col("candidate_response").alias("output")).distinct()
    rows = C.violations(read(spark, d, "identity_mapping").join(outputs, "blind_id", "left"), R.attempt_rules())
    return rows.where(F.size("violations") > 0).select("blind_id", "source_run_id", F.array_join("violations", ",").alias("violations")).distinct()


_VALUES = ", ".join(f"('{f}', '{s}')" for f, ss in R.SUBTYPES.items() for s in ss)


@query(f"select distinct slot_id, intent_family, task_subtype from production_matrix where intent_family is null or task_subtype is null or (intent_family, task_subtype) not in (values {_VALUES})")
def registry_misses(spark, d):
    """Planned slots whose family and subtype are no pair of the registry."""
    registry = spark.createDataFrame([(f, s) for f, ss in R.SUBTYPES.items() for s in ss], "intent_family string, task_subtype string")
    return C.outside_registry(read(spark, d, "production_matrix").select("slot_id", "intent_family", "task_subtype"), registry, ["intent_family", "task_subtype"]).distinct().select("slot_id", "intent_family", "task_subtype")


# The numbers of records per family that each axis must have, and bounds of topics and subtypes.
_AXES = {
    "slice": ("coverage_slice", {"target_use": 28, "breadth": 6, "robustness": 6}),
    "form": ("input_form", {"direct_request_or_command": 20, "question": 10, "statement_or_fragment": 10}),
    "complexity": ("complexity", {"composed": 16, "standard": 24}),
    "constraint": ("constraint_bearing", {"true": 12, "false": 28}),
    "role": ("robustness_role", {"behaviour_pressure": 2, "format_pressure": 2, "serialization_pressure": 2, "null": 34}),
}
_TOPIC_MOST, _SUBTYPE_MOST = 20, 10
# The held-out set's numbers per family.
_HELDOUT = {"slice": {"target_use": 6, "breadth": 3, "robustness": 3}, "complexity": {"composed": 4, "standard": 8}}


def _bounds_sql(axes, source):
    cells = [f"('{name}', '{f}|{v}', {n}, {n})" for name, (_, wanted) in axes.items() for f in R.SUBTYPES for v, n in wanted.items()]
    counts = " union all ".join(f"select '{name}' as quota, coalesce(family, 'null') || '|' || coalesce(cast({c} as varchar), 'null') as value, count(*) as n from s group by 2" for name, (c, _) in axes.items())
    return f"with s as ({source}), a as ({counts}), t(quota, value, least, most) as (values {', '.join(cells)})"


_GAPS = " select quota, value, coalesce(n, 0) as n, cast(coalesce(least, 0) as bigint) as least, cast(coalesce(most, 0) as bigint) as most from a full join t using (quota, value) where coalesce(n, 0) not between coalesce(least, 0) and coalesce(most, 0)"


@query(_bounds_sql(_AXES, f"select metadata.intent_family as family, unnest(metadata) from {_LATEST.format('candidates', 'example_id')}") + _GAPS)
def family_quota_gaps(spark, d):
    """Cells of family by slice, form, complexity, constraint and role whose numbers of examples miss the contract's."""
    rows = _latest(spark, d, "candidates", "example_id").select("metadata.*")
    quotas = {name: (["intent_family", c], {(f, v): (n, n) for f in R.SUBTYPES for v, n in wanted.items()}) for name, (c, wanted) in _AXES.items()}
    return C.crossed_quotas(rows, quotas)


@query(_bounds_sql({k: (_AXES[k][0], v) for k, v in _HELDOUT.items()}, f"select intent_family as family, * from {_LATEST.format('production_matrix', 'slot_id')}") + _GAPS)
def heldout_quota_gaps(spark, d):
    """Cells of family by slice and complexity whose numbers of planned slots miss the held-out set's."""
    quotas = {k: (["intent_family", _AXES[k][0]], {(f, v): (n, n) for f in R.SUBTYPES for v, n in wanted.items()}) for k, wanted in _HELDOUT.items()}
    return C.crossed_quotas(_latest(spark, d, "production_matrix", "slot_id"), quotas)


@query(
    f"""with s as (select metadata.intent_family as f, metadata.topic as t, metadata.task_subtype as u from {_LATEST.format('candidates', 'example_id')})
    select 'topic' as dimension, coalesce(t, 'null') as value, count(*) as n from s group by 2 having count(*) > {_TOPIC_MOST} union all select 'subtype', coalesce(f || '|' || u, 'null'), count(*) from s group by 2 having count(*) > {_TOPIC_MOST}"""
)
def topic_concentration(spark, d):
    """Topics and subtypes of a family that more examples have than a topic may."""
    rows = _latest(spark, d, "candidates", "example_id")
    return C.concentration(rows, {"topic": F.col("metadata.topic"), "subtype": F.concat(F.col("metadata.intent_family"), F.lit("|"), F.col("metadata.task_subtype"))}, _TOPIC_MOST)


@query("with s as (select distinct metadata.intent_family as family, metadata.robustness_role as role from candidates) select family, role from (select distinct family from s where family is not null), (select distinct role from s where role is not null) where (family, role) not in (select (family, role) from s where role is not null and family is not null)")
def family_role_gaps(spark, d):
    """Families without an example of a robustness role."""
    rows = read(spark, d, "candidates").select(F.col("metadata.intent_family").alias("family"), F.col("metadata.robustness_role").alias("role")).distinct()
    return C.missing_combinations(rows, ["family", "role"])


_META = ("complexity", "complexity_sources", "constraint_bearing", "coverage_slice", "important_constraints", "input_form", "intent_family", "requested_task_or_artefact", "robustness_role", "scenario_summary", "task_subtype", "topic", "user_goal")
_PROV = ("authoring_batch_id", "initial_draft_model_id", "initial_draft_source", "material_human_edit", "model_revision_used")
_CONTENT = (
    "to_json({'assistant_response': {'garnish': assistant_response.garnish, 'ingredients': list_transform(assistant_response.ingredients, lambda x: {'amount': x.amount, 'name': x.name, 'unit': x.unit}), 'method': assistant_response.method, 'title': assistant_response.title}, "
    "'example_id': example_id, 'metadata': {" + ", ".join(f"'{m}': metadata.{m}" for m in _META) + "}, 'provenance': {" + ", ".join(f"'{p}': provenance.{p}" for p in _PROV) + "}, 'record_schema_version': record_schema_version, 'scenario_id': scenario_id, 'user_prompt': user_prompt})"
)
_NOT_CONTENT = ["split", "pilot_member", "recorded_at", "ingested_at"]


@query(f"select distinct example_id, sha256({_CONTENT}) as content_sha256 from candidates")
def content_identity(spark, d):
    """The digest of every example's content: canonical JSON without split, pilot mark and the table's own times."""
    c = read(spark, d, "candidates")
    return c.select("example_id", digest(R.content_json(c, _NOT_CONTENT)).alias("content_sha256")).distinct()


@query(f"select example_id, count(distinct sha256({_CONTENT})) as contents from candidates group by 1 having count(distinct sha256({_CONTENT})) > 1")
def content_conflicts(spark, d):
    """Examples delivered with more than one content."""
    c = read(spark, d, "candidates")
    return C.conflicting_identities(c.select("example_id", digest(R.content_json(c, _NOT_CONTENT)).alias("x")), "example_id", "x").withColumnRenamed("values", "contents")


@query(
    """select example_id, sha256(to_json({'title': assistant_response.title, 'ingredients': list_transform(assistant_response.ingredients, lambda x: {'amount': x.amount, 'unit': x.unit, 'name': x.name}), 'method': assistant_response.method, 'garnish': assistant_response.garnish})) as target_sha256
    from candidates where lower(trim(split)) = 'train' group by all"""
)
def assistant_targets(spark, d):
    """Digests of the train examples' compact answers, fields in the contract's order."""
    r = F.col("assistant_response")
    parts = F.transform(r["ingredients"], lambda i: F.struct(i["amount"].alias("amount"), i["unit"].alias("unit"), i["name"].alias("name")))
    text = F.to_json(F.struct(r["title"].alias("title"), parts.alias("ingredients"), r["method"].alias("method"), r["garnish"].alias("garnish")), {"ignoreNullFields": "false"})
    return read(spark, d, "candidates").where(F.lower(F.trim("split")) == "train").select("example_id", digest(text).alias("target_sha256")).distinct()


@query("select example_id, sha256(concat_ws(chr(10), user_prompt, metadata.user_goal, metadata.scenario_summary, metadata.requested_task_or_artefact, array_to_string(metadata.important_constraints, ' '))) as view_sha256 from candidates group by all")
def scenario_text_view(spark, d):
    """Digests of the text views of every example's scenario: prompt, goal, summary, artefact, constraints."""
    m = F.col("metadata")
    view = F.concat_ws("\n", "user_prompt", m["user_goal"], m["scenario_summary"], m["requested_task_or_artefact"], F.array_join(m["important_constraints"], " "))
    return read(spark, d, "candidates").select("example_id", digest(view).alias("view_sha256")).distinct()


@query(
    f"""with s as (select distinct example_id, array_to_string(list_transform(assistant_response.ingredients, lambda x: cast(x.amount as varchar) || ' ' || {norm_sql('x.unit')}), '; ') as measures from candidates where assistant_response.ingredients is not null)
    select measures, count(distinct example_id) as n from s where measures is not null group by 1 having count(distinct example_id) >= 3"""
)
def repeated_measure_sequences(spark, d):
    """Sequences of amounts and units that three examples or more have."""
    parts = F.transform("assistant_response.ingredients", lambda i: F.concat(i["amount"].cast("string"), F.lit(" "), normalize(i["unit"])))
    rows = read(spark, d, "candidates").where("assistant_response.ingredients is not null").select("example_id", F.array_join(parts, "; ").alias("measures"))
    return rows.groupBy("measures").agg(F.countDistinct("example_id").alias("n")).where("n >= 3")


@query("select distinct example_id, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') as stamp, epoch(date_trunc('second', recorded_at))::bigint as second from candidates where recorded_at is not null")
def utc_stamps(spark, d):
    """Recording times as texts with an explicit Z, and read back."""
    rows = read(spark, d, "candidates").where("recorded_at is not null").select("example_id", F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")).distinct()
    return rows.select("example_id", "stamp", F.unix_timestamp(R.utc_instant(F.col("stamp"))).alias("second"))


@query("""select example_id, cast(cast(('0x' || left(sha256('{"namespace":"generation","parts":[20260714,"' || example_id || '",1]}'), 16))::ubigint as hugeint) % 2147483647 as bigint) as seed from (select distinct example_id from candidates)""")
def local_seeds(spark, d):
    """A 31-bit seed of every example for local runs."""
    seed = derive_seed("generation", F.lit("20260714"), F.concat(F.lit('"'), "example_id", F.lit('"')), F.lit("1"))
    return read(spark, d, "candidates").select("example_id").distinct().select("example_id", local_seed(seed).alias("seed"))


@query(
    """with m as (select distinct source_run_id, attempt_index, blind_id, prompt_id, system_id, raw_output_sha256 from identity_mapping where source_run_id is not null)
    select source_run_id, count(*) as attempts, count(distinct prompt_id) as prompts, count(distinct system_id) as systems, sha256(string_agg(coalesce(raw_output_sha256, ''), chr(10) order by attempt_index, blind_id, coalesce(raw_output_sha256, ''))) as outputs_sha256 from m group by 1"""
)
def run_manifests(spark, d):
    """Of every run its numbers of attempts, prompts and systems, and a digest over its outputs' digests in order."""
    m = read(spark, d, "identity_mapping").where("source_run_id is not null").select("source_run_id", "attempt_index", "blind_id", "prompt_id", "system_id", "raw_output_sha256").distinct()
    # a run's attempts are bounded by its schedule: 64 digits each
    line = F.struct("attempt_index", "blind_id", F.coalesce("raw_output_sha256", F.lit("")).alias("d"))
    outputs = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["d"]), "\n")
    return m.groupBy("source_run_id").agg(F.count("*").alias("attempts"), F.countDistinct("prompt_id").alias("prompts"), F.countDistinct("system_id").alias("systems"), digest(outputs).alias("outputs_sha256"))


@query(
    """with m as (select distinct blind_id, prompt_id, system_id from identity_mapping where prompt_id is not null and system_id is not null), a as (select prompt_id, system_id, count(*) as n from m group by 1, 2),
    e as (select p as prompt_id, s as system_id from (select distinct prompt_id as p from m), (select unnest(['A', 'B', 'C', 'D']) as s))
    select coalesce(e.prompt_id, a.prompt_id) as prompt_id, coalesce(e.system_id, a.system_id) as system_id, case when n is null then 'missing' when e.prompt_id is null then 'unexpected' else 'repeated' end as problem
    from e full join a on e.prompt_id = a.prompt_id and e.system_id = a.system_id where n is null or e.prompt_id is null or n > 1"""
)
def schedule_differences(spark, d):
    """Prompts and systems of the full schedule that no attempt has, several have, or none should."""
    m = read(spark, d, "identity_mapping").where("prompt_id is not null and system_id is not null").select("blind_id", "prompt_id", "system_id").distinct()
    systems = F.array(*[F.lit(s) for s in "ABCD"])
    expected = m.select("prompt_id").distinct().withColumn("system_id", F.explode(systems))
    return C.expected_differences(expected, m, ["prompt_id", "system_id"])


@query(
    """with m as (select blind_id, min(system_id) as system_id from identity_mapping group by 1), p as (select distinct blind_id, candidate_response as r from packets)
    select system_id, count(*) as attempts, count(r) as answered, round(avg(len(r)), 6) as mean_characters, round(avg(len(regexp_extract_all(r, '[^ \\t\\n\\r]+'))), 6) as mean_words, min(len(regexp_extract_all(r, '[^ \\t\\n\\r]+'))) as least_words, max(len(regexp_extract_all(r, '[^ \\t\\n\\r]+'))) as most_words, cast(sum(len(regexp_extract_all(r, '[^ \\t\\n\\r]+'))) as bigint) as words
    from p left join m using (blind_id) group by 1"""
)
def automatic_results(spark, d):
    """Attempts, answers, and means and ranges of their lengths by system."""
    m = read(spark, d, "identity_mapping").groupBy("blind_id").agg(F.min("system_id").alias("system_id"))
    p = read(spark, d, "packets").select("blind_id", F.col("candidate_response").alias("r")).distinct().join(m, "blind_id", "left")
    p = p.select("system_id", "r", F.length("r").alias("c"), F.size(F.regexp_extract_all("r", F.lit(r"[^ \t\n\r]+"), 0)).cast("long").alias("w"))
    w = F.when(F.col("r").isNotNull(), F.col("w"))
    return p.groupBy("system_id").agg(
        F.count("*").alias("attempts"), F.count("r").alias("answered"), F.round(F.avg("c"), 6).alias("mean_characters"), F.round(F.avg(w), 6).alias("mean_words"), F.min(w).alias("least_words"), F.max(w).alias("most_words"), F.sum(w).alias("words")
    )


_SHOTS = 5


@query(
    f"""with c as (select metadata.intent_family as family, example_id, user_prompt, assistant_response.title as title from {_LATEST.format('candidates', 'example_id')} where user_prompt is not null and assistant_response.title is not null and metadata.intent_family is not null),
    k as (select *, row_number() over (partition by family order by example_id) as i from c qualify i <= {_SHOTS})
    select family, sha256('Answer as a recipe.' || chr(10) || chr(10) || 'BEGIN EXAMPLES' || chr(10) || chr(10) || string_agg('EXAMPLE ' || i || chr(10) || 'Request: ' || user_prompt || chr(10) || 'Answer: ' || title, chr(10) || chr(10) order by i) || chr(10) || chr(10) || 'END EXAMPLES' || chr(10) || chr(10) || 'Return the recipe alone.') as prompt_sha256, count(*) as examples from k group by 1"""
)
def five_shot_prompts(spark, d):
    """Digests of prompts with each family's first five examples: five are the feature."""
    c = _latest(spark, d, "candidates", "example_id").select(F.col("metadata.intent_family").alias("family"), "example_id", F.col("user_prompt").alias("request"), F.col("assistant_response.title").alias("answer"))
    first = N.top_k(c.dropna().withColumn("one", F.lit(1)), ["family"], "one", "example_id", _SHOTS)
    shots = first.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "request", "answer"))), lambda x: F.struct(x["request"].alias("request"), x["answer"].alias("answer"))).alias("shots"))
    return shots.select("family", digest(assembled(F.lit("Answer as a recipe."), F.col("shots"), F.lit("Return the recipe alone."))).alias("prompt_sha256"), F.size("shots").cast("long").alias("examples"))


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_NUMBER = "try_cast(regexp_extract({}, '(\\d+)$', 1) as bigint)"


def _number(c):
    return F.regexp_extract(c, r"(\d+)$", 1).cast("long")


@query(
    f"""with k as (select distinct case_id, existing_id, existing_prompt, candidate_prompt, semantic_decision from contamination_calibration),
    q as (select distinct case_id as qid, {_TOKENS.format('candidate_prompt')} as t from k where candidate_prompt is not null and {_NUMBER.format('case_id')} % 100 = 0 and semantic_decision = 'reject'),
    c as (select distinct existing_id as id, {_TOKENS.format('existing_prompt')} as t from k where existing_prompt is not null),
    s as (select qid, id, round(len(list_intersect(q.t, c.t)) / len(list_distinct(list_concat(q.t, c.t))), 6) as score from q, c where len(list_intersect(q.t, c.t)) > 0),
    f as (select qid, id from s qualify row_number() over (partition by qid order by score desc, id) <= 5),
    e as (select distinct case_id as qid, existing_id as id from k where semantic_decision = 'reject' and {_NUMBER.format('case_id')} % 100 = 0 and candidate_prompt is not null)
    select count(*) as queries, count(f.id) as hits, round(count(f.id) / nullif(count(*), 0), 6) as recall from e left join f using (qid, id)"""
)
def retrieval_recall_at5(spark, d):
    """Of every hundredth calibration case to reject, whether its existing prompt is among the five nearest to its candidate prompt."""
    k = read(spark, d, "contamination_calibration").select("case_id", "existing_id", "existing_prompt", "candidate_prompt", "semantic_decision").distinct()
    asked = k.where((_number("case_id") % 100 == 0) & (F.col("semantic_decision") == "reject") & F.col("candidate_prompt").isNotNull())
    corpus = k.where("existing_prompt is not null").select(F.col("existing_id").alias("id"), F.col("existing_prompt").alias("text")).distinct()
    found = N.jaccard_neighbours(asked.select(F.col("case_id").alias("qid"), F.col("candidate_prompt").alias("text")).distinct(), corpus, word_tokens(F.col("text")), 5)
    return N.recall_at(found, asked.select(F.col("case_id").alias("qid"), F.col("existing_id").alias("id")).distinct())


@query(
    f"""with k as (select distinct case_id, case_type as grp, {_TOKENS.format('candidate_prompt')} as t from contamination_calibration where candidate_prompt is not null), q as (select * from k where {_NUMBER.format('case_id')} % 100 = 0),
    s as (select q.case_id as qid, k.case_id as id, len(list_intersect(q.t, k.t)) as shared, round(len(list_intersect(q.t, k.t)) / len(list_distinct(list_concat(q.t, k.t))), 6) as score from q join k on q.grp = k.grp and q.case_id != k.case_id where len(list_intersect(q.t, k.t)) > 0)
    select qid, id, shared, score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 5"""
)
def same_type_top5(spark, d):
    """The five other prompts of the same case type nearest to every hundredth calibration prompt."""
    k = read(spark, d, "contamination_calibration").where("candidate_prompt is not null").select(F.col("case_id").alias("id"), F.col("case_type").alias("group"), F.col("candidate_prompt").alias("text")).distinct()
    found = N.jaccard_neighbours(k.where(_number("id") % 100 == 0).withColumnRenamed("id", "qid"), k, word_tokens(F.col("text")), 5, eligible=N.same_group)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""with c as (select example_id as id, min(recorded_at) as ts, arg_min(user_prompt, struct_pack(a := recorded_at, b := user_prompt)) as x from candidates where user_prompt is not null and recorded_at is not null group by 1), k as (select id, epoch_us(ts) as ts, {_TOKENS.format('x')} as t from c),
    s as (select q.id as qid, k.id, len(list_intersect(q.t, k.t)) as shared, round(len(list_intersect(q.t, k.t)) / len(list_distinct(list_concat(q.t, k.t))), 6) as score from k q join k on k.ts < q.ts where {_NUMBER.format('q.id')} % 100 = 0 and len(list_intersect(q.t, k.t)) > 0)
    select qid, id, shared, score, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 5"""
)
def authored_before_top5(spark, d):
    """The five prompts recorded before every hundredth example that are nearest to its prompt."""
    c = read(spark, d, "candidates").where("user_prompt is not null and recorded_at is not null")
    k = c.groupBy(F.col("example_id").alias("id")).agg(F.unix_micros(F.min("recorded_at")).alias("at"), F.min_by("user_prompt", F.struct("recorded_at", "user_prompt")).alias("text"))
    found = N.jaccard_neighbours(k.where(_number("id") % 100 == 0).withColumnRenamed("id", "qid"), k, word_tokens(F.col("text")), 5, eligible=N.authored_before)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query()
def lexical_token_ratio_top5(spark, d):
    """The five candidate prompts with the greatest token ratio for every hundredth calibration prompt."""
    q = read(spark, d, "contamination_calibration").where("candidate_prompt is not null").select(F.col("case_id").alias("qid"), normalize(F.col("candidate_prompt")).alias("text")).distinct()
    c = read(spark, d, "candidates").where("user_prompt is not null").select(F.col("example_id").alias("id"), normalize(F.col("user_prompt")).alias("text")).distinct()
    return N.lexical_neighbours(q.where(_number("qid") % 100 == 0), c, 5)


@query(
    f"""with s as (select metadata.intent_family as family, lower(trim(split)) as split, pilot_member from {_LATEST.format('candidates', 'example_id')})
    select coalesce(family, 'all') as family, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'validation') as validation, count(*) filter (where pilot_member) as pilot,
    round(count(*) filter (where split = 'validation') - 0.2 * count(*) filter (where split in ('train', 'validation')), 6) as deviation from s where family is not null group by rollup (family)"""
)
def allocation_matrix(spark, d):
    """Examples of each family and of all by split, and how far validation is from a fifth of the allocated."""
    rows = _latest(spark, d, "candidates", "example_id").select(F.col("metadata.intent_family").alias("family"), F.lower(F.trim("split")).alias("split"), "pilot_member").where("family is not null")
    n = lambda c: F.count_if(c)
    placed = F.col("split").isin("train", "validation")
    per = rows.rollup("family").agg(n(F.col("split") == "train").alias("train"), n(F.col("split") == "validation").alias("validation"), n(F.col("pilot_member")).alias("pilot"), F.round(n(F.col("split") == "validation") - 0.2 * n(placed), 6).alias("deviation"))
    return per.withColumn("family", F.coalesce("family", F.lit("all")))


@query(
    f"""select metadata.intent_family as family, count(*) as pilot, count(distinct metadata.complexity) >= 2 as complexities, count(distinct metadata.input_form) >= 2 as forms, count(distinct metadata.coverage_slice) >= 2 as slices, coalesce(bool_or(metadata.constraint_bearing), false) as constrained
    from {_LATEST.format('candidates', 'example_id')} where pilot_member and metadata.intent_family is not null group by 1"""
)
def pilot_gate(spark, d):
    """Whether each family's pilot has both complexities, two forms, two slices and a constraint."""
    rows = _latest(spark, d, "candidates", "example_id").where("pilot_member and metadata.intent_family is not null").select("metadata.*")
    two = lambda c: F.countDistinct(c) >= 2
    return rows.groupBy(F.col("intent_family").alias("family")).agg(
        F.count("*").alias("pilot"), two("complexity").alias("complexities"), two("input_form").alias("forms"), two("coverage_slice").alias("slices"), F.coalesce(F.bool_or("constraint_bearing"), F.lit(False)).alias("constrained")
    )


@query(
    """with s as (select example_id, slot_id, scenario_id, lag(slot_id) over w as prior from (select distinct example_id, slot_id, scenario_id, planned_at from production_matrix where example_id is not null and slot_id is not null and planned_at is not null) window w as (partition by example_id order by planned_at, slot_id, scenario_id)),
    h as (select slot_id as prior, min(scenario_id) as scenario from s group by 1), c as (select prior, count(*) as n from s where prior is not null group by 1)
    select slot_id, case when s.prior = slot_id then 'itself' when scenario is distinct from scenario_id then 'other target' when n > 1 then 'shared' end as problem from s join h on h.prior = s.prior join c on c.prior = s.prior where s.prior = slot_id or scenario is distinct from scenario_id or n > 1"""
)
def replanned_slots(spark, d):
    """Slots that plan an example again, under another scenario than the plan before."""
    w = Window.partitionBy("example_id").orderBy("planned_at", "slot_id", "scenario_id")
    rows = read(spark, d, "production_matrix").where("example_id is not null and slot_id is not null and planned_at is not null").select("example_id", "slot_id", "scenario_id", "planned_at").distinct()
    s = rows.withColumn("prior", F.lag("slot_id").over(w)).select("slot_id", "scenario_id", "prior")
    return C.linked_chain(s, "slot_id", "prior", "scenario_id").withColumnRenamed("id", "slot_id")


# What each system has seen besides the prompt.
_EXPOSURE = {"A": "none", "B": "worked_examples", "C": "training", "D": "worked_examples,training"}


@query(
    f"""with e(system_id, exposure) as (values {', '.join(f"('{k}', '{v}')" for k, v in _EXPOSURE.items())}), m as (select distinct blind_id, system_id from identity_mapping)
    select coalesce(exposure, 'unknown') as exposure, count(*) as attempts, count(*) filter (where full_qualitative_pass) as passes from m left join e using (system_id) left join scores using (blind_id) group by 1"""
)
def exposure_passes(spark, d):
    """Scored attempts and passes by what their system had seen."""
    e = spark.createDataFrame(list(_EXPOSURE.items()), "system_id string, exposure string")
    m = read(spark, d, "identity_mapping").select("blind_id", "system_id").distinct()
    rows = m.join(F.broadcast(e), "system_id", "left").join(read(spark, d, "scores").select("blind_id", "full_qualitative_pass"), "blind_id", "left")
    return rows.groupBy(F.coalesce("exposure", F.lit("unknown")).alias("exposure")).agg(F.count("*").alias("attempts"), F.count_if("full_qualitative_pass").alias("passes"))


_LIMIT = 160


@query(
    f"""select case when candidate_response is null then 'generation_error' when len(regexp_extract_all(user_prompt, '[^ \\t\\n\\r]+')) + len(regexp_extract_all(candidate_response, '[^ \\t\\n\\r]+')) > {_LIMIT} then 'input_context_exceeded' else 'success' end as status,
    count(*) as attempts from (select distinct blind_id, user_prompt, candidate_response from packets) group by 1"""
)
def generation_status(spark, d):
    """Attempts by status, under a context of so many words for prompt and answer."""
    p = read(spark, d, "packets").select("blind_id", "user_prompt", "candidate_response").distinct()
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[^ \t\n\r]+"), 0))
    status = F.when(F.col("candidate_response").isNull(), "generation_error").when(words("user_prompt") + words("candidate_response") > _LIMIT, "input_context_exceeded").otherwise("success")
    return p.groupBy(status.alias("status")).agg(F.count("*").alias("attempts"))


@query(
    """with c as (select distinct example_id, scenario_id, lower(trim(split)) as split, user_prompt as p, array_to_string(assistant_response.method, ' ') as a from candidates where lower(trim(split)) in ('train', 'validation')),
    w as (select *, len(regexp_extract_all(p, '[^ \\t\\n\\r]+')) as pw, len(regexp_extract_all(a, '[^ \\t\\n\\r]+')) as aw, scenario_id in (select scenario_id from c group by 1 having count(distinct split) > 1 and scenario_id is not null) as leaks from c)
    select split, count(*) as examples, min(pw + aw) as least, max(pw + aw) as most, cast(sum(pw + aw) as bigint) as words, count(*) filter (where leaks) as leaking from w group by 1"""
)
def training_evidence(spark, d):
    """Examples, words and their range by split, and how many share a scenario with the other split."""
    split = F.lower(F.trim("split"))
    c = read(spark, d, "candidates").where(split.isin("train", "validation")).select("example_id", "scenario_id", split.alias("split"), F.col("user_prompt").alias("p"), F.array_join("assistant_response.method", " ").alias("a")).distinct()
    words = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[^ \t\n\r]+"), 0)).cast("long")
    both = c.where("scenario_id is not null").groupBy("scenario_id").agg((F.countDistinct("split") > 1).alias("leaks"))
    known = lambda x: F.when(F.col(x).isNotNull(), words(x))
    rows = c.join(both, "scenario_id", "left").select("split", (known("p") + known("a")).alias("w"), "leaks")
    return rows.groupBy("split").agg(F.count("*").alias("examples"), F.min("w").alias("least"), F.max("w").alias("most"), F.sum("w").alias("words"), F.count_if("leaks").alias("leaking"))


@query(
    f"""with m as (select blind_id, min(system_id) as s, min(attempt_index) as i from identity_mapping group by 1), p as (select distinct p.blind_id as id, s, i, {_TOKENS.format('candidate_response')} as t from packets p join m on m.blind_id = p.blind_id where candidate_response is not null),
    q as (select id as qid, s, t from p where i % 100 = 0),
    c as (select 'examples' as collection, example_id as id, null as s, {_TOKENS.format("array_to_string(assistant_response.method, ' ')")} as t from (select distinct example_id, assistant_response from candidates) union all select 'same_system', id, s, t from p),
    x as (select qid, collection, id, len(list_intersect(q.t, c.t)) as shared, round(len(list_intersect(q.t, c.t)) / len(list_distinct(list_concat(q.t, c.t))), 6) as score from q join c on collection = 'examples' or (c.s = q.s and c.id != q.qid) where len(list_intersect(q.t, c.t)) > 0)
    select qid, collection, id, shared, score, row_number() over (partition by qid, collection order by score desc, id) as rank from x qualify rank <= 5"""
)
def response_similarity_top5(spark, d):
    """For the responses of every hundredth attempt the five nearest examples and the five nearest other responses of the same system."""
    m = read(spark, d, "identity_mapping").groupBy("blind_id").agg(F.min("system_id").alias("group"), F.min("attempt_index").alias("i"))
    p = read(spark, d, "packets").where("candidate_response is not null").select("blind_id", "candidate_response").distinct().join(m, "blind_id")
    p = p.select(F.col("blind_id").alias("id"), "group", "i", F.col("candidate_response").alias("text"))
    q = p.where("i % 100 = 0").select(F.col("id").alias("qid"), "group", "text")
    c = read(spark, d, "candidates").select(F.col("example_id").alias("id"), F.array_join("assistant_response.method", " ").alias("text")).distinct()
    tokens = word_tokens(F.col("text"))
    near = N.jaccard_neighbours(q.drop("group"), c, tokens, 5).withColumn("collection", F.lit("examples"))
    other = N.jaccard_neighbours(q, p.drop("i"), tokens, 5, eligible=N.same_group).withColumn("collection", F.lit("same_system"))
    return near.unionByName(other).withColumn("rank", F.col("rank").cast("long"))
