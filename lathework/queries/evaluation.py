"""Rates, summaries, agreement and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import Z, summary
from ..operators import evaluation as E
from ..operators import sampling as S
from ..operators.contracts import latest_by
from . import query, read

_NAME = "trim(regexp_replace(lower(regexp_extract(evaluator, '^([^,;]*)', 1)), '\\s+', ' ', 'g'))"
_SOURCE = "(select blind_id, min(lower(trim(source_label))) as source from identity_mapping group by 1)"
_WILSON = f"round((h / n + {Z * Z} / (2 * n) - {Z} * sqrt(h / n * (1 - h / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n), 6) as low, round((h / n + {Z * Z} / (2 * n) + {Z} * sqrt(h / n * (1 - h / n) / n + {Z * Z} / (4 * n * n))) / (1 + {Z * Z} / n), 6) as high"


def _sources(spark, d):
    return read(spark, d, "identity_mapping").groupBy("blind_id").agg(F.min(F.lower(F.trim("source_label"))).alias("source"))


def _scored(spark, d):
    """Every score with its packet's source; scores of unmapped packets have none."""
    return read(spark, d, "scores").join(_sources(spark, d), "blind_id", "left")


@query(f"with c as (select source, cast(count(*) as double) as n, cast(count(*) filter (where full_qualitative_pass) as double) as h from scores left join {_SOURCE} using (blind_id) group by 1) select source, cast(n as bigint) as n, cast(h as bigint) as hits, round(h / n, 6) as rate, {_WILSON} from c")
def rate_wilson(spark, d):
    """Pass rates by source with Wilson intervals; unknown passes are misses."""
    return E.rates(_scored(spark, d), ["source"], F.col("full_qualitative_pass"))


def _summary_sql(x: str) -> str:
    return f"count({x}) as n, round(avg({x}), 6) as mean, round(quantile_cont({x}, 0.5), 6) as median, round(quantile_cont({x}, 0.25), 6) as q1, round(quantile_cont({x}, 0.75), 6) as q3, round(case when count({x}) = 1 then 0.0 else stddev_samp({x}) end, 6) as sd"


@query(f"select kind, {_summary_sql('cast(n_chars as double)')} from documents group by kind")
def continuous_summary(spark, d):
    """Lengths of documents by kind: mean, median, quartiles, deviation."""
    return read(spark, d, "documents").groupBy("kind").agg(*summary(F.col("n_chars")))


@query(f"select l_returnflag, l_linestatus, {_summary_sql('l_quantity')} from lineitem group by 1, 2")
def quantity_summary(spark, d):
    """Quantities by flag and status."""
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*summary(F.col("l_quantity")))


@query(
    f"""with p as (select distinct blind_id from packets), s as (select p.blind_id, source, coalesce(bool_or(underlying_answer_quality between 2 and 3 and metaphorical_coherence between 2 and 3 and recipe_style_execution between 2 and 3), false) as joint, count(score_id) as scored
    from p left join {_SOURCE} m using (blind_id) left join scores using (blind_id) group by 1, 2) select source, count(*) as packets, count(*) filter (where scored > 0) as scored, count(*) filter (where joint) as joint,
    round(count(*) filter (where joint) / count(*), 6) as end_to_end, round(count(*) filter (where joint) / nullif(count(*) filter (where scored > 0), 0), 6) as conditional from s group by 1"""
)
def full_response_pass(spark, d):
    """Packets that some evaluator scores 2 or more on all three dimensions, over all packets and over scored ones."""
    ok = F.col("underlying_answer_quality").between(2, 3) & F.col("metaphorical_coherence").between(2, 3) & F.col("recipe_style_execution").between(2, 3)
    per = read(spark, d, "scores").groupBy("blind_id").agg(F.bool_or(ok).alias("joint"), F.count("*").alias("n"))
    rows = read(spark, d, "packets").select("blind_id").distinct().join(_sources(spark, d), "blind_id", "left").join(per, "blind_id", "left")
    out = rows.groupBy("source").agg(F.count("*").alias("packets"), F.count("n").alias("scored"), F.count_if(F.coalesce("joint", F.lit(False))).alias("joint"))
    return out.withColumns({"end_to_end": F.round(F.col("joint") / F.col("packets"), 6), "conditional": F.round(F.try_divide("joint", "scored"), 6)})


@query(
    """with m as (select prompt_id, system_id, underlying_answer_quality as q from (select distinct blind_id, prompt_id, system_id from identity_mapping) left join scores using (blind_id)),
    p as (select prompt_id, round(avg(case when system_id = 'B' then q end), 6) as x, round(avg(case when system_id = 'C' then q end), 6) as y from m group by 1)
    select case when x is null and y is null then 'neither' when y is null then 'B by default' when x is null then 'C by default' when x > y then 'B' when x < y then 'C' else 'tie' end as outcome, count(*) as n from p group by 1"""
)
def pairwise_outcomes(spark, d):
    """Of each prompt, which of systems B and C scores higher."""
    m = read(spark, d, "identity_mapping").select("blind_id", "prompt_id", "system_id").distinct()
    return E.pairwise_outcomes(m.join(read(spark, d, "scores").select("blind_id", "underlying_answer_quality"), "blind_id", "left"), "prompt_id", "system_id", "underlying_answer_quality", "B", "C")


@query(
    f"""with m as (select distinct blind_id, system_id from identity_mapping), s as (select system_id, source, full_qualitative_pass as p from scores join m using (blind_id) left join {_SOURCE} using (blind_id))
    select system_id, source, count(*) as n, count(*) filter (where p) as passes from s group by grouping sets ((system_id, source), (system_id), (source), ())"""
)
def subgroup_diagnostics(spark, d):
    """Passes by system and source, each alone, and overall."""
    m = read(spark, d, "identity_mapping").select("blind_id", "system_id").distinct()
    rows = _scored(spark, d).join(m, "blind_id").select("system_id", "source", "full_qualitative_pass")
    return rows.cube("system_id", "source").agg(F.count("*").alias("n"), F.count_if("full_qualitative_pass").alias("passes"))


@query(
    """with c as (select full_qualitative_pass as passed, underlying_answer_quality as x, metaphorical_coherence as y, count(*) as c from scores where underlying_answer_quality between 1 and 3 and metaphorical_coherence between 1 and 3 group by 1, 2, 3),
    t as (select passed, sum(c) as n, sum(c * abs(x - y)) as d from c group by 1), e as (select a.passed, sum(cast(a.c as double) * b.c * abs(a.x - b.y)) as e from c a join c b on a.passed is not distinct from b.passed group by 1)
    select t.passed, cast(n as bigint) as n, round(1 - d / nullif(e / n, 0), 6) as kappa from t join e on t.passed is not distinct from e.passed"""
)
def weighted_kappa(spark, d):
    """Agreement of two dimensions' scores, by pass."""
    rows = read(spark, d, "scores").withColumnRenamed("full_qualitative_pass", "passed")
    return E.weighted_kappa(rows, "underlying_answer_quality", "metaphorical_coherence", 1, 3, ["passed"])


@query(
    f"""with s as (select blind_id, {_NAME} as name, underlying_answer_quality as q, row_number() over (partition by blind_id, {_NAME} order by recorded_at desc nulls last, score_id desc) as r from scores),
    v as (select blind_id, q, count(*) as c from s where r = 1 and q between 1 and 3 group by 1, 2), t as (select blind_id, cast(sum(c) as bigint) as n, cast(sum(c * (c - 1)) as bigint) as same from v group by 1)
    select n as raters, count(*) as packets, cast(sum(same) as bigint) as agreeing, round(sum(same) / sum(n * (n - 1)), 6) as agreement from t where n > 1 group by 1"""
)
def judge_agreement(spark, d):
    """The share of evaluators' pairs on a packet that agree, by how many there are; from counts of each value, without forming pairs."""
    name = F.trim(F.regexp_replace(F.lower(F.regexp_extract("evaluator", r"^([^,;]*)", 1)), r"\s+", " "))
    s = latest_by(read(spark, d, "scores").withColumn("name", name), ["blind_id", "name"], [F.col("recorded_at").desc_nulls_last(), F.col("score_id").desc()])
    v = s.where("underlying_answer_quality between 1 and 3").groupBy("blind_id", "underlying_answer_quality").agg(F.count("*").alias("c"))
    t = v.groupBy("blind_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    return t.groupBy(F.col("n").alias("raters")).agg(F.count("*").alias("packets"), F.sum("same").alias("agreeing"), F.round(F.sum("same") / F.sum(F.col("n") * (F.col("n") - 1)), 6).alias("agreement"))


_DRAWS = 200


@query(
    f"""with v as (select case_id, cast(max(len(candidate_prompt)) as double) as y from contamination_calibration where candidate_prompt is not null and case_id is not null group by 1),
    r as (select row_number() over (order by sha256(case_id), case_id) - 1 as i, y, count(*) over () as n from v), n as (select count(*) as n from v),
    x as (select d, cast(('0x' || left(sha256(concat_ws('|', '20260715', cast(d as varchar), cast(s as varchar))), 15))::bigint % n as bigint) as i from range({_DRAWS}) a(d), n, unnest(range(n)) b(s))
    select d as draw, round(avg(y), 6) as mean from x join r using (i) group by d"""
)
def paired_bootstrap_cases(spark, d):
    """Two hundred resampled means over all cases, numbered and drawn by digests."""
    cases = read(spark, d, "contamination_calibration").where("candidate_prompt is not null and case_id is not null")
    v = cases.groupBy("case_id").agg(F.max(F.length("candidate_prompt")).cast("double").alias("y"))
    return S.bootstrap_means(v, "case_id", "y", _DRAWS, 20260715)


@query(
    """with s as (select l_suppkey as supplier, count(*) as lines, round(avg(l_discount), 6) as discount, round(avg(l_tax), 6) as tax, count(*) filter (where l_returnflag = 'R') as returned from lineitem group by 1)
    select supplier, lines, discount, tax, returned from s where lines >= 10 and returned < lines order by lines desc, returned, discount desc, tax, supplier limit 10"""
)
def candidate_ranking(spark, d):
    """The ten best suppliers that pass the gates, by five keys: a report."""
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("lines"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return E.ranking(s, (F.col("lines") >= 10) & (F.col("returned") < F.col("lines")), [F.desc("lines"), F.asc("returned"), F.desc("discount"), F.asc("tax"), F.asc("supplier")]).limit(10)


@query("select coalesce(semantic_decision, 'null') as decision, case_type, grouping(case_type) as all_types, count(*) as n, count(distinct case_id) as cases from contamination_calibration group by grouping sets ((decision, case_type), (decision))")
def similarity_decision_cube(spark, d):
    """Calibration decisions by case type and over all types."""
    rows = read(spark, d, "contamination_calibration").select(F.coalesce("semantic_decision", F.lit("null")).alias("decision"), "case_type", "case_id")
    return rows.groupingSets([["decision", "case_type"], ["decision"]], "decision", "case_type").agg(F.grouping("case_type").cast("long").alias("all_types"), F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query(
    f"""with s as (select blind_id, {_NAME} as name, count(*) as c from scores group by 1, 2), p as (select distinct blind_id from packets)
    select case when p.blind_id is null then 'unknown packet' when s.blind_id is null then 'unscored' when c = 1 then 'once' else 'repeated' end as state, count(*) as n from s full join p on s.blind_id = p.blind_id group by 1"""
)
def judgment_coverage(spark, d):
    """How packets and evaluators' judgments meet: once, repeatedly, never, or on an unknown packet."""
    name = F.trim(F.regexp_replace(F.lower(F.regexp_extract("evaluator", r"^([^,;]*)", 1)), r"\s+", " "))
    s = read(spark, d, "scores").groupBy("blind_id", name.alias("name")).agg(F.count("*").alias("c"))
    p = read(spark, d, "packets").select("blind_id", F.lit(1).alias("known")).distinct()
    state = F.when(F.col("known").isNull(), "unknown packet").when(F.col("c").isNull(), "unscored").when(F.col("c") == 1, "once").otherwise("repeated")
    return s.join(p, "blind_id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(
    f"""with s as (select source, count(*) as scored, count(*) filter (where full_qualitative_pass) as passes, count(*) filter (where underlying_answer_quality between 2 and 3) as quality, count(*) filter (where metaphorical_coherence between 2 and 3) as coherence, count(*) filter (where recipe_style_execution between 2 and 3) as style
    from (select distinct blind_id from packets) join {_SOURCE} using (blind_id) join scores using (blind_id) group by 1) select * from s"""
)
def blind_reveal_summary(spark, d):
    """Scores by source after unblinding."""
    ok = lambda c: F.count_if(F.col(c).between(2, 3))
    rows = _scored(spark, d).join(read(spark, d, "packets").select("blind_id").distinct(), "blind_id", "left_semi").join(_sources(spark, d).select("blind_id"), "blind_id", "left_semi")
    return rows.groupBy("source").agg(F.count("*").alias("scored"), F.count_if("full_qualitative_pass").alias("passes"), ok("underlying_answer_quality").alias("quality"), ok("metaphorical_coherence").alias("coherence"), ok("recipe_style_execution").alias("style"))
