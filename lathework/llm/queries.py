"""The pN_ queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import cut
from .consensus import discover, latest
from .cross_split import cross_split_overlaps, overlap_report
from .grouped_split import assign_splits, related, scenario_words
from .language import code, identify
from .mixing import mix, source_name
from .near_dup import duplicate_groups, expand, link_counts, near_classes, near_duplicates
from .packing import pack, packing_report
from .pair_defects import pair_defects
from .sql import P1_FOUND, P3_FOUND, P3_REPORT, P4_FOUND
from .tokens import token_sizes
from .truncation import cuts, examined, truncated, truncation_rates


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Recipe methods and raw responses as collection, id, text."""
    c, p = _read(spark, d, "candidates"), _read(spark, d, "packets")
    methods = c.select(F.lit("candidates").alias("collection"), F.col("example_id").alias("id"), F.concat_ws(" ", "assistant_response.method").alias("text"))
    return methods.unionByName(p.select(F.lit("packets").alias("collection"), F.col("blind_id").alias("id"), F.col("candidate_response").alias("text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """All near-duplicate pairs, but that of more than 32 records of one text each further copy is paired with the first only.

    Where a text has so many copies this is less than all pairs; the rest follow through the first copy, and p1_groups counts them.
    """
    return near_duplicates(_texts(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record's group of near duplicates and its number of links."""
    texts = _texts(spark, d)
    near, members = near_classes(texts)
    return duplicate_groups(texts, cut(expand(near, members)), link_counts(near, members))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Train prompts as id, text; evaluation prompts as field, id, text, source."""
    c, k = _read(spark, d, "candidates"), _read(spark, d, "contamination_calibration")
    split = F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", ""))
    train = c.where(split == "train").select(F.col("example_id").alias("id"), F.col("user_prompt").alias("text"))
    evaluation = c.where(split == "validation").select(
        F.lit("validation").alias("field"), F.col("example_id").alias("id"), F.col("user_prompt").alias("text"), F.col("provenance.authoring_batch_id").alias("source")
    )
    for f in ("existing_prompt", "candidate_prompt"):
        evaluation = evaluation.unionByName(k.select(F.lit(f).alias("field"), F.col("case_id").alias("id"), F.col(f).alias("text"), F.col("case_type").alias("source")))
    return train, evaluation


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = cross_split_overlaps(*_sides(spark, d))
    return found.select(F.col("field").alias("eval_field"), F.col("id").alias("eval_id"), F.col("train_id").alias("train_example_id"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split or field and source (authoring batch or case type)."""
    train, evaluation = _sides(spark, d)
    return overlap_report(cross_split_overlaps(train, evaluation), evaluation)


def _slots(spark: SparkSession, d: str) -> DataFrame:
    m = _read(spark, d, "production_matrix")
    return m.select("slot_id", "example_id", scenario_words(F.col("scenario_id")).alias("scenario"), _name(F.col("intent_family")).alias("family"))


def _name(c: Column) -> Column:
    """One spelling of a name: lower case, runs of letters and digits joined by underscores."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1), "_")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    slots = _slots(spark, d)
    groups = related(slots, "slot_id", ["scenario", "example_id"])
    named = slots.where("slot_id is not null").groupBy("slot_id").agg(F.min("scenario").alias("scenario")).join(groups, "slot_id")
    keys = named.groupBy("component").agg(F.count("*").alias("n"), F.min("scenario").alias("scenario")).where("n > 1")
    return named.select("slot_id", "component").join(keys, "component").select("slot_id", F.concat(F.lit("scenario-"), "scenario").alias("scenario_key"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """``slot_id, split`` at 80/10/10, stratified by intent family."""
    slots = _slots(spark, d)
    families = slots.where("slot_id is not null").groupBy("slot_id").agg(F.min("family").alias("stratum"))
    return assign_splits(related(slots, "slot_id", ["scenario", "example_id"]).join(families, "slot_id")).select("slot_id", "split")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Raw responses as id, source, prompt, text; source is the label of the packet's mapping, in one spelling."""
    p, m = _read(spark, d, "packets"), _read(spark, d, "identity_mapping")
    label = F.lower(F.regexp_replace("source_label", r"(?U)^\s+|\s+$", ""))
    sources = m.groupBy("blind_id").agg(F.min(label).alias("source"))
    rows = p.select("blind_id", F.col("user_prompt").alias("prompt"), F.col("candidate_response").alias("text"))
    return rows.join(sources, "blind_id", "left").withColumnRenamed("blind_id", "id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(_answers(spark, d).withColumnRenamed("text", "response")).withColumnRenamed("id", "blind_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(_answers(spark, d)).withColumnRenamed("id", "blind_id")


def p6_cuts(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of every cut: a length limit, by kind, length and tail, or a break in transfer."""
    found = cuts(examined(_answers(spark, d), rules=False))
    return found.select(F.col("id").alias("blind_id"), "path", "kind", "length", F.round("p", 9).alias("p"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    answers = _answers(spark, d)
    return truncation_rates(answers, truncated(answers))


#: Field, widest distance of two valid values, and whether a value is valid.
FIELDS = (("underlying_answer_quality", 2.0), ("full_qualitative_pass", 1.0))
#: Labels are given where so many different evaluators gave a valid value.
AT_LEAST = 3


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """item, annotator, value of both fields at once: item and annotator with their field's number, the value as a share of the field's span."""
    s = _read(spark, d, "scores")
    name = F.trim(F.regexp_replace(F.lower(F.regexp_extract("evaluator", r"^([^,;]*)", 1)), r"(?U)\s+", " "))
    known = _read(spark, d, "packets").select("blind_id").distinct()
    quality = F.when(F.col(FIELDS[0][0]).between(1, 3), F.col(FIELDS[0][0]))
    values = ((FIELDS[0], quality), (FIELDS[1], F.col(FIELDS[1][0]).cast("int")))
    each = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("field"), (v / span).alias("value")) for k, ((_, span), v) in enumerate(values)])
    rows = s.withColumn("name", F.when(name != "", name)).join(known, "blind_id", "left_semi").withColumn("x", F.explode(each))
    rows = rows.where("blind_id is not null and name is not null").select(F.struct("x.field", F.col("blind_id").alias("name")).alias("packet"), F.struct("x.field", "name").alias("who"), "x.value", "recorded_at", "ingested_at", "score_id")
    return latest(rows, "packet", "who", "value", ["recorded_at", "ingested_at", "score_id"])


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return discover(_claims(spark, d), 1.0)


def _field(c: str) -> Column:
    return F.when(F.col(c) == 0, FIELDS[0][0]).otherwise(FIELDS[1][0]).alias("field")


def _label() -> Column:
    quality = F.round(F.col("value") * FIELDS[0][1]).cast("int").cast("string")
    return F.when(F.col("item.field") == 0, quality).otherwise(F.when(F.col("value") > 0.5, "true").otherwise("false"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = _consensus(spark, d)
    return items.where(F.col("annotators") >= AT_LEAST).select(F.col("item.name").alias("blind_id"), _field("item.field"), _label().alias("label"))


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    """Every packet's consensus, agreement and support in each field, however few evaluators."""
    items, _ = _consensus(spark, d)
    return items.select(F.col("item.name").alias("blind_id"), _field("item.field"), _label().alias("label"), "annotators", F.round("agreement", 6).alias("agreement"), F.round("support", 6).alias("support"))


def p5_evaluators(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluator's reliability in each field."""
    _, annotators = _consensus(spark, d)
    return annotators.select(F.col("annotator.name").alias("evaluator"), _field("annotator.field"), "labels", F.round("reliability", 6).alias("reliability"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = token_sizes(_read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["id"])
    kinds = _read(spark, d, "pack_capacities").select(F.col("container_kind").alias("kind"), F.col("capacity_tokens").alias("capacity"))
    return pack(sizes, kinds)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text's container of each kind."""
    return _packed(spark, d).select(F.col("kind").alias("container_kind"), "container", F.col("id").alias("doc_id"), "piece", F.col("size").alias("tokens"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used of each kind, the least possible number, and the share of their room that is filled."""
    return packing_report(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = _read(spark, d, "mix_targets").select("mix_id", source_name(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap"))
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), source_name(F.col("source")).alias("source"), "text")
    # only texts of listed sources are measured; targets never grow
    named = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return mix(token_sizes(named, ["id", "source"]), targets)


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each mix uses each document."""
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source of every mix."""
    return _mixed(spark, d)[1]


def _identified(spark: SparkSession, d: str) -> DataFrame:
    return identify(_read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", code(F.col("lang")).alias("code")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = _identified(spark, d).select("id", "code", F.filter("languages", lambda x: x["sentences"] > 0).alias("spoken"))
    wrong = found.where((F.size("spoken") != 1) | F.col("code").isNull() | (F.get("spoken", F.lit(0))["language"] != F.col("code")))
    return wrong.select(F.col("id").alias("doc_id"), F.explode("spoken.language").alias("lang"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's languages with share and confidence."""
    rows = _identified(spark, d).select(F.col("id").alias("doc_id"), F.explode("languages").alias("l"))
    return rows.select("doc_id", "l.language", F.round("l.share", 6).alias("share"), F.round("l.confidence", 6).alias("confidence"), "l.sentences")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language with its confidence."""
    rows = _identified(spark, d).select(F.col("id").alias("doc_id"), F.explode("segments").alias("s"))
    return rows.select("doc_id", "s.begin", "s.sentences", "s.language", F.round("s.confidence", 6).alias("confidence"))


_QUERIES = (
    p1_found, p1_groups, p2_found, p3_found, p3_report, p4_found, p4_splits, p5_found, p5_items, p5_evaluators, p6_found, p6_cuts, p6_report,
    p7_containers, p7_report, p8_copies, p8_shares, p9_found, p9_documents, p9_segments,
)


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_report": P3_REPORT, "p4_found": P4_FOUND}
