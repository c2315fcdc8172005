"""Records against their contract: named rules, registries, and the identity of their content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trim

# The registries of the record contract.
SUBTYPES = {
    "advice_decision_support": ["action_planning", "option_comparison", "prioritisation", "preparation", "habit_change", "interpersonal_navigation", "problem_diagnosis", "risk_and_tradeoff_assessment"],
    "creative_generation": ["name_generation", "slogan_or_tagline", "character_or_mascot", "story_premise_or_plot", "scene_or_opening", "concept_or_campaign", "event_or_experience", "idea_generation"],
    "explanation_technical_understanding": ["concept_explanation", "process_explanation", "cause_and_effect", "comparison_and_distinction", "worked_example", "troubleshooting", "misconception_correction", "technical_how_to"],
    "low_stakes_emotional_support": ["validation_and_normalisation", "perspective_reframing", "self_compassion", "confidence_support", "manageable_next_steps", "conversation_preparation", "boundary_reflection", "supporting_someone_else"],
    "short_form_transformation": ["summarisation", "clarity_edit", "tone_shift", "audience_adaptation", "notes_to_finished_copy", "shortening", "message_or_reply_drafting", "constraint_preserving_rewrite"],
}
SLICES = ["target_use", "breadth", "robustness"]
FORMS = ["question", "direct_request_or_command", "statement_or_fragment"]
COMPLEXITIES = ["standard", "composed"]
SOURCES = ["ordinary_content_constraint", "supplied_content", "multiple_outcomes", "competing_considerations", "connected_steps", "robustness_pressure"]
ROLES = ["format_pressure", "behaviour_pressure", "serialization_pressure"]
PROHIBITED_MODELS = ["Qwen/Qwen2.5-1.5B-Instruct", "Qwen2.5-1.5B-Instruct"]
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
DIGEST = r"^[0-9a-f]{64}$"


def trimmed(text: Column) -> Column:
    """Whether a text is there, not blank, and without outer white space."""
    return text.isNotNull() & (text == trim(text)) & (text != "")


def all_trimmed(texts: Column) -> Column:
    return F.forall(texts, trimmed)


def implies(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    """Where a holds b must, and where it doesn't ``otherwise`` must, if given."""
    return F.when(a, b).otherwise(F.lit(True) if otherwise is None else otherwise)


def identifier(text: Column) -> Column:
    return text.rlike(IDENTIFIER)


def sha256_digest(text: Column) -> Column:
    return text.rlike(DIGEST)


def prohibited_model(model: Column) -> Column:
    """Whether a model id is a prohibited one, by its whole name or its last part, in any letter case."""
    part = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    targets = sorted({x for m in PROHIBITED_MODELS for x in (m.lower(), m.rsplit("/", 1)[-1].lower())})
    return F.lower(model).isin(*targets) | F.lower(part(model)).isin(*targets)


def closed_keys(raw: Column, allowed: list[str]) -> tuple[Column, Column]:
    """(missing, unexpected) top-level keys of a JSON object; null where the text is no object."""
    keys, wanted = F.json_object_keys(raw), F.array(*map(F.lit, allowed))
    return F.array_sort(F.array_except(wanted, keys)), F.array_sort(F.array_except(keys, wanted))


def utc_instant(text: Column, now: Column | None = None) -> Column:
    """The instant a text with an explicit Z names; null for any other form and for instants after ``now``."""
    at = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))
    return at if now is None else F.when(at <= now, at)


def slot_rules(m: str = "") -> dict[str, Column]:
    """Rules of a record's planned metadata, its columns at prefix ``m``: registries, and what complexity, slice and constraints ask of each other."""
    c = lambda name: F.col(m + name)
    constrained, sources, constraints = c("constraint_bearing"), c("complexity_sources"), c("important_constraints")
    composed, none = c("complexity") == "composed", F.size(constraints) == 0
    subtypes = F.create_map(*[x for f, ss in SUBTYPES.items() for x in (F.lit(f), F.array(*map(F.lit, ss)))])
    return {
        "family": c("intent_family").isin(*SUBTYPES),
        "subtype": F.array_contains(subtypes[c("intent_family")], c("task_subtype")),
        "slice": c("coverage_slice").isin(*SLICES),
        "form": c("input_form").isin(*FORMS),
        "complexity": c("complexity").isin(*COMPLEXITIES),
        "sources": F.forall(sources, lambda s: s.isin(*SOURCES)) & (F.size(sources) == F.size(F.array_distinct(sources))),
        "robustness": implies(
            c("coverage_slice") == "robustness",
            composed & F.array_contains(sources, "robustness_pressure") & F.coalesce(c("robustness_role").isin(*ROLES), F.lit(False)),
            c("robustness_role").isNull() & ~F.array_contains(sources, "robustness_pressure"),
        ),
        "standard": implies(c("complexity") == "standard", (F.size(sources) == 0) & ~constrained & none, F.size(sources) > 0),
        "constraint": implies(constrained, composed & F.array_contains(sources, "ordinary_content_constraint") & ~none, none),
        "constraints_trimmed": all_trimmed(constraints),
        "summary_trimmed": trimmed(c("scenario_summary")),
    }


def example_rules() -> dict[str, Column]:
    """Rules of a supervised example: its texts, its response's shape, its provenance, and those of its metadata."""
    r, p = F.col("assistant_response"), F.col("provenance")
    human = p["initial_draft_source"] == "human"
    return {
        "id": identifier(F.col("example_id")),
        "prompt_trimmed": trimmed(F.col("user_prompt")),
        "title_trimmed": trimmed(r["title"]),
        "garnish_trimmed": trimmed(r["garnish"]),
        "method_trimmed": all_trimmed(r["method"]),
        "ingredients_trimmed": F.forall(r["ingredients"], lambda i: trimmed(i["unit"]) & trimmed(i["name"])),
        "amounts_positive": F.forall(r["ingredients"], lambda i: i["amount"] > 0),
        "ingredient_count": F.size(r["ingredients"]).between(3, 8),
        "method_count": F.size(r["method"]).between(2, 5),
        "pilot_in_train": implies(F.col("pilot_member"), F.coalesce(F.lower(trim(F.col("split"))) == "train", F.lit(False))),
        "draft_model": implies(human, p["initial_draft_model_id"].isNull(), F.coalesce(trimmed(p["initial_draft_model_id"]), F.lit(False))),
        "model_allowed": ~F.coalesce(prohibited_model(p["initial_draft_model_id"]), F.lit(False)),
        **slot_rules("metadata."),
        "goal_trimmed": trimmed(F.col("metadata.user_goal")),
        "artefact_trimmed": trimmed(F.col("metadata.requested_task_or_artefact")),
    }


def attempt_rules() -> dict[str, Column]:
    """Rules of a recorded attempt beside its output: identifiers, index, and the digest of the output as stored (``output``)."""
    return {
        "blind_id": identifier(F.col("blind_id")),
        "run": identifier(F.col("source_run_id")),
        "prompt": identifier(F.col("prompt_id")),
        "system": F.col("system_id").isin("A", "B", "C", "D"),
        "index": F.col("attempt_index") >= 0,
        "digest_form": sha256_digest(F.col("raw_output_sha256")),
        "digest": F.col("raw_output_sha256") == F.sha2("output", 256),
    }


def sorted_struct(value: Column, dtype) -> Column:
    """A value with the fields of all its structs in the order of their names, as canonical JSON has them."""
    from pyspark.sql.types import ArrayType, StructType

    if isinstance(dtype, StructType):
        return F.when(value.isNotNull(), F.struct(*[sorted_struct(value[f.name], f.dataType).alias(f.name) for f in sorted(dtype.fields, key=lambda f: f.name)]))
    if isinstance(dtype, ArrayType) and isinstance(dtype.elementType, StructType | ArrayType):
        return F.transform(value, lambda x: sorted_struct(x, dtype.elementType))
    return value


def content_json(df, leave_out: list[str]) -> Column:
    """Canonical JSON of a row but for some columns: sorted keys, nulls kept, no blanks. For finite numbers and text without control characters."""
    fields = sorted((f for f in df.schema.fields if f.name not in leave_out), key=lambda f: f.name)
    return F.to_json(F.struct(*[sorted_struct(F.col(f.name), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})
