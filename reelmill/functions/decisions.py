"""Answers of teachers and verifiers to decisions with a reason, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions import text as tx

#: A teacher's reasons, those of them that keep a state, and the length of a state in words.
REASONS = (
    "no_significant_change", "action_changed", "pose_changed", "appearance_changed", "scene_or_background_changed",
    "interaction_changed", "occlusion_recovered", "insufficient_evidence",
)
KEEP_REASONS = ("no_significant_change", "insufficient_evidence")
MIN_WORDS, MAX_WORDS = 4, 40
#: The keys of an API teacher's answer, what it may say, and the length of its updates in words and characters.
API_KEYS = ("decision", "changed_elements", "memory_update", "confidence", "evidence_sufficiency", "significant_change", "identity_consistent", "standalone_complete", "evidence")
API_DECISIONS, API_EVIDENCE = ("update", "keep", "uncertain"), ("sufficient", "insufficient")
API_ELEMENTS = ("action", "pose", "appearance", "viewpoint", "scale", "visibility", "interaction", "scene", "other")
API_FEWEST, API_MOST, API_LONGEST = 5, 30, 256
KEEP_MODES = ("none", "clear_state_change", "previous_state_unsupported", "insufficient_evidence")


def _flag(record: Column, name: str) -> Column:
    word = F.lower(F.trim(F.try_variant_get(record, f"$.{name}", "string")))
    return F.when(word == "true", True).when(word == "false", False)


def _get(record: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{name}", "string"), F.lit(""))


def with_teacher(df: DataFrame, raw: Column, out: str) -> DataFrame:
    """df with out, struct<changed, reason_code, new_state, rejection> of a raw answer: rejection says which gate failed, null if none did.

    The answer is parsed once, into a column of its own.
    """
    r = F.col("__r")
    fields = F.struct(
        r.isNotNull().alias("parsed"), F.try_variant_get(r, "$.state_changed", "variant").isNotNull().alias("has_changed"), _flag(r, "state_changed").alias("changed"),
        F.lower(F.trim(_get(r, "reason_code"))).alias("reason"), tx.sentence(_get(r, "new_state")).alias("state"),
    )
    f = F.col("__f")
    changed, reason, state = f["changed"], f["reason"], f["state"]
    rejection = (
        F.when(~f["parsed"], "unparseable_json")
        .when(~f["has_changed"], "missing_state_changed")
        .when(changed.isNull(), "non_boolean_state_changed")
        .when(~reason.isin(*REASONS), "unknown_reason_code")
        .when(~changed & ~reason.isin(*KEEP_REASONS), "keep_with_change_reason")
        .when(changed & reason.isin(*KEEP_REASONS), "update_with_keep_reason")
        .when(changed & (state == ""), "empty_new_state")
        .when(changed, F.coalesce(tx.word_gate(state, MIN_WORDS, MAX_WORDS), F.when(tx.is_ungrounded(state), "ungrounded_or_relative_phrasing"), F.when(tx.is_observation(state), "observation_not_state")))
    )
    fine = F.col("__x").isNull()
    made = F.struct(
        F.when(fine, changed).alias("changed"), F.when(fine, reason).alias("reason_code"),
        F.when(fine, F.when(changed, state).otherwise("")).alias("new_state"), F.col("__x").alias("rejection"),
    )
    staged = df.withColumn("__r", tx.json_in_prose(raw)).withColumn("__f", fields).withColumn("__x", rejection)
    return staged.withColumn(out, made).drop("__r", "__f", "__x")


def with_api_decision(df: DataFrame, raw: Column, out: str) -> DataFrame:
    """df with out, struct<decision, changed_elements, memory_update, confidence, identity_consistent, evidence, rejection> of an API teacher's raw answer.

    rejection says which rule the answer breaks first and is null if it breaks none; the
    other fields are null then. The answer is parsed once, into a column of its own.
    """
    r = F.col("__r")
    get = lambda k, kind="variant": F.try_variant_get(r, f"$.{k}", kind)
    word = lambda k: F.lower(F.btrim(F.coalesce(get(k, "string"), F.lit(""))))
    is_ = lambda k, kind: F.coalesce(F.schema_of_variant(get(k)).startswith(kind), F.lit(False))
    flags = ("significant_change", "identity_consistent", "standalone_complete")
    items = get("changed_elements", "array<variant>")
    fields = F.struct(
        r.isNotNull().alias("parsed"), F.array_sort(F.map_keys(F.try_variant_get(r, "$", "map<string,variant>"))).alias("keys"),
        word("decision").alias("decision"), word("evidence_sufficiency").alias("sufficiency"), get("confidence", "double").alias("confidence"),
        (is_("changed_elements", "ARRAY") & F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))).alias("texts"),
        F.array_distinct(F.transform(get("changed_elements", "array<string>"), lambda x: F.lower(F.btrim(x)))).alias("elements"),
        F.forall(F.array(*[is_(k, "BOOLEAN") for k in flags]), lambda x: x).alias("flagged"), *[get(k, "boolean").alias(k) for k in flags],
        tx.sentence(get("evidence", "string")).alias("evidence"), (F.is_variant_null(get("memory_update")) | is_("memory_update", "STRING")).alias("update_is_text"),
        F.nullif(tx.sentence(F.when(~F.is_variant_null(get("memory_update")), get("memory_update", "string"))), F.lit("")).alias("update"),
    )
    f = F.col("__f")
    decision, update, elements, sufficient = f["decision"], f["update"], f["elements"], f["sufficiency"] == "sufficient"
    none = F.size(elements) == 0
    rejection = (
        F.when(~f["parsed"], "unparseable_json")
        .when(~f["keys"].eqNullSafe(F.array(*[F.lit(k) for k in sorted(API_KEYS)])), "schema_keys_mismatch")
        .when(~decision.isin(*API_DECISIONS), "invalid_decision")
        .when(~f["texts"] | F.exists(elements, lambda x: ~x.isin(*API_ELEMENTS)), "invalid_changed_elements")
        .when(~f["sufficiency"].isin(*API_EVIDENCE), "invalid_evidence_sufficiency")
        .when(~F.coalesce((f["confidence"] >= 0) & (f["confidence"] <= 1), F.lit(False)), "invalid_confidence")
        .when(~f["flagged"], "non_boolean_audit_field")
        .when(f["evidence"] == "", "empty_evidence")
        .when(~F.lower(f["evidence"]).startswith("image 3 shows"), "invalid_current_evidence")
        .when(~f["update_is_text"], "invalid_memory_update_type")
        .when((decision == "uncertain") & (update.isNotNull() | ~none | sufficient), "inconsistent_uncertain")
        .when((decision == "keep") & (update.isNotNull() | ~none), "inconsistent_keep")
        .when((decision == "keep") & (~sufficient | f["significant_change"]), "unverified_keep")
        .when((decision == "update") & (update.isNull() | none), "inconsistent_update")
        .when((decision == "update") & ~(sufficient & f["significant_change"] & f["identity_consistent"] & f["standalone_complete"]), "unverified_update")
        .when((decision == "update") & (~tx.n_words(update).between(API_FEWEST, API_MOST) | (F.length(update) > API_LONGEST)), "invalid_update_length")
    )
    kept = {"decision": decision, "changed_elements": elements, "memory_update": update, "confidence": f["confidence"], "identity_consistent": f["identity_consistent"], "evidence": f["evidence"]}
    made = F.struct(*[F.when(F.col("__x").isNull(), c).alias(k) for k, c in kept.items()], F.col("__x").alias("rejection"))
    staged = df.withColumn("__r", tx.json_in_prose(raw)).withColumn("__f", fields).withColumn("__x", rejection)
    return staged.withColumn(out, made).drop("__r", "__f", "__x")


def api_gate(d: Column, input_state: Column, threshold: float) -> Column:
    """struct<accept, reason> of a decision of with_api_decision, whatever it says of itself; null where the answer was rejected."""
    refused = (
        F.when(d["decision"] == "uncertain", "model_uncertain")
        .when(d["confidence"] < threshold, "low_confidence")
        .when(~d["identity_consistent"], "identity_inconsistent")
        .when((d["decision"] == "update") & tx.is_vacuous(d["memory_update"], input_state), "vacuous_update")
    )
    passed = F.when(d["decision"] == "keep", "verified_hard_null").otherwise("verified_update")
    return F.when(d["rejection"].isNull(), F.struct(refused.isNull().alias("accept"), F.coalesce(refused, passed).alias("reason")))


def verifier(r: Column) -> Column:
    """struct<accept, reason> of a verifier's parsed answer; accept is null where the answer contradicts itself."""
    accept, mode = _flag(r, "accept"), F.coalesce(F.nullif(F.lower(F.trim(_get(r, "failure_mode"))), F.lit("")), F.lit("unspecified"))
    bad = F.when(r.isNull(), "unparseable_json").when(accept.isNull(), "non_boolean_accept").when(accept & (mode != "none"), "accept_with_failure_mode")
    return F.struct(F.when(bad.isNull(), accept).alias("accept"), F.coalesce(bad, F.when(accept, "none").otherwise(mode)).alias("reason"))


def keep_verifier(r: Column) -> Column:
    """struct<accept, reason> of the parsed answer of a verifier of kept states."""
    accept, mode = _flag(r, "accept_keep"), F.coalesce(F.nullif(F.lower(F.trim(_get(r, "failure_mode"))), F.lit("")), F.lit("unspecified"))
    bad = (
        F.when(r.isNull(), "unparseable_json")
        .when(accept.isNull(), "non_boolean_accept_keep")
        .when(~mode.isin(*KEEP_MODES), "unknown_keep_failure_mode")
        .when(accept & (mode != "none"), "accept_keep_with_failure_mode")
        .when(~accept & (mode == "none"), "reject_keep_without_failure_mode")
    )
    return F.struct(F.when(bad.isNull(), accept).alias("accept"), F.coalesce(bad, mode).alias("reason"))


def reconciled(a: Column, b: Column) -> Column:
    """struct<changed, new_state, reason> of two passes: both must agree, and the shorter wording of an update counts."""
    score = tx.agreement(a["new_state"], b["new_state"])
    unclear = (a["reason_code"] == "insufficient_evidence") | (b["reason_code"] == "insufficient_evidence")
    reason = (
        F.when(a["changed"].isNull() | b["changed"].isNull(), "dual_pass_parse_failure")
        .when(a["changed"] != b["changed"], "dual_pass_decision_conflict")
        .when(~a["changed"] & unclear, "dual_pass_insufficient_evidence")
        .when(~a["changed"], "dual_pass_keep")
        .when(score < tx.MIN_SELF_AGREEMENT, "dual_pass_wording_conflict")
        .otherwise("dual_pass_agreed")
    )
    kept = reason.isin("dual_pass_keep", "dual_pass_agreed")
    state = F.when(F.length(a["new_state"]) <= F.length(b["new_state"]), a["new_state"]).otherwise(b["new_state"])
    return F.struct(F.when(kept, a["changed"]).alias("changed"), F.when(kept, state).alias("new_state"), reason.alias("reason"))


def supervision_state(status: Column, update: Column, verified_null: Column) -> Column:
    """verified_update, verified_hard_null or masked_unknown; null where the label can't be."""
    text, sure = F.trim(update), F.coalesce(verified_null, F.lit(False))
    known = F.lower(F.trim(status)).isin("present", "absent")
    return F.when(known & ~(sure & update.isNotNull()) & ~F.coalesce(text == "", F.lit(False)), F.when(update.isNotNull(), "verified_update").when(sure, "verified_hard_null").otherwise("masked_unknown"))


def loss_scale(state: Column) -> Column:
    """1 where the whole answer is supervised; null where the memory's value is masked."""
    return F.when(state.isin("verified_update", "verified_hard_null"), F.lit(1.0))


#: Where an API teacher's label comes from, for an absent target with and without an update, and a present one.
DISAPPEARANCE_SOURCE, ABSENCE_SOURCE = "dataset_gt_disappearance_transition_v1", "dataset_gt_continued_absence_v1"
UPDATE_SOURCE, KEEP_SOURCE = "frontier_api_teacher_v1", "frontier_api_teacher_hard_null_v1"


def label_source(status: Column, update: Column) -> Column:
    """Where a label comes from: an absent target's is a fact of the data set, another's the teacher's."""
    gone = F.coalesce(status == "absent", F.lit(False))
    return F.when(gone & update.isNotNull(), DISAPPEARANCE_SOURCE).when(gone, ABSENCE_SOURCE).when(update.isNotNull(), UPDATE_SOURCE).otherwise(KEEP_SOURCE)
