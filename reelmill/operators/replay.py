"""The online loop over recorded frames: state machine, memory and fusion, without a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions import normalise
from reelmill.operators.evaluation import KEY, ordered
from reelmill.operators.fold import folded


def observed(frames: DataFrame, own: DataFrame | None = None, explicit: list[int] | None = None, listed: DataFrame | None = None, base: int = 0, mode: str = "keyframe", missing: str = "dense", first: bool = True) -> DataFrame:
    """(dataset, sequence, frame_id, observed, reason) of frames: which of them a tracker may look at.

    Dense looks at all. Otherwise keyframes count, from the first source that is given:
    explicit ids for every sequence, listed (a file's, with or without a sequence column),
    own (dataset, sequence, frame_id), the data set's. explicit and listed count from
    base, 0 or 1. Frame 0 is looked at if first says so. A sequence without keyframes is
    dense, not looked at, or an error, as missing says; keyframes outside of a sequence
    are an error. Keyframes are joined by frame, so that no list grows with a sequence.
    """
    if base not in (0, 1) or missing not in ("dense", "none", "error") or mode not in ("dense", "keyframe"):
        raise ValueError(f"base, missing or mode is none of the choices: {base}, {missing}, {mode}")
    ids = frames.select(*KEY, "frame_id")
    if mode == "dense":
        return ids.withColumns({"observed": F.lit(True), "reason": F.lit("dense")})
    spark, names = frames.sparkSession, frames.select(*KEY).distinct()
    if explicit is not None:
        given = spark.createDataFrame([(int(i) - base,) for i in set(explicit)], "frame_id int")
        keys = names.join(F.broadcast(given), F.lit(True)) if explicit else None
    elif listed is not None:
        moved = listed.withColumn("frame_id", (F.col("frame_id") - base).cast("int"))
        keys = names.join(moved.select("sequence", "frame_id").distinct(), "sequence") if "sequence" in listed.columns else names.join(moved.select("frame_id").distinct(), F.lit(True))
        keys = keys.select(*KEY, "frame_id")
    else:
        keys = own.select(*KEY, "frame_id").distinct() if own is not None else None
    everyone = explicit is not None or (listed is not None and "sequence" not in listed.columns)
    if keys is None:
        keys = ids.limit(0)
    has = names.withColumn("__has", F.lit(True)) if everyone else keys.select(*KEY).distinct().withColumn("__has", F.lit(True))
    sizes = frames.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n"))
    _none(keys.join(sizes, list(KEY)).where("frame_id < 0 or frame_id >= __n"), "keyframes outside of their sequence")
    if missing == "error":
        _none(names.join(has, list(KEY), "left_anti"), "sequences without keyframes")
    rows = ids.join(keys.withColumn("__key", F.lit(True)), [*KEY, "frame_id"], "left").join(has, list(KEY), "left")
    reason = (
        F.when((F.col("frame_id") == 0) & F.lit(first), "initial_frame")
        .when(F.col("__has").isNull(), "missing_keyframes_fallback_dense" if missing == "dense" else "missing_keyframes")
        .when(F.col("__key"), "keyframe")
        .otherwise("non_keyframe")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select(*KEY, "frame_id", F.col("reason").isin("initial_frame", "missing_keyframes_fallback_dense", "keyframe").alias("observed"), "reason")


def _none(rows: DataFrame, what: str) -> None:
    if some := rows.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def execution_of(output: Column, box: Column, seen: Column) -> Column:
    """The status of a frame's raw output (VARIANT): what its execution says, as an object or a word, or else skipped where nothing was looked at and no box came back."""
    raw = lambda path, kind: F.try_variant_get(output, path, kind)
    kind = F.schema_of_variant(raw("$.execution", "variant"))
    said = F.when(kind.startswith("OBJECT"), F.coalesce(raw("$.execution.status", "string"), F.lit("ok"))).when(kind == "STRING", raw("$.execution", "string"))
    return F.coalesce(said, F.when(~seen & box.isNull(), "skipped").otherwise("ok"))


def with_ground_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results (dataset, sequence, frame_id, ...) with ground_truth, struct<target_presence, bbox_xywh, annotation_valid, identity_match>; null without a truth.

    truth (dataset, sequence, frame_id, gt, visible, identity) is joined after the run, so
    that nothing of it can reach a tracker. visible decides where it is known, the box
    elsewhere; an absent target has no box, and a present one without a valid box is an
    annotation that isn't valid.
    """
    from reelmill.functions.boxes import is_valid

    valid = F.coalesce(is_valid(F.col("gt")), F.lit(False))
    present = F.coalesce(F.col("visible"), valid)
    made = F.struct(
        F.when(present, "present").otherwise("absent").alias("target_presence"), F.when(present & valid, F.col("gt")).alias("bbox_xywh"),
        (~present | valid).alias("annotation_valid"), F.col("identity").alias("identity_match"),
    )
    own = truth.select(*KEY, "frame_id", made.alias("ground_truth"))
    return results.join(own, [*KEY, "frame_id"], "left")


def cognitive_state(frames: DataFrame, search_after: int = 3, recover_after: int = 1) -> DataFrame:
    """(dataset, sequence, frame_id, phase, absent_duration, uncertain_duration, error_duration) of recorded frames.

    The machine needs no fold: each counter counts events since the last one that
    resets it, a difference of prefix sums. Skipped frames count for nothing and keep the
    phase of the frame before. The first frame sets the state up.
    """
    status, first = F.col("execution_status"), F.row_number().over(ordered()) == 1
    ok = status == "ok"
    trusted = ok & (F.col("pred_presence") == "present") & F.coalesce(F.col("pred_identity") == "same", F.lit(False)) & F.col("pred").isNotNull()
    kind = (
        F.when(first | trusted, "trusted")
        .when(ok & (F.col("pred_presence") == "absent"), "absent")
        .when(ok, "unsure").when(status == "skipped", "skipped").otherwise("error")
    )
    k = frames.withColumn("kind", kind)
    total = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("int")).over(ordered())
    k = k.withColumns({"n_trusted": total("trusted"), "n_absent": total("absent"), "n_unsure": total("unsure", "error"), "n_error": total("error"), "n_decided": total("trusted", "absent", "unsure"), "n_broken": total("absent", "unsure", "error")})
    since = lambda count, *resets: F.col(count) - F.coalesce(F.last(F.when(F.col("kind").isin(*resets), F.col(count)), ignorenulls=True).over(ordered()), F.lit(0))
    k = k.withColumns({
        "absent_duration": since("n_absent", "trusted"),
        "uncertain_duration": since("n_unsure", "trusted", "absent"),
        "error_duration": since("n_error", "trusted", "absent", "unsure"),
        "in_row": since("n_trusted", "absent", "unsure", "error"),
    })
    phase = (
        F.when(F.col("kind") == "trusted", F.when(first | (F.col("in_row") >= recover_after), "confirmed").otherwise("uncertain"))
        .when(F.col("kind") == "absent", "searching")
        .when(F.col("kind") == "unsure", F.when(F.col("uncertain_duration") >= search_after, "searching").otherwise("uncertain"))
        .when(F.col("kind") == "error", "uncertain")
    )
    k = k.withColumn("phase", F.last(phase, ignorenulls=True).over(ordered()))
    return k.select(*KEY, "frame_id", "phase", "absent_duration", "uncertain_duration", "error_duration")


def semantic_event(states: DataFrame, frames: DataFrame) -> DataFrame:
    """(dataset, sequence, frame_id, event): what a decided frame means after the absent frames before it."""
    before = F.lag("absent_duration").over(ordered())
    joined = states.withColumn("gone", F.coalesce(before, F.lit(0)) > 0).join(frames.select(*KEY, "frame_id", "pred_presence"), [*KEY, "frame_id"])
    p = F.col("pred_presence")
    event = F.when(p == "present", F.when(F.col("gone"), "reappearance").otherwise("continuous_present")).when(p == "absent", F.when(F.col("gone"), "continued_absence").otherwise("disappearance"))
    return joined.withColumn("event", event).select(*KEY, "frame_id", "event")


def memory_bank(records: DataFrame, capacity: dict[str, int]) -> DataFrame:
    """What a bank holds in the end: of each kind the latest records of different ids, as many as it has room for."""
    once = Window.partitionBy(*KEY, "record_id").orderBy("frame_id")
    room = F.lit(0)
    for kind, n in capacity.items():
        room = F.when(F.col("kind") == kind, n).otherwise(room)
    latest = Window.partitionBy(*KEY, "kind").orderBy(F.desc("frame_id"), F.desc("record_id"))
    first = records.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    return first.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= room).drop("__n")


def fusion(initial: Column, observed_: Column, vlm_status: Column, vlm_box: Column, committed: Column, base_box: Column, base_status: Column, presence: Column, identity: Column, on_rejection: str = "suppress", on_uncommitted: str = "fallback") -> Column:
    """struct<source, presence, reason>: whose box a frame publishes, and what it claims about the target."""
    base_ok = (base_status == "ok") & base_box.isNotNull()
    base = F.when(base_ok, "baseline").otherwise("none")
    rejection = F.when(presence == "absent", "absent").when(identity == "different", "different").when(presence == "uncertain", "presence_refused").when(identity == "uncertain", "identity_refused")
    vlm_ok = vlm_status == "ok"
    used = vlm_ok & committed & vlm_box.isNotNull()
    suppress = F.when(rejection.isNotNull(), F.lit(on_rejection == "suppress")).otherwise(F.lit(on_uncommitted == "suppress"))
    own = F.coalesce(F.when(presence.isin("absent", "uncertain"), presence), F.lit("uncertain"))
    present_if = lambda c: F.when(c, "present").otherwise("uncertain")
    row = lambda source, claim, reason: F.struct(source.alias("source"), claim.alias("presence"), F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"))
    return (
        F.when(initial & used, row(F.lit("vlm"), F.lit("present"), "initialised"))
        .when(initial, row(base, present_if(base_ok), "initial_fallback"))
        .when(~observed_, row(base, present_if(base_ok), "not_observed"))
        .when(~vlm_ok, row(base, F.lit("uncertain"), "vlm_error"))
        .when(used, row(F.lit("vlm"), F.lit("present"), "committed"))
        .when(suppress, row(F.lit("suppressed"), own, F.coalesce(rejection, F.lit("uncommitted"))))
        .otherwise(row(base, F.when(base_ok, "uncertain").otherwise(own), F.coalesce(rejection, F.lit("uncommitted"))))
    )


def decision_presence(status: Column, presence: Column) -> Column:
    """A failed answer is its error, never an absence."""
    return F.when(normalise.is_error(status), status).otherwise(F.coalesce(presence, F.lit("uncertain")))


def gated_updates(candidates: DataFrame, confirmations: int = 2, max_gap: int = 30, min_gap: int = 5) -> DataFrame:
    """candidates (dataset, sequence, frame_id, eligible) with accepted: the gate of positive memories alone.

    Eligible candidates must follow one another within max_gap; enough of them in a row
    are accepted if min_gap frames have passed since the last accepted one. What is
    accepted feeds back, so that a sequence is folded in order. operators.memory has all
    gates.
    """

    def step(s: dict, row: dict) -> dict:
        frame, last = row["frame_id"], s["last"]
        if not row["eligible"]:
            s.update(streak=0, last=None)
            return {"eligible": row["eligible"], "accepted": False}
        streak = s["streak"] + 1 if last is not None and 0 < frame - last <= max_gap else 1
        take = streak >= confirmations and (s["accepted"] is None or frame - s["accepted"] >= min_gap)
        s.update(streak=streak, last=frame, accepted=frame if take else s["accepted"])
        return {"eligible": True, "accepted": take}

    rows = candidates.select(*KEY, "frame_id", "eligible")
    return folded(rows, KEY, ("frame_id",), lambda: {"streak": 0, "last": None, "accepted": None}, step, "eligible boolean, accepted boolean")


def verifier_replay(labels: DataFrame) -> DataFrame:
    """labels (dataset, sequence, frame_id, update, accept, initial) judged again in order: input_state and verdict.

    Only accepted updates move the state on; one that says what is there already once
    refused ones are gone is vacuous and moves nothing.
    """

    def step(s: dict, row: dict) -> dict:
        state = row["initial"] if s["state"] is None else s["state"]
        plain = lambda x: (x or "").strip().lower().rstrip(".")
        verdict = "rejected" if not row["accept"] else "vacuous" if plain(row["update"]) == plain(state) else "accepted"
        s["state"] = row["update"] if verdict == "accepted" else state
        return {"input_state": state, "verdict": verdict}

    return folded(labels, KEY, ("frame_id",), lambda: {"state": None}, step, "input_state string, verdict string")


def label_chain(cases: DataFrame, predict: Callable[[str, str], str | None], initial: str = "") -> DataFrame:
    """cases (dataset, sequence, frame_id, status, prompt) labelled in order by predict(prompt, state); absent frames are not asked.

    predict is the boundary to a model: it returns a new state, or None to keep the old one.
    """

    def step(s: dict, row: dict) -> dict:
        state = s["state"]
        update = None if row["status"] == "absent" else predict(row["prompt"], state)
        s["state"] = update or state
        return {"input_state": state, "memory_update": update}

    return folded(cases, KEY, ("frame_id",), lambda: {"state": initial}, step, "input_state string, memory_update string")


def similarity(a: str, b: str) -> Column:
    """The matching ratio of two text columns by longest common blocks, case and blanks aside; 0 if either is empty."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        flat = [(" ".join((s or "").casefold().split()), " ".join((t or "").casefold().split())) for s, t in zip(x, y, strict=True)]
        return pd.Series([SequenceMatcher(None, s, t).ratio() if s and t else 0.0 for s, t in flat])

    return ratio(a, b)


def similar_pairs(rows: DataFrame, a: str, b: str, least: float, out: str = "ratio") -> DataFrame:
    """The rows whose two texts are alike to least or more, with their ratio.

    A ratio is at most twice the shorter text's share of both lengths: rows that this
    bound rules out never leave the JVM.
    """
    flat = lambda c: F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\s+", " "))
    n, m = F.length(flat(a)), F.length(flat(b))
    # lower-casing may be shorter than the case folding that the ratio uses, by a factor of three at most
    bound = F.try_divide(2.0 * F.least(n, m) * 3, n + m)
    bound = F.when(flat(a).rlike("^[\\x00-\\x7F]*$") & flat(b).rlike("^[\\x00-\\x7F]*$"), F.try_divide(2.0 * F.least(n, m), n + m)).otherwise(bound)
    kept = rows.where(F.coalesce(bound, F.lit(0.0)) >= least)
    return kept.withColumn(out, similarity(F.col(a), F.col(b))).where(F.col(out) >= least)
