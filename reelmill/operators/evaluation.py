"""Localisation and classification metrics of canonical frames.

Frames have dataset, sequence, frame_id, gt and pred boxes, presences, identities,
execution_status and is_observation_frame. A sequence is the key (dataset,
sequence). All three conventions for unobserved frames come from one window pass
and one aggregation.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions import normalise
from reelmill.functions.boxes import center_error, iou, is_valid, normalised_center_error

KEY = ("dataset", "sequence")
#: Thresholds of the three curves, the datasets whose absent frames miss, the conventions.
SUCCESS = tuple(i / 20.0 for i in range(21))
PRECISION = tuple(float(i) for i in range(51))
NORMALISED = tuple(i / 100.0 for i in range(51))
ABSENT_MISSES = ("lasot", "cognitivebench")
CONVENTIONS = ("dense_zero", "hold_last", "observation_only")


def thresholds_passed(value: Column, thresholds: tuple[float, ...]) -> Column:
    """How many thresholds a value exceeds; a sum of comparisons stays inside generated code."""
    return reduce(add, [F.when(value > F.lit(t), 1).otherwise(0) for t in thresholds])


def thresholds_met(value: Column, thresholds: tuple[float, ...]) -> Column:
    """How many thresholds a value is at or below."""
    return reduce(add, [F.when(value <= F.lit(t), 1).otherwise(0) for t in thresholds])


def ordered(*extra: str) -> Window:
    return Window.partitionBy(*KEY, *extra).orderBy("frame_id")


def with_main_masks(frames: DataFrame) -> DataFrame:
    """Adds non_obs, carry and missing: what the three conventions are made of.

    Sequences without a single observation flag count as unobserved where a prediction
    is missing. carry is the last prediction before a frame; an observed failure stays
    a failure and does not erase it.
    """
    flagged = F.max(F.col("is_observation_frame").isNotNull()).over(Window.partitionBy(*KEY))
    missing = F.col("pred").isNull()
    carry = F.last("pred", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumns({
        "missing": missing,
        "non_obs": F.when(flagged, F.coalesce(~F.col("is_observation_frame"), F.lit(False))).otherwise(missing),
        "carry": carry,
    })


def main_frames(frames: DataFrame) -> DataFrame:
    """A row for each frame and convention: scored, success, precision and norm_precision thresholds hit, and single hits."""
    first = F.first("dataset").over(ordered())  # a sequence's own dataset decides its branch
    begins = F.col("frame_id") == F.min("frame_id").over(Window.partitionBy(*KEY))
    masked = with_main_masks(frames).withColumns({"branch": first, "begins": begins})
    per = masked.withColumn("convention", F.explode(F.array(*[F.lit(c) for c in CONVENTIONS])))
    fill = (F.col("convention") == "hold_last") & F.col("non_obs") & F.col("missing")
    held = F.when(fill, F.col("carry")).otherwise(F.col("pred"))
    visible = F.coalesce(F.col("gt_presence") != "absent", F.lit(True))
    per = per.withColumns({"sparse": held.isNull(), "used": F.when(F.col("begins"), F.col("gt")).otherwise(held), "visible": visible})
    ok = is_valid(F.col("gt")) & F.col("visible") & ~F.col("sparse") & F.col("used").isNotNull()
    per = per.withColumns({
        "ok": ok,
        "scored": (F.col("convention") != "observation_only") | ~F.col("non_obs"),
        "iou": F.when(ok, iou(F.col("gt"), F.col("used"))),
        "ec": F.when(ok, center_error(F.col("gt"), F.col("used"))),
        "en": F.when(ok, normalised_center_error(F.col("gt"), F.col("used"))),
    })
    # a frame that can't be judged has a normalised error below all thresholds, unless it is sparse or a dataset counts it as missed
    free = ~F.col("ok") & ~F.col("sparse") & ~(F.col("branch").isin(*ABSENT_MISSES) & ~F.col("visible"))
    return per.withColumns({
        "success": F.coalesce(thresholds_passed(F.col("iou"), SUCCESS), F.lit(0)),
        "op50": F.coalesce(F.col("iou") > SUCCESS[10], F.lit(False)),
        "op75": F.coalesce(F.col("iou") > SUCCESS[15], F.lit(False)),
        "p20": F.coalesce(F.col("ec") <= PRECISION[20], F.lit(False)),
        "pn20": F.coalesce(F.col("en") <= NORMALISED[20], F.lit(False)) | free,
        "free": free,
    })


def share(condition: Column) -> Column:
    """The share of rows that meet a condition."""
    return F.avg(condition.cast("double"))


def main_sequences(frames: DataFrame) -> DataFrame:
    """(convention, dataset, sequence, n_scored, auc, op50, op75, p20, pn20, avg_overlap) over the scored frames of each sequence.

    Sequences without a scored frame are left out, as invalid ones are.
    """
    scored = main_frames(frames).where("scored")
    return scored.groupBy("convention", *KEY).agg(
        F.count(F.lit(1)).alias("n_scored"),
        (F.avg("success") / float(len(SUCCESS))).alias("auc"),
        *[share(F.col(c)).alias(c) for c in ("op50", "op75", "p20", "pn20")],
        F.avg("iou").alias("avg_overlap"),
    )


def main_scores(frames: DataFrame) -> DataFrame:
    """The headline figures: each convention's equal-weight mean over sequences."""
    return main_sequences(frames).groupBy("convention").agg(
        F.count(F.lit(1)).alias("n_sequences"), *[F.avg(c).alias(c) for c in ("auc", "op50", "op75", "p20", "pn20")]
    )


def curve(values: DataFrame, key: tuple[str, ...], value: str, thresholds: tuple[float, ...], exceed: bool) -> DataFrame:
    """(*key, threshold, n, share): of a group's rows, those whose value exceeds (or else is within) each threshold.

    values has a row a frame; a null value never hits. Each frame is counted once, in
    the bin that its thresholds end at, and the bins are summed up by a window: frames
    are not multiplied by thresholds.
    """
    n = len(thresholds)
    bin_ = (thresholds_passed if exceed else thresholds_met)(F.col(value), thresholds)
    bins = values.groupBy(*key, F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = bins.groupBy(*key).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    grid = totals.select(*key, "total", "by_bin", F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("i", "threshold"))
    # exceeding threshold i means that i + 1 are passed at least; being within it, that all from i on are met
    least = F.col("i") + 1 if exceed else F.lit(n) - F.col("i")
    hit = F.aggregate(F.map_entries("by_bin"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] >= least, e["value"]).otherwise(0))
    return grid.select(*key, "threshold", F.col("total").alias("n"), (hit / F.col("total")).alias("share"))


def macro(curves: DataFrame, over: tuple[str, ...] = ()) -> DataFrame:
    """Equal-weight mean of sequences' curves: (*over, threshold, n_sequences, share)."""
    return curves.groupBy(*over, "threshold").agg(F.count(F.lit(1)).alias("n_sequences"), F.avg("share").alias("share"))


def benchmark_frames(frames: DataFrame) -> DataFrame:
    """Frames of known ground truth with iou, ec and en; null, and so a failure, where the target is absent or its box invalid."""
    ok = (F.col("gt_presence") == "present") & is_valid(F.col("gt")) & is_valid(F.col("pred"))
    return frames.where(F.col("gt_presence").isin("present", "absent")).select(
        *KEY, "frame_id",
        F.when(ok, iou(F.col("gt"), F.col("pred"))).alias("iou"),
        F.when(ok, center_error(F.col("gt"), F.col("pred"))).alias("ec"),
        F.when(ok, normalised_center_error(F.col("gt"), F.col("pred"))).alias("en"),
    )


def headline(values: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(*key, n_frames, auc, op50, op75, p20, pn20, mean_iou) of frames with iou, ec, en; null values never hit."""
    hit = lambda c: share(F.coalesce(c, F.lit(False)))
    return values.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_frames"),
        (F.avg(F.coalesce(thresholds_passed(F.col("iou"), SUCCESS), F.lit(0))) / float(len(SUCCESS))).alias("auc"),
        hit(F.col("iou") > SUCCESS[10]).alias("op50"), hit(F.col("iou") > SUCCESS[15]).alias("op75"),
        hit(F.col("ec") <= PRECISION[20]).alias("p20"), hit(F.col("en") <= NORMALISED[20]).alias("pn20"),
        F.avg("iou").alias("mean_iou"),
    )


def visible_frames(frames: DataFrame) -> DataFrame:
    """Frames whose target is present with a valid box; only predictions committed as present count."""
    pred = F.when((F.col("pred_presence") == "present") & ~normalise.is_error(F.col("execution_status")), F.col("pred"))
    seen = frames.where((F.col("gt_presence") == "present") & is_valid(F.col("gt")))
    return seen.select(
        *KEY, "frame_id",
        F.coalesce(iou(F.col("gt"), pred), F.lit(0.0)).alias("iou"),
        center_error(F.col("gt"), pred).alias("ec"), normalised_center_error(F.col("gt"), pred).alias("en"),
    )


def confusion(frames: DataFrame, key: tuple[str, ...], gt: str, pred: str, yes: str, no: str) -> DataFrame:
    """Counts and rates of a decision between yes and no. Frames without a ground truth don't count.

    uncertain is a refusal; other values and frames that failed are unavailable. Rates
    without a denominator are null.
    """
    refused = F.coalesce(F.col(pred) == "uncertain", F.lit(False))
    usable = F.coalesce(F.col(pred).isin(yes, no), F.lit(False)) & ~normalise.is_error(F.col("execution_status"))
    n = lambda c: F.count_if(c)
    is_ = lambda g, p: ~refused & usable & (F.col(gt) == g) & (F.col(pred) == p)
    known = frames.where(F.col(gt).isin(yes, no))
    counted = (known.groupBy(*key) if key else known).agg(
        F.count(F.lit(1)).alias("evaluated"), n(is_(yes, yes)).alias("tp"), n(is_(no, yes)).alias("fp"), n(is_(no, no)).alias("tn"), n(is_(yes, no)).alias("fn"),
        n(refused).alias("uncertain"), n(~refused & ~usable).alias("unavailable"),
    )
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, tn, fn, total = (F.col(c) for c in ("tp", "fp", "tn", "fn", "evaluated"))
    rates = counted.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumns({
        "f1": F.try_divide(F.lit(2.0) * p * r, p + r),
        "false_positive_rate": div(fp, fp + tn), "miss_rate": div(fn, tp + fn),
        "uncertain_coverage": div(F.col("uncertain"), total), "decision_coverage": div(tp + fp + tn + fn, total),
        "unavailable_rate": div(F.col("unavailable"), total), "selective_accuracy": div(tp + tn, tp + fp + tn + fn),
    })


def presence_confusion(frames: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    return confusion(frames, key, "gt_presence", "pred_presence", "present", "absent")


def identity_confusion(frames: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    return confusion(frames, key, "gt_identity", "pred_identity", "same", "different")


def execution_counts(frames: DataFrame) -> DataFrame:
    """(execution_status, n, is_error) of all frames."""
    return frames.groupBy("execution_status").agg(F.count(F.lit(1)).alias("n")).withColumn("is_error", normalise.is_error(F.col("execution_status")))


def execution_rates(frames: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    seen = F.col("is_observation_frame")
    rows = frames.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(normalise.is_error(F.col("execution_status"))).alias("errors"),
        F.count(seen).alias("labelled"), F.count_if(seen).alias("observed"),
    )
    return rows.withColumns({"error_rate": div(F.col("errors"), F.col("total")), "observation_rate": div(F.col("observed"), F.col("labelled"))})


def reappearances(frames: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """(dataset, sequence, start_frame, delay): a row for each change from absent to present; delay is null if never recovered.

    The target must be found before it next isn't present: by a frame without an error
    that says present, not another identity, with a box good enough.
    """
    before = F.lag("gt_presence").over(ordered())
    present = F.coalesce(F.col("gt_presence") == "present", F.lit(False))
    starts = present & ~F.coalesce(F.lag(present).over(ordered()), F.lit(False))
    marked = frames.withColumns({"present": present, "starts": starts, "event": F.coalesce(starts & (before == "absent"), F.lit(False))})
    runs = marked.withColumn("run", F.sum(F.col("starts").cast("int")).over(ordered())).where("present")
    found = (
        ~normalise.is_error(F.col("execution_status"))
        & (F.col("pred_presence") == "present")
        & F.coalesce(F.col("pred_identity") != "different", F.lit(True))
        & F.coalesce(iou(F.col("gt"), F.col("pred")) >= least_iou, F.lit(False))
    )
    events = runs.groupBy(*KEY, "run").agg(F.max("event").alias("event"), F.min("frame_id").alias("start_frame"), F.min(F.when(found, F.col("frame_id"))).alias("found"))
    return events.where("event").select(*KEY, "start_frame", (F.col("found") - F.col("start_frame")).alias("delay"))


def recovery(events: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Events, rate and the mean, median and longest delay over all events together."""
    rows = events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("events"), F.count("delay").alias("recovered"), F.avg("delay").alias("mean_delay"),
        F.median("delay").alias("median_delay"), F.max("delay").alias("max_delay"),
    )
    return rows.withColumn("recovery_rate", F.try_divide(F.col("recovered").cast("double"), F.col("events").cast("double")))


def run_times(frames: DataFrame, time_col: str = "time") -> DataFrame:
    """(dataset, sequence, n_frames, errors, seconds, fps) of a run's frames."""
    rows = frames.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(normalise.is_error(F.col("execution_status"))).alias("errors"), F.sum(time_col).alias("seconds"))
    return rows.withColumn("fps", F.try_divide(F.col("n_frames").cast("double"), F.col("seconds")))
