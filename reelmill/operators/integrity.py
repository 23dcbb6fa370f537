"""What must hold across the rows of a sampling plan, as a table of what doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.operators.evaluation import KEY

SAMPLED_PRIOR, FIXED_ANCHOR = "sampled_prior", "fixed_identity_anchor"


def plan_violations(cases: DataFrame, sequences: DataFrame, totals: DataFrame, caps: DataFrame | None = None, policy: str = SAMPLED_PRIOR) -> DataFrame:
    """(rule, dataset, sequence, place, detail): a row for each breach of a plan.

    cases (dataset, sequence, place, frame_id, reference_id) in the plan's order by place,
    a null reference_id standing for the anchor; sequences (dataset, sequence, anchor,
    present_count, absent_count); totals, one row (sequence_count, case_count,
    present_count, absent_count, actual_absent_ratio); caps (place, dataset, cap). Under
    the fixed policy no frame is used twice and every reference is the anchor. dataset,
    sequence and place are null where a rule is about the whole plan.
    """
    if policy not in (SAMPLED_PRIOR, FIXED_ANCHOR):
        raise ValueError(f"unknown reference policy {policy}")
    order = Window.partitionBy(*KEY).orderBy("place")
    named = cases.join(sequences.groupBy(*KEY).agg(F.min("anchor").alias("anchor")), list(KEY), "left")
    named = named.withColumn("reference", F.coalesce("reference_id", "anchor")).withColumn("last", F.lag("frame_id").over(order))
    pair, frame = Window.partitionBy(*KEY, "frame_id", "reference").orderBy("place"), Window.partitionBy(*KEY, "frame_id").orderBy("place")
    named = named.withColumns({"nth_pair": F.row_number().over(pair), "nth_frame": F.row_number().over(frame)})
    fixed = F.lit(policy == FIXED_ANCHOR)
    of_cases = _breaches(named, "place", {
        "sequence_not_planned": F.col("anchor").isNull(),
        "frames_not_sorted": F.col("frame_id") < F.col("last"),
        "reference_not_before": F.col("reference").isNull() | (F.col("reference") < 0) | (F.col("reference") >= F.col("frame_id")),
        "pair_repeated": F.col("nth_pair") > 1,
        "frame_repeated": fixed & (F.col("nth_frame") > 1),
        "reference_not_anchor": fixed & ~F.col("reference").eqNullSafe(F.col("anchor")),
    }, F.concat_ws(" of ", F.col("reference").cast("string"), F.col("frame_id").cast("string")))
    counts = cases.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    listed = sequences.join(counts, list(KEY), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("anchor")))
    present, absent = F.col("present_count"), F.col("absent_count")
    of_sequences = _breaches(listed.withColumn("place", F.lit(None).cast("long")), "place", {
        "name_empty": (F.trim(F.coalesce("dataset", F.lit(""))) == "") | (F.trim(F.coalesce("sequence", F.lit(""))) == ""),
        "anchor_negative": F.col("anchor") < 0,
        "counts_differ": (present < 0) | (absent < 0) | (present + absent != F.col("n")),
        "sequence_repeated": F.col("nth") > 1,
    }, F.concat_ws(" ", present.cast("string"), absent.cast("string"), F.col("n").cast("string")))
    of_plan = _totals(cases, sequences, totals)
    found = of_cases.unionByName(of_sequences).unionByName(of_plan)
    return found.unionByName(_caps(caps)) if caps is not None else found


def _breaches(rows: DataFrame, place: str, rules: dict[str, Column], detail: Column) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(rule)) for rule, c in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), *KEY, F.col(place).cast("long").alias("place"), detail.alias("detail"))


def _totals(cases: DataFrame, sequences: DataFrame, totals: DataFrame) -> DataFrame:
    """The breaches of a plan's sums; each side is one row."""
    have = sequences.agg(F.count(F.lit(1)).alias("h_sequences"), F.coalesce(F.sum("present_count"), F.lit(0)).alias("h_present"), F.coalesce(F.sum("absent_count"), F.lit(0)).alias("h_absent"))
    rows = totals.limit(1).join(have, F.lit(True)).join(cases.agg(F.count(F.lit(1)).alias("h_cases")), F.lit(True))
    of = lambda c: F.col(c)
    ratio = F.abs(of("absent_count") / of("case_count") - of("actual_absent_ratio")) > 1.0 / of("case_count")
    rules = {
        "plan_empty": of("h_sequences") == 0,
        "sequence_count_differs": of("sequence_count") != of("h_sequences"),
        "case_count_differs": of("case_count") != of("h_cases"),
        "present_count_differs": of("present_count") != of("h_present"),
        "absent_count_differs": of("absent_count") != of("h_absent"),
        "cases_not_present_and_absent": of("case_count") != of("present_count") + of("absent_count"),
        "ratio_differs": (of("case_count") > 0) & ratio,
    }
    none = F.lit(None).cast("string")
    plain = rows.withColumns({"dataset": none, "sequence": none, "place": F.lit(None).cast("long")})
    return _breaches(plain, "place", rules, F.concat_ws(" ", *[of(c).cast("string") for c in ("sequence_count", "case_count", "present_count", "absent_count", "actual_absent_ratio")]))


def _caps(caps: DataFrame) -> DataFrame:
    """The breaches of the caps by data set: names are lower-case, sorted and there once, caps are positive."""
    order = Window.orderBy("place")  # a row a data set
    rows = caps.withColumns({"last": F.lag("dataset").over(order), "sequence": F.lit(None).cast("string")})
    name = F.col("dataset")
    return _breaches(rows, "place", {
        "cap_name_not_lower": name.isNull() | (F.trim(name) == "") | (name != F.lower(F.trim(name))),
        "cap_not_positive": F.coalesce(F.col("cap") <= 0, F.lit(True)),
        "cap_repeated": name == F.col("last"),
        "caps_not_sorted": name < F.col("last"),
    }, F.col("cap").cast("string"))


def replay_differences(plan: DataFrame, again: DataFrame) -> DataFrame:
    """(dataset, sequence, frame_id, reference_id, side): the cases that only the plan or only its replay has, as often as they differ."""
    own = [*KEY, "frame_id", "reference_id"]
    left, right = plan.select(*own), again.select(*own)
    return left.exceptAll(right).withColumn("side", F.lit("plan")).unionByName(right.exceptAll(left).withColumn("side", F.lit("replay")))
