"""Seeded allocation of sample types over sequences, and the frames that each sample takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.boxes import box
from reelmill.functions.hashing import hash_byte, order_key
from reelmill.operators.evaluation import KEY
from reelmill.session import dealt

#: The types in their order, with their shares; the first takes what rounding leaves.
TYPES = (("pure_positive", 0.70), ("current_absent", 0.15), ("history_noisy", 0.10), ("mixed_hard", 0.05))


def sample_types(quota: DataFrame, seed: int, types: tuple[tuple[str, float], ...] = TYPES) -> DataFrame:
    """quota (dataset, sequence, n_samples) -> (dataset, sequence, sample, sample_type), sample from 0.

    Each type gets the floor of its share of a sequence's samples and the first type the
    rest; which sample gets which is a hash order. Shares must add up to one.
    """
    if abs(sum(share for _, share in types) - 1) > 0.01:
        raise ValueError("the shares of sample types must add up to 1")
    rows = quota.where("n_samples > 0").select(*KEY, "n_samples", F.explode(F.sequence(F.lit(0), F.col("n_samples").cast("int") - 1)).alias("sample"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(order_key(seed, *KEY, "sample"), "sample")) - 1
    rows = rows.withColumn("place", place)
    kind, upto = F.lit(types[0][0]), F.lit(0)
    chosen = F.lit(None).cast("string")
    for name, share in types[1:]:
        here = F.floor(F.col("n_samples") * F.lit(share)).cast("int")
        chosen = F.coalesce(chosen, F.when((F.col("place") >= upto) & (F.col("place") < upto + here), F.lit(name)))
        upto = upto + here
    return rows.select(*KEY, "sample", F.coalesce(chosen, kind).alias("sample_type"))


def _share(seed: int, what: str, *extra: str) -> Column:
    """A number in [0, 1) that the seed, the sample and what is drawn give."""
    digits = F.substring(order_key(f"{seed}:{what}", *KEY, "sample", *extra), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**48)


def placed_samples(frames: DataFrame, typed: DataFrame, seed: int, max_span: int = 200, history: int = 3, interval: int = 10) -> DataFrame:
    """typed with init_id, current_id and history (frame ids in time order) of each sample that its sequence has room for.

    The current frame lies at least max(10, history * interval) and at most max_span
    frames after the first one; absent types take an absent frame of that range if there
    is one, the others a present one. Frames are numbered within their sequence from 0.
    The n-th such frame of a range is found by counts up to its ends, not by a list.
    """
    # frames and samples are rows of one table, dealt by sequence once; what a join would look up, windows find
    by, is_frame = Window.partitionBy(*KEY), F.col("frame_id").isNotNull()
    kinds = frames.where(_named()).select(*KEY, "frame_id", F.coalesce(F.col("gt_presence") == "absent", F.lit(False)).alias("gone"))
    rows = typed.select(*KEY, "sample", "sample_type").unionByName(kinds, allowMissingColumns=True)
    rows = dealt(rows, rows.count(), *KEY)
    order = by.orderBy("frame_id")
    rows = rows.withColumns({"n_gone": F.count_if(F.col("gone")).over(order), "n_shown": F.count_if(~F.col("gone")).over(order)}).withColumn("length", F.count("frame_id").over(by).cast("int"))
    least = max(10, history * interval)
    room = F.greatest(F.lit(0), F.col("length") - max_span - 1)
    rows = rows.withColumn("init_id", F.when(~is_frame, F.floor(_share(seed, "init") * (room + 1)).cast("int")))
    rows = rows.withColumns({"from_id": F.col("init_id") + least, "to_id": F.col("init_id") + F.least(F.lit(max_span), F.col("length") - F.col("init_id") - 1)}).where(is_frame | (F.col("to_id") >= F.col("from_id")))
    counts = F.when(is_frame, F.struct("n_gone", "n_shown"))
    rows = _looked_up(rows, {"at": F.when(is_frame, F.col("frame_id") + 1).otherwise(F.col("from_id"))}, counts, "before")
    rows = _looked_up(rows, {"at": F.coalesce("frame_id", "to_id")}, counts, "upto")
    wants_gone = F.col("sample_type").isin("current_absent", "mixed_hard")
    n_gone, n_shown = F.col("upto.n_gone") - F.col("before.n_gone"), F.col("upto.n_shown") - F.col("before.n_shown")
    # a range without a frame of the wanted kind gives any of its frames, which are then all of the other kind
    gone = F.when(is_frame, F.col("gone")).otherwise(F.when(wants_gone, n_gone > 0).otherwise(n_shown == 0))
    rows = rows.withColumn("gone", gone).where(is_frame | (F.col("before").isNotNull() & F.col("upto").isNotNull()))
    drawn = lambda n, before: before + 1 + F.floor(_share(seed, "current") * n)
    nth = F.when(F.col("gone"), drawn(n_gone, F.col("before.n_gone"))).otherwise(drawn(n_shown, F.col("before.n_shown")))
    nth = F.when(is_frame, F.when(F.col("gone"), F.col("n_gone")).otherwise(F.col("n_shown"))).otherwise(nth).cast("long")
    rows = _looked_up(rows, {"gone": F.col("gone"), "at": nth}, F.col("frame_id"), "current_id").where(~is_frame & F.col("current_id").isNotNull())
    ids = F.filter(F.transform(F.sequence(F.lit(history), F.lit(1), F.lit(-1)), lambda i: (F.col("current_id") - i * interval).cast("int")), lambda x: x > F.col("init_id"))
    return rows.withColumn("history", ids).where(F.size("history") > 0).select(*KEY, "sample", "sample_type", "init_id", "current_id", "history")


def _named() -> Column:
    return F.col("dataset").isNotNull() & F.col("sequence").isNotNull()


def _looked_up(rows: DataFrame, at: dict[str, Column], value: Column, out: str) -> DataFrame:
    """rows with out: the value, not null in one row at most, of the rows of their sequence with the same at."""
    return rows.withColumns(at).withColumn(out, F.first(value, ignorenulls=True).over(Window.partitionBy(*KEY, *at)))


def sample_frames(placed: DataFrame, frames: DataFrame, seed: int) -> DataFrame:
    """(dataset, sequence, sample, role, place, frame_id, box, visible, noise): the frames of each sample.

    Noisy types have one or two of their history frames disturbed: each is shifted by up
    to a fifth and scaled by 0.7 to 1.3, or shown as absent. Absent types show no target
    in the current frame, whatever the truth says.
    """
    noisy = F.col("sample_type").isin("history_noisy", "mixed_hard")
    count = F.when(noisy, F.least(F.size("history"), 1 + hash_byte(order_key(f"{seed}:count", *KEY, "sample"), 0) % 2)).otherwise(0)
    keys = F.when(noisy, F.transform("history", lambda x, i: order_key(f"{seed}:noisy", *KEY, "sample", i)))
    role = lambda name, place, at, disturbed, hidden: F.struct(F.lit(name).alias("role"), place.alias("place"), at.alias("frame_id"), disturbed.alias("disturbed"), hidden.alias("hidden"))
    no, none_here = F.lit(False), F.lit(0)
    roles = F.concat(
        F.array(role("init", none_here, F.col("init_id"), no, no)),
        F.transform("history", lambda x, i: role("history", i, x, F.coalesce(F.size(F.filter("keys", lambda k: k < F.get("keys", i))) < F.col("count"), no), no)),
        F.array(role("current", none_here, F.col("current_id"), no, F.col("sample_type").isin("current_absent", "mixed_hard"))),
    )
    own = F.array(role(None, none_here, F.col("frame_id"), no, no))
    # samples are dealt by sequence as one row each, together with the frames; their frames are found by a window
    truth = frames.where(_named()).select(*KEY, "frame_id", F.struct("gt", (F.col("gt_presence") == "present").alias("shown")).alias("truth"))
    both = placed.select(*KEY, "sample", "sample_type", "init_id", "current_id", "history").unionByName(truth, allowMissingColumns=True)
    both = dealt(both, frames.count(), *KEY)
    rows = both.withColumns({"count": count, "keys": keys}).select(*KEY, "sample", "truth", F.explode(F.when(F.col("truth").isNotNull(), own).otherwise(roles)).alias("f")).select(*KEY, "sample", "truth", "f.*")
    rows = _looked_up(rows, {"frame_id": F.col("frame_id")}, F.col("truth"), "found").where("truth is null and found is not null").select(*KEY, "sample", "role", "place", "frame_id", "disturbed", "hidden", "found.*")
    kind = F.when(F.col("disturbed"), F.when(_share(seed, "kind", "place") < 0.5, "moved").otherwise("hidden"))
    rows = rows.withColumn("noise", F.when(F.col("hidden"), "hidden").otherwise(kind))
    gt, by = F.col("gt"), lambda what, lo, hi: lo + _share(seed, what, "place") * (hi - lo)
    scale = by("scale", 0.7, 1.3)
    moved = box(gt["x"] + by("x", -0.2, 0.2) * gt["w"], gt["y"] + by("y", -0.2, 0.2) * gt["h"], gt["w"] * scale, gt["h"] * scale)
    none = box(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    made = F.when(F.col("noise") == "hidden", none).when(F.col("noise") == "moved", moved).otherwise(gt)
    shown = F.when(F.col("noise") == "hidden", False).otherwise(F.col("shown"))
    return rows.select(*KEY, "sample", "role", "place", "frame_id", made.alias("box"), shown.alias("visible"), "noise")
