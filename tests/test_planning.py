"""Plans of absent and present frames against plain Python, and how often their frames are read."""

import random

import pytest
from pyspark.sql import functions as F

from reelmill.operators import planning as pl
from reelmill.plans.planning import _quota


def spread(items, k):
    if k <= 0 or len(items) <= k:
        return list(items) if k > 0 else []
    return [items[round(i * (len(items) - 1) / (k - 1))] if k > 1 else items[0] for i in range(k)]


def runs_of(ids):
    made = []
    for f in sorted(set(ids)):
        if made and made[-1][1] == f - 1:
            made[-1][1] = f
        else:
            made.append([f, f])
    return made


def brute_absent(ids, k):
    chosen = spread(runs_of(ids), k)
    both = {a for a, _ in chosen}
    both |= set(spread([b for _, b in chosen], k - len(chosen)))
    return sorted(both) + spread([f for f in sorted(ids) if f not in both], k - len(both))


def brute_present(ids, gone, k):
    sides = {x for a, b in runs_of(gone) for x in (a - 1, b + 1)}
    border = spread([f for f in sorted(ids) if f in sides], k)
    return border + spread([f for f in sorted(ids) if f not in border], k - len(border))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, quota = [], []
    for s in range(12):
        lines = [(f, "absent" if rng.random() < 0.5 else "present") for f in range(1, 40) if rng.random() < 0.9]
        lines += [rng.choice(lines) for _ in range(s % 3)]  # repeated frames
        rows += [("d", f"s{s}", f, p) for f, p in lines]
        quota.append(("d", f"s{s}", 2, rng.randrange(0, 25), rng.randrange(0, 12)))
    frames = spark.createDataFrame(rows, "dataset string, sequence string, frame_id int, gt_presence string")
    plan = spark.createDataFrame([(d, s, a, n + k, k) for d, s, a, n, k in quota], "dataset string, sequence string, anchor int, target long, absent long")
    absent, present = pl.plan_absent(frames, plan).collect(), pl.plan_present(frames, plan).collect()
    for _, s, a, n, k in quota:
        gone, shown = ([f for _, q, f, p in rows if q == s and f > a and p == kind] for kind in ("absent", "present"))
        assert sorted(r.frame_id for r in absent if r.sequence == s) == sorted(brute_absent(gone, k))
        assert sorted(r.frame_id for r in present if r.sequence == s) == sorted(brute_present(shown, gone, n))


@pytest.mark.parametrize("made", [pl.plan_absent, pl.plan_present])
def test_a_plan_reads_its_frames_once(spark, sf_dir, made):
    plan = made(*_quota(spark, sf_dir)).select(F.col("frame_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events") + plan.count("Relation [") <= 1, plan
