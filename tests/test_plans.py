"""Sweeps, mining, samples, plans, packing and backends on small tables."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from reelmill.functions import decisions as dc
from reelmill.functions import protocol as pr
from reelmill.functions import text as tx
from reelmill.operators import audit, backend, integrity, mining, packing, replay, samples
from reelmill.operators import labels as lb

SEGMENT = "dataset string, sequence string, name string, start_frame int, end_frame int, text string"


def spans(spark, rows):
    return spark.createDataFrame([("mgit", s, f"a{i}", a, b, t) for i, (s, a, b, t) in enumerate(rows)], SEGMENT)


def frames_of(spark, shown):
    return spark.createDataFrame([("mgit", s, i, "present" if c == "T" else "absent") for s, line in shown.items() for i, c in enumerate(line)], "dataset string, sequence string, frame_id int, gt_presence string")


def brute_at(rows, s, f):
    texts = {t for q, a, b, t in rows if q == s and a <= f <= b}
    return (texts.copy().pop() if len(texts) == 1 else None, len(texts) > 1)


def random_spans(seed, n=40):
    rng = random.Random(seed)
    return [(rng.choice("st"), a := rng.randrange(0, 60), a + rng.randrange(-1, 12), rng.choice(["A", "B", "C"])) for _ in range(n)]


def test_sweep_is_the_interval_join(spark):
    rows = random_spans(1)
    points = spark.createDataFrame([("mgit", s, f, f) for s in "stu" for f in range(80)] + [("mgit", "s", 5, 99)], "dataset string, sequence string, frame_id int, number int")
    got = lb.state_at(points, spans(spark, rows))
    assert got.columns == [*points.columns, "state", "ambiguous"] and dict(got.dtypes)["frame_id"] == "int"
    found = got.collect()
    assert len(found) == 241
    for r in found:
        assert (r.state, r.ambiguous) == brute_at(rows, r.sequence, r.frame_id), r
    edges = sorted({(q, e) for q, a, b, _ in rows for e in (a, b + 1) if e > 0})
    want = [(q, e) for q, e in edges if brute_at(rows, q, e)[1] or brute_at(rows, q, e - 1)[1] or brute_at(rows, q, e) != brute_at(rows, q, e - 1)]
    assert sorted((r.sequence, r.frame_id) for r in lb.boundaries(spans(spark, rows)).collect()) == want


def test_long_texts_never_become_updates(spark):
    words, chars = " ".join(["word"] * 31), "x" * 257
    rows = [("s", 0, 4, "a man walks"), ("s", 5, 9, words), ("s", 10, 14, "y" * 256), ("s", 15, 19, chars), ("s", 20, 24, " ".join(["ab"] * 30))]
    plan = spark.createDataFrame([("mgit", "s", f, False) for f in (2, 7, 12, 17, 22)], "dataset string, sequence string, frame_id int, absent boolean")
    got = {r.frame_id: (r.reason, r.input_state) for r in lb.state_labels(plan, spans(spark, rows), margin=0).collect()}
    assert got[7] == ("update_text_exceeds_label_limit", "a man walks") and got[17] == ("update_text_exceeds_label_limit", "y" * 256)
    assert got[12] == ("action_segment_text_changed", "a man walks") and got[22] == ("action_segment_text_changed", "y" * 256)


def test_texts_are_anchored_at_the_reference(spark):
    rows = [("s", 0, 4, "walks"), ("s", 5, 9, "rides"), ("s", 8, 9, "sits"), ("t", 0, 9, "flies")]
    cases = [("mgit", "s", 9, 6), ("mgit", "s", 9, 8), ("mgit", "s", 30, 20), ("lasot", "t", 9, 3), (" MGIT", "t", 9, 3), ("mgit", "u", 9, 3), ("mgit", "s", 9, None)]
    df = spark.createDataFrame([(*c, "first", "start") for c in cases], "dataset string, sequence string, frame_id int, reference_id int, text string, text_source string")
    made = lb.reanchored(df, spans(spark, rows).unionByName(spans(spark, [("t", 0, 9, "flies")]).withColumn("dataset", F.lit(" MGIT"))))
    got = sorted((r.dataset, r.sequence, r.reference_id or -1, r.frame_id, r.text, r.text_source) for r in made.collect())
    anchored = "mgit_reference_action_description"
    want = [("mgit", "s", 6, 9, "rides", anchored), ("mgit", "s", 8, 9, "first", "start"), ("mgit", "s", 20, 30, "first", "start"), ("lasot", "t", 3, 9, "first", "start"), (" MGIT", "t", 3, 9, "flies", anchored), ("mgit", "u", 3, 9, "first", "start"), ("mgit", "s", -1, 9, "first", "start")]
    assert got == sorted(want)


def brute_probes(rows, shown, margin, per_segment, per_run):
    def uniform(values, k):
        if k <= 0 or len(values) <= k:
            return values if k > 0 else []
        return [values[round(i * (len(values) - 1) / (k - 1))] if k > 1 else values[0] for i in range(k)]

    found = set()
    for s, line in shown.items():
        own = [r for r in rows if r[0] == s]
        if "T" not in line or not own:
            continue
        anchor = line.index("T")
        edges = {e for _, a, b, _ in own for e in (a, b + 1) if e > anchor}
        for _, a, b, text in own:
            ids = [f for f in range(max(a, anchor + 1), min(b, len(line) - 1) + 1) if line[f] == "T" and brute_at(rows, s, f) == (text, False)]
            if ids:
                found.add((s, ids[0], "update"))
                found |= {(s, f, "stable") for f in uniform([f for f in ids if not edges or min(abs(f - e) for e in edges) >= margin], per_segment)}
        run = []
        for f in range(anchor + 1, len(line) + 1):
            if f < len(line) and line[f] == "F":
                run.append(f)
            else:
                found |= {(s, x, "absent") for x in uniform(run, per_run)}
                run = []
    return found


@pytest.mark.parametrize(("seed", "margin", "per_segment", "per_run"), [(1, 2, 2, 1), (2, 1, 3, 2), (3, 0, 1, 0), (4, 3, 0, 3)])
def test_probes_match_brute_force(spark, seed, margin, per_segment, per_run):
    rng = random.Random(seed)
    rows = [r for r in random_spans(seed, 14) if r[1] <= r[2]]
    shown = {s: "".join(rng.choice("TTTTF") for _ in range(70)) for s in "stu"} | {"v": "FFFF"}
    got = mining.probes(frames_of(spark, shown), spans(spark, rows), margin, per_segment, per_run)
    assert {(r.sequence, r.frame_id, r.kind) for r in got.collect()} == brute_probes(rows, shown, margin, per_segment, per_run)


def test_mined_plan_counts(spark):
    shown = {"s": "FTTTTTTTFFTTTTTT"}
    frames = frames_of(spark, shown)
    mined = mining.mined_labels(frames, spans(spark, [("s", 0, 7, "walks"), ("s", 8, 20, "rides")]), margin=2)
    plan = mining.mined_plan(mined, frames).collect()[0]
    assert (plan.anchor, plan.cases, plan.present_count, plan.absent_count, plan.absent_run_count) == (1, plan.present_count + 1, plan.present_count, 1, 1)
    by_source = {r.frame_id: (r.source, r.target_status, r.memory_update) for r in mined.collect()}
    assert by_source[10] == (mining.UPDATE_SOURCE, "present", "rides") and by_source[8] == (mining.NULL_SOURCE, "absent", None)


def test_sample_types_have_exact_totals(spark):
    quota = spark.createDataFrame([("d", f"s{i}", n) for i, n in enumerate([0, 1, 7, 100, 333])], "dataset string, sequence string, n_samples int")
    made = samples.sample_types(quota, 5).collect()
    counts = {}
    for r in made:
        counts.setdefault(r.sequence, {}).setdefault(r.sample_type, []).append(r.sample)
    assert {s: sum(map(len, c.values())) for s, c in counts.items()} == {"s1": 1, "s2": 7, "s3": 100, "s4": 333}
    for s, n in (("s3", 100), ("s4", 333)):
        for name, share in samples.TYPES[1:]:
            assert len(counts[s][name]) == int(n * share)
    assert sorted(map(tuple, samples.sample_types(quota.repartition(5), 5).collect())) == sorted(map(tuple, made))
    assert sorted(counts["s3"]["current_absent"]) != list(range(15))  # dealt, not in a row
    with pytest.raises(ValueError, match="add up"):
        samples.sample_types(quota, 5, (("a", 0.5),))


def test_samples_lie_where_they_must(spark):
    rng = random.Random(2)
    shown = {f"s{i}": "".join(rng.choice("TTTF") for _ in range(n)) for i, n in enumerate([5, 30, 80, 300])} | {"gone": "F" * 90}
    frames = frames_of(spark, shown).withColumn("gt", F.when(F.col("gt_presence") == "present", F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((10, 20, 30, 40), "xywh")])))
    quota = spark.createDataFrame([("mgit", s, 40) for s in shown], "dataset string, sequence string, n_samples int")
    typed = samples.sample_types(quota, 3)
    placed = samples.placed_samples(frames, typed, 3, max_span=50, history=2, interval=5).collect()
    assert {r.sequence for r in placed} == {"s1", "s2", "s3", "gone"}
    for r in placed:
        line = shown[r.sequence]
        assert 0 <= r.init_id <= max(0, len(line) - 51) and 10 <= r.current_id - r.init_id <= 50 and r.current_id < len(line)
        wanted = "F" if r.sample_type in ("current_absent", "mixed_hard") else "T"
        assert line[r.current_id] == wanted or wanted not in line[r.init_id + 10 : r.init_id + 51]
        assert r.history == [f for f in (r.current_id - 10, r.current_id - 5) if f > r.init_id]
    drawn = samples.sample_frames(spark.createDataFrame(placed), frames, 3).collect()
    assert len(drawn) == sum(2 + len(r.history) for r in placed)
    kinds = {(r.sequence, r.sample): r.sample_type for r in placed}
    for r in drawn:
        if r.role == "current" and kinds[r.sequence, r.sample] in ("current_absent", "mixed_hard"):
            assert r.visible is False and tuple(r.box) == (0, 0, 0, 0)
        if r.noise == "moved" and r.box:
            assert 4 <= r.box.x <= 16 and 21 <= r.box.w <= 39
        assert r.noise is None or r.role == "current" or kinds[r.sequence, r.sample] in ("history_noisy", "mixed_hard")
    assert {r.noise for r in drawn} == {None, "moved", "hidden"}


CASE, LISTED = "dataset string, sequence string, place int, frame_id int, reference_id int", "dataset string, sequence string, anchor int, present_count int, absent_count int"
TOTALS = "sequence_count long, case_count long, present_count long, absent_count long, actual_absent_ratio double"


def broken(spark, cases, listed=(("d", "s", 0, 2, 1),), totals=(1, 3, 2, 1, 1 / 3), caps=None, policy=integrity.SAMPLED_PRIOR):
    given = spark.createDataFrame(caps, "place int, dataset string, cap int") if caps else None
    rows = integrity.plan_violations(spark.createDataFrame(cases, CASE), spark.createDataFrame(list(listed), LISTED), spark.createDataFrame([totals], TOTALS), given, policy)
    return sorted({r.rule for r in rows.collect()})


def test_each_breach_of_a_plan_is_found(spark):
    good = [("d", "s", 0, 1, 0), ("d", "s", 1, 4, 0), ("d", "s", 2, 4, None)]
    assert broken(spark, [*good[:2], ("d", "s", 2, 5, None)]) == []
    assert broken(spark, good) == ["pair_repeated"]
    assert broken(spark, [good[1], ("d", "s", 2, 1, 0), ("d", "s", 3, 5, 0)]) == ["frames_not_sorted"]
    assert broken(spark, [good[0], ("d", "s", 1, 4, 4), ("d", "s", 2, 5, -1)]) == ["reference_not_before"]
    fine = [*good[:2], ("d", "s", 2, 5, 0)]
    assert broken(spark, fine, policy=integrity.FIXED_ANCHOR) == []
    assert broken(spark, [good[0], ("d", "s", 1, 4, 0), ("d", "s", 2, 4, 1)], policy=integrity.FIXED_ANCHOR) == ["frame_repeated", "reference_not_anchor"]
    assert broken(spark, fine, [("d", "s", -1, 2, 1)]) == ["anchor_negative"]
    assert broken(spark, fine, [("d", "s", 0, 2, 2)], (1, 3, 2, 2, 2 / 3)) == ["cases_not_present_and_absent", "counts_differ"]
    assert "sequence_repeated" in broken(spark, fine, [("d", "s", 0, 2, 1)] * 2)
    assert broken(spark, [*fine, ("d", "other", 0, 2, 1)])[:2] == ["case_count_differs", "sequence_not_planned"]
    assert broken(spark, fine, totals=(2, 4, 3, 0, 0.9)) == ["absent_count_differs", "case_count_differs", "cases_not_present_and_absent", "present_count_differs", "ratio_differs", "sequence_count_differs"]
    assert broken(spark, fine, caps=[(0, "b", 1), (1, "a", 0), (2, "A ", 3), (3, "A ", 3)]) == ["cap_name_not_lower", "cap_not_positive", "cap_repeated", "caps_not_sorted"]
    assert broken(spark, [("", "s", 0, 1, 0)], [("", "s", 0, 1, 0)], (1, 1, 1, 0, 0.0)) == ["name_empty"]
    assert broken(spark, [], [], (0, 0, 0, 0, 0.0)) == ["plan_empty"]
    with pytest.raises(ValueError, match="policy"):
        broken(spark, fine, policy="other")


def test_replays_are_compared_as_often_as_cases_repeat(spark):
    plan = spark.createDataFrame([("d", "s", 0, 1, 0), ("d", "s", 1, 1, 0), ("d", "s", 2, 4, None)], CASE)
    again = spark.createDataFrame([("d", "s", 0, 1, 0), ("d", "s", 2, 4, None), ("d", "s", 2, 5, 1)], CASE)
    assert {(r.frame_id, r.side) for r in integrity.replay_differences(plan, again).collect()} == {(1, "plan"), (5, "replay")}


def plain_longest_first(loads, bins):
    heap, found = [(0, w) for w in range(bins)], {}
    for name, load in sorted(loads, key=lambda x: (-x[1], x[0])):
        used, w = heapq.heappop(heap)
        found[name] = w
        heapq.heappush(heap, (used + load, w))
    return found


@pytest.mark.parametrize(("seed", "top", "bins"), [(1, 5, 3), (2, 60, 4), (3, 1, 7), (4, 0, 2), (5, 1000, 1)])
def test_loads_are_dealt_as_one_by_one(spark, seed, top, bins):
    rng = random.Random(seed)
    loads = [(f"k{i:03d}", rng.randint(0, top)) for i in range(150)]
    got = packing.longest_first(spark.createDataFrame(loads, "k string, load long"), "k", "load", bins, "bin").collect()
    assert {r.k: r.bin for r in got} == plain_longest_first(loads, bins)


def test_two_levels_of_workers(spark):
    rng = random.Random(9)
    loads = [(f"k{i:03d}", rng.randint(1, 30)) for i in range(90)]
    got = packing.lpt_shards(spark.createDataFrame(loads, "k string, load int"), "k", "load", 3, 2).collect()
    machine = plain_longest_first(loads, 3)
    assert {r.k: r.machine for r in got} == machine
    worker = {}
    for m in range(3):
        worker |= plain_longest_first([x for x in loads if machine[x[0]] == m], 2)
    assert {r.k: r.worker for r in got} == worker


def test_backends_are_loaded_once_and_keep_failures_to_their_rows(spark, tmp_path):
    log = str(tmp_path / "loads")

    class Fussy:
        def __init__(self, settings):
            with open(log, "a") as f:
                f.write("x\n")
            self.sign = settings["sign"]

        def generate(self, requests):
            assert set(requests[0]) == {"prompt"}
            if any(r["prompt"] == "bad" for r in requests):
                raise RuntimeError("no " * 300)
            return [None if r["prompt"] is None else r["prompt"] + self.sign for r in requests]

    backend.register_backend("fussy", Fussy)
    rows = [(i, "bad" if i % 10 == 3 else None if i == 5 else f"p{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "i int, prompt string").coalesce(1)
    got = {r.i: r for r in backend.answered(df, "fussy", {"sign": "!"}, batch=7, requests=("prompt",)).collect()}
    assert len(got) == 50 and {i for i in got if got[i].status == "model_error"} == {i for i in range(50) if i % 10 == 3}
    assert got[4].answer == "p4!" and got[5].answer is None and got[5].status == "ok"
    assert got[3].answer is None and got[3].error_type == "RuntimeError" and len(got[3].error_message) == backend.MESSAGE
    assert len(open(log).read().split()) == 1
    with pytest.raises(ValueError, match="unknown backend"):
        backend.answered(df, "none")
    with pytest.raises(ValueError, match="name of its own"):
        backend.register_backend("fussy", Fussy)
    assert "fussy" in backend.available_backends()
    assert backend.answered(df.limit(0), "fussy", {"sign": ""}, requests=("prompt",)).count() == 0


def test_a_backend_that_gives_too_few_answers_is_asked_row_by_row(spark):
    class Short:
        def __init__(self, settings):
            pass

        def generate(self, requests):
            return [r["p"] for r in requests][:1]

    backend.register_backend("short", Short)
    got = backend.answered(spark.createDataFrame([(f"p{i}",) for i in range(5)], "p string").coalesce(1), "short", batch=5).collect()
    assert [r.answer for r in got] == [f"p{i}" for i in range(5)]


def test_rewards_have_names(spark):
    df = spark.createDataFrame([('{"target_status":"absent","bbox_2d":null}', '{"target_status":"absent","bbox_2d":null}')], "c string, r string")
    made = backend.rewarded(df, F.col("c"), F.col("r"), ("format", "bbox"), (1.0, 0.5)).collect()[0]
    assert (made.reward_format, made.reward_bbox, made.reward) == (1.0, 1.0, 1.5)
    with pytest.raises(ValueError, match="unknown rewards"):
        backend.rewarded(df, F.col("c"), F.col("r"), ("style",))


@pytest.mark.parametrize("state", [
    "the man now also carries a backpack down the street", "the target is unchanged from the earlier observation here", "the same as before but closer to the camera now",
    "a man who probably wants to cross the street soon", "the person inside the red box walking on a road", "the target visible in Image 2 walking along a road",
])
def test_states_that_lean_on_something_are_refused(spark, state):
    assert teacher(spark, state) == "ungrounded_or_relative_phrasing"


@pytest.mark.parametrize("state", [
    "yellow airplane flying in the air, viewed from below", "brown airplane in flight, seen from below", "green airplane flying in the air from a side perspective", "yellow airplane flying in a different orientation",
    "whole body of the man in white, now standing with a rear view", "a white car driving along the road with motion blur", "the man walking down the street, partially occluded",
])
def test_states_that_tell_the_view_are_refused(spark, state):
    assert teacher(spark, state) == "observation_not_state"


@pytest.mark.parametrize("state", ["a man in a red jacket riding a bicycle on a city road", "the man in white climbing a wooden structure", "yellow airplane landing on a runway", "the man standing upright in a garden", "a man is still on the road"])
def test_states_of_the_target_are_taken(spark, state):
    assert teacher(spark, state) is None


def teacher(spark, state):
    raw = '{"state_changed": true, "reason_code": "interaction_changed", "new_state": "' + state + '"}'
    return dc.with_teacher(spark.createDataFrame([(raw,)], "t string"), F.col("t"), "d").first().d.rejection


def test_verifiers(spark):
    rows = [('{"accept": true, "failure_mode": "none"}', True, "none"), ('{"accept": "False", "failure_mode": "Not_Visible"}', False, "not_visible"), ('{"accept": true, "failure_mode": "x"}', None, "accept_with_failure_mode"), ('{"accept": 1}', None, "non_boolean_accept"), ("no", None, "unparseable_json"), ('{"accept": false}', False, "unspecified")]
    df = spark.createDataFrame(rows, "t string, a boolean, r string").withColumn("v", dc.verifier(tx.json_in_prose(F.col("t"))))
    assert all((x.v.accept, x.v.reason) == (x.a, x.r) for x in df.collect())
    rows = [('{"accept_keep": true, "failure_mode": "none"}', True, "none"), ('{"accept_keep": false, "failure_mode": "clear_state_change"}', False, "clear_state_change"), ('{"accept_keep": false, "failure_mode": "none"}', None, "reject_keep_without_failure_mode"), ('{"accept_keep": true, "failure_mode": "insufficient_evidence"}', None, "accept_keep_with_failure_mode"), ('{"accept_keep": true}', None, "unknown_keep_failure_mode")]
    df = spark.createDataFrame(rows, "t string, a boolean, r string").withColumn("v", dc.keep_verifier(tx.json_in_prose(F.col("t"))))
    assert all((x.v.accept, x.v.reason) == (x.a, x.r) for x in df.collect())


def test_revisits(spark):
    df = spark.createDataFrame([("A man walks.", ["a dog", "a man walks"]), ("A man walks.", ["a dog sleeps"]), ("", ["", "x"]), ("A man walks", None)], "n string, h array<string>")
    assert [r[0] for r in df.select(tx.is_revisit(F.col("n"), F.col("h"))).collect()] == [True, False, False, False]


def test_texts_that_only_begin_with_json_are_not_json(spark):
    texts = ['{"a":1}', ' {"a":1}\n', '{"a":1},"end"]', '{"a":1},"end"] trailing words', '{"a":1} {"b":2}', '{"a":1}x', "[1]", '```json\n{"a":1}\n```', "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.strict_json(F.col("t")).isNotNull()).collect()]
    assert got == [True, True, False, False, False, False, False, True, False, False]
    masked = ['{"a":1,"memory_update":null}', '{"a":1,"memory_update":"x" y}', '{"a":1,"memory_update":{"b":[1]}}']
    assert [r[0] is not None for r in spark.createDataFrame([(t,) for t in masked], "t string").select(tx.masked_response(F.col("t"))).collect()] == [True, False, True]


def test_scopes(spark):
    rows = [("initial_target", "mgit", False), ("First_Action_Description ", "mgit", False), ("full_video_story", "lasot", True), ("class_name", "MGIT", True), (None, "mgit", True), ("initial_description", "lasot", False)]
    df = spark.createDataFrame(rows, "s string, d string, u boolean").withColumn("got", pr.is_unsafe_scope(F.col("s"), F.col("d")))
    assert all(r.got == r.u for r in df.collect())


def test_label_sources(spark):
    rows = [("absent", "x", dc.DISAPPEARANCE_SOURCE), ("absent", None, dc.ABSENCE_SOURCE), ("present", "x", dc.UPDATE_SOURCE), ("present", None, dc.KEEP_SOURCE), (None, None, dc.KEEP_SOURCE)]
    df = spark.createDataFrame(rows, "s string, u string, w string").withColumn("got", dc.label_source(F.col("s"), F.col("u")))
    assert all(r.got == r.w for r in df.collect())


def test_observation_sources(spark):
    frames = spark.range(6).select(F.lit("d").alias("dataset"), F.explode(F.array(F.lit("s"), F.lit("t"))).alias("sequence"), F.col("id").cast("int").alias("frame_id"))
    own = spark.createDataFrame([("d", "s", 2), ("d", "s", 2)], "dataset string, sequence string, frame_id int")
    listed = spark.createDataFrame([("s", 1), ("s", 4), ("t", 6)], "sequence string, frame_id int")
    seen = lambda **k: {(r.sequence, r.frame_id) for r in replay.observed(frames, **k).where("observed").collect()}
    every = {(s, f) for s in "st" for f in range(6)}
    assert seen(mode="dense") == every and seen(missing="dense") == every
    assert seen(own=own) == {("s", 0), ("s", 2)} | {x for x in every if x[0] == "t"}
    assert seen(own=own, missing="none", first=False) == {("s", 2)}
    assert seen(own=own, listed=listed, base=1) == {("s", 0), ("s", 3), ("t", 0), ("t", 5)}
    assert seen(own=own, listed=listed.select("frame_id").where("frame_id < 6"), base=1) == {(s, f) for s in "st" for f in (0, 3)}
    assert seen(own=own, listed=listed, explicit=[5]) == {(s, f) for s in "st" for f in (0, 5)}
    assert seen(explicit=[], missing="error") == {("s", 0), ("t", 0)}
    with pytest.raises(ValueError, match="without keyframes"):
        replay.observed(frames, own=own, missing="error")
    with pytest.raises(ValueError, match="outside"):
        replay.observed(frames, listed=listed)
    with pytest.raises(ValueError, match="choices"):
        replay.observed(frames, base=2)


RECORD = "id int, messages array<struct<role:string,content:string>>, images array<string>, objects struct<bbox:array<array<double>>,bbox_type:string,image_id:array<int>>, solution string"


def test_records_break_rules_by_their_codes(spark):
    good = '{"target_status":"present","bbox_2d":<bbox>,"memory_update":"a man walks"}'
    box, images = [[1.0, 2.0, 3.0, 4.0]], ["a/b.jpg"]
    talk = [("user", "<image> where"), ("assistant", good)]
    rows = [
        (0, talk, images, (box, "real", [0]), None), (1, None, images, None, None), (2, [None, ("user", "x")], images, (box, None, [0]), None),
        (3, [("bot", None), *talk], ["a/../a/./b.jpg"], (box, "odd", [1]), None), (4, talk, images, None, None), (5, talk, images, (box * 2, "norm1", [0, 0]), None),
        (6, [("user", "<image><image><image>")], ["", "/x.jpg", "a/../../b.jpg"], None, '{"target_status":"absent","bbox_2d":null} junk'), (7, [("user", "hi")], [], None, '{"target_status":"absent","bbox_2d":null}'),
        (8, [("user", "<image>"), ("assistant", '{"target_status":"absent"}'), ("assistant", '{"target_status":"absent","bbox_2d":null,"memory_update":" "}')], ["gone.jpg"], None, None),
    ]
    listing = spark.createDataFrame([("a/b.jpg",), ("other.jpg",)], "path string")
    found = {}
    for r in audit.all_issues(spark.createDataFrame(rows, RECORD), "id", listing).collect():
        found.setdefault(r.id, []).append((r.code, r.place))
    assert {k: sorted(v) for k, v in found.items()} == {
        1: [("answer.missing", -1), ("images.token_mismatch", -1), ("messages.invalid", -1), ("messages.user_missing", -1)],
        2: [("answer.missing", -1), ("images.token_mismatch", -1), ("message.invalid", 0)],
        3: [("message.content", 0), ("message.role", 0), ("objects.bbox_type", -1), ("objects.image_id", -1)],
        4: [("objects.missing", -1)], 5: [("objects.bbox_count", -1), ("objects.image_id_count", -1)],
        6: [("answer.protocol", 0), ("image.absolute", 1), ("image.escape", 2), ("image.path", 0)],
        7: [("images.invalid", -1)], 8: [("answer.protocol", 0), ("answer.protocol", 1), ("image.missing", 0)],
    }


def test_a_capital_is_one_letter(spark, tmp_path):
    import duckdb

    from reelmill import plans

    starts = ["ß", "ŉ", "ﬁ", "ǆ", "ᾳ", "ᾈ", "ΐ", "և", "é", "a", "A", "7", "", " b", "\x0b", "a\x0bb c", "𐐨"]
    spark.createDataFrame([(i, t + "heit und mehr") for i, t in enumerate(starts)] + [(98, ""), (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in plans.queries()["text_gate"](spark, str(tmp_path)).collect())
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(connection.sql(plans.oracle_sql()["text_gate"]).fetchall())
    assert tx.SMALL[0] == "ß" and len(tx.SMALL) == len(tx.CAPITAL)


def test_samples_meet_their_frames_without_a_join(spark):
    frames = frames_of(spark, {"s": "T" * 40 + "F" * 20, "t": "TF" * 40}).withColumn("gt", F.struct(*[F.lit(1.0).alias(n) for n in "xywh"]))
    typed = samples.sample_types(spark.createDataFrame([("mgit", "s", 30), ("mgit", "t", 30), ("mgit", "none", 5)], "dataset string, sequence string, n_samples int"), 3)
    placed = samples.placed_samples(frames, typed, 3, max_span=50, history=2, interval=5)
    drawn = samples.sample_frames(placed, frames, 3)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    # rows are dealt by sequence once in either step, as one row a sample; no join and no order of hashes shuffles them again
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 2
    held = {(r.sequence, r.sample): r for r in placed.collect()}
    rows = drawn.collect()
    assert {(r.sequence, r.sample) for r in rows} == set(held) and len(rows) == sum(2 + len(r.history) for r in held.values())
    noisy = {}
    for r in rows:
        noisy[r.sequence, r.sample] = noisy.get((r.sequence, r.sample), 0) + (r.role == "history" and r.noise is not None)
    assert all((n in (1, 2)) if held[k].sample_type in ("history_noisy", "mixed_hard") else n == 0 for k, n in noisy.items())
