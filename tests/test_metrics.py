"""Metrics on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from reelmill.operators import evaluation as ev

SCHEMA = "sequence string, dataset string, frame_id int, gt struct<x:double,y:double,w:double,h:double>, pred struct<x:double,y:double,w:double,h:double>, gt_presence string, pred_presence string, gt_identity string, pred_identity string, execution_status string, is_observation_frame boolean"
BOX, FAR = (0.0, 0.0, 10.0, 10.0), (100.0, 100.0, 10.0, 10.0)


def row(sequence="s", frame=0, gt=BOX, pred=BOX, gp="present", pp="present", dataset="default", status="ok", seen=True, pi=None):
    return (sequence, dataset, frame, gt, pred, gp, pp, None, pi, status, seen)


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def scores(df):
    return {r.convention: r for r in ev.main_scores(df).collect()}


def test_sparse_conventions(table):
    got = scores(table(row(), row(frame=1, pred=None, pp=None, status="skipped", seen=False), row(frame=2, pred=FAR)))
    assert [round(got[c].p20, 9) for c in ev.CONVENTIONS] == [round(1 / 3, 9), round(2 / 3, 9), 0.5]


def test_hybrid_prediction_on_unobserved_frames_is_not_scored(table):
    got = scores(table(row(), row(frame=1, status="skipped", seen=False), row(frame=2, pred=FAR)))
    assert got["observation_only"].p20 == 0.5


def test_perfect_tracker_misses_the_last_threshold(table):
    assert scores(table(row(), row(frame=1)))["dense_zero"].auc == pytest.approx(20 / 21)


def test_macro_and_micro(table):
    df = table(row("short"), *[row("long", i, pred=FAR) for i in range(9)])
    curves = ev.headline(ev.benchmark_frames(df), ev.KEY)
    macro = curves.agg(F.avg("p20"), F.avg("auc")).first()
    assert macro[0] == 0.5 and macro[1] == pytest.approx(10 / 21)
    micro = ev.headline(ev.visible_frames(df), ()).first()
    assert micro.p20 == pytest.approx(0.1) and micro.auc == pytest.approx(2 / 21)
    assert scores(df)["dense_zero"].p20 == pytest.approx(5 / 9)


def test_absent_frames(table):
    df = table(row(), row(frame=1, gt=None, pred=None, gp="absent", pp="absent"))
    assert ev.headline(ev.benchmark_frames(df), ()).first().p20 == 0.5
    assert ev.headline(ev.visible_frames(df), ()).first().p20 == 1.0
    assert ev.presence_confusion(df).first().tn == 1 and scores(df)["dense_zero"].pn20 == 0.5


def test_published_and_committed(table):
    df = table(row(pp="uncertain"))
    assert ev.headline(ev.benchmark_frames(df), ()).first().p20 == 1.0
    assert ev.headline(ev.visible_frames(df), ()).first().p20 == 0.0
    assert scores(df)["dense_zero"].p20 == 1.0


@pytest.mark.parametrize(("dataset", "want"), [("lasot", 0.25), ("cognitivebench", 0.25), ("default", 1.0)])
def test_dataset_branch(table, dataset, want):
    df = table(row(dataset=dataset), *[row(frame=i, gt=None, gp="absent", dataset=dataset) for i in (1, 2, 3)])
    assert scores(df)["dense_zero"].pn20 == want


def test_curve_is_the_share_above_each_threshold(table):
    df = table(*[row(frame=i, pred=(float(i), 0.0, 10.0, 10.0)) for i in range(11)])
    values = ev.benchmark_frames(df)
    rows = values.collect()
    for r in ev.curve(values, ev.KEY, "iou", ev.SUCCESS, True).collect():
        assert r.share == pytest.approx(sum(v.iou > r.threshold for v in rows) / len(rows))
    for r in ev.curve(values, ev.KEY, "ec", ev.PRECISION, False).collect():
        assert r.share == pytest.approx(sum(v.ec <= r.threshold for v in rows) / len(rows))


def test_recovery(table):
    gone = {"gt": None, "pred": None, "gp": "absent", "pp": "absent"}
    df = table(row(), row(frame=1, **gone), row(frame=2, pi="different"), row(frame=3, pi="same"), row(frame=4, **gone), row(frame=5, pred=FAR), row(frame=6, **gone), row(frame=7))
    assert sorted((r.start_frame, r.delay) for r in ev.reappearances(df).collect()) == [(2, 1), (5, None), (7, 0)]
    got = ev.recovery(ev.reappearances(df)).first()
    assert (got.events, got.recovered, got.median_delay, got.max_delay) == (3, 2, 0.5, 1)
