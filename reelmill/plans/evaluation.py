"""Queries over frames: metrics, confusions, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelmill.operators import evaluation as ev
from reelmill.plans.registry import query, rounded
from reelmill.sources.fixtures import FRAMES_SQL, frames

#: IoU, centre error and normalised centre error of frames with flat boxes.
MEASURE = """
greatest(0, least(gx + gw, {p}x + {p}w) - greatest(gx, {p}x)) * greatest(0, least(gy + gh, {p}y + {p}h) - greatest(gy, {p}y)) as inter"""
BENCH = f"""with {FRAMES_SQL},
i as (select *, gx is not null and px is not null as ok, {MEASURE.format(p="p")},
  (gx + (gw - 1) / 2) - (px + (pw - 1) / 2) as dx, (gy + (gh - 1) / 2) - (py + (ph - 1) / 2) as dy from frames),
b as (select *, case when ok then inter / (gw * gh + pw * ph - inter) end as iou, case when ok then sqrt(dx * dx + dy * dy) end as ec,
  case when ok then sqrt(dx / gw * dx / gw + dy / gh * dy / gh) end as en from i)"""
T20, T50 = "(select unnest([x / 20.0::double for x in range(21)]) as threshold)", "(select unnest([x::double for x in range(51)]) as threshold)"
HEAD = """count(*) as n_frames, round(avg(len(list_filter([x / 20.0::double for x in range(21)], lambda t: coalesce(iou > t, false))) / 21.0::double), 9) as auc,
  round(avg(coalesce(iou > 0.5::double, false)::int::double), 9) as op50, round(avg(coalesce(iou > 0.75::double, false)::int::double), 9) as op75,
  round(avg(coalesce(ec <= 20, false)::int::double), 9) as p20, round(avg(coalesce(en <= 0.2::double, false)::int::double), 9) as pn20"""


def _curve(thresholds: str, hit: str) -> str:
    return f"""{BENCH}, c as (select dataset, sequence, threshold, avg(coalesce({hit}, false)::int::double) as share from b, {thresholds} t group by all)
select threshold, count(*) as n_sequences, round(avg(share), 9) as share from c group by threshold"""


@query(_curve(T20, "iou > threshold"))
def success_curve_macro(spark, sf_dir):
    values = ev.benchmark_frames(frames(spark, sf_dir))
    return rounded(ev.macro(ev.curve(values, ev.KEY, "iou", ev.SUCCESS, True)), "share")


@query(_curve(T50, "ec <= threshold"))
def precision_curve_macro(spark, sf_dir):
    values = ev.benchmark_frames(frames(spark, sf_dir))
    return rounded(ev.macro(ev.curve(values, ev.KEY, "ec", ev.PRECISION, False)), "share")


@query(f"{BENCH} select dataset, sequence, {HEAD} from b group by dataset, sequence")
def benchmark_sequence(spark, sf_dir):
    made = ev.headline(ev.benchmark_frames(frames(spark, sf_dir)), ev.KEY).drop("mean_iou")
    return rounded(made, "auc", "op50", "op75", "p20", "pn20")


VISIBLE = BENCH.replace("b as (select *, case when ok", "b as (select *, case when ok and pred_presence = 'present' and execution_status = 'ok'").replace(
    "gx is not null and px is not null as ok", "gx is not null and px is not null and pred_presence = 'present' and execution_status = 'ok' as ok"
)


@query(f"{VISIBLE}, v as (select * replace (coalesce(iou, 0) as iou) from b where gt_presence = 'present') select {HEAD}, round(avg(iou), 9) as mean_iou from v")
def visible_only_micro(spark, sf_dir):
    made = ev.headline(ev.visible_frames(frames(spark, sf_dir)), ())
    return rounded(made, "auc", "op50", "op75", "p20", "pn20", "mean_iou")


MAIN = f"""with {FRAMES_SQL},
w as (select *, px is null as missing, max((is_observation_frame is not null)::int) over (partition by dataset, sequence) as flagged,
  last_value(case when px is not null then {{'x': px, 'y': py, 'w': pw, 'h': ph}} end ignore nulls) over (partition by dataset, sequence order by frame_id rows between unbounded preceding and 1 preceding) as carry from frames),
n as (select *, case when flagged = 1 then not is_observation_frame else missing end as non_obs from w),
k as (select n.*, c.convention, c.convention = 'hold_last' and non_obs and missing as fill from n, (select unnest(['dense_zero', 'hold_last', 'observation_only']) as convention) c),
u as (select *, case when fill then carry.x else px end as hx, case when fill then carry.y else py end as hy, case when fill then carry.w else pw end as hw, case when fill then carry.h else ph end as hh,
  gt_presence <> 'absent' as visible from k),
q as (select *, hx is null as sparse, case when frame_id = 0 then gx else hx end as ux, case when frame_id = 0 then gy else hy end as uy,
  case when frame_id = 0 then gw else hw end as uw, case when frame_id = 0 then gh else hh end as uh from u),
i as (select *, coalesce(gw > 0 and gh > 0 and visible and not sparse, false) as ok, {MEASURE.format(p="u")},
  (gx + (gw - 1) / 2) - (ux + (uw - 1) / 2) as dx, (gy + (gh - 1) / 2) - (uy + (uh - 1) / 2) as dy from q),
b as (select *, case when ok then inter / (gw * gh + uw * uh - inter) end as iou, case when ok then sqrt(dx * dx + dy * dy) end as ec,
  case when ok then sqrt(dx / gw * dx / gw + dy / gh * dy / gh) end as en from i where convention <> 'observation_only' or not non_obs),
seq as (select convention, dataset, sequence, avg(len(list_filter([x / 20.0::double for x in range(21)], lambda t: coalesce(iou > t, false))) / 21.0::double) as auc,
  avg(coalesce(iou > 0.5::double, false)::int::double) as op50, avg(coalesce(iou > 0.75::double, false)::int::double) as op75, avg(coalesce(ec <= 20, false)::int::double) as p20,
  avg((coalesce(en <= 0.2::double, false) or (not ok and not sparse and not (dataset in ('lasot', 'cognitivebench') and not visible)))::int::double) as pn20
  from b group by convention, dataset, sequence)
select convention, count(*) as n_sequences, round(avg(auc), 9) as auc, round(avg(op50), 9) as op50, round(avg(op75), 9) as op75, round(avg(p20), 9) as p20, round(avg(pn20), 9) as pn20 from seq"""


@query(f"{MAIN} group by convention")
def eval_main(spark, sf_dir):
    """The three conventions in one pass."""
    return rounded(ev.main_scores(frames(spark, sf_dir)), "auc", "op50", "op75", "p20", "pn20")


def _one(convention: str):
    def run(spark, sf_dir):
        made = ev.main_sequences(frames(spark, sf_dir)).where(F.col("convention") == convention)
        made = made.groupBy("convention").agg(F.count(F.lit(1)).alias("n_sequences"), *[F.avg(c).alias(c) for c in ("auc", "op50", "op75", "p20", "pn20")])
        return rounded(made, "auc", "op50", "op75", "p20", "pn20")

    run.__name__ = f"eval_main_{convention}"
    return query(f"{MAIN} where convention = '{convention}' group by convention")(run)


eval_main_dense_zero, eval_main_hold_last, eval_main_observation_only = map(_one, ev.CONVENTIONS)


def _confusion(gt: str, pred: str, yes: str, no: str) -> str:
    c = lambda g, p: f"count(*) filter (use and {gt} = '{g}' and {pred} = '{p}')"
    return f"""with {FRAMES_SQL}, k as (select *, coalesce({pred} = 'uncertain', false) as refused, coalesce({pred} in ('{yes}', '{no}'), false) and execution_status not like '%\\_error' escape '\\' as fine from frames where {gt} in ('{yes}', '{no}')),
t as (select dataset, count(*) as evaluated, {c(yes, yes)} as tp, {c(no, yes)} as fp, {c(no, no)} as tn, {c(yes, no)} as fn, count(*) filter (refused) as uncertain, count(*) filter (not refused and not fine) as unavailable
  from (select *, not refused and fine as use from k) group by dataset),
r as (select *, tp / nullif(tp + fp, 0)::double as precision, tp / nullif(tp + fn, 0)::double as recall from t)
select dataset, evaluated, tp, fp, tn, fn, uncertain, unavailable, round(precision, 9) as precision, round(recall, 9) as recall, round(2 * precision * recall / nullif(precision + recall, 0), 9) as f1,
  round(fp / nullif(fp + tn, 0)::double, 9) as false_positive_rate, round(fn / nullif(tp + fn, 0)::double, 9) as miss_rate, round(uncertain / evaluated::double, 9) as uncertain_coverage,
  round((tp + fp + tn + fn) / evaluated::double, 9) as decision_coverage, round(unavailable / evaluated::double, 9) as unavailable_rate,
  round((tp + tn) / nullif(tp + fp + tn + fn, 0)::double, 9) as selective_accuracy from r"""


RATES = ("precision", "recall", "f1", "false_positive_rate", "miss_rate", "uncertain_coverage", "decision_coverage", "unavailable_rate", "selective_accuracy")


@query(_confusion("gt_presence", "pred_presence", "present", "absent"))
def presence_confusion(spark, sf_dir):
    return rounded(ev.presence_confusion(frames(spark, sf_dir), ("dataset",)), *RATES)


@query(_confusion("gt_identity", "pred_identity", "same", "different"))
def identity_confusion(spark, sf_dir):
    return rounded(ev.identity_confusion(frames(spark, sf_dir), ("dataset",)), *RATES)


@query(f"with {FRAMES_SQL} select execution_status, count(*) as n, execution_status like '%error' as is_error from frames group by all")
def execution_status(spark, sf_dir):
    return ev.execution_counts(frames(spark, sf_dir))


@query(f"""with {FRAMES_SQL} select dataset, count(*) as total, count(*) filter (execution_status like '%error') as errors, count(is_observation_frame) as labelled,
  count(*) filter (is_observation_frame) as observed, round(count(*) filter (execution_status like '%error') / count(*)::double, 9) as error_rate,
  round(count(*) filter (is_observation_frame) / count(is_observation_frame)::double, 9) as observation_rate from frames group by dataset""")  # fmt: skip
def execution_rates(spark, sf_dir):
    return rounded(ev.execution_rates(frames(spark, sf_dir), ("dataset",)), "error_rate", "observation_rate")


REAPPEAR = f"""{BENCH.replace("b as (", "b0 as (")}, b as (select *, row_number() over (partition by dataset, sequence order by frame_id) as rn, lag(gt_presence) over (partition by dataset, sequence order by frame_id) as before from b0),
starts as (select dataset, sequence, frame_id as start_frame, lead(frame_id, 1, 1000000) over (partition by dataset, sequence order by frame_id) as next_start from b where before = 'absent' and gt_presence = 'present'),
ends as (select s.dataset, s.sequence, s.start_frame, coalesce(min(x.frame_id), 1000000) as stop from starts s left join b x on x.dataset = s.dataset and x.sequence = s.sequence and x.frame_id > s.start_frame and x.gt_presence <> 'present' group by s.dataset, s.sequence, s.start_frame),
ev as (select e.dataset, e.sequence, e.start_frame, min(f.frame_id) - e.start_frame as delay from ends e left join b f on f.dataset = e.dataset and f.sequence = e.sequence and f.frame_id >= e.start_frame and f.frame_id < e.stop
  and f.execution_status not like '%error' and f.pred_presence = 'present' and coalesce(f.pred_identity <> 'different', true) and f.iou >= 0.5 group by e.dataset, e.sequence, e.start_frame)"""


@query(f"""{REAPPEAR} select dataset, count(*) as events, count(delay) as recovered, round(avg(delay), 9) as mean_delay, median(delay)::double as median_delay, max(delay) as max_delay,
  round(count(delay) / count(*)::double, 9) as recovery_rate from ev group by dataset""")  # fmt: skip
def reappearance_recovery(spark, sf_dir):
    return rounded(ev.recovery(ev.reappearances(frames(spark, sf_dir)), ("dataset",)), "mean_delay", "recovery_rate")


@query(f"{REAPPEAR} select dataset, sequence, start_frame, delay from ev")
def reappearance_events(spark, sf_dir):
    return ev.reappearances(frames(spark, sf_dir))


@query(f"""with {FRAMES_SQL} select dataset, sequence, count(*) as n_frames, count(*) filter (execution_status like '%error') as errors, round(sum((frame_id % 7 + 1) / 16.0::double), 9) as seconds,
  round(count(*) / sum((frame_id % 7 + 1) / 16.0::double), 9) as fps from frames group by dataset, sequence""")  # fmt: skip
def run_times(spark, sf_dir):
    timed = frames(spark, sf_dir).withColumn("time", (F.col("frame_id") % 7 + 1) / F.lit(16.0))
    return rounded(ev.run_times(timed), "seconds", "fps")
