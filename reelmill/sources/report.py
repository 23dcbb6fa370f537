"""The report of an evaluation as Markdown: headline figures, conventions and diagnostics.

Every figure is an aggregate that Spark makes; what comes to the driver is a row a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.operators import evaluation as ev
from reelmill.operators.evaluation import KEY


def number(x, digits: int = 4) -> str:
    return "N/A" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def percent(x) -> str:
    return "N/A" if x is None else f"{100 * x:.2f}%"


def _table(head: tuple[str, ...], rows: list[tuple]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "| " + " | ".join(["---"] + ["---:"] * (len(head) - 1)) + " |", *["| " + " | ".join(r) + " |" for r in rows], ""]


def evaluation_report(frames: DataFrame, least_iou: float = 0.5) -> str:
    """The report of canonical frames. Sections without a ground truth say so instead of showing zeros.

    Where less than all frames were observed, the dense convention is named as the one
    that is kept for comparison only.
    """
    first = lambda df: df.first().asDict()
    scope = first(frames.agg(F.count_distinct(*KEY).alias("sequences"), F.count(F.lit(1)).alias("frames")))
    rates = first(ev.execution_rates(frames))
    conventions = {r.convention: r.asDict() for r in ev.main_scores(frames).collect()}
    benchmark = ev.headline(ev.benchmark_frames(frames), KEY)
    macro = first(benchmark.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n_frames").alias("frames"), *[F.avg(c).alias(c) for c in ("auc", "op50", "op75", "p20", "pn20")]))
    visible = (ev.headline(ev.visible_frames(frames), ()).collect() or [None])[0]
    presence, identity = first(ev.presence_confusion(frames)), first(ev.identity_confusion(frames))
    recovery = first(ev.recovery(ev.reappearances(frames, least_iou)))
    statuses = ev.execution_counts(frames).orderBy("execution_status").collect()
    sparse = rates["observation_rate"] is not None and rates["observation_rate"] < 1.0
    main = conventions.get("dense_zero") or next(iter(conventions.values()), {})
    figures = (("Success AUC", "auc"), ("Success OP50", "op50"), ("Success OP75", "op75"), ("Precision @ 20 px", "p20"), ("Normalized Precision @ 0.2", "pn20"))
    lines = ["# Evaluation report", "", "## Scope", "", f"- Sequences: {scope['sequences']}", f"- Frames: {scope['frames']}", f"- IoU from which a target is recovered: {least_iou}", ""]
    lines += ["## For comparison only: dense convention" if sparse else "## Main figures: dense convention", ""]
    lines += _table(("Figure", "Value"), [("Valid sequences", number(main.get("n_sequences", 0))), *[(name, number(main.get(c))) for name, c in figures]])
    lines += ["## Conventions", ""]
    lines += _table(("Convention", "AUC", "OP50", "OP75", "P@20", "Pnorm@0.2"), [(f"`{name}`", *[number(r.get(c)) for _, c in figures]) for name, r in sorted(conventions.items())])
    lines += ["# Diagnostics", "", "These follow rules of their own and can't be compared with published figures.", "", "## Localisation", ""]
    lines += _table(("Figure", "Value"), [
        ("Sequences", number(macro["sequences"])), ("Frames with a truth", number(macro["frames"] or 0)), *[(name, number(macro[c])) for name, c in figures],
    ])
    lines += ["## Localisation of visible targets", ""]
    shown = visible.asDict() if visible else {}
    lines += _table(("Figure", "Value"), [("Visible frames", number(shown.get("n_frames", 0))), ("Mean IoU", number(shown.get("mean_iou"))), *[(name, number(shown.get(c))) for name, c in figures if c in ("auc", "p20", "pn20")]])
    lines += ["## Presence", ""]
    lines += _table(("Figure", "Value"), [("TP / FP / TN / FN", " / ".join(str(presence[c]) for c in ("tp", "fp", "tn", "fn"))), *_decisions(presence)])
    lines += ["## Identity", ""]
    lines += _table(("Figure", "Value"), [("Frames with an identity", number(identity["evaluated"])), *_decisions(identity)]) if identity["evaluated"] else ["No frame says whose the target is, so nothing is reported.", ""]
    lines += ["## Recovery", ""]
    lines += _table(("Figure", "Value"), [
        ("Reappearances", number(recovery["events"])), ("Recovered / not", f"{recovery['recovered']} / {recovery['events'] - recovery['recovered']}"), ("Recovery rate", percent(recovery["recovery_rate"])),
        ("Mean delay (frames)", number(recovery["mean_delay"], 2)), ("Median delay (frames)", number(recovery["median_delay"], 2)),
    ])
    lines += ["## Execution", "", f"- Failed frames: {rates['errors']} ({percent(rates['error_rate'])})", f"- Frames that say if they were observed: {rates['labelled']}", f"- Observation rate: {percent(rates['observation_rate'])}"]
    lines += [f"- `{r.execution_status}`: {r.n}" for r in statuses]
    return "\n".join([*lines, ""])


def _decisions(c: dict) -> list[tuple[str, str]]:
    """The rates of a decision between two values, as ev.confusion() names them."""
    shares = (("False-positive rate", "false_positive_rate"), ("Miss rate", "miss_rate"), ("Uncertain", "uncertain_coverage"), ("Decided", "decision_coverage"), ("Accuracy of decisions", "selective_accuracy"), ("Unavailable", "unavailable_rate"))
    return [("Precision", number(c["precision"])), ("Recall", number(c["recall"])), ("F1", number(c["f1"])), *[(name, percent(c[k])) for name, k in shares]]
