"""The state machine, the memory and windowed rates over streams of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelmill.operators.evaluation import KEY
from reelmill.operators.memory import CANDIDATE, Gates, Memory
from reelmill.operators.memory import SCHEMA as MEMORY_COLUMNS


class PhaseProcessor(StatefulProcessor):
    """One sequence's phase and counters. A batch's frames are taken in order; a frame not after the last one is dropped."""

    def __init__(self, search_after: int = 3) -> None:
        self.search_after = search_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("phase", "frame int, phase string, absent int, unsure int, errors int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, phase, absent, unsure, errors = self.state.get() if self.state.exists() else (-1, None, 0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_id").itertuples():
            if r.frame_id <= last:
                continue
            if phase is None or (r.execution_status == "ok" and r.trusted):
                phase, absent, unsure, errors = "confirmed", 0, 0, 0
            elif r.execution_status == "ok" and r.pred_presence == "absent":
                phase, absent, unsure, errors = "searching", absent + 1, 0, 0
            elif r.execution_status == "ok":
                unsure, errors = unsure + 1, 0
                phase = "searching" if unsure >= self.search_after else "uncertain"
            elif r.execution_status != "skipped":
                phase, unsure, errors = "uncertain", unsure + 1, errors + 1
            last = r.frame_id
            out.append((key[0], key[1], int(last), phase, absent, unsure, errors))
        if out:
            self.state.update((int(last), phase, absent, unsure, errors))
        yield pd.DataFrame(out, columns=["dataset", "sequence", "frame_id", "phase", "absent_duration", "uncertain_duration", "error_duration"])

    def close(self) -> None:
        pass


SCHEMA = "dataset string, sequence string, frame_id int, phase string, absent_duration int, uncertain_duration int, error_duration int"


def phases(frames: DataFrame, search_after: int = 3) -> DataFrame:
    """A stream of frames to a stream of phases; needs the RocksDB state store, as transformWithState does."""
    trusted = F.coalesce((F.col("pred_presence") == "present") & (F.col("pred_identity") == "same") & F.col("pred").isNotNull(), F.lit(False))
    rows = frames.select("dataset", "sequence", "frame_id", "execution_status", "pred_presence", trusted.alias("trusted"))
    return rows.groupBy("dataset", "sequence").transformWithStateInPandas(PhaseProcessor(search_after), SCHEMA, "append", "None")


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of a stream of events by time window; later rows than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = timed.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


class MemoryProcessor(StatefulProcessor):
    """One sequence's gates and bank over a stream of candidates: operators.memory's fold, its state between batches.

    What the gates wait for is a value, the bank's records are a list: both are bounded,
    however long the stream. A batch's candidates are taken in order of frame and kind; one not after the last is dropped.
    """

    def __init__(self, gates: Gates) -> None:
        self.gates = gates

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waits = handle.getValueState("waits", "frame int, kind string, streak int, last_frame int, box array<double>, positive_at int, text_at int, pending string, pending_at int, text_streak int, n_records int")
        self.records = handle.getListState("records", "kind string, frame int, id string, text string")

    def _restored(self) -> tuple[Memory, tuple[int, str]]:
        m = Memory.new(self.gates)
        for kind, frame, record_id, text in self.records.get() if self.records.exists() else ():
            m.bank.held[kind].append((frame, record_id, text))
        if not self.waits.exists():
            return m, (-1, "")
        frame, kind, m.streak, m.last_frame, box, m.positive_at, m.text_at, m.pending, m.pending_at, m.text_streak, m.n_records = self.waits.get()
        m.last_box = tuple(box) if box is not None else None
        return m, (frame, kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m, last = self._restored()
        out = []
        for r in pd.concat(list(rows)).sort_values(["frame_id", "kind"]).to_dict("records"):
            now = (int(r["frame_id"]), r["kind"])
            if now <= last:
                continue
            last = now
            c = {k: None if v is pd.NA or (isinstance(v, float) and v != v) else v for k, v in r.items()} | {"frame_id": now[0]}
            c["box"] = _plain_box(c["box"])
            out.append({"dataset": key[0], "sequence": key[1], "frame_id": now[0], "kind": now[1]} | m.take(c))
        if out:
            box = list(map(float, m.last_box)) if m.last_box is not None else None
            self.waits.update((*last, m.streak, m.last_frame, box, m.positive_at, m.text_at, m.pending, m.pending_at, m.text_streak, m.n_records))
            held = [(kind, *record) for kind, own in m.bank.held.items() for record in own]
            if held:
                self.records.put(held)
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _plain_box(b):
    """A box as pandas holds it, a row or a mapping, as a mapping."""
    return b if b is None or isinstance(b, dict) else b.asDict() if hasattr(b, "asDict") else dict(zip("xywh", b, strict=True))


MEMORY_SCHEMA = f"dataset string, sequence string, frame_id int, kind string, {MEMORY_COLUMNS}"


def memories(candidates: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """A stream of candidates (operators.memory) to what became of each, and the bank after it; needs the RocksDB state store."""
    rows = candidates.select(*KEY, "frame_id", *CANDIDATE)
    return rows.groupBy(*KEY).transformWithStateInPandas(MemoryProcessor(gates), MEMORY_SCHEMA, "append", "None")
