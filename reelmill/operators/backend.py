"""The boundary to models: backends by name, loaded once a worker, asked in batches, with failures kept to their rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from reelmill.operators.evaluation import KEY
from reelmill.operators.fold import folded


class Backend(Protocol):
    """What a model must do; generate gives an answer for each request, in their order."""

    def generate(self, requests: list[dict]) -> list[str | None]: ...


Factory = Callable[[dict], Backend]
_FACTORIES: dict[str, Factory] = {}
#: The backends that this worker has loaded, by name and settings.
_LOADED: dict[tuple, Backend] = {}


def register_backend(name: str, factory: Factory) -> None:
    """Makes factory(settings) the backend of that name; a name stands for one factory."""
    if not name or name in _FACTORIES:
        raise ValueError(f"a backend needs a name of its own, not {name!r}")
    _FACTORIES[name] = factory


def available_backends() -> tuple[str, ...]:
    return tuple(sorted(_FACTORIES))


def _factory(name: str) -> Factory:
    if name not in _FACTORIES:
        raise ValueError(f"unknown backend {name!r}; there are {list(available_backends())}")
    return _FACTORIES[name]


def loaded(name: str, factory: Factory, settings: dict) -> Backend:
    """The backend of these settings, made at its first use in this process."""
    key = (name, repr(sorted(settings.items())))
    if key not in _LOADED:
        _LOADED[key] = factory(dict(settings))
    return _LOADED[key]


#: What each row gets beside its own columns.
ANSWER = "answer string, status string, error_type string, error_message string, seconds double"
MESSAGE = 500


def answered(rows: DataFrame, name: str, settings: dict | None = None, batch: int = 16, requests: tuple[str, ...] | None = None) -> DataFrame:
    """rows with answer, status (ok or model_error), error_type, error_message and seconds.

    requests names the columns that the backend sees, all by default. A batch that fails,
    or comes back in another length, is asked again row by row, so that only the rows that
    fail by themselves are errors. A backend that can't be loaded fails the job. Errors
    are rows, never absences; nothing is asked twice once it has an answer.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if batch < 1:
        raise ValueError("a batch has one row at least")
    if taken := {f.name for f in T._parse_datatype_string(ANSWER).fields} & set(rows.columns):
        raise ValueError(f"rows must not have the columns {sorted(taken)}")
    factory, own, seen = _factory(name), dict(settings or {}), list(requests or rows.columns)
    out = T.StructType([*rows.schema.fields, *T._parse_datatype_string(ANSWER).fields])
    arrow = to_arrow_schema(out)

    def ask(backend: Backend, some: list[dict]) -> list[dict]:
        began = time.monotonic()
        try:
            answers = list(backend.generate([{c: r[c] for c in seen} for r in some]))
            if len(answers) != len(some):
                raise RuntimeError(f"{len(answers)} answers to {len(some)} requests")
        except Exception as error:  # a model may raise anything
            if len(some) > 1:
                return [made for r in some for made in ask(backend, [r])]
            told = {"answer": None, "status": "model_error", "error_type": type(error).__name__, "error_message": str(error)[:MESSAGE]}
            return [told | {"seconds": time.monotonic() - began}]
        each = (time.monotonic() - began) / len(some)
        return [{"answer": a, "status": "ok", "error_type": None, "error_message": None, "seconds": each} for a in answers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                made = ask(loaded(name, factory, own), some.to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array([m[f.name] for m in made], f.type) for f in list(arrow)[part.num_columns :]]], schema=arrow)

    return rows.mapInArrow(run, out)


class Tracker(Protocol):
    """One sequence's tracker. initialize gets the first frame, track every other one in order; both may return None."""

    def initialize(self, info: dict) -> dict | None: ...

    def track(self, info: dict) -> dict | None: ...


_TRACKERS: dict[str, Callable[[dict], Tracker]] = {}
TRACKED = "box array<double>, status string, error_type string, error_message string, seconds double"


def register_tracker(name: str, factory: Callable[[dict], Tracker]) -> None:
    """Makes factory(settings) the tracker of that name, one for each sequence; a name stands for one factory."""
    if not name or name in _TRACKERS:
        raise ValueError(f"a tracker needs a name of its own, not {name!r}")
    _TRACKERS[name] = factory


def available_trackers() -> tuple[str, ...]:
    return tuple(sorted(_TRACKERS))


def tracked(frames: DataFrame, name: str, settings: dict | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, sequence, frame_id, box, status, error_type, error_message, seconds): every frame of every sequence run through a tracker in order.

    A frame is a mapping of frame_id, observed, columns, and previous, what the tracker
    returned last; the first one also has init_box. No other truth is ever shown. What is
    returned has box, four numbers, and may have status; without a box, an unobserved frame
    is skipped. initialize may return None, whose box is then init_box. A frame that fails
    is a row with internal_error, and the sequence goes on.
    """
    if name not in _TRACKERS:
        raise ValueError(f"unknown tracker {name!r}; there are {list(available_trackers())}")
    factory, own = _TRACKERS[name], dict(settings or {})

    def step(s: dict, row: dict) -> dict:
        info = {c: row[c] for c in ("frame_id", "observed", *columns)} | {"previous": s["previous"]}
        began = time.monotonic()
        try:
            if s["tracker"] is None:
                s["tracker"], first = factory(dict(own)), True
            else:
                first = False
            given = s["tracker"].initialize(info | {"init_box": row["init_box"]}) if first else s["tracker"].track(info)
            made = dict(given or {})
            box = made.setdefault("box", row["init_box"]) if first else made.get("box")
            box = None if box is None else [float(x) for x in box]
            s["previous"] = made
            status = made.get("status") or ("skipped" if box is None and not row["observed"] else "ok")
            return {"box": box, "status": status, "error_type": None, "error_message": None, "seconds": time.monotonic() - began}
        except Exception as error:  # a tracker may raise anything
            return {"box": None, "status": "internal_error", "error_type": type(error).__name__, "error_message": str(error)[:MESSAGE], "seconds": time.monotonic() - began}

    rows = frames.select(*KEY, "frame_id", "observed", "init_box", *columns)
    return folded(rows, KEY, ("frame_id",), lambda: {"tracker": None, "previous": {}}, step, TRACKED)


#: A reward turns a frame with the struct column that functions.protocol.with_rewards adds into a number.
_REWARDS: dict[str, Callable[[Column], Column]] = {name: lambda r, n=name: r[n] for name in ("format", "presence", "bbox", "consistency")}


def register_reward(name: str, reward: Callable[[Column], Column]) -> None:
    if not name or name in _REWARDS:
        raise ValueError(f"a reward needs a name of its own, not {name!r}")
    _REWARDS[name] = reward


def available_rewards() -> tuple[str, ...]:
    return tuple(sorted(_REWARDS))


def rewarded(rows: DataFrame, completion: Column, reference: Column, names: tuple[str, ...], weights: tuple[float, ...] | None = None) -> DataFrame:
    """rows with a column reward_<name> for each name and reward, their weighted sum (weights of 1 by default)."""
    from pyspark.sql import functions as F

    from reelmill.functions.protocol import with_rewards

    if unknown := set(names) - set(_REWARDS):
        raise ValueError(f"unknown rewards {sorted(unknown)}; there are {list(available_rewards())}")
    weights = weights or (1.0,) * len(names)
    if len(weights) != len(names):
        raise ValueError("each reward has one weight")
    made = with_rewards(rows, completion, reference, "__rewards")
    made = made.withColumns({f"reward_{n}": _REWARDS[n](F.col("__rewards")) for n in names})
    total = sum((F.col(f"reward_{n}") * F.lit(float(w)) for n, w in zip(names, weights, strict=True)), F.lit(0.0))
    return made.withColumn("reward", total).drop("__rewards")
