"""Which observations enter a tracker's memory, and what the memory holds at each frame.

A candidate is judged after all before it: streaks, pending texts and the time since the
last update feed back, so that a sequence is a fold. Its state is a few numbers, one
pending text and a bank of bounded capacity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import DataFrame

from reelmill.functions.boxes import iou_of
from reelmill.functions.text import NO_CHANGE, NO_CHANGE_ZH
from reelmill.operators.evaluation import KEY
from reelmill.operators.fold import folded

#: Events at which a text counts at once, and the source that never is a candidate.
DISAPPEARANCE, REAPPEARANCE = "disappearance", "reappearance"
FIRST_TRUTH = "initial_ground_truth"
_SAYS_NOTHING = re.compile(f"(?i:{NO_CHANGE.removeprefix('(?i)')})|{NO_CHANGE_ZH}")


@dataclass(frozen=True)
class Gates:
    """Defaults of the gates, in frames but for the counts and shares.

    confirmations in a row, each within gap of the one before and alike to iou, make a
    positive record, positive_cooldown after the last one; texts have their own count,
    gap, similarity and cooldown.
    """

    confirmations: int = 2
    gap: int = 30
    iou: float = 0.0
    positive_cooldown: int = 5
    text_confirmations: int = 1
    text_gap: int = 300
    text_similarity: float = 0.35
    text_cooldown: int = 30
    positive_room: int = 8
    negative_room: int = 8
    semantic_room: int = 4
    #: Records of each frame's selection: the latest positive ones.
    recent: int = 4

    def room(self, kind: str) -> int:
        return {"positive": self.positive_room, "negative": self.negative_room, "semantic": self.semantic_room}.get(kind, 0)


@dataclass
class Bank:
    """Records (frame, id, text) of each kind, as many as there is room for: a new one drives the earliest out."""

    gates: Gates
    held: dict[str, list[tuple[int, str, str]]] = field(default_factory=lambda: {"positive": [], "negative": [], "semantic": []})

    def add(self, kind: str, record: tuple[int, str, str]) -> str | None:
        """The id of what had to go, the new record's own if its kind has no room; an id that is held is an error."""
        if any(record[1] == r[1] for own in self.held.values() for r in own):
            raise ValueError(f"record {record[1]} is held already")
        room, own = self.gates.room(kind), self.held[kind]
        if not room:
            return record[1]
        own.append(record)
        if len(own) <= room:
            return None
        return own.pop(min(range(len(own)), key=lambda i: own[i][0]))[1]

    def recent(self, n: int) -> list[int]:
        """The frames of the n latest positive records, in time order."""
        return sorted(sorted((r[0] for r in self.held["positive"]), reverse=True)[:n])


def flat(text: str | None) -> str:
    return " ".join((text or "").split())


def alike(a: str, b: str) -> float:
    """The matching ratio of two texts by longest common blocks, case and blanks aside; 0 if either is empty."""
    x, y = flat(a.casefold()), flat(b.casefold())
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


@dataclass
class Memory:
    """The state of a sequence: what the gates wait for, when they last opened, and the bank."""

    gates: Gates
    bank: Bank
    streak: int = 0
    last_frame: int | None = None
    last_box: tuple | None = None
    positive_at: int | None = None
    text_at: int | None = None
    pending: str = ""
    pending_at: int | None = None
    text_streak: int = 0
    n_records: int = 0

    @classmethod
    def new(cls, gates: Gates) -> Memory:
        return cls(gates, Bank(gates))

    def forget_text(self) -> None:
        self.pending, self.pending_at, self.text_streak = "", None, 0

    def forget(self) -> None:
        self.streak, self.last_frame, self.last_box = 0, None, None
        self.forget_text()

    def take(self, c: dict) -> dict:
        """c (frame_id, kind, source, status, presence, identity, box, text, event) judged and, if taken, put into the bank."""
        reason, count = self._before_text(c) if c["kind"] == "semantic" else (None, None)
        if not reason:
            reason, count = self._judged(c)
        record_id = evicted = None
        if reason == "accepted":
            self.n_records += 1
            record_id = f"{c['kind']}-{c['frame_id']:08d}-{self.n_records:06d}"
            evicted = self.bank.add(c["kind"], (c["frame_id"], record_id, (c["text"] or "").strip()))
            if c["kind"] == "semantic":
                self.text_at = c["frame_id"]
        return {
            "accepted": reason == "accepted", "reason": reason, "confirmations": self.streak if count is None else count,
            "record_id": record_id, "evicted": evicted, "recent": self.bank.recent(self.gates.recent),
            **{f"n_{kind}": len(own) for kind, own in self.bank.held.items()}, "texts": [r[2] for r in self.bank.held["semantic"]],
        }

    def _before_text(self, c: dict) -> tuple[str | None, int | None]:
        """Why a text isn't even judged: it says what the bank holds, or comes too soon after the last one."""
        event = c["event"] or ""
        if c["presence"] == "absent" and event != DISAPPEARANCE:
            self.forget_text()
            return "absent_without_disappearance", None
        own = flat((c["text"] or "").casefold())
        if any(flat(r[2].casefold()) == own for r in self.bank.held["semantic"]):
            return "text_held_already", None
        soon = self.text_at is not None and c["frame_id"] - self.text_at < self.gates.text_cooldown
        return ("text_too_soon", None) if soon and event not in (DISAPPEARANCE, REAPPEARANCE) else (None, None)

    def _judged(self, c: dict) -> tuple[str, int | None]:
        if c["source"] == FIRST_TRUTH:
            return "first_truth_is_the_anchor", None
        if c["status"] != "ok":
            self.forget()
            return "execution_not_ok", None
        if c["kind"] == "negative":
            return ("accepted", 1) if c["identity"] == "different" else ("negative_not_different", None)
        return self._text(c) if c["kind"] == "semantic" else self._positive(c)

    def _text(self, c: dict) -> tuple[str, int | None]:
        event, text, g = c["event"] or "", flat(c["text"]), self.gates
        reason = (
            "present_not_same" if c["presence"] == "present" and c["identity"] != "same"
            else "presence_unknown" if c["presence"] not in ("present", "absent")
            else "empty_text" if not text
            else "says_no_change" if _SAYS_NOTHING.search(text)
            else None
        )
        if reason:
            self.forget_text()
            return reason, None
        close = self.pending_at is not None and 0 < c["frame_id"] - self.pending_at <= g.text_gap
        self.text_streak = self.text_streak + 1 if close and alike(self.pending, text) >= g.text_similarity else 1
        self.pending, self.pending_at = text, c["frame_id"]
        count = self.text_streak
        if count < (1 if event in (DISAPPEARANCE, REAPPEARANCE) else g.text_confirmations):
            return "text_unconfirmed", count
        self.forget_text()
        return "accepted", count

    def _positive(self, c: dict) -> tuple[str, int | None]:
        g, frame, box = self.gates, c["frame_id"], c["box"] and tuple(c["box"][k] for k in "xywh")
        reason = "not_present" if c["presence"] != "present" else "not_same" if c["identity"] != "same" else None if box else "no_box"
        if reason:
            self.forget()
            return reason, None
        follows = self.last_frame is not None and 0 < frame - self.last_frame <= g.gap
        strays = follows and g.iou > 0 and self.last_box is not None and iou_of(box, self.last_box) < g.iou
        self.streak = self.streak + 1 if follows and not strays else 1
        self.last_frame, self.last_box = frame, box
        if self.streak < g.confirmations:
            return "unconfirmed", None
        if self.positive_at is not None and frame - self.positive_at < g.positive_cooldown:
            return "too_soon", None
        self.positive_at = frame
        return "accepted", None


SCHEMA = "accepted boolean, reason string, confirmations int, record_id string, evicted string, recent array<int>, n_positive int, n_negative int, n_semantic int, texts array<string>"
CANDIDATE = ("kind", "source", "status", "presence", "identity", "box", "text", "event")


def replayed(candidates: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """candidates (dataset, sequence, frame_id, kind, source, status, presence, identity, box, text, event) in order: what became of each, and the bank after it.

    kind orders the candidates of a frame. Rows come back once each: accepted, reason
    (accepted, or why not), confirmations so far, record_id, evicted, the frames of the
    recent positive records, how many records of each kind are held, and the texts held.
    Nulls count as unknown: no status, presence or identity ever opens a gate.
    """
    rows = candidates.select(*KEY, "frame_id", *CANDIDATE)
    return folded(rows, KEY, ("frame_id", "kind"), lambda: Memory.new(gates), Memory.take, SCHEMA)
