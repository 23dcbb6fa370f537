"""Secret scans: all rules in one pass of one deterministic automaton, and extents by automata too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelmill.llm.automaton import Automaton, compile_rules
from reelmill.llm.common import _arrow, map_batches, sliced, texts


@dataclass(frozen=True)
class Rule:
    """Leftmost, longest, non-overlapping matches of search; those of which what follows head is shorter than least are no secrets."""

    kind: str
    search: bytes
    least: int = 1
    #: What stands before the part of a match whose length counts; it never goes on into that part.
    head: bytes = b""
    #: What the automaton of all rules looks for: something that every secret of this kind holds. Counts of
    #: several rules multiply its states, and so only one rule should count far.
    scan: bytes = b""


#: The kinds in their order, the patterns and the least lengths.
_NAMES = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", _NAMES + rb"[A-Za-z0-9+/_.=-]+", 6, _NAMES, _NAMES + rb"[A-Za-z0-9+/_.=-]"),
    Rule("access", rb"AKIA[A-Z0-9]+", 20, scan=rb"AKIA[A-Z0-9]"),
    # a run of so many digits is what is left of all runs when shorter ones are dropped
    Rule("hex", rb"[0-9a-f]{24,}", 24, scan=rb"[0-9a-f]{24,}"),
    Rule("key_block", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", scan=rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("signed", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", scan=rb"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("url_login", rb"[a-z]+://[A-Za-z0-9_.-]+:[A-Za-z0-9!$%&*+._~-]{4,}@", scan=rb"://[A-Za-z0-9_.-]+:[A-Za-z0-9!$%&*+._~-]+@"),
)
BASE = ("assign", "access", "hex")
#: Text bytes that one automaton pass takes at most, unless one text alone is longer.
CHUNK = 8 << 20


@dataclass(frozen=True)
class Machines:
    """One automaton that scans for all rules, and for each rule those that find its matches' starts (backwards), ends and heads."""

    scan: Automaton
    starts: tuple[Automaton, ...]
    ends: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


@lru_cache(maxsize=4)
def machines(rules: tuple[Rule, ...]) -> Machines:
    made = Machines(
        compile_rules([r.scan for r in rules]),
        tuple(compile_rules([r.search], back=True) for r in rules),
        tuple(compile_rules([r.search], anchored=True) for r in rules),
        tuple(compile_rules([r.head], anchored=True) if r.head else None for r in rules),
    )
    if not all(a.separators[10] for a in (made.scan, *made.starts)):
        raise ValueError("a rule goes beyond the end of a line")
    return made


def spans_of(data: np.ndarray, begins: np.ndarray, starts: Automaton, ends: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the leftmost, longest, non-overlapping matches in texts that begin at begins in data, each with a line's end behind it.

    The automaton that reads backwards says where any match begins. All texts go on
    side by side from their next such place: a match ends where the other automaton says.
    """
    possible = len(data) - 1 - starts.hits(data[::-1])[0][::-1]
    bounds, made = np.append(begins, len(data)), []
    at = np.searchsorted(possible, begins)
    live = np.arange(len(begins))
    while True:
        inside = at < len(possible)
        inside[inside] = possible[at[inside]] < bounds[live[inside] + 1]
        live, at = live[inside], at[inside]
        if not len(live):
            break
        here = possible[at]
        until = ends.ends(data, here)
        made.append((here, until))
        at = np.searchsorted(possible, np.maximum(until, here + 1))
    none = np.zeros(0, np.int64)
    lo, hi = (np.concatenate([none, *(m[i] for m in made)]) for i in (0, 1))
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order]


def find_secrets(many: list[bytes], rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """(start, rule, end) in bytes, ordered, by the number of each text that holds a secret.

    One pass of the automaton of all rules says which texts may hold a secret of which
    rule; of those, the rule's own automata give the extents.
    """
    m = machines(rules)
    data, first = np.frombuffer(b"\n".join(many) + b"\n", np.uint8), np.cumsum([0, *(len(t) + 1 for t in many)])
    where, states = m.scan.hits(data)
    if not len(where):
        return {}
    text = np.searchsorted(first, where, "right") - 1
    found: dict[int, list] = {}
    flagged: dict[int, set[int]] = {}
    n_states = len(m.scan.moves) // 256
    for both in np.unique(text * n_states + states).tolist():
        for k in m.scan.rules_at[both % n_states]:
            flagged.setdefault(k, set()).add(both // n_states)
    for k, own in flagged.items():
        numbers = np.array(sorted(own))
        sizes = first[numbers + 1] - first[numbers]
        begins = np.append(0, np.cumsum(sizes)[:-1])
        part = np.concatenate([data[first[i] : first[i + 1]] for i in numbers.tolist()])
        lo, hi = spans_of(part, begins, m.starts[k], m.ends[k])
        counted = m.heads[k].ends(part, lo) if m.heads[k] else lo
        long = hi - counted >= rules[k].least
        lo, hi = lo[long], hi[long]
        at = np.searchsorted(begins, lo, "right") - 1
        for i, a, b in zip(numbers[at].tolist(), (lo - begins[at]).tolist(), (hi - begins[at]).tolist(), strict=True):
            found.setdefault(i, []).append((a, k, b))
    return {t: sorted(spans) for t, spans in found.items()}


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row of df, in code points with exclusive ends.

    spans go by start, then as the rules are listed; none gives an empty array. Null
    and empty texts have none; repeated rows come back as often as they are there,
    null ids stay null, and other columns of df play no part.
    """
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    arrow = _arrow(df.sparkSession, schema)

    def chunks(many: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        at = size = 0
        for i, t in enumerate(many):
            size += len(t)
            if size >= CHUNK:
                yield at, many[at : i + 1]
                at, size = i + 1, 0
        if at < len(many):
            yield at, many[at:]

    def run(batches):
        for batch in sliced(batches, most=CHUNK):
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            many = batch.column("text").cast(pa.binary()).to_pylist()
            for at, some in chunks(many):
                for i, found in find_secrets(some, rules).items():
                    points = np.cumsum((np.frombuffer(some[i], np.uint8) & 0xC0) != 0x80)
                    place = lambda b, p=points: int(p[b - 1]) if b else 0
                    spans[at + i] = [{"kind": rules[k].kind, "start": place(s), "end": place(e)} for s, k, e in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, arrow.field(1).type)], schema=arrow)

    return map_batches(texts(df, id_col, text_col), run, schema)
