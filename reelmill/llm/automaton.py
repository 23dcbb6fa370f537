"""Rules compiled into deterministic automata that read bytes in lanes.

Rule patterns (Python's bytes syntax without anchors, look-around, back-references
and lazy repeats) become one nondeterministic automaton; subset construction and
minimisation turn it into a transition array. Bytes are cut into lanes anywhere, which
go through the array side by side: a lane begins with a guess of its state, and one
whose guess was wrong is read again from the right state until both agree. The same
patterns, read backwards, say where matches begin.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np


class _Nfa:
    """Epsilon moves and byte moves between numbered states."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, items, at: int, flags: int, back: bool = False) -> int:
        """Appends the parsed items, last one first if back, after state at; returns the state at their end."""
        for op, arg in reversed(items) if back else items:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                to = self.state()
                self.moves[at].append((_bytes(op, arg, flags), to))
                at = to
            elif op is C.SUBPATTERN:
                _, on, off, inner = arg
                at = self.add(inner, at, (flags | on) & ~off, back)
            elif op is C.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    start = self.state()
                    self.free[at].append(start)
                    self.free[self.add(branch, start, flags, back)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, flags, back)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, flags, back)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(inner, at, flags, back)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules can't use {op}")
        return at


def _bytes(op, arg, flags: int) -> frozenset[int]:
    """The bytes that one parsed item takes; letters in either case under IGNORECASE."""
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    if op is C.IN:
        found, negate = set(), False
        for kind, x in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"rules can't use {kind} in a set")
    else:
        found, negate = {arg}, op is C.NOT_LITERAL
    if flags & re.IGNORECASE:
        found |= {x ^ 32 for x in found if 65 <= x & ~32 <= 90}
    return frozenset(range(256)) - found if negate else frozenset(found)


#: Bytes that are read at once, lanes of them at most, a lane's least length, and bytes before a lane that its guess reads.
SEGMENT, LANES, SHORTEST, BEFORE = 4 << 20, 4096, 64, 48
#: Bytes that matches are followed for side by side; longer ones go on by themselves.
TOGETHER = 2048


@dataclass(frozen=True)
class Automaton:
    """moves[state * 256 + byte] is the next state times 256; the start is 0, states from first_hit on accept rules, and dead (if any) is left no more."""

    moves: np.ndarray
    first_hit: int
    rules_at: dict[int, tuple[int, ...]]
    separators: np.ndarray
    dead: int = -1

    def path(self, data: np.ndarray, start: int = 0, guess: int | None = None) -> np.ndarray:
        """The state after each byte of data, which is read from start; lanes begin from guess, the start if there is none."""
        size = max(SHORTEST, -(-len(data) // LANES))
        lanes = -(-len(data) // size)
        if lanes <= 1:
            return self._lane(data, start)
        padded = np.zeros(lanes * size, np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(lanes, size).T)
        # what a lane's own state is, if the bytes before it say so
        state = np.full(lanes, 0 if guess is None else guess, np.int32)
        if guess is None:
            for step in range(max(0, size - BEFORE), size):
                state[1:] = self.moves[state[1:] + columns[step, :-1]]
        state[0] = start
        path, begun = np.empty((size, lanes), np.int32), state.copy()
        for step in range(size):
            state = self.moves[state + columns[step]]
            path[step] = state
        width = 1
        while True:
            wrong = np.flatnonzero(begun[1:] != path[-1, :-1]) + 1
            if not len(wrong):
                return path.T.reshape(-1)[: len(data)]
            # a match that goes on over many lanes stays in one state, as a rule: more and more lanes behind a wrong one try it
            tried, first = np.unique((wrong + np.arange(width)[:, None]).ravel(), return_index=True)
            at, state = tried[tried < lanes], np.tile(path[-1, wrong - 1], width)[first][tried < lanes]
            begun[at] = state
            width = min(2 * width, lanes)
            for step in range(size):
                state = self.moves[state + columns[step, at]]
                differs = state != path[step, at]
                if not differs.all():
                    at, state = at[differs], state[differs]
                    if not len(at):
                        break
                path[step, at] = state

    def _lane(self, data: np.ndarray, state: int) -> np.ndarray:
        moves, made = self.moves, np.empty(len(data), np.int32)
        for i, byte in enumerate(data.tolist()):
            made[i] = state = int(moves[state + byte])
        return made

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, states) after whose byte a rule has just matched, in order."""
        where, which, state = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for at in range(0, len(data), SEGMENT):
            path = self.path(data[at : at + SEGMENT], state)
            found = np.flatnonzero(path >= self.first_hit)
            where.append(found + at)
            which.append(path[found] // 256)
            state = int(path[-1])
        return np.concatenate(where), np.concatenate(which)

    def ends(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Behind the last byte of the longest match that begins at each start; the start itself if none does. For automata with a dead state."""
        ends, state, live, at = starts.copy(), np.zeros(len(starts), np.int32), np.arange(len(starts)), starts.copy()
        for _ in range(TOGETHER):
            inside = at < len(data)
            live, at, state = live[inside], at[inside], state[inside]
            if not len(live):
                return ends
            state = self.moves[state + data[at]]
            at = at + 1
            hit = state >= self.first_hit
            ends[live[hit]] = at[hit]
            on = state != self.dead
            live, at, state = live[on], at[on], state[on]
        for i, begin, s in zip(live.tolist(), at.tolist(), state.tolist(), strict=True):
            size = 1 << 16
            while s != self.dead and begin < len(data):
                path = self.path(data[begin : begin + size], s, guess=s)  # a long match loops in one state, as a rule
                hit = np.flatnonzero(path >= self.first_hit)
                if len(hit):
                    ends[i] = begin + int(hit[-1]) + 1
                s, begin, size = int(path[-1]), begin + len(path), min(size * 4, SEGMENT)
        return ends


def compile_rules(patterns: list[bytes], anchored: bool = False, back: bool = False) -> Automaton:
    """One minimal automaton that finds where any of the patterns has matched, wherever it began; only from its first byte on if anchored.

    With back, patterns are those of bytes in reverse order. A hit of an anchored
    automaton doesn't end it: it goes on to longer matches until it is dead.
    """
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for k, pattern in enumerate(patterns):
        parsed = _parser.parse(pattern)
        own = nfa.state()
        nfa.free[start].append(own)
        ends[nfa.add(list(parsed), own, parsed.state.flags, back)] = k

    def closed(states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    kinds: dict[tuple, list[int]] = {}
    sets = list({s for moves in nfa.moves for s, _ in moves})
    for byte in range(256):
        kinds.setdefault(tuple(byte in s for s in sets), []).append(byte)
    classes = list(kinds.values())
    root = closed([start])
    number, table, todo = {root: 0}, [], [root]
    for states in todo:
        row = []
        for members in classes:
            to = closed({t for s in states for b, t in nfa.moves[s] if members[0] in b} | (set() if anchored else {start}))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    accepts = [tuple(sorted({ends[s] for s in states if s in ends})) for states in todo]
    block = _minimal(table, accepts)
    # the start first, accepting states last
    names = sorted(set(block), key=lambda b: (b != block[0], bool(accepts[block.index(b)])))
    place = {b: i for i, b in enumerate(names)}
    moves, rules_at = np.zeros((len(names), 256), np.int32), {}
    for b, i in place.items():
        k = block.index(b)
        for members, to in zip(classes, table[k], strict=True):
            moves[i, members] = place[block[to]] * 256
        if accepts[k]:
            rules_at[i] = accepts[k]
    first = min(rules_at, default=len(names)) * 256
    dead = place[block[number[frozenset()]]] * 256 if frozenset() in number else -1
    return Automaton(moves.ravel(), first, rules_at, (moves == 0).all(0), dead)


def _minimal(table: list[list[int]], accepts: list[tuple]) -> list[int]:
    """The block of each state, when states that no input tells apart share one."""
    kinds: dict = {}
    block = [kinds.setdefault(a, len(kinds)) for a in accepts]
    while True:
        again: dict = {}
        finer = [again.setdefault((block[s], *(block[t] for t in row)), len(again)) for s, row in enumerate(table)]
        if len(again) == len(set(block)):
            return block
        block = finer
