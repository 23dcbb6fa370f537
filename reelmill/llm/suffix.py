"""A generalised suffix automaton of word strings, as arrays that match many runs of words side by side."""

from __future__ import annotations

import numpy as np

#: Words of a lane; a longer run is cut into lanes that overlap by as much as a match can be long.
LANE = 2048


class SuffixAutomaton:
    """All substrings of strings of word numbers (from 1), each string given with the number of its owner.

    A string of window words or more has all its runs of window words as windows; a
    shorter one is a window by itself. For each window size in use, above[size] says
    which state stands for the last size words of what another state has matched, and
    owners_at(size, state) whose windows these are.
    """

    def __init__(self, strings: list[tuple[list[int], int]], words: int, window: int) -> None:
        self.words, self.longest = words + 1, max((len(s) for s, _ in strings), default=0)
        moves, link, length = [{}], [-1], [0]
        for string in {tuple(s) for s, _ in strings}:
            last = 0
            for word in string:
                last = _extended(moves, link, length, last, word)
        keys = [s * self.words + w for s, own in enumerate(moves) for w in own]
        to = [t for own in moves for t in own.values()]
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int32)[order]
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self.sizes = sorted({min(len(s), window) for s, _ in strings if s})
        self.above = {k: self._above(k) for k in self.sizes}
        self.first, self.owners = {}, {}
        found: dict[int, set[tuple[int, int]]] = {k: set() for k in self.sizes}
        for string, owner in strings:
            if not string:
                continue
            k, state, above = min(len(string), window), 0, self.above[min(len(string), window)]
            for i, word in enumerate(string):
                state = moves[state][word]
                if i >= k - 1:
                    found[k].add((int(above[state]), owner))
        for k, pairs in found.items():
            rows = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            self.first[k] = np.searchsorted(rows[:, 0], np.arange(len(link) + 1)).astype(np.int32)
            self.owners[k] = rows[:, 1].astype(np.int32)
        pairs = {(a, b) for s, _ in strings for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(a * self.words + b for a, b in pairs), np.int64)

    def _above(self, k: int) -> np.ndarray:
        """For each state the one on its path of suffix links whose words are those of size k; 0 where it has fewer."""
        made = np.zeros(len(self.link), np.int32)
        for s in np.argsort(self.length, kind="stable").tolist():
            if self.length[s] >= k:
                made[s] = s if self.length[self.link[s]] < k else made[self.link[s]]
        return made

    def owners_at(self, k: int, state: int) -> np.ndarray:
        return self.owners[k][self.first[k][state] : self.first[k][state + 1]]

    def runs(self, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, ends) of the runs that may hold a window: known words, whose neighbours are neighbours in a string too.

        tokens are word numbers, 0 for unknown ones; no run goes on over begins.
        """
        if not len(tokens) or not self.sizes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = tokens > 0
        joined = known[1:] & known[:-1]
        at = np.flatnonzero(joined)
        joined[at] = _among(self.pairs, tokens[at].astype(np.int64) * self.words + tokens[at + 1])
        inner = begins[(begins > 0) & (begins < len(tokens))]
        joined[inner - 1] = False
        first = np.flatnonzero(known & np.append(True, ~joined))
        end = np.flatnonzero(known & np.append(~joined, True)) + 1
        long = end - first >= self.sizes[0]
        return first[long], end[long]

    def matched(self, tokens: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, states, lengths): the longest match that ends at each word of the runs, once a word.

        Lanes go through the automaton together, a word a step. One that doesn't begin
        where its run does first reads as many words as a match can have.
        """
        lane = max(LANE, 4 * self.longest)
        starts = [np.arange(a, b, lane) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        at = np.concatenate([np.zeros(0, np.int64), *starts])
        run = np.repeat(np.arange(len(first)), [len(s) for s in starts])
        stop, begin = np.minimum(at + lane, end[run]), np.maximum(at - self.longest + 1, first[run])
        order = np.argsort(begin - stop, kind="stable")
        at, stop, begin = at[order], stop[order], begin[order]
        state, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        places, states, lengths = [], [], []
        for step in range(int((stop - begin).max(initial=0))):
            n = int(np.searchsorted(begin - stop, -step, side="left"))
            here = begin[:n] + step
            state[:n], length[:n] = self._step(state[:n], length[:n], tokens[here].astype(np.int64))
            own = here >= at[:n]
            places.append(here[own])
            states.append(state[:n][own])
            lengths.append(length[:n][own])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *states]), np.concatenate([none, *lengths])

    def _step(self, state: np.ndarray, length: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, length, todo = state.copy(), length.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            done = todo[found]
            state[done], length[done] = self.to[at[found]], length[done] + 1
            todo = todo[~found]
            # words that no string holds never come here, and so the start has a move for each
            state[todo] = self.link[state[todo]]
            length[todo] = self.length[state[todo]]
        return state, length

    def windows(self, states: np.ndarray, lengths: np.ndarray):
        """(size, which, states): for each window size, which of the matches end with a window, and its state."""
        for k in self.sizes:
            which = np.flatnonzero(lengths >= k)
            at = self.above[k][states[which]]
            held = self.first[k][at + 1] > self.first[k][at]
            yield k, which[held], at[held]


def _extended(moves: list[dict], link: list[int], length: list[int], last: int, word: int) -> int:
    """The state after word is read at last, the end of what was read of a string so far, with states made as needed."""
    if word in moves[last]:
        held = moves[last][word]
        return held if length[held] == length[last] + 1 else _parted(moves, link, length, last, word, held)
    new = _state(moves, link, length, {}, length[last] + 1)
    at = last
    while at >= 0 and word not in moves[at]:
        moves[at][word] = new
        at = link[at]
    if at < 0:
        link[new] = 0
    else:
        held = moves[at][word]
        link[new] = held if length[held] == length[at] + 1 else _parted(moves, link, length, at, word, held)
    return new


def _parted(moves: list[dict], link: list[int], length: list[int], at: int, word: int, held: int) -> int:
    """A copy of held for its shorter substrings, which at and its suffixes reach by word."""
    copy = _state(moves, link, length, dict(moves[held]), length[at] + 1)
    link[copy], link[held] = link[held], copy
    while at >= 0 and moves[at].get(word) == held:
        moves[at][word] = copy
        at = link[at]
    return copy


def _state(moves: list[dict], link: list[int], length: list[int], own: dict, n: int) -> int:
    moves.append(own)
    link.append(0)
    length.append(n)
    return len(moves) - 1


def _among(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array held."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values
