"""Byte-level BPE: a minimal acyclic transducer for frequent words, exact merges for the rest.

Words are counted over the whole corpus. The most frequent become a minimal
acyclic automaton, whose states share prefixes and suffixes; the number of words
before a path's end, summed along it, says where the word's ids are. Its arrays
are one file, which every worker maps into memory. Words outside it are merged by
the tokenizer's ranks, so that the ids don't depend on what is frequent.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import iter_unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import _arrow, checkpoint, map_batches, sliced, texts

#: Words in the lexicon at most, how often one must occur, and its characters at most.
LEXICON, LEAST, LONGEST = 1 << 18, 3, 64
#: Characters of text that are worked on at once, and of a piece of a very long text.
CHUNK, PIECE = 1 << 20, 1 << 20
NO_MERGE, ID_MASK = 1 << 62, (1 << 32) - 1
#: Bytes of a word at most that is merged together with others of its length, and how many of them at once.
TOGETHER, ROWS = 32, 1 << 14


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def word_pattern() -> re.Pattern:
    """The split before merges, with the classes of letters, numbers and white space spelled out."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        if (own := runs.get(unicodedata.category(chr(c))[0])) is not None:
            if own and own[-1][1] == c - 1:
                own[-1][1] = c
            else:
                own.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs[k]) for k in "LN")
    # fixed values: white space, and the endings that stand alone
    white = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+")


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranks and ids of a byte-level BPE file of the tokenizers library."""

    def __init__(self, file: bytes) -> None:
        data, byte_of = json.loads(file), _byte_of()
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocab = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.id_of_byte = [vocab.get(bytes([b]), -1) for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate((raw(a), raw(b)) for a, b in pairs)}
        pairs_of = np.array([a << 20 | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs_of)
        self.pairs, self.made = pairs_of[order], np.array(list(self.merges.values()), np.int64)[order]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.specials.items()}
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def ids(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of the lowest rank merges first, the leftmost of equal ones.

        A merge's number holds its rank above the id that it makes, so that the least
        number is the first merge.
        """
        parts, get = [self.id_of_byte[b] for b in word], self.merges.get
        ranks = [get(p, NO_MERGE) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NO_MERGE:
            at, new = ranks.index(least), least & ID_MASK
            if len(parts) > 64:  # long words: all places of this pair in one sweep
                a, b, out, k = parts[at], parts[at + 1], parts[:at], at
                while k < len(parts):
                    if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                        out.append(new)
                        k += 2
                    else:
                        out.append(parts[k])
                        k += 1
                parts = out
                ranks = [get(p, NO_MERGE) for p in zip(parts, parts[1:])]
                continue
            parts[at : at + 2] = [new]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get((new, parts[at + 1]), NO_MERGE)
            if at:
                ranks[at - 1] = get((parts[at - 1], new), NO_MERGE)
        return parts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The numbers of the merges of pairs, or NO_MERGE."""
        if not len(self.pairs):
            return np.full(left.shape, NO_MERGE, np.int64)
        key = left * (1 << 20) + right
        at = np.searchsorted(self.pairs, key).clip(max=len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NO_MERGE)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, how many each word has): words of one length are merged together, a step each at a time."""
        size, of_byte, done = np.fromiter(map(len, words), np.int64, len(words)), np.array(self.id_of_byte, np.int64), []
        for length in np.unique(size).tolist():
            alike = np.flatnonzero(size == length)
            if length > TOGETHER:
                done += [(alike[i : i + 1], np.array([self.ids(words[k])], np.int64)) for i, k in enumerate(alike.tolist())]
                continue
            for at in range(0, len(alike), ROWS):
                some = alike[at : at + ROWS]
                parts = of_byte[np.frombuffer(b"".join([words[k] for k in some.tolist()]), np.uint8).reshape(len(some), length)]
                done += self._merged(some, parts)
        count = np.zeros(len(words), np.int64)
        for some, parts in done:
            count[some] = parts.shape[1]
        starts = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for some, parts in done:
            flat[starts[some][:, None] + np.arange(parts.shape[1])] = parts
        return flat, count

    def _merged(self, words: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of words' parts, merged by rank until none fits: each round takes one merge in every row, so that rows stay equally long."""
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while ranks.shape[1]:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(at)), at]
            if (stop := least == NO_MERGE).any():
                yield words[stop], parts[stop]
                words, parts, ranks, at, least = words[~stop], parts[~stop], ranks[~stop], at[~stop], least[~stop]
            if not len(words):
                return
            rows, width, new = np.arange(len(words)), parts.shape[1], least & ID_MASK
            parts[rows, at] = new
            stay = np.ones(parts.shape, bool)
            stay[rows, at + 1] = False
            parts = parts[stay].reshape(len(words), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[rows, at] = False
            ranks = ranks[stay].reshape(len(words), width - 2)
            for own, place, side in ((at < width - 2, at, 1), (at > 0, at - 1, 0)):
                own = np.flatnonzero(own)
                place = place[own]
                ranks[own, place] = self._ranks(new[own], parts[own, place + 1]) if side else self._ranks(parts[own, place], new[own])
        yield words, parts

    def unit_ids(self, unit: str) -> list[int]:
        """The ids of a unit, which is a special token or a run of whole words."""
        if unit in self.specials:
            return [self.specials[unit]]
        return [i for w in word_pattern().findall(unit) for i in self.ids(w.encode())]

    def units(self, text: str) -> list[str]:
        """A text in pieces between which words end for sure, in order: mostly a word with its marks and the blank before it.

        A blank or a line end between marks always begins a word, and a line end is one
        of its own. Texts with other white space are split by the pattern.
        """
        parts = [text]
        if self.special is not None and any(s in text for s in self.specials):
            parts = self.special.split(text)
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append(part)
            elif _RUN.search(part) or SPLIT in part:
                found += word_pattern().findall(part)
            else:
                found += filter(None, part.replace("\n", f"{SPLIT}\n{SPLIT}").replace(" ", f"{SPLIT} ").split(SPLIT))
        return found


#: White space beside a blank or a line end, where words may hold several of them; a mark that is not for use in texts.
_RUN, SPLIT = re.compile(r"\s[ \n]|\n\s"), "\ue000"


class Lexicon:
    """A transducer in one array: (state, byte) keys with target and words passed by, then states' ends, then ids.

    The words' ids lie in the order of the words' bytes; a path's place among them is
    the sum of what its steps pass by. All numbers have 32 bits: 2**23 states at most.
    """

    def __init__(self, flat: np.ndarray) -> None:
        steps, states, words, ids = (int(x) for x in flat[:4])
        cuts = np.cumsum([4, steps, steps, steps, states, words + 1, ids])
        self.keys, self.targets, self.passed, self.final, self.offsets, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    @staticmethod
    def build(words: list[bytes], ids: Iterable[list[int]]) -> np.ndarray:
        """The flat array for distinct words in order of their bytes; equal suffixes share their states.

        A state is written as bytes: whether a word ends, then each step's byte and
        target. What is written alike is one state, numbered when it is first closed.
        """
        register: dict[bytes, int] = {}
        counts = array("q")  # words from a state on
        path = [bytearray(1)]  # the open states of the last word; the last step of each still lacks its target

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                state = bytes(path.pop())
                if (number := register.get(state)) is None:
                    number = register[state] = len(register)
                    counts.append(state[0] + sum(counts[to] for _, to in iter_unpack("<Bi", state[1:])))
                path[-1] += number.to_bytes(4, "little")

        before = b""
        for word in words:
            shared = len(os.path.commonprefix([before, word]))
            close(shared)
            for byte in word[shared:]:
                path[-1].append(byte)
                path.append(bytearray(1))
            path[-1][0] = 1
            before = word
        close(0)
        states = [bytes(path[0]), *register]  # the start is state 0, and so the steps are in order of their keys
        sizes, final = np.array([len(s) // 5 for s in states]), np.array([s[0] for s in states])
        steps = np.frombuffer(b"".join([s[1:] for s in states]), np.dtype([("byte", "u1"), ("to", "<i4")]))
        owner = np.repeat(np.arange(len(states)), sizes)
        after = np.array(counts, np.int64)[steps["to"]]
        ahead = np.cumsum(after) - after
        passed = final[owner] + ahead - ahead[np.repeat(np.cumsum(sizes) - sizes, sizes)]
        flat, offsets = array("i"), array("i", [0])
        for own in ids:
            flat.extend(own)
            offsets.append(len(flat))
        head = [len(steps), len(states), len(words), len(flat)]
        return np.concatenate([np.asarray(x, np.int32) for x in (head, owner * 256 + steps["byte"], steps["to"] + 1, passed, final, offsets, flat)])

    def ids_at(self, places: np.ndarray) -> Iterator[list[int]]:
        """The ids of the words at places."""
        flat, count = self.runs_at(places)
        ends = np.cumsum(count)
        return (flat[a:b].tolist() for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True))

    def runs_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, how many each word has) of the words at places."""
        starts = self.offsets[places].astype(np.int64)
        count = self.offsets[places + 1] - starts
        return self.ids[_runs(starts, count)], count

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, or -1; all words step through the automaton together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.append(0, np.cumsum(size)[:-1])
        data, out = np.frombuffer(b"".join(words), np.uint8), np.full(len(words), -1, np.int64)
        live, state, place, depth = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(live) and len(self.keys):
            done = size[live] == depth
            ended = done & (self.final[state] == 1)
            out[live[ended]] = place[ended]
            live, state, place = live[~done], state[~done], place[~done]
            if not len(live):
                break
            key = state.astype(np.int32) * np.int32(256) + data[starts[live] + depth]
            at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            known = self.keys[at] == key
            live, at = live[known], at[known]
            state, place, depth = self.targets[at], place[known] + self.passed[at], depth + 1
        return out


def _runs(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(count)
    return np.repeat(starts - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(text: str) -> Iterator[str]:
    """A long text, cut where a word ends for sure: between a mark and one blank before another mark."""
    while len(text) > PIECE and (cut := _CUT.search(text, PIECE)):
        yield text[: cut.start()]
        text = text[cut.start() :]
    yield text


_CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[A-Za-z])")


def word_counts(df: DataFrame, file: bytes, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts of df; a word goes with the marks and the blank at it, as units() gives it."""
    held, arrow = df.sparkSession.sparkContext.broadcast(file), _arrow(df.sparkSession, "word string, n long")

    def run(batches):
        merges, seen, size = _merges(held), Counter(), 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=arrow)
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                for piece in _pieces(text):
                    seen.update(merges.units(piece))
                    size += len(piece)
                if size > CHUNK:
                    yield flush()
                    seen, size = Counter(), 0
        yield flush()

    return map_batches(df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_MERGES: dict[int, Merges] = {}


def _merges(held) -> Merges:
    """This worker's Merges of a broadcast file."""
    key = hash(held.value)
    if key not in _MERGES:
        _MERGES.clear()
        _MERGES[key] = Merges(held.value)
    return _MERGES[key]


def build_lexicon(df: DataFrame, file: bytes, most: int = LEXICON, least: int = LEAST) -> np.ndarray:
    """The transducer of df's most frequent words: all that occur as often as the least one taken, most at most."""
    counts = checkpoint(word_counts(df, file).where(F.col("n") >= least))
    # the least count that leaves no more words than fit, by eighths of a doubling: few rows, however many words
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    total, lowest = 0, None
    for row in sizes:
        if (total := total + row.words) > most:
            break
        lowest = row.step
    rows = counts.where(step >= lowest).select("word").toArrow().column("word").to_pylist() if lowest is not None else []
    merges = Merges(file)
    words = sorted([w.encode() for w in rows if w not in merges.specials and len(w) <= LONGEST])
    return Lexicon.build(words, (merges.unit_ids(w.decode()) for w in words))


_MAPPED: dict[bytes, np.ndarray] = {}


def mapped(data: bytes) -> np.ndarray:
    """A lexicon's array, mapped once a worker from a file that goes when the worker does or reads another lexicon."""
    key = hashlib.sha256(data).digest()
    if key not in _MAPPED:
        _MAPPED.clear()
        with tempfile.NamedTemporaryFile(suffix=".lexicon") as f:
            f.write(data)
            f.flush()
            _MAPPED[key] = np.memmap(f.name, np.int32, "r")
    return _MAPPED[key]


class Encoder:
    """Ids of texts by a lexicon, and by merges where it has none; and texts of ids."""

    def __init__(self, merges: Merges, lexicon: Lexicon) -> None:
        self.merges, self.lexicon = merges, lexicon
        self.text_of = [str(i) for i in range(max(merges.bytes_of) + 1)]
        self.bytes_of = [merges.bytes_of.get(i, b"") for i in range(len(self.text_of))]

    def _looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, ids of the words that the lexicon holds, how many each of those has); places are -1 where it holds none."""
        places = self.lexicon.places([w.encode() for w in words])
        return places, *self.lexicon.runs_at(places[places >= 0])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, how many each word has) of single words and special tokens."""
        places, flat, count = self._looked_up(words)
        rare = np.flatnonzero(places < 0)
        merged, own = self.merges.ids_of([b"" if words[k] in self.merges.specials else words[k].encode() for k in rare.tolist()])
        special = [k for k in np.flatnonzero(own == 0).tolist() if words[rare[k]] in self.merges.specials]
        merged = np.insert(merged, (np.cumsum(own) - own)[special], [self.merges.specials[words[rare[k]]] for k in special])
        own[special] = 1
        return _woven(places >= 0, (flat, count), (merged, own))

    def unit_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, how many each unit has): units that the lexicon lacks are split into words, which it may hold."""
        places, flat, count = self._looked_up(units)
        find = word_pattern().findall
        parts = [[units[k]] if units[k] in self.merges.specials else find(units[k]) for k in np.flatnonzero(places < 0).tolist()]
        index = {w: i for i, w in enumerate(dict.fromkeys(w for words in parts for w in words))}
        ids, each = self._words(list(index))
        code = np.array([index[w] for words in parts for w in words], np.int64)
        unit = np.repeat(np.arange(len(parts)), [len(words) for words in parts])
        starts = np.cumsum(each) - each
        rest = ids[_runs(starts[code], each[code])], np.bincount(unit, each[code], len(parts)).astype(np.int64)
        return _woven(places >= 0, (flat, count), rest)

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, how many each unit has) of units as they follow in texts; each is looked up once."""
        index = {u: i for i, u in enumerate(dict.fromkeys(units))}
        ids, each = self.unit_ids(list(index))
        code = np.fromiter(map(index.__getitem__, units), np.int64, len(units))
        starts = np.cumsum(each) - each
        return ids[_runs(starts[code], each[code])], each[code]


def _woven(first: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The runs (flat, count) of a where first is true and those of b where it isn't, in order."""
    count, starts = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for which, (_, own), base in ((first, a, 0), (~first, b, len(a[0]))):
        count[which], starts[which] = own, base + np.cumsum(own) - own
    return np.concatenate([a[0], b[0]]).astype(np.int32)[_runs(starts, count)], count


def encode(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, most: int = LEXICON) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids array<int>) for every row of df.

    ids are those of the tokenizers library without a post-processor's tokens; special
    tokens in a text get their own ids. decoded_sha256 is of the text that the ids
    decode to. Null and empty texts have no ids. Repeated rows come back as often as
    they are there, null ids stay null, and other columns of df play no part.
    with_ids=False leaves ids out.
    """
    with open(tokenizer or default_path(), "rb") as f:
        file = f.read()
    docs = texts(df, id_col, text_col)
    # a lexicon has most words at most, whatever the input's size
    lexicon_held = df.sparkSession.sparkContext.broadcast(build_lexicon(docs, file, most).tobytes())
    held = df.sparkSession.sparkContext.broadcast(file)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    arrow = _arrow(df.sparkSession, schema)

    def run(batches):
        encoder = Encoder(_merges(held), Lexicon(mapped(lexicon_held.value)))
        for batch in sliced(batches, most=CHUNK):
            yield encoded(batch, encoder)

    def groups(rows: list[str], merges: Merges) -> Iterator[tuple[list[int], list[int], list[str]]]:
        """(row of each piece, units of each piece, all units) of pieces, so many that they hold about CHUNK characters."""
        of, many, units, size = [], [], [], 0
        for k, text in enumerate(rows):
            for piece in _pieces(text):
                before = len(units)
                units += merges.units(piece)
                of.append(k)
                many.append(len(units) - before)
                size += len(piece)
                if size >= CHUNK:
                    yield of, many, units
                    of, many, units, size = [], [], [], 0
        if of:
            yield of, many, units

    def encoded(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        n, text_of, bytes_of = batch.num_rows, encoder.text_of.__getitem__, encoder.bytes_of.__getitem__
        counts, ids = [0] * n, [[] for _ in range(n)]
        of_ids, of_text = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        for of, many, units in groups(batch.column("text").to_pylist(), encoder.merges):
            flat, each = encoder.ids(units)
            cuts = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(many))].tolist()
            for k, lo, hi in zip(of, cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                own = flat[lo:hi].tolist()
                of_ids[k].update((("," if counts[k] else "") + ",".join(map(text_of, own))).encode())
                of_text[k].update(b"".join(map(bytes_of, own)).decode("utf-8", "replace").encode())
                counts[k] += hi - lo
                if with_ids:
                    ids[k].append(flat[lo:hi])
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in of_ids]), pa.array([h.hexdigest() for h in of_text])]
        if with_ids:
            flat = np.concatenate([np.zeros(0, np.int32), *(x for own in ids for x in own)])
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat)))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    return map_batches(docs, run, schema)


def decode(ids: list[int], merges: Merges) -> str:
    """The text that ids stand for, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(merges.bytes_of[i] for i in ids).decode("utf-8", "replace")
