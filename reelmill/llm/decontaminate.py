"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The words of all items are numbered, and their strings make one automaton a block of
items. Training texts stream through it: words become numbers, runs of words that
could hold a match go through the automaton, and the longest match at each word says
which windows of which items end there. Blocks have a bounded number of words, so
that what is broadcast is bounded however large the benchmark is; texts go through
one block after another.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.llm.common import _arrow, checkpoint, map_batches, sliced, texts, written
from reelmill.llm.suffix import SuffixAutomaton, _among
from reelmill.llm.words import Words, hashes, words_of

#: Words of a block of items on average, of which a task makes an automaton of about 100 bytes a word.
BLOCK_WORDS = 1 << 17
#: Words of a segment; a longer item is cut into segments that share all but one word of a window.
SEGMENT = 1024
MATCH = "n_words long, n_hit long, longest long, spans array<struct<start: long, end: long>>, items array<string>"


@dataclass(frozen=True)
class Limits:
    """Windows have so many words. Hit spans of least_span words or more are cut out of a text; texts of which a larger share than most_share is hit go as a whole."""

    window: int = 10
    least_span: int = 10
    most_share: float = 0.5


class Block:
    """The automaton of a block of items, the words that it knows and the names of their items."""

    def __init__(self, segments: list[tuple[bytes, str | None]], window: int) -> None:
        """segments: normalised words joined by spaces, and the id of their item."""
        split = [(s.split(b" "), name) for s, name in segments]
        self.vocabulary = sorted({w for s, _ in split for w in s})
        number = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        self.names = sorted({n for _, n in split if n is not None})
        owner = {n: i for i, n in enumerate(self.names)} | {None: -1}
        self.automaton = SuffixAutomaton([([number[w] for w in s], owner[n]) for s, n in split], len(self.vocabulary), window)
        flat = words_of(pa.array([b" ".join(self.vocabulary)], pa.binary()))
        h = hashes(flat)
        order = np.argsort(h, kind="stable")
        self.hashes, self.numbers = h[order], (order + 1).astype(np.int32)
        if len(h) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words of a benchmark share a 64-bit hash")
        self.seen = np.zeros(1 << 20, bool)
        self.seen[h >> np.uint64(44)] = True

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """The number of each word by its hash, 0 for those that no item has."""
        made = np.zeros(len(h), np.int32)
        if len(self.hashes):
            some = np.flatnonzero(self.seen[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            held = self.hashes[at] == h[some]
            made[some[held]] = self.numbers[at[held]]
        return made

    def matches(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """(whether each word is hit, the longest match that ends at each word, the items of each text).

        A word whose hash alone is that of an item's word is found out when it is hit.
        """
        tokens = self.tokens(h)
        while True:
            places, states, lengths = self.automaton.matched(tokens, *self.automaton.runs(tokens, words.first))
            longest, steps, items = np.zeros(len(tokens), np.int32), np.zeros(len(tokens) + 1, np.int32), {}
            longest[places] = lengths
            for size, which, at in self.automaton.windows(states, lengths):
                np.add.at(steps, places[which] - size + 1, 1)
                np.add.at(steps, places[which] + 1, -1)
                text = np.searchsorted(words.first, places[which], side="right") - 1
                for t, state in np.unique(np.stack([text, at], axis=1), axis=0).tolist() if len(which) else ():
                    items.setdefault(t, set()).update(self.names[o] for o in self.automaton.owners_at(size, state).tolist() if o >= 0)
            hit = np.cumsum(steps[:-1]) > 0
            strangers = [i for i in np.flatnonzero(hit).tolist() if words.word(i) != self.vocabulary[tokens[i] - 1]]
            if not strangers:
                return hit, longest, items
            tokens[strangers] = 0


def segments_of(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item string, part long, words binary, n long): the normalised words of items, cut into segments; items without a word have none."""
    own = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "item string, part long, words binary, n long"
    arrow = _arrow(items.sparkSession, schema)

    def run(batches):
        for batch in sliced(batches):
            words, rows = words_of(batch.column("text")), []
            for i, item in enumerate(batch.column("item").to_pylist()):
                own = [words.word(w) for w in range(words.first[i], words.first[i + 1])]
                step = max(1, SEGMENT - window + 1)
                for at in range(0, max(min(1, len(own)), len(own) - window + 1), step):
                    part = own[at : at + max(SEGMENT, window)]
                    rows.append((item, at, b" ".join(part), len(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return map_batches(own, run, schema)


def blocks_of(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """((block, automaton binary), how many): segments are dealt by hash, so that all blocks are about block_words long."""
    held = checkpoint(segments_of(items, window, id_col, text_col).distinct())
    words = held.agg(F.sum("n")).first()[0] or 0
    many = max(1, -(-words // block_words))
    schema = "block int, automaton binary"
    arrow = _arrow(items.sparkSession, schema)

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("words").to_pylist(), table.column("item").to_pylist(), strict=True), key=lambda r: (r[0], r[1] or ""))
        return pa.table({"block": table.column("block")[:1], "automaton": [pickle.dumps(Block(rows, window))]}, schema=arrow)

    dealt = held.select(F.pmod(F.xxhash64("item", "part", "words"), F.lit(many)).cast("int").alias("block"), "words", "item")
    return checkpoint(dealt.groupBy("block").applyInArrow(build, schema)), many


def _merged(one: dict | None, first: list[tuple[int, int]], items: set[str], longest: int) -> tuple[list, set, int]:
    """What several blocks found of one text, as spans of words."""
    if one:
        items, longest = items | set(one["items"]), max(longest, one["longest"])
        first = sorted(first + [(s["start"], s["end"]) for s in one["spans"]])
    spans: list[tuple[int, int]] = []
    for lo, hi in first:
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], hi))
        else:
            spans.append((lo, hi))
    return spans, items, longest


def matches(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """docs with __match: n_words, n_hit, longest, spans (hit words, in word numbers with exclusive ends), items (sorted).

    A window is window consecutive words of an item, or a whole shorter item; longest
    is the longest run of words that an item has too, measured up to SEGMENT words.
    With cut, __kept is the text without its spans of least_span words or more, from a
    span's first byte to its last. Null and empty texts, and items without a word,
    have no match; an item without an id hits words and is not listed; items that
    share an id are one. Repeated rows come back as often as they are there.
    """
    built, many = blocks_of(items, limits.window, item_id, item_text, block_words)
    own, spark = list(docs.columns), docs.sparkSession
    df, place = docs, docs.columns.index(text_col)
    found = [T.StructField("__match", T.StructType.fromDDL(MATCH))]
    kept = [T.StructField("__kept", T.StringType())] if cut else []
    for block in range(many):
        row = built.where(F.col("block") == block).first()
        last = block == many - 1
        held = spark.sparkContext.broadcast(bytes(row.automaton) if row else b"")
        out = T.StructType([*docs.schema.fields, *found, *(kept if last else [])])
        df = map_batches(df, _pass(held, place, len(own), block > 0, limits if cut and last else None, _arrow_of(out)), out)
        if not last:
            df = written(df)  # each task holds one block's automaton
    return df


def _arrow_of(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pass(held, place: int, width: int, before: bool, limits: Limits | None, arrow: pa.Schema):
    """The task that takes batches of texts through one block; with limits it cuts the texts as well."""

    def run(batches):
        block = pickle.loads(held.value) if held.value else None
        for batch in sliced(batches, place):
            column = batch.column(place).fill_null("")
            words, n = words_of(column), batch.num_rows
            if block:
                hit, longest, items = block.matches(words, hashes(words))
            else:
                hit, longest, items = np.zeros(len(words.starts), bool), np.zeros(len(words.starts), np.int32), {}
            # spans end with their text
            text = np.searchsorted(words.first, np.flatnonzero(hit), side="right") - 1
            some = dict.fromkeys(text.tolist())
            earlier = batch.column(width).to_pylist() if before else [None] * n
            made, cut = [], []
            for i in range(n):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                spans: list[tuple[int, int]] = []
                if i in some:
                    steps = np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]]))
                    spans = list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))
                far = int(longest[lo:hi].max(initial=0)) if hi > lo else 0
                spans, names, far = _merged(earlier[i], spans, items.get(i, set()), far)
                made.append({"n_words": hi - lo, "n_hit": sum(b - a for a, b in spans), "longest": far, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(names)})
                if limits:
                    cut.append(_without(column[i].as_py(), [(lo + a, lo + b) for a, b in spans if b - a >= limits.least_span], words, int(words.texts[i])))
            columns = [*batch.columns[:width], pa.array(made, arrow.field("__match").type)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(cut, pa.string())] if limits else []), schema=arrow)

    return run


def _without(text: str, spans: list[tuple[int, int]], words: Words, begin: int) -> str:
    if not spans:
        return text
    raw, at, parts = text.encode(), 0, []
    for a, b in spans:
        parts.append(raw[at : int(words.starts[a]) - begin])
        at = int(words.starts[b - 1] + words.sizes[b - 1]) - begin
    return b"".join([*parts, raw[at:]]).decode()


def contamination(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, longest, spans, items) for every row of docs, at the edges as matches() says.

    An empty docs gives no rows, an empty items no hit; other columns play no part.
    """
    found = matches(texts(docs, id_col, text_col), items, limits)
    return found.select("doc_id", "__match.*")


def decontaminated(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """docs without what the limits forbid: long spans are cut out of texts, and texts that are hit too much go.

    Texts without such a span stay as they are, null ones too.
    """
    found = matches(docs, items, limits, text_col, cut=True)
    share = F.col("__match.n_hit") / F.greatest(F.lit(1), F.col("__match.n_words"))
    text = F.when(F.col(text_col).isNotNull(), F.col("__kept"))
    return found.where(share <= limits.most_share).withColumn(text_col, text).select(*docs.columns)
