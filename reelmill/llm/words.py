"""Words of whole Arrow batches: bytes classified by a lookup table, boundaries by differences, hashes of all words at once.

A word is a run of ASCII digits, letters and bytes of code points beyond ASCII, with A
to Z in lower case; it ends where its text does. Working on the UTF-8 bytes is exact,
as every byte of a code point beyond ASCII is 128 or more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from reelmill.llm.shingles import _FIRST, _mixed

#: Bytes that are classified at once, and bytes from which a word is hashed by itself.
PIECE, LONG = 1 << 21, 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, np.int8)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = 1
INSIDE[128:] = 1


def crc_table() -> np.ndarray:
    """The CRC-32 register that each byte leaves, by the polynomial's eight shifts."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()


@dataclass(frozen=True)
class Words:
    """Places of words in data (lower-cased bytes of all texts of a column); text i has the words first[i] to first[i + 1].

    texts holds where each text begins in data, and last where the last one ends.
    """

    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary column; nulls take no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, places, held = column.buffers()
    if not len(column) or not places:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(column: pa.Array) -> Words:
    """The words of each text of a column without nulls."""
    raw, offsets = buffer_of(column)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(raw), PIECE):
        # one byte on either side says whether a word goes on beyond the piece
        lo, hi = max(0, at - 1), min(len(raw), at + PIECE + 1)
        steps = np.diff(INSIDE[raw[lo:hi]])
        starts.append(np.flatnonzero(steps[: min(at + PIECE, len(raw)) - lo - 1] == 1) + lo + 1)
        ends.append(np.flatnonzero(steps[: min(at + PIECE, len(raw)) - lo - 1] == -1) + lo + 1)
    begins, stops = np.concatenate(starts), np.concatenate(ends)
    if len(raw):
        if INSIDE[raw[0]]:
            begins = np.append(0, begins)
        if INSIDE[raw[-1]]:
            stops = np.append(stops, len(raw))
    # a word that goes on over the end of a text is two words
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(raw))]
    cut = inner[(INSIDE[raw[inner]] & INSIDE[raw[inner - 1]]) == 1] if len(inner) else inner
    if len(cut):
        begins, stops = np.sort(np.append(begins, cut)), np.sort(np.append(stops, cut))
    return Words(LOWER[raw], offsets, begins, stops - begins, np.searchsorted(begins, offsets))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes of all words at a time."""
    data, starts, sizes = words.data, words.starts, words.sizes
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h, live, k = np.zeros(len(starts), np.uint64), np.arange(len(starts)), 0
    while len(live) and k < LONG:
        left = sizes[live] - k
        h[live] = _mixed((h[live] + sizes[live].astype(np.uint64)) ^ (eight[starts[live] + k] & _FIRST[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    for i in live.tolist():
        h[i] = xxhash.xxh64_intdigest(words.word(i))
    return h


def advanced(register: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 registers after they have read sizes bytes from starts, all of them a byte at a time.

    Longest first, so that those still reading are always the front of the array.
    """
    short = np.minimum(sizes, LONG).astype(np.uint16)
    order = np.argsort(-short.astype(np.int16), kind="stable")
    state, at = register[order], starts[order]
    reading = len(short) - np.cumsum(np.bincount(short, minlength=LONG + 1))
    for k in range(int(short.max(initial=0))):
        n = int(reading[k])
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    made = np.empty_like(register)
    made[order] = state
    for i in np.flatnonzero(sizes > LONG).tolist():
        rest = data[starts[i] + LONG : starts[i] + sizes[i]].tobytes()
        made[i] = zlib.crc32(rest, int(made[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return made


def run_crcs(words: Words, longest: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of first words, CRC-32s) of the runs of 1 to longest words that begin at words lo to hi, joined by one space.

    A run's register goes on from that of the run shorter by one, so that no byte is read twice for one length.
    """
    text = np.searchsorted(words.first, np.arange(lo, hi), side="right")
    begin, until = np.arange(lo, hi), words.first[text] if hi > lo else np.zeros(0, np.int64)
    register = np.full(hi - lo, 0xFFFFFFFF, np.uint32)
    for k in range(longest):
        inside = begin + k < until
        begin, until, register = begin[inside], until[inside], register[inside]
        if k:
            register = CRC[(register ^ np.uint32(32)) & 255] ^ (register >> 8)
        register = advanced(register, words.data, words.starts[begin + k], words.sizes[begin + k])
        yield begin, register ^ np.uint32(0xFFFFFFFF)
