"""Sets of word shingles as 64-bit hashes, of a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
#: Bytes whose words are sought at once, and bytes from which a word is hashed by itself.
PIECE, LONG = 1 << 21, 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: What is left of eight bytes when only the first k count.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    z = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _pieces(data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places that cut data into runs of about PIECE bytes, where no word goes on."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not (_BLANK[data[end]] or begins[end]):
            stop = _BLANK[data[end : end + 4096]] | begins[end : end + 4096]
            end += int(stop.argmax()) if stop.any() else len(stop)
        yield at, end
        at = end


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in data; a word ends at a blank and where a text begins."""
    inside = ~_BLANK[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~inside[:-1] | begins[1:], ~inside[1:] | begins[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size, h, live, k = ends - starts, np.zeros(len(starts), np.uint64), np.arange(len(starts)), 0
    while len(live) and k < LONG:
        left = size[live] - k
        h[live] = _mixed((h[live] + size[live].astype(np.uint64)) ^ (eight[starts[live] + k] & _FIRST[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    for i in live.tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return starts, h


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text of a string or binary column without nulls.

    Words are split at ASCII blanks, A to Z in lower case. A text of fewer than five
    words is one shingle, one without a word none.
    """
    _, places, held = column.buffers()
    offsets = np.frombuffer(places, np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if places else np.zeros(len(column) + 1, np.int64)
    data = _LOWER[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]] if held and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:-1]
    found = [(at, *_words(data[at:end], begins[at:end])) for at, end in _pieces(data, begins)]
    starts = np.concatenate([np.zeros(0, np.int64), *(at + s for at, s, _ in found)])
    words = np.concatenate([np.zeros(0, np.uint64), *(h for *_, h in found)])
    first = np.searchsorted(starts, offsets)
    joined = _joined(words, SHINGLE)
    for lo, hi in zip(first.tolist(), first[1:].tolist(), strict=False):
        own = joined[lo : hi - SHINGLE + 1] if hi - lo >= SHINGLE else _joined(words[lo:hi], hi - lo)
        yield np.unique(own.view(np.int64))


def _joined(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size words."""
    n = max(0, len(words) - size + 1) if size else 0
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = _mixed(h * np.uint64(0x100000001B3) + words[i : i + n])
    return h


def shingle_set(text: str) -> np.ndarray:
    """The shingle hashes of one text."""
    return next(shingle_sets(pa.array([text.encode("utf-8", "surrogatepass")], pa.binary())))
