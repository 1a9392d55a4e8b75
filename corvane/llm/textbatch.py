"""Texts of an Arrow batch as one numpy byte array, with the places and hashes of their words.

Helpers for functions that ``mapInArrow`` calls; everything is sized by one piece of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text comes alone.
PIECE = 1 << 21

#: Bytes that separate words in the pattern [^\x20\x09-\x0D]+
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 128


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices with about ``size`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(piece: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a piece; null becomes empty."""
    return [x or "" for x in piece.column(column).to_pylist()]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in UTF-8 with a blank before, between and after them, and where each begins (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8), starts + 1


def joined_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``joined`` for a column of strings, straight from its buffer; null counts as empty."""
    n = len(column)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.ones(n + 1, np.int64)
    begins[1:] += np.cumsum(sizes + 1)
    out = np.full(int(begins[-1]), 0x20, np.uint8)
    _, offsets, raw = column.buffers()
    if raw is not None and n:
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        source, at = np.frombuffer(raw, np.uint8), np.frombuffer(offsets, kind)[column.offset : column.offset + n].tolist()
        for a, b, size in zip(at, begins.tolist(), sizes.tolist(), strict=False):
            out[b : b + size] = source[a : a + size]
    return out, begins


def word_edges(data: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are not blank; ``data`` begins and ends with a blank."""
    inside = ~blank[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return turns[0::2], turns[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lanes:
    """Up to eight bytes of an array from any place on, as one integer, the first byte lowest."""

    def __init__(self, data: np.ndarray):
        self.view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)

    def take(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        lane = self.view[at].view("<u8").reshape(-1)
        bits = np.minimum(size, 7).astype(np.uint64) * np.uint64(8)
        return np.where(size < 8, lane & ((np.uint64(1) << bits) - np.uint64(1)), lane)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair.

    Eight bytes at a time are added to the hash, which is scrambled after each; so different spans
    of one length and up to eight bytes never share a hash, and longer ones have no linear relation
    that texts could be built on. Spans of more than LONG_SPAN bytes get eight bytes of BLAKE2b.
    """
    size = ends - starts
    lanes = Lanes(data)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = mix(out + lanes.take(starts, size))
    live, done = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(live):
        left = size[live] - done
        out[live] = mix(out[live] + lanes.take(starts[live] + done, left))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes, from those of ever longer runs."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, span = mix(words + np.uint64(k)), 1
    while span < k:
        step = min(span, k - span)  # the last two runs may overlap; together they hold all words
        out = mix(out[:-step] * np.uint64(3) + out[step:])
        span += step
    return out
