"""Vectorised word kernels over Arrow string batches.

A word is a run of bytes outside 0x20 and 0x09-0x0D. All of these are ASCII, so that working on UTF-8 bytes gives
exactly the words of the regular expression ``[^\\x20\\x09-\\x0D]+``. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of a slice of rows: ``data`` bytes, ``start``/``end`` byte offsets and ``row`` of each word, 64-bit
    ``hash`` of each, and ``first``: the index of each row's first word, with the total at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        return self.data[i:j].tobytes()


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``limit`` bytes of text (one row at least), which bounds the kernels' memory."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(col: pa.Array, fold: bool = False) -> Words:
    """Words of every row. ``fold``: hashes ignore ASCII punctuation and the case of ASCII and Latin-1 letters;
    a word of punctuation alone then hashes to 0."""
    data, offsets = _bytes_of(col)
    n_rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64), offsets)
    space = _SPACE[data]
    solid = ~space
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    if fold:
        folded = _LOWER[data]
        wide = np.zeros(len(data), bool)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[wide] += 32
        keep = ~_PUNCT[data]
        kept = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        return Words(data, start, end, row, _hash(folded[keep], kept[start], kept[end]), first, offsets)
    return Words(data, start, end, row, _hash(data, start, end), first, offsets)


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte stretch, eight bytes at a time; 0 for an empty one."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    mask = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    mask = np.r_[mask, np.uint64(2**64 - 1)]
    with np.errstate(over="ignore"):
        h = mix((eight[start] & mask[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
        at, todo = 8, np.flatnonzero(size > 8)
        while len(todo):
            h[todo] = mix(h[todo] * _ODD + (eight[start[todo] + at] & mask[np.minimum(size[todo] - at, 8)]))
            at += 8
            todo = todo[size[todo] > at]
    h[size == 0] = 0
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (len(h) - k + 1 of them), by doubling; callers drop those across rows."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, have, base = None, 0, h
        size, p = 1, powers(k + 1)
        while True:
            if k & size:
                out, have = (base, size) if out is None else (out[: len(h) - have - size + 1] * p[size] + base[have : len(h) - size + 1], have + size)
            if have == k:
                return mix(out)
            base = base[: len(base) - size] * p[size] + base[size:]
            size *= 2


def inside(row: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-word windows lie in one row."""
    return row[: len(row) - k + 1] == row[k - 1 :] if len(row) >= k else np.zeros(0, bool)


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def winnow(h: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Boolean: which values are the least of some ``w`` consecutive values of their row (ties all count; a row with
    fewer values counts as one window). Equal stretches of w values in any two rows so share a chosen value."""
    if w <= 1 or not len(h):
        return np.ones(len(h), bool)
    begins = np.r_[True, row[1:] != row[:-1]]
    rank = np.cumsum(begins) - 1
    at = np.arange(len(h)) + rank * (w - 1)  # w - 1 unused places after each row
    top = np.uint64(2**64 - 1)
    padded = np.full(at[-1] + w, top, np.uint64)
    padded[at] = np.minimum(h, top - np.uint64(1))
    least = _sliding(padded, w, np.minimum)
    whole = np.zeros(len(h), bool)  # where a window begins
    if len(h) >= w:
        whole[: len(h) - w + 1] = rank[w - 1 :] == rank[: len(h) - w + 1]
    whole |= begins & (np.bincount(rank)[rank] < w)
    chosen = np.zeros(len(least), np.uint64)
    chosen[at[whole]] = least[at[whole]]
    reach = _sliding(np.r_[np.zeros(w - 1, np.uint64), chosen], w, np.maximum)
    return reach[at] == padded[at]


def sequence_key(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's word sequence (0, 0 without words)."""
    n = len(w.first) - 1
    k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    count = np.diff(w.first)
    some = np.flatnonzero(count)
    if len(some):
        pos = np.arange(len(w.hash)) - np.repeat(w.first[some], count[some])
        with np.errstate(over="ignore"):
            for out, base in ((k1, np.uint64(0xD6E8FEB86659FD93)), (k2, np.uint64(0xA0761D6478BD642F))):
                out[some] = mix(np.add.reduceat(mix(w.hash ^ base) * powers(int(count.max()) + 1, base)[pos], w.first[some]) + count[some].astype(np.uint64))
    return k1, k2


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's signed longs."""
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of consecutive stretches of ``values``."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
