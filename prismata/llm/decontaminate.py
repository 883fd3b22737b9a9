"""Benchmark decontamination by template canonicalisation.

Words lose punctuation and case; numbers, names and units become typed placeholders whose values are kept as slots. A
number is a word with a digit; a unit is a word of UNITS after a number; a name is a capitalised word inside a
sentence. Windows of eight template tokens of benchmark items and documents meet in a hash join (a bitmap made of the
items' windows lets few document windows reach it). Along one alignment of a document with an item, the slots must
agree: an item's value always stands for the same value of the document, as it does in a verbatim copy and in a
question with other numbers or names, but not where unlike passages share a frame. Where an alignment does not agree, its windows
with the item's own values still count: one edited mention does not clear a copied item. A document is contaminated by
an item when the windows that count are at least ``coverage`` of the item's.

A window counts when at least half of its tokens are literal words. An item of fewer than eight tokens is one window.

Defined results: null and empty texts match nothing; an item without a counting window matches nothing; rows without
a doc_id or item_id match nothing; rows that repeat a doc_id are read as one document; repeated item rows change
nothing; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.llm import text as tx
from prismata.llm.bitmap import bitmap, passes
from prismata.plans.shared import materialize

WINDOW = 8
COVERAGE = 0.5
# fixed values: words that are units after a number
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces "
    "ml cl l liter liters litre litres gallon gallons cup cups second seconds s minute minutes min hour hours h day days week weeks month months year years "
    "cent cents dollar dollars usd euro euros eur percent degree degrees celsius fahrenheit kelvin watt watts kw volt volts joule joules calorie calories kb mb gb tb byte bytes mph kmh"
).split()
NUM, NAME, UNIT = (np.uint64(x) for x in (11, 13, 17))


def template(w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template token, slot value (0 for a literal) and row of every word that is not punctuation alone.
    ``w`` must come from ``words(..., fold=True)``."""
    n = len(w.hash)
    if not n:
        return w.hash, w.hash, w.row
    digits = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data >= 48) & (w.data <= 57), out=digits[1:])
    number = digits[w.end] > digits[w.start]
    b0 = w.data[w.start]
    b1 = w.data[np.minimum(w.start + 1, len(w.data) - 1)]
    capital = ((b0 >= 65) & (b0 <= 90)) | ((b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E) & (b1 != 0x97))
    newline = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 10, out=newline[1:])
    inner = np.zeros(n, bool)
    last = w.data[w.end[:-1] - 1]
    inner[1:] = (w.row[1:] == w.row[:-1]) & ~np.isin(last, np.frombuffer(b".!?:", np.uint8)) & (newline[w.start[1:]] == newline[w.end[:-1]])
    token, slot = w.hash.copy(), np.zeros(n, np.uint64)
    name = capital & inner & ~number
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & (w.row[1:] == w.row[:-1]) & np.isin(w.hash[1:], _units())
    unit &= ~number
    for which, mark in ((name & ~unit, NAME), (unit, UNIT), (number, NUM)):
        slot[which] = w.hash[which]
        token[which] = mark
    keep = w.hash != 0
    return token[keep], slot[keep], w.row[keep]


_UNIT_HASHES: list[np.ndarray] = []


def _units() -> np.ndarray:
    if not _UNIT_HASHES:
        _UNIT_HASHES.append(tx.words(pa.array(UNITS), fold=True).hash)
    return _UNIT_HASHES[0]


def _windows(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place in its row, row, slots (n x k) of the counting k-token windows; tokens per row."""
    w = tx.words(col, fold=True)
    token, slot, row = template(w)
    count = np.bincount(row, minlength=len(col)) if len(row) else np.zeros(len(col), np.int64)
    first = np.cumsum(count) - count
    h = tx.grams(tx.mix(token + np.uint64(k)), k)
    ok = tx.inside(row, k)
    free = np.r_[0, np.cumsum(slot == 0)]
    literal = free[k:] - free[: len(free) - k] if len(free) > k else np.zeros(len(h), np.int64)
    at = np.flatnonzero(ok & (2 * literal[: len(ok)] >= k))
    slots = np.lib.stride_tricks.sliding_window_view(slot, k) if len(slot) >= k else np.zeros((0, k), np.uint64)
    return h[at], at - first[row[at]], row[at], slots[at], count


def _emit(ids: pa.Array, id_name: str, h: np.ndarray, at: np.ndarray, row: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
    names = [id_name, "h", "at", "slots"]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(tx.signed(h)), pa.array(at.astype(np.int32)), tx.lists(tx.signed(np.ascontiguousarray(slots).ravel()), np.full(len(h), slots.shape[1]), pa.int64())], names=names)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                _, _, _, _, count = _windows(part.column("text"), window)
                for k in sorted({min(window, int(c)) for c in count if c}):
                    h, at, row, slots, _ = _windows(part.column("text"), k)
                    mine = np.minimum(count[row], window) == k
                    yield _emit(part.column("item_id"), "item_id", h[mine], at[mine], row[mine], slots[mine]).append_column("k", pa.array(np.full(int(mine.sum()), k, np.int32)))

    return run


def _document_windows(sizes: list[int], bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                for k in sizes:
                    h, at, row, slots, _ = _windows(part.column("text"), k)
                    hit = passes(bits, h)
                    if hit.any():
                        yield _emit(part.column("doc_id"), "doc_id", h[hit], at[hit], row[hit], slots[hit])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, item_id, n_matched, n_windows, reparameterised)`` for each document and item that it contains:
    matched and all counting windows of the item, and whether some slot has another value than in the item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id IS NOT NULL").distinct()
    index = materialize(items.mapInArrow(_item_windows(window), "item_id long, h long, at int, slots array<long>, k int"), "item-windows")
    sizes = sorted(r["k"] for r in index.select("k").distinct().collect())  # at most ``window`` values
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    found = texts.mapInArrow(_document_windows(sizes, bitmap(index)), "doc_id long, h long, at int, slots array<long>")
    hits = found.join(index.select("item_id", "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")), "h")
    aligned = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("places"),
        F.collect_set(F.when(F.col("slots") == F.col("item_slots"), F.col("item_at"))).alias("verbatim"),
        F.array_distinct(F.flatten(F.collect_set(F.expr("filter(arrays_zip(item_slots, slots), x -> x.item_slots <> 0)")))).alias("pairs"),
    )
    agrees = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.item_slots")))
    counted = aligned.withColumns({"agrees": agrees, "places": F.when(agrees, F.col("places")).otherwise(F.col("verbatim"))}).where(F.size("places") > 0)
    total = index.groupBy("item_id").agg(F.count_distinct("at").alias("n_windows"))
    per_item = counted.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_matched"),
        F.max(F.expr("agrees AND exists(pairs, x -> x.item_slots <> x.slots)")).alias("reparameterised"),
    )
    return per_item.join(total, "item_id").where(F.col("n_matched") >= F.ceil(F.col("n_windows") * coverage)).select("doc_id", "item_id", "n_matched", "n_windows", "reparameterised")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id no item contaminates, with its own columns."""
    return docs.join(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti")
