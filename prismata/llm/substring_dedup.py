"""Substring dedup by level-wise doubling.

Goal: every word covered by a 50-word window whose word sequence also starts in a document with a smaller doc_id goes.

Window lengths double up to the goal: 13, 25, 50. A level looks only at windows that hold a window which was found
repeated one level below, and asks which of them are repeated; when none is, the run ends there.

* At the levels below the last, one window per stretch is enough: of the windows inside any goal-length window, those
  with the least hash are taken (winnowing), so equal goal windows always share a taken one. The first level's taken
  windows are about one in twenty positions.
* At the last level every candidate window is looked up: the smallest doc_id that holds it decides.

Documents with the same words as one with a smaller doc_id need no windows: all their words go (from 50 words on).
Counts of repeats are map-side combined minima and maxima per hash; a hash is looked up again by a join that
broadcasts the few hot hashes, so a passage in a third of all documents does not meet in one task.

Defined results: a null or empty text has no words, nothing removed, and the SHA-256 of the empty string; windows of a
row whose doc_id is null are never removed and remove nothing; rows that repeat a doc_id are not smaller than each
other, and each text gets its own row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.llm import text as tx
from prismata.plans.hot import join_hot
from prismata.plans.shared import materialize

WINDOW = 50
KEY = ["doc_id", "k1", "k2"]


def levels(window: int = WINDOW, least: int = 13) -> list[int]:
    """Lengths that double (rounded up) to ``window``, from at least ``least`` on."""
    out = [window]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _windows(w: tx.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of every k-word window."""
    g = tx.grams(w.hash, k)
    at = np.flatnonzero(tx.inside(w.row, k))
    return g[at], at, w.row[at]


def _listed(values: list[np.ndarray], row: np.ndarray, n: int, kinds: list[pa.DataType]) -> list[pa.Array]:
    counts = np.bincount(row, minlength=n)
    return [tx.lists(v, counts, kind) for v, kind in zip(values, kinds, strict=True)]


def _first_level(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                w = tx.words(part.column("text"))
                k1, k2 = tx.sequence_key(w)
                h, _, row = _windows(w, k)
                long = np.diff(w.first)[row] >= window if len(row) else np.zeros(0, bool)
                h, row = h[long], row[long]
                pick = tx.winnow(h, row, window - k + 1)
                h, row = h[pick], row[pick]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
                sums = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in part.column("text").to_pylist()]
                (taken,) = _listed([tx.signed(h[new])], row[new], part.num_rows, [pa.int64()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tx.signed(k1)), pa.array(tx.signed(k2)), pa.array(np.diff(w.first)), pa.array(sums), taken], names=["doc_id", "k1", "k2", "n_words", "sha", "taken"])

    return run


def _reached(w: tx.Words, k: int, found: pa.Array, window: int, into: int) -> np.ndarray:
    """Boolean per word: whether a window of ``into`` words from there may lie in a ``window``-word one that holds a
    found k-word window (``into`` = window: whether it does hold one)."""
    h, at, row = _windows(w, k)
    lens = np.diff(found.offsets.to_numpy())
    f_row, f = np.repeat(np.arange(len(lens)), lens), found.flatten().to_numpy().view(np.uint64)
    pair = np.zeros(len(w.hash) + 1, np.int64)
    if len(f) and len(h):
        order = np.lexsort((f, f_row))
        f_row, f = f_row[order], f[order]
        hit = np.isin(tx.mix(h ^ tx.mix(row.astype(np.uint64))), tx.mix(f ^ tx.mix(f_row.astype(np.uint64))))
        p = at[hit]
        lo = np.maximum(p - (window - k), w.first[row[hit]])
        hi = np.minimum(p + (window - into) if into < window else p, w.first[row[hit] + 1] - 1) + 1
        np.add.at(pair, lo, 1)
        np.add.at(pair, hi, -1)
    return np.cumsum(pair)[:-1] > 0


def _next_level(window: int, k: int, into: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                w = tx.words(part.column("text"))
                near = _reached(w, k, part.column("found"), window, into)
                h, at, row = _windows(w, into)
                if into < window:
                    pick = tx.winnow(h, row, window - into + 1) & near[at]
                else:
                    pick = near[at]
                h, at, row = h[pick], at[pick] - w.first[row[pick]], row[pick]
                taken, places = _listed([tx.signed(h), at.astype(np.int32)], row, part.num_rows, [pa.int64(), pa.int32()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in KEY] + [taken, places], names=[*KEY, "taken", "places"])

    return run


def _remove(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sums, left = [], [], []
            for t, places in zip(batch.column("text"), batch.column("places"), strict=True):
                words = (t.as_py() or "").encode().split()
                keep = np.zeros(len(words) + 1, np.int64)
                p = places.values.to_numpy()
                np.add.at(keep, p, 1)
                np.add.at(keep, p + window, -1)
                keep = np.cumsum(keep)[:-1] == 0
                kept = b" ".join([words[x] for x in np.flatnonzero(keep)])
                removed.append(int((~keep).sum()))
                sums.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in KEY] + [pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(left, pa.string())], names=[*KEY, "n_removed", "kept_sha256", "kept_text"])

    return run


def _owners(each: DataFrame) -> tuple[DataFrame, int]:
    """``(h, lo, n)``: the hashes of two documents or more, their smallest doc_id and number of rows; and all rows of
    these hashes together."""
    owners = materialize(each.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi"), "owners")
    return owners, owners.agg(F.sum("n")).first()[0] or 0


def _repeated(level: DataFrame) -> DataFrame:
    """Per row key the taken hashes that occur in two documents or more."""
    each = level.select(*KEY, F.explode("taken").alias("h"))
    owners, total = _owners(each)
    return join_hot(each, owners.select("h", "n"), "h", total).groupBy(*KEY).agg(F.collect_set("h").alias("found"))


def _removals(docs: DataFrame, text: str, window: int, texts_too: bool) -> DataFrame:
    """``KEY, n_words, n_removed, kept_sha256`` (and ``kept_text`` of rows with something removed) per row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ladder = levels(window)
    first = materialize(docs.mapInArrow(_first_level(window, ladder[0]), "doc_id long, k1 long, k2 long, n_words long, sha string, taken array<long>"), "level-1")
    least = first.where(f"n_words >= {window} AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = join_hot(first, least, ["k1", "k2"], least.agg(F.sum("n")).first()[0] or 0).where("doc_id > least").select(*KEY).distinct()
    level = first.where(f"n_words >= {window} AND doc_id IS NOT NULL").select(*KEY, "taken").join(copies, KEY, "left_anti")
    found = _repeated(level)
    # the texts of the documents that are still in play move once
    play = materialize(found.dropDuplicates(KEY), "found")
    texts = docs.join(play.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_keyed, "doc_id long, k1 long, k2 long, text string")
    texts = materialize(texts.join(play, KEY), "candidates")
    for k, into in zip(ladder, ladder[1:], strict=False):
        texts_now = texts if k == ladder[0] else texts.drop("found").join(play, KEY)
        level = materialize(texts_now.select(*KEY, "text", "found").mapInArrow(_next_level(window, k, into), "doc_id long, k1 long, k2 long, taken array<long>, places array<int>"), f"level-{into}")
        if into < window:
            play = materialize(_repeated(level.select(*KEY, "taken")), "found")
    each = level.select(*KEY, F.explode(F.arrays_zip("taken", "places")).alias("x")).select(*KEY, F.col("x.taken").alias("h"), F.col("x.places").alias("place"))
    owners, total = _owners(each)
    gone = join_hot(each, owners, "h", total).where("doc_id > lo").groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    done = texts.select(*KEY, "text").join(gone, KEY).select(*KEY, "text", "places").mapInArrow(_remove(window, texts_too), "doc_id long, k1 long, k2 long, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(KEY)
    whole = copies.withColumn("whole", F.lit(True))
    out = first.select(*KEY, "n_words", "sha").join(whole, KEY, "left").join(done, KEY, "left")
    return out.select(
        *KEY,
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("whole"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def dedup_substrings(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``."""
    return _removals(docs, text, window, False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove_substrings(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, text, n_removed)`` for every row of ``docs``: texts without what is repeated, their kept words joined
    by one space; a text that loses nothing stays as it is."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = _removals(docs, text, window, True).where("n_removed > 0").select(*KEY, "n_removed", "kept_text").dropDuplicates(KEY)
    rows = plain.mapInArrow(_keyed, "doc_id long, k1 long, k2 long, text string")
    # a row without a doc_id loses nothing, so a plain join keeps it
    return rows.join(cut, KEY, "left").select("doc_id", F.coalesce("kept_text", "text").alias("text"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch):
            k1, k2 = tx.sequence_key(tx.words(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tx.signed(k1)), pa.array(tx.signed(k2)), part.column("text")], names=["doc_id", "k1", "k2", "text"])
