"""N-gram Jaccard self-join by MinHash banding.

1. Every text becomes its set of word n-grams (five words; a shorter text is one n-gram of all its words) and a MinHash
   signature cut into bands. ``bands_for`` picks the band count so that a pair at the threshold collides in at least
   one band with probability ``recall``.
2. Texts with the same word sequence are one representative from here on, so copies cost nothing further.
3. Band hashes are shuffled; buckets of one representative and buckets with the same members as another are dropped.
4. Buckets are cut into blocks of about BLOCK members; each pair of blocks meets once, in a task that verifies the
   pairs on their full n-gram sets. A task gives back one row per member: how many documents it is linked to, and the
   smallest member it is connected to. Pairs themselves are never emitted, and a pair counts in one bucket only.
5. Classes are the connected components of those rows.

Defined results: null and empty texts have no n-grams, no links, and are their own class; texts of equal words have
similarity 1; repeated ``doc_id``s count as copies of a document each; rows without a ``doc_id`` take no part and come
back with null class and no links; an empty table gives an empty table; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.llm import text as tx
from prismata.plans.components import connected_components
from prismata.plans.hot import join_hot
from prismata.plans.shared import materialize

NGRAM = 5
THRESHOLD = 0.8
ROWS = 4
BLOCK = 256


def bands_for(threshold: float = THRESHOLD, recall: float = 0.99999, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` values with collision probability ``recall`` at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def ngrams(w: tx.Words, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and the row of each; a row of fewer words has one n-gram of all of them."""
    g = tx.grams(w.hash, n)
    ok = tx.inside(w.row, n)
    h, row = g[ok], w.row[: len(ok)][ok]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        k1, _ = tx.sequence_key(w)
        h, row = np.r_[h, k1[short]], np.r_[row, short]
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def _signatures(n: int, rows: int, bands: int):
    rng = np.random.default_rng(77)
    xor = rng.integers(0, 2**63, rows * bands, dtype=np.uint64)
    odd = rng.integers(0, 2**62, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                w = tx.words(part.column("text"))
                k1, k2 = tx.sequence_key(w)
                h, row = ngrams(w, n)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                some = np.flatnonzero(np.diff(first))
                least = np.zeros((len(some), rows * bands), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(rows * bands):
                        if len(some):
                            least[:, j] = np.minimum.reduceat((h ^ xor[j]) * odd[j], first[some])
                    key = np.zeros((len(some), bands), np.uint64)
                    for r in range(rows):
                        key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows] + np.arange(bands, dtype=np.uint64))
                counts = np.zeros(part.num_rows, np.int64)
                counts[some] = bands
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(tx.signed(k1)), pa.array(tx.signed(k2)), tx.lists(tx.signed(key.ravel()), counts, pa.int64())], names=["doc_id", "k1", "k2", "bands"]
                )

    return run


def _gram_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                w = tx.words(part.column("text"))
                h, row = ngrams(w, n)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(tx.signed(tx.sequence_key(w)[0])), tx.lists(tx.signed(h[new]), np.bincount(row[new], minlength=part.num_rows), pa.int64())], names=["rep", "grams"])

    return run


def _shared_counts(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with all sets, by a product of incidence matrices over
    slabs of the values that occur in two sets or more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    at, owner = place[at[keep]], owner[keep]
    out = np.zeros((left, len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    width = 4096
    for lo in range(0, int((times > 1).sum()), width):
        i, j = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], at[i:j] - lo] = 1
        out += m[:left] @ m.T
    return out


def verify_block(bucket: int, i: int, j: int, side: np.ndarray, reps: np.ndarray, copies: np.ndarray, buckets: list[np.ndarray], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the members of two blocks (or within one): rep, linked documents, smallest connected member."""
    order = np.argsort(side, kind="stable")
    reps, copies, side = reps[order], copies[order], side[order]
    buckets, sets = [buckets[x] for x in order], [sets[x] for x in order]
    n, left = len(reps), int((side == i).sum())
    size = np.array([len(s) for s in sets], np.float64)
    shared = _shared_counts(sets, left)
    a, b = np.nonzero(shared >= threshold * (size[:left, None] + size[None, :] - shared) - 1e-6)
    # exact test on integers, each unordered pair once, and only across the blocks if there are two
    ok = (b >= left) if i != j else (a < b)
    a, b = a[ok], b[ok]
    inter = shared[a, b].astype(np.int64)
    ok = inter * 1000 >= round(threshold * 1000) * (size[a].astype(np.int64) + size[b].astype(np.int64) - inter)
    a, b = a[ok], b[ok]
    links, root = np.zeros(n, np.int64), np.arange(n)
    if len(a):
        width = max(len(x) for x in buckets)
        table = np.full((n, width), np.iinfo(np.int64).max)
        for x, ids in enumerate(buckets):
            table[x, : len(ids)] = ids
        mine = np.zeros(len(a), bool)
        for lo in range(0, len(a), 4096):  # a pair counts in the first bucket that holds both
            p, q = table[a[lo : lo + 4096]], table[b[lo : lo + 4096]]
            both = (p[:, :, None] == q[:, None, :]).any(2) & (p != np.iinfo(np.int64).max)
            mine[lo : lo + 4096] = np.where(both, p, np.iinfo(np.int64).max).min(1) == bucket
        a, b = a[mine], b[mine]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                if reps[x] > reps[y]:
                    x, y = y, x
                root[y] = x
        root = np.array([find(x) for x in range(n)])
    return reps, links, reps[root]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def done() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            _, once = np.unique(t["rep"].to_numpy(), return_index=True)  # rows that repeat a doc_id bring a text again
            if len(once) < 2:
                return
            if len(once) < t.num_rows:
                t = t.take(once).combine_chunks()
            np_of = {c: t[c].to_numpy() for c in ("bucket", "i", "j", "side", "rep", "copies")}
            r = verify_block(int(np_of["bucket"][0]), int(np_of["i"][0]), int(np_of["j"][0]), np_of["side"], np_of["rep"], np_of["copies"], *[[x.values.to_numpy() for x in t[c]] for c in ("buckets",)], [x.values.to_numpy() for x in t["grams"]], threshold)
            some = (r[1] > 0) | (r[2] != r[0])
            out.append(tuple(x[some] for x in r))

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(key)], strict=True):
                now = tuple(key[lo])
                if last is not None and now != last:
                    done()
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = now
            if sum(len(x[0]) for x in out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rep", "links", "root"])
                out = []
        if held:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rep", "links", "root"])

    return run


def jaccard_classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, n: int = NGRAM, recall: float = 0.99999, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, class_id, n_links)`` for every row: class_id is the smallest doc_id of the class, n_links counts the
    other documents whose n-gram sets have similarity ``threshold`` or more with this one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bands = bands_for(threshold, recall, rows)
    sig = materialize(docs.mapInArrow(_signatures(n, rows, bands), "doc_id long, k1 long, k2 long, bands array<long>"), "signatures")
    known = sig.where("doc_id IS NOT NULL AND size(bands) > 0")
    reps = materialize(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "representatives")
    reps = reps.withColumn("rep", F.col("k1"))  # the text itself names the node: a doc_id may stand for several texts
    banded = reps.select(F.explode("bands").alias("bucket"), "rep")
    found = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep") / 4).alias("s"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("n > 1")
    found = found.groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    found = materialize(found, "buckets")
    members = materialize(join_hot(banded, found, "bucket", found.agg(F.sum("n")).first()[0] or 0).select("bucket", "n", "rep"), "members")
    of_rep = members.groupBy("rep").agg(F.collect_list("bucket").alias("buckets"))  # at most one per band
    texts = docs.join(of_rep.join(reps.select("rep", "doc_id"), "rep").select("doc_id"), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_gram_sets(n), "rep long, grams array<long>")
    full = of_rep.join(reps.select("rep", "copies"), "rep").join(sets, "rep")
    cells = members.withColumn("m", F.ceil(F.col("n") / block).cast("int")).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("bucket", "rep", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))
    laid = cells.join(full, "rep").select("bucket", "i", "j", "side", "rep", "copies", "buckets", "grams")
    laid = laid.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    linked = materialize(laid.mapInArrow(_verify(threshold), "rep long, links long, root long"), "links")
    classes = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    named = reps.select("rep", "doc_id").join(classes, "rep").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    per_rep = reps.select("k1", "k2", "rep", "doc_id", "copies").join(linked.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(classes.join(named, "component").select("rep", "class_id"), "rep", "left")
    per_rep = per_rep.select("k1", "k2", F.coalesce("class_id", "doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = sig.select("doc_id", "k1", "k2", (F.col("doc_id").isNotNull() & (F.size("bands") > 0)).alias("in_play")).join(per_rep, ["k1", "k2"], "left")
    return joined.select("doc_id", F.when(F.col("in_play"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("in_play"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, with its own columns. Rows without a doc_id
    stay. Of rows that repeat a doc_id all stay or go together."""
    kept = jaccard_classes(docs, text, **options).where("doc_id = class_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id IS NULL"))
