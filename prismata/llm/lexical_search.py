"""Ranked lexical search of many items at once, with shared work.

Items are queries against all documents. What several items have in common is computed once:

* An item is a bag of terms. Terms (and their repeats) that occur in just the same items form an atom.
* Shared sets of atoms are mined by merging: the pair of nodes that most items hold together becomes a node of its own,
  round by round, until no pair is shared. This gives a graph in which every item is the union of a few nodes.
* One pass over the texts stores each document's frequencies of the items' terms, and the corpus counts come from
  that table. A second pass stores each document's partial score per atom, its accumulators. The last pass adds them up
  along the graph, for blocks of documents and all nodes of a level together, and keeps the best of each item.

The items are taken in blocks of about BLOCK terms, so that what a task holds (vocabulary, graph, best documents) is
bounded whatever the number of items. A task gives ``top`` documents per item at most, and these few meet in one
ranking per item.

Defined results: a null or empty text has no terms and is never found; rows that repeat a doc_id are documents of their
own; rows without a doc_id rank after equal scores with one (2 ** 63 - 1 counts as none); items of equal id and text
are one item, and items of equal id but unlike texts are ranked each for itself; an item without terms, or without a
document that has one, has no rows; an empty table of either kind gives an empty table; other columns are not read.

Terms are compared by a 64-bit hash of their bytes: with V terms of items and W different words in the documents a false
match is expected V * W / 1.8e19 times.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismata.llm import text as tx
from prismata.plans.shared import materialize

TOP, BLOCK, CELLS = 20, 1 << 18, 1 << 21
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_FOLD = np.array([32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
NONE = 2**63 - 1
GRAPH = "block int, items array<long>, terms array<string>, atom_sizes array<int>, atom_terms array<int>, levels array<int>, left array<int>, right array<int>, item_sizes array<int>, item_nodes array<int>"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def _words(col: pa.Array) -> tx.Words:
    """Terms of every row: bytes of no term become spaces, so that words are terms."""
    data, offsets = tx._bytes_of(col)
    folded = pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_FOLD[data]))
    return tx.words(folded)


def _pairs(nodes: list[np.ndarray], span: int) -> Counter:
    """Pairs of nodes that two items or more hold together. Of an item with many nodes only neighbours are tried: which
    pairs are merged changes the work, not the scores."""
    keys = []
    for own in nodes:
        if len(own) > 512:
            keys.append(own[:-1] * span + own[1:])
        else:
            a, b = np.triu_indices(len(own), 1)
            keys.append(own[a] * span + own[b])
    found, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Counter(dict(zip(found[n > 1].tolist(), n[n > 1].tolist(), strict=True)))


def share(nodes: list[np.ndarray], n: int) -> tuple[list[int], list[tuple[int, int]], list[np.ndarray]]:
    """Merge what items share. ``nodes`` are each item's node numbers below ``n``. Gives the number of new nodes per level,
    the two parts of every new node (numbers from ``n`` on), and the items' nodes after all merges."""
    levels, merged = [], []
    while pairs := _pairs(nodes, 1 << 31):
        taken, chosen = set(), {}
        for key, _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            a, b = key >> 31, key & ((1 << 31) - 1)
            if a not in taken and b not in taken:
                taken |= {a, b}
                chosen[a] = (b, n + len(merged) + len(chosen))
        merged += [(a, b) for a, (b, _) in chosen.items()]
        levels.append(len(chosen))
        after = []
        for own in nodes:
            have, out = set(own.tolist()), []
            for x in own.tolist():
                partner = chosen.get(x)
                if partner and partner[0] in have:
                    have -= {x, partner[0]}
                    out.append(partner[1])
            after.append(np.array(sorted([*have, *out]), np.int64))
        nodes = after
    return levels, merged, nodes


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sharing graph of one block of items."""
    bags = [Counter(terms_of(t)) for t in pdf["text"]]
    holders: dict[tuple[str, int], list[int]] = defaultdict(list)
    for i, bag in enumerate(bags):
        for term, n in bag.items():
            for copy in range(n):
                holders[term, copy].append(i)
    vocabulary = {t: k for k, t in enumerate(sorted({t for t, _ in holders}))}
    atoms: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for (term, _), who in holders.items():
        atoms[tuple(who)].append(vocabulary[term])
    nodes: list[list[int]] = [[] for _ in bags]
    for k, who in enumerate(atoms):
        for i in who:
            nodes[i].append(k)
    levels, merged, left = share([np.array(x, np.int64) for x in nodes], len(atoms))
    held = [a for a in atoms.values()]
    ids = [NONE if pd.isna(x) else int(x) for x in pdf["item_id"]]
    row = {"block": int(pdf["block"].iloc[0]), "items": ids, "terms": list(vocabulary), "atom_sizes": [len(a) for a in held], "atom_terms": [t for a in held for t in a], "levels": levels, "left": [a for a, _ in merged], "right": [b for _, b in merged], "item_sizes": [len(x) for x in left], "item_nodes": [int(v) for x in left for v in x]}
    return pd.DataFrame([row])


def sharing(items: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per block of items: its vocabulary, atoms, merges by level, and the nodes of each item."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    total = own.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    own = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-total // block) or 1)).cast("int"))
    return materialize(own.groupBy("block").applyInPandas(_graph, GRAPH), "sharing-graph")


class Block:
    """Scores of one block of items over all documents."""

    def __init__(self, graph, docs: DataFrame, top: int) -> None:
        self.graph, self.top = graph, top
        self.counts = materialize(self._frequencies(docs), "term-counts")
        self.n_docs, self.n_terms = (x or 0 for x in self.counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
        found = self.counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # the block's vocabulary at most
        self.weight = np.zeros(len(graph.terms), np.int64)
        for r in found:
            self.weight[r.t] = math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * r.df + 1)))
        self.accumulators = materialize(self._accumulate(), "accumulators")

    def _frequencies(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n, terms, tfs``: a document's terms, and its frequencies of those of the items."""
        known = _words(pa.array(self.graph.terms, pa.large_string())).hash
        order = np.argsort(known)
        known = known[order]
        if len(known) and (known[1:] == known[:-1]).any():
            raise ValueError("two terms of the items have one hash")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tx.slices(batch):
                    w = _words(part.column("text"))
                    at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                    hit = known[at] == w.hash
                    key = (w.row[hit] << 32) | order[at[hit]]
                    key.sort()
                    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                    times, size = np.diff(np.r_[new, len(key)]), np.bincount(key[new] >> 32, minlength=part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.first)), tx.lists((key[new] & 0xFFFFFFFF).astype(np.int32), size, pa.int32()), tx.lists(times.astype(np.int32), size, pa.int32())], names=["doc_id", "n", "terms", "tfs"])

        return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")

    def _accumulate(self) -> DataFrame:
        """``doc_id, atoms, sums``: a document's partial scores."""
        weight, n_docs, n_terms = self.weight, self.n_docs, self.n_terms
        owner = np.repeat(np.arange(len(self.graph.atom_sizes)), self.graph.atom_sizes)
        order = np.argsort(np.array(self.graph.atom_terms, np.int64), kind="stable")
        of_term, n_atoms = owner[order], np.bincount(np.array(self.graph.atom_terms, np.int64), minlength=len(weight))
        first = np.cumsum(n_atoms) - n_atoms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("terms").offsets.to_numpy()))
                m = 100 - 25 + 25 * batch.column("n").to_numpy() * n_docs // max(1, n_terms)
                score = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                # a term with repeats in items stands in several atoms
                n = n_atoms[term]
                atom = of_term[np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                key, score = (np.repeat(row, n) << 32) | atom, np.repeat(score, n)
                order = np.argsort(key, kind="stable")
                key, score = key[order], score[order]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                size = np.bincount(key[new] >> 32, minlength=batch.num_rows)
                sums = np.add.reduceat(score, new) if len(new) else score
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tx.lists((key[new] & 0xFFFFFFFF).astype(np.int32), size, pa.int32()), tx.lists(sums, size, pa.int64())], names=["doc_id", "atoms", "sums"])

        return self.counts.where("size(terms) > 0").mapInArrow(run, "doc_id long, atoms array<int>, sums array<long>")

    def best(self) -> DataFrame:
        """``block, item, item_id, doc_id, score``: every task's best documents of each item."""
        g, top = self.graph, self.top
        block, ids = g.block, np.array(g.items, np.int64)
        n_atoms, n_nodes, n_items = len(g.atom_sizes), len(g.atom_sizes) + len(g.left), len(g.items)
        left, right, nodes, sizes = (np.array(x, np.int64) for x in (g.left, g.right, g.item_nodes, g.item_sizes))
        steps = np.r_[0, np.cumsum(np.array(g.levels, np.int64))]
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        width = max(1, CELLS // max(1, n_nodes, len(nodes)))

        def scores(atom: np.ndarray, row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
            """Items x documents: sums along the graph."""
            held = np.zeros((n_nodes, n), np.int64)
            held[atom, row] = value
            for a, b in zip(steps[:-1], steps[1:], strict=True):
                held[n_atoms + a : n_atoms + b] = held[left[a:b]] + held[right[a:b]]
            out = np.zeros((n_items, n), np.int64)
            out[some] = np.add.reduceat(held[nodes], starts, 0)
            return out

        def cut(item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((doc, -score, item))
            item, doc, score = item[order], doc[order], score[order]
            keep = np.arange(len(item)) - np.searchsorted(item, item) < top
            return item[keep], doc[keep], score[keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.zeros(0, np.int64)
            found = (none, none, none)
            least, last = np.ones(n_items, np.int64), np.full(n_items, NONE)  # score and doc_id to beat
            for batch in batches:
                doc = batch.column("doc_id").fill_null(NONE).to_numpy()
                offs = batch.column("atoms").offsets.to_numpy() - batch.column("atoms").offsets[0].as_py()
                atom, value = batch.column("atoms").flatten().to_numpy(), batch.column("sums").flatten().to_numpy()
                for at in range(0, len(doc), width):
                    to = min(len(doc), at + width)
                    row = np.repeat(np.arange(to - at), np.diff(offs[at : to + 1]))
                    got = scores(atom[offs[at] : offs[to]], row, value[offs[at] : offs[to]], to - at)
                    near = (got > least[:, None]) | ((got == least[:, None]) & (doc[at:to] <= last[:, None]))
                    item, k = np.nonzero(near)
                    if len(item):
                        found = cut(*(np.concatenate(x) for x in zip(found, (item, doc[at + k], got[item, k]), strict=True)))
                        count = np.bincount(found[0], minlength=n_items)
                        full = np.flatnonzero(count >= top)
                        end = np.cumsum(count)[full] - 1
                        least[full], last[full] = found[2][end], found[1][end]
            item, doc, score = found
            lost = lambda x: pa.array(x, pa.int64(), mask=x == NONE)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), block), pa.int32()), pa.array(item, pa.int32()), lost(ids[item]), lost(doc), pa.array(score)], names=["block", "item", "item_id", "doc_id", "score"])

        return self.accumulators.mapInArrow(run, "block int, item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_text: str = "text", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item with a score above 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    graphs = sharing(items, item_text, block).where("size(terms) > 0")
    blocks = [r.block for r in graphs.select("block").collect()]
    parts = [Block(graphs.where(F.col("block") == b).first(), docs, top).best() for b in sorted(blocks)]  # a block is a bounded set of items
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
