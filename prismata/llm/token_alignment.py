"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers split ``space + text`` into tokens that cover its bytes without a gap. Byte offsets where tokens of both
end are cuts; between cuts lie groups of tokens that stand for the same bytes.

* Cuts are found by divide and conquer: the token in the middle of an interval is looked up by bisection among the other
  side's ends; where it is no cut, its neighbours are tried, nearest first, in stretches that double. The interval
  falls into two at the cut, and an interval without one is a leaf group. All intervals of a slice of documents
  take each step together, so a step is a few array operations.
* A link is a pair of token occurrences whose byte ranges overlap. Links are counted per pair of ids: in each document
  first, then over the corpus with map-side sums.
* Every document then looks its pairs up in the corpus counts. The HOT most frequent pairs, a number that does not grow
  with the input, are sent to all tasks and looked up there; all other pairs meet their counts in a join by pair, whose
  keys are rare by that choice, and come back as sums per document.

Defined results: a null or empty text, and one whose joined token bytes differ from ``space + text`` on either side (a
tokenizer that normalises), has no tokens: zeros and an empty ``groups_sha256``. Rows that repeat a doc_id or
have none are documents of their own. An empty table gives an empty table. Other columns are not read.

Documents are encoded by words where that is exact: no token of either side goes past a single space into the next word,
which is checked for the pieces. A text with two spaces in a row, with one at an end, or with the mark that stands for a space, is encoded whole. A worker encodes a word once, as long as its table holds it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.llm import text as tx
from prismata.plans.shared import materialize

FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
HOT = 1 << 20  # pairs that every task holds: 16 bytes each
SLICE = 4 << 20
WORDS = 500_000
SIDE = 1 << 20  # ids are below it, and a slice has fewer documents than 2 ** 23
#: How a byte-level vocabulary cuts a text before merging (fixed by the file's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Side:
    """One tokenizer: ``encode`` gives ids of ``space + unit`` for every unit, ``raw`` the bytes of each id."""

    encode: object
    raw: pa.Array
    size: np.ndarray
    by_word: bool

    @classmethod
    def of(cls, encode, raw: list[bytes], by_word: bool) -> Side:
        return cls(encode, pa.array(raw, pa.large_binary()), np.array([len(x) for x in raw], np.int64), by_word)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the others in
    order for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + n)] = b
    return out


@lru_cache(maxsize=4)
def byte_side(path: str) -> Side:
    """A byte-level BPE from its JSON file. Ids of such a file are in order of merging, so they serve as ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    letters, special = _byte_letters(), {x["content"] for x in held["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): n for token, n in held["model"]["vocab"].items() if token not in special}
    raw = [b""] * (max(held["model"]["vocab"].values()) + 1)
    for token, n in ranks.items():
        raw[n] = token
    encoder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    # PATTERN starts a new stretch at every single space, whatever stands before it
    return Side.of(lambda units: [encoder.encode_ordinary(" " + u) for u in units], raw, True)


@lru_cache(maxsize=4)
def piece_side(path: str) -> Side:
    """A SentencePiece model, which puts the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def raw(n: int) -> bytes:
        piece = model.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(n) else b"" if model.is_control(n) else piece.replace("▁", " ").encode()

    pieces = [raw(n) for n in range(model.get_piece_size())]
    # merging never goes past a space where no piece has one after another character
    return Side.of(lambda units: model.encode(units, num_threads=1), pieces, not any(re.search(rb"[^ ] ", x) for x in pieces))


class Pair:
    """Two tokenizers and the ids of words met so far, for one worker. The table is emptied when it holds WORDS words."""

    def __init__(self, a: Side, b: Side) -> None:
        self.sides, self.by_word = (a, b), a.by_word and b.by_word
        self.empty()

    def empty(self) -> None:
        none = np.zeros(0, np.int32)
        self.where: dict[str, int] = {}
        self.flat, self.size = [none, none], [none, none]

    def _look(self, units: list[str]) -> np.ndarray:
        """Place of each of the distinct units in the table."""
        new = [u for u in units if u not in self.where]
        if new and len(self.where) + len(new) > WORDS:
            self.empty()
            new = units
        if new:
            self.where.update(zip(new, range(len(self.where), len(self.where) + len(new)), strict=True))
            for k, side in enumerate(self.sides):
                ids = side.encode(new)
                size = np.fromiter(map(len, ids), np.int32, len(ids))
                self.size[k] = np.concatenate([self.size[k], size])
                self.flat[k] = np.concatenate([self.flat[k], np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        return np.fromiter(map(self.where.__getitem__, units), np.int32, len(units))

    def encode(self, col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either side the ids of ``space + text`` of all texts in a row, and the number of each text's tokens."""
        units, n_units = _units(col, self.by_word)
        coded = units.dictionary_encode()
        code = self._look(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        out = []
        for flat, size in zip(self.flat, self.size, strict=True):
            start, n = (np.cumsum(size, dtype=np.int32) - size)[code], size[code]
            place = np.repeat(start - (np.cumsum(n, dtype=np.int32) - n), n)
            place += np.arange(len(place), dtype=np.int32)
            out.append((flat[place], np.add.reduceat(n, np.cumsum(n_units) - n_units, dtype=np.int64) if len(n_units) else n_units))
        return out


def _units(col: pa.Array, by_word: bool) -> tuple[pa.Array, np.ndarray]:
    """The strings to encode, in document order, and how many each document has."""
    if not by_word:
        return col, np.ones(len(col), np.int64)
    # a unit past the first begins at a single space; pieces write a space as U+2581
    whole = pc.match_substring_regex(col, "^ |  | $|▁")
    if not pc.any(whole).as_py():
        words = pc.split_pattern(col, " ")
        return words.flatten(), np.diff(words.offsets.to_numpy())
    parts, counts = [], []
    for text, one in zip(col.to_pylist(), whole.to_pylist(), strict=True):
        own = [text] if one else text.split(" ")
        parts += own
        counts.append(len(own))
    return pa.array(parts, col.type), np.array(counts, np.int64)


def cuts(ga: np.ndarray, gb: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups ``(a0, a1, b0, b1)`` in order: tokens ``a0`` to ``a1 - 1`` of one side and ``b0`` to ``b1 - 1`` of the other.
    ``ga`` and ``gb`` are all ends of a run of documents, ascending, the counts are each document's tokens."""
    to_b = np.zeros(len(ga), np.int32)  # at the last token of a group: where it ends on the other side
    a1, b1 = np.cumsum(count_a, dtype=np.int32), np.cumsum(count_b, dtype=np.int32)
    a0, b0 = a1 - count_a.astype(np.int32), b1 - count_b.astype(np.int32)
    to_b[a1 - 1] = b1
    while len(a0):
        split = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[split], a1[split], b0[split], b1[split]
        middle = (a0 + a1 - 2) >> 1
        at = np.searchsorted(gb, ga[middle]).astype(np.int32)
        hit = gb[at] == ga[middle]
        cut_a, cut_b = middle + 1, at + 1
        todo, reach = np.flatnonzero(~hit), 1
        while len(todo):
            todo = todo[(middle[todo] - reach >= a0[todo]) | (middle[todo] + reach <= a1[todo] - 2)]
            near = np.arange(reach, 2 * reach, dtype=np.int32)
            tried = middle[todo, None] + np.stack([near, -near], 1).ravel()  # nearest first
            fits = (tried >= a0[todo, None]) & (tried <= a1[todo, None] - 2)
            row, k = np.nonzero(fits)
            tried = tried[row, k]
            at = np.searchsorted(gb, ga[tried]).astype(np.int32)
            good = np.flatnonzero(gb[at] == ga[tried])[::-1]  # the nearest is written last
            found = todo[row[good]]
            cut_a[found], cut_b[found], hit[found] = tried[good] + 1, at[good] + 1, True
            todo = todo[~hit[todo]]
            reach *= 2
        a0, a1, b0, b1, cut_a, cut_b = (x[hit] for x in (a0, a1, b0, b1, cut_a, cut_b))
        to_b[cut_a - 1] = cut_b
        a0, a1 = np.stack([a0, cut_a], 1).ravel(), np.stack([cut_a, a1], 1).ravel()
        b0, b1 = np.stack([b0, cut_b], 1).ravel(), np.stack([cut_b, b1], 1).ravel()
    a1 = np.flatnonzero(to_b) + 1
    b1 = to_b[a1 - 1].astype(np.int64)
    return np.r_[0, a1[:-1]][: len(a1)], a1, np.r_[0, b1[:-1]][: len(b1)], b1


@lru_cache(maxsize=4)
def _decimals(n: int) -> pa.Array:
    """``id`` and a separator for every id below ``n``: comma, bar and semicolon, one after the other."""
    return pa.array([f"{i}{c}" for c in ",|;" for i in range(n)], pa.large_string())


def _spelled(ids_a: np.ndarray, ids_b: np.ndarray, leaf: tuple[np.ndarray, ...], first: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups; ``first``: the index of each document's first group, and the number of groups."""
    a0, a1, b0, b1 = leaf
    n = int(max(ids_a.max(initial=0), ids_b.max(initial=0))) + 1
    sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    sign_a[a1 - 1], sign_b[b1 - 1] = n, 2 * n
    both = np.empty(len(ids_a) + len(ids_b), np.int64)
    # before a token stand all tokens of earlier groups, of both sides, and in its own group side a first
    both[np.arange(len(ids_a)) + np.repeat(b0, a1 - a0)] = ids_a + sign_a
    both[np.arange(len(ids_b)) + np.repeat(a1, b1 - b0)] = ids_b + sign_b
    text = _decimals(n).take(pa.array(both))
    offs = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
    data = memoryview(text.buffers()[2]) if len(text) else memoryview(b"")
    token = np.r_[a0 + b0, len(both)][first]
    return [hashlib.sha256(data[offs[i] : offs[j] - 1]).hexdigest() for i, j in zip(token[:-1], token[1:], strict=True)]


def _same(raw: pa.Array, ids: np.ndarray, count: np.ndarray, size: np.ndarray, wanted: bytes, offs: np.ndarray) -> np.ndarray:
    """Which documents' joined token bytes are the wanted ones."""
    got = raw.take(pa.array(ids))
    data = np.frombuffer(got.buffers()[2], np.uint8) if len(ids) else np.zeros(0, np.uint8)
    ends = np.r_[0, np.cumsum(size[ids])][np.r_[0, np.cumsum(count)]]
    view = np.frombuffer(wanted, np.uint8)
    return np.array([np.array_equal(data[ends[i] : ends[i + 1]], view[offs[i] : offs[i + 1]]) for i in range(len(count))], bool)


def align(pair: Pair, col: pa.Array) -> dict:
    """Groups and links of a slice of texts: ``n_a, n_b, n_groups, n_links, sha`` per text, and per text the distinct
    pairs ``a * SIDE + b`` with their links as ``pairs, times`` and ``n_pairs``."""
    a, b = pair.sides
    filled = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(filled)
    some = np.flatnonzero(pc.greater(pc.binary_length(filled), 0).to_numpy(zero_copy_only=False))
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")} | {"sha": np.full(n, "", object)}
    texts = filled.take(pa.array(some))
    (ids_a, count_a), (ids_b, count_b) = pair.encode(texts)
    wanted = [b" " + t.encode() for t in texts.to_pylist()]
    offs = np.r_[0, np.cumsum([len(w) for w in wanted], dtype=np.int64)]
    wanted = b"".join(wanted)
    good = _same(a.raw, ids_a, count_a, a.size, wanted, offs) & _same(b.raw, ids_b, count_b, b.size, wanted, offs)
    if not good.all():
        ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
        some, count_a, count_b = some[good], count_a[good], count_b[good]
    ga, gb = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
    groups = cuts(ga, gb, count_a, count_b)
    end_a = np.cumsum(count_a)
    first = np.searchsorted(groups[0], np.r_[0, end_a])
    # each overlap ends at a byte where a token of either side ends, and every such byte ends one
    length = int(ga[-1]) + 1 if len(ga) else 0
    of_a, of_b = np.zeros(length, bool), np.zeros(length, bool)
    of_a[ga], of_b[gb] = True, True
    ends = np.flatnonzero(of_a | of_b)
    of_a, of_b = of_a[ends], of_b[ends]
    n_links = np.diff(np.searchsorted(ends, np.r_[0, ga[end_a - 1]] if len(some) else [0], "right"))
    key = ids_a[np.cumsum(of_a) - of_a] * np.int64(SIDE) + ids_b[np.cumsum(of_b) - of_b]
    key += np.repeat(np.arange(len(some), dtype=np.int64) << 40, n_links)
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    out["n_a"][some], out["n_b"][some], out["n_groups"][some], out["n_links"][some] = count_a, count_b, np.diff(first), n_links
    out["n_pairs"][some] = np.bincount(key[new] >> 40, minlength=len(some))
    out["sha"][some] = _spelled(ids_a, ids_b, groups, first)
    return out | {"pairs": key[new] & ((1 << 40) - 1), "times": np.diff(np.r_[new, len(key)])}


@lru_cache(maxsize=2)
def _pair(folder: str, file_a: str, file_b: str) -> Pair:
    """One per worker process."""
    return Pair(byte_side(f"{folder}/{file_a}"), piece_side(f"{folder}/{file_b}"))


def _plain(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


class Alignment:
    """Both tokenizers over all ``docs``, aligned. ``folder`` holds the two files on every executor."""

    SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"

    def __init__(self, docs: DataFrame, text: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B, hot: int = HOT) -> None:
        self.files, self.hot, self.docs = (folder, file_a, file_b), hot, _plain(docs, text)
        files = self.files

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tx.slices(batch, limit=SLICE):
                    x = align(_pair(*files), part.column("text"))
                    cols = [part.column("doc_id"), *[pa.array(x[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(x["sha"], pa.string()), tx.lists(x["pairs"], x["n_pairs"], pa.int64()), tx.lists(x["times"].astype(np.int32), x["n_pairs"], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        # a row's number is made once and stored with it
        self.rows = materialize(self.docs.mapInArrow(run, self.SCHEMA).withColumn("_id", F.monotonically_increasing_id()), "token-pairs")
        self.each = self.rows.select("_id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        self.counts = self._count()

    def _count(self) -> DataFrame:
        """``(pair, n, best)``: links of a pair of ids in all documents, and whether its B id has none more frequent."""
        counted = materialize(self.each.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(SIDE - 1)), "pair-counts")
        # an id meets as many ids as the other vocabulary has at most
        top = counted.groupBy("b").agg(F.max("n").alias("most"))
        return materialize(counted.join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-bests")

    def pairs(self) -> DataFrame:
        """``(a, b, n, best)``: how often two ids stand for common bytes in the corpus."""
        return self.counts.select(F.shiftright("pair", 20).cast("int").alias("a"), F.col("pair").bitwiseAND(SIDE - 1).cast("int").alias("b"), "n", "best")

    def _looked_up(self) -> DataFrame:
        """Every document's pairs with their counts; the pairs of the highest powers of two, up to ``hot`` of them, by
        broadcast."""
        power = F.floor(F.log2("n")).cast("int")
        least, held = 0, 0
        for p, n in sorted(((r["p"], r["k"]) for r in self.counts.groupBy(power.alias("p")).agg(F.count("*").alias("k")).collect()), reverse=True):  # 63 at most
            held += n
            if held > self.hot:
                least = p + 1
                break
        frequent = self.counts.where(power >= least)
        found = self.each.join(F.broadcast(frequent), "pair")
        if least:
            rest = self.each.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
            found = found.unionByName(rest.join(self.counts.where(power < least), "pair"))
        return found

    def documents(self) -> DataFrame:
        """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``."""
        sums = self._looked_up().groupBy("_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = self.rows.drop("pairs", "times").join(sums, "_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

    def groups(self) -> DataFrame:
        """``doc_id, groups`` for every row of ``docs``: an array of ``(start, end, a, b)``, byte offsets in ``space +
        text`` and the ids of either side."""
        files = self.files

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in tx.slices(batch):
                    found = [_listed(_pair(*files), t) for t in part.column("text").to_pylist()]
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "groups"])

        return self.docs.mapInArrow(run, "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def _listed(pair: Pair, text: str | None) -> list[dict]:
    if not text or not align(pair, pa.array([text]))["n_a"][0]:
        return []
    (ids_a, count_a), (ids_b, count_b) = pair.encode(pa.array([text], pa.large_string()))
    ga, gb = (np.cumsum(side.size[ids]) for side, ids in zip(pair.sides, (ids_a, ids_b), strict=True))
    start, out = 0, []
    for a0, a1, b0, b1 in zip(*cuts(ga, gb, count_a, count_b), strict=True):
        out.append({"start": start, "end": int(ga[a1 - 1]), "a": ids_a[a0:a1].tolist(), "b": ids_b[b0:b1].tolist()})
        start = int(ga[a1 - 1])
    return out
