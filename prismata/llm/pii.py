"""Personal data: patterns, and terms of the corpus that give protected entities away.

Patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers in every whole text.

Each distinct match is a protected entity, whatever its spelling: e-mail addresses are compared without case, IP
addresses by the numbers of their parts, card and phone numbers by their digits. Terms are folded words (no
punctuation, no case) outside all matches. A term reveals an entity when knowing the term leaves little of the
entity's information: with document frequencies over all distinct texts, PMI(entity, term) = log2(p(entity, term) /
(p(entity) p(term))) is compared with IC(entity) = -log2 p(entity), which it reaches when the term never occurs
without the entity. A term anywhere in ``support`` texts of an entity, or in every text of an entity that has fewer,
whose PMI is at least ``share`` of the entity's IC and that stands with the entity in more than half of its texts,
exceeds the disclosure threshold; its occurrences become spans of kind ``term``, and ``sanitise`` generalises patterns
to their kind and removes such terms. So in a text with an entity of its own, the words that stand in no other text are
terms: they point at that text as surely as the entity. An entity of every text has no information to give away.

Counting is exact and over all documents: entities of the same texts share all counts and are counted as one class; a
term whose count in texts with entities already rules it out is dropped before classes and terms are paired; the
second pass counts the other candidates in every text (a bitmap lets few other words reach the exact join).

Defined results: a null or empty text has no spans; rows without a doc_id are treated like others; texts of the same
folded words count once in all frequencies; a row is known by its doc_id and its text, so rows that repeat a doc_id each
get their own result and rows that repeat both get the same; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.llm import text as tx
from prismata.llm.bitmap import bitmap, passes
from prismata.plans.shared import materialize

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, SHARE = 3, 0.9
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where a run of digits does
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the local part reaches back from each @, so long runs cost one look."""
    out, upto, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        upto = m.end() if m else at + 1
        at = text.find("@", max(upto, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m.group())) <= 15]
    return sorted(out)


def normal(kind: int, match: str) -> str:
    """The entity that a match spells."""
    if kind == 0:
        return f"{KINDS[kind]}:{match.lower()}"
    return f"{KINDS[kind]}:" + (".".join(p.lstrip("0") or "0" for p in match.split(".")) if kind == 1 else _DIGITS.sub("", match))


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_HASHES = pa.list_(pa.int64())


def _points(w: tx.Words) -> np.ndarray:
    """Code points before each byte offset."""
    out = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=out[1:])
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tx.slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = [base_spans(t) for t in texts]
            entities: list[np.ndarray | list] = [[] for _ in texts]
            terms: list[np.ndarray | list] = [[] for _ in texts]
            w = tx.words(part.column("text"), fold=True)
            keys, _ = tx.sequence_key(w)
            point = _points(w) if any(found) else None
            for i, spans in enumerate(found):
                if not spans:
                    continue
                a, b = w.first[i], w.first[i + 1]
                base = point[w.offsets[i]]
                starts, ends, hashes = point[w.start[a:b]] - base, point[w.end[a:b]] - base, w.hash[a:b]
                covered = np.zeros(b - a, bool)
                for s, _, e in spans:
                    covered[int(np.searchsorted(ends, s, "right")) : int(np.searchsorted(starts, e, "left"))] = True
                values = {normal(k, texts[i][s:e]) for s, k, e in spans}
                entities[i] = sorted(int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "big", signed=True) for v in values)
                terms[i] = tx.signed(np.unique(hashes[~covered & (hashes != 0)]))
            counts = [np.bincount([k for _, k, _ in f], minlength=4) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row"),
                    pa.array(tx.signed(keys)),
                    *[pa.array([int(c[k]) for c in counts], pa.int64()) for k in range(4)],
                    pa.array([hashlib.sha256(_spell(f).encode()).hexdigest() for f in found]),
                    pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in f] for f in found], _SPANS),
                    pa.array(entities, _HASHES),
                    pa.array(terms, _HASHES),
                ],
                names=["doc_id", "row", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "terms"],
            )


def _occurrences(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                w = tx.words(part.column("text"), fold=True)
                at = np.flatnonzero(passes(bits, w.hash) & (w.hash != 0))
                if not len(at):
                    continue
                point = _points(w)
                base = point[w.offsets[w.row[at]]]
                k1, _ = tx.sequence_key(w)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(w.row[at])), part.column("row").take(pa.array(w.row[at])), pa.array(tx.signed(k1[w.row[at]])), pa.array(tx.signed(w.hash[at])), pa.array((point[w.start[at]] - base).astype(np.int32)), pa.array((point[w.end[at]] - base).astype(np.int32))],
                    names=["doc_id", "row", "key", "term", "start", "end"],
                )

    return run


def disclosing_terms(found: DataFrame, texts: DataFrame, support: int = SUPPORT, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """``(term)`` above the disclosure threshold, and every candidate's occurrences ``(doc_id, row, key, term, start,
    end)``."""
    held = found.where("size(entities) > 0")
    terms = held.select("key", F.explode("terms").alias("term")).distinct()
    entities = held.select("key", F.explode("entities").alias("entity")).distinct()
    total = float(max(found.select("key").distinct().count(), 1))
    sets = entities.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "key")).alias("y"))
    sets = sets.where(F.col("n_entity") < total).select("entity", "n_entity", F.xxhash64("n_entity", "x", "y").alias("class"))
    classes = materialize(entities.join(sets, "entity").select("key", "class", "n_entity").distinct(), "pii-classes")
    # p(entity | term) is at most together / beside; PMI >= share * IC says it is at least p(entity) ** (1 - share)
    bar = F.pow(F.col("n_entity") / F.lit(total), F.lit(1 - share))
    room = classes.groupBy("key").agg(F.max(F.least(F.col("n_entity") / bar, 2.0 * F.col("n_entity"))).alias("room"))
    beside = terms.groupBy("term").agg(F.count("*").alias("beside"))
    rare = terms.join(beside.where(F.col("beside") <= F.lit(room.agg(F.max("room")).first()[0] or 0.0)), "term").join(room, "key").where("beside <= room").select("key", "term", "beside")
    together = rare.join(classes, "key").groupBy("class", "term").agg(F.count("*").alias("together"), F.first("n_entity").alias("n_entity"), F.first("beside").alias("beside"))
    together = together.where((F.col("together") >= F.least(F.lit(support), "n_entity")) & (F.col("together") / F.col("beside") >= bar) & (2 * F.col("together") > F.col("beside")))
    pairs = materialize(together.select("term", "together", "n_entity").distinct(), "pii-pairs")
    where = materialize(texts.mapInArrow(_occurrences(bitmap(pairs, "term")), "doc_id long, row long, key long, term long, start int, end int").join(pairs.select("term").distinct(), "term", "left_semi"), "pii-occurrences")
    frequency = where.select("key", "term").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    told = pairs.join(frequency, "term").where((F.col("together") / F.col("n_term") >= bar) & (2 * F.col("together") > F.col("n_term"))).select("term").distinct()
    return told, where


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """``(doc_id, text, row)``; doc_id and row (a hash of the text) name a row, and rows of equal names are equal."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return df.withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))


def find(docs: DataFrame, text: str = "text", support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """``(doc_id, row, n_email, n_ip, n_card, n_phone, base_sha256, base, spans)`` per row; spans are all, sorted."""
    texts = _texts(docs, text)
    span = "array<struct<start: int, kind: int, end: int>>"
    found = materialize(texts.mapInArrow(_find, f"doc_id long, row long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {span}, entities array<long>, terms array<long>"), "pii")
    told, where = disclosing_terms(found, texts, support, share)
    extra = where.join(told, "term", "left_semi").select("doc_id", "row", F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end").alias("s")).groupBy("doc_id", "row").agg(F.collect_set("s").alias("extra"))
    extra = extra.withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    rows = found.join(extra, found["doc_id"].eqNullSafe(F.col("_d")) & (found["row"] == F.col("_r")), "left")
    clear = F.expr("filter(coalesce(extra, array()), x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))")
    return rows.select("doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", F.array_sort(F.concat("base", clear)).alias("spans"))


def spelled(spans: str = "spans"):
    """The spans as ``kind:start:end``, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')")


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``(doc_id, text)``: patterns are generalised to ``[KIND]``, disclosing terms removed."""
    found = find(docs, text, **options).where("size(spans) > 0").select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "spans").dropDuplicates(["_d", "_r"])
    df = _texts(docs, text)
    df = df.join(found, df["doc_id"].eqNullSafe(F.col("_d")) & (df["row"] == F.col("_r")), "left")
    names = ", ".join("''" if k == "term" else f"'[{k.upper()}]'" for k in KINDS)
    cut = f"aggregate(spans, struct(1 AS at, '' AS t), (a, x) -> IF(x.start + 1 < a.at, a, struct(x.end + 1 AS at, concat(a.t, substring(text, a.at, x.start + 1 - a.at), array({names})[x.kind]) AS t)), a -> concat(a.t, substring(text, a.at)))"
    return df.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(cut)).alias("text"))
