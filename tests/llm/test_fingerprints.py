"""I-Match fingerprints: order and edits against a plain version, likeness on planted copies."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prismata.llm import fingerprints as fp

ROWS = [(5, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "another text"), (1, "Öl und Wasser 🙂🙂🙂"), (9, None), (3, ""), (None, "no id here"), (None, None), (8, "x" * 50_000), (-4, "alpha beta gamma delta"), (2, "b"), (7, "ab")]


def plain_edits(rows):
    """Multiset of (doc_id, n_chars, SHA-256 of the edited text), for rows whose order is fixed by doc_id and text hash."""
    import xxhash

    def h(t):
        v = xxhash.xxh64(t.encode(), seed=42).intdigest()
        return v - (1 << 64) if v >> 63 else v

    line = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -h(r[1])))
    out = []
    for (i, t), (_, n) in zip(line, line[1:] + line[:1], strict=True):
        third = len(t) // 3
        new = t[: len(t) - third] + n[:third]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("cells", [1, 4, 40])
def test_edited_texts_equal_plain_version(spark, monkeypatch, cells):
    monkeypatch.setattr(fp, "CELLS_PER_PARTITION", cells)
    for rows in (ROWS, ROWS[:1], [(3, f"t {n}") for n in range(60)] + [(n, "u") for n in range(20)], [(None, "a"), (None, "bcdef")]):
        df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, f string")
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fp.fingerprints(df).collect())
        assert got == plain_edits(rows)


def _corpus(n, rng):
    words = ["w%d" % k for k in range(30_000)]
    often = [1 / (k + 3) for k in range(30_000)]
    return [" ".join(rng.choices(words, often, k=rng.choice([30, 150, 800, 3000]))) for _ in range(n)]


def test_likeness_tells_copies_edits_and_others_apart(spark):
    rng = random.Random(3)
    texts = _corpus(240, rng)
    texts = texts[:120] + texts[118:240]  # two exact copies side by side
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in fp.fingerprints(df).select("doc_id", fp.spelled("f").alias("a"), fp.likeness("f", "f").alias("same"), fp.likeness("f", "g").alias("edited"), fp.likeness("f", "after").alias("next")).collect()}
    assert all(r.same == 1 for r in rows.values())
    by_text = defaultdict(set)
    for i, t in enumerate(texts):
        by_text[t].add(rows[i].a)
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    edited, after = [r.edited for r in rows.values()], [r.next for r in rows.values()]
    assert sum(edited) / len(edited) > 0.25 and sum(after) / len(after) < 0.05
    assert all(r.edited > r.next for i, r in rows.items()) or sum(r.edited > r.next for r in rows.values()) >= 0.98 * len(rows)


def test_fingerprint_equals_plain_version(spark):
    """Subsets, levels and the band by sets in Python, on the hashes that Spark gives."""
    rng = random.Random(5)
    texts = [*_corpus(40, rng), "", None, "zzz only here", "The the THE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r.doc_id: set(r.t) for r in df.withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", fp._terms("text").alias("t")).collect()}
    n, df_of = sum(bool(t) for t in terms.values()), Counter(h for t in terms.values() for h in t)
    import math

    band = {h for h, k in df_of.items() if fp.LEAST_IDF - 1e-9 <= math.log(n / k) <= fp.MOST_IDF + 1e-9}
    found = {r.doc_id: r.f for r in fp.fingerprints(df).collect()}
    for i, own in terms.items():
        level = max(0, int(math.log2(max(1, len(own)) / fp.RATE)) if len(own) >= fp.RATE else 0)
        filled = []
        for at in (level, level + 1):
            kept = [h for h in own & band if (h >> 20) % (1 << at) == 0]
            filled += [bool([h for h in kept if h & (fp.SLOTS - 1) == s]) for s in range(fp.SLOTS)]
        assert found[i].level == level and [v >= 0 for v in found[i].slots] == filled
        assert (found[i].plain is None) == any(filled)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fp.fingerprints(df).count() == fp.near_duplicates_of_next(df).count() == 0


def test_lexicon_is_a_band(spark):
    df = spark.createDataFrame([(n, "everywhere " + ("often " if n % 5 == 0 else "") + ("rare " if n % 20 == 0 else "")) for n in range(100)], "doc_id long, text string")
    assert {r.df for r in fp.lexicon(df).collect()} == {5, 20}
    assert {r.df for r in fp.lexicon(df, least_idf=2.0).collect()} == {5}
