"""Edge rows and brute-force comparisons of the pipeline operators, on one small table."""

import hashlib
import io
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prismata.llm import decontaminate, licenses, line_dedup, mixing, ngram_join, pii, quality, sharding, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, size long, posterior string"


def _rows():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice(["th", "er", "on", "an", "é", "in"]) for _ in range(rnd.randint(1, 4))) for _ in range(200)]
    text = lambda n: "\n".join(" ".join(rnd.choice(vocab) for _ in range(12)) for _ in range(n))
    base = [text(8) for _ in range(12)]
    near = [b.replace(b.split()[3], "zzz", 1) for b in base[:5]]
    joined = [text(2) + "\n" + base[0] + "\n" + text(1)]
    odd = [None, "", " \n\t ", "one", "x" * 50_000, "word " * 3000]
    texts = base + near + base[:3] + joined + odd
    rows = [(i, t, "en", [None, "a", "b"][i % 3], 0, "r", 1, "p") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base[1], None, None, None, None, None, None)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _grams(t):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_ngram_join_equals_brute_force(docs):
    known = [r for r in ROWS if r[0] is not None]
    sets = [(r[0], _grams(r[1])) for r in known]
    linked = {(i, j) for i, (_, a) in enumerate(sets) for j, (_, b) in enumerate(sets) if i != j and a and b and 1000 * len(a & b) >= 800 * len(a | b)}
    want = sorted((sets[i][0], sum(1 for x, _ in linked if x == i)) for i in range(len(sets)))
    got = ngram_join.jaccard_classes(docs).collect()
    assert sorted((r.doc_id, r.n_links) for r in got if r.doc_id is not None) == want
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    classes = {r.doc_id: r.class_id for r in got}
    assert all(classes[sets[i][0]] == classes[sets[j][0]] for i, j in linked)


def test_substrings_equal_brute_force(docs):
    first, want = {}, []
    rows = sorted(((r[0], (r[1] or "").encode().split()) for r in ROWS if r[0] is not None), key=lambda r: r[0])
    for i, w in rows:
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    for i, w in rows:
        gone = set()
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    got = [tuple(r) for r in substring_dedup.dedup_substrings(docs).collect() if r.doc_id is not None]
    assert sorted(got) == sorted(want)


def test_line_distances_equal_levenshtein(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))), "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9)))) for _ in range(300)]
    df = line_dedup.differing(spark.createDataFrame(rows, "x string, y string"))
    got = df.select(F.expr(line_dedup.banded_distance(2)).alias("d"), F.levenshtein("x", "y").alias("e")).collect()
    assert all(r.d == (r.e if r.e <= 2 else None) for r in got)


def _edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x):
        row, last = [i + 1], row
        for j, d in enumerate(y):
            row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_line_pairs_equal_brute_force(spark):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdé ") for _ in range(n)) for n in range(8, 40) for _ in range(2)]
    texts = set(base) | {"The thertion.", "The, thertion."}
    for t in base:
        for n in (1, 2, 3):
            u = t
            for _ in range(n):
                p = rnd.randrange(len(u))
                u = u[:p] + rnd.choice(["", "x", u[p] + "x"]) + u[p + 1 :]
            texts.add(u)
    texts = sorted(t for t in texts if t.strip())
    rows = line_dedup.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    name = {r.l1: r.line for r in rows.collect()}
    got = {(*sorted((name[r.a], name[r.b])), r.distance) for r in line_dedup.near_pairs(rows).collect()}
    want = {(x, y, d) for i, x in enumerate(texts) for y in texts[i + 1 :] if abs(len(x) - len(y)) <= 2 and (d := _edits(x, y)) <= min(2, min(len(x), len(y)) // 12)}
    assert got == want and any(len(x) < 24 for x, _, _ in got) and (*sorted(("The thertion.", "The, thertion.")), 1) in got


def test_line_dedup_edges(docs):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len({r[0] for r in ROWS})
    assert [got[i].n_lines for i in (21, 22, 23, 24, 25, 26)] == [0, 0, 0, 1, 1, 1]
    assert all(got[i].n_removed == got[i].n_lines == 8 for i in (17, 18, 19))  # copies of the first three


def test_quality_counts(docs):
    got = quality.score(docs).select("_row.doc_id", "_row.text", "n_words", "word_chars", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = WORD.findall(r.text or "")
        times = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_mixing(docs):
    m = mixing.Mix(docs)
    got = m.documents().collect()
    assert len(got) == len(ROWS)
    assert all(r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size for r in got)
    assert sorted(map(tuple, mixing.Mix(docs).documents().drop("shards").collect()), key=str) == sorted(map(tuple, m.documents().drop("shards").collect()), key=str)
    assert m.apply(docs).columns == docs.columns


def test_quota_tree_is_exact(spark):
    q = spark.createDataFrame([([5, 0, 17, 300],)], "quota array<long>")
    rows = mixing.split_quotas(q, 3).collect()
    assert [sum(r.quota[i] for r in rows) for i in range(4)] == [5, 0, 17, 300]
    totals = [sum(r.quota) for r in rows]
    assert len(rows) == 8 and max(totals) - min(totals) <= 1


def test_sharding(docs):
    got = sharding.histogram_shards(docs).select("_row.text", "_size", "_crc", "_shard", "_slot").collect()
    assert len(got) == len(ROWS)
    for k in {r["_shard"] for r in got}:
        assert sorted(r["_slot"] for r in got if r["_shard"] == k) == list(range(sum(r["_shard"] == k for r in got)))
    assert sharding.shard_documents(docs).columns == [*docs.columns, "shard", "slot"]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, ROWS[0][1]), (2, "Then John bought 12 apples for 30 dollars and gave 12 away to the poor"), (3, None), (None, "x")], "item_id long, text string")
    extra = spark.createDataFrame(
        [(90, "well so Then Anna bought 15 apples for 44 dollars and gave 15 away to the poor indeed"), (91, "well so Then Anna bought 15 apples for 44 dollars and gave 16 away to the poor indeed")], "doc_id long, text string"
    )
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs.select("doc_id", "text").union(extra), items).collect()}
    assert got[(0, 1)] is False and got[(90, 2)] is True and (91, 2) not in got and (5, 1) not in got
    left = {r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()}
    assert 0 not in left and 5 in left and None in left


def test_licenses(spark, docs):
    t = "Some début.\n" + licenses.TEMPLATES["MIT-notice"] + " More words. " + licenses.TEMPLATES["MIT-notice"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(77, t)], "doc_id long, text string"))
    got = sorted((r.doc_id, r.license_id, t[r.span_start : r.span_end]) for r in licenses.scan(df).collect())
    assert got == [(77, "MIT-notice", "Released under the MIT License.")] * 2


def test_license_versions_and_whole_texts(spark):
    whole = licenses.TEMPLATES
    lines = ["This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-SA 4.0.", "Licensed under the Apache License, Version 7.3."]
    texts = [*lines, whole["BSD-2-Clause"], whole["BSD-3-Clause"], whole["GPL-2.0"], "Words before. " + whole["MIT"][400:] + " " + whole["ISC"]]
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    want = [{"GPL-2.0-notice"}, {"LGPL-3.0-notice"}, {"Apache-1.1-notice"}, {"CC-BY-SA-4.0-short-notice"}, None, {"BSD-2-Clause"}, {"BSD-3-Clause"}, {"GPL-2.0"}]
    assert [got.get(i) for i in range(8)] == want and "ISC" in got[8]


def test_pii(spark):
    t = "mail é a.b@c.de, a@b@c.d.e 300.1.1.1 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 tel +1 (743) 555-3824."
    assert [t[a:b] for a, k, b in pii.base_spans(t)] == ["a.b@c.de", "b@c.d.e", "1.2.3.4", "5.6.7.8", "4111 1111 1111 1111", "+1 (743) 555-3824"]
    rows = [(i, f"text number {'abcdefg'[i]} here zorblatt wrote to x@y.org about things {'hijklmn'[i]}") for i in range(5)] + [(9, "zorblatt is out"), (10, None)]
    df = spark.createDataFrame(rows + [(20 + i, f"here about to wrote things number text {i}") for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df, share=0.5).collect()}
    assert "[EMAIL]" in got[0] and "zorblatt" not in got[0] and "about" in got[0] and got[10] is None


def test_pii_terms_of_rare_entities(spark):
    fill = " ".join(["and so on it went for them"] * 4)
    rows = [(0, f"call +1 (743) 555-3824 {fill} quimby"), (1, f"quimby {fill} has +17435553824 still"), (2, f"write to A@b.com {fill} Only.here"), (3, f"no entity but {fill} lonely"), (3, f"no entity but {fill} lonely")]
    rows += [(10 + i, f"call write to has still {fill} {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "quimby" not in got[0] + got[1] and "here" not in got[2] and "lonely" in got[3]
    assert all(fill in t for t in got.values()) and got[0].startswith("call [PHONE]")
    assert pii.normal(0, "A@b.com") == pii.normal(0, "a@B.com") and pii.normal(1, "010.0.0.01") == pii.normal(1, "10.0.0.1") and pii.normal(2, "4111 1111-11111111") == "card:4111111111111111"
    whole = pii.find(spark.createDataFrame([(1, "alone with a@b.de"), (2, "with a@b.de")], "doc_id long, text string"))
    assert {r.kind for row in whole.collect() for r in row.spans} == {0}


def test_warc_reader_refuses_damage():
    good = warc.record(1, "http://x/", b"a" * 200, None) + warc.record(2, None, b"a" * 200, 1) + warc.record(None, None, b"", None)
    got = list(warc.read_records(io.BytesIO(good)))
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got] == [(1, "response", None, 200), (2, "revisit", 1, 200), (None, "response", None, 0)]
    with pytest.raises(warc.Broken):
        list(warc.read_records(io.BytesIO(good[:-5])))


def test_warc_round_trip(spark):
    rows = [(3, "u", "é" * 100), (1, "u", "é" * 100), (2, None, None), (4, "u", "short"), (5, "u", "short"), (None, "u", "é" * 100)]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (200, "response", None), 3: (200, "revisit", 1), 2: (0, "response", None), 4: (5, "response", None), 5: (5, "response", None), None: (200, "response", None)}


def test_empty_tables(spark, empty):
    assert ngram_join.jaccard_classes(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert quality.keep_good(empty).count() == 0
    assert mixing.Mix(empty).documents().count() == 0
    assert sharding.histogram_shards(empty).count() == 0
    assert decontaminate.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert licenses.scan(empty).count() == 0
    assert pii.find(empty).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
