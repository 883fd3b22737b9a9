"""The pipeline's stages on the given documents against plain versions: rules and EM, similarity of all pairs, verbatim items,
water-filled targets, gapless shards."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


def _votes(t):
    """Good 1, bad 0, none -1 of the seven rules."""
    w = words(t)
    n, chars = len(w), sum(map(len, w))
    symbols, symbol_runs = len(re.findall(r"[#*$%&|<>]", t)), len(re.findall(r"[#*$%&|<>]+", t))
    lines = [x for x in t.split("\n") if words(x)]
    copies = len(lines) - len(set(lines))
    seen, covered = defaultdict(list), set()
    for i in range(n - 7):
        seen[tuple(w[i : i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {j for i in at for j in range(i, i + 8)}
    again = len(covered)
    stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
    rule = lambda good, bad: 0 if bad else 1 if good else -1
    votes = (
        rule(n >= 50, n < 20), rule(3 * n <= chars <= 7 * n, chars > 9 * n or chars < 2 * n), rule(50 * symbols <= n, 10 * symbols > n), rule(50 * symbol_runs <= n, 10 * symbol_runs > n),
        rule(10 * copies <= len(lines), 2 * copies > len(lines)), rule(10 * again <= n, 100 * again > 30 * n), rule(20 * stutter <= n, 4 * stutter > n),
    )
    return votes, n < 20 or 100 * again > 30 * n


def _posterior(votes):
    """Expectation-maximisation over documents, not over patterns."""
    v = np.array(votes)
    prior, good, bad = 0.8, np.full(7, 0.99), np.full(7, 0.3)

    def e():
        g = np.where(v == 1, good, np.where(v == 0, 1 - good, 1)).prod(1) * prior
        b = np.where(v == 0, bad, np.where(v == 1, 1 - bad, 1)).prod(1) * (1 - prior)
        return g / (g + b)

    for _ in range(40):
        q = e()
        prior = (1 + q.sum()) / (2 + len(q))
        good = np.array([(1 + q[v[:, j] == 1].sum()) / (2 + q[v[:, j] >= 0].sum()) for j in range(7)])
        bad = np.array([(1 + (1 - q)[v[:, j] == 0].sum()) / (2 + (1 - q)[v[:, j] >= 0].sum()) for j in range(7)])
    return e()


def test_quality_rules_equal_plain_rules_and_em(spark, docs, rows):
    told = {i: _votes(r.text or "") for i, r in rows.items()}
    q = dict(zip(told, _posterior([v for v, _ in told.values()]), strict=True))
    want = {i for i, (_, failed) in told.items() if not failed and q[i] >= 0.5}
    out = corpus_pipeline.quality_rules(spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == want and 0 < len(want) < len(rows)
    assert all(not 0.49 < q[i] < 0.51 for i in q)


def test_near_duplicates_equal_all_pairs(spark, docs, rows):
    grams = {}
    for i, r in rows.items():
        w = words(r.text)
        if w:
            grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(grams)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = grams[a], grams[b]
            small, large = sorted((len(x), len(y)))
            if small * 10 >= large * 8 and len(x & y) * 10 >= 8 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = {i for i in rows if find(i) == i}
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == want and len(got) < len(rows)


def test_documents_that_hold_an_item_go(spark, docs, rows):
    """Items of eight words or more that stand in a text word for word (case and punctuation aside)."""
    fold = lambda t: [x for x in (re.sub(r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]", "", w).lower() for w in words(t)) if x]
    items = [fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {i: " " + " ".join(fold(r.text)) + " " for i, r in rows.items()}
    hold = {i for i, t in texts.items() if any(len(x) >= 8 and " " + " ".join(x) + " " in t for x in items)}
    kept = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    assert hold and not hold & kept
    # what goes shares a long run of words with an item
    for i in set(rows) - kept - hold:
        assert any(len({tuple(x[k : k + 6]) for k in range(len(x) - 5)} & {tuple(y[k : k + 6]) for y in [texts[i].split()] for k in range(len(y) - 5)}) for x in items), i


def test_mixed_sources_come_near_their_targets(spark, docs, rows):
    size = Counter()
    for r in rows.values():
        size[r.source] += len(words(r.text))
    names = [*sorted(s for s in size if s is not None), *[s for s in size if s is None]]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    left, open_, target = float(sum(size.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] <= level * weight[s]}
        target |= {s: 3.0 * size[s] for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(3 * size[s] for s in full)
        open_ = open_ - full if full else set()
    out = corpus_pipeline.source_mixing(spark, docs, SF).collect()
    taken, times = Counter(), Counter(r.doc_id for r in out)
    for r in out:
        assert r.text == rows[r.doc_id].text
        taken[r.source] += len(words(r.text))
    assert max(times.values()) <= 3
    longest = max(len(words(r.text)) for r in rows.values())
    for s in names:
        assert abs(taken[s] - target[s]) <= max(0.1 * target[s], 2 * longest), s
    assert sum(taken.values()) == pytest.approx(sum(size.values()), rel=0.1)


def test_shards_are_whole_and_even(spark, docs, rows):
    out = corpus_pipeline.histogram_sharding(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(rows.keys())
    slots, size, of_text = defaultdict(list), Counter(), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        size[r.shard] += len((r.text or "").encode()) + 1
        of_text[r.text].add(r.shard)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / 8, max(len((r.text or "").encode()) + 1 for r in rows.values())
    assert all(abs(b - mean) <= max(0.02 * mean, largest) for b in size.values())
    assert sum(len(s) > 1 for s in of_text.values()) == 0
