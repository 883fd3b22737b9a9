"""Ranked lexical search against a plain version."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismata.llm import lexical_search as ls

DOCS = [
    (1, "The cat sat on the mat. The CAT!"),
    (2, "A dog sat; a dog ran-away"),
    (3, None),
    (4, ""),
    (5, "Señor café É é cat 42 42"),
    (None, "the cat sat on the mat the cat"),
    (7, "The cat sat on the mat. The CAT!"),
    (7, "the cat sat on the mat the cat"),
    (8, "word " * 20_000 + "cat"),
    (9, "...  !!"),
]
ITEMS = [(10, "the cat the cat sat"), (11, "dog cat mat"), (12, "zzz nothing"), (13, None), (10, "the cat the cat sat"), (14, "É café 42 cat cat cat"), (None, "the dog sat on the mat"), (15, "the cat sat on the mat again")]


def plain(docs, items, top):
    bags = [(i, Counter(ls.terms_of(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for doc, bag in bags:
            score = 0
            for t, k in Counter(ls.terms_of(text)).items():
                if bag[t]:
                    m = 75 + 25 * sum(bag.values()) * n_docs // total
                    score += k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, n, d, -s) for n, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("top", "block", "cells"), [(20, ls.BLOCK, ls.CELLS), (3, ls.BLOCK, 1), (2, 8, 60)])
def test_ranking_equals_plain_version(spark, monkeypatch, top, block, cells):
    monkeypatch.setattr(ls, "CELLS", cells)
    docs = spark.createDataFrame([(*r, 0) for r in DOCS], "doc_id long, text string, rank int")
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, doc_id int")
    got = sorted(str(tuple(r)) for r in ls.search(docs, items, top, block=block).collect())
    assert got == plain(DOCS, ITEMS, top)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ls.search(docs.limit(0), items).count() == 0
    assert ls.search(docs, items.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12)), max_size=8))
def test_shared_nodes_make_up_every_item(sets):
    levels, merged, left = ls.share([np.array(sorted(s), np.int64) for s in sets], 13)
    parts = {k: {k} for k in range(13)}
    for n, (a, b) in enumerate(merged, 13):
        assert not parts[a] & parts[b]
        parts[n] = parts[a] | parts[b]
    assert sum(levels) == len(merged)
    for s, own in zip(sets, left, strict=True):
        assert sorted(x for k in own.tolist() for x in parts[k]) == sorted(s)
    assert not ls._pairs(left, 1 << 31)


def test_levels_use_earlier_levels_only():
    base = list(range(8))
    levels, merged, _ = ls.share([np.array(base)] * 3, 8)
    assert levels == [4, 2, 1]
    for k, (a, b) in enumerate(merged):
        below = 8 + sum(levels[: next(i for i in range(3) if k < sum(levels[: i + 1]))])
        assert a < below and b < below
