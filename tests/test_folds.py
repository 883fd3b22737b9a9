"""Folds against brute force over all assignments."""

import itertools
import random

import numpy as np
import pytest

from prismata.operators import folds

SCHEMA = "image string, class string, batch int, area double"


def _objects(seed, n_groups, classes=2, batches=2):
    rng = random.Random(seed)
    return [(f"i{g:02d}", f"c{g % classes}", g // 2 % batches, float(rng.choice([10, 20, 35, 50, 90]))) for g in range(n_groups) for _ in range(rng.randrange(1, 9))]


def _table(rows, n_bins=3):
    names = sorted({r[0] for r in rows})
    label = {r[0]: r[1] for r in rows}
    batch = {r[0]: r[2] for r in rows}
    n = np.array([sum(r[0] == g for r in rows) for g in names])
    size = np.array([np.median([r[3] for r in rows if r[0] == g]) for g in names])
    rank = np.empty(len(names))
    rank[np.lexsort((names, size))] = np.arange(1, len(names) + 1)
    edges = np.quantile(rank, np.linspace(0, 1, n_bins + 1))
    return names, [label[g] for g in names], [batch[g] for g in names], n, size, np.maximum(np.searchsorted(edges, rank, "left") - 1, 0)


def _score(table, fold, n_folds):
    names, label, batch, n, size, bins = table
    lacking = 0
    for f in range(n_folds):
        for column in (label, batch):
            lacking += len(set(column) - {v for v, x in zip(column, fold, strict=True) if x == f}) + len(set(column) - {v for v, x in zip(column, fold, strict=True) if x != f})
    total = [n[np.array(fold) == f].sum() for f in range(n_folds)]
    med = [np.median(size[np.array(fold) == f]) for f in range(n_folds)]
    per = np.array([[np.sum((np.array(fold) == f) & (bins == b)) for b in range(bins.max() + 1)] for f in range(n_folds)])
    return int(lacking), int(np.ptp(total)), int(np.ptp(per, 0).sum()), round(float(np.ptp(med)), 9)


@pytest.mark.parametrize(("seed", "n"), [(1, 12), (2, 12), (3, 5), (4, 2)])
def test_two_folds_equal_brute_force(spark, seed, n):
    rows = _objects(seed, n)
    table = _table(rows)
    got = folds.balanced_folds(spark.createDataFrame([*rows, ("lost", None, 1, 2.0)], SCHEMA), "image", "class", "batch", "area").collect()
    best = min((_score(table, (0, *x), 2), (0, *x)) for x in itertools.product((0, 1), repeat=n - 1) if any(x))
    assert tuple(r.fold for r in sorted(got, key=lambda r: r.group)) == best[1]
    assert (got[0].incomplete, got[0].count_range, got[0].bin_range, round(got[0].median_range, 9)) == best[0]


def test_search_improves_on_its_starts_and_scores_alike(spark):
    rows = _objects(7, 30, 3, 2)
    table = _table(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for steps in (0, 3000):
        got = sorted(folds.balanced_folds(df, "image", "class", "batch", "area", 3, seed=5, starts=6, steps=steps).collect(), key=lambda r: r.group)
        found[steps] = _score(table, [r.fold for r in got], 3)
        assert (got[0].incomplete, got[0].count_range, got[0].bin_range, round(got[0].median_range, 9)) == found[steps]
        assert sorted(np.bincount([r.fold for r in got])) == [10, 10, 10]
    assert found[3000] < found[0] and found[3000][:2] <= (0, 1)
    again = sorted(folds.balanced_folds(df, "image", "class", "batch", "area", 3, seed=5, starts=6, steps=3000).collect(), key=lambda r: r.group)
    assert [r.fold for r in again] == [r.fold for r in got]


def test_coverage_says_what_a_side_lacks(spark):
    rows = [("a", "x", 1, 1.0), ("b", "x", 1, 1.0), ("c", "y", 1, 3.0), ("c", "y", 1, 5.0)]
    got = {r.fold: r for r in folds.coverage(folds.balanced_folds(spark.createDataFrame(rows, SCHEMA), "image", "class", "batch", "area")).collect()}
    assert not any(r.coverage_complete for r in got.values()) and sum(r.n_validation_objects for r in got.values()) == 4
    assert all(r.validation_has_all_batches and r.training_has_all_batches for r in got.values())
    assert {r.n_validation_groups + r.n_training_groups for r in got.values()} == {3}


def test_faults_are_errors(spark):
    with pytest.raises(Exception, match="two classes or batches"):
        folds.balanced_folds(spark.createDataFrame([("a", "x", 1, 1.0), ("a", "y", 1, 1.0), ("b", "x", 1, 1.0)], SCHEMA), "image", "class", "batch")
    with pytest.raises(ValueError, match="do not fill"):
        folds.balanced_folds(spark.createDataFrame([("a", "x", 1, 1.0)], SCHEMA), "image", "class", "batch")
