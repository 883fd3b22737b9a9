"""Weighted sums of group statistics against copies of rows and refits in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import pca_metrics, resample

K = 2


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 5)) @ np.diag([3, 2, 1, 0.5, 0.2]) + 1e5
    key = np.array(["a", "b"])[np.arange(120) % 2]
    group = np.array([f"g{i}" for i in rng.integers(0, 7, 120)])
    df = spark.createDataFrame([(k, g, [float(v) for v in r]) for k, g, r in zip(key, group, x, strict=True)], "key string, image string, s array<double>").repartition(5)
    return x, key, group, resample.statistics(df, "key", "image", "s")


def _refit(x):
    value, vector = np.linalg.eigh(np.cov(x, rowvar=False))
    return x.mean(0), value[::-1], vector[:, ::-1].T


def test_bootstrap_equals_copied_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(resample, "HELD", 1)
    x, key, group, stats = rows
    groups = spark.createDataFrame([(g,) for g in sorted(set(group))], "image string")
    weights = resample.bootstrap_weights(groups, "image", 100, 3)
    per = {}
    for r in weights.collect():
        per.setdefault(r.run, {})[r.group] = r.w
    assert len(per) == 100 and all(sum(w.values()) == 7 for w in per.values()) and len({tuple(sorted(w.items())) for w in per.values()}) > 90
    got = {(r.key, r.run): r for r in resample.fits(resample.weighted_sums(stats, weights)).collect()}
    assert len(got) == 200
    for (k, run), r in got.items():
        at = [i for i in range(120) if key[i] == k for _ in range(int(per[run].get(group[i], 0)))]
        mean, value, vector = _refit(x[at])
        assert r.n == len(at) and np.allclose(r.mean, mean, rtol=1e-12) and np.allclose(r.eigenvalues, value, rtol=1e-6)
        assert np.allclose(np.abs((np.array(r.loadings)[:K] * vector[:K]).sum(1)), 1, atol=1e-6)


def test_partitions_equal_refits(spark, rows):
    x, key, group, stats = rows
    names = sorted(set(group))
    parts = {"even": {g: n % 2 for n, g in enumerate(names)}, "thirds": {g: n % 3 for n, g in enumerate(names)}}
    table = spark.createDataFrame([(p, g, f) for p, a in parts.items() for g, f in a.items()], "partition string, group string, fold int")
    got = {(r.key, r.partition, int(r.fold)): r for r in resample.partition_metrics(stats, table, K).collect()}
    assert len(got) == 2 * 5
    for (k, p, f), r in got.items():
        out = np.array([parts[p][g] == f for g in group])
        train, held = x[(key == k) & ~out], x[(key == k) & out]
        mean, value, vector = _refit(train)
        c = held - mean
        t = c @ vector[:K].T
        own = (train - mean) @ vector[:K].T
        assert (r.n_train, r.n_held) == (len(train), len(held))
        assert r.explained == pytest.approx(value[:K].sum() / value.sum())
        assert r.mean_h == pytest.approx((t * t / value[:K]).sum(1).mean(), rel=1e-6)
        assert r.mean_q == pytest.approx(((c - t @ vector[:K]) ** 2).sum(1).mean(), rel=1e-6)
        assert r.train_q == pytest.approx((((train - mean) - own @ vector[:K]) ** 2).sum(1).mean(), rel=1e-6)
        assert r["shift"] == pytest.approx(np.linalg.norm(held.mean(0) - mean) / np.sqrt(value.sum()), rel=1e-6)


def test_null_keys_and_groups_count(spark):
    df = spark.createDataFrame([(None, None, [1.0, 2.0]), (None, "g", [2.0, 5.0]), (None, "g", [4.0, 1.0])], "key string, image string, s array<double>")
    stats = resample.statistics(df, "key", "image", "s")
    weights = spark.createDataFrame([("r", None, 2.0), ("r", "g", 1.0)], "run string, group string, w double")
    r = resample.fits(resample.weighted_sums(stats, weights)).first()
    assert r.key is None and r.n == 4 and np.allclose(r.mean, [2.0, 2.5])


def test_no_second_scan(spark, rows):
    *_, stats = rows
    weights = spark.createDataFrame([("r", "g1", 1.0)], "run string, group string, w double")
    sums = resample.weighted_sums(stats, weights)
    assert all("weighted-sums" in f for f in sums.inputFiles())
    assert all("factors" in f for f in stats.inputFiles())


def test_types_are_reduced_apart(spark, rows):
    *_, stats = rows
    names = [r.group for r in stats.select("group").distinct().collect()]
    one = spark.createDataFrame([("all", g, 1.0) for g in names], "run string, group string, w double")
    folds = spark.createDataFrame([("fold", g, n % 2) for n, g in enumerate(sorted(names))], "partition string, group string, fold int")
    runs = resample.fold_weights(folds, "partition", "group", "fold").unionByName(resample.bootstrap_weights(stats.select("group").distinct(), "group", 4))
    table = resample.loading_runs(resample.fits(resample.weighted_sums(stats, one)), resample.fits(resample.weighted_sums(stats, runs)))
    compared = pca_metrics.loading_stability(table, "candidate", "run", K)
    got = {(r.candidate, r.run_type): r for r in resample.stability_by_type(compared, {"fold": "fold/", "bootstrap": "boot_"}).collect()}
    assert {k: r.n_runs for k, r in got.items()} == {("a", "fold"): 2, ("b", "fold"): 2, ("a", "bootstrap"): 4, ("b", "bootstrap"): 4}
    first = compared.where(F.col("run").startswith("fold/")).where("candidate = 'a' AND component = 1").collect()
    assert got["a", "fold"].subspace_instability == pytest.approx(np.mean([1 - r.subspace_similarity for r in first]))
