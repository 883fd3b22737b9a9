"""Rank, pivots and eigenvalues from tall-skinny QR against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import factor, models, sampling


def _table(spark, x, keys=None, parts=7):
    rows = [(keys[i] if keys else "m", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key string, s array<double>").repartition(parts)


@pytest.mark.parametrize("offset", [0.0, 1.0, 1e6])
@pytest.mark.parametrize("fan", [2, 16])
def test_eigenvalues_keep_their_digits_at_an_offset(spark, monkeypatch, offset, fan):
    monkeypatch.setattr(factor, "FAN", fan)
    x = np.random.default_rng(1).normal(size=(300, 4)) * 0.01 + offset
    r = models.fit_pca(_table(spark, x, parts=9), "key", "s").first()
    want = np.sort(np.linalg.eigvalsh(np.cov(x - offset, rowvar=False)))[::-1]
    assert r.n == 300 and np.allclose(r.mean, x.mean(0), rtol=1e-12)
    assert np.allclose(r.eigenvalues, want, rtol=1e-5)
    c = x - x.mean(0)
    assert np.allclose(np.var(c @ np.array(r.loadings).T, axis=0, ddof=1), want, rtol=1e-5)


def _cases():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5))
    yield "full", x
    yield "dependent", np.hstack([x, x[:, :2] + x[:, 1:3], x[:, :1] * 3])
    yield "offset", np.hstack([x + 1e6, (x[:, :1] + 1e6) * 2])
    yield "few_rows", x[:3]
    yield "one_row", x[:1]
    yield "equal_rows", np.tile(x[:1] + 1e6, (40, 1))
    yield "zero", np.zeros((6, 3))
    yield "constant_band", np.hstack([x, np.full((80, 1), 7.0)])


@pytest.mark.parametrize(("name", "x"), list(_cases()))
def test_rank_equals_numpy(spark, name, x):
    r = factor.ranks(factor.factors(_table(spark, x), "key", "s")).first()
    assert (r.n, r.width, r["rank"]) == (*x.shape, np.linalg.matrix_rank(x))
    assert np.allclose(r.singular_values, np.linalg.svd(x, compute_uv=False), rtol=1e-9, atol=1e-6)
    tol = np.linalg.svd(x, compute_uv=False).max() * max(x.shape) * np.finfo(float).eps
    assert r.centred_rank == np.linalg.matrix_rank(x - x.mean(0), tol=tol)
    assert sorted(r.pivots) == list(range(x.shape[1]))
    assert not r["rank"] or np.linalg.matrix_rank(x[:, r.pivots[: r["rank"]]]) == r["rank"]


def test_models_are_kept_apart_and_null_is_one_of_them(spark):
    x = np.random.default_rng(4).normal(size=(90, 6))
    keys = [["a", None, "b"][i % 3] for i in range(90)]
    got = {r.model: r for r in factor.ranks(factor.factors(_table(spark, x, keys), "key", "s")).collect()}
    assert {k: (r.n, r["rank"]) for k, r in got.items()} == {"a": (30, 6), "b": (30, 6), None: (30, 6)}


def test_values_that_are_not_finite_have_no_rank(spark):
    x = np.random.default_rng(4).normal(size=(9, 3))
    x[4, 1] = np.nan
    r = factor.ranks(factor.factors(_table(spark, x), "key", "s")).first()
    assert r["rank"] is None and r.pivots is None


def test_rows_of_unlike_length_are_refused_in_one_model(spark):
    df = spark.createDataFrame([("m", [1.0, 2.0]), ("m", [1.0])], "key string, s array<double>")
    with pytest.raises(Exception, match="differ in length"):
        factor.ranks(factor.factors(df, "key", "s")).collect()
    assert sampling.matrix_rank(df, "s").first().asDict() == {"matrix_rank": None, "rank_ratio": None}


def test_empty_table_has_no_models(spark):
    df = spark.createDataFrame([], "key string, s array<double>")
    assert factor.ranks(factor.factors(df, "key", "s")).count() == 0 and models.fit_pca(df, "key", "s").count() == 0
    assert sampling.matrix_rank(df, "s").first().matrix_rank is None


def test_pivoted_order_takes_the_largest_remainder():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4)) * [1, 5, 0.1, 2]
    x = np.hstack([x, x[:, [1]] + x[:, [3]] * 1e-3])
    order, gains = factor.pivoted(np.linalg.qr(x, mode="r"))
    left = x.copy()
    for k, g in zip(order, gains, strict=True):
        size = np.linalg.norm(left, axis=0)
        assert size[k] == pytest.approx(size.max(), abs=1e-9) and g == pytest.approx(size[k], abs=1e-9)
        if size[k] > 1e-9:
            u = left[:, k] / size[k]
            left = left - np.outer(u, u @ left)


def test_contract_names_rank_and_spatial_columns(spark):
    df = spark.createDataFrame([("a", "i", "o1", 0, [0.0, 0.0]), ("b", "i", "o2", 1, [0.0, 0.0])], "label string, image string, object string, row int, spectrum array<double>")
    got = {r.check: r.n_broken for r in sampling.matrix_contract(df, "label", "image", "object", ["a", "b"], df.select("object"), level="pixel").collect()}
    assert got["rank_above_zero"] == 1 and got["spatial_columns"] == 2 and got["varying_bands"] == 2
    got = {r.check: r.passed for r in sampling.matrix_contract(df.drop("row"), "label", "image", "object", ["a", "b"], df.select("object"), level="object_mean").collect()}
    assert got["spatial_columns"] and not got["rank_above_zero"]
    assert sampling.matrix_summary(df.where(F.col("label") == "a"), "label", "image").first().status == "invalid"
