import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.functions import spectra as sp
from prismata.operators import models


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(5).normal(1.0, 0.2, (60, 8))


@pytest.fixture(scope="module")
def df(spark, x):
    return spark.createDataFrame([(i, "ab"[i % 2], r.tolist()) for i, r in enumerate(x)], "id long, label string, s array<double>")


def _back(df, column):
    return np.array([r[0] for r in df.orderBy("id").select(column).collect()])


def test_row_transforms_match_numpy(df, x):
    assert np.allclose(_back(df, sp.snv(F.col("s"))), (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True))
    assert np.allclose(_back(df, sp.l2_normalise(F.col("s"))), x / np.linalg.norm(x, axis=1, keepdims=True))
    assert np.allclose(_back(df, sp.absorbance(F.col("s"))), -np.log10(x))


def test_constant_spectrum_is_not_divided_by_zero(spark):
    df = spark.createDataFrame([(0, [2.0, 2.0, 2.0]), (1, [0.0, 0.0, 0.0])], "id long, s array<double>")
    assert np.allclose(_back(df, sp.snv(F.col("s"))), 0)
    assert np.allclose(_back(df, sp.l2_normalise(F.col("s")))[1], 0)


def test_validity_priority(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [0.0, 0.0]), (2, [1.0, -1.0]), (3, [1.0, 2.0])], "id long, s array<double>")
    got = [r[0] for r in df.orderBy("id").select(sp.validity_reason(F.col("s"))).collect()]
    assert got == ["non_finite_spectrum", "all_zero_spectrum", "nonpositive_reflectance", "valid"]


def test_savgol_is_exact_on_polynomials():
    t = np.arange(20.0)
    y = 3 + 2 * t + 0.5 * t * t
    assert np.allclose(sp.savgol_matrix(20, 7, 2) @ y, y)
    assert np.allclose(sp.savgol_matrix(20, 7, 2, 1) @ y, 2 + t)
    assert np.allclose(sp.savgol_matrix(20, 7, 2, 2) @ y, 1.0)


def test_chi_square_quantiles():
    assert np.allclose(models.chi2_inverse(0.95, np.array([1.0, 3.0, 10.0])), [3.841459, 7.814728, 18.307038], atol=1e-5)


def test_pca_matches_numpy(df, x):
    for r in models.fit_pca(df, "label", "s").collect():
        part = x["ab".index(r["model"]) :: 2]
        want = np.sort(np.linalg.eigvalsh(np.cov(part.T)))[::-1]
        assert r["n"] == len(part)
        assert np.allclose(r["mean"], part.mean(0))
        assert np.allclose(r["eigenvalues"], want)


def test_h_and_q_match_numpy(df, x):
    m = models.fit_pca(df.withColumn("all", F.lit("m")), "all", "s")
    got = models.score(df, m, 3, "s").orderBy("id").select("h", "q").collect()
    c = x - x.mean(0)
    value, vector = np.linalg.eigh(np.cov(c.T))
    p, lam = vector[:, ::-1][:, :3], value[::-1][:3]
    t = c @ p
    assert np.allclose([r["h"] for r in got], (t * t / lam).sum(1))
    assert np.allclose([r["q"] for r in got], ((c - t @ p.T) ** 2).sum(1))
