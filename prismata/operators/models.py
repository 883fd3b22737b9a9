"""PCA and one-class SIMCA from distributed QR factors and Gram matrices.

One bands x bands block per task and key is shuffled, whatever the number of rows: a triangle where a model is fitted, a
Gram matrix where sums are added and subtracted. Eigenproblems are solved in grouped tasks, one per model, on that block
alone. Models are rows (arrays and doubles) that scoring joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators import factor

MODEL = "model string, n long, mean array<double>, eigenvalues array<double>, loadings array<array<double>>"


def grams(df: DataFrame, key: str, spectrum: str) -> DataFrame:
    """``(key, n, total array, gram array)`` per key: row count, column sums and the flattened cross-product sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            col = batch.column(1)
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))
            for k in dict.fromkeys(keys):
                part = x[keys == k]
                h = held.setdefault(k, [0, 0.0, 0.0])
                h[0] += len(part)
                h[1] = h[1] + part.sum(0)
                h[2] = h[2] + part.T @ part
        for k, (n, s, g) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], names=["model", "n", "total", "gram"])

    parts = df.where(F.col(spectrum).isNotNull()).select(F.col(key).cast("string").alias("model"), F.col(spectrum).alias("s")).mapInArrow(run, "model string, n long, total array<double>, gram array<double>")
    long = parts.select("model", "n", F.posexplode(F.concat("total", "gram")).alias("i", "v"))
    cells = long.groupBy("model", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return cells.groupBy("model").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("cells"))


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    r = pdf.iloc[0]
    mean, value, vector = factor.eigen(np.asarray(r["triangle"], float).reshape(-1, int(r["width"]) + 1), int(r["n"]))
    return pd.DataFrame([{"model": r["model"], "n": int(r["n"]), "mean": mean.tolist(), "eigenvalues": value.tolist(), "loadings": vector.tolist()}])


def fit_pca(df: DataFrame, key: str, spectrum: str) -> DataFrame:
    """One row of MODEL per key: all eigenvalues of the covariance (n - 1), descending, and their loadings, from a QR
    factorisation; digits that rows have in common do not cost precision."""
    return solve_pca(factor.merged(factor.triangles(df, key, spectrum)))


def solve_pca(stored: DataFrame) -> DataFrame:
    """Rows of MODEL from rows of ``factor.TRIANGLE``."""
    return stored.groupBy("model").applyInPandas(_solve, MODEL)


def component_table(models: DataFrame, levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """Per component variance, its share, the share so far, and the components each level needs."""
    total = F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x)
    long = models.select("model", total.alias("total"), F.posexplode("eigenvalues").alias("component", "eigenvalue"))
    w = Window.partitionBy("model").orderBy("component")
    long = long.withColumns({"component": F.col("component") + 1, "ratio": F.col("eigenvalue") / F.col("total")}).withColumn("cumulative", F.sum("ratio").over(w))
    for level in levels:
        long = long.withColumn(f"needed_{round(level * 100)}", F.min(F.when(F.col("cumulative") >= level - 1e-12, F.col("component"))).over(Window.partitionBy("model")))
    return long.drop("total")


def score(df: DataFrame, models: DataFrame, k: int, spectrum: str, on: str | None = None) -> DataFrame:
    """Rows with ``scores``, ``h`` (sum of t^2 / eigenvalue) and ``q`` (squared residual) under each model; with ``on``
    a row meets the model of that name only. Models are one row per fit, a parameter-sized table."""
    m = models.select(F.col("model").alias("_m"), F.col("mean").alias("_mean"), F.slice("eigenvalues", 1, k).alias("_l"), F.slice("loadings", 1, k).alias("_p"))
    df = df.join(m, F.col(on).cast("string") == F.col("_m")) if on else df.crossJoin(m)
    df = df.withColumn("_x", F.zip_with(spectrum, "_mean", lambda x, c: x - c))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    df = df.withColumn("scores", F.transform("_p", lambda p: dot(F.col("_x"), p)))
    h = F.aggregate(F.zip_with("scores", "_l", lambda t, v: t * t / F.greatest(v, F.lit(1e-12))), F.lit(0.0), lambda a, x: a + x)
    # loadings are orthonormal, so the residual is what the scores leave of the centred norm
    q = F.greatest(F.lit(0.0), F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x) - F.aggregate("scores", F.lit(0.0), lambda a, t: a + t * t))
    return df.withColumns({"h": h, "q": q, "model": F.col("_m")}).drop("_x", "_mean", "_l", "_p", "_m")


def chi2_inverse(p: float, dof: np.ndarray) -> np.ndarray:
    """Quantile of the chi-square distribution for real degrees of freedom, by bisection on the regularised gamma."""

    def cdf(x: float, k: float) -> float:
        a, x = k / 2, x / 2
        if x <= 0:
            return 0.0
        if x < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= x / n
                total += term
            return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
        b, c = x + 1 - a, 1e300
        d = h = 1 / b
        for i in range(1, 10_000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h

    out = []
    for k in np.asarray(dof, float):
        lo, hi = 0.0, max(1.0, k)
        while cdf(hi, k) < p:
            hi *= 2
        for _ in range(200):
            mid = (lo + hi) / 2
            if mid in (lo, hi):  # no double lies between
                break
            lo, hi = (mid, hi) if cdf(mid, k) < p else (lo, mid)
        out.append((lo + hi) / 2)
    return np.array(out)


def limits(models: DataFrame, k: int, alpha: float, eps: float = 1e-12) -> DataFrame:
    """H0 = A (n - 1) / n with A degrees, Q0 and its degrees by Box from the residual eigenvalues, and the chi-square
    limits of H, Q and the combined data-driven statistic."""
    rest = F.filter(F.slice("eigenvalues", k + 1, 100_000), lambda x: x > eps)
    q1, q2 = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x), F.aggregate(rest, F.lit(0.0), lambda a, x: a + x * x)
    df = models.withColumns({"h0": k * (F.col("n") - 1) / F.col("n"), "nh": F.lit(float(k)), "q0": q1, "nq": F.try_divide(q1 * q1, q2)})

    @F.pandas_udf("double")
    def quantile(dof: pd.Series) -> pd.Series:
        good = dof.notna()
        out = pd.Series(np.nan, index=dof.index)
        out[good] = chi2_inverse(1 - alpha, dof[good].to_numpy())
        return out

    return df.withColumns({"h_limit": F.col("h0") / F.col("nh") * quantile("nh"), "q_limit": F.col("q0") / F.col("nq") * quantile("nq"), "dd_limit": quantile(F.col("nh") + F.col("nq"))})


def rule_variants(scored: DataFrame) -> DataFrame:
    """Long form: statistic, limit, ratio, signed margin and acceptance (strictly below the limit) per rule."""
    h, q = F.col("h") / F.col("h_limit"), F.col("q") / F.col("q_limit")
    rules = {"simple": (F.greatest(h, q), F.lit(1.0)), "alternative": (h + q, F.lit(2.0)), "data_driven": (F.col("nh") * F.col("h") / F.col("h0") + F.col("nq") * F.col("q") / F.col("q0"), F.col("dd_limit"))}
    long = scored.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), s.alias("statistic"), x.alias("limit")) for n, (s, x) in rules.items()])))
    long = long.select("*", "_v.*").drop("_v")
    return long.withColumns({"ratio": F.col("statistic") / F.col("limit"), "margin": 1 - F.col("statistic") / F.col("limit"), "accepted": F.col("statistic") < F.col("limit")})


def multiclass(scored: DataFrame, key: str) -> DataFrame:
    """Accepted by none is unknown, by one that class, by several ambiguous; the closest by H/Hlim + Q/Qlim."""
    d = F.col("h") / F.col("h_limit") + F.col("q") / F.col("q_limit")
    ok = (F.col("h") < F.col("h_limit")) & (F.col("q") < F.col("q_limit"))
    df = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.when(ok, F.col("model")))).alias("accepted"), F.min_by("model", d).alias("closest"))
    return df.withColumn("decision", F.when(F.size("accepted") == 0, "unknown").when(F.size("accepted") == 1, F.col("accepted")[0]).otherwise("ambiguous"))
