"""One-class SIMCA: fits with all limits, ten rule variants, thresholds by grouped cross-validation, projections.

A fit needs one QR factor per model. Cross-validation needs no pass per fold: the Gram matrix of a fold's training rows is
that of all rows minus that of the rows held out, and small folds are taken off where their rows are. Scoring multiplies Arrow batches by the loadings, which are sent to the
tasks up to a checked size; larger model tables are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators import factor
from prismata.operators.chain import mean_spectrum
from prismata.operators.models import MODEL, chi2_inverse, grams, score, solve_pca
from prismata.plans.nulls import join_same
from prismata.plans.shared import materialize

EPS = 1e-12
SENT = 64 << 20  # bytes of models that scoring sends to the tasks
BUNDLE = 1024  # rows of small folds of a class that one group fits and scores
STACK = 16 << 20  # bytes of covariances that are decomposed at once


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    r = pdf.iloc[0]
    cells, n = np.asarray(r["cells"], float), int(r["n"])
    b = (math.isqrt(1 + 4 * len(cells)) - 1) // 2
    mean = cells[:b] / n
    value, vector = np.linalg.eigh((cells[b:].reshape(b, b) - n * np.outer(mean, mean)) / max(1, n - 1))
    order = np.argsort(value)[::-1]
    return pd.DataFrame([{"model": r["model"], "n": n, "mean": mean.tolist(), "eigenvalues": np.maximum(value[order], 0).tolist(), "loadings": vector[:, order].T.tolist()}])


def distances(rows: DataFrame, models: DataFrame, k: int, spectrum: str, own: str | None = None) -> DataFrame:
    """Rows (without their spectrum) with ``model``, ``h`` and ``q`` under every model, or with ``own`` under the model
    of that name only. ``models`` must be a stored table."""
    n = models.count()
    size = n * (models.select(F.size("mean").alias("b")).agg(F.max("b")).first()[0] or 0) * (k + 1) * 8
    if size > SENT:
        return score(rows, models, k, spectrum, own).drop(spectrum, "scores")
    fits = {r["model"]: (np.array(r["mean"]), np.array(r["l"]), np.array(r["p"])) for r in models.select("model", "mean", F.slice("eigenvalues", 1, k).alias("l"), F.slice("loadings", 1, k).alias("p")).collect()}
    keep = [c for c in rows.columns if c not in (spectrum, "model", "h", "q")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("_x"))
            if not len(col):
                continue
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
            if own:  # sorted once: a batch may meet many models
                codes, names = pd.factorize(np.array(batch.column(batch.schema.get_field_index("_own")).to_pylist(), object), use_na_sentinel=False)
                order = np.argsort(codes, kind="stable")
                groups = zip(names, np.split(order, np.flatnonzero(np.diff(codes[order])) + 1), strict=True)
            else:
                groups = ((name, np.arange(len(x))) for name in fits)
            for name, at in groups:
                if name not in fits:
                    continue
                mean, values, loadings = fits[name]
                c = x[at] - mean
                t = c @ loadings.T
                h = (t * t / np.maximum(values, EPS)).sum(1)
                q = np.maximum(0, (c * c).sum(1) - (t * t).sum(1))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(len(keep))], pa.array([name] * len(at), pa.string()), pa.array(h), pa.array(q)], names=[*keep, "model", "h", "q"])

    df = rows.where(F.col(spectrum).isNotNull()).select(*keep, (F.col(own).cast("string") if own else F.lit("")).alias("_own"), F.col(spectrum).alias("_x"))
    schema = df.select(*keep, F.lit("").alias("model"), F.lit(0.0).alias("h"), F.lit(0.0).alias("q")).schema
    return df.mapInArrow(run, schema)


def quantile_udf(p: float):
    @F.pandas_udf("double")
    def quantile(dof: pd.Series) -> pd.Series:
        good = dof.notna() & (dof > 0)
        out = pd.Series(np.nan, index=dof.index)
        out[good] = chi2_inverse(p, dof[good].to_numpy())
        return out

    return quantile


def eigensystems(rows: DataFrame, key: str, spectrum: str) -> DataFrame:
    """Stored rows of MODEL per key, with the numerical ``rank`` of its rows: all components, so that one pass serves every
    number of them."""
    stored = factor.factors(rows, key, spectrum)
    return materialize(solve_pca(stored).join(factor.ranks(stored).select("model", "rank"), "model"), "simca-pca")


def fit(rows: DataFrame, key: str, spectrum: str, k: int, alpha: float, h_method: str = "theoretical", q_method: str = "box", pca: DataFrame | None = None) -> DataFrame:
    """One stored row per class: MODEL, and its distribution parameters and limits.

    H0 = k (n - 1) / n; NH is k, or 2 H0^2 / var (``moment``). Q0 and NQ come from the residual eigenvalues (``box``), or, with
    ``moment`` and where no residual is left, from the training rows' Q. Empirical limits are linear quantiles of the training
    distances; the combined index has a chi-square limit scaled by its moments. ``status`` is ok, or says that n is
    not above k, or that k is above the rank; such rows have no limits.
    """
    pca = eigensystems(rows, key, spectrum) if pca is None else pca
    own = materialize(distances(rows.select(key, spectrum), pca, k, spectrum, key).select("model", "h", "q"), "simca-training")
    h0 = k * (F.col("n") - 1) / F.col("n")
    rest = F.filter(F.slice("eigenvalues", k + 1, 1_000_000), lambda x: x > EPS)
    df = pca.withColumns({"h0": F.greatest(h0, F.lit(EPS)), "_rest": rest, "rank": F.col("rank") if "rank" in pca.columns else F.size(F.filter("eigenvalues", lambda x: x > EPS))})
    df = df.withColumns({"_q1": F.aggregate("_rest", F.lit(0.0), lambda a, x: a + x), "_q2": F.aggregate("_rest", F.lit(0.0), lambda a, x: a + x * x)})
    moments = own.join(df.select("model", F.col("h0").alias("_h0")), "model").groupBy("model").agg(F.avg("q").alias("_mq"), F.var_pop("q").alias("_vq"), F.avg((F.col("h") - F.col("_h0")) * (F.col("h") - F.col("_h0"))).alias("_vh"))
    df = df.join(moments, "model", "left")
    fallback = F.greatest(F.size("mean") - k, F.lit(1)).cast("double")
    box = (F.size("_rest") > 0) & F.lit(q_method == "box")
    nq = F.when(box, F.when(F.col("_q2") > EPS, F.col("_q1") * F.col("_q1") / F.nullif("_q2", F.lit(0.0))).otherwise(fallback)).when((F.col("_vq") <= EPS) | (F.col("_mq") <= EPS), fallback).otherwise(2 * F.col("_mq") * F.col("_mq") / F.nullif("_vq", F.lit(0.0)))
    nh = F.lit(float(k)) if h_method == "theoretical" else F.when(F.col("_vh") <= EPS, float(k)).otherwise(2 * F.col("h0") * F.col("h0") / F.nullif("_vh", F.lit(0.0)))
    status = F.when(F.col("n") <= k, "too_few_rows").when(F.col("rank") < k, "components_above_rank").otherwise("ok")
    df = df.withColumns({"q0": F.greatest(F.when(box, F.col("_q1")).otherwise(F.col("_mq")), F.lit(EPS)), "nq": F.greatest(nq, F.lit(EPS)), "nh": F.greatest(nh, F.lit(EPS)), "status": status})
    quantile = quantile_udf(1 - alpha)
    good = F.col("status") == "ok"
    limit = lambda mean, dof: F.when(good, F.greatest(F.col(mean) / F.col(dof) * quantile(dof), F.lit(EPS)))
    df = df.withColumns({"h_limit": limit("h0", "nh"), "q_limit": limit("q0", "nq"), "dd_limit": F.when(good, quantile(F.col("nh") + F.col("nq")))})
    df = materialize(df.drop("_rest", "_q1", "_q2", "_mq", "_vq", "_vh"), "simca-limits")
    c = own.join(df.select("model", "h_limit", "q_limit"), "model").withColumn("c", F.col("h") / F.col("h_limit") + F.col("q") / F.col("q_limit"))
    p = F.lit(1 - alpha)
    stats = c.groupBy("model").agg(F.avg("c").alias("_c0"), F.var_pop("c").alias("_vc"), F.percentile("h", p).alias("h_empirical"), F.percentile("q", p).alias("q_empirical"), F.percentile("c", p).alias("c_empirical"))
    nc = F.greatest(F.when(F.col("_vc") <= EPS, 1e6).otherwise(2 * F.col("_c0") * F.col("_c0") / F.nullif("_vc", F.lit(0.0))), F.lit(EPS))
    df = df.join(stats, "model", "left").withColumn("_nc", nc).withColumn("combined_limit", F.when(good, F.col("_c0") / F.col("_nc") * quantile("_nc")))
    return materialize(df.drop("_c0", "_vc", "_nc"), "simca-fits")


LIMITS = ["h0", "nh", "q0", "nq", "h_limit", "q_limit", "dd_limit", "combined_limit"]
#: variant: the statistic, and the fixed limit or the name of the column that has it
VARIANTS = {
    "simple_chi2": ("simple", 1.0), "simple_emp_cv": ("simple", "simple_emp_cv"), "alternative_chi2_fixed2": ("sum", 2.0), "alternative_chi2_emp_cv": ("sum", "alternative_chi2_emp_cv"),
    "alternative_empHQ_fixed2": ("emp_sum", 2.0), "alternative_empHQ_emp_cv": ("emp_sum", "alternative_empHQ_emp_cv"), "combined_index_chi2": ("sum", "combined_limit"), "combined_index_emp_cv": ("sum", "combined_index_emp_cv"),
    "data_driven_chi2": ("dd", "dd_limit"), "data_driven_emp_cv": ("dd", "data_driven_emp_cv"),
}


def statistics() -> dict[str, Column]:
    h, q = F.col("h") / F.col("h_limit"), F.col("q") / F.col("q_limit")
    return {"simple": F.greatest(h, q), "sum": h + q, "dd": F.col("nq") * F.col("q") / F.col("q0") + F.col("nh") * F.col("h") / F.col("h0")}


def project(scored: DataFrame, fits: DataFrame, thresholds: DataFrame | None = None, variants: list[str] | None = None) -> DataFrame:
    """Long form of rows with ``model, h, q``: per rule variant statistic, limit, ratio, signed margin, acceptance
    (strictly below the limit) and two-way decision (margin of 0 or more). Variants that need cross-validated thresholds
    (one row per model) need ``thresholds``."""
    df = scored.join(fits.select("model", *LIMITS).where("h_limit IS NOT NULL"), "model")
    stats = statistics()
    names = variants or [v for v, (s, limit) in VARIANTS.items() if thresholds is not None or (s != "emp_sum" and (not isinstance(limit, str) or limit in LIMITS))]
    if thresholds is not None:
        df = df.join(thresholds, "model")
        stats["emp_sum"] = F.col("h") / F.greatest("H_emp_cv", F.lit(EPS)) + F.col("q") / F.greatest("Q_emp_cv", F.lit(EPS))
    rules = [F.struct(F.lit(v).alias("rule"), stats[VARIANTS[v][0]].alias("statistic"), (F.col(VARIANTS[v][1]) if isinstance(VARIANTS[v][1], str) else F.lit(VARIANTS[v][1])).alias("limit")) for v in names]
    out = df.select(*scored.columns, F.explode(F.array(*rules)).alias("_r")).select(*scored.columns, "_r.*").where("limit > 0")
    return out.withColumns({"family": F.regexp_extract("rule", "^(simple|alternative|combined_index|data_driven)", 1), "ratio": F.col("statistic") / F.col("limit"), "margin": 1 - F.col("statistic") / F.col("limit"), "accepted": F.col("statistic") < F.col("limit"), "decision": F.col("statistic") <= F.col("limit")})


def wide_projection(long: DataFrame, keys: list[str], variants: list[str]) -> DataFrame:
    """One row per key: ``stat_``, ``limit_`` and ``pred_`` of every variant."""
    pick = lambda v, c: F.max(F.when(F.col("rule") == v, F.col(c)))
    return long.groupBy(*keys).agg(*[pick(v, c).alias(f"{p}_{v}") for v in variants for c, p in (("statistic", "stat"), ("limit", "limit"), ("accepted", "pred"))])


def higher_quantiles(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """``(by, quantile)``: element ceil(q (n - 1)) of each group's sorted values. A sketch of bounded size brackets it
    (its rank error is 1 in 10,000, the bracket 1 in 100 on both sides); only values inside the bracket are sorted."""
    ends = F.array(F.lit(max(0.0, q - 0.01)), F.lit(min(1.0, q + 0.01)))
    v = F.col(value).cast("double")
    df = df.where(v.isNotNull()).select(*by, v.alias("_v"))
    sketch = df.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, F.lit(10_000)).alias("_b"))
    one = [F.lit(0).alias("_one")] if not by else []
    on = by or ["_one"]
    df, sketch = (df.select("*", *one), sketch.select("*", *one)) if one else (df, sketch)
    near = join_same(df, sketch, on)
    below = near.groupBy(*on).agg(F.count_if(F.col("_v") < F.col("_b")[0]).alias("_below"))
    counts = near.where((F.col("_v") >= F.col("_b")[0]) & (F.col("_v") <= F.col("_b")[1])).groupBy(*on, "_v", "_n").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*on).orderBy("_v"))
    counts = join_same(counts, below, on).withColumn("_upto", F.col("_below") + upto)
    return counts.where(F.col("_upto") > F.ceil(F.lit(q) * (F.col("_n") - 1))).groupBy(*on).agg(F.min("_v").alias("quantile")).drop("_one")


def cv_distances(rows: DataFrame, key: str, group: str, spectrum: str, k: int, alpha: float, folds: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Held-out distances: each row under the model of its class that was fitted without its fold's groups. ``folds``
    None leaves one group out at a time; otherwise groups are dealt to that many folds by hash. Columns: ``model`` (the
    class), ``fold``, ``keep``, h, q and the statistics of the fold's own limits.

    Only the classes' sums are shuffled as matrices. Folds of up to BUNDLE rows are fitted and scored in bundles of about as
    many rows of a class, where the rows themselves are the smaller form of what is taken off; larger folds have a model each."""
    keep = keep or []
    fold = F.col(group).cast("string") if folds is None else F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(folds)).cast("string")
    rows = rows.where(F.col(spectrum).isNotNull()).withColumns({"_class": F.col(key).cast("string"), "_fold": fold}).where("_class IS NOT NULL")
    rows = rows.withColumn("_fit", F.to_json(F.struct(F.col("_class").alias("c"), F.col("_fold").alias("f"))))
    # sums are taken about one mean of all rows, so that digits they have in common do not cancel
    centre = (mean_spectrum(rows, [], spectrum).first() or {"mean": []})["mean"]
    centre = F.array(*map(F.lit, centre)) if centre else F.array().cast("array<double>")
    shifted = F.zip_with(spectrum, centre, lambda x, c: x - c)
    total = materialize(grams(rows.select("_class", shifted.alias("_x")), "_class", "_x"), "class-grams").select(F.col("model").alias("_class"), F.col("n").alias("_n"), F.col("cells").alias("_all"))
    large = materialize(rows.groupBy("_fit").agg(F.count("*").alias("_rows")).where(F.col("_rows") > BUNDLE).select("_fit"), "large-folds")
    rows = rows.select("_fit", "_class", "_fold", *keep, shifted.alias("spectrum"))
    out = _bundled(rows.join(large, "_fit", "left_anti").drop("_fit"), total, k, alpha, keep)
    if large.isEmpty():
        return out
    rows = rows.join(large, "_fit", "left_semi")
    held = materialize(grams(rows, "_fit", "spectrum"), "held-grams").withColumn("_class", F.get_json_object("model", "$.c"))
    train = held.join(total, "_class").select("model", (F.col("_n") - F.col("n")).alias("n"), F.zip_with("_all", "cells", lambda a, b: a - b).alias("cells")).where(F.col("n") > k)
    models = materialize(train.groupBy("model").applyInPandas(_solve, MODEL), "fold-models")
    return out.unionByName(held_out(rows, models, k, alpha, keep))


def _bundled(rows: DataFrame, total: DataFrame, k: int, alpha: float, keep: list[str]) -> DataFrame:
    """Rows (``_class, _fold``, ``keep``, ``spectrum``) of small folds under the model of their class without their fold, with the
    columns of ``held_out``. ``total``: ``_class, _n, _all`` (rows, and sums and Gram matrix in one array) per class."""
    deal = total.withColumn("_bundles", F.ceil(F.col("_n") / BUNDLE).cast("long"))
    rows = rows.join(deal.select("_class", "_bundles"), "_class").withColumn("_bundle", F.pmod(F.xxhash64("_fold"), F.col("_bundles"))).drop("_bundles")
    deal = deal.select("_class", "_n", "_all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bundles") - 1)).alias("_bundle"))
    numbers = ["h", "q", "h0", "nh", "q0", "nq", "h_limit", "q_limit"]
    kept = ["_class", "_fold", *keep]
    schema = rows.select(*kept, *[F.lit(0.0).alias(c) for c in numbers]).schema

    def fit(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], f.type) for f in map(left.schema.field, kept)] + [pa.array([], pa.float64())] * len(numbers), names=[*kept, *numbers])
        spectra = left["spectrum"].combine_chunks()
        x = spectra.flatten().to_numpy(zero_copy_only=False).reshape(len(spectra), -1)
        cells, n, b = right["_all"].combine_chunks().flatten().to_numpy(zero_copy_only=False), right["_n"][0].as_py(), x.shape[1]
        codes = pd.factorize(left["_fold"].to_pandas(), use_na_sentinel=False)[0]
        order = np.argsort(codes, kind="stable")
        held = [at for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if n - len(at) > k]
        taken, found = [], []
        step = max(1, STACK // (8 * b * b))
        for first in range(0, len(held), step):
            some = held[first : first + step]
            m = n - np.array([float(len(at)) for at in some])
            mean = (cells[:b] - np.stack([x[at].sum(0) for at in some])) / m[:, None]
            gram = cells[b:].reshape(b, b) - np.stack([x[at].T @ x[at] for at in some])
            value, vector = np.linalg.eigh((gram - m[:, None, None] * mean[:, :, None] * mean[:, None, :]) / np.maximum(1, m - 1)[:, None, None])
            value, vector = np.maximum(value[:, ::-1], 0), vector[:, :, ::-1][:, :, :k]
            rest = np.where(value[:, k:] > EPS, value[:, k:], 0)
            q1, q2 = rest.sum(1), (rest * rest).sum(1)
            nq = np.where(q2 > 0, q1 * q1 / np.where(q2 > 0, q2, 1), float(max(b - k, 1)))
            h0, nh, q0 = k * (m - 1) / m, np.full(len(m), float(k)), np.maximum(q1, EPS)
            limits = np.stack([h0, nh, q0, nq, h0 / nh * chi2_inverse(1 - alpha, [float(k)])[0], q0 / nq * chi2_inverse(1 - alpha, nq)], 1)
            for i, at in enumerate(some):
                c = x[at] - mean[i]
                t = c @ vector[i]
                h = (t * t / np.maximum(value[i, :k], EPS)).sum(1)
                q = np.maximum(0, (c * c).sum(1) - (t * t).sum(1))
                taken.append(at)
                found.append(np.hstack([h[:, None], q[:, None], np.repeat(limits[i][None], len(at), 0)]))
        rows = left.select(kept).take(pa.array(np.concatenate(taken) if taken else np.zeros(0, int)))
        found = np.concatenate(found) if found else np.zeros((0, len(numbers)))
        return pa.table([*rows.columns, *[pa.array(found[:, j]) for j in range(len(numbers))]], names=[*kept, *numbers])

    return _statistics(rows.groupBy("_class", "_bundle").cogroup(deal.groupBy("_class", "_bundle")).applyInArrow(fit, schema), keep)


def held_out(rows: DataFrame, models: DataFrame, k: int, alpha: float, keep: list[str]) -> DataFrame:
    """Rows (``_fit, _class, _fold``, ``keep``, ``spectrum``) under the model of their ``_fit``, with the statistics of its limits."""
    rest = F.filter(F.slice("eigenvalues", k + 1, 1_000_000), lambda x: x > EPS)
    q1, q2 = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x), F.aggregate(rest, F.lit(0.0), lambda a, x: a + x * x)
    quantile = quantile_udf(1 - alpha)
    par = models.select("model", (k * (F.col("n") - 1) / F.col("n")).alias("h0"), F.lit(float(k)).alias("nh"), F.greatest(q1, F.lit(EPS)).alias("q0"), F.coalesce(F.try_divide(q1 * q1, q2), F.greatest(F.size("mean") - k, F.lit(1)).cast("double")).alias("nq"))
    par = materialize(par.withColumns({"h_limit": F.col("h0") / F.col("nh") * quantile("nh"), "q_limit": F.col("q0") / F.col("nq") * quantile("nq")}), "fold-limits")
    return _statistics(distances(rows, models, k, "spectrum", "_fit").join(par, "model"), keep)


def _statistics(scored: DataFrame, keep: list[str]) -> DataFrame:
    stats = statistics()
    return scored.select(F.col("_class").alias("model"), F.col("_fold").alias("fold"), *keep, "h", "q", stats["simple"].alias("simple_stat"), stats["sum"].alias("sum_stat"), stats["dd"].alias("dd_stat"))


_CV = {"H_emp_cv": "h", "Q_emp_cv": "q", "simple_emp_cv": "simple_stat", "alternative_chi2_emp_cv": "sum_stat", "combined_index_emp_cv": "sum_stat", "data_driven_emp_cv": "dd_stat"}


def cv_thresholds(cv: DataFrame, alpha: float) -> DataFrame:
    """One row per model: every empirical threshold, the "higher" quantile at 1 - alpha of its held-out statistic.
    ``cv`` should be a stored table."""
    q = 1 - alpha
    out = cv.groupBy("model").agg(F.count("*").alias("n_cv"), F.count_distinct("fold").alias("n_folds"))
    for column in ("h", "q", "simple_stat", "sum_stat", "dd_stat"):
        found = higher_quantiles(cv, ["model"], column, q)
        for name in [n for n, c in _CV.items() if c == column]:
            found = found.withColumn(name, F.col("quantile"))
        out = out.join(found.drop("quantile"), "model")
    out = materialize(out, "cv-thresholds")
    emp = cv.join(out.select("model", "H_emp_cv", "Q_emp_cv"), "model").withColumn("e", F.col("h") / F.greatest("H_emp_cv", F.lit(EPS)) + F.col("q") / F.greatest("Q_emp_cv", F.lit(EPS)))
    return out.join(higher_quantiles(emp, ["model"], "e", q).withColumnRenamed("quantile", "alternative_empHQ_emp_cv"), "model")


def cv_summary(cv: DataFrame, thresholds: DataFrame, alpha: float) -> DataFrame:
    """Per model and variant how often held-out target rows are rejected, against alpha; nearest first by order."""
    df = cv.join(thresholds, "model").withColumn("emp_stat", F.col("h") / F.greatest("H_emp_cv", F.lit(EPS)) + F.col("q") / F.greatest("Q_emp_cv", F.lit(EPS)))
    of = {"simple": "simple_stat", "sum": "sum_stat", "emp_sum": "emp_stat", "dd": "dd_stat"}
    rules = [(v, of[s], limit) for v, (s, limit) in VARIANTS.items() if not isinstance(limit, str) or limit not in LIMITS]
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("rule"), F.col(c).alias("statistic"), (F.col(x) if isinstance(x, str) else F.lit(x)).alias("limit")) for v, c, x in rules])).alias("r")
    out = df.select("model", cells).select("model", "r.*").groupBy("model", "rule").agg(F.max("limit").alias("limit"), F.count("*").alias("n"), F.count_if(F.col("statistic") >= F.col("limit")).alias("n_rejected"))
    rate = F.col("n_rejected") / F.col("n")
    return out.withColumns({"rejection_rate": rate, "expected_rejection_rate": F.lit(alpha), "abs_rejection_error": F.abs(rate - alpha)})


def train_thresholds(rows: DataFrame, key: str, spectrum: str, fits: DataFrame, k: int, alpha: float) -> DataFrame:
    """The thresholds of ``cv_thresholds`` from the training rows' own distances, without folds."""
    own = distances(rows.select(key, spectrum), fits, k, spectrum, key).join(fits.select("model", *LIMITS), "model")
    stats = statistics()
    cv = materialize(own.select("model", F.lit("train").alias("fold"), "h", "q", stats["simple"].alias("simple_stat"), stats["sum"].alias("sum_stat"), stats["dd"].alias("dd_stat")), "train-statistics")
    return cv_thresholds(cv, alpha)
