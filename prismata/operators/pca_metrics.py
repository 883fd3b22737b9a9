"""Diagnostics of PCA scores and loadings. Scores are an array column of which the first ``k`` count; per group only sums
of k values and their squares are shuffled."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.plans.nulls import join_same

UNNAMED = ("None", "nan", "unknown")


def _named(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.col(group).isNotNull() & ~F.col(group).cast("string").isin(*UNNAMED))


def _means(k: int, scores: str = "scores") -> list[Column]:
    return [F.avg(F.col(scores)[i]).alias(f"m{i}") for i in range(k)]


def _variances(k: int, scores: str = "scores") -> Column:
    """Trace of the covariance (ddof 1); 0 for a single row."""
    return F.coalesce(reduce(lambda a, b: a + b, [F.var_samp(F.col(scores)[i]) for i in range(k)]), F.lit(0.0))


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def reconstruct(df: DataFrame, mean: list[float], loadings: list[list[float]], scores: str = "scores") -> DataFrame:
    """``reconstruction``: the spectrum that the scores stand for. Mean and loadings are parameter-sized."""
    back = F.aggregate(F.arrays_zip(F.col(scores).alias("t"), F.array(*[F.array(*map(F.lit, p)) for p in loadings]).alias("p")), F.array(*map(F.lit, mean)), lambda acc, x: F.zip_with(acc, F.transform(x["p"], lambda v: v * x["t"]), lambda a, b: a + b))
    return df.withColumn("reconstruction", back)


def hotelling(scores: Column, variances: list[float], eps: float = 1e-12) -> Column:
    v = F.array(*[F.lit(max(float(x), eps)) for x in variances])
    return F.aggregate(F.zip_with(F.slice(scores, 1, len(variances)), v, lambda t, x: t * t / x), F.lit(0.0), lambda a, x: a + x)


def class_separation(df: DataFrame, label: str, k: int = 3, scores: str = "scores", reg: float = 1e-6) -> DataFrame:
    """One row: centroid distances on 2 and 3 components, Fisher ratio per component, and the regularised Mahalanobis
    distance of the centroids; all NULL unless there are two classes. Only means and co-moments leave the executors."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"), *_means(k, scores), *[F.covar_samp(F.col(scores)[i], F.col(scores)[j]).alias(f"c{i}{j}") for i, j in pairs])
    names = ["centroid_distance_2", "centroid_distance_3", *[f"fisher_{i + 1}" for i in range(3)], "mahalanobis_2", "mahalanobis_3"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = dict.fromkeys(names)
        if len(pdf) == 2:
            a, b = (r for _, r in pdf.sort_values("label").iterrows())
            gap = np.array([a[f"m{i}"] - b[f"m{i}"] for i in range(k)])
            cov = [np.array([[r[f"c{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)], float) for r in (a, b)]
            for c in (2, 3):
                if k >= c:
                    out[f"centroid_distance_{c}"] = float(np.linalg.norm(gap[:c]))
                    if a["n"] > 1 and b["n"] > 1:
                        pooled = ((a["n"] - 1) * cov[0] + (b["n"] - 1) * cov[1])[:c, :c] / max(a["n"] + b["n"] - 2, 1) + reg * np.eye(c)
                        out[f"mahalanobis_{c}"] = float(np.sqrt(max(gap[:c] @ np.linalg.pinv(pooled) @ gap[:c], 0)))
            for i in range(min(3, k)):
                out[f"fisher_{i + 1}"] = float(gap[i] ** 2 / (np.nan_to_num(cov[0][i, i]) + np.nan_to_num(cov[1][i, i]) + 1e-12))
        return pd.DataFrame([out], columns=names).astype(float)

    return moments.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, ", ".join(f"{n} double" for n in names))  # one row a class


def trace_ratio(df: DataFrame, group: str, k: int = 3, scores: str = "scores", eps: float = 1e-12) -> DataFrame:
    """One row: between over within sum of squares; NULL with fewer than two groups or rows."""
    per = _named(df, group).groupBy(group).agg(F.count("*").alias("n"), *_means(k, scores), (F.coalesce(reduce(lambda a, b: a + b, [F.var_pop(F.col(scores)[i]) for i in range(k)]), F.lit(0.0)) * F.count("*")).alias("within"))
    total = F.sum("n")
    between = reduce(lambda a, b: a + b, [F.sum(F.col("n") * F.col(f"m{i}") * F.col(f"m{i}")) - F.sum(F.col("n") * F.col(f"m{i}")) * F.sum(F.col("n") * F.col(f"m{i}")) / total for i in range(k)])
    return per.agg(F.when((F.count("*") >= 2) & (total >= 2), between / (F.sum("within") + eps)).alias("trace_ratio"), F.count("*").alias("n_groups"))


def compactness(df: DataFrame, group: str, k: int = 3, scores: str = "scores") -> DataFrame:
    """One row: means over groups of the within trace and of the mean and 95 % distance to the centroid."""
    df = _named(df, group)
    centre = df.groupBy(group).agg(*_means(k, scores), _variances(k, scores).alias("trace"))
    d = df.join(centre, group).withColumn("d", _norm([F.col(scores)[i] - F.col(f"m{i}") for i in range(k)]))
    per = d.groupBy(group).agg(F.first("trace").alias("trace"), F.avg("d").alias("mean"), F.percentile("d", 0.95).alias("q95"))
    return per.agg(F.avg("trace").alias("within_class_trace"), F.avg("mean").alias("mean_distance_to_class_centroid"), F.avg("q95").alias("q95_distance_to_class_centroid"))


def displacements(df: DataFrame, group: str, k: int = 3, scores: str = "scores") -> DataFrame:
    df = _named(df, group)
    whole = df.agg(*[F.avg(F.col(scores)[i]).alias(f"g{i}") for i in range(k)])  # one row
    return df.groupBy(group).agg(*_means(k, scores)).crossJoin(F.broadcast(whole)).select(group, _norm([F.col(f"m{i}") - F.col(f"g{i}") for i in range(k)]).alias("centroid_shift"))


def distance_summary(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    return df.agg(*[x for c in columns for x in (F.avg(c).alias(f"{prefix}_{c}_mean"), F.percentile(c, 0.5).alias(f"{prefix}_{c}_median"), F.percentile(c, 0.95).alias(f"{prefix}_{c}_q95"))])


def projection_shift(train: DataFrame, projected: DataFrame, label: str, k: int = 3, scores: str = "scores", eps: float = 1e-12) -> DataFrame:
    """One row: mean and largest centroid shift over shared labels, plain and over the square root of the train trace."""
    t = train.groupBy(label).agg(*_means(k, scores), F.count("*").alias("n"), _variances(k, scores).alias("trace"))
    p = projected.groupBy(label).agg(*[F.avg(F.col(scores)[i]).alias(f"p{i}") for i in range(k)])
    d = join_same(t, p, [label]).withColumn("shift", _norm([F.col(f"m{i}") - F.col(f"p{i}") for i in range(k)]))
    norm = F.col("shift") / (F.when(F.col("n") > 1, F.sqrt("trace")).otherwise(eps) + eps)
    return d.agg(F.avg("shift").alias("mean_shift"), F.max("shift").alias("max_shift"), F.avg(norm).alias("mean_shift_norm"), F.max(norm).alias("max_shift_norm"))


def object_scores(df: DataFrame, keys: list[str], k: int = 3, scores: str = "scores") -> DataFrame:
    """One row per object: mean scores (array) and the trace within it."""
    return df.groupBy(*keys).agg(F.array(*[F.avg(F.col(scores)[i]) for i in range(k)]).alias(scores), F.when(F.count("*") > 1, _variances(k, scores)).alias("trace"), F.count("*").alias("n_pixels"))


def object_metrics(df: DataFrame, item: str, label: str, batch: str, k: int = 3, scores: str = "scores", eps: float = 1e-12) -> DataFrame:
    """One row: trace ratios of objects by class and batch, the mean trace within objects, and that between over it."""
    objects = object_scores(df, [item, label, batch], k, scores)
    intra = object_scores(df, [item], k, scores).agg(F.avg("trace").alias("mean_intra_object_trace"))
    between = objects.agg(_variances(k, scores).alias("_b"))
    one = trace_ratio(objects, label, k, scores, eps).select(F.col("trace_ratio").alias("object_class_trace_ratio")).crossJoin(trace_ratio(objects, batch, k, scores, eps).select(F.col("trace_ratio").alias("object_batch_trace_ratio")))
    return one.crossJoin(intra).crossJoin(between).withColumn("object_over_intra_ratio", F.col("_b") / (F.col("mean_intra_object_trace") + eps)).drop("_b")  # one row each


def summary(train: DataFrame, projected: DataFrame, label: str, item: str, batch: str, k: int = 3, scores: str = "scores") -> DataFrame:
    """One wide row of all of the above for a model's train and projected rows; both have ``q``."""
    parts = [class_separation(train, label, k, scores), trace_ratio(train, label, k, scores).select(F.col("trace_ratio").alias("class_trace_ratio")), compactness(train, label, k, scores), projection_shift(train, projected, label, k, scores), object_metrics(train, item, label, batch, k, scores), distance_summary(train, ["q"], "train"), distance_summary(projected, ["q"], "projection")]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return one.withColumn("projection_q_deviation", F.abs(F.try_divide("projection_q_mean", "train_q_mean") - 1))


def loading_stability(models: DataFrame, candidate: str, run: str, k: int) -> DataFrame:
    """``models(candidate, run, loadings)``: every run of a candidate against its first: per component the correlation
    and angle without sign, and of the subspaces the mean squared cosine and largest principal angle. A task holds one
    candidate's loadings, k vectors a run."""
    schema = f"{candidate} string, {run} string, component int, loading_abs_correlation double, loading_angle_deg double, subspace_similarity double, max_principal_angle_deg double"

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(run)
        ref = np.array(pdf.iloc[0]["loadings"].tolist(), float)[:k]
        out = []
        for _, r in pdf.iterrows():
            cur = np.array(r["loadings"].tolist(), float)[:k]
            cos = np.clip(np.linalg.svd(np.linalg.qr(ref.T)[0].T @ np.linalg.qr(cur.T)[0], compute_uv=False), 0, 1)
            cos[np.isclose(cos, 1, atol=1e-12)] = 1
            for i, (a, b) in enumerate(zip(ref, cur, strict=True)):
                c = abs(float(np.corrcoef(a, b)[0, 1]))
                angle = np.degrees(np.arccos(np.clip(abs(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), 0, 1)))
                out.append((r[candidate], r[run], i + 1, c, float(angle), float((cos**2).mean()), float(np.degrees(np.arccos(cos)).max())))
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return models.select(F.col(candidate).cast("string").alias(candidate), F.col(run).cast("string").alias(run), F.slice("loadings", 1, k).alias("loadings")).groupBy(candidate).applyInPandas(compare, schema)


def candidate_plan(matrices: DataFrame, chains: DataFrame, feasible: DataFrame, window: int) -> DataFrame:
    """Accepted matrices with accepted chains and feasible samplings. Matrix ids name m and strategy
    (``..._m<m>_<strategy>``); chains with a Savitzky-Golay step count only at the chosen window."""
    m = matrices.where("status = 'accepted'").select("matrix_id", F.regexp_extract("matrix_id", r"_m(\d+)_", 1).try_cast("int").alias("m"), F.nullif(F.regexp_extract("matrix_id", r"_m\d+_(\w+)$", 1), F.lit("")).alias("strategy"))
    c = chains.where((F.col("status") == "accepted") & (~F.col("chain").contains("sg_") | (F.col("window") == window))).select("chain").distinct()
    ok = feasible.where("status = 'accepted'").select(F.col("m").alias("_m"), F.col("strategy").alias("_s")).distinct()
    plan = m.join(ok, (F.col("m") == F.col("_m")) & (F.col("strategy") == F.col("_s")), "left").where("m IS NULL OR _m IS NOT NULL").drop("_m", "_s")
    return plan.crossJoin(F.broadcast(c)).withColumn("candidate_id", F.concat(F.lit("pca_"), F.substring(F.sha2(F.to_json(F.struct("matrix_id", "chain")), 256), 1, 20)))  # chains are a catalogue
