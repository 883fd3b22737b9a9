"""Splits, leakage, domain shift, seed stability and influence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.plans.nulls import join_same


def split_leakage(df: DataFrame, group: str, role: str) -> DataFrame:
    """Groups that occur in more than one role; empty when the split is clean."""
    return df.groupBy(group).agg(F.count_distinct(role).alias("n_roles"), F.count("*").alias("n_rows")).where("n_roles > 1")


def split_diagnostics(df: DataFrame, by: list[str], item: str, image: str, area: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(item).alias("n_objects"), F.count_distinct(image).alias("n_images"), F.min(area).alias("least_area"), F.percentile(area, 0.5).alias("median_area"), F.max(area).alias("largest_area"))


def size_bins(df: DataFrame, by: list[str], order: list, n_bins: int) -> DataFrame:
    """Quantile bins of the first-come rank: edges at linear quantiles of the ranks, the lowest rank included."""
    w = Window.partitionBy(*by)
    df = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return df.withColumn("size_bin", F.greatest(F.lit(0), F.ceil((F.col("_r") - 1) * n_bins / F.greatest(F.col("_n") - 1, F.lit(1))) - 1).cast("int")).drop("_r", "_n")


def fold_assignment(groups: DataFrame, n_folds: int, group: str, label: str, n: str, seed: int = 1, tries: int = 64) -> DataFrame:
    """Whole groups to folds: seeded candidate assignments are rows, scored by missing classes, then by the range of
    object counts; the best one stays. Groups times tries rows, tries being a parameter."""
    tried = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
    tried = tried.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy("try", label).orderBy(F.xxhash64(F.lit(seed), "try", group), group)), F.lit(n_folds)))
    cells = tried.groupBy("try", "fold").agg(F.count_distinct(label).alias("k"), F.sum(n).alias("n"))
    scores = cells.groupBy("try").agg((-F.sum("k")).alias("missing"), (F.max("n") - F.min("n")).alias("spread"))
    best = scores.agg(F.min(F.struct("missing", "spread", "try")).alias("b")).select("b.try")
    return tried.join(F.broadcast(best), "try").select(group, label, n, "fold")  # one row


def domain_shift(df: DataFrame, role: str, by: list[str], columns: list[str]) -> DataFrame:
    """Standardised mean shift of the projection rows against the train rows; a zero deviation gives 0 or an infinity."""
    t, p = F.col(role) == "train", F.col(role) == "projection"
    aggs = [x for c in columns for x in (F.avg(F.when(t, F.col(c))).alias(f"{c}_mean"), F.stddev_samp(F.when(t, F.col(c))).alias(f"{c}_sd"), F.avg(F.when(p, F.col(c))).alias(f"{c}_projection"))]
    out = df.groupBy(*by).agg(*aggs)
    for c in columns:
        d = F.col(f"{c}_projection") - F.col(f"{c}_mean")
        z = F.when(F.col(f"{c}_sd") > 0, d / F.nullif(f"{c}_sd", F.lit(0.0))).when(d == 0, 0.0).when(d > 0, float("inf")).when(d < 0, float("-inf"))
        out = out.withColumn(f"{c}_shift", z)
    return out


def eligibility(df: DataFrame, by: list[str], shift: str, warn: float = 1.5, unsupported: float = 3.0) -> DataFrame:
    out = df.groupBy(*by).agg(F.max(F.abs(shift)).alias("worst"))
    return out.withColumn("status", F.when(F.col("worst").isNull(), "not_estimable").when(F.col("worst") > unsupported, "unsupported").when(F.col("worst") > warn, "warning").otherwise("eligible"))


def seed_statistics(df: DataFrame, model: str, metric: Column, seed: str, worst_is_high: bool = True) -> DataFrame:
    per = df.groupBy(model, seed).agg(metric.alias("value"))
    out = per.groupBy(model).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("largest"), F.count("*").alias("n_seeds"))
    return out.withColumn("worst", F.col("largest") if worst_is_high else F.col("least"))


def seed_disagreement(df: DataFrame, model: str, entity: str, seed: str, decision: str, n_seeds: int) -> DataFrame:
    """Share of entities, seen under every seed, whose decision changes between seeds."""
    per = df.groupBy(model, entity).agg(F.count_distinct(seed).alias("s"), F.count_distinct(decision).alias("d")).where(F.col("s") == n_seeds)
    return per.groupBy(model).agg(F.avg((F.col("d") > 1).cast("double")).alias("disagreement"), F.count("*").alias("n_entities"))


def leave_one_out(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean without each row in turn, from the group's sum: no second pass."""
    w = Window.partitionBy(*by)
    total, n = F.sum(value).over(w), F.count(value).over(w)
    df = df.withColumns({"left_out_mean": F.try_divide(total - F.col(value), n - 1), "full_mean": total / n})
    return df.withColumn("influence", F.col("left_out_mean") - F.col("full_mean"))


def risk_coverage(df: DataFrame, by: list[str], confidence: str, grid: list[float]) -> DataFrame:
    """At each coverage the error rate of the most confident rows, with the threshold that gives it."""
    cuts = df.groupBy(*by).agg(F.percentile(confidence, F.array(*[F.lit(1 - g) for g in grid])).alias("q"))
    cuts = cuts.select(*by, F.posexplode("q").alias("i", "threshold")).withColumn("coverage", F.element_at(F.array(*map(F.lit, grid)), F.col("i") + 1)).drop("i")
    kept = join_same(df, cuts, by).where(F.col(confidence) >= F.col("threshold"))
    return kept.groupBy(*by, "coverage").agg(F.count("*").alias("n"), F.avg((F.col("truth") != F.col("prediction")).cast("double")).alias("risk"))
