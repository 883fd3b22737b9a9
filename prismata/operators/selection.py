"""Fronts, orderings and choices among candidate rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pareto_front(df: DataFrame, by: list[str], minimise: list[str], maximise: list[str] | None = None) -> DataFrame:
    """Rows that no row of their group dominates; equal rows stay together. Dominance runs between distinct objective
    vectors, and first within slices of a group: what a slice prunes cannot be on the front."""
    goals = [*minimise, *(maximise or [])]
    sign = {**dict.fromkeys(minimise, 1), **dict.fromkeys(maximise or [], -1)}

    def survivors(vectors: DataFrame, keys: list[str]) -> DataFrame:
        other = vectors.select(*[F.col(c).alias(f"_o_{c}") for c in vectors.columns])
        same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
        no_worse = [F.col(f"_o_{g}") * sign[g] <= F.col(g) * sign[g] for g in goals]
        better = reduce(lambda a, b: a | b, [F.col(f"_o_{g}") * sign[g] < F.col(g) * sign[g] for g in goals])
        return vectors.join(other, reduce(lambda a, b: a & b, [*same, *no_worse]) & better, "left_anti")

    vectors = df.select(*by, *goals).distinct().withColumn("_slice", F.pmod(F.xxhash64(*goals), F.lit(32)))
    front = survivors(survivors(vectors, [*by, "_slice"]).drop("_slice"), by)
    keep = front.select(*[F.col(c).alias(f"_f_{c}") for c in front.columns])
    return df.join(keep, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in [*by, *goals]]), "left_semi")


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; ``order`` must end in a unique key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).withColumnRenamed("_r", "rank")


def lexicographic(df: DataFrame, by: list[str], priority: list[tuple[str, bool, float]], key: str) -> DataFrame:
    """Per group keep what is within a tolerance of the best, metric by metric (name, ascending, tolerance); the
    smallest key left is primary, the others are its equivalents."""
    w = Window.partitionBy(*by)
    for metric, ascending, tolerance in priority:
        best = F.min(metric).over(w) if ascending else F.max(metric).over(w)
        within = F.col(metric) <= best + tolerance if ascending else F.col(metric) >= best - tolerance
        df = df.withColumn("_ok", within).where("_ok").drop("_ok")
    return df.withColumn("role", F.when(F.col(key) == F.min(key).over(w), "primary").otherwise("equivalent"))


def deduplicate(df: DataFrame, key: list[str], order: str, source: str) -> DataFrame:
    """One row per key: the first by order, all sources sorted, and the count."""
    return df.groupBy(*key).agg(F.min_by(source, order).alias("first_source"), F.array_join(F.array_sort(F.collect_set(source)), ";").alias("sources"), F.count("*").alias("n_rows"))


def duplicate_groups(df: DataFrame, signature: list[str], key: str) -> DataFrame:
    """Rows of equal rounded values share a representative, the smallest key; one column each of group size and it."""
    w = Window.partitionBy(*signature)
    return df.withColumns({"representative": F.min(key).over(w), "group_size": F.count("*").over(w)})


def parameter_tendencies(df: DataFrame, family: str, order: list, parameters: list[str], fraction: float = 0.15, least: int = 20) -> DataFrame:
    """How often each parameter value occurs among the best rows of each family."""
    ranked = df.withColumns({"_r": F.row_number().over(Window.partitionBy(family).orderBy(*order)), "_n": F.count("*").over(Window.partitionBy(family))})
    top = ranked.where(F.col("_r") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * fraction)))
    long = top.select(family, *[F.col(p).cast("string").alias(p) for p in parameters]).unpivot([family], parameters, "parameter", "value")
    return long.groupBy(family, "parameter", "value").agg(F.count("*").alias("n"))


def factor_summary(df: DataFrame, factors: list[str], metric: str) -> DataFrame:
    """mean, median, deviation (ddof 0), least and largest value of a metric per factor value."""
    long = df.select(*[F.col(f).cast("string").alias(f) for f in factors], metric).unpivot([metric], factors, "factor", "value")
    return long.groupBy("factor", "value").agg(F.avg(metric).alias("mean"), F.percentile(metric, 0.5).alias("median"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("least"), F.max(metric).alias("largest"), F.count(metric).alias("n"))
