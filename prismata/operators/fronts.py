"""Fronts of groups of any size: sorted block-nested skylines, and the front with tolerance in objective order.

With a tolerance, a vector a dominates b where a is nowhere worse by more than epsilon and somewhere better by more than
epsilon. This is not transitive, so the front depends on the order of arrival: vectors come in ascending order; one that a front
member dominates is dropped and drops nothing; otherwise it removes the members it dominates and joins.

Most vectors are decided before that walk, by blocks in parallel. A member of the exact front that no member dominates with
tolerance is *certain*: any vector that dominates it would be matched by a member of the exact front that is nowhere larger
and so dominates it too. A certain vector is thus never dropped nor removed, and every later vector that it dominates
is dropped when it comes, in any case: leaving it out changes nothing. The walk takes the rest in sorted blocks. A member whose
first objective is more than epsilon below a block's can be removed by nobody from there on, so such members decide
the whole block at once, and only the others are asked one by one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.plans.nulls import join_same
from prismata.plans.shared import materialize

SLICE, FAN, BLOCK, WIDE = 50_000, 16, 256, 4096


def _sorted(pdf: pd.DataFrame, goals: list[str]) -> pd.DataFrame:
    return pdf.sort_values(goals, kind="mergesort").reset_index(drop=True)


def _dominated(front: np.ndarray, x: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``x`` some row of ``front`` dominates."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), BLOCK):
        b = x[at : at + BLOCK]
        for to in range(0, len(front), WIDE):
            f = front[to : to + WIDE, None, :]
            out[at : at + BLOCK] |= ((f <= b + eps).all(2) & (f < b - eps).any(2)).any(0)
    return out


def exact(x: np.ndarray) -> np.ndarray:
    """Places of the vectors of ``x`` (distinct, in ascending order) that none dominates: no vector dominates an earlier one."""
    kept = np.zeros(0, np.int64)
    for at in range(0, len(x), BLOCK):
        own = np.arange(at, min(at + BLOCK, len(x)))
        own = own[~_dominated(x[kept], x[own], 0.0)]
        kept = np.r_[kept, own[~_dominated(x[own], x[own], 0.0)]]
    return kept


def walk(x: np.ndarray, eps: float) -> np.ndarray:
    """Places of the front with tolerance of vectors in ascending order."""
    settled, active = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(x), BLOCK):
        own = np.arange(at, min(at + BLOCK, len(x)))
        done = ~(x[at, 0] <= x[active, 0] + eps)
        settled, active = np.r_[settled, active[done]], active[~done]
        for i in own[~_dominated(x[settled], x[own], eps)]:
            a, c = x[active], x[i]
            if ((a <= c + eps).all(1) & (a < c - eps).any(1)).any():
                continue
            active = np.r_[active[~((c <= a + eps).all(1) & (c < a - eps).any(1))], i]
    return np.sort(np.r_[settled, active])


def _vectors(df: DataFrame, by: list[str], minimise: list[str], maximise: list[str]) -> tuple[DataFrame, list[str]]:
    """Distinct objective vectors per group, all to be made small, in columns ``g0`` on; one that is not finite is an error."""
    goals = [*[F.col(c).cast("double") for c in minimise], *[-F.col(c).cast("double") for c in maximise]]
    broken = reduce(lambda a, b: a | b, [g.isNull() | F.isnan(g) | (F.abs(g) == float("inf")) for g in goals])
    names = [f"g{i}" for i in range(len(goals))]
    checked = [F.when(broken, F.raise_error(F.lit("an objective is not finite"))).otherwise(g + 0.0) for g in goals]  # + 0.0: one zero
    return df.select(*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)], F.lit(0).alias("_all"), *[g.alias(n) for g, n in zip(checked, names, strict=True)]).distinct(), names


def _skyline(vectors: DataFrame, keys: list[str], goals: list[str], n: int) -> DataFrame:
    """The exact front per group: fronts of slices, merged FAN at a time."""
    schema = vectors.schema

    def front(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf, goals)
        return pdf.iloc[exact(pdf[goals].to_numpy(float))][list(schema.names)]

    slices = -(-n // SLICE)
    df = vectors
    while slices > 1:
        df = df.withColumn("_slice", F.pmod(F.xxhash64(*goals), F.lit(slices))).groupBy(*keys, "_slice").applyInPandas(lambda p: front(p.drop(columns="_slice")), schema)
        slices //= FAN
    return df.groupBy(*keys).applyInPandas(front, schema)


def epsilon_front(df: DataFrame, by: list[str], minimise: list[str], epsilon: float, maximise: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` on the front with tolerance of their group; equal rows stay together, NULL is a group."""
    if epsilon < 0:
        raise ValueError("a tolerance is not negative")
    vectors, goals = _vectors(df, by, minimise, maximise or [])
    keys = ["_all", *[f"b{i}" for i in range(len(by))]]
    vectors = materialize(vectors, "front-vectors")
    schema, n = vectors.schema, vectors.count()

    def certain(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[goals].to_numpy(float)
        return pdf[~_dominated(x, x, epsilon)]

    def undecided(rows: pd.DataFrame, sure: pd.DataFrame) -> pd.DataFrame:
        rows = _sorted(rows.drop(columns="_slice"), goals)
        x, a = rows[goals].to_numpy(float), _sorted(sure, goals)[goals].to_numpy(float)
        gone = np.zeros(len(x), bool)
        both = np.vstack([a, x]) if len(a) else x
        # how many certain vectors come before each row
        place = np.lexsort(both.T[::-1])
        before = np.empty(len(both), np.int64)
        before[place] = np.cumsum(place < len(a))
        before = before[len(a) :] if len(a) else np.zeros(len(x), np.int64)
        for k in np.unique(before[before > 0]):
            mine = np.flatnonzero(before == k)
            gone[mine] = _dominated(a[:k], x[mine], epsilon)
        return rows[~gone][list(schema.names)]

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf, goals)
        return pdf.iloc[walk(pdf[goals].to_numpy(float), epsilon)][list(schema.names)]

    sure = materialize(_skyline(vectors, keys, goals, n).groupBy(*keys).applyInPandas(certain, schema), "front-certain")
    slices = max(1, -(-n // SLICE))
    sliced = vectors.withColumn("_slice", F.pmod(F.xxhash64(*goals), F.lit(slices)))
    each = sure.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    left = sliced.groupBy(*keys, "_slice").cogroup(each.groupBy(*keys, "_slice")).applyInPandas(undecided, schema)
    front = left.groupBy(*keys).applyInPandas(last, schema)
    sign = [*[F.col(c).cast("double") + 0.0 for c in minimise], *[-F.col(c).cast("double") + 0.0 for c in maximise or []]]
    named = df.withColumns({f"_g{i}": s for i, s in enumerate(sign)})
    found = front.select(*[F.col(f"b{i}").alias(c) for i, c in enumerate(by)], *[F.col(g).alias(f"_{g}") for g in goals])
    return join_same(named, found, [*by, *[f"_{g}" for g in goals]], "left_semi").drop(*[f"_{g}" for g in goals])
