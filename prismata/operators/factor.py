"""Tall-skinny QR: triangles per task, merged in a tree.

Every task reduces its rows of a model to one upper triangle, and triangles are stacked and reduced again, FAN at a time, until
one is left per model; nothing but triangles of bands x bands is shuffled. A column of ones stands before the
spectra, so the triangle's first row holds count and mean, and the rest is the triangle of the centred rows: nothing is ever
squared, and a large common offset does not cancel the digits that differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.plans.shared import materialize

FAN = 16
TRIANGLE = "model string, part int, n long, width int, triangle array<double>"
RANK = "model string, n long, width int, rank int, centred_rank int, singular_values array<double>, pivots array<int>"


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def _square(r: pd.Series) -> np.ndarray:
    return np.asarray(r["triangle"], float).reshape(-1, int(r["width"]) + 1)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    widths = set(pdf["width"])
    if len(widths) > 1:
        raise ValueError(f"spectra of model {pdf['model'].iloc[0]} differ in length: {sorted(widths)}")
    tri = _stack([_square(r) for _, r in pdf.iterrows()])
    return pd.DataFrame([{"model": pdf["model"].iloc[0], "part": int(pdf["part"].iloc[0]), "n": int(pdf["n"].sum()), "width": widths.pop(), "triangle": tri.ravel().tolist()}])


def triangles(df: DataFrame, key: str, spectrum: str) -> DataFrame:
    """Rows of TRIANGLE: one per task and model. A task holds one triangle a model and an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str | None, int], list] = {}
        for batch in batches:
            names, col = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            width, flat = np.diff(col.offsets.to_numpy()), col.flatten().to_numpy(zero_copy_only=False)
            start = np.cumsum(width) - width
            codes, found = pd.factorize(names, use_na_sentinel=False)
            for c, name in enumerate(found):
                mine = np.flatnonzero(codes == c)
                for w in np.unique(width[mine]):
                    at = mine[width[mine] == w]
                    x = np.hstack([np.ones((len(at), 1)), flat[start[at][:, None] + np.arange(w)]])
                    h = held.setdefault((None if name is None or name != name else name, int(w)), [0, np.zeros((0, w + 1))])
                    h[0] += len(at)
                    h[1] = _stack([h[1], x])
        part = TaskContext.get().partitionId()
        for (name, w), (n, tri) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([part], pa.int32()), pa.array([n]), pa.array([w], pa.int32()), pa.array([tri.ravel().tolist()], pa.list_(pa.float64()))], names=["model", "part", "n", "width", "triangle"])

    rows = df.where(F.col(spectrum).isNotNull()).select(F.col(key).cast("string").alias("model"), F.col(spectrum).cast("array<double>").alias("s"))
    return rows.mapInArrow(run, TRIANGLE)


def merged(parts: DataFrame) -> DataFrame:
    """One row of TRIANGLE per model. ``parts`` is read once, so it should be stored if it is used again."""
    parts = materialize(parts, "triangles")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last > 0:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("model", "part").applyInPandas(_merge, TRIANGLE)
        last //= FAN
    return parts.groupBy("model").applyInPandas(_merge, TRIANGLE)


def factors(df: DataFrame, key: str, spectrum: str) -> DataFrame:
    """Stored rows of TRIANGLE per value of ``key``."""
    return materialize(merged(triangles(df, key, spectrum)), "factors")


def centred(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the rows and the triangle of the centred rows."""
    return tri[0, 1:] / tri[0, 0], tri[1:, 1:]


def eigen(tri: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, eigenvalues of the covariance (ddof 1), descending, and their vectors as rows. The largest entry of a vector
    is positive."""
    mean, rest = centred(tri)
    b = len(mean)
    if not len(rest):
        rest = np.zeros((1, b))
    _, s, v = np.linalg.svd(rest, full_matrices=True)
    value = np.zeros(b)
    value[: len(s)] = s * s / max(1, n - 1)
    sign = np.sign(v[np.arange(b), np.abs(v).argmax(1)])
    return mean, value, v * np.where(sign == 0, 1, sign)[:, None]


def pivoted(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """QR with column pivoting of a triangle: the order in which columns add most, and what each adds (its distance from the
    span of those before it)."""
    r = r.copy()
    b = r.shape[1]
    order, gains = np.arange(b), np.zeros(b)
    for k in range(min(r.shape)):
        size = (r[k:, k:] ** 2).sum(0)
        j = k + int(size.argmax())
        r[:, [k, j]], order[[k, j]] = r[:, [j, k]], order[[j, k]]
        x = r[k:, k].copy()
        gains[k] = math.sqrt(size[j - k])
        if gains[k] == 0:
            break
        x[0] += math.copysign(gains[k], x[0])
        r[k:, k:] -= np.outer(x, (2 / (x @ x)) * (x @ r[k:, k:]))
    return order, gains


def _rank(s: np.ndarray, n: int, b: int) -> int:
    return int((s > s.max(initial=0) * max(n, b) * np.finfo(float).eps).sum())


def ranks(stored: DataFrame) -> DataFrame:
    """Rows of RANK from rows of TRIANGLE: numerical rank of the spectra and of the centred ones (singular values above the
    largest, times the longer side, times the machine epsilon), singular values, and the bands in the order in which they add
    most. Ranks are NULL where a value is not finite."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            tri, n, b = _square(r), int(r["n"]), int(r["width"])
            row = {"model": r["model"], "n": n, "width": b, "rank": None, "centred_rank": None, "singular_values": None, "pivots": None}
            if np.isfinite(tri).all():
                s = np.linalg.svd(tri[:, 1:], compute_uv=False)[: min(n, b)]
                c = np.linalg.svd(tri[1:, 1:], compute_uv=False) if len(tri) > 1 else np.zeros(1)
                # what centring leaves of rows that are equal is as large as the rounding of the rows themselves
                least = s.max(initial=0) * max(n, b) * np.finfo(float).eps
                row |= {"rank": _rank(s, n, b), "centred_rank": int((c > least).sum()), "singular_values": s.tolist(), "pivots": pivoted(tri[:, 1:])[0].tolist()}
            out.append(row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in RANK.split(", ")])

    return stored.groupBy("model").applyInPandas(solve, RANK)


def independent_bands(stored: DataFrame) -> DataFrame:
    """``(model, band)``: bands that together span all others, as many as the rank."""
    return ranks(stored).select("model", F.explode(F.slice("pivots", F.lit(1), F.col("rank"))).alias("band"))
