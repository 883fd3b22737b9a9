"""Column functions on a spectrum, an ``array<double>`` column. All of them stay in the JVM, one pass per spectrum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(s: Column, f=lambda x: x) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def validity_reason(s: Column, atol: float = 1e-12) -> Column:
    """valid, non_finite_spectrum, all_zero_spectrum or nonpositive_reflectance; the first that holds of the last three."""
    return (
        F.when(F.exists(s, lambda x: ~finite(x)), "non_finite_spectrum")
        .when(F.forall(s, lambda x: F.abs(x) <= atol), "all_zero_spectrum")
        .when(F.exists(s, lambda x: x <= 0), "nonpositive_reflectance")
        .otherwise("valid")
    )


def absorbance(s: Column, eps: float | None = None) -> Column:
    """log10(1 / R); with ``eps`` values below it are clipped first."""
    return F.transform(s, lambda r: -F.log10(F.greatest(r, F.lit(eps)) if eps is not None else r))


def snv(s: Column, eps: float = 1e-12) -> Column:
    """(x - mean) / standard deviation with ddof 1; a deviation below eps counts as 1."""
    n = F.size(s)
    mean = _sum(s) / n
    both = F.aggregate(F.array(mean), F.lit(None).cast("struct<m:double,sd:double>"), lambda a, m: F.struct(m.alias("m"), F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + (x - m) * (x - m)) / (n - 1)).alias("sd")))
    return F.flatten(F.transform(F.array(both), lambda b: F.transform(s, lambda x: (x - b["m"]) / F.when(b["sd"] < eps, 1.0).otherwise(b["sd"]))))


def l2_normalise(s: Column, eps: float = 1e-12) -> Column:
    return F.flatten(F.transform(F.array(F.sqrt(_sum(s, lambda x: x * x))), lambda n: F.transform(s, lambda x: x / F.when(n < eps, 1.0).otherwise(n))))


def msc(s: Column, reference: Column, eps: float = 1e-12) -> Column:
    """Remove offset and slope of the least-squares line on the reference spectrum; a slope near 0 counts as 1."""
    n = F.size(s)
    means = F.struct((_sum(s) / n).alias("ms"), (_sum(reference) / n).alias("mr"))
    line = F.transform(
        F.array(means),
        lambda m: F.struct(
            m["ms"].alias("ms"),
            m["mr"].alias("mr"),
            (F.aggregate(F.zip_with(s, reference, lambda x, r: (x - m["ms"]) * (r - m["mr"])), F.lit(0.0), lambda a, x: a + x) / F.aggregate(reference, F.lit(0.0), lambda a, r: a + (r - m["mr"]) * (r - m["mr"]))).alias("b"),
        ),
    )
    slope = F.transform(line, lambda p: F.struct(p["ms"].alias("ms"), p["mr"].alias("mr"), F.when(F.abs(p["b"]) < eps, 1.0).otherwise(p["b"]).alias("b")))
    return F.flatten(F.transform(slope, lambda p: F.transform(s, lambda x: (x - (p["ms"] - p["b"] * p["mr"])) / p["b"])))


def savgol_matrix(bands: int, window: int, order: int, deriv: int = 0, delta: float = 1.0) -> np.ndarray:
    """The fixed linear operator of a Savitzky-Golay filter; near the edges the outermost polynomial is evaluated."""
    if window % 2 == 0 or window < 5 or order >= window or deriv not in (0, 1, 2) or window > bands:
        raise ValueError("window must be odd, at least 5 and at most the bands; order below it; deriv 0, 1 or 2")
    half = window // 2
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))
    out = np.zeros((bands, bands))
    for i in range(bands):
        centre = min(max(i, half), bands - 1 - half)
        x = i - centre
        powers = np.zeros(order + 1)
        for p in range(deriv, order + 1):
            powers[p] = np.prod(np.arange(p, p - deriv, -1)) * float(x) ** (p - deriv)
        out[i, centre - half : centre + half + 1] = powers @ fit / delta**deriv
    return out


def apply_matrix(s: Column, m: np.ndarray) -> Column:
    """``m @ s`` for a matrix as small as the bands, given as literals; each row keeps its non-zero stretch."""
    rows = []
    for r in m:
        nz = np.flatnonzero(np.abs(r) > 0)
        lo, hi = (int(nz[0]), int(nz[-1]) + 1) if len(nz) else (0, 1)
        weights = F.array(*[F.lit(float(x)) for x in r[lo:hi]])
        rows.append(F.aggregate(F.zip_with(F.slice(s, lo + 1, hi - lo), weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x))
    return F.array(*rows)


def centre(s: Column, mean: Column) -> Column:
    return F.zip_with(s, mean, lambda x, m: x - m)


def wavelength_axis(start: float, end: float, bands: int, first: int = 0, stop: int = 0) -> list[float]:
    """linspace of the raw bands, trimmed at both ends."""
    return [start + i * (end - start) / (bands - 1) for i in range(bands)][first : bands - stop]


def window(s: Column, axis: list[float], low: float, high: float, inclusive: bool = True) -> Column:
    """The bands inside a wavelength window; an empty window is an error."""
    keep = [i for i, w in enumerate(axis) if (low <= w <= high if inclusive else low < w < high)]
    if not keep:
        raise ValueError("no band in the window")
    return F.slice(s, keep[0] + 1, len(keep))


def trim(s: Column, bands: int, first: int, stop: int) -> Column:
    """The bands without the first and last ones; none left is an error."""
    if bands - first - stop < 1:
        raise ValueError("no band is left")
    return F.slice(s, first + 1, bands - first - stop)
