"""Whether a track may be used on projected data: shifts and rates of its diagnostics against predeclared limits, with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.plans.nulls import join_same

SATISFIED, MISSING, SUPPORT = "all_predeclared_limits_satisfied", "no_diagnostics", "insufficient_target_support"


def eligibility(diagnostics: DataFrame, tracks: DataFrame, track: str, shifts: list[str], rates: list[str], limits: dict[str, tuple[float, float]], supported: str) -> DataFrame:
    """One row per track of ``tracks``: number of diagnostics, the largest absolute value over its ``shifts`` columns
    (``standardized_shift``) and the largest of each of its ``rates``, ``status`` and ``reasons`` (joined by semicolons).

    ``limits`` gives the warning and the unsupported bound of ``standardized_shift`` and of each rate; what is above a bound
    counts. Only rows with ``supported`` true give values; another row makes its track unsupported, as does a value that is
    NULL, NaN or infinite, and a track without a diagnostic."""
    names = ["standardized_shift", *rates]
    if set(names) != set(limits):
        raise ValueError(f"limits are needed for {names}")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ok = F.coalesce(F.col(supported), F.lit(False))
    widest = F.greatest(*[F.abs(c) for c in shifts]) if len(shifts) > 1 else F.abs(shifts[0])
    every = F.forall(F.array(*[F.struct(finite(c).alias("f")) for c in shifts]), lambda x: x["f"])
    held = {"standardized_shift": (F.when(every, widest), every), **{r: (F.when(finite(r), F.col(r)), finite(r)) for r in rates}}
    aggs = [F.count("*").alias("n_diagnostics"), F.count_if(ok).alias("_n_ok")]
    for n, (value, good) in held.items():
        aggs += [F.max(F.when(ok, value)).alias(f"_m_{n}"), F.count_if(ok & ~good).alias(f"_b_{n}")]
    out = join_same(tracks.select(track).distinct(), diagnostics.groupBy(track).agg(*aggs), [track], "left").fillna(0, ["n_diagnostics", "_n_ok"])
    bad, warn = [F.when(F.col("_n_ok") < F.col("n_diagnostics"), F.lit(SUPPORT))], []
    for n in names:
        unknown = (F.coalesce(F.col(f"_b_{n}"), F.lit(0)) > 0) | F.col(f"_m_{n}").isNull()
        out = out.withColumn(f"max_{n}", F.when(~unknown, F.col(f"_m_{n}")))
        bad.append(F.when(unknown, F.lit(f"{n}_not_finite")).when(F.col(f"_m_{n}") > limits[n][1], F.lit(n)))
        warn.append(F.when(~unknown & (F.col(f"_m_{n}") > limits[n][0]) & (F.col(f"_m_{n}") <= limits[n][1]), F.lit(n)))
    out = out.withColumns({"_bad": F.array_compact(F.array(*bad)), "_warn": F.array_compact(F.array(*warn))})
    none = F.col("n_diagnostics") == 0
    status = F.when(none, "unsupported_missing_diagnostics").when(F.size("_bad") > 0, "unsupported_domain_shift").when(F.size("_warn") > 0, "eligible_with_warning").otherwise("eligible")
    reasons = F.when(none, MISSING).when(F.size("_bad") > 0, F.array_join("_bad", ";")).when(F.size("_warn") > 0, F.array_join("_warn", ";")).otherwise(SATISFIED)
    return out.select(track, "n_diagnostics", *[f"max_{n}" for n in names], status.alias("status"), reasons.alias("reasons"))
