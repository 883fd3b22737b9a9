"""Numeric audit of preprocessing chains: fitted on one set of rows, applied to it and to another, all chains in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.operators.chain import Chain, row_valid

SUMMARY = "chain string, steps string, window int, order int, n_fit long, n_eval long, n_filtered long, n_features int, n_nan long, n_inf long, least double, largest double, zero_variance_rate double, saturation_rate double, repeatability_error double, status string"


def _expression(chain: Chain, spectrum: str) -> Column:
    return reduce(lambda s, i: chain._step(i, s), range(len(chain.steps)), F.col(spectrum))


def audit(fit_rows: DataFrame, eval_rows: DataFrame, chains: dict[str, Chain], spectrum: str = "spectrum", saturation: tuple[float, float] | None = None, least_variance: float = 1e-12, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """``(summary, errors)``. A summary row per chain over the rows of both sides that it can take: counts, least and largest
    value, bands without variance, share of values at a ``saturation`` bound or beyond (NULL without bounds), and the
    repeatability error, the largest difference between outputs on the evaluated rows of the chain and of one that was
    fitted again on the same rows in another order. ``status`` is accepted with finite values, some varying band, nothing
    saturated and an error within the tolerance; invalid otherwise, which is also a row of ``errors`` with its reason, as is a
    chain that cannot be fitted."""
    spark, fitted, failed = fit_rows.sparkSession, {}, []
    for name, c in chains.items():
        try:
            again = Chain(c.steps, c.window, c.order, c.eps, c.nonpositive, c.delta)
            fitted[name] = (c.fit(fit_rows, spectrum), again.fit(fit_rows.repartition(3) if "msc" in c.steps else fit_rows, spectrum))
        except ValueError as e:
            failed.append((name, str(e)))
    steps = spark.createDataFrame([(n, " + ".join(c.steps), c.window, c.order) for n, c in chains.items()], "chain string, steps string, window int, order int")
    if not fitted:
        per = spark.createDataFrame([], "chain string, n_fit long, n_eval long, n_filtered long, n_features int, n_nan long, n_inf long, least double, largest double, zero_variance_rate double, saturation_rate double, repeatability_error double")
    else:
        both = fit_rows.select(F.col(spectrum), F.lit(True).alias("_fit")).unionByName(eval_rows.select(F.col(spectrum), F.lit(False).alias("_fit")))
        cells = []
        for name, (c, again) in fitted.items():
            ok = row_valid(spectrum, c.steps, c.nonpositive)
            cells.append(F.struct(F.lit(name).alias("chain"), F.when(ok, _expression(c, spectrum)).alias("x"), F.when(ok & ~F.col("_fit"), _expression(again, spectrum)).alias("y")))
        rows = both.select("_fit", F.explode(F.array(*cells)).alias("c")).select("_fit", "c.*")
        counts = rows.groupBy("chain").agg(F.count_if(F.col("_fit") & F.col("x").isNotNull()).alias("n_fit"), F.count_if(~F.col("_fit") & F.col("x").isNotNull()).alias("n_eval"), F.count_if(F.col("x").isNull()).alias("n_filtered"), F.max(F.size("x")).alias("n_features"))
        long = rows.where("x IS NOT NULL").select("chain", F.posexplode(F.when(F.col("y").isNull(), F.transform("x", lambda v: F.struct(v.alias("v"), v.alias("w")))).otherwise(F.zip_with("x", "y", lambda v, w: F.struct(v.alias("v"), w.alias("w"))))).alias("band", "p"))
        v, w = F.col("p.v"), F.col("p.w")
        full = (v <= saturation[0]) | (v >= saturation[1]) if saturation else F.lit(None).cast("boolean")
        bands = long.groupBy("chain", "band").agg(F.count("*").alias("n"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"), F.min(v).alias("least"), F.max(v).alias("largest"), F.var_pop(v).alias("variance"), F.sum(full.cast("long")).alias("n_full"), F.max(F.abs(v - w)).alias("gap"))
        one = bands.groupBy("chain").agg(F.sum("n_nan").alias("n_nan"), F.sum("n_inf").alias("n_inf"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.avg((F.col("variance") <= least_variance).cast("double")).alias("zero_variance_rate"), F.try_divide(F.sum("n_full"), F.sum("n")).alias("saturation_rate"), F.max("gap").alias("repeatability_error"))
        per = counts.join(one, "chain", "left")
    finite = (F.col("n_nan") == 0) & (F.col("n_inf") == 0)
    reason = (
        F.when(F.col("n_features").isNull(), "no row that the chain can take")
        .when(~finite, "values that are not finite")
        .when(F.col("zero_variance_rate") >= 1, "no band varies")
        .when(F.col("saturation_rate") > 0, "saturated values")
        .when(~(F.col("repeatability_error") <= tolerance), "not repeatable")
    )
    lost = spark.createDataFrame(failed, "chain string, _failed string")
    out = steps.join(per, "chain", "left").join(lost, "chain", "left").withColumn("_reason", F.coalesce("_failed", reason))
    summary = out.withColumn("status", F.when(F.col("_reason").isNull(), "accepted").otherwise("invalid")).select(*[c.split()[0] for c in SUMMARY.split(", ")])
    return summary, out.where("_reason IS NOT NULL").select("chain", "steps", F.col("_reason").alias("error"))
