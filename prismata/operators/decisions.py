"""Decisions from margins and the rates that describe them. NaN must be NULL already; a zero denominator gives NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def locked_two_way(margin: str, threshold: float = 0.0) -> Column:
    return F.col(margin) >= threshold


def locked_three_way(margin: str, lower: float, upper: float) -> Column:
    """target from ``upper`` on, uncertain from ``lower`` on, else non_target: the lower edge is uncertain."""
    if not lower < upper:
        raise ValueError("lower must be below upper")
    return F.when(F.col(margin) >= upper, "target").when(F.col(margin) >= lower, "uncertain").when(F.col(margin).isNotNull(), "non_target")


def rates(truth: str = "truth", prediction: str = "prediction") -> list[Column]:
    """Counts and rates of a binary prediction; rows without a label or a prediction do not count."""
    t, p = F.col(truth), F.col(prediction)
    tp, fn, fp, tn = (F.count_if(x) for x in (t & p, t & ~p, ~t & p, ~t & ~p))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return [
        tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"), sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"),
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(fn, tp + fn).alias("fn_rate"), F.try_divide(fp, tn + fp).alias("fp_rate"),
    ]


def detection_metrics(df: DataFrame, by: list[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*by).agg(*rates(truth, prediction))


def confusion_table(df: DataFrame, by: list[str], truth: str = "truth", prediction: str = "prediction", three_way: bool = False) -> DataFrame:
    """All cells per group, also the empty ones, with the rate in the row and in the group. The rate of a row without
    cases is NULL for two-way and 0 for three-way predictions."""
    spark = df.sparkSession
    answers = ["target", "uncertain", "non_target"] if three_way else ["true", "false"]
    cells = spark.createDataFrame([(t, a) for t in (True, False) for a in answers], "truth boolean, prediction string")
    counted = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull()).groupBy(*by, F.col(truth).alias("truth"), F.col(prediction).cast("string").alias("prediction")).agg(F.count("*").alias("n"))
    full = df.select(*by).distinct().crossJoin(F.broadcast(cells))  # the cells are six rows at most
    same = reduce(lambda a, b: a & b, [full[c].eqNullSafe(counted[c]) for c in [*by, "truth", "prediction"]])
    out = full.join(counted, same, "left").select(*[full[c] for c in [*by, "truth", "prediction"]], F.coalesce("n", F.lit(0)).alias("n"))
    per_row = out.groupBy(*by, "truth").agg(F.sum("n").alias("row_n")).withColumnsRenamed({c: f"_r_{c}" for c in [*by, "truth"]})
    per_all = out.groupBy(*by).agg(F.sum("n").alias("all_n")).withColumnsRenamed({c: f"_a_{c}" for c in by})
    meet = lambda p, cols: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(p + c)) for c in cols])
    out = out.join(per_row, meet("_r_", [*by, "truth"])).join(per_all, meet("_a_", by))
    empty = F.lit(0.0) if three_way else F.lit(None).cast("double")
    return out.select(*by, "truth", "prediction", "n", F.when(F.col("row_n") == 0, empty).otherwise(F.col("n") / F.nullif("row_n", F.lit(0))).alias("row_rate"), F.try_divide("n", "all_n").alias("rate"))


def vote(pixels: DataFrame, keys: list[str], threshold: float = 0.75, truth_threshold: float = 0.5, least_truth: float = 0.5) -> DataFrame:
    """Object decision from its pixels' share of target predictions. Truth comes from the pixels that have one, and
    holds where enough of them do; objects without a key are left out."""
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    df = pixels.where(named).groupBy(*keys).agg(F.count("*").alias("n_pixels"), F.avg(F.col("prediction").cast("double")).alias("ratio"), (F.count("truth") / F.count("*")).alias("truth_share"), F.avg(F.col("truth").cast("double")).alias("truth_ratio"))
    return df.withColumns({"prediction": F.col("ratio") >= threshold, "truth": F.when(F.col("truth_share") >= least_truth, F.col("truth_ratio") >= truth_threshold)})


def core_vote(pixels: DataFrame, keys: list[str], core: str, least_core: int = 20, threshold: float = 0.75) -> DataFrame:
    """As ``vote`` on core pixels; an object with fewer than ``least_core`` of them votes with all."""
    df = pixels.groupBy(*keys).agg(F.count_if(core).alias("n_core"), F.avg(F.when(F.col(core), F.col("prediction").cast("double"))).alias("core_ratio"), F.avg(F.col("prediction").cast("double")).alias("all_ratio"))
    df = df.withColumn("fallback", F.col("n_core") < least_core).withColumn("ratio", F.when(F.col("fallback"), F.col("all_ratio")).otherwise(F.col("core_ratio")))
    return df.withColumn("prediction", F.col("ratio") >= threshold)


def threshold_grid(df: DataFrame, score: str, thresholds: list[float], by: list[str]) -> DataFrame:
    """Rates for every threshold in one aggregation; thresholds are a parameter, so the row grid is bounded."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    df = df.groupBy(*by, F.col(score).alias("_s"), "truth").agg(F.count("*").alias("_n")).select("*", grid)
    p = F.col("_s") >= F.col("threshold")
    tp, fn, fp, tn = (F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)) for c in (F.col("truth") & p, F.col("truth") & ~p, ~F.col("truth") & p, ~F.col("truth") & ~p))
    miss, false = F.try_divide(fn, tp + fn), F.try_divide(fp, tn + fp)
    return df.groupBy(*by, "threshold").agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"), miss.alias("miss_rate"), false.alias("false_accept_rate"), (1 - (miss + false) / 2).alias("balanced_accuracy"))


def three_way_rates(df: DataFrame, by: list[str], decision: str = "decision") -> DataFrame:
    t, d = F.col("truth"), F.col(decision)
    n_t, n_f = F.count_if(t), F.count_if(~t)
    decided = F.count_if(d != "uncertain")
    hit, rej = F.count_if(t & (d == "target")), F.count_if(~t & (d == "non_target"))
    dt, df_ = F.count_if(t & (d != "uncertain")), F.count_if(~t & (d != "uncertain"))
    return df.where(t.isNotNull()).groupBy(*by).agg(
        F.try_divide(F.count_if(t & (d == "non_target")), n_t).alias("miss_rate"), F.try_divide(F.count_if(~t & (d == "target")), n_f).alias("false_accept_rate"),
        F.try_divide(hit, n_t).alias("auto_accept_rate"), F.try_divide(rej, n_f).alias("auto_reject_rate"), F.try_divide(F.count_if(d == "uncertain"), F.count("*")).alias("uncertain_rate"),
        F.try_divide(decided, F.count("*")).alias("coverage"), ((F.try_divide(hit, dt) + F.try_divide(rej, df_)) / 2).alias("decided_balanced_accuracy"),
    )


def three_way_grid(df: DataFrame, score: str, pairs: list[tuple[float, float]], by: list[str]) -> DataFrame:
    """Calibration rates of every (lower, upper): here a score at the lower edge is non_target."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("lower"), F.lit(float(b)).alias("upper")) for a, b in pairs if a < b])).alias("g")
    df = df.select(*by, score, "truth", grid).select(*by, score, "truth", "g.lower", "g.upper")
    d = F.when(F.col(score) >= F.col("upper"), "target").when(F.col(score) <= F.col("lower"), "non_target").otherwise("uncertain")
    return three_way_rates(df.withColumn("decision", d), [*by, "lower", "upper"])


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a rate; NULL without cases."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p = successes / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def micro_macro(df: DataFrame, level: str) -> DataFrame:
    """The pooled rates, then mean and worst over one grouping level."""
    micro = df.agg(*rates()).select(F.lit("micro").alias("kind"), "fn_rate", "fp_rate", "balanced_accuracy")
    per = df.groupBy(level).agg(*rates())
    macro = per.agg(F.avg("fn_rate").alias("fn_rate"), F.avg("fp_rate").alias("fp_rate"), F.avg("balanced_accuracy").alias("balanced_accuracy")).select(F.lit("macro").alias("kind"), "*")
    worst = per.agg(F.max("fn_rate").alias("fn_rate"), F.max("fp_rate").alias("fp_rate"), F.min("balanced_accuracy").alias("balanced_accuracy")).select(F.lit("worst").alias("kind"), "*")
    return micro.unionByName(macro).unionByName(worst)


def two_way_confidence(df: DataFrame, score: str, threshold: float, eps: float = 1e-12) -> DataFrame:
    """Signed margin, its share of the room on that side in [0, 1], and low / medium / high."""
    margin = F.col(score) - threshold
    room = F.when(margin >= 0, F.lit(abs(1 - threshold))).otherwise(F.lit(abs(threshold)))
    scale = F.when(room > eps, room).otherwise(F.lit(max(abs(threshold), 1.0)))
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(margin) / scale))
    return df.withColumns({"margin": margin, "confidence": c, "confidence_bin": F.when(c <= 0.33, "low").when(c <= 0.66, "medium").otherwise("high")})


def macro_miss(df: DataFrame, item: str, by: list[str], score: str, threshold: float) -> DataFrame:
    """Mean over target objects of the share of their pixels below the threshold: objects weigh the same."""
    per = df.where("truth").groupBy(*by, item).agg(F.avg((F.col(score) < threshold).cast("double")).alias("miss"))
    return per.groupBy(*by).agg(F.avg("miss").alias("macro_miss_rate"), F.count("*").alias("n_objects"))


def quantile_policies(df: DataFrame, score: str, by: list[str], centre: float, lower: list[float], upper: list[float]) -> DataFrame:
    """Thresholds from quantiles of the scores on either side of the centre, every pair that encloses it."""
    q = df.groupBy(*by).agg(F.percentile(F.when(F.col(score) < centre, F.col(score)), F.array(*map(F.lit, lower))).alias("lo"), F.percentile(F.when(F.col(score) > centre, F.col(score)), F.array(*map(F.lit, upper))).alias("hi"))
    a = q.select(*by, F.posexplode("lo").alias("i", "lower_threshold"), "hi").select("*", F.posexplode("hi").alias("j", "upper_threshold"))
    names = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), F.col(k) + 1)
    return a.where((F.col("lower_threshold") < centre) & (F.col("upper_threshold") > centre)).select(*by, names(lower, "i").alias("lower_quantile"), names(upper, "j").alias("upper_quantile"), "lower_threshold", "upper_threshold")
