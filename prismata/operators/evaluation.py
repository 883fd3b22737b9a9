"""Object decisions, their grids and choices, and the evaluation of stored thresholds. A zero denominator gives NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators.catalog import join_once
from prismata.operators.decisions import rates
from prismata.operators.selection import pareto_front
from prismata.plans.nulls import join_same
from prismata.plans.shared import materialize

Z95 = 1.959963984540054


def ratio_decision(ratio: Column, lower: Column, upper: Column) -> Column:
    """target from ``upper`` on, non_target below ``lower``, else uncertain."""
    return F.when(ratio >= upper, "target").when(ratio < lower, "non_target").when(ratio.isNotNull(), "uncertain")


def decide_by_config(objects: DataFrame, thresholds: DataFrame, key: str, ratio: str = "ratio") -> DataFrame:
    """Each object under the thresholds of its configuration: ``thresholds(key, lower, upper)``, one row a key."""
    df = objects.join(thresholds.select(key, "lower", "upper"), key)
    return df.withColumn("decision", ratio_decision(F.col(ratio), F.col("lower"), F.col("upper")))


def decision_shares(df: DataFrame, by: list[str], decision: str = "decision") -> DataFrame:
    n = df.groupBy(*by, decision).agg(F.count("*").alias("n"))
    return join_same(n, n.groupBy(*by).agg(F.sum("n").alias("n_all")), by).select(*by, decision, "n", (F.col("n") / F.col("n_all")).alias("rate"))


def attach(rows: DataFrame, facts: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Chosen columns of ``facts`` on rows of their key; columns that rows have already stay theirs. A key that ``facts`` has
    twice is an error."""
    new = [c for c in columns if c not in rows.columns]
    return join_once(rows, facts.select(*key, *new), key, "left") if new else rows


def object_threshold_grid(objects: DataFrame, thresholds: list[float], by: list[str], ratio: str = "ratio") -> DataFrame:
    """Rates of object decisions at every threshold; ``objects`` holds one row per object, so the votes are counted
    once for the whole grid."""
    grid = objects.select(*by, ratio, "truth", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return grid.withColumn("prediction", F.col(ratio) >= F.col("threshold")).groupBy(*by, "threshold").agg(*rates())


def core_vote_grid(pixels: DataFrame, keys: list[str], distance: str, widths: list[int], thresholds: list[float], least_core: int = 20) -> DataFrame:
    """Votes of the pixels farther than each width from the border, for each threshold: rates over objects, and the share
    of objects that fall back to all their pixels. Width 0 takes all."""
    wide = pixels.select(*keys, distance, "prediction", "truth", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    core = (F.col("width") == 0) | (F.col(distance) > F.col("width"))
    p = F.col("prediction").cast("double")
    votes = wide.groupBy(*keys, "width").agg(F.count_if(core).alias("n_core"), F.avg(F.when(core, p)).alias("core"), F.avg(p).alias("all"), (F.avg(F.col("truth").cast("double")) >= 0.5).alias("truth"))
    votes = votes.withColumn("fallback", F.col("n_core") < least_core).withColumn("ratio", F.when(F.col("fallback"), F.col("all")).otherwise(F.col("core")))
    grid = votes.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")).withColumn("prediction", F.col("ratio") >= F.col("threshold"))
    return grid.groupBy("width", "threshold").agg(F.avg(F.col("fallback").cast("double")).alias("fallback_rate"), *rates())


def confusion_case(truth: str = "truth", prediction: str = "prediction", available: Column | None = None) -> Column:
    """TP, TN, FP, FN, or unavailable without a label, a prediction or where ``available`` does not hold."""
    t, p = F.col(truth), F.col(prediction)
    missing = t.isNull() | p.isNull() | (~F.coalesce(available, F.lit(False)) if available is not None else F.lit(False))
    return F.when(missing, "unavailable").when(t & p, "TP").when(~t & ~p, "TN").when(~t & p, "FP").otherwise("FN")


def border_zone_errors(pixels: DataFrame, by: list[str], distance: str, widths: list[int]) -> DataFrame:
    """Errors of border (up to a width) and core pixels per width; a denominator is 1 at least."""
    wide = pixels.select(*by, distance, "truth", "prediction", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    zone = F.when((F.col("width") > 0) & (F.col(distance) <= F.col("width")), "border").otherwise("core")
    t, p = F.col("truth"), F.col("prediction")
    df = wide.groupBy(*by, "width", zone.alias("zone")).agg(F.count("*").alias("n"), F.count_if(t).alias("n_target"), F.count_if(~t).alias("n_other"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"))
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return df.withColumns({"error_rate": (F.col("fn") + F.col("fp")) / one("n"), "fn_rate": F.col("fn") / one("n_target"), "fp_rate": F.col("fp") / one("n_other")})


def three_way_object_grid(objects: DataFrame, pairs: list[tuple[float, float]], by: list[str], ratio: str = "ratio") -> DataFrame:
    """Decision rates of every lower < upper pair (at the lower edge an object is uncertain)."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("lower"), F.lit(float(b)).alias("upper")) for a, b in pairs if a < b])).alias("g")
    df = objects.where("truth IS NOT NULL").select(*by, ratio, "truth", grid).select("*", "g.lower", "g.upper")
    d, t = ratio_decision(F.col(ratio), F.col("lower"), F.col("upper")), F.col("truth")
    df = df.withColumn("decision", d)
    d = F.col("decision")
    hit, dt = F.count_if(t & (d == "target")), F.count_if(t & (d != "uncertain"))
    rej, df_ = F.count_if(~t & (d == "non_target")), F.count_if(~t & (d != "uncertain"))
    return df.groupBy(*by, "lower", "upper").agg(
        F.try_divide(F.count_if(t & (d == "non_target")), F.count_if(t)).alias("target_miss_rate"), F.try_divide(F.count_if(~t & (d == "target")), F.count_if(~t)).alias("false_accept_rate"),
        F.try_divide(F.count_if(d == "uncertain"), F.count("*")).alias("uncertain_rate"), F.try_divide(F.count_if(d != "uncertain"), F.count("*")).alias("coverage_rate"),
        ((F.try_divide(hit, dt) + F.try_divide(rej, df_)) / 2).alias("decided_balanced_accuracy"),
    )


def choose_three_way(grid: DataFrame, by: list[str], max_miss: float, max_false: float | None = None, max_uncertain: float | None = None, min_coverage: float | None = None, fallback: bool = True) -> DataFrame:
    """One threshold pair per group: what meets the limits (all rows where none does, if ``fallback``; else a row that
    says so), the front of miss, false accepts, uncertain and coverage, then their order."""
    ok = F.coalesce("target_miss_rate", F.lit(1.0)) <= max_miss
    for column, limit in (("false_accept_rate", max_false), ("uncertain_rate", max_uncertain)):
        ok = ok & (F.coalesce(column, F.lit(1.0)) <= limit) if limit is not None else ok
    ok = ok & (F.coalesce("coverage_rate", F.lit(0.0)) >= min_coverage) if min_coverage is not None else ok
    df = grid.withColumn("_ok", ok).withColumn("n_feasible", F.count_if("_ok").over(Window.partitionBy(*by)))
    allowed = df.where(F.col("_ok") | ((F.col("n_feasible") == 0) & F.lit(fallback))).drop("_ok")
    worst = {c: F.coalesce(c, F.lit(w)) for c, w in (("target_miss_rate", 1.0), ("false_accept_rate", 1.0), ("uncertain_rate", 1.0), ("coverage_rate", 0.0))}
    front = pareto_front(allowed.withColumns({f"_{c}": v for c, v in worst.items()}), by, ["_target_miss_rate", "_false_accept_rate", "_uncertain_rate"], ["_coverage_rate"]).drop(*[f"_{c}" for c in worst])
    order = [F.asc_nulls_last("target_miss_rate"), F.asc_nulls_last("false_accept_rate"), F.asc_nulls_last("uncertain_rate"), F.desc_nulls_last("coverage_rate"), "lower", "upper"]
    best = front.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
    status = F.when((F.col("n_feasible") > 0) | F.lit(fallback), "acceptable").otherwise("technically_calculable_but_not_acceptable")
    groups = grid.select(*[F.col(c).alias(f"_g_{c}") for c in by]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"_g_{c}").eqNullSafe(F.col(c)) for c in by])
    return groups.join(best, same, "left").select(*[F.col(f"_g_{c}").alias(c) for c in by], "lower", "upper", "target_miss_rate", "false_accept_rate", "uncertain_rate", "coverage_rate", F.coalesce("n_feasible", F.lit(0)).alias("n_feasible")).withColumn("selection_status", status)


def grouped_decisions(df: DataFrame, by: list[str], item: str, truth: str = "truth", decision: str = "decision") -> DataFrame:
    """Counts and rates with uncertainty, and the mean over target objects of each one's miss rate."""
    t, d = F.col(truth), F.col(decision)
    sums = {"n_observations": F.count("*"), "n_target": F.count_if(t), "n_uncertain": F.count_if(d == "uncertain"), "n_target_uncertain": F.count_if(t & (d == "uncertain")), "tp": F.count_if(t & (d == "target")), "fn": F.count_if(t & (d == "non_target")), "fp": F.count_if(~t & (d == "target")), "tn": F.count_if(~t & (d == "non_target"))}
    # rows without a true target give counts only, which need no state an item
    per = df.where(t).groupBy(*by, item).agg(F.count("*").alias("n"), F.count_if(d == "non_target").alias("fn"))
    macro = per.groupBy(*by).agg(F.count("*").alias("n_target_objects"), F.avg(F.col("fn") / F.col("n")).alias("macro_object_target_miss_rate"))
    out = join_same(df.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()]), macro, by, "left").fillna(0, ["n_target_objects"])
    out = out.withColumns({"n_non_target": F.col("n_observations") - F.col("n_target"), "n_non_target_uncertain": F.col("n_uncertain") - F.col("n_target_uncertain")})
    out = out.withColumns({"target_miss_rate": F.try_divide("fn", "n_target"), "false_accept_rate": F.try_divide("fp", "n_non_target"), "uncertain_rate": F.try_divide("n_uncertain", "n_observations"), "target_uncertain_rate": F.try_divide("n_target_uncertain", "n_target"), "non_target_uncertain_rate": F.try_divide("n_non_target_uncertain", "n_non_target")})
    decided = (F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")) + F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))) / 2
    return out.withColumns({"coverage_rate": 1 - F.col("uncertain_rate"), "decided_balanced_accuracy": decided, "balanced_accuracy": F.when(F.col("n_uncertain") == 0, decided)})


def finite(c: Column) -> Column:
    """NULL where a value is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_reducers(df: DataFrame, by: list[str], value: str, ddof: int = 1) -> DataFrame:
    """mean, deviation (NULL with no more than ``ddof`` values) and maximum of the finite values."""
    v = finite(F.col(value).cast("double"))
    std = F.stddev_samp(v) if ddof else F.stddev_pop(v)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.when(F.count(v) > ddof, std).alias("std"), F.max(v).alias("largest"), F.count(v).alias("n_finite"))


MACRO = ["target_miss_rate", "false_accept_rate", "uncertain_rate", "target_uncertain_rate", "non_target_uncertain_rate", "coverage_rate"]


def macro_images(by_image: DataFrame, by: list[str], z: float = Z95) -> DataFrame:
    """Means over images of their rates, with a normal interval clipped to [0, 1] (a point for one image)."""
    aggs, bounds = [], {}
    for m in MACRO:
        v = finite(F.col(m))
        aggs += [F.avg(v).alias(f"macro_image_{m}"), F.coalesce(z * F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(0.0)).alias(f"_{m}")]
        bounds |= {f"macro_image_{m}_ci_low": F.greatest(F.lit(0.0), F.col(f"macro_image_{m}") - F.col(f"_{m}")), f"macro_image_{m}_ci_high": F.least(F.lit(1.0), F.col(f"macro_image_{m}") + F.col(f"_{m}"))}
    out = by_image.groupBy(*by).agg(F.count("*").alias("n_images"), *aggs)
    for name, c in bounds.items():  # NULL without an image; greatest and least skip NULLs
        out = out.withColumn(name, F.when(F.col(name[: name.index("_ci_")]).isNotNull(), c))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    for end, other in (("", ""), ("_ci_low", "_ci_high"), ("_ci_high", "_ci_low")):
        s = F.col(f"macro_image_target_miss_rate{other}") + F.col(f"macro_image_false_accept_rate{other}")
        out = out.withColumn(f"macro_image_balanced_accuracy{end}", F.when(s.isNotNull(), clip(1 - s / 2)))
    return out.drop(*[f"_{m}" for m in MACRO])


def locked_evaluation(predictions: DataFrame, thresholds: DataFrame, key: str, image: str, item: str, score: str) -> DataFrame:
    """Stored scores under stored thresholds: rates per configuration over all rows and per image, in long form.
    A configuration without a usable pair (lower < upper) gives one row of status ``technical_failure``."""
    usable = thresholds.where("lower < upper")
    df = predictions.join(usable, key)
    decided = df.withColumn("decision", F.when(F.col(score) >= F.col("upper"), "target").when(F.col(score) >= F.col("lower"), "uncertain").otherwise("non_target"))
    names = ["target_miss_rate", "false_accept_rate", "uncertain_rate", "coverage_rate", "macro_object_target_miss_rate"]
    every = grouped_decisions(decided, [key], item).withColumn(image, F.lit(None).cast(df.schema[image].dataType))
    each = grouped_decisions(decided, [key, image], item)
    keep = [key, image, *names]
    long = every.select(*keep).unionByName(each.select(*keep)).unpivot([key, image], names, "metric", "value").withColumn("status", F.lit("calculable"))
    failed = thresholds.where("NOT coalesce(lower < upper, false)").select(key, F.lit(None).cast(df.schema[image].dataType).alias(image), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit("technical_failure").alias("status"))
    return long.unionByName(failed)


def guardrails(metrics: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """``metrics(key, scope, metric, value)`` against ``limits(metric, operator, warn, fail)``: pass, warning, fail or
    missing per check; where the overall scope fails, its other scopes cannot pass either and become warnings."""
    df = materialize(metrics, "guardrails").join(F.broadcast(limits), "metric")  # read twice below; a row per kind of check
    worse = lambda limit: F.when(F.col("operator") == "<=", F.col("value") > F.col(limit)).otherwise(F.col("value") < F.col(limit))
    status = F.when(F.col("value").isNull() | F.isnan("value"), "missing").when(worse("fail"), "fail").when(worse("warn"), "warning").otherwise("pass")
    df = df.withColumn("status", status)
    failed = df.where("scope = 'overall' AND status = 'fail'").select(F.col(key).alias("_k"), F.col("metric").alias("_m")).distinct()
    df = df.join(failed, F.col(key).eqNullSafe(F.col("_k")) & (F.col("metric") == F.col("_m")), "left")
    return df.withColumn("status", F.when(F.col("_m").isNotNull() & (F.col("status") == "pass"), "warning").otherwise(F.col("status"))).select(key, "scope", "metric", "value", "operator", "warn", "fail", "status")


def fold_aggregation(folds: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Rates of folds weighted by their support, the worst fold, the mean over images, and the deviation (ddof 0)
    of the folds' balanced accuracy, with a verdict against nothing but itself: whether all could be computed."""
    def weighted(rate: str, n: str) -> Column:
        r = finite(F.col(rate))
        return F.try_divide(F.sum(F.when(r.isNotNull() & (F.col(n) > 0), r * F.col(n))), F.sum(F.when(r.isNotNull() & (F.col(n) > 0), F.col(n))))

    out = folds.groupBy(key).agg(
        F.count("*").alias("n_folds"), F.sum("n_observations").alias("n_observations"), weighted("target_miss_rate", "n_target").alias("target_miss_rate"), weighted("false_accept_rate", "n_non_target").alias("false_accept_rate"),
        weighted("uncertain_rate", "n_observations").alias("uncertain_rate"), weighted("target_uncertain_rate", "n_target").alias("tu"), weighted("non_target_uncertain_rate", "n_non_target").alias("nu"),
        F.max(finite(F.col("target_miss_rate"))).alias("worst_fold_target_miss_rate"), F.max(finite(F.col("false_accept_rate"))).alias("worst_fold_false_accept_rate"), F.stddev_pop(finite(F.col("decided_balanced_accuracy"))).alias("fold_metric_std"),
    )
    sens = F.try_divide(1 - F.col("target_miss_rate") - F.col("tu"), 1 - F.col("tu"))
    spec = F.try_divide(1 - F.col("false_accept_rate") - F.col("nu"), 1 - F.col("nu"))
    out = out.withColumns({"coverage_rate": 1 - F.col("uncertain_rate"), "decided_balanced_accuracy": (sens + spec) / 2}).drop("tu", "nu")
    macro = images.groupBy(key).agg(F.count("*").alias("n_images"), F.avg(finite(F.col("target_miss_rate"))).alias("macro_image_target_miss_rate"), F.avg(finite(F.col("false_accept_rate"))).alias("macro_image_false_accept_rate"))
    out = out.join(macro, key, "left").withColumn("macro_image_balanced_accuracy", 1 - (F.col("macro_image_target_miss_rate") + F.col("macro_image_false_accept_rate")) / 2)
    return out.withColumn("technical_status", F.when(F.col("decided_balanced_accuracy").isNull(), "not_calculable").otherwise("calculable"))


def acceptability(df: DataFrame, limits: list[tuple[str, str, float]]) -> DataFrame:
    """acceptable where every ``(metric, operator, limit)`` holds; the reason lists those that do not, in order."""
    fails = []
    for metric, operator, limit in limits:
        v = F.col(metric)
        ok = F.coalesce(~F.isnan(v) & (v <= limit if operator == "<=" else v >= limit), F.lit(False))
        fails.append(F.when(~ok, F.lit(metric)))
    reason = F.concat_ws(";", *fails)
    return df.withColumns({"failure_reason": reason, "acceptability_status": F.when(reason == "", "acceptable").otherwise("calculable_not_acceptable")})


def block_evaluation(df: DataFrame, by: list[str], image: str, score: str, pairs: list[tuple[float, float]], unit: str = "image") -> DataFrame:
    """Calibration rates of threshold pairs (a score at the lower edge is non_target): with unit ``image`` the mean of
    the images' rates, with ``object`` the pooled ones; the worst image either way."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("lower"), F.lit(float(b)).alias("upper")) for a, b in pairs])).alias("g")
    wide = df.select(*by, image, score, "truth", grid).select("*", "g.lower", "g.upper")
    t, s = F.col("truth"), F.col(score)
    sums = {"n_t": F.count_if(t), "n_f": F.count_if(~t), "fn": F.count_if(t & (s <= F.col("lower"))), "fp": F.count_if(~t & (s >= F.col("upper"))), "un": F.count_if((s > F.col("lower")) & (s < F.col("upper"))), "n": F.count("*")}
    per = wide.groupBy(*by, "lower", "upper", image).agg(*[c.alias(k) for k, c in sums.items()])
    per = per.withColumns({"miss": F.try_divide("fn", "n_t"), "false": F.try_divide("fp", "n_f"), "uncertain": F.try_divide("un", "n")})
    if unit == "image":
        rates_ = [F.avg(c).alias(c) for c in ("miss", "false", "uncertain")]
    else:
        rates_ = [F.try_divide(F.sum(a), F.sum(b)).alias(c) for c, a, b in (("miss", "fn", "n_t"), ("false", "fp", "n_f"), ("uncertain", "un", "n"))]
    out = per.groupBy(*by, "lower", "upper").agg(*rates_, *[F.max(c).alias(f"worst_{c}") for c in ("miss", "false", "uncertain")])
    return out.withColumn("balanced_accuracy", 1 - (F.col("miss") + F.col("false")) / 2)


def to_long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def three_way_confidence(df: DataFrame, ratio: str, lower: str, upper: str, decision: str) -> DataFrame:
    """Margin and confidence of a three-way decision: the share of the room beyond the threshold, or, for an uncertain
    object, of half the band's width."""
    r, lo, up, d = F.col(ratio), F.col(lower), F.col(upper), F.col(decision)
    margin = F.when(d == "target", r - up).when(d == "non_target", lo - r).when(d == "uncertain", F.least(r - lo, up - r))
    room = F.when(d == "target", 1 - up).when(d == "non_target", lo).when(d == "uncertain", (up - lo) / 2)
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin / F.when(room > 1e-12, room).otherwise(1.0)))
    c = F.when(margin.isNotNull(), c)
    return df.withColumns({"margin": margin, "confidence": c, "confidence_bin": F.when(c <= 0.33, "low").when(c <= 0.66, "medium").when(c.isNotNull(), "high")})
