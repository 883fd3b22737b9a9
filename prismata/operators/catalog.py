"""Configuration grids, registries, policy choice with its audit, stored-metric checks and small reports.

Grids, seeds, limits and class bounds are parameters, so what they expand to is bounded; everything else is joins and
aggregations with map-side combining, without windows over groups that grow. A NULL condition counts as not met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.sources.tables import canonical


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which NULL keys match; the right keys go."""
    r = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(r, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), how).drop(*[f"_k_{k}" for k in keys])


def configuration_grid(base: DataFrame, axes: dict[str, list], applicable: Column, ident: list[str]) -> DataFrame:
    """Every base row with every combination of the axes that applies, and an id from a hash of ``ident``."""
    for name, values in axes.items():
        base = base.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return base.where(applicable).withColumn("config_id", F.sha2(canonical(ident), 256))


def additional_seeds(models: DataFrame, key: str, stochastic: Column, seeds: list[int], existing: DataFrame) -> DataFrame:
    """Stochastic models with each seed they have not run yet; ``existing`` holds ``(key, seed)``."""
    plan = models.where(stochastic).select(key, F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    return plan.join(existing.select(key, F.col("seed").cast("int").alias("seed")), [key, "seed"], "left_anti")


def join_once(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Many-to-one join; a key that the right side holds twice is an error. NULL keys match."""
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_v"))
    once = once.select(*keys, F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key: " + ", ".join(keys)))).otherwise(F.col("_v")).alias("_v"))
    return _same(left, once, keys, how).select(*left.columns, *[F.col("_v")[c].alias(c) for c in rest])


def join_covered(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As ``join_once``, and a left row without its ``value`` is an error: every selected run gets its threshold."""
    out = join_once(left, right, keys, "left")
    return out.withColumn(value, F.coalesce(value, F.raise_error(F.lit("no value for a key of: " + ", ".join(keys)))))


def position_check(parts: DataFrame, key: str, position: str) -> DataFrame:
    """Per object: parts, distinct positions, first and last position, and whether they are 1 to n without gap."""
    out = parts.groupBy(key).agg(F.count("*").alias("n_parts"), F.count_distinct(position).alias("n_positions"), F.min(position).alias("first"), F.max(position).alias("last"))
    return out.withColumn("consistent", F.coalesce((F.col("n_parts") == F.col("n_positions")) & (F.col("first") == 1) & (F.col("last") == F.col("n_parts")), F.lit(False)))


def select_policies(df: DataFrame, by: list[str], complete: Column, limits: list[tuple[str, Column]], priority: list[tuple[str, bool, float]], key: str) -> DataFrame:
    """Every candidate with the stage at which it fell, or ``selected``.

    Stages: incomplete; each limit in turn; per priority (metric, ascending, tolerance) what is not within the
    tolerance of the best left in its group; the tie break, in which the smallest key stays. Each best is an
    aggregation joined back, so a large group is never one task.
    """
    met = lambda c: F.coalesce(c, F.lit(False))
    start = reduce(lambda c, x: c.when(~met(x[1]), "limit:" + x[0]), limits, F.when(~met(complete), "incomplete"))
    df = df.withColumn("stage", start)
    alive = F.col("stage").isNull()
    for metric, ascending, tolerance in priority:
        best = df.where(alive).groupBy(*by).agg((F.min if ascending else F.max)(metric).alias("_best"))
        within = F.col(metric) <= F.col("_best") + tolerance if ascending else F.col(metric) >= F.col("_best") - tolerance
        df = _same(df, best, by, "left").withColumn("stage", F.when(alive & ~met(within), "plateau:" + metric).otherwise(F.col("stage"))).drop("_best")
    first = df.where(alive).groupBy(*by).agg(F.min(key).alias("_best"))
    return _same(df, first, by, "left").withColumn("stage", F.when(~alive, F.col("stage")).when(F.col(key) == F.col("_best"), "selected").otherwise("tie_break")).drop("_best")


def acceptability(configs: DataFrame, stored: DataFrame, key: str, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Look up the one stored row of each config and compare its metrics with (least, largest) limits."""
    per = stored.groupBy(key).agg(F.count("*").alias("n_stored"), *[F.first(m).alias(m) for m in limits])
    out = configs.select(key).join(per, key, "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0).cast("long")))
    within = reduce(lambda a, b: a & b, [c for m, (lo, hi) in limits.items() for c in ([F.col(m) >= lo] if lo is not None else []) + ([F.col(m) <= hi] if hi is not None else [])])
    known = reduce(lambda a, b: a & b, [F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")) for m in limits])
    status = F.when(F.col("n_stored") == 0, "missing").when(F.col("n_stored") > 1, "duplicated").when(~known, "technical_invalid").when(within, "acceptable").otherwise("calculable_but_not_acceptable")
    return out.select(key, "n_stored", status.alias("status"))


def paired_plan(configs: DataFrame, key: str, factor: str, reference: object, others: list[str]) -> DataFrame:
    """Each config beside the one that differs only in having the reference level of the factor (the smallest key of
    several); without one it is not estimable. NULL levels of the other factors match."""
    ref = configs.where(F.col(factor) == reference).groupBy(*others).agg(F.min(key).alias("reference"))
    rest = configs.where(~F.col(factor).eqNullSafe(F.lit(reference))).select(key, factor, *others)
    return _same(rest, ref, others, "left").select(key, factor, "reference", F.when(F.col("reference").isNull(), "not_estimable").otherwise("planned").alias("status"))


def area_classes(df: DataFrame, by: list[str], area: str, detected: str, iou: str, bounds: list[int], labels: list[str]) -> DataFrame:
    """Recall and mean best IoU per area class (upper bounds inclusive, the last class open); every group has every
    class, and its smallest occupied one is flagged."""
    inside = [(F.lit(True) if i == 0 else F.col(area) > bounds[i - 1]) & (F.col(area) <= bounds[i] if i < len(bounds) else F.lit(True)) for i in range(len(labels))]
    cells = [F.struct(F.count_if(c).alias("n"), F.count_if(c & F.col(detected)).alias("n_detected"), F.avg(F.when(c, F.col(iou))).alias("mean_iou")) for c in inside]
    out = df.groupBy(*by).agg(F.array(*cells).alias("c")).withColumn("_least", F.expr("array_position(transform(c, x -> x.n > 0), true)"))
    out = out.select(*by, "_least", F.posexplode("c").alias("i", "c"))
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("i") + 1)
    return out.select(*by, name.alias("area_class"), "c.n", "c.n_detected", F.try_divide("c.n_detected", "c.n").alias("recall"), "c.mean_iou", (F.col("_least") == F.col("i") + 1).alias("smallest"))


def output_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Least, median and largest value of each metric per track and level."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("least", F.min), ("median", F.median), ("largest", F.max))])


def otsu(df: DataFrame, image: str, value: str, bins: int = 256) -> DataFrame:
    """``(image, threshold)``: centre of the bin after which the variance between both sides is largest, the first of
    equals; of one value only, that value. Windows run over the occupied bins, ``bins`` at most per image."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(image, F.col(value).cast("double").alias("v"))
    v = _same(v, v.groupBy(image).agg(F.min("v").alias("lo"), F.max("v").alias("hi")), [image], "inner")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))))).otherwise(0)
    hist = v.groupBy(image, "lo", "hi", place.cast("long").alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(image).orderBy("b")
    hist = hist.withColumns({"w1": F.sum("n").over(w), "s1": F.sum(F.col("n") * F.col("b")).over(w), "wt": F.sum("n").over(Window.partitionBy(image)), "st": F.sum(F.col("n") * F.col("b")).over(Window.partitionBy(image))})
    w1, w2 = F.col("w1").cast("double"), (F.col("wt") - F.col("w1")).cast("double")
    gap = F.try_divide(F.col("s1"), w1) - F.try_divide(F.col("st") - F.col("s1"), w2)
    best = hist.groupBy(image, "lo", "hi").agg(F.max_by("b", F.struct(w1 * w2 * gap * gap, -F.col("b"))).alias("b"))
    return best.select(image, F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / bins).otherwise(F.col("lo")).alias("threshold"))


def threshold_mask(df: DataFrame, image: str, value: str, least: float | None = None) -> DataFrame:
    """Every row with its image's threshold (not under ``least``) and whether the value is above; NaN never is."""
    t = otsu(df, image, value)
    t = t.withColumn("threshold", F.greatest("threshold", F.lit(least))) if least is not None else t
    return _same(df, t, [image], "left").withColumn("in_mask", F.coalesce((F.col(value) > F.col("threshold")) & ~F.isnan(F.col(value).cast("double")), F.lit(False)))


def reference_audit(stored: DataFrame, rebuilt: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Stored metrics beside rebuilt ones, one row per key and metric: equal within the tolerance, both NULL included,
    or not; keys of one side only are named."""
    pair = lambda t, side: t.select(*keys, F.lit(True).alias(f"_{side}"), *[F.col(m).cast("double").alias(f"{m}_{side}") for m in metrics])
    out = pair(stored, "stored").join(pair(rebuilt, "rebuilt"), keys, "full")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_stored").alias("stored"), F.col(f"{m}_rebuilt").alias("rebuilt")) for m in metrics])).alias("c")
    out = out.select(*keys, "_stored", "_rebuilt", cells).select(*keys, "_stored", "_rebuilt", "c.*")
    same = F.col("stored").eqNullSafe(F.col("rebuilt")) | (F.abs(F.col("stored") - F.col("rebuilt")) <= tolerance)
    status = F.when(F.col("_stored").isNull(), "not_stored").when(F.col("_rebuilt").isNull(), "not_rebuilt").when(same, "equal").otherwise("differs")
    return out.select(*keys, "metric", "stored", "rebuilt", status.alias("status"))


def per_image_errors(df: DataFrame, by: list[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Errors of each kind per image and their share of the rows whose truth and prediction are known."""
    t, p = F.col(truth), F.col(prediction)
    out = df.where(t.isNotNull() & p.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.count_if(t & ~p).alias("n_fn"), F.count_if(~t & p).alias("n_fp"))
    return out.withColumn("error_rate", (F.col("n_fn") + F.col("n_fp")) / F.col("n"))
