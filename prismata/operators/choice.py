"""Choices among models with their reasons: fronts with witnesses, chained filters, equivalence, audits of a choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators.selection import pareto_front
from prismata.plans.nulls import join_same


def _same(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b, strict=True)])


def front_with_witness(df: DataFrame, by: list[str], minimise: list[str], key: str) -> DataFrame:
    """Every row with ``on_front`` and, off it, ``witness``: the smallest key of the front rows that dominate it. Rows
    meet the front of their group only."""
    front = pareto_front(df, by, minimise).select(*[F.col(c).alias(f"_f_{c}") for c in [*by, *minimise, key]])
    no_worse = reduce(lambda a, b: a & b, [F.col(f"_f_{g}") <= F.col(g) for g in minimise])
    better = reduce(lambda a, b: a | b, [F.col(f"_f_{g}") < F.col(g) for g in minimise])
    met = df.withColumn("_row", F.monotonically_increasing_id()).join(front, _same([F.col(c) for c in by], [F.col(f"_f_{c}") for c in by]) & no_worse & better, "left")
    # equal rows are rows of their own
    out = met.groupBy("_row").agg(F.first(F.struct(*df.columns)).alias("_v"), F.min(f"_f_{key}").alias("witness")).select("_v.*", "witness")
    return out.withColumn("on_front", F.col("witness").isNull())


def sequential_fronts(df: DataFrame, by: list[str], passes: list[tuple[str, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """Front after front: what is left, and an audit row per pass with the rows before and after it."""
    audit = []
    for name, goals in passes:
        after = pareto_front(df, by, goals)
        counts = df.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))  # one row each
        audit.append(counts.select(F.lit(name).alias("pass"), "n_before", "n_after"))
        df = after
    return df, reduce(DataFrame.unionByName, audit)


def calibrated_models(models: DataFrame, by: str, key: str, expected_folds: int, risk: str, tolerance: float, k: str, m: str, objectives: list[str]) -> DataFrame:
    """Every model with the stage at which it falls: ``error``, ``coverage`` (not all folds), ``not_finite``, ``plateau`` (risk
    above the best of its track by more than the tolerance), ``larger`` (a smaller k, then m, at equal risk), ``dominated``, or
    selected. ``models`` has ``error`` and ``n_folds``."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in [risk, *objectives]])
    df = models.withColumn("stage", F.when(F.col("error").isNotNull(), "error").when(F.coalesce("n_folds", F.lit(0)) < expected_folds, "coverage").when(bad, "not_finite"))

    def best(d: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
        b = d.where("stage IS NULL").groupBy(*keys).agg(F.min(value).alias(name)).withColumnsRenamed({c: f"_b_{c}" for c in keys})
        return d.join(b, _same([F.col(c) for c in keys], [F.col(f"_b_{c}") for c in keys]), "left").drop(*[f"_b_{c}" for c in keys])

    df = best(df, [by], F.col(risk), "_best")
    df = df.withColumn("stage", F.coalesce("stage", F.when(F.col(risk) > F.col("_best") + tolerance, "plateau"))).drop("_best")
    df = best(df, [by, risk], F.struct(k, m), "_small")
    df = df.withColumn("stage", F.coalesce("stage", F.when(F.struct(k, m) > F.col("_small"), "larger"))).drop("_small")
    front = pareto_front(df.where("stage IS NULL"), [by], objectives).select(F.col(key).alias("_k")).distinct()
    df = df.join(front, F.col(key) == F.col("_k"), "left")
    return df.withColumn("stage", F.coalesce("stage", F.when(F.col("_k").isNull(), "dominated"), F.lit("selected"))).drop("_k")


def input_guardrails(panel: DataFrame, thresholds: DataFrame, flags: DataFrame, key: str, tracks: list[str], track: str, split: str, expected_split: str) -> DataFrame:
    """Checks of a final choice's inputs: the flags' split, a threshold for every panel model, no model twice, every
    expected track there. One row each with its level and what breaks it."""
    wrong_split = flags.agg(F.count_if(F.coalesce(F.col(split) != expected_split, F.lit(True))).alias("n"))
    no_threshold = panel.join(thresholds.select(key), key, "left_anti").agg(F.count("*").alias("n"))
    twice = panel.groupBy(key).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
    missing = panel.agg(F.size(F.array_except(F.array(*map(F.lit, tracks)), F.collect_set(F.col(track).cast("string")))).cast("long").alias("n"))  # tracks are few
    rows = [("split", "error", wrong_split), ("thresholds", "error", no_threshold), ("unique_models", "error", twice), ("tracks", "warning", missing)]
    out = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("check"), F.lit(level).alias("level"), "n") for name, level, d in rows])
    return out.withColumns({"passed": F.col("n") == 0, "blocks": (F.col("n") > 0) & (F.col("level") == "error")})


def metric_equivalent(df: DataFrame, key: str, metrics: list[str], protected: list[str], groups: list[list[str]], digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """One parameter group after another: of rows equal on rounded metrics, protected and all other parameters, the
    smallest key stays. What is kept, and what was dropped with its representative and the group that told."""
    every = [c for g in groups for c in g]
    dropped = []
    for n, group in enumerate(groups):
        same = [F.round(m, digits).alias(f"_k{i}") for i, m in enumerate(metrics)] + [F.col(c).alias(f"_p{i}") for i, c in enumerate([*protected, *[c for c in every if c not in group]])]
        named = df.select("*", *same)
        cols = [c for c in named.columns if c not in df.columns]
        first = named.groupBy(*cols).agg(F.min(key).alias("_first")).withColumnsRenamed({c: f"f{c}" for c in cols})
        told = named.join(first, _same([F.col(c) for c in cols], [F.col(f"f{c}") for c in cols]))
        dropped.append(told.where(F.col(key) != F.col("_first")).select(key, F.col("_first").alias("representative"), F.lit(n).alias("parameter_group")))
        df = told.where(F.col(key) == F.col("_first")).select(*df.columns)
    return df, reduce(DataFrame.unionByName, dropped)


def output_signatures(predictions: DataFrame, key: str, item: str, value: str, digits: int = 6) -> DataFrame:
    """A signature of each configuration's predictions without an order, and the smallest key that shares it. Row hashes
    are folded by map-side sums of two independent parts, so no prediction list is gathered."""
    h = lambda s: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(s), F.col(item).cast("string"), F.coalesce(F.round(value, digits).cast("string"), F.lit("null"))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    sig = predictions.groupBy(key).agg(F.count("*").alias("n_predictions"), F.sum(h("a")).alias("a"), F.sum(h("b")).alias("b"))
    sig = sig.select(key, "n_predictions", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n_predictions", "a", "b")]), 256).alias("signature"))
    least = sig.groupBy("signature").agg(F.min(key).alias("representative"), F.count("*").alias("group_size"))
    return sig.join(least, "signature")


def configuration_catalogue(runs: DataFrame, config: list[str], run: str, seed: str) -> DataFrame:
    """Runs that differ in their seed alone are one configuration, with its seeds and the smallest run."""
    return runs.groupBy(*config).agg(F.min(run).alias("first_run"), F.count_distinct(seed).alias("n_seeds"), F.array_sort(F.collect_set(seed)).alias("seeds"))


def front_reference(df: DataFrame, tracks: DataFrame, track: str, minimise: list[str], allowed: Column, key: str) -> DataFrame:
    """Per track the diagnostic front (all rows) and the protocol front (allowed rows), why others are not on it, and a
    row for each track without any."""
    diagnostic = pareto_front(df, [track], minimise).select(F.col(key).alias("_d"))
    protocol = pareto_front(df.where(allowed), [track], minimise).select(F.col(key).alias("_p"))
    out = df.withColumn("_ok", F.coalesce(allowed, F.lit(False))).join(diagnostic, F.col(key) == F.col("_d"), "left").join(protocol, F.col(key) == F.col("_p"), "left")
    out = out.withColumns({"diagnostic_front": F.col("_d").isNotNull(), "protocol_front": F.col("_p").isNotNull(), "reason": F.when(F.col("_p").isNotNull(), "on_front").when(~F.col("_ok"), "not_allowed").otherwise("dominated")})
    out = tracks.select(F.col(track).alias("_t")).distinct().join(out, F.col("_t") == F.col(track), "left")
    return out.select(F.col("_t").alias(track), key, F.coalesce("diagnostic_front", F.lit(False)).alias("diagnostic_front"), F.coalesce("protocol_front", F.lit(False)).alias("protocol_front"), F.coalesce("reason", F.lit("empty_track")).alias("reason"))


def unit_diagnostics(df: DataFrame, unit: list[str], variant: str, metrics: list[str], expected: list[str]) -> DataFrame:
    """Per unit and metric least, median, largest, interquartile range and worst over variants, and whether all expected
    variants are there."""
    covered = df.groupBy(*unit).agg((F.size(F.array_except(F.array(*map(F.lit, expected)), F.collect_set(F.col(variant).cast("string")))) == 0).alias("covered"))
    long = df.select(*unit, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(unit, metrics, "metric", "value")
    stats = long.groupBy(*unit, "metric").agg(F.min("value").alias("least"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("largest"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    return join_same(stats, covered, unit)


def artifact_gate(artifacts: DataFrame, reviews: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Every artifact with the state of its review: accepted or rejected, or pending, stale (of another fingerprint) or
    undocumented (no reviewer or comment), which block."""
    r = reviews.select(key, F.col(fingerprint).alias("_f"), "decision", "reviewer", "comment")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    state = F.when(F.col("decision").isNull(), "pending").when(~F.col(fingerprint).eqNullSafe(F.col("_f")), "stale").when(blank("reviewer") | blank("comment"), "undocumented").otherwise(F.col("decision"))
    return artifacts.join(r, key, "left").withColumn("state", state).withColumn("blocks", F.col("state").isin("pending", "stale", "undocumented")).drop("_f")


def selection_events(df: DataFrame, family: str, key: str, minimise: list[str]) -> DataFrame:
    """One event per (dominated row, dominating front row, metric) within a family: both values and whether it is
    strictly better there."""
    front = pareto_front(df, [family], minimise).select(*[F.col(c).alias(f"_f_{c}") for c in [family, key, *minimise]])
    no_worse = reduce(lambda a, b: a & b, [F.col(f"_f_{g}") <= F.col(g) for g in minimise])
    better = reduce(lambda a, b: a | b, [F.col(f"_f_{g}") < F.col(g) for g in minimise])
    met = df.join(front, F.col(family).eqNullSafe(F.col(f"_f_{family}")) & no_worse & better)
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("metric"), F.col(g).cast("double").alias("value"), F.col(f"_f_{g}").cast("double").alias("dominator_value")) for g in minimise]))
    return met.select(family, key, F.col(f"_f_{key}").alias("dominator"), cells.alias("x")).select(family, key, "dominator", "x.*").withColumn("strictly_better", F.col("dominator_value") < F.col("value"))


def audit_consistency(audit: DataFrame, registry: DataFrame, key: str, compare: Column) -> DataFrame:
    """Audit rows whose numbers do not give the recorded verdict (``passed``), or whose candidate the registry lacks."""
    known = registry.select(F.col(key).alias("_k")).distinct()
    df = audit.join(known, F.col(key) == F.col("_k"), "left")
    fault = F.when(F.col("_k").isNull(), "unknown_candidate").when(~compare.eqNullSafe(F.col("passed")), "verdict_differs")
    return df.withColumn("fault", fault).where("fault IS NOT NULL").drop("_k")


def no_score_columns(df: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """The frame itself; a column that names a test score is an error."""
    bad = [c for c in df.columns if c not in allowed and any(t in c.lower() for t in ("test_score", "pure_test", "mixture_score"))]
    if bad:
        raise ValueError(f"columns of a later stage: {bad}")
    return df


def diverse_picks(df: DataFrame, family: str, order: list, n: int, per_family: int) -> DataFrame:
    """The first ``n`` rows overall of the first ``per_family`` of each family."""
    few = df.withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where(F.col("_r") <= per_family)
    return few.drop("_r").orderBy(*order).limit(n)  # a top-n report


def picked_images(df: DataFrame, config: str, image: str, metric: str) -> DataFrame:
    """Per configuration its worst, best and most middling image by a metric (ties by name)."""
    m = df.groupBy(config).agg(F.percentile(metric, 0.5).alias("_m"), F.min(F.struct((-F.col(metric)).alias("v"), image))[image].alias("worst"), F.min(F.struct(metric, image))[image].alias("best"))
    mid = join_same(df, m, [config]).groupBy(config, "worst", "best").agg(F.min(F.struct(F.abs(F.col(metric) - F.col("_m")).alias("v"), image))[image].alias("middle"))
    return mid
