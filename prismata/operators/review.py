"""Alerts and their reviews, retention funnels, threshold policies across folds and search audits.

Every operator is one or two aggregations with map-side combining; lists of rules, stages, grids and metrics are
parameters, so what they expand to is bounded. A condition that is NULL counts as not met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.operators.decisions import three_way_rates
from prismata.plans.nulls import join_same

# fixed values: decisions of a review and the status each leads to
STATUS = {"accept_as_is": "accepted", "exclude": "excluded", "correct_segmentation": "needs_new_cycle"}


def alerts(df: DataFrame, record_type: str, record_id: str, rules: list[tuple[str, Column, str, list[str]]]) -> DataFrame:
    """One row per record and met rule (flag, condition, severity, evidence columns), with an id from a hash. A
    record that raises the same flag twice is an error."""
    ident = F.col(record_id).cast("string")
    hits = F.array(*[F.when(F.coalesce(met, F.lit(False)), F.struct(F.lit(flag).alias("flag_type"), F.lit(level).alias("severity"), F.to_json(F.struct(*evidence)).alias("evidence_json"))) for flag, met, level, evidence in rules])
    rows = df.select(ident.alias("record_id"), F.explode(F.array_compact(hits)).alias("a")).select("record_id", "a.*")
    rows = rows.groupBy("record_id", "flag_type").agg(F.count("*").alias("n"), F.first("severity").alias("severity"), F.first("evidence_json").alias("evidence_json"))
    once = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("alert raised twice: "), F.coalesce("record_id", F.lit("null"))))).otherwise(F.sha2(F.to_json(F.struct(F.lit(record_type).alias("record_type"), "record_id", "flag_type"), {"ignoreNullFields": "false"}), 256))
    return rows.select(F.lit(record_type).alias("record_type"), "record_id", "flag_type", once.alias("alert_id"), "severity", "evidence_json")


def missing_fields(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Records that lack a required field, with the names of those they lack."""
    lacks = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    return df.select(key, lacks.alias("missing")).where("missing <> ''")


def merge_reviews(flags: DataFrame, stored: DataFrame, key: str = "alert_id") -> DataFrame:
    """Every alert with its stored review, or pending without one."""
    s = stored.select(key, "review_decision", "reviewer", "review_date", "review_comment", F.lit("reviewed").alias("_status"))
    return flags.join(s, key, "left").withColumn("review_status", F.coalesce("_status", F.lit("pending"))).drop("_status")


def open_reviews(review: DataFrame) -> DataFrame:
    """Reviews that keep a quality check from closing, with the first reason."""
    blank = lambda c: F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == ""
    known = F.coalesce(F.col("review_decision").isin(*STATUS), F.lit(False))
    reason = (
        F.when(F.col("review_status") != "reviewed", "pending").when(~known, "invalid_decision").when(blank("reviewer"), "no_reviewer")
        .when(blank("review_date"), "no_date").when(F.try_to_timestamp(F.col("review_date").cast("string"), F.lit("yyyy-MM-dd")).isNull(), "bad_date").when(blank("review_comment"), "no_comment")
    )
    return review.withColumn("reason", reason).where("reason IS NOT NULL")


def apply_reviews(review: DataFrame) -> DataFrame:
    """``qc_status`` of every alert, whether its record is excluded and whether a new cycle is due."""
    status = reduce(lambda c, x: c.when(F.col("review_decision") == x[0], x[1]), STATUS.items(), F.when(F.col("review_status") != "reviewed", "pending"))
    return review.withColumn("qc_status", F.coalesce(status, F.lit("pending"))).withColumns({"excluded": F.col("qc_status") == "excluded", "new_cycle": F.col("qc_status") == "needs_new_cycle"})


def closure(applied: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group; closed where nothing is pending."""
    return applied.groupBy(*by).agg(
        F.count("*").alias("n_alerts"), F.count_if(F.col("qc_status") == "pending").alias("n_pending"), F.count_if("excluded").alias("n_excluded"), F.count_if("new_cycle").alias("n_new_cycle"),
        F.when(F.count_if(F.col("qc_status") == "pending") == 0, "closed").otherwise("pending").alias("state"),
    )


def retention_funnel(df: DataFrame, by: list[str], stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows that enter and leave each stage; a row fails at its first unmet condition. One aggregation for all stages."""
    met = [F.coalesce(c, F.lit(False)) for _, c in stages]
    passed = [reduce(lambda a, b: a & b, met[: i + 1]) for i in range(len(met))]
    counts = [F.count("*").alias("_0"), *[F.count_if(p).alias(f"_{i + 1}") for i, p in enumerate(passed)]]
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"_{i}").alias("n_entering"), F.col(f"_{i + 1}").alias("n_retained")) for i, (name, _) in enumerate(stages)]))
    return df.groupBy(*by).agg(*counts).select(*by, rows.alias("s")).select(*by, "s.*", (F.col("s.n_entering") - F.col("s.n_retained")).alias("n_failed"))


def in_shortlist(df: DataFrame, shortlist: DataFrame, keys: list[str], keep: bool = True) -> DataFrame:
    """Rows whose keys the shortlist names (or does not name); NULL keys are never named."""
    return df.join(shortlist.select(*keys), keys, "left_semi" if keep else "left_anti")


def snap(value: Column, grid: list[float]) -> Column:
    """The nearest grid value, the lesser of two equally near."""
    near = F.array_min(F.array(*[F.struct(F.abs(value - g).alias("d"), F.lit(float(g)).alias("g")) for g in sorted(grid)]))
    return F.when(value.isNotNull(), near["g"])


def crossfit_rates(df: DataFrame, score: str, by: list[str], fold: str, centre: float, lower: float, upper: float) -> DataFrame:
    """Per evaluation fold, thresholds are quantiles of the other folds' scores on either side of the centre, and
    rates those of the fold's own rows; fold -1 takes all rows for both. Scores are counted per fold first, so that
    only distinct scores are repeated for the folds."""
    counted = df.groupBy(*by, fold, F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    folds = df.select(F.col(fold).cast("long").alias("evaluation_fold")).where("evaluation_fold IS NOT NULL").distinct().agg(F.collect_set("evaluation_fold").alias("_all"))  # folds are few by definition
    spread = counted.join(F.broadcast(folds)).select(*by, fold, "_s", "_n", F.explode(F.array_append("_all", F.lit(-1).cast("long"))).alias("evaluation_fold")).where(F.col(fold) != F.col("evaluation_fold"))
    cut = lambda side, q: F.percentile(F.when(side, F.col("_s")), q, F.col("_n"))
    cuts = spread.groupBy(*by, "evaluation_fold").agg(cut(F.col("_s") < centre, lower).alias("lower"), cut(F.col("_s") > centre, upper).alias("upper"))
    held = df.select(*by, score, "truth", F.explode(F.array(F.col(fold).cast("long"), F.lit(-1).cast("long"))).alias("evaluation_fold"))
    d = F.when(F.col(score) >= F.col("upper"), "target").when(F.col(score) <= F.col("lower"), "non_target").otherwise("uncertain")
    return three_way_rates(join_same(held, cuts, [*by, "evaluation_fold"]).withColumn("decision", d), [*by, "evaluation_fold", "lower", "upper"])


def aggregate_policies(df: DataFrame, by: list[str], run: list[str], metric: str, value: str, metrics: list[str]) -> DataFrame:
    """Mean and worst (largest) of each metric over runs, and how many runs there are."""
    each = [f(F.when(F.col(metric) == m, F.col(value))).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("worst", F.max))]
    return df.groupBy(*by).agg(F.count_distinct(F.struct(*run)).alias("n_runs"), *each)


def audit_summary(audit: DataFrame, levels: list[str]) -> DataFrame:
    """Counts by all levels and their subtotals, ``all`` standing for a level summed over."""
    return audit.rollup(*levels).agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).select(*[F.when(F.col("_g").bitwiseAND(1 << (len(levels) - 1 - i)) != 0, "all").otherwise(F.col(c).cast("string")).alias(c) for i, c in enumerate(levels)], "n")


def model_metrics(df: DataFrame, model: str, scope: str, metrics: list[str]) -> DataFrame:
    """Long ``scope.metric`` rows per model, and ``safety.metric``, its largest value over the scopes."""
    long = df.unpivot([model, scope], metrics, "metric", "value")
    worst = long.groupBy(model, "metric").agg(F.max("value").alias("value")).select(model, F.concat(F.lit("safety."), "metric").alias("key"), "value")
    return long.select(model, F.concat_ws(".", scope, "metric").alias("key"), "value").unionByName(worst)


def search_efficiency(trials: DataFrame, universe: DataFrame, front: DataFrame, track: str, config: str) -> DataFrame:
    """Per track: unique trials, share of repeats, coverage of the universe, recall of the front, and what as many
    uniform draws would be expected to reach."""
    n, n_front = universe.select(config).distinct().count(), front.select(config).distinct().count()
    per = trials.groupBy(track, config).agg(F.count("*").alias("n")).join(front.select(config, F.lit(True).alias("_hit")).distinct(), config, "left")
    got = per.groupBy(track).agg(F.sum("n").alias("n_trials"), F.count("*").alias("n_unique"), (F.count("_hit") / (n_front or None)).alias("front_recall"))
    got = got.withColumns({"duplicate_rate": 1 - F.col("n_unique") / F.col("n_trials"), "coverage": F.col("n_unique") / (n or None), "expected": 1 - F.pow(F.lit(1 - 1 / n if n else None), F.col("n_trials"))})
    return got.withColumns({"delta": F.col("front_recall") - F.col("expected"), "lift": F.try_divide("front_recall", "expected")})


def first_trials(trials: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first trial of each configuration, by a minimum that combines before the shuffle."""
    rest = [c for c in trials.columns if c not in {*by, *order}]
    return trials.groupBy(*by).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_f")).select(*by, "_f.*")
