"""Runs of SIMCA configurations over pixel tables: grids, folds, locked batches, held-out tests and mixtures. All of them
are grids of one plan (``grid.fit_grid``) with their own splits; failures are rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.operators import grid
from prismata.operators.catalog import join_covered
from prismata.operators.decisions import rates
from prismata.operators.grid import Config
from prismata.plans.nulls import join_same
from prismata.sources.tables import stable_id

_ID = ["chain", "k", "variant", "alpha", "m", "seed"]


def settings_of(settings: list[tuple[str, list[int], list[str]]], alpha: float) -> list[Config]:
    """Chain, numbers of components and rules as configurations."""
    return [Config(name, k, rule, alpha) for name, ks, rules in settings for k in ks for rule in rules]


def run_grid(train: DataFrame, projected: DataFrame, configs: list[Config], target: str, thresholds: list[float]) -> DataFrame:
    """Per configuration and object threshold the rates of object decisions on the projected rows; a configuration
    that cannot be fitted gives one row with its ``error``. Truth of an object is its class."""
    out = grid.fit_grid(grid.simple_roles(train, projected), configs, target).metrics(thresholds)
    return out.drop("setting", "split")


def out_of_fold_grid(rows: DataFrame, fold: str, target: str, settings: list[tuple[str, list[int], list[str]]], alpha: float = 0.05) -> grid.Grid:
    """Every fold under models of the others, with the tables, events and diagnostics of ``grid.Grid``."""
    return grid.fit_grid(grid.fold_roles(rows, fold), settings_of(settings, alpha), target)


def out_of_fold(rows: DataFrame, fold: str, target: str, settings: list[tuple[str, list[int], list[str]]], alpha: float = 0.05) -> DataFrame:
    """The pixels of ``out_of_fold_grid``: one row per pixel, k and rule with statistic, limit, ratio and margin."""
    p = out_of_fold_grid(rows, fold, target, settings, alpha).pixels()
    return p.select(F.col("split").cast(rows.schema[fold].dataType).alias(fold), "chain", "k", F.col("variant").alias("rule"), "vec_id", "object", "image", "truth", "h", "q", "statistic", "limit", "ratio", "margin")


def locked_refit(rows: DataFrame, train_batches: list[int], projection_batches: list[int], forbidden: list[int], target: str, settings: list[tuple[str, list[int], list[str]]], alpha: float = 0.05) -> DataFrame:
    """One projection of the validation batches per setting, with its ``projection_id``: batches and configuration decide
    it. Batches must not overlap, and none may be forbidden."""
    if set(train_batches) & set(projection_batches) or (set(train_batches) | set(projection_batches)) & set(forbidden):
        raise ValueError("training, projection and forbidden batches must be apart")
    train, proj = rows.where(F.col("batch").isin(train_batches)), rows.where(F.col("batch").isin(projection_batches))
    p = grid.fit_grid(grid.simple_roles(train, proj), settings_of(settings, alpha), target).pixels()
    p = p.withColumns({"_train": F.lit(",".join(map(str, sorted(train_batches)))), "_proj": F.lit(",".join(map(str, sorted(projection_batches))))})
    ident = stable_id("prj", ["_train", "_proj", "chain", "matrix", "k", "variant", "alpha", "m", "seed"])
    return p.select(ident.alias("projection_id"), "chain", "k", F.col("variant").alias("rule"), "vec_id", "object", "image", "class", "truth", "h", "q", "statistic", "limit", "ratio", "margin")


@dataclass
class HeldOut:
    """Outputs of configurations on held-out rows; two-way decisions are those of the rules, three-way ones of thresholds."""

    pixels: DataFrame
    objects: DataFrame
    by: list[str]

    def two_way(self, level: str = "objects", image: bool = False) -> DataFrame:
        """Rates per configuration (and image) of object votes (half of the pixels or more) or pixel decisions."""
        df = self.objects.withColumn("prediction", F.col("ratio") >= 0.5) if level == "objects" else self.pixels.withColumn("prediction", F.col("decision"))
        return df.groupBy(*self.by, *(["image"] if image else [])).agg(F.count("*").alias("n"), *rates())

    def three_way(self, image: bool = False) -> DataFrame:
        """Per configuration (and image): objects, misses, false accepts and uncertain ones of the three-way decision."""
        t, d = F.col("truth"), F.col("decision")
        out = self.objects.groupBy(*self.by, *(["image"] if image else [])).agg(F.count("*").alias("n_objects"), F.count_if(t).alias("n_target"), F.count_if(t & (d == "non_target")).alias("n_missed"), F.count_if(~t & (d == "target")).alias("n_false_accepted"), F.count_if(d == "uncertain").alias("n_uncertain"))
        n, nt = F.col("n_objects"), F.col("n_target")
        return out.withColumns({"miss_rate": F.try_divide("n_missed", nt), "false_accept_rate": F.try_divide(F.col("n_false_accepted"), n - nt), "uncertain_rate": F.try_divide("n_uncertain", n), "coverage": 1 - F.try_divide("n_uncertain", n)})


def held_out_test(train: DataFrame, test: DataFrame, configs: list[Config], target: str, thresholds: DataFrame) -> HeldOut:
    """Refit locked configurations on ``train``, score ``test`` and decide: an object is target from the ``upper`` share of
    accepted pixels on, non-target up to the ``lower``, uncertain between. ``thresholds`` has ``_ID``, lower and upper (and
    more columns, such as a track, that stay); a configuration without thresholds is an error."""
    g = grid.fit_grid(grid.simple_roles(train, test), configs, target)
    p = join_covered(g.pixels(), thresholds, _ID, "upper")
    o = join_covered(g.objects(), thresholds, _ID, "upper")
    decision = F.when(F.col("ratio") >= F.col("upper"), "target").when(F.col("ratio") <= F.col("lower"), "non_target").otherwise("uncertain")
    more = [c for c in thresholds.columns if c not in (*_ID, "lower", "upper")]
    return HeldOut(p, o.withColumn("decision", decision), [*_ID, *more])


def mixture_application(train: DataFrame, mixtures: DataFrame, configs: list[Config], target: str, thresholds: DataFrame, track: str) -> tuple[DataFrame, DataFrame]:
    """Locked configurations on rows without truth: every object with votes, decision and the configuration's ``track``, and per
    track, configuration and image the shares of decisions."""
    out = held_out_test(train, mixtures, configs, target, thresholds).objects.drop("truth", "class")
    shares = out.groupBy(track, *_ID, "image").agg(F.count("*").alias("n_objects"), *[F.avg((F.col("decision") == x).cast("double")).alias(f"{x}_rate") for x in ("target", "non_target", "uncertain")])
    return out, shares


def configuration_validity(plan: DataFrame, pca: DataFrame) -> DataFrame:
    """``plan(k, alpha)`` against every class's eigensystem: ``valid`` or the first reason against it."""
    facts = pca.select("model", "n", F.size("mean").alias("bands"), "rank")
    k, alpha = F.col("k"), F.col("alpha")
    status = F.when(k < 1, "components_not_positive").when((alpha <= 0) | (alpha >= 1), "alpha_out_of_range").when(k > F.col("bands"), "components_above_bands").when(k >= F.col("n"), "too_few_target_rows").when(k > F.col("rank"), "components_above_rank").otherwise("valid")
    return facts.crossJoin(F.broadcast(plan)).withColumn("status", status)  # the plan is a parameter


def technical_audit(metrics: DataFrame) -> DataFrame:
    """Per configuration whether it can be used: not with an error row, without a metric row, or with a balanced accuracy
    that could not be computed."""
    df = metrics.groupBy(*_ID).agg(F.max("error").alias("error"), F.count("threshold").alias("n_metric_rows"), F.count_if(F.col("threshold").isNotNull() & F.col("balanced_accuracy").isNull()).alias("n_undefined"))
    reason = F.when(F.col("error").isNotNull(), F.concat(F.lit("error:"), F.col("error"))).when(F.col("n_metric_rows") == 0, "no_metrics").when(F.col("n_undefined") > 0, "undefined_metric")
    return df.withColumns({"valid": reason.isNull(), "reason": reason})


def prediction_audit(g: grid.Grid, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``technical_audit`` with what the predictions say: also a configuration without a prediction, or with a statistic
    that is not finite, is no valid one. The audit, and the metric rows of the valid configurations."""
    broken = F.col("statistic").isNull() | F.isnan("statistic") | (F.abs("statistic") == float("inf"))
    seen = g.pixels().groupBy(*_ID).agg(F.count("*").alias("n_predictions"), F.count_if(broken).alias("n_broken"))
    out = join_same(technical_audit(metrics), seen, _ID, "left").fillna(0, ["n_predictions", "n_broken"])
    reason = F.coalesce("reason", F.when(F.col("n_predictions") == 0, "no_predictions").when(F.col("n_broken") > 0, "prediction_not_finite"))
    out = out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    return out, join_same(metrics, out.where("valid").select(*_ID), _ID, "left_semi")
