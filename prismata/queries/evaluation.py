"""Queries of object decisions, grids, choices and the evaluation of stored thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.operators import decisions, evaluation
from prismata.registry import BANDS, M, RATES, margins, pixels, query, read, rounded  # noqa: F401

PAIRS = [(0.1, 0.5), (0.2, 0.6), (0.3, 0.7), (0.4, 0.8), (0.25, 0.75)]
_PAIRS = "(VALUES (0.1, 0.5), (0.2, 0.6), (0.3, 0.7), (0.4, 0.8), (0.25, 0.75)) g(lower, upper)"
OBJ = f"{M}, o AS (SELECT object, min(image) AS image, fold, count(*) AS n_pixels, avg(CAST(score >= 0 AS DOUBLE)) AS ratio, avg(CAST(truth AS DOUBLE)) >= 0.5 AS truth FROM m GROUP BY object, fold)"
_D = "CASE WHEN {r} >= upper THEN 'target' WHEN {r} < lower THEN 'non_target' WHEN {r} IS NOT NULL THEN 'uncertain' END"


def objects(s, d):
    m = margins(s, d)
    return m.groupBy("object", "fold").agg(F.min("image").alias("image"), F.count("*").alias("n_pixels"), F.avg((F.col("score") >= 0).cast("double")).alias("ratio"), (F.avg(F.col("truth").cast("double")) >= 0.5).alias("truth"))


def fold_thresholds(s):
    return s.createDataFrame([(0, 0.2, 0.6), (1, 0.3, 0.8)], "fold long, lower double, upper double")


_FT = "(VALUES (0, 0.2, 0.6), (1, 0.3, 0.8)) c(fold, lower, upper)"


@query("d2_three_way_by_config", f"{OBJ}, x AS (SELECT o.fold, {_D.format(r='ratio')} AS decision FROM o JOIN {_FT} ON o.fold = c.fold) SELECT fold, decision, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY fold), 6) AS rate FROM x GROUP BY fold, decision")
def _(s, d):
    return rounded(evaluation.decision_shares(evaluation.decide_by_config(objects(s, d), fold_thresholds(s), "fold"), ["fold"]))


@query("d3_object_metadata", f"{OBJ} SELECT object, ratio, o_orderstatus, o_orderpriority FROM o LEFT JOIN orders ON o_orderkey = object")
def _(s, d):
    facts = read(s, d, "orders").withColumnRenamed("o_orderkey", "object")
    return evaluation.attach(objects(s, d), facts, ["object"], ["o_orderstatus", "o_orderpriority"]).select("object", "ratio", "o_orderstatus", "o_orderpriority")


@query("d5_object_threshold_grid", f"{OBJ}, x AS (SELECT threshold, truth, ratio >= threshold AS prediction FROM o, (VALUES (0.25), (0.5), (0.75)) t(threshold)) SELECT CAST(threshold AS DOUBLE) AS threshold, {RATES} FROM x GROUP BY threshold")
def _(s, d):
    return rounded(evaluation.object_threshold_grid(objects(s, d), [0.25, 0.5, 0.75], []))


@query(
    "d6_core_width_grid",
    f"{M}, v AS (SELECT image, width, count_if(width = 0 OR line > width) AS n_core, avg(CASE WHEN width = 0 OR line > width THEN CAST(score >= 0 AS DOUBLE) END) AS core, avg(CAST(score >= 0 AS DOUBLE)) AS al, avg(CAST(truth AS DOUBLE)) >= 0.5 AS truth FROM m, (VALUES (0), (2), (4)) w(width) GROUP BY image, width), "
    f"x AS (SELECT width, threshold, n_core < 20 AS fallback, truth, CASE WHEN n_core < 20 THEN al ELSE core END >= threshold AS prediction FROM v, (VALUES (0.4), (0.5)) t(threshold)) SELECT width, CAST(threshold AS DOUBLE) AS threshold, round(avg(CAST(fallback AS DOUBLE)), 6) AS fallback_rate, {RATES} FROM x GROUP BY width, threshold",
)
def _(s, d):
    p = margins(s, d).withColumn("prediction", F.col("score") >= 0)
    return rounded(evaluation.core_vote_grid(p, ["image"], "line", [0, 2, 4], [0.4, 0.5]))


@query("d8_confusion_cases", f"{M} SELECT CASE WHEN line > 5 THEN 'unavailable' WHEN truth AND score >= 0 THEN 'TP' WHEN NOT truth AND score < 0 THEN 'TN' WHEN NOT truth AND score >= 0 THEN 'FP' ELSE 'FN' END AS kind, fold, count(*) AS n FROM m GROUP BY ALL")
def _(s, d):
    p = margins(s, d).withColumn("prediction", F.col("score") >= 0)
    return p.groupBy(evaluation.confusion_case(available=F.col("line") <= 5).alias("kind"), "fold").agg(F.count("*").alias("n"))


@query(
    "d12_border_zone_errors",
    f"{M} SELECT fold, width, CASE WHEN width > 0 AND line <= width THEN 'border' ELSE 'core' END AS zone, count(*) AS n, count_if(truth) AS n_target, count_if(NOT truth) AS n_other, count_if(truth AND score < 0) AS fn, count_if(NOT truth AND score >= 0) AS fp, round((count_if(truth AND score < 0) + count_if(NOT truth AND score >= 0)) / greatest(count(*), 1), 6) AS error_rate, "
    "round(count_if(truth AND score < 0) / greatest(count_if(truth), 1), 6) AS fn_rate, round(count_if(NOT truth AND score >= 0) / greatest(count_if(NOT truth), 1), 6) AS fp_rate FROM m, (VALUES (0), (1), (3)) w(width) GROUP BY ALL",
)
def _(s, d):
    p = margins(s, d).withColumn("prediction", F.col("score") >= 0)
    return rounded(evaluation.border_zone_errors(p, ["fold"], "line", [0, 1, 3]))


_GRID = (
    f"{OBJ}, x AS (SELECT fold, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, truth, {_D.format(r='ratio')} AS decision FROM o, {_PAIRS}), "
    "g AS (SELECT fold, lower, upper, count_if(truth AND decision = 'non_target') / nullif(count_if(truth), 0) AS target_miss_rate, count_if(NOT truth AND decision = 'target') / nullif(count_if(NOT truth), 0) AS false_accept_rate, count_if(decision = 'uncertain') / count(*) AS uncertain_rate, count_if(decision <> 'uncertain') / count(*) AS coverage_rate, "
    "(count_if(truth AND decision = 'target') / nullif(count_if(truth AND decision <> 'uncertain'), 0) + count_if(NOT truth AND decision = 'non_target') / nullif(count_if(NOT truth AND decision <> 'uncertain'), 0)) / 2 AS decided_balanced_accuracy FROM x GROUP BY fold, lower, upper)"
)


@query("d14_three_way_object_grid", f"{_GRID} SELECT fold, lower, upper, round(target_miss_rate, 6) AS target_miss_rate, round(false_accept_rate, 6) AS false_accept_rate, round(uncertain_rate, 6) AS uncertain_rate, round(coverage_rate, 6) AS coverage_rate, round(decided_balanced_accuracy, 6) AS decided_balanced_accuracy FROM g")
def _(s, d):
    return rounded(evaluation.three_way_object_grid(objects(s, d), PAIRS, ["fold"]))


@query(
    "d15_three_way_choice",
    f"{_GRID}, f AS (SELECT *, count_if(target_miss_rate <= 0.5 AND uncertain_rate <= 0.4) OVER (PARTITION BY fold) AS n_feasible FROM g), a AS (SELECT * FROM f WHERE n_feasible = 0 OR (target_miss_rate <= 0.5 AND uncertain_rate <= 0.4)), "
    "p AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.fold = a.fold AND b.target_miss_rate <= a.target_miss_rate AND b.false_accept_rate <= a.false_accept_rate AND b.uncertain_rate <= a.uncertain_rate AND b.coverage_rate >= a.coverage_rate AND (b.target_miss_rate < a.target_miss_rate OR b.false_accept_rate < a.false_accept_rate OR b.uncertain_rate < a.uncertain_rate OR b.coverage_rate > a.coverage_rate))) "
    "SELECT fold, lower, upper, round(target_miss_rate, 6) AS target_miss_rate, round(false_accept_rate, 6) AS false_accept_rate, round(uncertain_rate, 6) AS uncertain_rate, round(coverage_rate, 6) AS coverage_rate, n_feasible, 'acceptable' AS selection_status FROM p QUALIFY row_number() OVER (PARTITION BY fold ORDER BY target_miss_rate, false_accept_rate, uncertain_rate, coverage_rate DESC, lower, upper) = 1",
)
def _(s, d):
    return rounded(evaluation.choose_three_way(evaluation.three_way_object_grid(objects(s, d), PAIRS, ["fold"]), ["fold"], 0.5, max_uncertain=0.4))


def decided(s, d):
    return margins(s, d).withColumn("truth", F.col("object") % 3 == 0).withColumn("decision", decisions.locked_three_way("score", -0.2, 0.2))


DEC = f"{M}, x AS (SELECT object, image, fold, line, score, object % 3 = 0 AS truth, CASE WHEN score >= 0.2 THEN 'target' WHEN score >= -0.2 THEN 'uncertain' ELSE 'non_target' END AS decision FROM m)"


def grouped_sql(by: str) -> str:
    return (
        f"SELECT {by}, CAST(sum(n) AS BIGINT) AS n_observations, CAST(sum(nt) AS BIGINT) AS n_target, CAST(sum(nu) AS BIGINT) AS n_uncertain, CAST(sum(tu) AS BIGINT) AS n_target_uncertain, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, count_if(t) AS n_target_objects, avg(CASE WHEN t THEN fn / nt END) AS macro_object_target_miss_rate, "
        "CAST(sum(n) - sum(nt) AS BIGINT) AS n_non_target, CAST(sum(nu) - sum(tu) AS BIGINT) AS n_non_target_uncertain, sum(fn) / nullif(sum(nt), 0) AS target_miss_rate, sum(fp) / nullif(sum(n) - sum(nt), 0) AS false_accept_rate, sum(nu) / sum(n) AS uncertain_rate, sum(tu) / nullif(sum(nt), 0) AS target_uncertain_rate, (sum(nu) - sum(tu)) / nullif(sum(n) - sum(nt), 0) AS non_target_uncertain_rate, 1 - sum(nu) / sum(n) AS coverage_rate, "
        "(sum(tp) / nullif(sum(tp) + sum(fn), 0) + sum(tn) / nullif(sum(tn) + sum(fp), 0)) / 2 AS decided_balanced_accuracy "
        f"FROM (SELECT {by}, object, max(truth) AS t, count(*) AS n, count_if(truth) AS nt, count_if(decision = 'uncertain') AS nu, count_if(truth AND decision = 'uncertain') AS tu, count_if(truth AND decision = 'target') AS tp, count_if(truth AND decision = 'non_target') AS fn, count_if(NOT truth AND decision = 'target') AS fp, count_if(NOT truth AND decision = 'non_target') AS tn FROM x GROUP BY {by}, object) GROUP BY {by}"
    )


_GROUPED = ["target_miss_rate", "false_accept_rate", "uncertain_rate", "target_uncertain_rate", "non_target_uncertain_rate", "coverage_rate", "decided_balanced_accuracy", "macro_object_target_miss_rate"]


@query("d16_grouped_decisions", f"{DEC}, g AS ({grouped_sql('image')}) SELECT image, n_observations, n_target, n_uncertain, n_target_uncertain, tp, fn, fp, tn, n_target_objects, " + ", ".join(f"round({c}, 6) AS {c}" for c in _GROUPED) + " FROM g")
def _(s, d):
    return rounded(evaluation.grouped_decisions(decided(s, d), ["image"], "object").select("image", "n_observations", "n_target", "n_uncertain", "n_target_uncertain", "tp", "fn", "fp", "tn", "n_target_objects", *_GROUPED))


def _ci(m: str, fold: str = "fold") -> str:
    half = f"coalesce(1.959963984540054 * stddev_samp({m}) / sqrt(count({m})), 0)"
    return f"round(avg({m}), 6) AS macro_image_{m}, round(greatest(0, avg({m}) - {half}), 6) AS macro_image_{m}_ci_low, round(least(1, avg({m}) + {half}), 6) AS macro_image_{m}_ci_high"


@query(
    "d18_macro_images",
    f"{DEC}, g AS ({grouped_sql('fold, image')}) SELECT fold, count(*) AS n_images, {', '.join(_ci(m) for m in evaluation.MACRO)}, round(1 - (avg(target_miss_rate) + avg(false_accept_rate)) / 2, 6) AS macro_image_balanced_accuracy FROM g GROUP BY fold",
)
def _(s, d):
    out = evaluation.macro_images(evaluation.grouped_decisions(decided(s, d), ["fold", "image"], "object"), ["fold"])
    return rounded(out.drop("macro_image_balanced_accuracy_ci_low", "macro_image_balanced_accuracy_ci_high"))


def _locked(s, d):
    t = s.createDataFrame([(0, -0.2, 0.2), (1, -0.1, 0.3), (2, 0.3, 0.1)], "fold long, lower double, upper double")
    return evaluation.locked_evaluation(margins(s, d).withColumn("truth", F.col("object") % 3 == 0), t, "fold", "image", "object", "score")


_LOCK = f"{M}, x AS (SELECT object, image, m.fold, object % 3 = 0 AS truth, CASE WHEN score >= upper THEN 'target' WHEN score >= lower THEN 'uncertain' ELSE 'non_target' END AS decision FROM m JOIN (VALUES (0, -0.2, 0.2), (1, -0.1, 0.3)) c(fold, lower, upper) ON m.fold = c.fold), e AS ({grouped_sql('fold')}), i AS ({grouped_sql('fold, image')})"
_NAMES = ["target_miss_rate", "false_accept_rate", "uncertain_rate", "coverage_rate", "macro_object_target_miss_rate"]


@query("d19_locked_evaluation", f"{_LOCK} " + " UNION ALL ".join(f"SELECT fold, NULL AS image, '{m}' AS metric, round({m}, 6) AS value, 'calculable' AS status FROM e UNION ALL SELECT fold, image, '{m}', round({m}, 6), 'calculable' FROM i" for m in _NAMES) + " UNION ALL SELECT 2, NULL, NULL, NULL, 'technical_failure'")
def _(s, d):
    return rounded(_locked(s, d))


@query(
    "d20_guardrails",
    f"{_LOCK}, a AS (" + " UNION ALL ".join(f"SELECT fold, 'overall' AS scope, '{m}' AS metric, {m} AS value FROM e UNION ALL SELECT fold, CAST(image AS VARCHAR), '{m}', {m} FROM i" for m in _NAMES[:3]) + "), "
    "b AS (SELECT fold, scope, l.metric, value, CASE WHEN value IS NULL THEN 'missing' WHEN value > fl THEN 'fail' WHEN value > warn THEN 'warning' ELSE 'pass' END AS status FROM a JOIN (VALUES ('target_miss_rate', 0.2, 0.25), ('false_accept_rate', 0.5, 0.6), ('uncertain_rate', 0.3, 0.5)) l(metric, warn, fl) ON a.metric = l.metric), "
    "c AS (SELECT *, max(scope = 'overall' AND status = 'fail') OVER (PARTITION BY fold, metric) AS bad FROM b) SELECT fold, scope, metric, round(value, 6) AS value, CASE WHEN bad AND status = 'pass' THEN 'warning' ELSE status END AS status FROM c",
)
def _(s, d):
    limits = s.createDataFrame([("target_miss_rate", "<=", 0.2, 0.25), ("false_accept_rate", "<=", 0.5, 0.6), ("uncertain_rate", "<=", 0.3, 0.5)], "metric string, operator string, warn double, fail double")
    m = _locked(s, d).where("status = 'calculable'").withColumn("scope", F.coalesce(F.col("image").cast("string"), F.lit("overall")))
    return rounded(evaluation.guardrails(m.drop("status"), limits, "fold").select("fold", "scope", "metric", "value", "status"))


@query("d21_finite_reducers", "SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(max(v), 6) AS largest, count(v) AS n_finite FROM (SELECT event_type, CASE WHEN event_id % 7 > 1 THEN value END AS v FROM events) GROUP BY event_type")
def _(s, d):
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 7 == 1, float("inf")).otherwise(F.col("value"))
    return rounded(evaluation.finite_reducers(read(s, d, "events").withColumn("value", v), ["event_type"], "value"))


_W = "sum(CASE WHEN {n} > 0 THEN {r} * {n} END) / nullif(sum(CASE WHEN {n} > 0 AND {r} IS NOT NULL THEN {n} END), 0)"
_FOLD = (
    f"{DEC}, c AS (SELECT *, image % 5 AS cfg FROM x), f AS ({grouped_sql('cfg, fold').replace('FROM x', 'FROM c')}), i AS ({grouped_sql('cfg, image').replace('FROM x', 'FROM c')}), "
    f"a AS (SELECT cfg, count(*) AS n_folds, CAST(sum(n_observations) AS BIGINT) AS n_observations, {_W.format(r='target_miss_rate', n='n_target')} AS tm, {_W.format(r='false_accept_rate', n='n_non_target')} AS fa, {_W.format(r='uncertain_rate', n='n_observations')} AS un, {_W.format(r='target_uncertain_rate', n='n_target')} AS tu, {_W.format(r='non_target_uncertain_rate', n='n_non_target')} AS nu, "
    "max(target_miss_rate) AS w1, max(false_accept_rate) AS w2, stddev_pop(decided_balanced_accuracy) AS sd FROM f GROUP BY cfg), b AS (SELECT cfg, count(*) AS n_images, avg(target_miss_rate) AS m1, avg(false_accept_rate) AS m2 FROM i GROUP BY cfg) "
)


@query(
    "d22_fold_aggregation",
    _FOLD + "SELECT cfg, n_folds, n_observations, round(tm, 6) AS target_miss_rate, round(fa, 6) AS false_accept_rate, round(un, 6) AS uncertain_rate, round(w1, 6) AS worst_fold_target_miss_rate, round(w2, 6) AS worst_fold_false_accept_rate, round(sd, 6) AS fold_metric_std, round(1 - un, 6) AS coverage_rate, round(((1 - tm - tu) / (1 - tu) + (1 - fa - nu) / (1 - nu)) / 2, 6) AS decided_balanced_accuracy, n_images, round(m1, 6) AS macro_image_target_miss_rate, round(m2, 6) AS macro_image_false_accept_rate, round(1 - (m1 + m2) / 2, 6) AS macro_image_balanced_accuracy, 'calculable' AS technical_status, "
    "CASE WHEN w1 <= 0.4 AND sd <= 0.05 THEN 'acceptable' ELSE 'calculable_not_acceptable' END AS acceptability_status, concat_ws(';', CASE WHEN NOT w1 <= 0.4 THEN 'worst_fold_target_miss_rate' END, CASE WHEN NOT sd <= 0.05 THEN 'fold_metric_std' END) AS failure_reason FROM a JOIN b USING (cfg)",
)
def _(s, d):
    x = decided(s, d).withColumn("cfg", F.col("image") % 5)
    out = evaluation.fold_aggregation(evaluation.grouped_decisions(x, ["cfg", "fold"], "object"), evaluation.grouped_decisions(x, ["cfg", "image"], "object"), "cfg")
    return rounded(evaluation.acceptability(out, [("worst_fold_target_miss_rate", "<=", 0.4), ("fold_metric_std", "<=", 0.05)]))


_BLOCK = f"{M}, p AS (SELECT fold, image, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, count_if(truth) AS nt, count_if(NOT truth) AS nf, count_if(truth AND score <= lower) AS fn, count_if(NOT truth AND score >= upper) AS fp, count_if(score > lower AND score < upper) AS un, count(*) AS n FROM m, (VALUES (-0.3, 0.1), (-0.1, 0.1), (0.0, 0.2)) g(lower, upper) GROUP BY ALL), q AS (SELECT *, fn / nullif(nt, 0) AS miss, fp / nullif(nf, 0) AS fls, un / n AS unc FROM p)"


@query(
    "t5_block_by_image",
    f"{_BLOCK} SELECT fold, lower, upper, round(avg(miss), 6) AS miss, round(avg(fls), 6) AS \"false\", round(avg(unc), 6) AS uncertain, round(max(miss), 6) AS worst_miss, round(max(fls), 6) AS worst_false, round(max(unc), 6) AS worst_uncertain, round(1 - (avg(miss) + avg(fls)) / 2, 6) AS balanced_accuracy FROM q GROUP BY fold, lower, upper",
)
def _(s, d):
    return rounded(evaluation.block_evaluation(margins(s, d), ["fold"], "image", "score", [(-0.3, 0.1), (-0.1, 0.1), (0.0, 0.2)]))


@query(
    "t5_block_pooled",
    f"{_BLOCK} SELECT fold, lower, upper, round(sum(fn) / sum(nt), 6) AS miss, round(sum(fp) / sum(nf), 6) AS \"false\", round(sum(un) / sum(n), 6) AS uncertain, round(max(miss), 6) AS worst_miss, round(max(fls), 6) AS worst_false, round(max(unc), 6) AS worst_uncertain, round(1 - (sum(fn) / sum(nt) + sum(fp) / sum(nf)) / 2, 6) AS balanced_accuracy FROM q GROUP BY fold, lower, upper",
)
def _(s, d):
    return rounded(evaluation.block_evaluation(margins(s, d), ["fold"], "image", "score", [(-0.3, 0.1), (-0.1, 0.1), (0.0, 0.2)], "object"))


@query("t7_metrics_to_long", f"{_BLOCK} SELECT fold, lower, upper, unnest(['miss', 'uncertain']) AS metric, unnest([round(avg(miss), 6), round(avg(unc), 6)]) AS value FROM q GROUP BY fold, lower, upper")
def _(s, d):
    wide = evaluation.block_evaluation(margins(s, d), ["fold"], "image", "score", [(-0.3, 0.1), (-0.1, 0.1), (0.0, 0.2)])
    return rounded(evaluation.to_long(wide, ["fold", "lower", "upper"], ["miss", "uncertain"]))


_CONF = f"{OBJ}, x AS (SELECT object, ratio AS r, lower AS lo, upper AS up, {_D.format(r='ratio')} AS d FROM o JOIN {_FT} ON o.fold = c.fold), y AS (SELECT *, CASE d WHEN 'target' THEN r - up WHEN 'non_target' THEN lo - r ELSE least(r - lo, up - r) END AS margin, CASE d WHEN 'target' THEN 1 - up WHEN 'non_target' THEN lo ELSE (up - lo) / 2 END AS room FROM x), z AS (SELECT *, greatest(0, least(1, margin / room)) AS c FROM y)"


@query("p18_three_way_confidence", f"{_CONF} SELECT object, d AS decision, round(margin, 6) AS margin, round(c, 6) AS confidence, CASE WHEN c <= 0.33 THEN 'low' WHEN c <= 0.66 THEN 'medium' ELSE 'high' END AS confidence_bin FROM z")
def _(s, d):
    x = evaluation.decide_by_config(objects(s, d), fold_thresholds(s), "fold")
    return rounded(evaluation.three_way_confidence(x, "ratio", "lower", "upper", "decision").select("object", "decision", "margin", "confidence", "confidence_bin"))
