"""Queries of preprocessing chains and one-class SIMCA. Classes are the embeddings' labels, batches 1 and 2 calibrate,
batch 3 is projected."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.functions import spectra as sp
from prismata.operators import chain, grid, runner, simca
from prismata.plans.shared import materialize
from prismata.registry import BANDS, P, pixels, query, read, rounded

K, ALPHA = 5, 0.05
CHI5 = 11.070497693516351  # fixed value: the chi-square quantile of 5 degrees of freedom at 0.95


def calibration(s, d):
    return pixels(s, d).where("batch IN (1, 2)").withColumn("class", F.col("label").cast("string"))


def projection(s, d):
    return pixels(s, d).where("batch = 3").withColumn("class", F.col("label").cast("string"))


@query("x3_chain_row_mask", f"{P} SELECT image, count(*) AS n_input_rows, count_if(len(list_filter(spectrum, lambda x: x <= 0.75)) = 0) AS n_valid_rows, count_if(len(list_filter(spectrum, lambda x: x <= 0.75)) > 0) AS n_filtered_rows, 0 AS n_nonfinite_rows, count_if(len(list_filter(spectrum, lambda x: x <= 0.75)) > 0) AS n_nonpositive_absorbance_rows FROM p GROUP BY image")
def _(s, d):
    rows = pixels(s, d).withColumn("spectrum", F.transform("spectrum", lambda x: x - 0.75))
    return chain.validity_report(rows, ["image"], "spectrum", ("absorbance", "snv"))


@query("x6_msc_fit", f"{BANDS} SELECT label, band, round(avg(v), 6) AS value FROM b WHERE batch IN (1, 2) GROUP BY label, band")
def _(s, d):
    ref = chain.mean_spectrum(calibration(s, d), ["label"], "spectrum")
    return rounded(ref.select("label", F.posexplode("mean").alias("band", "value")).withColumn("band", F.col("band").cast("long")))


@query("x9_mean_centring", f"{BANDS}, c AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY band) AS v FROM b) SELECT vec_id, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares FROM c GROUP BY vec_id")
def _(s, d):
    p = pixels(s, d)
    mean = chain.mean_spectrum(p, [], "spectrum").first()["mean"]
    c = F.zip_with("spectrum", F.array(*map(F.lit, mean)), lambda x, m: x - m)
    add = lambda f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    return rounded(p.select("vec_id", add(lambda x: x).alias("total"), add(lambda x: x * x).alias("squares")))


@query(
    "x10_fitted_chain",
    f"{BANDS}, a AS (SELECT vec_id, batch, band, -log10(v) AS v FROM b), z AS (SELECT vec_id, batch, band, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS v FROM a WINDOW w AS (PARTITION BY vec_id)), r AS (SELECT band, avg(v) AS ref FROM z WHERE batch IN (1, 2) GROUP BY band), "
    "f AS (SELECT vec_id, band, v, regr_slope(v, ref) OVER (PARTITION BY vec_id) AS slope, avg(v) OVER (PARTITION BY vec_id) - regr_slope(v, ref) OVER (PARTITION BY vec_id) * avg(ref) OVER (PARTITION BY vec_id) AS base FROM z JOIN r USING (band) WHERE batch = 3) SELECT vec_id, round(max((v - base) / slope), 4) AS largest, round(sum(((v - base) / slope) * ((v - base) / slope)), 4) AS squares FROM f GROUP BY vec_id",
)
def _(s, d):
    out = chain.Chain(("absorbance", "snv", "msc")).fit(calibration(s, d)).transform(projection(s, d))
    return rounded(out.select("vec_id", F.array_max("spectrum").alias("largest"), F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x * x).alias("squares")), 4)


_NAMES = list(chain.catalogue())
_PARTS = f"SELECT p_partkey, list_extract([{', '.join(repr(n) for n in _NAMES)}], CAST(p_partkey % {len(_NAMES)} AS INTEGER) + 1) AS name, 3 + p_size % 24 AS w, p_partkey % 4 AS o FROM part"


def named_chains(s, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int") + 1)
    return read(s, d, "part").select("p_partkey", name.alias("name"), (3 + F.col("p_size") % 24).alias("w"), (F.col("p_partkey") % 4).alias("o"))


@query(
    "x11_chain_rules",
    f"WITH x AS ({_PARTS}), y AS (SELECT *, CASE WHEN NOT contains(name, 'sg_') THEN 'valid' WHEN w < 5 THEN 'window_too_small' WHEN w % 2 = 0 THEN 'window_even' WHEN w > 21 THEN 'window_exceeds_bands' WHEN o >= w THEN 'order_not_below_window' WHEN (CASE WHEN contains(name, 'd2') THEN 2 WHEN contains(name, 'd1') THEN 1 ELSE 0 END) > o THEN 'derivative_above_order' ELSE 'valid' END AS status FROM x) SELECT name, status, count(*) AS n FROM y GROUP BY name, status",
)
def _(s, d):
    df = named_chains(s, d)
    return df.groupBy("name", chain.chain_status(chain.parse_steps(F.col("name")), F.lit(21), F.col("w"), F.col("o")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "p14_chain_text",
    f"WITH x AS ({_PARTS}) SELECT p_partkey, list_transform(string_split(replace(replace(replace(replace(replace(name, 'vector_norm', 'vector~norm'), 'sg_smooth', 'sg~smooth'), 'sg_d1', 'sg~d1'), 'sg_d2', 'sg~d2'), '_', '+'), '+'), lambda t: replace(t, '~', '_')) AS steps FROM x",
)
def _(s, d):
    df = named_chains(s, d)
    joined = F.array_join(F.transform(F.split(F.regexp_replace(F.regexp_replace("name", "vector_norm", "vector~norm"), "sg_", "sg~"), "_"), lambda t: F.replace(t, F.lit("~"), F.lit("_"))), '", "')
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("name")).when(F.col("p_partkey") % 3 == 1, F.upper(F.regexp_replace(F.regexp_replace("name", "sg_", "savitzky_golay_"), "_", "-"))).otherwise(F.concat(F.lit('["'), joined, F.lit('"]')))
    return df.select("p_partkey", chain.parse_steps(text).alias("steps"))


def fits(s, d, k=K):
    return simca.fit(calibration(s, d), "class", "spectrum", k, ALPHA)


_N = P + ", c AS (SELECT CAST(label AS VARCHAR) AS model, count(*) AS n FROM p WHERE batch IN (1, 2) GROUP BY label)"


@query("c1_class_fits", f"{_N} SELECT model, n, CASE WHEN n <= 5 THEN 'too_few_rows' WHEN n - 1 < 5 THEN 'components_above_rank' ELSE 'ok' END AS status FROM c")
def _(s, d):
    return fits(s, d).select("model", "n", "status")


@query("c2_training_distances", f"{_N} SELECT model, n, round(5 * (n - 1) / n, 5) AS mean_h FROM c")
def _(s, d):
    rows, f = calibration(s, d), fits(s, d)
    return rounded(simca.distances(rows.select("class", "spectrum"), f, K, "spectrum", "class").groupBy("model").agg(F.count("*").alias("n"), F.avg("h").alias("mean_h")), 5)


@query("c3_score_parameters", f"{_N} SELECT model, round(5 * (n - 1) / n, 6) AS h0, 5.0::DOUBLE AS nh FROM c")
def _(s, d):
    return rounded(fits(s, d).select("model", "h0", "nh"))


@query("c4_chi_square_limits", f"{_N} SELECT model, round((n - 1) / n * {CHI5}, 5) AS h_limit FROM c")
def _(s, d):
    return rounded(fits(s, d).select("model", "h_limit"), 5)


@query("c5_training_quantiles")
def _(s, d):
    return rounded(fits(s, d).select("model", "h_empirical", "q_empirical", "c_empirical"))


@query("c6_rule_limits")
def _(s, d):
    return rounded(fits(s, d).select("model", "h_limit", "q_limit", "dd_limit", "combined_limit"))


def cross_validated(s, d):
    cv = materialize(simca.cv_distances(calibration(s, d), "class", "object", "spectrum", K, ALPHA, folds=4, keep=["vec_id"]), "cv")
    return cv, simca.cv_thresholds(cv, ALPHA)


@query("c9_group_cv_thresholds")
def _(s, d):
    return rounded(cross_validated(s, d)[1])


@query("c9_leave_one_group_out", f"{_N}, o AS (SELECT CAST(label AS VARCHAR) AS model, object, count(*) AS k FROM p WHERE batch IN (1, 2) GROUP BY label, object), x AS (SELECT model, object, k FROM o JOIN c USING (model) WHERE n - k > 5) SELECT model, count(*) AS n_folds, CAST(sum(k) AS BIGINT) AS n_held_out FROM x GROUP BY model")
def _(s, d):
    cv = simca.cv_distances(calibration(s, d), "class", "object", "spectrum", K, ALPHA)
    return cv.groupBy("model").agg(F.count_distinct("fold").alias("n_folds"), F.count("*").alias("n_held_out"))


@query("c10_cv_summary")
def _(s, d):
    cv, t = cross_validated(s, d)
    return rounded(simca.cv_summary(cv, t, ALPHA))


@query("c11_train_only_thresholds")
def _(s, d):
    return rounded(simca.train_thresholds(calibration(s, d), "class", "spectrum", fits(s, d), K, ALPHA))


@query("c7_ten_variants")
def _(s, d):
    _, t = cross_validated(s, d)
    f = fits(s, d)
    long = simca.project(simca.distances(projection(s, d).select("vec_id", "class", "spectrum"), f, K, "spectrum"), f, t)
    return rounded(long.groupBy("model", "rule", "family").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.avg("limit").alias("limit")))


@query("c12_projection_margins", f"{P}, c AS (SELECT CAST(label AS VARCHAR) AS model, count(*) AS n FROM p WHERE batch IN (1, 2) AND len(list_filter(spectrum, lambda x: x <= 0.75)) = 0 GROUP BY label), v AS (SELECT count(*) AS n_rows, count_if(len(list_filter(spectrum, lambda x: x <= 0.75)) > 0) AS bad FROM p WHERE batch = 3) SELECT model, n_rows - bad AS n_projected, bad AS n_filtered, true AS consistent FROM c, v WHERE n > 5")
def _(s, d):
    shift = lambda df: df.withColumn("spectrum", F.transform("spectrum", lambda x: x - 0.75))
    steps = ("absorbance", "snv")
    c = chain.Chain(steps).fit(shift(calibration(s, d)))
    train, proj = c.transform(shift(calibration(s, d))), shift(projection(s, d))
    f = simca.fit(train, "class", "spectrum", K, ALPHA)
    long = simca.project(simca.distances(c.transform(proj).select("vec_id", "spectrum"), f, K, "spectrum"), f, variants=["simple_chi2"])
    bad = chain.validity_report(proj, [], "spectrum", steps).select(F.col("n_filtered_rows").alias("n_filtered"))
    out = long.groupBy("model").agg(F.count("*").alias("n_projected"), F.every((F.col("margin") >= 0) == F.col("decision")).alias("consistent"))
    return out.join(bad)


@query("c13_variant_projection")
def _(s, d):
    f = fits(s, d)
    names = ["simple_chi2", "alternative_chi2_fixed2", "combined_index_chi2", "data_driven_chi2"]
    long = simca.project(simca.distances(projection(s, d).select("vec_id", "spectrum"), f, K, "spectrum"), f, variants=names)
    return rounded(simca.wide_projection(long, ["vec_id", "model"], names))


GRID = [runner.Config("raw", 3), runner.Config("snv", 3), runner.Config("snv", 5, variant="data_driven_chi2"), runner.Config("absorbance_snv", 5, variant="combined_index_chi2"), runner.Config("snv", 500), runner.Config("absorbance_sg_d1", 4, m=10, seed=1), runner.Config("absorbance_sg_d1", 4, m=10, seed=2)]


def projected_grid(s, d):
    return grid.fit_grid(grid.simple_roles(calibration(s, d), projection(s, d)), [*GRID, *MATRIX_AXIS], "0")


MATRIX_AXIS = [runner.Config("snv", 3, matrix=x) for x in ("object_mean", "object_median")] + [runner.Config("absorbance_msc", 3)]


@query("c14_projection_grid")
def _(s, d):
    return rounded(projected_grid(s, d).metrics([0.5, 0.75]).drop("setting", "split"))


_EVENTS = f"{P}, c AS (SELECT unnest([{', '.join(repr(c.data) for c in dict.fromkeys([c for c in GRID if c.m is None]))}]) AS data), e AS (SELECT DISTINCT data, CASE WHEN batch < 3 THEN 'fit' ELSE 'project' END AS role, vec_id, len(list_filter(spectrum, lambda x: x <= 0.75)) = 0 OR data NOT LIKE 'absorbance%' AS taken FROM p, c WHERE batch < 4)"


@query("c17_row_events", f"{_EVENTS} SELECT data, role, count(*) AS n_input_rows, count_if(taken) AS n_valid_rows, count_if(NOT taken) AS n_filtered_rows FROM e GROUP BY ALL")
def _(s, d):
    """Rows seen, taken and filtered by every chain, counted while they are projected."""
    shift = lambda df: df.withColumn("spectrum", F.transform("spectrum", lambda x: x - 0.75))
    configs = [c for c in GRID if c.m is None]
    return grid.fit_grid(grid.simple_roles(shift(calibration(s, d)), shift(projection(s, d))), configs, "0").events


@query("c17_diagnostics")
def _(s, d):
    """Fit and rule diagnostics of an out-of-fold run, one row per fold and configuration."""
    rows = calibration(s, d).withColumn("fold", F.col("batch") - 1)
    g = runner.out_of_fold_grid(rows, "fold", "0", [("snv", [3, 5], ["simple_chi2", "data_driven_chi2"]), ("absorbance_msc", [3], ["simple_chi2"])])
    fits = g.fit_diagnostics().select("setting", "k", "alpha", "n", "rank", "explained", "h_limit", "q_limit", "status")
    return rounded(g.rule_diagnostics().join(fits, ["setting", "k", "alpha"]).drop("setting"), 4)


@query("h1_domain_rates")
def _(s, d):
    """Shift of H, Q, ratio and margin, rate out of the domain and rejection of the target, per configuration."""
    return rounded(projected_grid(s, d).shift().drop("setting", "split"), 4)


@query("c15_refit_selected")
def _(s, d):
    chosen = [c for c in GRID if c.variant != "simple_chi2"]
    return rounded(runner.run_grid(calibration(s, d), projection(s, d), chosen, "0", [0.5]))


def chosen_grid(s, d):
    chosen = [c for c in GRID if c.variant != "simple_chi2"]
    return grid.fit_grid(grid.simple_roles(calibration(s, d), projection(s, d)), chosen, "0")


@query("c15_refit_objects")
def _(s, d):
    return rounded(chosen_grid(s, d).objects().drop("setting", "split"))


@query("c15_refit_pixels")
def _(s, d):
    return rounded(chosen_grid(s, d).pixels().drop("setting", "split"))


@query("c16_seed_stability")
def _(s, d):
    out = runner.run_grid(calibration(s, d), projection(s, d), [runner.Config("snv", 3, m=10, seed=i) for i in (1, 2, 3)], "0", [0.5])
    return rounded(out.groupBy("chain", "k", "variant", "threshold").agg(F.count("*").alias("n_seeds"), F.avg("balanced_accuracy").alias("mean"), F.stddev_samp("balanced_accuracy").alias("std"), F.min("balanced_accuracy").alias("least"), F.max("balanced_accuracy").alias("largest")))


@query("c17_out_of_fold", f"{P}, f AS (SELECT DISTINCT image, batch FROM p WHERE batch IN (1, 2) AND label = 0), r AS (SELECT vec_id, object, batch FROM p WHERE batch IN (1, 2)) SELECT batch - 1 AS fold, k, rule, count(*) AS n_rows, count(DISTINCT object) AS n_objects FROM r, (VALUES (3), (5)) k(k), (VALUES ('simple_chi2'), ('data_driven_chi2')) v(rule) GROUP BY ALL")
def _(s, d):
    rows = calibration(s, d).withColumn("fold", F.col("batch") - 1)
    oof = runner.out_of_fold(rows, "fold", "0", [("snv", [3, 5], ["simple_chi2", "data_driven_chi2"])])
    return oof.groupBy("fold", "k", "rule").agg(F.count("*").alias("n_rows"), F.count_distinct("object").alias("n_objects"))


@query("c18_locked_refit", f"{P} SELECT 'snv' AS chain, 3 AS k, 'simple_chi2' AS rule, object, count(*) AS n_pixels FROM p WHERE batch = 3 GROUP BY object")
def _(s, d):
    out = runner.locked_refit(pixels(s, d).withColumn("class", F.col("label").cast("string")), [1, 2], [3], [4], "0", [("snv", [3], ["simple_chi2"])])
    return out.groupBy("chain", "k", "rule", "object").agg(F.count("*").alias("n_pixels"))


@query(
    "c19_configuration_validity",
    f"{_N} SELECT model, k, alpha, CASE WHEN k < 1 THEN 'components_not_positive' WHEN alpha <= 0 OR alpha >= 1 THEN 'alpha_out_of_range' WHEN k > 64 THEN 'components_above_bands' WHEN k >= n THEN 'too_few_target_rows' WHEN k > least(n - 1, 64) THEN 'components_above_rank' ELSE 'valid' END AS status FROM c, (VALUES (0, 0.05::DOUBLE), (5, 0.05), (5, 1.5), (30, 0.01), (100, 0.05)) g(k, alpha)",
)
def _(s, d):
    plan = s.createDataFrame([(0, 0.05), (5, 0.05), (5, 1.5), (30, 0.01), (100, 0.05)], "k int, alpha double")
    pca = simca.eigensystems(calibration(s, d), "class", "spectrum")
    return runner.configuration_validity(plan, pca).select("model", "k", "alpha", "status")


_CHECKED = [runner.Config("snv", 3), runner.Config("sg_d1", 3, window=8), runner.Config("sg_d2", 3, order=1), runner.Config("sg_smooth", 3, window=65), runner.Config("raw", 3, m=0), runner.Config("raw", 3, m=1000), runner.Config("raw", 0), runner.Config("raw", 3, alpha=1.0), runner.Config("raw", 65), runner.Config("raw", 3, variant="other")]
_SAID = ["valid", "window_even", "derivative_above_order", "window_exceeds_bands", "m_not_positive", "too_few_pixels_an_object", "components_not_positive", "alpha_out_of_range", "components_above_bands", "unknown_rule"]


@query("c19_configuration_checks", f"{P}, t AS (SELECT unnest(['0', '3', 'none']) AS target), c AS (SELECT unnest([{', '.join(map(repr, _SAID))}]) AS said, unnest([{', '.join('NULL' if c.m is None else str(c.m) for c in _CHECKED)}]) AS m), o AS (SELECT CAST(label AS VARCHAR) AS class, object, count(*) AS n FROM p WHERE batch < 3 GROUP BY ALL) SELECT target, CASE WHEN said IN ('window_even', 'derivative_above_order', 'window_exceeds_bands', 'unknown_rule') THEN said WHEN count(object) = 0 THEN 'target_class_missing' WHEN said <> 'valid' THEN said WHEN sum(n) <= 3 THEN 'too_few_target_rows' ELSE 'valid' END AS status, CAST(count(object) AS BIGINT) AS n_objects, CAST(coalesce(sum(CASE WHEN m IS NULL THEN n ELSE least(n, m) END), 0) AS BIGINT) AS n_rows FROM t CROSS JOIN c LEFT JOIN o ON class = target GROUP BY target, said, m")
def _(s, d):
    roles = grid.simple_roles(calibration(s, d), projection(s, d))
    return grid.configuration_status(roles, _CHECKED, ["0", "3", "none"]).select("target", "status", "n_objects", "n_rows")


@query("c9_msc_references", f"{BANDS}, a AS (SELECT CAST(label AS VARCHAR) AS class, CAST(batch AS VARCHAR) AS fold, band, -log10(v) AS v FROM b), f AS (SELECT DISTINCT class, fold FROM a) SELECT a.class, f.fold, band, round(avg(v), 6) AS value FROM a JOIN f ON a.class = f.class AND a.fold <> f.fold GROUP BY ALL")
def _(s, d):
    """Mean absorbance of a class without each fold in turn, from band sums."""
    p = pixels(s, d).withColumns({"class": F.col("label").cast("string"), "fold": F.col("batch").cast("string"), "x": sp.absorbance(F.col("spectrum"), None)})
    refs = grid.leave_out_means(p, "class", "fold", "x")
    return rounded(refs.select("class", "fold", F.posexplode("mean").alias("band", "value")).withColumn("band", F.col("band").cast("long")))


@query("c9_group_cv_msc")
def _(s, d):
    """Cross-validated thresholds of a chain whose MSC reference is fitted without each fold; the tests hold it against refits."""
    cv = materialize(grid.cross_validated(calibration(s, d), chain.Chain(("absorbance", "msc")), "class", "object", K, ALPHA, folds=4, keep=["vec_id"]), "cv")
    return rounded(simca.cv_thresholds(cv, ALPHA), 4)


@query("c20_valid_predictions")
def _(s, d):
    """Metric rows of the configurations whose predictions are there and finite."""
    g = projected_grid(s, d)
    return rounded(runner.prediction_audit(g, g.metrics([0.5]))[1].drop("setting", "split"))


@query("c20_technical_audit")
def _(s, d):
    return rounded(runner.technical_audit(runner.run_grid(calibration(s, d), projection(s, d), GRID, "0", [0.5])))
