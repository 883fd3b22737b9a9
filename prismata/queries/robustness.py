"""Queries of robustness, splits, strata, registries, quality and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.operators import audit, domain, robustness, runner, spatial
from prismata.queries.evaluation import DEC, OBJ, decided, objects
from prismata.registry import M, P, margins, pixels, query, read, rounded


def runs(s, d):
    """Orders as runs: model = customer, seed = order number modulo 3."""
    return read(s, d, "orders").select(F.col("o_custkey").alias("model"), (F.col("o_orderkey") % 3).alias("seed"), (F.col("o_totalprice") / 1e6).alias("m1"), (F.col("o_orderkey") % 10 / 10).cast("double").alias("m2"), (F.col("o_custkey") % 4).alias("track"), F.col("o_orderkey").alias("run"))


RUNS = "WITH u AS (SELECT o_custkey AS model, o_orderkey % 3 AS seed, o_totalprice / 1e6 AS m1, CAST(o_orderkey % 10 / 10 AS DOUBLE) AS m2, o_custkey % 4 AS track FROM orders)"


@query("b3_stability_status", f"{RUNS}, a AS (SELECT model, count(DISTINCT seed) AS n_seeds, stddev_samp(m1) AS s1, max(m1) - min(m1) AS r1, stddev_samp(m2) AS s2, max(m2) - min(m2) AS r2 FROM u GROUP BY model) SELECT model, n_seeds, CASE WHEN n_seeds < 3 THEN 'missing_seed' WHEN r1 = 0 AND r2 = 0 THEN 'deterministic' WHEN s1 > 0.12 THEN 'unstable_blocking' WHEN s2 > 0.3 THEN 'robust_with_supporting_warnings' ELSE 'robust' END AS status FROM a")
def _(s, d):
    return robustness.stability_status(runs(s, d), "model", "seed", {"m1": (0.12, True), "m2": (0.3, False)}, 3, "run").select("model", "n_seeds", "status")


def _pairs(s):
    return s.createDataFrame([(0, -0.2, 0.2), (1, -0.1, 0.3)], "fold long, lower double, upper double")


_VAR = "(VALUES (0, -0.2, 0.2), (1, -0.1, 0.3)) c(fold, lower, upper), (VALUES ('centre_shift', -0.25), ('centre_shift', 0.0), ('centre_shift', 0.25), ('width_scale', 0.0), ('width_scale', 0.5), ('width_scale', 2.0)) v(kind, amount)"
_NEW = "CASE WHEN kind = 'centre_shift' THEN lower + amount * (upper - lower) ELSE (lower + upper) / 2 - amount * (upper - lower) / 2 END AS nl, CASE WHEN kind = 'centre_shift' THEN upper + amount * (upper - lower) ELSE (lower + upper) / 2 + amount * (upper - lower) / 2 END AS nu"


@query(
    "b4_threshold_plan",
    f"{M}, q AS (SELECT image, quantile_cont(score, 0.25) AS lower, quantile_cont(score, 0.75) AS upper FROM m GROUP BY image), x AS (SELECT image, kind, CAST(amount AS DOUBLE) AS amount, {_NEW} FROM q, (VALUES ('centre_shift', -0.25), ('centre_shift', 0.0), ('centre_shift', 0.25), ('width_scale', 0.0), ('width_scale', 0.5), ('width_scale', 2.0)) v(kind, amount)) "
    "SELECT image, kind, amount, round(nl, 6) AS new_lower, round(nu, 6) AS new_upper, CASE WHEN NOT nl < nu THEN 'invalid' WHEN kind = 'centre_shift' AND amount = 0 THEN 'no_effect' ELSE 'estimable' END AS status FROM x",
)
def _(s, d):
    """Pairs are the quartiles of each image's scores."""
    pairs = margins(s, d).groupBy("image").agg(F.percentile("score", 0.25).alias("lower"), F.percentile("score", 0.75).alias("upper"))
    return rounded(robustness.threshold_plan(pairs, "image", [-0.25, 0.0, 0.25], [0.0, 0.5, 2.0]).select("image", "kind", "amount", "new_lower", "new_upper", "status"))


@query(
    "b4_threshold_sensitivity",
    f"{M}, x AS (SELECT c.fold, kind, CAST(amount AS DOUBLE) AS amount, {_NEW} FROM {_VAR}), e AS (SELECT fold, kind, amount, nl, nu FROM x WHERE nl < nu AND NOT (kind = 'centre_shift' AND amount = 0) UNION ALL SELECT * FROM (VALUES (0, 'base', 0.0, -0.2, 0.2), (1, 'base', 0.0, -0.1, 0.3))), r AS (SELECT e.fold, kind, amount, count_if(truth AND round(score, 6) < round(nl, 9)) / count_if(truth) AS miss, count_if(NOT truth AND round(score, 6) >= round(nu, 9)) / count_if(NOT truth) AS fa, count_if(round(score, 6) >= round(nl, 9) AND round(score, 6) < round(nu, 9)) / count(*) AS un FROM m JOIN e ON m.fold = e.fold GROUP BY ALL) "
    "SELECT r.fold, r.kind, CAST(r.amount AS DOUBLE) AS amount, round(r.miss, 6) AS miss_rate, round(r.fa, 6) AS false_accept_rate, round(r.un, 6) AS uncertain_rate, round(r.miss - b.miss, 6) AS miss_delta, round(r.fa - b.fa, 6) AS false_accept_delta FROM r JOIN r b ON b.fold = r.fold AND b.kind = 'base' WHERE r.kind <> 'base'",
)
def _(s, d):
    plan = robustness.threshold_plan(_pairs(s), "fold", [-0.25, 0.0, 0.25], [0.0, 0.5, 2.0])
    m = margins(s, d).withColumn("score", F.round("score", 6))
    return rounded(robustness.threshold_sensitivity(m, plan.withColumns({"new_lower": F.round("new_lower", 9), "new_upper": F.round("new_upper", 9)}), "fold", "score"))


@query("b5_threshold_drift", f"{RUNS}, a AS (SELECT model, count(DISTINCT track) AS n, max(m1) - min(m1) AS rl, max(m1 + 1 + m2) - min(m1 + 1 + m2) AS ru, max(m1 + (1 + m2) / 2) - min(m1 + (1 + m2) / 2) AS rc, max(1 + m2) - min(1 + m2) AS rw, avg(m1) AS lm, avg(1 + m2) AS wm FROM u GROUP BY model) SELECT model, n AS n_policies, round(lm, 6) AS lower_mean, round(wm, 6) AS width_mean, CASE WHEN n > 1 THEN 'policy_drift' WHEN greatest(rl, ru, rc, rw) > 0.65 THEN 'warning' ELSE 'stable' END AS status FROM a")
def _(s, d):
    t = runs(s, d).withColumns({"lower": F.col("m1"), "upper": F.col("m1") + 1 + F.col("m2")})
    return rounded(robustness.threshold_drift(t, "model", "track", 0.65).select("model", "n_policies", "lower_mean", "width_mean", "status"))


_JACK = f"{RUNS}, g AS (SELECT u.*, o FROM u, (SELECT unnest([-1, 0, 1, 2]) AS o) WHERE model % 2 = 0 OR seed <> o), a AS (SELECT o, track, model, avg(m1) AS x, avg(m2) AS y FROM g GROUP BY ALL), f AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM a b WHERE b.o = a.o AND b.track = a.track AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y)) AS onf FROM a)"


@query("b7_front_jackknife", f"{_JACK}, c AS (SELECT track, model, max(CASE WHEN o = -1 THEN onf END) AS reference, avg(CASE WHEN o <> -1 THEN CAST(onf AS DOUBLE) END) AS q FROM f GROUP BY ALL) SELECT track, model, reference, round(q, 6) AS frequency, CASE WHEN q = 1 THEN 'stable_member' WHEN q = 0 THEN 'stable_non_member' ELSE 'membership_sensitive' END AS status FROM c")
def _(s, d):
    r = runs(s, d).withColumn("random", F.col("model") % 2 == 1)
    return rounded(robustness.front_jackknife(r, "track", "model", "seed", "random", [0, 1, 2], ["m1", "m2"], "run"))


@query("b7_front_jaccard", f"{_JACK}, t AS (SELECT o, track, model FROM f WHERE onf), n AS (SELECT o, track, count(*) AS n FROM t GROUP BY ALL), i AS (SELECT t.o, t.track, count(r.model) AS bth FROM t LEFT JOIN t r ON r.o = -1 AND r.track = t.track AND r.model = t.model WHERE t.o <> -1 GROUP BY ALL) SELECT i.track, i.o AS omitted, round(bth / (n.n + r.n - bth), 6) AS jaccard FROM i JOIN n ON n.o = i.o AND n.track = i.track JOIN n r ON r.o = -1 AND r.track = i.track")
def _(s, d):
    r = runs(s, d).withColumn("random", F.col("model") % 2 == 1)
    return rounded(robustness.front_jaccard(r, "track", "model", "seed", "random", [0, 1, 2], ["m1", "m2"], "run"))


@query("b8_spatial_sensitivity")
def _(s, d):
    df = pixels(s, d).withColumn("image", F.lit(0))
    lock = {"connectivity": 8, "operation": "closing", "radius": 1, "least": 4}
    near = robustness.spatial_neighbours(lock, spatial.spatial_grid([8], ["none", "closing"], [1], [0, 4]))
    on = F.col("spectrum")[0] > 1.0
    out = spatial.evaluate_spatial([lock, *[{k: v for k, v in g.items() if k != "factor"} for g in near]], df.where(on), df.where(F.col("spectrum")[2] > 1.1), df.where("label = 0"), df, df)
    return rounded(out)


_PAIR = "WITH r AS (SELECT * FROM part WHERE p_partkey % 10 = 0), q AS (SELECT 'p_size' AS factor, a.p_partkey AS alternative_id, r.p_partkey AS reference_id, CAST(r.p_size AS VARCHAR) AS reference_value, CAST(a.p_size AS VARCHAR) AS alternative_value FROM part a JOIN r ON a.p_brand = r.p_brand AND a.p_size <> r.p_size UNION ALL SELECT 'p_brand', a.p_partkey, r.p_partkey, r.p_brand, a.p_brand FROM part a JOIN r ON a.p_size = r.p_size AND a.p_brand <> r.p_brand), s AS (SELECT *, CASE WHEN alternative_id % 3 = 0 THEN 'not_evaluated' ELSE 'estimable' END AS status FROM q)"


def _parts(s, d):
    part = read(s, d, "part")
    return part.withColumn("ref", F.col("p_partkey") % 10 == 0), part.where("p_partkey % 3 <> 0")


_FACTORS = "p_partkey", ["p_size", "p_brand"], "ref"


@query("b9_one_factor_pairs", f"{_PAIR} SELECT * FROM s")
def _(s, d):
    return robustness.one_factor_pairs(*_parts(s, d), *_FACTORS)


@query("b9_paired_effects", f"{_PAIR}, e AS (SELECT factor, alternative_value, reference_value, a.p_retailprice - b.p_retailprice AS delta FROM s JOIN part a ON a.p_partkey = alternative_id JOIN part b ON b.p_partkey = reference_id WHERE status = 'estimable') SELECT factor, alternative_value, reference_value, count(*) AS n_pairs, round(avg(delta), 4) AS mean_delta, round(stddev_pop(delta), 4) AS std_delta FROM e GROUP BY ALL")
def _(s, d):
    # whole multiples of 2 ** -43 (prices of 512 or more are), whose sums do not depend on an order
    unit = 2.0**43
    one = read(s, d, "part").select("p_partkey", F.lit(0).alias("seed"), (F.col("p_retailprice") * unit).cast("decimal(20,0)").alias("price"))
    e = robustness.factor_effects(*_parts(s, d), one, *_FACTORS, "seed", "price")
    return rounded(e.withColumns({c: F.col(c) / unit for c in ("mean_delta", "std_delta")}), 4)


@query("b9_coverage", f"{_PAIR} SELECT factor, count(*) AS n_planned, count_if(status = 'estimable') AS n_estimable FROM s GROUP BY factor")
def _(s, d):
    return robustness.factor_coverage(*_parts(s, d), *_FACTORS)


@query("b10_practical_effects", "WITH e AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'accuracy' ELSE 'miss' END AS metric, (p_size - 25) / 100 AS delta FROM part) SELECT p_partkey, CASE WHEN abs(delta) <= 0.1 THEN 'within_tolerance' ELSE 'outside_tolerance' END AS effect_status, CASE WHEN abs(delta) <= 0.1 THEN 'no_practical_difference' WHEN (delta > 0) = (metric = 'accuracy') THEN 'alternative_better' ELSE 'reference_better' END AS direction FROM e")
def _(s, d):
    e = read(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "accuracy").otherwise("miss").alias("metric"), ((F.col("p_size") - 25) / 100).alias("delta"))
    tol = s.createDataFrame([("accuracy", 0.1, True), ("miss", 0.1, False)], "metric string, tolerance double, higher_is_better boolean")
    return robustness.practical_effects(e, tol).select("p_partkey", "effect_status", "direction")


@query("b11_interval_envelope", f"{RUNS} SELECT model, round(min(m1), 8) AS envelope_low, round(max(m1 + m2), 8) AS envelope_high, count(*) AS n_seeds, CASE WHEN min(seed) >= 1 THEN 'descriptive' ELSE 'too_few_images' END AS status FROM u GROUP BY model")
def _(s, d):
    r = runs(s, d).withColumn("high", F.col("m1") + F.col("m2"))
    return rounded(robustness.interval_envelope(r, ["model"], "m1", "high", "seed", 1).drop("n_images"), 8)


@query(
    "b12_coverage_auc",
    f"{M}, c AS (SELECT *, abs(score) AS conf FROM m), q AS (SELECT fold, quantile_cont(conf, [0.75, 0.5, 0.25, 0.0]) AS t FROM c GROUP BY fold), g AS (SELECT fold, coverage, t[i] AS t FROM q, (VALUES (1, 0.25::DOUBLE), (2, 0.5), (3, 0.75), (4, 1.0)) g(i, coverage)), "
    "r AS (SELECT c.fold, coverage, avg(CAST(truth <> (score >= 0) AS DOUBLE)) AS risk FROM c JOIN g ON c.fold = g.fold AND conf >= t GROUP BY ALL), n AS (SELECT *, lead(coverage) OVER w AS c2, lead(risk) OVER w AS r2 FROM r WINDOW w AS (PARTITION BY fold ORDER BY coverage)) "
    "SELECT fold, round(coalesce(sum((c2 - coverage) * (risk + r2) / 2), 0), 6) AS auc, round(max(coverage) FILTER (risk <= 0.5), 6) AS coverage_at_limit FROM n GROUP BY fold",
)
def _(s, d):
    m = margins(s, d).withColumns({"confidence": F.abs("score"), "prediction": F.col("score") >= 0})
    return rounded(robustness.coverage_auc(audit.risk_coverage(m, ["fold"], "confidence", [0.25, 0.5, 0.75, 1.0]), ["fold"], limit=0.5))


@query("l1_role_manifest", f"{P}, o AS (SELECT object, min(batch) AS batch, min(label) AS label FROM p GROUP BY object) SELECT object, CASE WHEN batch = 4 AND label = 1 THEN 'excluded' WHEN label = 9 THEN 'application' WHEN batch IN (1, 2) THEN 'calibration' WHEN batch = 3 THEN 'validation' ELSE 'unknown' END AS role FROM o")
def _(s, d):
    o = pixels(s, d).groupBy("object").agg(F.min("batch").alias("batch"), F.min("label").alias("label")).withColumn("kind", F.when(F.col("label") == 9, "mixture").otherwise("pure"))
    return robustness.role_manifest(o, o.where("batch = 4 AND label = 1"), "object", "batch", "kind", {"calibration": [1, 2], "validation": [3]}).select("object", "role")


@query("l6_fold_diagnostics", f"{P}, f AS (SELECT *, batch % 2 AS fold FROM p WHERE NOT (label = 3 AND batch % 2 = 0)), e AS (SELECT * FROM (SELECT DISTINCT fold FROM f), (SELECT DISTINCT label FROM f)), c AS (SELECT fold, label, count(DISTINCT object) AS n_objects, count(DISTINCT image) AS n_groups, median(row) AS median_size FROM f GROUP BY ALL) SELECT fold, label, coalesce(n_objects, 0) AS n_objects, coalesce(n_groups, 0) AS n_groups, round(median_size, 6) AS median_size, n_objects IS NOT NULL AS covered FROM e LEFT JOIN c USING (fold, label)")
def _(s, d):
    f = pixels(s, d).withColumn("fold", F.col("batch") % 2).where("NOT (label = 3 AND fold = 0)")
    return rounded(robustness.fold_diagnostics(f, "fold", "label", "image", "object", "row"))


@query("l7_partition_signatures", "WITH a AS (SELECT DISTINCT c, n_nationkey, CASE c WHEN 0 THEN n_nationkey % 2 WHEN 1 THEN 1 - n_nationkey % 2 ELSE n_nationkey % 3 END AS fold FROM nation, (SELECT unnest([0, 1, 2]) AS c)) SELECT c, CASE WHEN c < 2 THEN 0 ELSE 2 END AS representative, CASE WHEN c < 2 THEN 2 ELSE 1 END AS n_same FROM a GROUP BY c")
def _(s, d):
    c = F.col("c")
    a = read(s, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, range(3)))).alias("c"))
    a = a.withColumn("fold", F.when(c == 0, F.col("n_nationkey") % 2).when(c == 1, 1 - F.col("n_nationkey") % 2).otherwise(F.col("n_nationkey") % 3))
    return robustness.partition_signatures(a, "c", "fold", "n_nationkey").select("c", "representative", "n_same")


_Z = f"{M}, t AS (SELECT fold, avg(score) AS mu, stddev_samp(score) AS sd FROM m WHERE line <= 3 GROUP BY fold), z AS (SELECT m.fold, (score - mu) / sd AS z, truth, line FROM m JOIN t ON t.fold = m.fold WHERE line > 3), x AS (SELECT fold, 'overall' AS stratum, 'all' AS level, z FROM z UNION ALL SELECT fold, 'truth', CAST(truth AS VARCHAR), z FROM z UNION ALL SELECT fold, 'line', CAST(line AS VARCHAR), z FROM z)"


@query("h2_stratified_shift", f"{_Z} SELECT fold, stratum, level, count(*) AS n, round(avg(z), 6) AS mean_z, CASE WHEN count(*) < 5 THEN 'not_estimable' ELSE 'estimable' END AS status FROM x GROUP BY ALL")
def _(s, d):
    m = margins(s, d)
    return rounded(robustness.stratified_shift(m.where("line <= 3"), m.where("line > 3"), "fold", "score", {"truth": "truth", "line": "line"}))


@query("h3_track_eligibility", f"{_Z}, a AS (SELECT stratum, level, avg(z) AS v FROM x GROUP BY ALL), w AS (SELECT stratum, max(abs(v)) AS worst FROM a GROUP BY stratum) SELECT stratum, round(worst, 6) AS worst, CASE WHEN worst > 0.05 THEN 'unsupported' WHEN worst > 0.02 THEN 'warning' ELSE 'eligible' END AS status FROM w UNION ALL SELECT 'none', NULL, 'unsupported_missing_diagnostics'")
def _(s, d):
    m = margins(s, d)
    shift = robustness.stratified_shift(m.where("line <= 3"), m.where("line > 3"), "fold", "score", {"truth": "truth", "line": "line"})
    pooled = shift.groupBy("stratum", "level").agg((F.sum(F.col("mean_z") * F.col("n")) / F.sum("n")).alias("v"))
    tracks = shift.select("stratum").union(s.createDataFrame([("none",)], "stratum string"))
    return rounded(robustness.track_eligibility(pooled, tracks, "stratum", "v", 0.02, 0.05))


@query("k2_projection_expansion", "WITH c AS (SELECT * FROM (VALUES ('Brand#11', 'object', '2way'), ('Brand#11', 'pixel', '3way'), ('Brand#12', 'object', '3way')) c(p_brand, projection_level, decision_mode)) SELECT p_partkey, projection_level, decision_mode, 'prj_' || substring(sha256(to_json({'p_partkey': p_partkey, 'projection_level': projection_level})), 1, 20) AS projection_id, 'evl_' || substring(sha256(to_json({'p_partkey': p_partkey, 'projection_level': projection_level, 'decision_mode': decision_mode})), 1, 20) AS evaluation_id FROM part JOIN c USING (p_brand)")
def _(s, d):
    contracts = s.createDataFrame([("Brand#11", "object", "2way"), ("Brand#11", "pixel", "3way"), ("Brand#12", "object", "3way")], "p_brand string, projection_level string, decision_mode string")
    return robustness.expand_projections(read(s, d, "part"), contracts, "p_brand", "p_partkey").select("p_partkey", "projection_level", "decision_mode", "projection_id", "evaluation_id")


@query("k6_restored_configs", "WITH x AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS lower, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS review_order FROM part WHERE p_partkey % 2 = 0) SELECT p_partkey, p_brand, lower, review_order FROM x WHERE review_order <= 2")
def _(s, d):
    part = read(s, d, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    t = part.select("p_partkey", F.col("p_size").cast("double").alias("lower"), (F.col("p_size") + 1).cast("double").alias("upper"))
    return robustness.restored_configs(part.where("p_partkey % 2 = 0"), part, t, "p_partkey", "p_brand", ["p_retailprice", "p_partkey"], 2).select("p_partkey", "p_brand", "lower", "review_order")


@query("u1_held_out_report", f"{DEC}, i AS (SELECT fold, image, count(*) AS n, count_if(truth) AS nt, count_if(truth AND decision = 'non_target') AS ms, count_if(NOT truth AND decision = 'target') AS fa, count_if(decision = 'uncertain') AS un FROM x GROUP BY ALL) SELECT fold, CAST(sum(n) AS BIGINT) AS n_objects, round(sum(ms) / sum(nt), 6) AS miss_rate, round(sum(fa) / sum(n - nt), 6) AS false_accept_rate, round(sum(un) / sum(n), 6) AS uncertain_rate, count_if(ms > 0) AS n_images_with_miss, count(*) AS n_images FROM i GROUP BY fold")
def _(s, d):
    return rounded(robustness.held_out_report(decided(s, d), "fold", "image", "object"))


@query(
    "h3_eligibility_reasons",
    f"{M}, a AS (SELECT avg(score) AS mu, stddev_samp(score) AS sd FROM m), d AS (SELECT image, fold, (avg(score) - mu) / sd AS z, avg(CAST(score > 0.4 AS DOUBLE)) AS ood, avg(CAST(score < 0 AS DOUBLE)) FILTER (truth) AS rejection, count_if(truth) >= 3 AS ok FROM m, a GROUP BY image, fold, mu, sd), "
    "e AS (SELECT image, count(*) AS n, count_if(ok) AS n_ok, max(abs(z)) FILTER (ok) AS z, max(ood) FILTER (ok) AS ood, max(rejection) FILTER (ok) AS rejection FROM d GROUP BY image), "
    "r AS (SELECT *, list_filter([CASE WHEN n_ok < n THEN 'insufficient_target_support' END, CASE WHEN z IS NULL THEN 'standardized_shift_not_finite' WHEN z > 0.2 THEN 'standardized_shift' END, CASE WHEN ood IS NULL THEN 'ood_not_finite' WHEN ood > 0.15 THEN 'ood' END, CASE WHEN rejection IS NULL THEN 'rejection_not_finite' WHEN rejection > 0.65 THEN 'rejection' END], lambda x: x IS NOT NULL) AS bad, list_filter([CASE WHEN z > 0.1 THEN 'standardized_shift' END, CASE WHEN ood > 0.1 THEN 'ood' END, CASE WHEN rejection > 0.55 THEN 'rejection' END], lambda x: x IS NOT NULL) AS warn FROM e) "
    "SELECT image, n AS n_diagnostics, round(z, 6) AS max_standardized_shift, round(ood, 6) AS max_ood, round(rejection, 6) AS max_rejection, CASE WHEN len(bad) > 0 THEN 'unsupported_domain_shift' WHEN len(warn) > 0 THEN 'eligible_with_warning' ELSE 'eligible' END AS status, CASE WHEN len(bad) > 0 THEN array_to_string(bad, ';') WHEN len(warn) > 0 THEN array_to_string(warn, ';') ELSE 'all_predeclared_limits_satisfied' END AS reasons FROM r",
)
def _(s, d):
    """Images as tracks, folds as their strata: shift of the score, rate above 0.4, rejection of the truth."""
    m = margins(s, d)
    whole = m.agg(F.avg("score").alias("mu"), F.stddev_samp("score").alias("sd"))
    per = m.groupBy("image", "fold").agg(F.avg("score").alias("v"), F.avg((F.col("score") > 0.4).cast("double")).alias("ood"), F.avg(F.when(F.col("truth"), (F.col("score") < 0).cast("double"))).alias("rejection"), (F.count_if("truth") >= 3).alias("ok"))
    diagnostics = per.crossJoin(F.broadcast(whole)).withColumn("z", (F.col("v") - F.col("mu")) / F.col("sd"))  # one row
    return rounded(domain.eligibility(diagnostics, m, "image", ["z"], ["ood", "rejection"], {"standardized_shift": (0.1, 0.2), "ood": (0.1, 0.15), "rejection": (0.55, 0.65)}, "ok"))


_LOCKED = [runner.Config("snv", 3, "data_driven_chi2"), runner.Config("absorbance_msc", 3, "simple_chi2")]


def locked_thresholds(s):
    rows = [(c.chain, c.k, c.variant, c.alpha, c.m, c.seed, 0.2, 0.6, t) for c, t in zip(_LOCKED, ("conservative", "balanced"), strict=True)]
    return s.createDataFrame(rows, "chain string, k int, variant string, alpha double, m int, seed int, lower double, upper double, track string")


def tested(s, d):
    rows = pixels(s, d).withColumn("class", F.col("label").cast("string"))
    return runner.held_out_test(rows.where("batch < 4"), rows.where("batch = 4"), _LOCKED, "0", locked_thresholds(s))


@query("u1_refit_objects", f"{P}, t AS (SELECT unnest(['conservative', 'balanced']) AS track) SELECT track, object, CAST(count(*) AS BIGINT) AS n_pixels, min(label) = 0 AS truth, true AS consistent FROM p, t WHERE batch = 4 GROUP BY track, object")
def _(s, d):
    """Every held-out object of every locked model, and whether its decision is that of its thresholds; the tests hold the
    scores against refits."""
    o = tested(s, d).objects
    said = F.when(F.col("ratio") >= 0.6, "target").when(F.col("ratio") <= 0.2, "non_target").otherwise("uncertain")
    return o.select("track", "object", "n_pixels", "truth", (F.col("decision") == said).alias("consistent"))


@query("u1_refit_two_way")
def _(s, d):
    out = tested(s, d)
    return rounded(out.two_way().withColumn("level", F.lit("object")).unionByName(out.two_way("pixels").withColumn("level", F.lit("pixel"))))


@query("u1_refit_three_way")
def _(s, d):
    return rounded(tested(s, d).three_way(image=True))


def mixed(s, d):
    """Models of class 0 from batches 1 to 3 on the objects of three other classes in batch 4."""
    rows = pixels(s, d).withColumn("class", F.col("label").cast("string"))
    return runner.mixture_application(rows.where("batch < 4"), rows.where("batch = 4 AND label IN (7, 8, 9)"), _LOCKED, "0", locked_thresholds(s), "track")


@query("u2_mixture_application", f"{P}, t AS (SELECT unnest(['conservative', 'balanced']) AS track) SELECT track, object, count(*) AS n_pixels FROM p, t WHERE batch = 4 AND label IN (7, 8, 9) GROUP BY ALL")
def _(s, d):
    return mixed(s, d)[0].select("track", "object", "n_pixels")


@query("u2_mixture_shares")
def _(s, d):
    return rounded(mixed(s, d)[1])


@query("u4_inventory", f"{P}, i AS (SELECT image, min(label) AS label, min(batch) AS batch, count(DISTINCT object) AS k FROM p GROUP BY image) SELECT label, batch, count(*) AS n_images, CAST(sum(k) AS BIGINT) AS n_objects, min(k) AS least_objects, max(k) AS most_objects FROM i GROUP BY ALL")
def _(s, d):
    i = pixels(s, d).groupBy("image").agg(F.min("label").alias("label"), F.min("batch").alias("batch"), F.count_distinct("object").alias("k"))
    return robustness.inventory(i, "label", "batch", "k")


@query("u5_parameter_rates", "WITH l AS (SELECT p_brand, unnest(['p_size', 'p_type']) AS parameter, unnest([CAST(p_size AS VARCHAR), p_type]) AS value FROM part), t AS (SELECT p_brand, count(*) AS k FROM part GROUP BY p_brand) SELECT p_brand, parameter, value, count(*) AS n, round(count(*) / max(k), 6) AS rate FROM l JOIN t USING (p_brand) GROUP BY ALL")
def _(s, d):
    return rounded(robustness.value_rates(read(s, d, "part"), "p_brand", ["p_size", "p_type"]))


_OD = f"{OBJ}, x AS (SELECT image, truth, CASE WHEN ratio >= 0.6 THEN 'target' WHEN ratio >= 0.3 THEN 'uncertain' ELSE 'non_target' END AS d FROM o)"


def object_decisions(s, d):
    r = F.col("ratio")
    return objects(s, d).withColumn("decision", F.when(r >= 0.6, "target").when(r >= 0.3, "uncertain").otherwise("non_target"))


@query("u5_object_counts", f"{_OD} SELECT image, count_if(truth) AS true_target, count_if(NOT truth) AS true_other, count_if(d = 'target') AS predicted_target, count_if(d = 'non_target') AS predicted_other, count_if(d = 'uncertain') AS predicted_uncertain, count_if(d = 'target') - count_if(truth) AS target_count_error FROM x GROUP BY image")
def _(s, d):
    return robustness.object_counts(object_decisions(s, d), "image")


@query("u5_stage_comparison", f"{_OD}, c AS (SELECT image, CAST(count_if(truth) AS DOUBLE) AS a, CAST(count_if(d = 'target') AS DOUBLE) AS b FROM x GROUP BY image) SELECT image, unnest(['true_target', 'predicted_target']) AS metric, unnest([a, b]) AS value, 'all' AS stage FROM c UNION ALL SELECT image, unnest(['true_target', 'predicted_target']), unnest([a, b]), 'even' FROM c WHERE image % 2 = 0")
def _(s, d):
    c = robustness.object_counts(object_decisions(s, d), "image")
    return robustness.stage_comparison({"all": c, "even": c.where("image % 2 = 0")}, "image", ["true_target", "predicted_target"])


@query("q2_image_quality", f"{P}, i AS (SELECT image, min(label) AS label, count(*) AS n, count_if(spectrum[1] > 1) AS k, count(DISTINCT object) AS o FROM p GROUP BY image) SELECT image, CASE WHEN label = 2 THEN 'invalid_values' WHEN label = 3 THEN 'axis_differs' WHEN k = 0 THEN 'empty_mask' END AS exclusion_reason, CASE WHEN label IN (2, 3) OR k = 0 THEN 'excluded' WHEN o <> n THEN 'warning' ELSE 'accepted' END AS qc_status FROM i")
def _(s, d):
    i = pixels(s, d).groupBy("image").agg(F.min("label").alias("label"), F.lit(1).alias("height"), F.lit(1).alias("width"), F.count("*").alias("n_values"), F.count_if(F.col("spectrum")[0] > 1).alias("mask_pixels"), F.count_distinct("object").alias("n_objects"))
    i = i.withColumns({"n_bad": F.when(F.col("label") == 2, F.col("n_values")).otherwise(0), "axis_ok": F.col("label") != 3, "n_labels": F.col("n_values")})
    return robustness.image_quality(i).select("image", "exclusion_reason", "qc_status")


_SEG = f"{P}, r AS (SELECT CAST(row // 10 AS INTEGER) AS image, label, row, col, spectrum[1] > 1.0 AS on_ FROM p), f AS (SELECT image, min(row) AS a0, max(row) AS a1, min(col) AS b0, max(col) AS b1 FROM r GROUP BY image), o AS (SELECT image, label, count(*) AS area, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, count_if(on_) AS bad FROM r GROUP BY ALL), s AS (SELECT o.*, median(area) OVER (PARTITION BY image) AS med, r0 <= a0 OR r1 >= a1 OR c0 <= b0 OR c1 >= b1 AS touches FROM o JOIN f USING (image))"


def segmented(s, d):
    r = pixels(s, d).select(F.floor(F.col("row") / 10).cast("int").alias("image"), "label", "row", "col", (F.col("spectrum")[0] > 1.0).alias("on"))
    return r, robustness.segmentation_diagnostics(r, "label", 20, 1.2)


@query("q11_segmentation_diagnostics", f"{_SEG} SELECT image, label, area, round(area / ((r1 - r0 + 1) * (c1 - c0 + 1)), 6) AS fill_ratio, touches AS touches_border, area < 20 AS too_small, area > 1.2 * med AS maybe_merged FROM s")
def _(s, d):
    return rounded(segmented(s, d)[1].select("image", "label", "area", "fill_ratio", "touches_border", "too_small", "maybe_merged"))


@query("q5_object_quality", f"{_SEG} SELECT image, label, bad AS n_invalid, CASE WHEN bad >= area THEN 'excluded' WHEN area < 20 OR area > 1.2 * med OR touches OR bad > 0 THEN 'warning' ELSE 'accepted' END AS qc_status FROM s")
def _(s, d):
    r, seg = segmented(s, d)
    bad = r.where("on").groupBy("image", "label").agg(F.count("*").alias("n_invalid"))
    return robustness.object_quality(seg, bad, "label").select("image", "label", "n_invalid", "qc_status")


@query("q10_shape_check", f"{P}, o AS (SELECT object, count(*) AS n, count(DISTINCT row * 100 + col) AS k FROM p GROUP BY object) SELECT object, concat_ws(',', CASE WHEN n > 1 THEN 'n_pixels' END) AS faults, n <= 1 AS consistent FROM o")
def _(s, d):
    p = pixels(s, d)
    held = p.groupBy("object").agg(F.count("*").alias("n_pixels"), F.max(F.size("spectrum")).alias("n_bands"), F.count_distinct("row", "col").alias("n_positions"))
    return robustness.shape_check(held.select("object", F.lit(1).cast("long").alias("n_pixels"), F.lit(64).alias("n_bands")), held, "object")
