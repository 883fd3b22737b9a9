"""Summaries of fits and splits that SQL cannot say, against NumPy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import audit, models, pca_metrics, simca

K, ALPHA = 2, 0.1


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(70, 5)) @ np.diag([3, 2, 1, 0.5, 0.4]) + np.repeat([[0.0], [1.0]], 35, 0)
    df = spark.createDataFrame([(i, "ab"[i // 35], f"g{i % 5}", [float(v) for v in r]) for i, r in enumerate(x)], "i int, class string, grp string, spectrum array<double>").repartition(3)
    return df, simca.fit(df, "class", "spectrum", K, ALPHA)


def _stats(r, h, q):
    a, b = h / r.h_limit, q / r.q_limit
    return {"simple_stat": max(a, b), "sum_stat": a + b, "dd_stat": r.nq * q / r.q0 + r.nh * h / r.h0}


def test_wide_projection_holds_the_long_one(spark, fitted):
    df, f = fitted
    names = ["simple_chi2", "data_driven_chi2", "combined_index_chi2"]
    long = simca.project(simca.distances(df.select("i", "spectrum"), f, K, "spectrum"), f, variants=names)
    wide = {(r.i, r.model): r for r in simca.wide_projection(long, ["i", "model"], names).collect()}
    assert len(wide) == 140
    for r in long.collect():
        w = wide[r.i, r.model]
        assert (w[f"stat_{r.rule}"], w[f"limit_{r.rule}"], w[f"pred_{r.rule}"]) == (r.statistic, r.limit, r.accepted)


def test_training_thresholds_are_higher_quantiles(spark, fitted):
    df, f = fitted
    fits = {r.model: r for r in f.collect()}
    own = simca.distances(df.select("class", "spectrum"), f, K, "spectrum", "class").collect()
    for t in simca.train_thresholds(df, "class", "spectrum", f, K, ALPHA).collect():
        mine = [r for r in own if r.model == t.model]
        each = [_stats(fits[t.model], r.h, r.q) for r in mine]
        quantile = lambda v: np.quantile(v, 1 - ALPHA, method="higher")
        assert t.H_emp_cv == pytest.approx(quantile([r.h for r in mine])) and t.Q_emp_cv == pytest.approx(quantile([r.q for r in mine]))
        for name, s in (("simple_emp_cv", "simple_stat"), ("alternative_chi2_emp_cv", "sum_stat"), ("data_driven_emp_cv", "dd_stat")):
            assert t[name] == pytest.approx(quantile([e[s] for e in each]))
        assert t.alternative_empHQ_emp_cv == pytest.approx(quantile([r.h / t.H_emp_cv + r.q / t.Q_emp_cv for r in mine]))


def test_rejection_rates_of_the_summary(spark, fitted):
    df, f = fitted
    cv = simca.cv_distances(df, "class", "grp", "spectrum", K, ALPHA)
    t = simca.cv_thresholds(cv, ALPHA)
    rows, held = cv.collect(), {r.model: r for r in t.collect()}
    of = {"simple_chi2": ("simple_stat", 1.0), "simple_emp_cv": ("simple_stat", "simple_emp_cv"), "alternative_chi2_fixed2": ("sum_stat", 2.0), "data_driven_emp_cv": ("dd_stat", "data_driven_emp_cv")}
    got = {(r.model, r.rule): r for r in simca.cv_summary(cv, t, ALPHA).collect()}
    for (model, rule), r in got.items():
        if rule in of:
            s, limit = of[rule]
            limit = held[model][limit] if isinstance(limit, str) else limit
            rate = np.mean([x[s] >= limit for x in rows if x.model == model])
            assert r.n == 35 and r.rejection_rate == pytest.approx(rate) and r.abs_rejection_error == pytest.approx(abs(rate - ALPHA))
    assert {rule for _, rule in got} >= set(of)


def test_decisions_among_several_classes(spark):
    rows = [(1, "a", 0.5, 0.5), (1, "b", 0.9, 0.2), (2, "a", 2.0, 0.1), (2, "b", 0.3, 0.3), (3, "a", 5.0, 5.0), (3, "b", 4.0, 4.0), (4, "a", 1.0, 0.1), (4, "b", 3.0, 0.1)]
    df = spark.createDataFrame([(*r, 1.0, 1.0) for r in rows], "i int, model string, h double, q double, h_limit double, q_limit double")
    got = {r.i: (r.accepted, r.closest, r.decision) for r in models.multiclass(df, "i").collect()}
    assert got == {1: (["a", "b"], "a", "ambiguous"), 2: (["b"], "b", "b"), 3: ([], "b", "unknown"), 4: ([], "a", "unknown")}


def test_loading_stability_equals_numpy(spark):
    rng = np.random.default_rng(2)
    runs = {r: np.linalg.qr(rng.normal(size=(6, 6)))[0][:3] for r in ("0", "1", "2")}
    runs["3"] = runs["0"] * [[1], [-1], [1]]
    df = spark.createDataFrame([("c", r, x.tolist()) for r, x in runs.items()], "candidate string, run string, loadings array<array<double>>")
    for r in pca_metrics.loading_stability(df, "candidate", "run", 2).collect():
        a, b = runs["0"][:2], runs[r.run][:2]
        i = r.component - 1
        assert r.loading_abs_correlation == pytest.approx(abs(np.corrcoef(a[i], b[i])[0, 1]))
        assert r.loading_angle_deg == pytest.approx(np.degrees(np.arccos(min(1, abs(a[i] @ b[i])))), abs=1e-5)
        s = np.clip(np.linalg.svd(a @ b.T, compute_uv=False), 0, 1)
        assert r.subspace_similarity == pytest.approx((s**2).mean()) and r.max_principal_angle_deg == pytest.approx(np.degrees(np.arccos(s)).max(), abs=1e-4)
        if r.run in ("0", "3"):
            assert r.loading_abs_correlation == pytest.approx(1) and r.subspace_similarity == pytest.approx(1)


def test_fold_assignment_deals_whole_groups_evenly(spark):
    groups = spark.range(24).select(F.concat(F.lit("g"), "id").alias("g"), (F.col("id") % 3).alias("label"), (F.col("id") % 5 + 1).alias("n"))
    got = audit.fold_assignment(groups, 2, "g", "label", "n").collect()
    assert len({r.g for r in got}) == len(got) == 24 and {r.fold for r in got} == {0, 1}
    for label in range(3):
        assert {r.fold for r in got if r.label == label} == {0, 1}
    size = [sum(r.n for r in got if r.fold == f) for f in (0, 1)]
    assert abs(size[0] - size[1]) <= 2
    again = audit.fold_assignment(groups.repartition(5), 2, "g", "label", "n").collect()
    assert {r.g: r.fold for r in again} == {r.g: r.fold for r in got}
