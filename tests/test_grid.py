"""Grids as one plan against refits in NumPy, configuration by configuration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import grid, runner, simca
from prismata.operators.chain import Chain
from prismata.operators.models import chi2_inverse

BANDS = 11


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    x = np.abs(rng.normal(size=(240, BANDS)).cumsum(1) * 0.1 + 2 + rng.normal(size=(240, 1)) * 0.2) + 0.05
    rows = [(i, f"o{i // 6}", f"i{i // 24}", "ab"[(i // 6) % 2], i // 24 % 3, [float(v) for v in x[i]]) for i in range(240)]
    lost = -1.0 - 0.1 * np.sin(np.arange(BANDS))
    rows.append((240, "o0", "i0", "a", 0, lost.tolist()))
    return np.vstack([x, lost]), rows, spark.createDataFrame(rows, "vec_id int, object string, image string, class string, fold int, spectrum array<double>").repartition(4)


def _snv(x):
    return (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)


def _msc(x, ref):
    b = ((x - x.mean(1, keepdims=True)) * (ref - ref.mean())).sum(1, keepdims=True) / ((ref - ref.mean()) ** 2).sum()
    return (x - (x.mean(1, keepdims=True) - b * ref.mean())) / b


def _apply(chain, fit, x):
    if chain == "raw":
        return x
    if chain == "snv":
        return _snv(x)
    if chain == "absorbance":
        return -np.log10(x)
    if chain == "msc":
        return _msc(x, fit.mean(0))
    return _msc(-np.log10(x), (-np.log10(fit)).mean(0))


def _model(x, k, alpha):
    n, chi = len(x), lambda dof: chi2_inverse(1 - alpha, np.array([dof]))[0]
    value, vector = np.linalg.eigh(np.cov(x, rowvar=False))
    value, vector = value[::-1], vector[:, ::-1]
    rest = value[k:][value[k:] > 1e-12]
    m = {"mean": x.mean(0), "l": value[:k], "p": vector[:, :k], "h0": k * (n - 1) / n, "q0": rest.sum(), "nq": rest.sum() ** 2 / (rest**2).sum(), "nh": float(k)}
    m |= {"h_limit": m["h0"] / k * chi(k), "q_limit": m["q0"] / m["nq"] * chi(m["nq"]), "dd_limit": chi(k + m["nq"])}
    h, q = _hq(m, x)
    c = h / m["h_limit"] + q / m["q_limit"]
    nc = 2 * c.mean() ** 2 / c.var()
    return m | {"combined": c.mean() / nc * chi(nc)}


def _hq(m, x):
    c = x - m["mean"]
    t = c @ m["p"]
    return (t * t / m["l"]).sum(1), ((c - t @ m["p"].T) ** 2).sum(1)


def _margin(m, variant, h, q):
    a, b = h / m["h_limit"], q / m["q_limit"]
    stat, limit = {"simple_chi2": (np.maximum(a, b), 1.0), "alternative_chi2_fixed2": (a + b, 2.0), "combined_index_chi2": (a + b, m["combined"]), "data_driven_chi2": (m["nh"] * h / m["h0"] + m["nq"] * q / m["q0"], m["dd_limit"])}[variant]
    return 1 - stat / limit


CONFIGS = [grid.Config("raw", 2), grid.Config("raw", 4, "combined_index_chi2"), grid.Config("snv", 3, "data_driven_chi2", 0.01), grid.Config("msc", 2, "alternative_chi2_fixed2"), grid.Config("absorbance_msc", 3), grid.Config("raw", 2, matrix="object_mean"), grid.Config("absorbance", 90)]


def test_folds_equal_refits(spark, table):
    x, rows, df = table
    g = grid.fit_grid(grid.fold_roles(df, "fold"), CONFIGS, "a")
    pixels = g.pixels().collect()
    got = {(r.split, r.chain, r.matrix, r.k, r.variant, r.vec_id): r for r in pixels}
    assert len(got) == len(pixels)
    fold, klass, obj = (np.array([r[j] for r in rows]) for j in (4, 3, 1))
    n = 0
    for c in CONFIGS[:-1]:
        for f in range(3):
            taken = (x > 0).all(1) | (not c.chain.startswith("absorbance"))
            fit, held = taken & (fold != f), taken & (fold == f)
            raw, target = x[fit], klass[fit] == "a"
            if c.matrix == "object_mean":
                names = obj[fit][target]
                train = np.array([raw[target][names == o].mean(0) for o in sorted(set(names))])
                m = _model(train, c.k, c.alpha)
            else:
                m = _model(_apply(c.chain, raw, raw[target]), c.k, c.alpha)
            h, q = _hq(m, _apply(c.chain, raw, x[held]))
            want = _margin(m, c.variant, h, q)
            for i, a, b, w in zip(np.flatnonzero(held), h, q, want, strict=True):
                r = got[str(f), c.chain, c.matrix, c.k, c.variant, int(rows[i][0])]
                assert r.h == pytest.approx(a, rel=1e-6, abs=1e-9) and r.q == pytest.approx(b, rel=1e-6, abs=1e-9)
                assert r.margin == pytest.approx(w, rel=1e-6, abs=1e-9) and r.decision == (w >= 0) and r.truth == (rows[i][3] == "a")
                n += 1
    assert n == len(got)
    assert {(r.split, r.error) for r in g.errors.collect()} == {(str(f), "too_few_rows") for f in range(3)}


def test_objects_metrics_and_events_follow_from_pixels(spark, table):
    _, rows, df = table
    g = grid.fit_grid(grid.simple_roles(df.where("fold < 2"), df.where("fold = 2")), CONFIGS, "a")
    pixels = g.pixels().toPandas()
    objects = g.objects().toPandas()
    name = ["chain", "matrix", "k", "variant"]
    by = pixels.groupby([*name, "object"])["decision"].mean()
    assert len(by) == len(objects) and all(by[tuple(r[c] for c in [*name, "object"])] == pytest.approx(r["ratio"]) for _, r in objects.iterrows())
    metrics = g.metrics([0.5, 0.9]).toPandas()
    for _, r in metrics[metrics["error"].isna()].iterrows():
        o = objects[(objects[name] == r[name].values).all(1)]
        hit = o["ratio"] >= r["threshold"]
        assert (r["tp"], r["fn"], r["fp"], r["tn"]) == ((hit & o["truth"]).sum(), (~hit & o["truth"]).sum(), (hit & ~o["truth"]).sum(), (~hit & ~o["truth"]).sum())
    assert list(metrics[metrics["error"].notna()]["chain"]) == ["absorbance"] and len(metrics) == 2 * 6 + 1
    seen = {(r.data.split("/")[0], r.data.split("/")[1], r.role): (r.n_input_rows, r.n_valid_rows, r.n_filtered_rows) for r in g.events.collect()}
    n_fit = sum(r[4] < 2 for r in rows)
    assert seen["raw", "pixels", "fit"] == (n_fit, n_fit, 0) and seen["absorbance", "pixels", "fit"] == (n_fit, n_fit - 1, 1)
    assert seen["snv", "pixels", "project"] == (len(rows) - n_fit,) * 2 + (0,) and len(seen) == 2 * 6
    own = g.pixels("fit").toPandas()
    shift = g.shift().toPandas()
    assert len(shift) == 6
    for _, r in shift.iterrows():
        t, p = (d[(d[name] == r[name].values).all(1)] for d in (own, pixels))
        assert (r["n_train"], r["n_projection"]) == (len(t), len(p))
        for v in ("h", "q", "ratio", "margin"):
            assert r[f"{v}_shift"] == pytest.approx((p[v].mean() - t[v].mean()) / t[v].std())
        assert r["out_of_domain_rate"] == pytest.approx((p["ratio"] >= 1).mean())
        assert r["target_rejection_rate"] == pytest.approx((p[p["truth"]]["margin"] < 0).mean())
    rules = g.rule_diagnostics().toPandas()
    for _, r in rules.iterrows():
        p = pixels[(pixels[name] == r[name].values).all(1)]
        assert r["target_accept_rate"] == pytest.approx(p[p["truth"]]["accepted"].mean()) and r["other_accept_rate"] == pytest.approx(p[~p["truth"]]["accepted"].mean())
    assert {(r.status, r.explained is None or 0 < r.explained <= 1) for r in g.fit_diagnostics().collect()} == {("ok", True), ("too_few_rows", True)}


def test_held_out_outputs_and_mixtures(spark, table):
    *_, df = table
    configs = CONFIGS[:3]
    thresholds = spark.createDataFrame([(c.chain, c.k, c.variant, c.alpha, c.m, c.seed, 0.3, 0.8, f"t{i}") for i, c in enumerate(configs)], "chain string, k int, variant string, alpha double, m int, seed int, lower double, upper double, track string")
    train, test = df.where("fold < 2"), df.where("fold = 2")
    out = runner.held_out_test(train, test, configs, "a", thresholds)
    o = out.objects.toPandas()
    assert set(o["track"]) == {"t0", "t1", "t2"}
    assert (o["decision"] == np.where(o["ratio"] >= 0.8, "target", np.where(o["ratio"] <= 0.3, "non_target", "uncertain"))).all()
    for r in out.three_way(image=True).collect():
        x = o[(o["track"] == r.track) & (o["image"] == r.image)]
        assert r.n_missed == (x["truth"] & (x["decision"] == "non_target")).sum() and r.n_uncertain == (x["decision"] == "uncertain").sum() and r.n_objects == len(x)
    two = {r.track: r for r in out.two_way().collect()}
    assert all(r.tp == ((o["track"] == t) & o["truth"] & (o["ratio"] >= 0.5)).sum() for t, r in two.items())
    assert out.two_way("pixels", True).count() == 3 * df.where("fold = 2").select("image").distinct().count()
    objects, shares = runner.mixture_application(train, test.withColumn("class", F.lit(None).cast("string")), configs, "a", thresholds, "track")
    assert "truth" not in objects.columns and objects.count() == len(o)
    got = {(r.track, r.image): r.target_rate for r in shares.collect()}
    assert all(got[t, i] == pytest.approx((x["decision"] == "target").mean()) for (t, i), x in o.groupby(["track", "image"]))
    with pytest.raises(Exception, match="no value for a key"):
        runner.held_out_test(train, test, configs, "a", thresholds.where("track <> 't1'")).objects.collect()


def test_configurations_are_checked_before_a_fit(spark, table):
    *_, df = table
    roles = grid.simple_roles(df.where("fold < 2"), df.where("fold = 2"))
    plan = {
        "valid": grid.Config("raw", 3), "window_even": grid.Config("sg_d1", 3, window=8), "derivative_above_order": grid.Config("sg_d2", 3, order=1), "window_exceeds_bands": grid.Config("sg_d1", 3, window=13), "m_not_positive": grid.Config("raw", 3, m=0),
        "too_few_pixels_an_object": grid.Config("raw", 3, m=50), "components_not_positive": grid.Config("raw", 0), "alpha_out_of_range": grid.Config("raw", 3, alpha=1.0), "components_above_bands": grid.Config("raw", 12), "unknown_rule": grid.Config("raw", 3, "other"), "unknown_step": grid.Config("other", 3),
    }
    got = grid.configuration_status(roles, list(plan.values()), ["a", "z"]).collect()
    assert {r.status for r in got if r.target == "z"} >= {"target_class_missing"}
    by = {(r.chain, r.k, r.variant, r.alpha, r.m, r.window, r.order): r.status for r in got if r.target == "a"}
    assert {by[c.chain, c.k, c.variant, c.alpha, c.m, c.window, c.order] == s for s, c in plan.items()} == {True}
    assert {r.status for r in grid.configuration_status(grid.simple_roles(df.where("fold < 2 AND class = 'a'"), df), [grid.Config("raw", 3)], ["a"]).collect()} == {"one_class_only"}
    few = grid.configuration_status(grid.simple_roles(df.where("vec_id < 8"), df), [grid.Config("raw", 3, matrix="object_mean")], ["a"])
    assert few.first().status == "too_few_target_rows"


def test_audit_of_predictions_leaves_the_valid_ones(spark, table):
    *_, df = table
    g = grid.fit_grid(grid.simple_roles(df.where("fold < 2"), df.where("fold = 2")), CONFIGS, "a")
    audit, valid = runner.prediction_audit(g, g.metrics([0.5]))
    assert {(r.chain, r.reason) for r in audit.collect() if not r.valid} == {("absorbance", "error:too_few_rows")}
    assert "absorbance" not in {r.chain for r in valid.collect()} and valid.count() == 6


def test_sampling_takes_the_same_pixels_for_every_chain(spark, table):
    *_, df = table
    configs = [grid.Config(c, 2, m=4, seed=s) for c in ("raw", "snv") for s in (1, 2)]
    g = grid.fit_grid(grid.simple_roles(df.where("fold < 2"), df.where("fold = 2")), configs, "a")
    picks = {}
    for r in g.pixels().collect():
        picks.setdefault((r.chain, r.seed), set()).add(r.vec_id)
    assert picks["raw", 1] == picks["snv", 1] != picks["raw", 2] and len(picks["raw", 1]) == 12 * 4


def test_scoring_by_join_and_the_number_of_jobs(spark, table, monkeypatch):
    *_, df = table
    roles = grid.simple_roles(df.where("fold < 2"), df.where("fold = 2"))
    a = {(r.setting, r.k, r.vec_id): r.margin for r in grid.fit_grid(roles, CONFIGS[:3], "a").pixels().collect()}
    monkeypatch.setattr(simca, "SENT", 0)
    b = {(r.setting, r.k, r.vec_id): r.margin for r in grid.fit_grid(roles, CONFIGS[:3], "a").pixels().collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    monkeypatch.undo()
    tracker, n = spark.sparkContext.statusTracker(), {}
    for size in (1, 8):
        spark.sparkContext.setJobGroup(f"grid-{size}", "")
        grid.fit_grid(roles, [grid.Config("raw", 1), *[grid.Config("snv", k) for k in range(1, size)]], "a").metrics([0.5]).collect()
        n[size] = len(tracker.getJobIdsForGroup(f"grid-{size}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n[8] <= n[1] + 3


def test_cross_validation_with_msc_equals_refits(spark, table):
    x, rows, df = table
    cv = grid.cross_validated(df.where("spectrum[0] > 0"), Chain(("absorbance", "msc")), "class", "fold", 2, 0.05, keep=["vec_id"])
    got = {r.vec_id: r for r in cv.collect()}
    assert len(got) == 240
    for c in "ab":
        for f in range(3):
            mine = np.array([r[3] == c for r in rows]) & (x > 0).all(1)
            held = mine & np.array([r[4] == f for r in rows])
            fit = x[mine & ~held]
            m = _model(_apply("absorbance_msc", fit, fit), 2, 0.05)
            h, q = _hq(m, _apply("absorbance_msc", fit, x[held]))
            for i, a, b in zip(np.flatnonzero(held), h, q, strict=True):
                assert got[i].h == pytest.approx(a, rel=1e-6) and got[i].q == pytest.approx(b, rel=1e-6, abs=1e-10)
                assert got[i].simple_stat == pytest.approx(max(a / m["h_limit"], b / m["q_limit"]), rel=1e-6)


def test_cross_validation_at_an_offset(spark, table):
    x, rows, df = table
    near = simca.cv_distances(df, "class", "fold", "spectrum", 2, 0.05, keep=["vec_id"]).collect()
    far = simca.cv_distances(df.withColumn("spectrum", F.transform("spectrum", lambda v: v + 1e6)), "class", "fold", "spectrum", 2, 0.05, keep=["vec_id"]).collect()
    a, b = ({r.vec_id: r for r in y} for y in (near, far))
    assert all(a[i].q == pytest.approx(b[i].q, rel=1e-4, abs=1e-8) and a[i].h == pytest.approx(b[i].h, rel=1e-4) for i in a)


def test_an_empty_table_gives_error_rows_only(spark, table):
    *_, df = table
    g = grid.fit_grid(grid.simple_roles(df.limit(0), df.where("fold = 2")), CONFIGS[:2], "a")
    assert g.pixels().count() == 0 and {r.error for r in g.metrics([0.5]).collect()} == {"no_target_row"}
