"""SIMCA fits, rules, cross-validation and matching against NumPy and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import simca, spatial
from prismata.operators.models import chi2_inverse
from prismata.plans.shared import materialize

K, ALPHA = 2, 0.1


def _fit(x):
    mean, n = x.mean(0), len(x)
    value, vector = np.linalg.eigh(np.cov(x, rowvar=False))
    order = np.argsort(value)[::-1]
    value, vector = value[order], vector[:, order]
    q1, q2 = value[K:].sum(), (value[K:] ** 2).sum()
    h0, nh, q0, nq = K * (n - 1) / n, float(K), q1, q1 * q1 / q2
    chi = lambda dof: chi2_inverse(1 - ALPHA, np.array([dof]))[0]
    return {"mean": mean, "l": value[:K], "p": vector[:, :K], "h0": h0, "nh": nh, "q0": q0, "nq": nq, "h_limit": h0 / nh * chi(nh), "q_limit": q0 / nq * chi(nq), "dd_limit": chi(nh + nq)}


def _dist(m, x):
    c = x - m["mean"]
    t = c @ m["p"]
    return (t * t / m["l"]).sum(1), ((c - t @ m["p"].T) ** 2).sum(1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) @ np.diag([3, 2, 1, 0.5, 0.4]) + 4
    table = [(i, "a" if i < 40 else "b", f"g{i % 4}", [float(v) for v in x[i]]) for i in range(60)]
    return x, spark.createDataFrame(table, "i int, class string, group string, spectrum array<double>").repartition(3)


def test_limits_and_rules_equal_numpy(spark, rows):
    x, df = rows
    f = simca.fit(df, "class", "spectrum", K, ALPHA)
    got = {r.model: r for r in f.collect()}
    for name, part in (("a", x[:40]), ("b", x[40:])):
        m = _fit(part)
        for c in ("h0", "nh", "q0", "nq", "h_limit", "q_limit", "dd_limit"):
            assert got[name][c] == pytest.approx(m[c], rel=1e-8), c
        h, q = _dist(m, part)
        s = h / m["h_limit"] + q / m["q_limit"]
        assert got[name].h_empirical == pytest.approx(np.quantile(h, 1 - ALPHA)) and got[name].c_empirical == pytest.approx(np.quantile(s, 1 - ALPHA))
        nc = 2 * s.mean() ** 2 / s.var()
        assert got[name].combined_limit == pytest.approx(s.mean() / nc * chi2_inverse(1 - ALPHA, np.array([nc]))[0])
    m = _fit(x[:40])
    h, q = _dist(m, x)
    long = {(r.i, r.rule): r for r in simca.project(simca.distances(df, f, K, "spectrum"), f).where("model = 'a'").collect()}
    for i in range(60):
        a, b = h[i] / m["h_limit"], q[i] / m["q_limit"]
        want = {"simple_chi2": (max(a, b), 1), "alternative_chi2_fixed2": (a + b, 2), "data_driven_chi2": (m["nh"] * h[i] / m["h0"] + m["nq"] * q[i] / m["q0"], m["dd_limit"])}
        for rule, (stat, limit) in want.items():
            r = long[i, rule]
            assert r.statistic == pytest.approx(stat) and r.margin == pytest.approx(1 - stat / limit) and r.accepted == (stat < limit)


def test_scoring_by_join_equals_scoring_in_tasks(spark, rows, monkeypatch):
    _, df = rows
    f = simca.fit(df, "class", "spectrum", K, ALPHA)
    a = {(r.i, r.model): (r.h, r.q) for r in simca.distances(df, f, K, "spectrum").collect()}
    monkeypatch.setattr(simca, "SENT", 0)
    b = {(r.i, r.model): (r.h, r.q) for r in simca.distances(df, f, K, "spectrum").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_cross_validation_equals_refits(spark, rows):
    x, df = rows
    cv = simca.cv_distances(df.where("class = 'a'"), "class", "group", "spectrum", K, ALPHA, keep=["i"])
    got = {r.i: r for r in cv.collect()}
    sums = []
    for g in range(4):
        out = [i for i in range(40) if i % 4 == g]
        m = _fit(x[[i for i in range(40) if i % 4 != g]])
        h, q = _dist(m, x[out])
        for i, a, b in zip(out, h, q, strict=True):
            assert got[i].h == pytest.approx(a) and got[i].q == pytest.approx(b)
            sums.append(a / m["h_limit"] + b / m["q_limit"])
    t = simca.cv_thresholds(cv, ALPHA).first()
    assert t.alternative_chi2_emp_cv == pytest.approx(np.quantile(sums, 1 - ALPHA, method="higher")) and t.n_folds == 4


def test_small_folds_write_no_matrix_each(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 30))
    of = [i // 2 if i < 200 else 100 for i in range(240)]  # 100 folds of two rows, one of 40
    df = spark.createDataFrame([(i, "a", of[i], [float(v) for v in x[i]]) for i in range(240)], "i int, class string, group int, spectrum array<double>").repartition(3)
    monkeypatch.setattr(simca, "BUNDLE", 20, raising=False)
    written = []
    monkeypatch.setattr(simca, "materialize", lambda d, name: written.append((name, t := materialize(d, name))) or t)
    got = {r.i: r for r in simca.cv_distances(df, "class", "group", "spectrum", K, ALPHA, keep=["i"]).collect()}
    assert len(got) == 240
    for g in set(of):
        out = [i for i in range(240) if of[i] == g]
        m = _fit(x[[i for i in range(240) if of[i] != g]])
        h, q = _dist(m, x[out])
        for i, a, b in zip(out, h, q, strict=True):
            assert got[i].h == pytest.approx(a) and got[i].q == pytest.approx(b) and got[i].sum_stat == pytest.approx(a / m["h_limit"] + b / m["q_limit"])
            assert got[i].dd_stat == pytest.approx(m["nq"] * b / m["q0"] + m["nh"] * a / m["h0"]) and got[i].model == "a" and got[i].fold == str(g)
    assert {name: t.count() for name, t in written if "grams" in name or "models" in name} == {"class-grams": 1, "held-grams": 1, "fold-models": 1}


def test_higher_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g in range(3) for v in np.round(rng.normal(size=200 + g), g)]
    df = spark.createDataFrame([*data, (3, 1.0), (None, 2.0), (0, None)], "g int, v double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {r.g: r.quantile for r in simca.higher_quantiles(df.where("g IS NOT NULL"), ["g"], "v", q).collect()}
        assert got == {g: (1.0 if g == 3 else float(np.quantile([v for k, v in data if k == g], q, method="higher"))) for g in range(4)}


def test_degenerate_fits_have_no_limits(spark):
    df = spark.createDataFrame([("few", [1.0, 2.0, 3.0]), ("few", [1.0, 2.0, 4.0])] + [("line", [float(i), 2.0 * i, 0.0]) for i in range(9)], "class string, spectrum array<double>")
    got = {r.model: r for r in simca.fit(df, "class", "spectrum", 2, 0.05).collect()}
    assert got["few"].status == "too_few_rows" and got["line"].status == "components_above_rank" and got["few"].h_limit is None
    one = simca.fit(df.where("class = 'line'"), "class", "spectrum", 1, 0.05).first()
    assert one.status == "ok" and one.q_limit > 0 and one.nq >= 1  # no residual is left, so the moments decide


def test_matching_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = map(int, rng.integers(1, 6, 2))
        gain = np.where(rng.random((a, b)) < 0.6, rng.random((a, b)), 0.0)
        pairs = spatial._assign(gain)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == min(a, b)
        small, large = (gain, b) if a <= b else (gain.T, a)
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), min(a, b)))
        assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def test_matching_of_components(spark):
    cells = [("x", 0, c, la, lb) for c, (la, lb) in enumerate([(1, 7), (1, 7), (1, 8), (2, 8), (2, 8), (None, 9), (3, None)])]
    df = spark.createDataFrame(cells, "image string, row int, col int, a int, b int")
    got = spatial.component_agreement(df, "a", "b").first()
    assert (got.n_a, got.n_b, got.n_matched) == (3, 3, 2) and got.unmatched_rate == pytest.approx(2 / 6) and got.mean_iou == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_ids_tell_values_and_nulls_apart(spark):
    from prismata.sources import tables

    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("null", "c"), ("a|y=1", "c")], "x string, y string")
    assert df.select(tables.stable_id("i", ["x", "y"]).alias("i")).distinct().count() == 5
    prints = {tables.fingerprint(df.where(F.col("x").eqNullSafe(v)), ["x", "y"], []).first()[0] for v in ("a|b", "a", None, "null")}
    assert len(prints) == 4
