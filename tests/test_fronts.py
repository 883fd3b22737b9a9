"""Tolerance fronts and greedy collapse against plain loops, and null keys in grouped operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import audit, choice, evaluation, fronts, leaders, matrices, pca_metrics, robustness, sampling, simca


def _loop(x, eps):
    """Vectors one after another in ascending order."""
    front = []
    for c in sorted(set(map(tuple, x))):
        better = lambda a, b: all(p <= q + eps for p, q in zip(a, b, strict=True)) and any(p < q - eps for p, q in zip(a, b, strict=True))
        if not any(better(f, c) for f in front):
            front = [f for f in front if not better(c, f)] + [c]
    return set(front)


@pytest.mark.parametrize("eps", [0.0, 0.05, 0.3])
@pytest.mark.parametrize("slice_", [7, 50_000])
def test_front_equals_the_loop(spark, monkeypatch, eps, slice_):
    for name, value in (("SLICE", slice_), ("FAN", 2), ("BLOCK", 4), ("WIDE", 5)):
        monkeypatch.setattr(fronts, name, value)
    rng = np.random.default_rng(3)
    groups = {"a": rng.random((90, 2)), "b": rng.integers(0, 5, (80, 3)) / 10, None: np.c_[np.arange(60) * 0.01, 1 - np.arange(60) * 0.3, np.zeros(60)], "d": np.zeros((3, 3))}
    rows = [(k, *map(float, np.r_[v, [0.0] * (3 - len(v))]), i) for k, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double, i int")
    got = fronts.epsilon_front(df, ["g"], ["x", "y"], eps, ["z"]).collect()
    for k, x in groups.items():
        x = np.c_[x, np.zeros((len(x), 3 - x.shape[1]))]
        want = _loop(x * [1, 1, -1] + 0.0, eps)
        mine = [r for r in got if r.g == k]
        assert {(r.x, r.y, -r.z + 0.0) for r in mine} == want
        assert len(mine) == sum(tuple(v) in want for v in (x * [1, 1, -1] + 0.0).tolist())


def test_walk_and_exact_equal_the_loop_without_spark(monkeypatch):
    monkeypatch.setattr(fronts, "BLOCK", 8)
    rng = np.random.default_rng(4)
    for k in range(60):
        x = np.unique(rng.integers(0, 12, (70, 2 + k % 3)) / 10, axis=0)
        eps = [0.0, 0.1, 0.15, 0.4][k % 4]
        assert {tuple(v) for v in x[fronts.walk(x, eps)]} == _loop(x, eps)
        assert {tuple(v) for v in x[fronts.exact(x)]} == _loop(x, 0.0)


def test_a_million_vectors_in_one_group(spark):
    df = spark.range(1_000_000).select(F.lit("all").alias("g"), *[F.round(F.rand(s), 9).alias(f"m{s}") for s in range(3)])
    got = {(r.m0, r.m1, r.m2) for r in fronts.epsilon_front(df, ["g"], ["m0", "m1", "m2"], 0.01).collect()}
    x = df.drop("g").toPandas().to_numpy(float)
    x = x[np.lexsort(x.T[::-1])]
    assert got == {tuple(v) for v in x[fronts.walk(x, 0.01)].tolist()} and len(got) >= 3


def test_objectives_that_are_not_finite_are_errors(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan"))], "g string, x double")
    with pytest.raises(Exception, match="not finite"):
        fronts.epsilon_front(df, ["g"], ["x"], 0.1).collect()
    assert fronts.epsilon_front(df.limit(0), ["g"], ["x"], 0.1).count() == 0


def _greedy(rows, varied, most):
    """Kept, dropped and summary by a plain loop; rows are in order."""
    kept, dropped, summary = [], {}, {}
    groups = {}
    for r in rows:
        groups.setdefault(r["out"], []).append(r)
    for left in groups.values():
        while left:
            lead = left[0]
            kept.append(lead["id"])
            near = [(r, [c for c in varied if r[c] != lead[c]]) for r in left[1:]]
            gone = [(r, v) for r, v in near if 0 < len(v) <= most]
            for r, v in gone:
                dropped[r["id"]] = (lead["id"], ",".join(sorted(v)))
            if gone:
                summary[lead["id"]] = (len(gone) + 1, ",".join(sorted({c for _, v in gone for c in v})))
            left = [r for r in left[1:] if r["id"] not in dropped]
    return sorted(kept), dropped, summary


@pytest.mark.parametrize("most", [1, 2, 4])
def test_collapse_equals_the_loop(spark, most):
    rng = random.Random(most)
    varied = ["p", "q", "r", "s"]
    rows = [{"id": i, "out": rng.choice([0.1, 0.2 + 1e-14, None]), "p": rng.choice("ab"), "q": rng.choice([1, 2, None]), "r": rng.randrange(4), "s": rng.random() < 0.5} for i in range(140)]
    rows += [dict(rows[3], id=140), dict(rows[3], id=141)]
    df = spark.createDataFrame([(r["id"], *[r[c] for c in ("out", *varied)]) for r in rows], "id int, out double, p string, q int, r int, s boolean")
    kept, dropped, summary = leaders.collapse(df, "id", ["out"], varied, ["id"], most)
    want = _greedy([dict(r, out=None if r["out"] is None else round(r["out"], 12)) for r in rows], varied, most)
    assert sorted(r.id for r in kept.collect()) == want[0] and kept.columns == df.columns
    assert {r.id: (r.representative, r.varied_columns) for r in dropped.collect()} == want[1]
    assert {r.representative: (r.n_candidates, r.varied_columns) for r in summary.collect()} == want[2]


def test_a_chain_is_followed_and_a_big_bucket_makes_no_pairs(spark):
    chain = spark.createDataFrame([(i, (i + 1) // 2, i // 2) for i in range(12)], "id int, a int, b int").withColumn("o", F.lit(1))
    kept, dropped, _ = leaders.collapse(chain, "id", ["o"], ["a", "b"], ["id"])
    assert sorted(r.id for r in kept.collect()) == list(range(0, 12, 2)) and dropped.count() == 6
    many = spark.range(20_000).select("id", F.lit(1).alias("o"), F.col("id").alias("a"), F.lit(0).alias("b"))
    kept, dropped, summary = leaders.collapse(many, "id", ["o"], ["a", "b"], ["id"])
    assert kept.count() == 1 and dropped.count() == 19_999 and summary.first().n_candidates == 20_000


def test_grouped_operators_keep_null_groups_and_equal_rows(spark):
    df = spark.createDataFrame([(None, "x", 1.0, True, False), (None, "x", 1.0, True, False), (None, "y", 3.0, False, False), ("g", "x", 2.0, True, True)], "g string, decision string, v double, truth boolean, prediction boolean")
    assert {(r.g, r.decision): r.rate for r in evaluation.decision_shares(df, ["g"]).collect()} == {(None, "x"): pytest.approx(2 / 3), (None, "y"): pytest.approx(1 / 3), ("g", "x"): 1.0}
    keyed = df.withColumn("k", F.lit(1))
    assert choice.front_with_witness(keyed, ["g"], ["v"], "k").count() == 4
    assert {r.g for r in choice.unit_diagnostics(df, ["g"], "decision", ["v"], ["x"]).collect()} == {None, "g"}
    assert {r.g for r in choice.picked_images(df, "g", "decision", "v").collect()} == {None, "g"}
    assert {r.g: r.quantile for r in simca.higher_quantiles(df, ["g"], "v", 0.5).collect()} == {None: 1.0, "g": 2.0}
    assert {r.g for r in audit.risk_coverage(df, ["g"], "v", [0.5, 1.0]).collect()} == {None, "g"}
    spec = df.withColumns({"spectrum": F.array("v", F.col("v") + 1), "row": F.lit(1), "col": F.lit(2)}).withColumn("id", F.monotonically_increasing_id())
    assert matrices.robust_outliers(spec, ["g"], "id").count() == 4
    assert sampling.centre_distance(spec, ["g"]).count() == 4
    shift = pca_metrics.projection_shift(spec.withColumn("scores", F.col("spectrum")), spec.withColumn("scores", F.col("spectrum")), "g", 2)
    assert shift.first().mean_shift == 0
    assert {r.g for r in robustness.stratified_shift(df, df, "g", "v", {"d": "decision"}, 1).collect()} == {None, "g"}
    with pytest.raises(Exception, match="repeated key"):
        evaluation.attach(df, df.withColumn("w", F.lit(1)), ["g"], ["w"]).collect()
