"""Evaluations keep no more state than they need, and read what is costly once."""

import pytest

from prismata.operators import evaluation


def test_only_target_rows_are_held_by_item(spark):
    rows = [("a", 1, True, "non_target"), ("a", 1, True, "target"), ("a", 1, None, "target"), ("a", 2, False, "target"), ("a", 3, True, "uncertain"), (None, 4, False, "non_target"), (None, 4, None, None)]
    df = spark.createDataFrame(rows, "image string, item int, truth boolean, decision string")
    out = evaluation.grouped_decisions(df, ["image"], "item")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in below and "truth" in below for x, below in zip(plan.splitlines(), plan.splitlines()[2:]) if "Aggregate [image" in x and "item" in x.split("],")[0])
    got = {r.image: r for r in out.collect()}
    a, n = got["a"], got[None]
    assert (a.n_observations, a.n_target, a.fn, a.tp, a.fp, a.n_target_objects, a.macro_object_target_miss_rate) == (5, 3, 1, 1, 1, 2, pytest.approx(0.25))
    assert (n.n_observations, n.n_target, n.tn, n.n_target_objects, n.macro_object_target_miss_rate) == (2, 0, 1, 0, None)


def test_guardrails_store_what_they_read_twice(spark):
    metrics = spark.createDataFrame([(0, "overall", "miss", 0.9), (0, "x", "miss", 0.1), (1, "overall", "miss", 0.1), (1, "x", "miss", None)], "fold int, scope string, metric string, value double")
    limits = spark.createDataFrame([("miss", "<=", 0.2, 0.5)], "metric string, operator string, warn double, fail double")
    out = evaluation.guardrails(metrics, limits, "fold")
    assert any("guardrails-" in f for f in out.inputFiles())
    assert {(r.fold, r.scope): r.status for r in out.collect()} == {(0, "overall"): "fail", (0, "x"): "warning", (1, "overall"): "pass", (1, "x"): "missing"}


def test_shares_come_from_one_count(spark):
    df = spark.createDataFrame([(0, "target"), (0, "target"), (0, None), (None, "target")], "fold int, decision string")
    out = evaluation.decision_shares(df, ["fold"])
    assert "sum(n" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.fold, r.decision, r.n, round(r.rate, 6)) for r in out.collect()} == {(0, "target", 2, 0.666667), (0, None, 1, 0.333333), (None, "target", 1, 1.0)}
