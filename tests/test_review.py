"""Edge cases of alerts, reviews, funnels and policies on small tables."""

import pytest
from pyspark.sql import functions as F

from prismata.operators import review


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_alerts_null_condition_raises_none_and_repeats_are_an_error(spark):
    rule = [("big", F.col("x") > 1, "warning", ["x"])]
    df = spark.createDataFrame([("a", 2), ("b", None), ("c", 0)], "id string, x int")
    assert [r["record_id"] for r in review.alerts(df, "t", "id", rule).collect()] == ["a"]
    assert review.alerts(df.limit(0), "t", "id", rule).count() == 0
    with pytest.raises(Exception, match="alert raised twice"):
        review.alerts(df.union(df), "t", "id", rule).collect()


def test_missing_fields_names_each(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "a", "b")], "id int, p string, q string")
    assert rows(review.missing_fields(df, "id", ["p", "q"])) == [(1, "p,q"), (2, "q")]


def test_reviews_open_until_whole(spark):
    flags = spark.createDataFrame([(k,) for k in "abcdef"], "alert_id string")
    stored = spark.createDataFrame(
        [("a", "exclude", "x", "2024-01-31", "ok"), ("b", "other", "x", "2024-01-31", "ok"), ("c", "exclude", " ", "2024-01-31", "ok"), ("d", "exclude", "x", "soon", "ok"), ("e", "exclude", "x", "2024-01-31", None)],
        "alert_id string, review_decision string, reviewer string, review_date string, review_comment string",
    )
    merged = review.merge_reviews(flags, stored)
    assert rows(review.open_reviews(merged).select("alert_id", "reason")) == [("b", "invalid_decision"), ("c", "no_reviewer"), ("d", "bad_date"), ("e", "no_comment"), ("f", "pending")]
    applied = review.apply_reviews(merged)
    assert rows(applied.select("alert_id", "qc_status"))[-1] == ("f", "pending")
    assert rows(review.closure(applied.withColumn("g", F.lit(1)), ["g"])) == [(1, 6, 2, 4, 0, "pending")]


def test_funnel_counts_null_as_failed(spark):
    df = spark.createDataFrame([("g", 1), ("g", None), ("g", 5)], "g string, x int")
    got = review.retention_funnel(df, ["g"], [("low", F.col("x") > 0), ("high", F.col("x") > 3)])
    assert rows(got) == [("g", 1, "low", 3, 2, 1), ("g", 2, "high", 2, 1, 1)]


def test_snap_ties_and_null(spark):
    df = spark.createDataFrame([(0.25,), (0.4,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(review.snap(F.col("x"), [0.5, 0.0])).collect()] == [0.0, 0.5, 0.5, None]


def test_crossfit_thresholds_leave_the_fold_out(spark):
    df = spark.createDataFrame([("m", 0, -1.0, False), ("m", 0, 1.0, True), ("m", 1, -3.0, False), ("m", 1, 3.0, True)], "model string, fold int, s double, truth boolean")
    got = review.crossfit_rates(df, "s", ["model"], "fold", 0.0, 0.5, 0.5)
    assert rows(got.select("evaluation_fold", "lower", "upper")) == [(-1, -2.0, 2.0), (0, -3.0, 3.0), (1, -1.0, 1.0)]


def test_search_efficiency_without_a_front(spark):
    t = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "track string, config int")
    u = spark.createDataFrame([(1,), (2,), (3,)], "config int")
    r = review.search_efficiency(t, u, u.limit(0), "track", "config").first()
    assert (r["n_trials"], r["n_unique"], r["front_recall"]) == (3, 2, None)


def test_first_trial_ties_break_by_order(spark):
    t = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "c string, o int, v string")
    assert rows(review.first_trials(t, ["c"], ["o"])) == [("a", 1, "y"), ("b", 1, None)]
