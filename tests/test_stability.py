"""Statuses at their limits do not follow how a table is split or sorted."""

import math

from pyspark.sql import functions as F

from prismata.operators import robustness


def _welford(values):
    n, mean, m2 = 0, 0.0, 0.0
    for x in values:
        n += 1
        new = mean + (x - mean) / n
        m2 += (x - new) * (x - mean)
        mean = new
    return math.sqrt(m2 / (n - 1)) if n > 1 else None


def test_a_deviation_at_its_limit_follows_the_order_of_runs(spark):
    digits = {"a": [0, 8, 4, 6, 1, 7, 7, 7, 8], "b": [8, 7, 7, 7, 1, 6, 4, 8, 0], "c": [3], "d": [0, 2, None, 5]}
    rows = [(m, i, None if v is None else v / 10) for m, d in digits.items() for i, v in enumerate(d)]
    df = spark.createDataFrame(rows, "model string, run int, m2 double").withColumn("seed", F.col("run") % 3)
    for cut in (df, df.orderBy(F.desc("run")), df.repartition(5, "run")):
        got = {r.model: r for r in robustness.stability_status(cut, "model", "seed", {"m2": (0.3, False)}, 1, "run").collect()}
        for m, d in digits.items():
            want = _welford([v / 10 for v in d if v is not None])
            assert got[m].m2_std == want
        assert got["a"].status == "robust_with_supporting_warnings"  # 0.3 and a rounding, as DuckDB's stddev_samp of these runs


def test_equal_means_follow_the_order_of_runs(spark):
    values = {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1], "c": [0.9, None, None]}
    rows = [(0, m, i, x, 1.0, m == "c") for m, v in values.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "track int, model string, run int, m1 double, m2 double, random boolean").withColumn("seed", F.col("run"))
    for cut in (df, df.orderBy(F.desc("run")), df.repartition(5, "run")):
        got = {r.model: r for r in robustness.front_jackknife(cut, "track", "model", "seed", "random", [0, 1, 2], ["m1", "m2"], "run").collect()}
        assert (got["a"].reference, got["a"].frequency) == (False, 0.0)  # 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1
        assert (got["b"].reference, got["b"].frequency) == (True, 1.0)
        assert robustness._means_without(cut, "track", "model", "seed", "random", [0, 1, 2], ["m1", "m2"], "run").where("model = 'c'").select("omitted", "m1").orderBy("omitted").collect() == [(-1, 0.9), (0, None), (1, 0.9), (2, 0.9)]
        jaccard = robustness.front_jaccard(cut, "track", "model", "seed", "random", [0, 1, 2], ["m1", "m2"], "run").where("omitted <> 0").select("jaccard").collect()
        assert [r.jaccard for r in jaccard] == [1.0, 1.0]
