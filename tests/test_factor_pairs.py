"""Pairs that differ in one factor, and what is counted and averaged over them without making them."""

import random

import pytest
from pyspark.sql import functions as F

from prismata.operators import robustness


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None]), rng.choice([True, False]), rng.choice([0.1, 5.25, 1e6 + 0.5, None])) for i in range(120)]
    models = spark.createDataFrame(rows + rows[:5], "id int, p int, q string, ref boolean, m double")
    runs = models.select("id", "m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(None).cast("int"))).alias("seed")).where("(id + coalesce(seed, 0)) % 4 <> 1")
    return models, models.where("id % 3 <> 0").select("id"), runs


FACTORS = "id", ["p", "q"], "ref"


def test_pairs_are_not_joined_or_moved_again(spark, tables):
    models, evaluated, _ = tables
    pairs = robustness.one_factor_pairs(models, evaluated, *FACTORS)
    assert pairs._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    rows = [r for r in models.collect()]
    text = lambda v: None if v is None else str(v)
    want = [(f, a.id, b.id, text(b[f]), text(a[f]), "not_evaluated" if a.id % 3 == 0 else "estimable") for f, rest in (("p", "q"), ("q", "p")) for a in rows for b in rows if b.ref and a[rest] == b[rest] and a[f] != b[f]]
    assert sorted(map(str, map(tuple, pairs.collect()))) == sorted(map(str, want))


def _shuffled(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_references_are_not_shuffled_in_copies(spark):
    """Neither is a key lost that is NULL."""
    rows = [(i or None, i % 3, "x", i % 10 == 0) for i in range(1000)]
    models = spark.createDataFrame(rows, "id int, p int, q string, ref boolean")
    before = _shuffled(spark)
    got = sorted(map(str, map(tuple, robustness.one_factor_pairs(models, models.where("id < 500").select("id"), *FACTORS).collect())))
    assert _shuffled(spark) - before < 4 * len(rows)
    assert got == sorted(str(("p", a[0], b[0], str(b[1]), str(a[1]), "estimable" if a[0] and a[0] < 500 else "not_evaluated")) for a in rows for b in rows if b[3] and a[1] != b[1])


def test_coverage_without_pairs(spark, tables):
    models, evaluated, _ = tables
    want = robustness.coverage_of(robustness.one_factor_pairs(models, evaluated, *FACTORS))
    got = robustness.factor_coverage(models, evaluated, *FACTORS)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 2
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "")
    assert robustness.factor_coverage(models.where("ref IS NULL"), evaluated, *FACTORS).count() == 0


def test_effects_without_pairs(spark, tables):
    models, evaluated, runs = tables
    want = robustness.paired_effects(robustness.one_factor_pairs(models, evaluated, *FACTORS), runs, "id", "seed", "m").collect()
    got = {tuple(r)[:3]: r for r in robustness.factor_effects(models, evaluated, runs, *FACTORS, "seed", "m").collect()}
    assert len(got) == len(want) == 18
    for w in want:
        g = got[tuple(w)[:3]]
        assert g.n_pairs == w.n_pairs and g.mean_delta == pytest.approx(w.mean_delta, abs=1e-6) and g.std_delta == pytest.approx(w.std_delta, abs=1e-6)


def test_sums_of_decimals_are_exact(spark):
    rows = [(i, i % 2, i % 2 == 0, str(v)) for i, v in enumerate(["0.1", "0.2", "0.7", "0.3", "0.9", "0.6"] * 50)]
    models = spark.createDataFrame(rows, "id int, p int, ref boolean, m string").withColumns({"q": F.lit("x"), "seed": F.lit(0), "m": F.col("m").cast("decimal(20,6)")})
    r = robustness.factor_effects(models, models, models, *FACTORS, "seed", "m").collect()
    assert [(x.factor, x.n_pairs, x.mean_delta) for x in r] == [("p", 150 * 150, -0.2)]
