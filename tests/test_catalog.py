"""Edge cases of grids, registries, policy choice and thresholds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_join_once_matches_null_keys_and_rejects_repeats(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k int, t int")
    assert rows(catalog.join_once(left, right, ["k"])) == [(1, "x", 10), (None, "y", 20)]
    with pytest.raises(Exception, match="repeated key"):
        catalog.join_once(left, right.union(right), ["k"]).collect()
    with pytest.raises(Exception, match="no value"):
        catalog.join_covered(left, right, ["k"], "t").collect()


def test_policy_stages_name_where_a_candidate_fell(spark):
    df = spark.createDataFrame([(1, None, 5, 0.1), (2, None, None, 0.1), (3, None, 5, None), (4, None, 6, 0.1), (5, None, 9, 0.1), (6, None, 6, 0.1)], "id int, g string, n int, m double")
    got = catalog.select_policies(df, ["g"], F.col("n") > 0, [("m", F.col("m") < 1)], [("n", True, 1)], "id")
    assert rows(got.select("id", "stage")) == [(1, "selected"), (2, "incomplete"), (3, "limit:m"), (4, "tie_break"), (5, "plateau:n"), (6, "tie_break")]


def test_acceptability_of_missing_repeated_and_nan(spark):
    configs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "c string")
    stored = spark.createDataFrame([("a", 0.1), ("b", 0.1), ("b", 0.2), ("d", float("nan")), ("e", 0.9)], "c string, fn double")
    got = rows(catalog.acceptability(configs, stored, "c", {"fn": (None, 0.5)}).select("c", "status"))
    assert got == [("a", "acceptable"), ("b", "duplicated"), ("c", "missing"), ("d", "technical_invalid"), ("e", "calculable_but_not_acceptable")]


def test_paired_plan_without_a_reference(spark):
    df = spark.createDataFrame([(1, "sg", 3), (2, "raw", 3), (3, "raw", None), (4, "sg", None), (5, "sg", 8)], "id int, chain string, k int")
    assert rows(catalog.paired_plan(df, "id", "chain", "raw", ["k"])) == [(1, "sg", 2, "planned"), (4, "sg", 3, "planned"), (5, "sg", None, "not_estimable")]


def test_area_classes_are_complete(spark):
    df = spark.createDataFrame([("i", 3, True, 0.5), ("i", 4, False, 0.1)], "image string, area int, hit boolean, iou double")
    got = rows(catalog.area_classes(df, ["image"], "area", "hit", "iou", [2], ["small", "large"]))
    assert got == [("i", "large", 2, 1, 0.5, pytest.approx(0.3), True), ("i", "small", 0, 0, None, None, False)]


def test_otsu_equals_exhaustive_search(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.2, 0.05, 300), rng.normal(0.8, 0.1, 200)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("flat", 0.5), ("flat", 0.5), ("flat", None), ("flat", float("nan"))], "image string, v double")
    n, edges = np.histogram(x, 256)
    at = np.arange(256)
    gaps = [n[: i + 1].sum() * n[i + 1 :].sum() * ((n * at)[: i + 1].sum() / n[: i + 1].sum() - (n * at)[i + 1 :].sum() / n[i + 1 :].sum()) ** 2 for i in range(255)]
    centre = (edges[:-1] + edges[1:])[int(np.argmax(gaps))] / 2
    got = dict(rows(catalog.otsu(df, "image", "v")))
    assert got["a"] == pytest.approx(centre) and got["flat"] == 0.5
    assert catalog.threshold_mask(df, "image", "v", 0.6).where("in_mask").count() == int((x > max(centre, 0.6)).sum())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "image string, v double")
    assert catalog.otsu(empty, "image", "v").count() == 0
    assert catalog.position_check(empty, "image", "v").count() == 0
    assert catalog.additional_seeds(empty, "image", F.lit(True), [1], empty.withColumnRenamed("v", "seed")).count() == 0


def test_hole_filling_keeps_open_background(spark):
    from prismata.operators import raster

    art = ["......", ".###..", ".#.###", ".###.#", "...###", "#.#..."]  # two holes, the second touching the first only at a corner
    within = spark.createDataFrame([("i", r, c) for r in range(6) for c in range(6)], "image string, row int, col int")
    mask = spark.createDataFrame([("i", r, c) for r, line in enumerate(art) for c, x in enumerate(line) if x == "#"], "image string, row int, col int")
    added = raster.fill_holes(mask, within).exceptAll(mask)
    assert rows(added.select("row", "col")) == [(2, 2), (3, 4)]
    cleaned = raster.clean_mask(mask, within, least=5, closing_radius=0)
    assert cleaned.count() == mask.count() + 2 - 2


def test_reference_audit_names_what_one_side_lacks(spark):
    a = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.5)], "k int, m double")
    b = spark.createDataFrame([(1, 0.6), (2, None), (4, 0.5)], "k int, m double")
    assert rows(catalog.reference_audit(a, b, ["k"], ["m"]).select("k", "status")) == [(1, "differs"), (2, "equal"), (3, "not_rebuilt"), (4, "not_stored")]
