"""Table contracts, numbered batches, and the sampling grid against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from prismata.operators import sampling, sampling_grid
from prismata.sources import contracts
from prismata.sources.contracts import Contract

SCHEMA = "b int, a int, k string, none string, more int"


def test_a_table_takes_its_contracts_form(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "x", None, 5), (None, 3, "y", None, 6)], SCHEMA)
    c = Contract(("k", "a", "none", "b", "lost"), ("k",))
    assert contracts.conform(df, c).columns == ["k", "a", "b"]
    assert contracts.conform(df, c, remaining=True, drop_empty=False).columns == ["k", "a", "none", "b", "more"]
    assert contracts.conform(df, Contract(key=("none",), unique=False)).columns == df.columns
    assert contracts.conform(df, Contract()).columns == ["b", "a", "k", "more"]
    contracts.write_table(df, str(tmp_path / "t"), c)
    back = contracts.read_table(spark, str(tmp_path / "t"), c)
    assert sorted(map(tuple, back.collect())) == [("x", 2, 1), ("y", 3, None)]
    assert contracts.conform(df.limit(0), c).columns == ["k", "a", "none", "b"]


def test_broken_contracts_are_errors(spark):
    df = spark.createDataFrame([(1, 2, None, None, 5), (1, 3, None, None, 6)], SCHEMA)
    with pytest.raises(ValueError, match="a key repeats"):
        contracts.conform(df, Contract(key=("k",)))
    assert contracts.conform(df, Contract(key=("k",)), check_key=False).columns == ["b", "a", "k", "more"]
    assert contracts.conform(df, Contract(key=("k", "a"))).count() == 2
    with pytest.raises(KeyError, match="missing key columns"):
        contracts.conform(df, Contract(key=("z",)))
    with pytest.raises(KeyError, match="missing columns"):
        contracts.conform(df, Contract(("a", "z")), require_all=True)
    odd = spark.createDataFrame([(1, None)], "`a.b` int, `c d` int")
    assert contracts.conform(odd, Contract(("c d", "a.b"), ("a.b",))).columns == ["a.b"]


@pytest.mark.parametrize("size", [1, 7, 100])
def test_batches_are_runs_of_the_whole_table(spark, size):
    values = random.Random(1).sample(range(1000), 53)
    df = spark.createDataFrame([(v, v % 3) for v in values], "v int, g int").repartition(5)
    got = contracts.numbered_batches(df, ["g", "v"], size).collect()
    line = sorted(values, key=lambda v: (v % 3, v))
    for r in got:
        at = line.index(r.v)
        start = at // size * size
        assert (r.row_start, r.row_stop, r.batch_id) == (start, min(start + size, 53), f"batch_{start // size + 1:04d}")
    assert len(got) == 53 and contracts.numbered_batches(df.limit(0), ["v"], 5).count() == 0


def test_columns_with_few_values(spark):
    df = spark.createDataFrame([("a", str(i), None, i) for i in range(10)], "x string, y string, z string, n int")
    assert contracts.category_columns(df) == ["x", "z"] and contracts.category_columns(df.select("n")) == []


@pytest.mark.parametrize("policy", ["short", "exclude", "error"])
def test_grid_equals_draws_one_by_one(spark, policy):
    rng = random.Random(4)
    rows, n = [], 0
    for o in range(9):
        for _ in range(rng.randrange(2, 12)):
            rows.append((n, f"o{o}", "ab"[o % 2], f"i{o // 3}", rng.randrange(9), rng.randrange(9), [1.0, float("nan") if n % 13 == 5 else 2.0]))
            n += 1
    df = spark.createDataFrame(rows, "vec_id int, object string, class string, image string, row int, col int, spectrum array<double>")
    seeds, sizes = [3, 4, 5], [2, 5, 8]
    got = {(r.m, r.strategy): r for r in sampling_grid.feasibility(df, ["object"], "class", "image", "vec_id", sizes, ["random", "center"], seeds, policy).collect()}
    valid = df.where("NOT isnan(spectrum[1])")
    held = {r["object"]: r["count"] for r in valid.groupBy("object").count().collect()}
    for m in sizes:
        picks = {}
        for s in seeds:
            drawn = sampling.draw(valid, ["object"], m, [sampling.hash_order(F.lit(s), "object", "vec_id"), "vec_id"], "short" if policy == "short" else "exclude")
            for r in drawn.collect():
                picks.setdefault(s, {}).setdefault(r["object"], set()).add(r.vec_id)
        each = [len(picks[a][o] & picks[b][o]) / len(picks[a][o] | picks[b][o]) for a, b in itertools.combinations(seeds, 2) if a in picks and b in picks for o in set(picks[a]) & set(picks[b])]
        r = got[m, "random"]
        short = sum(k < m for k in held.values())
        assert (r.n_objects_total, r.n_objects_under_m) == (9, short) and r.eligible_rate == pytest.approx(1 - short / 9)
        assert r.n_rows == sum(map(len, picks.get(3, {}).values())) and (r.selection_stability == pytest.approx(sum(each) / len(each)) if each else r.selection_stability is None)
        per = {}
        for o, s in picks.get(3, {}).items():
            per["ab"[int(o[1:]) % 2]] = per.get("ab"[int(o[1:]) % 2], 0) + len(s)
        assert r.n_classes == len(per) and (r.class_balance_ratio == pytest.approx(min(per.values()) / max(per.values())) if per else r.class_balance_ratio is None)
        assert got[m, "center"].selection_stability in (None, 1.0) and got[m, "center"].n_rows == r.n_rows
        assert r.status == ("invalid" if r.n_rows == 0 or (policy == "error" and short) else "warning" if r.eligible_rate < 0.9 else "accepted")
