"""Greedy collapse of candidates with equal outputs that differ in few parameters.

In order, a candidate that is still there drops every later one of equal outputs that differs from it in one to ``most`` of the
varied parameters; what is dropped drops nothing, and rows equal in all parameters do not drop each other.

Rows that differ in at most ``most`` parameters are equal in all others, so they share a key: the outputs and the parameters
without some set of ``most``. In such a bucket all unlike rows are neighbours, and no pair has to be made: a row needs to
know only the first row of each kind in its buckets that is unlike itself, which are the first two unlike rows of a bucket.
A round decides every row whose earlier neighbours are decided; rounds follow the longest chain of rows that wait for each
other.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.plans.nulls import join_same
from prismata.plans.shared import materialize


def _text(columns: list[str]) -> F.Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("")


def _first_two(buckets: DataFrame, name: str) -> DataFrame:
    """Per key the first row (``_o`` its place, ``_v`` its parameters), and the place of the first unlike it."""
    per = buckets.groupBy("_k", "_v").agg(F.min("_o").alias("_o"))
    one = per.groupBy("_k").agg(F.min(F.struct("_o", "_v")).alias("_1"))
    two = per.join(one, "_k").where(F.col("_v") != F.col("_1._v")).groupBy("_k").agg(F.min("_o").alias("_2"))
    return one.join(two, "_k", "left").select("_k", F.struct("_1", "_2").alias(name))


def _unlike(name: str) -> F.Column:
    return F.when(F.col(f"{name}._1._v") == F.col("_v"), F.col(f"{name}._2")).otherwise(F.col(f"{name}._1._o"))


def collapse(df: DataFrame, key: str, outputs: list[str], varied: list[str], order: list[str], most: int = 1, digits: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(kept, dropped, summary)``. ``kept`` are rows of ``df``; ``dropped`` has key, ``representative`` and the
    ``varied_columns`` (sorted, comma-joined) of each dropped row; ``summary`` a row per representative that dropped any:
    number of candidates with itself, and all columns that vary. ``order`` must be unique; ``outputs`` of type double are
    compared on ``digits`` digits, and NULL equals NULL."""
    if most < 1:
        raise ValueError("at least one column varies")
    kinds = dict(df.dtypes)
    same = [F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in outputs]
    rows = df.select(F.struct(*order).alias("_o"), F.struct(*same).alias("_b"), *varied)
    sets = list(combinations(varied, min(most, len(varied))))
    keys = F.array(*[F.sha2(F.concat_ws("|", F.lit(str(i)), F.to_json("_b", {"ignoreNullFields": "false"}), _text([c for c in varied if c not in s])), 256) for i, s in enumerate(sets)])
    buckets = materialize(rows.select("_o", _text(varied).alias("_v"), F.explode(keys).alias("_k")), "variant-keys")
    state = materialize(buckets.select("_o").distinct().withColumn("_leads", F.lit(None).cast("boolean")), "variant-state")
    while not state.where("_leads IS NULL").isEmpty():
        now = buckets.join(state, "_o")
        open_ = now.where("_leads IS NULL").drop("_leads")
        met = open_.join(_first_two(now.where("_leads"), "_lead"), "_k", "left").join(_first_two(open_, "_open"), "_k", "left")
        told = met.groupBy("_o").agg(F.min(_unlike("_lead")).alias("_led"), F.min(_unlike("_open")).alias("_waits"))
        verdict = F.when(F.col("_led") < F.col("_o"), False).when(F.col("_waits") < F.col("_o"), None).otherwise(True)
        state = materialize(state.where("_leads IS NOT NULL").unionByName(told.select("_o", verdict.alias("_leads"))), "variant-state")
    now = buckets.join(state, "_o")
    led = now.where("NOT _leads").join(_first_two(now.where("_leads"), "_lead"), "_k").groupBy("_o").agg(F.min(_unlike("_lead")).alias("_led"))
    named = df.withColumn("_o", F.struct(*order))
    kept = named.join(state.where("_leads"), "_o", "left_semi").drop("_o")
    mine, theirs = named.select("_o", key, *varied), named.select(F.col("_o").alias("_led"), F.col(key).alias("representative"), *[F.col(c).alias(f"_r_{c}") for c in varied])
    differs = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in varied]))), ",")
    dropped = materialize(mine.join(led, "_o").join(theirs, "_led").select(key, "representative", differs.alias("varied_columns")), "variant-dropped")
    columns = dropped.select("representative", F.explode(F.split("varied_columns", ",")).alias("c")).distinct().groupBy("representative").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("varied_columns"))
    counts = dropped.groupBy("representative").agg((F.count("*") + 1).alias("n_candidates"))
    return kept, dropped, join_same(counts, columns, ["representative"])
