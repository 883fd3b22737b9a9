"""Feasibility and seed stability of balanced pixel sampling, for all sizes, strategies and seeds in one plan.

A selection of m pixels is the first m of an order, so one ranking per strategy and seed serves every m, and whether two
seeds pick the same pixels is a count of pixels that both rank low enough: no selection is gathered.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismata.functions import spectra as sp
from prismata.operators.sampling import centre_distance, hash_order
from prismata.plans.shared import materialize

STRATEGIES = ("random", "center")


def _ranks(pixels: DataFrame, item: list[str], pixel: str, strategy: str, seeds: list[int], most: int) -> DataFrame:
    """``r0, r1, ...``: the rank of a pixel in its object under each seed; pixels that no seed ranks up to ``most`` go. All
    seeds rank in one exchange by object."""
    w = Window.partitionBy(*item)
    if strategy == "center":
        df = centre_distance(pixels, item)
        df = df.withColumn("r0", F.row_number().over(w.orderBy("centre_distance", pixel)))
        df = df.withColumns({f"r{i}": F.col("r0") for i in range(1, len(seeds))}) if len(seeds) > 1 else df
    else:
        df = pixels.withColumns({f"r{i}": F.row_number().over(w.orderBy(hash_order(F.lit(s), *item, pixel), pixel)) for i, s in enumerate(seeds)})
    names = [F.col(f"r{i}") for i in range(len(seeds))]
    return df.where((F.least(*names) if len(names) > 1 else names[0]) <= most)


def feasibility(pixels: DataFrame, item: list[str], label: str, image: str, pixel: str, sizes: list[int], strategies: list[str], seeds: list[int], policy: str = "short", least: float = 0.9, spectrum: str = "spectrum") -> DataFrame:
    """A row per m and strategy over the valid pixels of each object: objects and those with fewer than m pixels, share that
    reaches m, rows drawn, classes and images with rows and their balance, ``selection_stability`` (mean Jaccard of an object's
    pixels under two seeds, NULL for one seed), and ``status``: invalid without a row or with the policy ``error`` and an object
    that is short, warning where fewer than ``least`` reach m, accepted otherwise. Objects with fewer pixels give what they
    have (``short``) or nothing (``exclude``)."""
    if policy not in ("short", "exclude", "error") or set(strategies) - set(STRATEGIES):
        raise ValueError("unknown policy or strategy")
    objects = pixels.groupBy(*item).agg(F.min(label).alias("_label"), F.min(image).alias("_image"), F.count_if(sp.validity_reason(F.col(spectrum)) == "valid").alias("_n"))
    objects = materialize(objects, "sampled-objects")
    ms = F.explode(F.array(*map(F.lit, sizes))).alias("m")
    per = objects.select("*", ms).withColumn("_short", F.col("_n") < F.col("m"))
    take = F.least("_n", "m") if policy == "short" else F.when(F.col("_short"), 0).otherwise(F.col("m"))
    per = per.withColumn("_take", take)
    base = per.groupBy("m").agg(F.count("*").alias("n_objects_total"), F.count_if("_short").alias("n_objects_under_m"), F.avg((~F.col("_short")).cast("double")).alias("eligible_rate"), F.sum("_take").alias("n_rows"))
    for name, column in (("class", "_label"), ("image", "_image")):
        cells = per.groupBy("m", column).agg(F.sum("_take").alias("k")).where("k > 0").groupBy("m").agg(F.count("*").alias(f"n_{name}{'e' if name == 'class' else ''}s"), (F.min("k") / F.max("k")).alias(f"{name}_balance_ratio"))
        base = base.join(cells, "m", "left")
    valid = pixels.where(sp.validity_reason(F.col(spectrum)) == "valid").select(*dict.fromkeys([*item, pixel, "row", "col"]))
    pairs = list(combinations(range(len(seeds)), 2))
    parts = []
    for strategy in strategies:
        ranks = _ranks(valid, item, pixel, strategy, seeds, max(sizes))
        both = [F.count_if((F.col(f"r{a}") <= m) & (F.col(f"r{b}") <= m)).alias(f"c{j}_{m}") for j, (a, b) in enumerate(pairs) for m in sizes]
        if both:
            shared = ranks.groupBy(*item).agg(F.count_if(F.col("r0") <= F.lit(max(sizes))).alias("_held"), *both)
            cells = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"c{j}_{m}").alias("c")) for j in range(len(pairs)) for m in sizes])).alias("x")
            long = shared.select("_held", cells).select("_held", "x.*").withColumn("_size", F.least("_held", "m"))
            if policy != "short":
                long = long.where(F.col("_held") >= F.col("m"))
            stable = long.where("_size > 0").groupBy("m").agg(F.avg(F.col("c") / (2 * F.col("_size") - F.col("c"))).alias("selection_stability"))
        else:
            stable = pixels.sparkSession.createDataFrame([], "m int, selection_stability double")
        parts.append(base.join(stable, "m", "left").withColumn("strategy", F.lit(strategy)))
    out = reduce(DataFrame.unionByName, parts).fillna(0, ["n_classes", "n_images"])
    broken = (F.col("n_rows") == 0) | (F.lit(policy == "error") & (F.col("n_objects_under_m") > 0))
    return out.withColumn("status", F.when(broken, "invalid").when(F.col("eligible_rate") < least, "warning").otherwise("accepted"))
