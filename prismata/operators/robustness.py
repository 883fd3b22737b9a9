"""How choices hold when seeds, thresholds, images or factors change. Limits, deltas and factors are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators.selection import pareto_front
from prismata.plans.nulls import join_same

SPREAD = 64


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b, strict=True)])


def _deviation_in_order(value: str, order: str) -> Column:
    """Welford's sample deviation of the values that are not NULL, in ascending order of a key."""
    x = F.col(value).cast("double")
    runs = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(F.col(order).alias("o"), x.alias("x")))))

    def add(a: Column, r: Column) -> Column:
        mean = a["mean"] + (r["x"] - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["m2"] + (r["x"] - mean) * (r["x"] - a["mean"])).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(runs, start, add, lambda a: F.when(a["n"] > 1, F.sqrt(a["m2"] / F.greatest(a["n"] - 1, F.lit(1.0)))))


def stability_status(runs: DataFrame, model: str, seed: str, metrics: dict[str, tuple[float, bool]], expected: int, order: str | None = None) -> DataFrame:
    """Per model: ``missing_seed``, ``deterministic`` (no metric varies), ``unstable_blocking`` (a blocking metric's standard deviation is
    above its limit), ``robust_with_supporting_warnings`` (only others are) or ``robust``; ``metrics`` names limit and
    whether it blocks. A deviation that equals its limit but for rounding is on the one or the other side by the order of the runs; with
    ``order``, a unique key, it is theirs in this order however the table is split (the runs of one model are then one array)."""
    deviation = lambda m: _deviation_in_order(m, order) if order else F.stddev_samp(m)
    stats = runs.groupBy(model).agg(F.count_distinct(seed).alias("n_seeds"), *[x for m in metrics for x in (deviation(m).alias(f"{m}_std"), (F.max(m) - F.min(m)).alias(f"{m}_range"))])
    over = lambda blocks: reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{m}_std") > limit, F.lit(False)) for m, (limit, b) in metrics.items() if b == blocks] or [F.lit(False)])
    still = reduce(lambda a, b: a & b, [F.col(f"{m}_range") == 0 for m in metrics])
    return stats.withColumn("status", F.when(F.col("n_seeds") < expected, "missing_seed").when(still, "deterministic").when(over(True), "unstable_blocking").when(over(False), "robust_with_supporting_warnings").otherwise("robust"))


def threshold_plan(thresholds: DataFrame, key: str, shifts: list[float], widths: list[float]) -> DataFrame:
    """Variants of a (lower, upper) pair: the centre moved by a fraction of the width, and the width scaled; votes stay in
    [0, 1]. ``status``: estimable, no_effect (the pair stays) or invalid (lower is not below upper)."""
    kinds = [("centre_shift", x) for x in shifts] + [("width_scale", x) for x in widths]
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(x)).alias("amount")) for k, x in kinds])).alias("v")
    df = thresholds.select(key, "lower", "upper", v).select(key, "lower", "upper", "v.*")
    width, centre = F.col("upper") - F.col("lower"), (F.col("upper") + F.col("lower")) / 2
    lo = F.when(F.col("kind") == "centre_shift", F.col("lower") + F.col("amount") * width).otherwise(centre - F.col("amount") * width / 2)
    hi = F.when(F.col("kind") == "centre_shift", F.col("upper") + F.col("amount") * width).otherwise(centre + F.col("amount") * width / 2)
    df = df.withColumns({"new_lower": lo, "new_upper": hi})
    return df.withColumn("status", F.when(~(F.col("new_lower") < F.col("new_upper")), "invalid").when((F.abs(F.col("new_lower") - F.col("lower")) < 1e-12) & (F.abs(F.col("new_upper") - F.col("upper")) < 1e-12), "no_effect").otherwise("estimable"))


def threshold_sensitivity(predictions: DataFrame, plan: DataFrame, key: str, score: str) -> DataFrame:
    """Miss and false accept rates of every estimable variant and their differences from the pair itself."""
    base = plan.select(key, F.lit("base").alias("kind"), F.lit(0.0).alias("amount"), F.col("lower").alias("new_lower"), F.col("upper").alias("new_upper")).distinct()
    every = plan.where("status = 'estimable'").select(key, "kind", "amount", "new_lower", "new_upper").unionByName(base)
    # scores are counted first, so that variants multiply distinct values, not rows
    counted = predictions.groupBy(key, score, "truth").agg(F.count("*").alias("n"))
    df = counted.join(every, key)
    t, s = F.col("truth"), F.col(score)
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rate = df.groupBy(key, "kind", "amount").agg(F.try_divide(n(t & (s < F.col("new_lower"))), n(t)).alias("miss_rate"), F.try_divide(n(~t & (s >= F.col("new_upper"))), n(~t)).alias("false_accept_rate"), F.try_divide(n((s >= F.col("new_lower")) & (s < F.col("new_upper"))), F.sum("n")).alias("uncertain_rate"))
    b = rate.where("kind = 'base'").select(F.col(key).alias("_k"), F.col("miss_rate").alias("_m"), F.col("false_accept_rate").alias("_f"))
    return rate.where("kind <> 'base'").join(b, F.col(key) == F.col("_k")).withColumns({"miss_delta": F.col("miss_rate") - F.col("_m"), "false_accept_delta": F.col("false_accept_rate") - F.col("_f")}).drop("_k", "_m", "_f")


def threshold_drift(seeds: DataFrame, model: str, policy: str, warn: float) -> DataFrame:
    """Per model mean, deviation and range over seeds of lower, upper, centre and width; more than one policy is drift,
    a range above ``warn`` a warning."""
    df = seeds.withColumns({"centre": (F.col("lower") + F.col("upper")) / 2, "width": F.col("upper") - F.col("lower")})
    names = ["lower", "upper", "centre", "width"]
    out = df.groupBy(model).agg(F.count_distinct(policy).alias("n_policies"), *[x for c in names for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), (F.max(c) - F.min(c)).alias(f"{c}_range"))])
    worst = F.greatest(*[F.col(f"{c}_range") for c in names])
    return out.withColumn("status", F.when(F.col("n_policies") > 1, "policy_drift").when(worst > warn, "warning").otherwise("stable"))


def _means_without(runs: DataFrame, track: str, model: str, seed: str, stochastic: str, seeds: list[int], metrics: list[str], order: str | None) -> DataFrame:
    """Per track and model the means of the metrics over all runs (``omitted`` is -1) and without each seed of the stochastic models.
    With ``order``, a unique key, each sum is that of the runs in this order, however the table is split."""
    if order is None:
        grid = runs.withColumn("omitted", F.explode(F.array(*[F.lit(x) for x in [-1, *seeds]])))
        kept = grid.where(~F.col(stochastic) | (F.col(seed) != F.col("omitted")))
        return kept.groupBy("omitted", track, model).agg(*[F.avg(m).alias(m) for m in metrics])
    after = Window.partitionBy(track, model).orderBy(order)
    line = after.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = []
    for i, o in enumerate([-1, *seeds]):
        keep = ~F.col(stochastic) | (F.col(seed) != o)
        values = [F.when(keep, F.col(m).cast("double")) for m in metrics]
        sums.append(F.struct(F.lit(o).alias("omitted"), F.count(F.when(keep, 1)).over(line).alias("n"), *[x for m, v in zip(metrics, values, strict=True) for x in (F.sum(v).over(line).alias(f"s_{m}"), F.count(v).over(line).alias(f"n_{m}"))]).alias(f"_{i}"))
    # running sums add in order and hold no array of runs; a model's last run has them all
    last = runs.select(track, model, *sums, F.lead(F.lit(True)).over(after).alias("_next")).where("_next IS NULL")
    out = last.select(track, model, F.explode(F.array(*[f"_{i}" for i in range(len(sums))])).alias("x")).where("x.n > 0")
    return out.select("x.omitted", track, model, *[F.when(F.col(f"x.n_{m}") > 0, F.col(f"x.s_{m}") / F.col(f"x.n_{m}")).alias(m) for m in metrics])


def front_jackknife(runs: DataFrame, track: str, model: str, seed: str, stochastic: str, seeds: list[int], metrics: list[str], order: str | None = None) -> DataFrame:
    """Each base seed left out of the stochastic models in turn: how often a model is on its track's front, and
    stable_member, stable_non_member or membership_sensitive; ``reference`` says whether it is with all seeds. Means that are equal
    but for rounding dominate or not by the order of the runs; with ``order``, a unique key, they are theirs in this order."""
    means = _means_without(runs, track, model, seed, stochastic, seeds, metrics, order)
    front = pareto_front(means, ["omitted", track], metrics).select(F.col("omitted").alias("_o"), F.col(track).alias("_t"), F.col(model).alias("_m"))
    told = means.join(front, _same(["omitted", track, model], ["_o", "_t", "_m"]), "left").withColumn("on", F.col("_m").isNotNull())
    out = told.groupBy(track, model).agg(F.max(F.when(F.col("omitted") == -1, F.col("on"))).alias("reference"), F.avg(F.when(F.col("omitted") != -1, F.col("on").cast("double"))).alias("frequency"))
    return out.withColumn("status", F.when(F.col("frequency") == 1, "stable_member").when(F.col("frequency") == 0, "stable_non_member").otherwise("membership_sensitive"))


def front_jaccard(runs: DataFrame, track: str, model: str, seed: str, stochastic: str, seeds: list[int], metrics: list[str], order: str | None = None) -> DataFrame:
    """Per track and omitted seed the Jaccard index of the front with that of all seeds; ``order`` as in ``front_jackknife``."""
    means = _means_without(runs, track, model, seed, stochastic, seeds, metrics, order)
    front = pareto_front(means, ["omitted", track], metrics).select("omitted", track, model)
    ref = front.where("omitted = -1").select(F.col(track).alias("_t"), F.col(model).alias("_m"))
    every = front.where("omitted <> -1")
    n_ref = ref.groupBy("_t").agg(F.count("*").alias("n_ref"))
    both = every.join(ref, _same([track, model], ["_t", "_m"]), "left").groupBy("omitted", track).agg(F.count("*").alias("n"), F.count("_m").alias("both"))
    return both.join(n_ref, F.col(track).eqNullSafe(F.col("_t"))).select(track, "omitted", (F.col("both") / (F.col("n") + F.col("n_ref") - F.col("both"))).alias("jaccard"))


def spatial_neighbours(lock: dict, grid: list[dict]) -> list[dict]:
    """Candidates that differ from the locked one in one parameter only, with the name of that parameter."""
    out = []
    for g in grid:
        differ = [k for k in lock if g[k] != lock[k]]
        if len(differ) == 1:
            out.append({**g, "factor": differ[0]})
    return out


def one_factor_pairs(models: DataFrame, evaluated: DataFrame, key: str, factors: list[str], reference: str) -> DataFrame:
    """Models that equal a reference model in all factors but one (nulls are equal): one row per pair and factor. Its rows grow with
    models times references. Models are dealt once by their key, over SPREAD tasks at least however small their table is, and stay where
    they are; the references' keys, 8 bytes each, are broadcast as arrays of equal factors. Pairs leave the join as they are found, none
    is sorted, shuffled or held."""
    n = max(SPREAD, int(models.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = evaluated.select(F.col(key).alias("_k")).repartition(n, "_k").distinct().hint("merge")  # as many as models, so not for a broadcast
    told = models.select(F.col(key).alias("alternative_id"), *factors).repartition(n, "alternative_id").join(known, F.col("alternative_id") == F.col("_k"), "left")
    told = told.withColumn("status", F.when(F.col("_k").isNotNull(), "estimable").otherwise("not_evaluated")).drop("_k")
    nulls = F.array_repeat(F.lit(None).cast(models.schema[key].dataType), F.count_if(F.col(key).isNull()).cast("int"))
    cells = models.where(F.col(reference)).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(16))).groupBy(*factors, "_block").agg(F.concat(F.collect_list(key), nulls).alias("_ids"))
    cells = F.broadcast(cells.select(*[F.col(f).alias(f"_r_{f}") for f in factors], "_ids"))
    parts = []
    for f in factors:
        rest = [c for c in factors if c != f]
        cell = told.join(cells, reduce(lambda a, b: a & b, [~F.col(f).eqNullSafe(F.col(f"_r_{f}")), *([_same(rest, [f"_r_{c}" for c in rest])] if rest else [])]))
        pair = cell.select("alternative_id", F.explode("_ids").alias("reference_id"), F.col(f"_r_{f}").cast("string").alias("reference_value"), F.col(f).cast("string").alias("alternative_value"), "status")
        parts.append(pair.select(F.lit(f).alias("factor"), "*"))
    return reduce(DataFrame.unionByName, parts)


def factor_coverage(models: DataFrame, evaluated: DataFrame, key: str, factors: list[str], reference: str) -> DataFrame:
    """``coverage_of`` the pairs of ``one_factor_pairs``, from counts per value: no pair is made. A factor without a pair has no row."""
    known = evaluated.select(F.col(key).alias("_k")).distinct()
    df = models.join(known, F.col(key) == F.col("_k"), "left")
    cells = df.groupBy(*factors).agg(F.count("*").alias("n"), F.count("_k").alias("e"), F.count_if(F.col(reference)).alias("r"))
    parts = []
    for f in factors:
        rest = [c for c in factors if c != f]
        # models times references of one rest, less those that share the value too
        out = cells.groupBy(*rest).agg(*[(F.sum(c) * F.sum("r") - F.sum(F.col(c) * F.col("r"))).alias(f"_{c}") for c in ("n", "e")])
        parts.append(out.groupBy(F.lit(f).alias("factor")).agg(F.sum("_n").alias("n_planned"), F.sum("_e").alias("n_estimable")))
    return reduce(DataFrame.unionByName, parts).where("n_planned > 0")


def factor_effects(models: DataFrame, evaluated: DataFrame, runs: DataFrame, key: str, factors: list[str], reference: str, seed: str, metric: str) -> DataFrame:
    """``paired_effects`` of the pairs of ``one_factor_pairs``, from count, mean and variance per value, rest and seed: no pair is made.
    All differences of two such cells have the difference of their means as mean, and the sum of their variances as variance.
    The sums of a decimal metric are exact."""
    known = evaluated.select(F.col(key).alias("_k")).distinct()
    x = F.col("_x")
    stats = lambda df, to: df.groupBy(*factors, "_seed").agg(F.count("*").alias("n"), F.count(x).alias("k"), F.sum(x).alias("s"), F.avg(x.cast("double")).alias("m"), F.var_pop(x.cast("double")).alias("v")).select(*[F.col(c).alias(f"{to}_{c}") for c in [*factors, "_seed", "n", "k", "s", "m", "v"]])
    r = runs.select(F.col(key).alias("_key"), F.col(seed).alias("_seed"), F.col(metric).alias("_x")).where("_seed IS NOT NULL")
    rows = models.join(r, F.col(key) == F.col("_key"))
    a, b = stats(rows.join(known, F.col(key) == F.col("_k"), "left_semi"), "a"), stats(rows.where(F.col(reference)), "b")
    parts = []
    for f in factors:
        rest = [c for c in factors if c != f]
        pair = a.join(b, _same([f"a_{c}" for c in [*rest, "_seed"]], [f"b_{c}" for c in [*rest, "_seed"]]) & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")))
        parts.append(pair.select(F.lit(f).alias("factor"), F.col(f"a_{f}").cast("string").alias("alternative_value"), F.col(f"b_{f}").cast("string").alias("reference_value"), (F.col("a_n") * F.col("b_n")).alias("n"), (F.col("a_k") * F.col("b_k")).alias("k"), (F.col("b_k") * F.col("a_s") - F.col("a_k") * F.col("b_s")).alias("s"), (F.col("a_m") - F.col("b_m")).alias("m"), (F.col("a_v") + F.col("b_v")).alias("v")))
    cells, by = reduce(DataFrame.unionByName, parts), ["factor", "alternative_value", "reference_value"]
    mean = F.try_divide(F.sum("s").cast("double"), F.sum("k"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n_pairs"), mean.alias("mean_delta"))
    # squares are taken about the mean itself, so that a large mean does not cancel their digits
    square = F.sum(F.col("k") * (F.col("v") + F.pow(F.col("m") - F.col("mean_delta"), 2)))
    return join_same(cells, total, by).groupBy(*by, "n_pairs", "mean_delta").agg(F.sqrt(F.try_divide(square, F.sum("k"))).alias("std_delta"))


def paired_effects(pairs: DataFrame, runs: DataFrame, key: str, seed: str, metric: str) -> DataFrame:
    """Per factor and alternative value the mean and deviation (ddof 0) of the differences at equal seeds."""
    a = runs.select(F.col(key).alias("alternative_id"), F.col(seed).alias("_s"), F.col(metric).alias("_a"))
    b = runs.select(F.col(key).alias("reference_id"), F.col(seed).alias("_s"), F.col(metric).alias("_b"))
    df = pairs.where("status = 'estimable'").join(a, "alternative_id").join(b, ["reference_id", "_s"]).withColumn("delta", F.col("_a") - F.col("_b"))
    return df.groupBy("factor", "alternative_value", "reference_value").agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta"))


def coverage_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("factor").agg(F.count("*").alias("n_planned"), F.count_if(F.col("status") == "estimable").alias("n_estimable"))


def practical_effects(df: DataFrame, tolerances: DataFrame, metric: str = "metric", delta: str = "delta") -> DataFrame:
    """Whether a difference is within its metric's tolerance, and which side is better (``higher_is_better``)."""
    out = join_same(df, tolerances, [metric])  # a row a metric
    better = F.when(F.col("higher_is_better"), F.col(delta)).otherwise(-F.col(delta))
    status = F.when(F.col(delta).isNull() | F.isnan(delta), "not_estimable").when(F.abs(delta) <= F.col("tolerance"), "within_tolerance").otherwise("outside_tolerance")
    return out.withColumn("effect_status", status).withColumn("direction", F.when(F.col("effect_status") != "outside_tolerance", "no_practical_difference").when(better > 0, "alternative_better").otherwise("reference_better"))


def interval_envelope(df: DataFrame, by: list[str], low: str, high: str, images: str, least_images: int) -> DataFrame:
    """Lowest low and highest high over seeds, and whether every seed has images enough."""
    out = df.groupBy(*by).agg(F.min(low).alias("envelope_low"), F.max(high).alias("envelope_high"), F.min(images).alias("n_images"), F.count("*").alias("n_seeds"))
    return out.withColumn("status", F.when(F.col("n_images") >= least_images, "descriptive").otherwise("too_few_images"))


def coverage_auc(curve: DataFrame, by: list[str], coverage: str = "coverage", risk: str = "risk", limit: float = 0.1) -> DataFrame:
    """Area under a risk-coverage curve by trapezoids, and the largest coverage whose risk is within the limit."""
    points = curve.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(coverage).cast("double").alias("c"), F.col(risk).cast("double").alias("r")))).alias("p"), F.max(F.when(F.col(risk) <= limit, F.col(coverage))).alias("coverage_at_limit"))  # a grid of coverages
    area = F.expr("aggregate(sequence(1, greatest(size(p) - 1, 1)), 0D, (a, i) -> IF(size(p) < 2, 0D, a + (p[i].c - p[i - 1].c) * (p[i].r + p[i - 1].r) / 2))")
    return points.withColumn("auc", area).drop("p")


# splits, strata, registries and reports


def role_manifest(objects: DataFrame, excluded: DataFrame, key: str, batch: str, kind: str, roles: dict[str, list[int]]) -> DataFrame:
    """An object's role by batch, mixtures apply; what is excluded has no other role."""
    role = F.when(F.col(kind) == "mixture", "application")
    for name, batches in roles.items():
        role = role.when(F.col(batch).isin(batches), name)
    gone = excluded.select(F.col(key).alias("_x")).distinct()
    return objects.join(gone, F.col(key) == F.col("_x"), "left").withColumn("role", F.when(F.col("_x").isNotNull(), "excluded").otherwise(F.coalesce(role, F.lit("unknown")))).drop("_x")


def fold_diagnostics(df: DataFrame, fold: str, label: str, group: str, item: str, size: str) -> DataFrame:
    """A row for every fold and class, also where the class is missing: objects, groups, median size."""
    every = df.select(fold).distinct().crossJoin(F.broadcast(df.select(label).distinct()))  # folds x classes
    counts = df.groupBy(F.col(fold).alias("_f"), F.col(label).alias("_l")).agg(F.count_distinct(item).alias("n_objects"), F.count_distinct(group).alias("n_groups"), F.percentile(size, 0.5).alias("median_size"))
    out = every.join(counts, _same([fold, label], ["_f", "_l"]), "left")
    return out.select(fold, label, F.coalesce("n_objects", F.lit(0)).alias("n_objects"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), "median_size").withColumn("covered", F.col("n_objects") > 0)


def partition_signatures(assignments: DataFrame, candidate: str, fold: str, group: str) -> DataFrame:
    """Candidates of equal partitions, whatever their folds are called, share a signature; the smallest represents it. A fold is
    known by its sorted groups (images)."""
    folds = assignments.groupBy(candidate, fold).agg(F.array_join(F.array_sort(F.collect_set(F.col(group).cast("string"))), ",").alias("g"))
    sig = folds.groupBy(candidate).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("g")), "|"), 256).alias("signature"))
    return sig.join(sig.groupBy("signature").agg(F.min(candidate).alias("representative"), F.count("*").alias("n_same")), "signature")


def stratified_shift(train: DataFrame, projected: DataFrame, key: str, value: str, strata: dict[str, str], least: int = 5) -> DataFrame:
    """z-scores of projected rows against their key's train mean and deviation, averaged per stratum; an infinite z (no
    deviation) makes its stratum infinite, a stratum of fewer than ``least`` rows is not estimable."""
    ref = train.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    gap = F.col(value) - F.col("_m")
    z = F.when(F.col("_s") > 0, gap / F.nullif("_s", F.lit(0.0))).when(gap == 0, 0.0).when(gap > 0, float("inf")).otherwise(float("-inf"))
    cells = F.explode(F.array(F.struct(F.lit("overall").alias("stratum"), F.lit("all").alias("level")), *[F.struct(F.lit(n).alias("stratum"), F.col(c).cast("string").alias("level")) for n, c in strata.items()])).alias("x")
    df = join_same(projected, ref, [key]).withColumn("z", z).select(key, "z", cells).select(key, "z", "x.*")
    out = df.groupBy(key, "stratum", "level").agg(F.count("z").alias("n"), F.avg(F.when(F.abs("z") < float("inf"), F.col("z"))).alias("_z"), F.max(F.when(F.col("z") == float("inf"), 1).otherwise(0)).alias("_up"), F.max(F.when(F.col("z") == float("-inf"), 1).otherwise(0)).alias("_down"))
    mean = F.when((F.col("_up") == 1) & (F.col("_down") == 1), float("nan")).when(F.col("_up") == 1, float("inf")).when(F.col("_down") == 1, float("-inf")).otherwise(F.col("_z"))
    return out.withColumns({"mean_z": mean, "status": F.when(F.col("n") < least, "not_estimable").otherwise("estimable")}).drop("_z", "_up", "_down")


def track_eligibility(shift: DataFrame, tracks: DataFrame, track: str, value: str, warn: float = 1.5, unsupported: float = 3.0) -> DataFrame:
    """Every track with its worst absolute shift and status; a track without diagnostics is not supported either."""
    worst = shift.groupBy(F.col(track).alias("_t")).agg(F.max(F.abs(value)).alias("worst"))
    out = tracks.select(track).distinct().join(worst, F.col(track).eqNullSafe(F.col("_t")), "left").drop("_t")
    return out.withColumn("status", F.when(F.col("worst").isNull(), "unsupported_missing_diagnostics").when(F.col("worst") > unsupported, "unsupported").when(F.col("worst") > warn, "warning").otherwise("eligible"))


def expand_projections(fits: DataFrame, contracts: DataFrame, family: str, fit_id: str) -> DataFrame:
    """Each fit with every track of its family, and ids of the projection (fit and level) and the evaluation (and mode)."""
    df = join_same(fits, contracts, [family])  # tracks are a table of the protocol
    ident = lambda prefix, cols: F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 20))
    return df.withColumns({"projection_id": ident("prj_", [fit_id, "projection_level"]), "evaluation_id": ident("evl_", [fit_id, "projection_level", "decision_mode"])})


def restored_configs(chosen: DataFrame, panel: DataFrame, thresholds: DataFrame, key: str, track: str, order: list, per_track: int) -> DataFrame:
    """Chosen models with their panel columns and thresholds, the first of each track in review order; a model that the panel or
    the thresholds lack is an error."""
    p = panel.withColumn("_in", F.lit(True))
    t = thresholds.select(key, "lower", "upper")
    df = chosen.select(key).join(p, key, "left").join(t, key, "left")
    fault = F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("not in the panel: "), F.col(key).cast("string")))).when(F.col("lower").isNull(), F.raise_error(F.concat(F.lit("no threshold: "), F.col(key).cast("string"))))
    df = df.withColumn("lower", F.coalesce(fault.cast("double"), F.col("lower"))).drop("_in")
    return df.withColumn("review_order", F.row_number().over(Window.partitionBy(track).orderBy(*order))).where(F.col("review_order") <= per_track)


def inventory(images: DataFrame, kind: str, batch: str, objects: str) -> DataFrame:
    return images.groupBy(kind, batch).agg(F.count("*").alias("n_images"), F.sum(objects).alias("n_objects"), F.min(objects).alias("least_objects"), F.max(objects).alias("most_objects"))


def value_rates(df: DataFrame, track: str, parameters: list[str]) -> DataFrame:
    """How often each value of a parameter occurs among a track's configurations, as counts and rates."""
    long = df.select(track, *[F.col(p).cast("string").alias(p) for p in parameters]).unpivot([track], parameters, "parameter", "value")
    counts = long.groupBy(track, "parameter", "value").agg(F.count("*").alias("n"))
    total = df.groupBy(F.col(track).alias("_t")).agg(F.count("*").alias("_n"))
    return counts.join(total, F.col(track).eqNullSafe(F.col("_t"))).select(track, "parameter", "value", "n", (F.col("n") / F.col("_n")).alias("rate"))


def held_out_report(decided: DataFrame, track: str, image: str, item: str, truth: str = "truth", decision: str = "decision") -> DataFrame:
    """Per track: pooled three-way rates on objects, and of its images how many have a miss; one pass over the votes."""
    t, d = F.col(truth), F.col(decision)
    per = decided.groupBy(track, image).agg(F.count("*").alias("n"), F.count_if(t).alias("n_t"), F.count_if(t & (d == "non_target")).alias("miss"), F.count_if(~t & (d == "target")).alias("false"), F.count_if(d == "uncertain").alias("un"))
    return per.groupBy(track).agg(F.sum("n").alias("n_objects"), F.try_divide(F.sum("miss"), F.sum("n_t")).alias("miss_rate"), F.try_divide(F.sum("false"), F.sum(F.col("n") - F.col("n_t"))).alias("false_accept_rate"), F.try_divide(F.sum("un"), F.sum("n")).alias("uncertain_rate"), F.count_if(F.col("miss") > 0).alias("n_images_with_miss"), F.count("*").alias("n_images"))


def object_counts(decided: DataFrame, image: str, truth: str = "truth", decision: str = "decision") -> DataFrame:
    t, d = F.col(truth), F.col(decision)
    return decided.groupBy(image).agg(F.count_if(t).alias("true_target"), F.count_if(~t).alias("true_other"), F.count_if(d == "target").alias("predicted_target"), F.count_if(d == "non_target").alias("predicted_other"), F.count_if(d == "uncertain").alias("predicted_uncertain")).withColumn("target_count_error", F.col("predicted_target") - F.col("true_target"))


def stage_comparison(stages: dict[str, DataFrame], by: str, metrics: list[str]) -> DataFrame:
    """Long table of the same metrics at several stages."""
    return reduce(DataFrame.unionByName, [df.select(by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([by], metrics, "metric", "value").withColumn("stage", F.lit(n)) for n, df in stages.items()])


# quality of images and objects


def image_quality(images: DataFrame, least_valid: float = 0.99) -> DataFrame:
    """``images`` with height, width, n_values, n_bad, axis_ok, mask_pixels, n_objects, n_labels: excluded with the first
    fatal reason, warning where labels and objects differ, or accepted."""
    fatal = F.when((F.col("height") < 1) | (F.col("width") < 1), "bad_dimensions").when(F.try_divide(F.col("n_values") - F.col("n_bad"), F.col("n_values")) < least_valid, "invalid_values").when(~F.col("axis_ok"), "axis_differs").when(F.col("mask_pixels") == 0, "empty_mask")
    return images.withColumns({"exclusion_reason": fatal, "qc_status": F.when(fatal.isNotNull(), "excluded").when(F.col("n_objects") != F.col("n_labels"), "warning").otherwise("accepted")})


def segmentation_diagnostics(pixels: DataFrame, item: str, least: int, merged_above: float, margin: int = 0) -> DataFrame:
    """Geometry of each object: box, fill ratio, whether it touches its image's border, is too small, or so much larger
    than its image's median that objects may be merged."""
    frame = pixels.groupBy("image").agg(F.min("row").alias("R0"), F.max("row").alias("R1"), F.min("col").alias("C0"), F.max("col").alias("C1"))
    o = pixels.where(F.col(item).isNotNull()).groupBy("image", item).agg(F.count("*").alias("area"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    med = o.groupBy("image").agg(F.percentile("area", 0.5).alias("median_area"))
    o = join_same(join_same(o, frame, ["image"]), med, ["image"])
    touches = (F.col("min_row") <= F.col("R0") + margin) | (F.col("max_row") >= F.col("R1") - margin) | (F.col("min_col") <= F.col("C0") + margin) | (F.col("max_col") >= F.col("C1") - margin)
    fill = F.col("area") / ((F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1))
    return o.withColumns({"fill_ratio": fill, "touches_border": touches, "too_small": F.col("area") < least, "maybe_merged": F.col("area") > merged_above * F.col("median_area")}).drop("R0", "R1", "C0", "C1")


def object_quality(segmented: DataFrame, invalid_pixels: DataFrame, item: str) -> DataFrame:
    """Geometry joined with the number of invalid pixels: excluded (no valid pixel), warning (small, merged, at the border or
    with invalid pixels) or accepted."""
    df = join_same(segmented, invalid_pixels, ["image", item], "left").fillna(0, ["n_invalid"])
    return df.withColumn("qc_status", F.when(F.col("n_invalid") >= F.col("area"), "excluded").when(F.col("too_small") | F.col("maybe_merged") | F.col("touches_border") | (F.col("n_invalid") > 0), "warning").otherwise("accepted"))


def shape_check(objects: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Declared pixel and band numbers against what the parts hold: ``parts`` has key, n_pixels, n_bands, n_positions."""
    df = objects.join(parts.withColumnsRenamed({c: f"_{c}" for c in parts.columns if c != key}), key, "left")
    fault = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("n_pixels", "n_bands")], F.when(~F.col("_n_positions").eqNullSafe(F.col("_n_pixels")), F.lit("positions")))
    return df.select(key, fault.alias("faults")).withColumn("consistent", F.col("faults") == "")
