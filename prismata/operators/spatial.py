"""Objects, borders, truth and agreement on pixel tables. A raster is a set of (image, row, col) rows; label rasters have
a label column besides. Everything meets in equi-joins on positions or labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators import distance, raster, runs
from prismata.plans.components import connected_components
from prismata.plans.shared import materialize

AT = raster.AT


def reference_value(spectrum: str, method: str, band: int = 0) -> Column:
    """A pixel's value in the reference image: ``max``, ``mean`` or one ``band`` of its spectrum."""
    if method == "max":
        return F.array_max(spectrum)
    if method == "mean":
        return F.aggregate(spectrum, F.lit(0.0), lambda a, x: a + x) / F.size(spectrum)
    if method == "band":
        return F.col(spectrum)[band]
    raise ValueError(method)


def extract_objects(pixels: DataFrame, label: str, least: int, spectrum: str = "spectrum") -> DataFrame:
    """One row per label of ``least`` pixels or more: id (image and number in label order), box, centroid, area, and
    band-wise mean, deviation (ddof 0) and median as arrays."""
    named = pixels.where(F.col(label).isNotNull())
    shape = named.groupBy("image", label).agg(F.count("*").alias("area"), F.avg("row").alias("centre_row"), F.avg("col").alias("centre_col"), F.min("row").alias("min_row"), F.min("col").alias("min_col"), F.max("row").alias("max_row"), F.max("col").alias("max_col")).where(F.col("area") >= least)
    number = F.row_number().over(Window.partitionBy("image").orderBy(label))  # one row an object
    shape = shape.withColumn("object_id", F.concat(F.col("image").cast("string"), F.lit("_obj"), F.lpad(number.cast("string"), 3, "0")))
    long = named.select("image", label, F.posexplode(spectrum).alias("band", "v")).groupBy("image", label, "band").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", 0.5).alias("median"))
    lists = long.groupBy("image", label).agg(F.array_sort(F.collect_list(F.struct("band", "mean", "std", "median"))).alias("b"))
    return shape.join(lists, ["image", label]).select("*", *[F.col(f"b.{c}").alias(f"{c}_spectrum") for c in ("mean", "std", "median")]).drop("b")


def border_distance(pixels: DataFrame, item: str, radius: int | None = None) -> DataFrame:
    """``distance_to_border``: from each pixel to the nearest position of its object's box that is not the object's (the
    box's own edge is no background); NULL where there is none, or, with a ``radius``, none that near."""
    found = distance.to_background(pixels, item)
    if radius is not None:
        found = found.where(F.col("distance") <= radius)
    at = ["image", item, "row", "col"]
    on = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"d.{c}")) for c in at])
    return pixels.alias("p").join(found.alias("d"), on, "left").select("p.*", F.col("d.distance").alias("distance_to_border"))


def core_flag(distance: str, width: int) -> Column:
    """Core: farther from the border than ``width``; width 0 makes every pixel core."""
    return F.lit(True) if width == 0 else F.coalesce(F.col(distance) > width, F.lit(True))


def position_key(mixture: Column) -> Column:
    """``alm<a>pea<b>`` is shown by the reference image ``pea<b>_pos<a>``."""
    k = F.regexp_replace(F.lower(F.trim(mixture)), "_sb$", "")
    return F.when(k.rlike(r"^alm\d+pea\d+$"), F.regexp_replace(k, r"^alm(\d+)pea(\d+)$", "pea$2_pos$1"))


def mixture_truth(pixels: DataFrame, references: DataFrame, radius: int) -> DataFrame:
    """Truth of mixture pixels: inside the dilated mask of the reference image that shows them; ``available`` where
    there is such an image. ``pixels(image, row, col)``, ``references(image, row, col)``."""
    wanted = pixels.withColumn("_key", position_key(F.col("image")))
    grown = raster.dilate(references, radius).select(F.col("image").alias("_key"), "row", "col", F.lit(True).alias("truth"))
    there = references.select(F.col("image").alias("_key")).distinct().withColumn("available", F.lit(True))
    out = wanted.join(there, "_key", "left").join(grown, ["_key", "row", "col"], "left")
    return out.withColumns({"available": F.coalesce("available", F.lit(False)), "truth": F.when(F.col("available"), F.coalesce("truth", F.lit(False)))}).drop("_key")


def resolve_truth(pixels: DataFrame, annotations: DataFrame, class_truth: Column, proxy: DataFrame | None = None) -> DataFrame:
    """``truth``, ``truth_source``: an accepted annotation of the pixel (that of the smallest reference_id) before the image's
    class before a mixture's proxy; none is unavailable."""
    best = annotations.groupBy(*AT).agg(F.min_by("truth", "reference_id").alias("_a"))
    df = pixels.withColumn("_c", class_truth).join(best, AT, "left")
    if proxy is not None:
        df = df.join(proxy.select(*AT, F.col("truth").alias("_m")), AT, "left")
    else:
        df = df.withColumn("_m", F.lit(None).cast("boolean"))
    source = F.when(F.col("_a").isNotNull(), "annotation").when(F.col("_c").isNotNull(), "weak_object_label").when(F.col("_m").isNotNull(), "indirect").otherwise("unavailable")
    return df.withColumns({"truth": F.coalesce("_a", "_c", "_m"), "truth_source": source}).drop("_a", "_c", "_m")


def post_process(target: DataFrame, uncertain: DataFrame, valid: DataFrame, connectivity: int = 8, operation: str = "none", radius: int = 1, least: int = 0, pixels: DataFrame | None = None) -> DataFrame:
    """The target mask after morphology, without small components. Uncertain and invalid pixels are no target before it and
    never become target. The raster of an image is all its ``pixels``, whatever its shape; without them it is the box that ends at its
    outermost valid pixels."""
    free = lambda mask: mask.join(valid.select(*AT), AT, "left_semi").join(uncertain.select(*AT), AT, "left_anti")
    out = free(target.select(*AT).distinct())
    if operation not in ("none", "opening", "closing", "opening_closing"):
        raise ValueError(operation)
    if operation != "none":
        edge, found = runs.bounds(valid) if pixels is None else runs.runs(pixels), runs.runs(out)
        if operation != "closing":
            found = runs.opening(found, radius, edge)
        if operation != "opening":
            found = runs.closing(found, radius, edge)
        out = free(runs.pixels(found))
    return raster.remove_small(raster.components(out, connectivity), least).select(*AT) if least > 1 else out


def attach_decisions(pixels: DataFrame, objects: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each pixel with the decision columns of its object, one row an object."""
    return pixels.join(objects.select(*keys, *columns), keys, "left")


def _assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the largest sum of gains: rows are added one by one, each along the
    cheapest chain of swaps."""
    cost = gain.max(initial=0) - gain
    flip = cost.shape[0] > cost.shape[1]
    cost = cost.T if flip else cost
    n, m = cost.shape
    pot_r, pot_c, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last, low = i, -1, 0.0
        while True:
            step = low + cost[row] - pot_r[row] - pot_c
            closer = ~done & (step < dist)
            dist[closer], back[closer] = step[closer], last
            j = int(np.where(done, np.inf, dist).argmin())
            low, last = dist[j], j
            done[j] = True
            if owner[j] < 0:
                break
            row = owner[j]
        used = done.copy()
        used[last] = False
        pot_r[i] += low
        for j in np.flatnonzero(used):
            pot_r[owner[j]] += low - dist[j]
            pot_c[j] -= low - dist[j]
        while last >= 0:
            before = back[last]
            owner[last] = owner[before] if before >= 0 else i
            last = before
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return [(b, a) for a, b in pairs] if flip else pairs


def component_matching(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(image, a, b, iou)``: the one-to-one matching of overlapping labels with the largest summed IoU. Labels that
    overlap each other through others form a cluster; each cluster is matched by itself."""
    pairs = materialize(raster.component_iou(df, ["image"], a, b).select("image", F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), "iou"), "overlaps")
    node = lambda side, c: F.xxhash64(F.col("image").cast("string"), F.lit(side), c)
    clusters = connected_components(pairs.select(node("a", "a").alias("a"), node("b", "b").alias("b")), "overlap-clusters")
    named = pairs.withColumn("node", node("a", "a")).join(clusters, "node")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(pdf["a"])), sorted(set(pdf["b"]))
        gain = np.zeros((len(rows), len(cols)))
        for x, y, v in zip(pdf["a"], pdf["b"], pdf["iou"], strict=True):
            gain[rows.index(x), cols.index(y)] = v
        out = [(pdf["image"].iloc[0], rows[i], cols[j], gain[i, j]) for i, j in _assign(gain) if gain[i, j] > 0]
        return pd.DataFrame(out, columns=["image", "a", "b", "iou"])

    return named.select("component", F.col("image").cast("string").alias("image"), "a", "b", "iou").groupBy("component").applyInPandas(match, "image string, a string, b string, iou double")


def component_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per image components on both sides, matched ones, their mean IoU and the share left unmatched."""
    counts = df.groupBy(F.col("image").cast("string").alias("image")).agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"))
    m = component_matching(df, a, b).groupBy("image").agg(F.count("*").alias("n_matched"), F.avg("iou").alias("mean_iou"))
    out = counts.join(m, "image", "left").fillna(0, ["n_matched"])
    both = F.col("n_a") + F.col("n_b")
    return out.withColumns({"mean_iou": F.coalesce("mean_iou", F.when(both == 0, 1.0).otherwise(0.0)), "unmatched_rate": F.when(both == 0, 0.0).otherwise((both - 2 * F.col("n_matched")) / F.nullif(both, F.lit(0)))})


def component_detection(df: DataFrame, truth: str, predicted: str, least_iou: float = 0.0) -> DataFrame:
    """Per image: truth components that some prediction overlaps (recall), predictions that overlap some truth
    (precision), truths of several predictions (split) and predictions of several truths (merge)."""
    n = df.groupBy("image").agg(F.count_distinct(truth).alias("n_truth"), F.count_distinct(predicted).alias("n_predicted"))
    pairs = raster.component_iou(df, ["image"], truth, predicted).where(F.col("iou") > least_iou)
    t = pairs.groupBy("image", truth).agg(F.count("*").alias("k")).groupBy("image").agg(F.count("*").alias("n_detected"), F.count_if(F.col("k") > 1).alias("n_split"))
    p = pairs.groupBy("image", predicted).agg(F.count("*").alias("k")).groupBy("image").agg(F.count("*").alias("n_matched"), F.count_if(F.col("k") > 1).alias("n_merged"))
    out = n.join(t, "image", "left").join(p, "image", "left").fillna(0, ["n_detected", "n_split", "n_matched", "n_merged"])
    return out.withColumns({"recall": F.try_divide("n_detected", "n_truth"), "precision": F.try_divide("n_matched", "n_predicted"), "split_rate": F.coalesce(F.try_divide("n_split", "n_truth"), F.lit(0.0)), "merge_rate": F.coalesce(F.try_divide("n_merged", "n_predicted"), F.lit(0.0))})


def fragment_table(df: DataFrame, truth: str, predicted: str, bounds: list[float], names: list[str], least_iou: float = 0.0) -> DataFrame:
    """A row per truth component: area, area class, whether it is detected, its best prediction and IoU."""
    area = df.where(F.col(truth).isNotNull()).groupBy("image", truth).agg(F.count("*").alias("area"))
    pairs = raster.component_iou(df, ["image"], truth, predicted).where(F.col("iou") > least_iou)
    best = pairs.groupBy("image", truth).agg(F.max("iou").alias("best_iou"), F.max_by(predicted, F.struct("iou", -F.col(predicted))).alias("best_match"))
    klass = reduce(lambda c, x: c.when(F.col("area") <= x[0], x[1]), zip(bounds, names, strict=False), F.when(F.lit(False), "")).otherwise(names[-1])
    return area.join(best, ["image", truth], "left").withColumns({"area_class": klass, "detected": F.col("best_match").isNotNull(), "best_iou": F.coalesce("best_iou", F.lit(0.0))})


def annotation_agreement(masks: DataFrame, image: str, dice: float = 0.85, iou: float = 0.75) -> DataFrame:
    """``masks(image, row, col, annotator, truth, valid)``: every pair of annotators of an image on pixels valid for both,
    with Dice, IoU and whether they must be adjudicated."""
    v = masks.where("valid").select(image, "row", "col", "annotator", "truth")
    pairs = v.alias("x").join(v.alias("y"), (F.col(f"x.{image}") == F.col(f"y.{image}")) & (F.col("x.row") == F.col("y.row")) & (F.col("x.col") == F.col("y.col")) & (F.col("x.annotator") < F.col("y.annotator")))
    pairs = pairs.select(F.col(f"x.{image}").alias(image), F.col("x.annotator").alias("first"), F.col("y.annotator").alias("second"), F.col("x.truth").alias("a"), F.col("y.truth").alias("b"))
    out = raster.mask_agreement(pairs, [image, "first", "second"], "a", "b")
    return out.withColumn("needs_adjudication", (F.col("dice") < dice) | (F.col("iou") < iou))


def annotation_checks(masks: DataFrame, by: list[str], area: DataFrame) -> DataFrame:
    """Per annotation its pixels outside the object area, positive pixels that are not valid, and accepted, or error where there is
    any of these."""
    inside = area.select(*AT, F.lit(True).alias("_in"))
    df = masks.join(inside, AT, "left")
    out = df.groupBy(*by).agg(F.count("*").alias("n_pixels"), F.count_if(F.col("_in").isNull() & F.col("truth")).alias("n_outside"), F.count_if(F.col("truth") & ~F.coalesce("valid", F.lit(False))).alias("n_positive_invalid"), F.count_if("truth").alias("n_positive"))
    return out.withColumn("status", F.when((F.col("n_outside") == 0) & (F.col("n_positive_invalid") == 0), "accepted").otherwise("error"))


def calibration_input(pixels: DataFrame, thresholds: DataFrame, key: str, score: str, allowed: list[int]) -> DataFrame:
    """Pixels with raw target and uncertain flags under their configuration's thresholds. A batch that is not allowed or a
    position that a configuration has twice is an error."""
    df = pixels.join(thresholds.select(key, "lower", "upper"), key)
    once = df.groupBy(key, *AT).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in df.columns if c not in (key, *AT)])).alias("_v"))
    fault = F.when(F.col("_n") > 1, F.raise_error(F.lit("a position occurs twice"))).when(~F.col("_v.batch").isin(allowed), F.raise_error(F.lit("a batch is not allowed")))
    out = once.withColumn("_v", F.coalesce(fault.cast(once.schema["_v"].dataType), F.col("_v"))).select(key, *AT, "_v.*")
    return out.withColumns({"target": F.col(score) >= F.col("upper"), "uncertain": (F.col(score) >= F.col("lower")) & (F.col(score) < F.col("upper"))})


def spatial_grid(connectivities: list[int], operations: list[str], radii: list[int], areas: list[int]) -> list[dict]:
    """Every combination; without morphology the radius does not matter and occurs once."""
    return [{"connectivity": c, "operation": o, "radius": r, "least": a} for c in connectivities for o in operations for r in (radii if o != "none" else radii[:1]) for a in areas]


def evaluate_spatial(grid: list[dict], target: DataFrame, uncertain: DataFrame, truth: DataFrame, valid: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """Per candidate the pooled pixel counts of its mask against the truth on valid pixels that are not uncertain; ``pixels`` as in
    ``post_process``."""
    ground = valid.select(*AT).join(uncertain.select(*AT), AT, "left_anti").join(truth.select(*AT, F.lit(True).alias("_t")), AT, "left")
    parts = []
    for n, g in enumerate(grid):
        mask = post_process(target, uncertain, valid, **g, pixels=pixels)
        both = ground.join(mask.select(*AT, F.lit(True).alias("_p")), AT, "left")
        t, p = F.col("_t").isNotNull(), F.col("_p").isNotNull()
        counts = both.agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))
        parts.append(counts.select(F.lit(n).alias("candidate"), *[F.lit(v).alias(k) for k, v in g.items()], "*"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumns({"miss_rate": F.try_divide(F.col("fn"), F.col("tp") + F.col("fn")), "false_rate": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))})


def choose_spatial(evaluated: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Of the candidates within the tolerance of the best miss rate, then of the best false rate, the simplest: no morphology,
    smaller radius, smaller area, lower connectivity."""
    for metric in ("miss_rate", "false_rate"):
        best = evaluated.agg(F.min(metric).alias("_b"))  # one row
        evaluated = evaluated.crossJoin(F.broadcast(best)).where(F.col(metric) <= F.col("_b") + tolerance).drop("_b")
    rank = F.struct(F.when(F.col("operation") == "none", 0).when(F.col("operation") == "opening_closing", 2).otherwise(1).alias("o"), "radius", "least", "connectivity", "candidate")
    return evaluated.agg(F.min_by(F.struct(*evaluated.columns), rank).alias("x")).select("x.*")


def locked_validation(target: DataFrame, uncertain: DataFrame, truth_objects: DataFrame, item: str, valid: DataFrame, lock: dict, pixels: DataFrame | None = None) -> DataFrame:
    """Per image and map (raw, post_processed): pixel counts, Dice, and component recall, with the truth's objects as
    components, so that objects that touch stay apart; ``pixels`` as in ``post_process``."""
    ground = valid.select(*AT).join(uncertain.select(*AT), AT, "left_anti").join(truth_objects.select(*AT, F.col(item).alias("_t")), AT, "left")
    parts = []
    for name, mask in (("raw", target.select(*AT)), ("post_processed", post_process(target, uncertain, valid, **lock, pixels=pixels))):
        labelled = raster.components(mask.join(ground.select(*AT), AT, "left_semi"), lock["connectivity"])
        both = ground.join(labelled, AT, "left")
        t, p = F.col("_t").isNotNull(), F.col("label").isNotNull()
        counts = both.groupBy("image").agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"))
        comps = component_detection(both, "_t", "label").select("image", "n_truth", "n_detected", "recall")
        parts.append(counts.join(comps, "image").select(F.lit(name).alias("map"), "*"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("dice", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(1.0)))
