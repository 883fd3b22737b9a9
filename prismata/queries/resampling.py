"""Queries of resampled statistics, balanced folds, exact object tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.operators import folds, object_quality, pca_metrics, resample, sampling_grid
from prismata.plans.shared import materialize
from prismata.queries.spatial import R, ras
from prismata.registry import BANDS, P, pixels, query, rounded

# the stand-in: classes are labels modulo 3, groups (images) are classes by batches, 12 of them over all pixels
_G = f"{P}, q AS (SELECT *, CAST(label % 3 AS VARCHAR) AS class, (label % 3) || '_' || batch AS grp FROM p)"
_GB = f"{BANDS}, q AS (SELECT vec_id, CAST(label % 3 AS VARCHAR) AS class, (label % 3) || '_' || batch AS grp, batch, band, v FROM b)"


def grouped(s, d):
    kind = F.col("label") % 3
    return pixels(s, d).withColumns({"class": kind.cast("string"), "grp": F.concat_ws("_", kind, "batch")})


def partitions(s, d):
    """Two partitions of the groups: by odd batches, and by batch."""
    g = grouped(s, d).select("grp", "batch").distinct()
    each = F.explode(F.array(F.struct(F.lit("odd").alias("partition"), (F.col("batch") % 2).alias("fold")), F.struct(F.lit("batch").alias("partition"), F.col("batch").alias("fold")))).alias("x")
    return g.select(F.col("grp").alias("group"), each).select("group", "x.*")


@query("g16_bootstrap_stability")
def _(s, d):
    """Whole-image bootstrap of the first components: 100 replicates as weighted sums of one Gram matrix an image."""
    stats = resample.statistics(grouped(s, d).where("batch < 4").withColumn("all", F.lit("all")), "all", "grp", "spectrum")
    groups = stats.select("group").distinct()
    whole = resample.fits(resample.weighted_sums(stats, groups.select(F.lit("all").alias("run"), "group", F.lit(1.0).alias("w"))))
    runs = resample.fits(resample.weighted_sums(stats, resample.bootstrap_weights(groups, "group", 100)))
    table = pca_metrics.loading_stability(resample.loading_runs(whole, runs), "candidate", "run", 3).where("run <> ''")
    return rounded(table.groupBy("component").agg(F.avg("loading_abs_correlation").alias("mean_correlation"), F.max("loading_angle_deg").alias("worst_angle"), F.avg("subspace_similarity").alias("mean_similarity"), F.count("*").alias("n_runs")), 4)


@query("g16_folds_seeds_bootstrap")
def _(s, d):
    """Folds, sampling seeds and bootstrap against the fit of all rows, each type of run reduced apart."""
    df = grouped(s, d).withColumn("all", F.lit("all"))
    stats = resample.statistics(df, "all", "grp", "spectrum")
    groups = stats.select("group").distinct()
    whole = resample.fits(resample.weighted_sums(stats, groups.select(F.lit("all").alias("run"), "group", F.lit(1.0).alias("w"))))
    runs = resample.fold_weights(partitions(s, d).where("partition = 'odd'"), "partition", "group", "fold").unionByName(resample.bootstrap_weights(groups, "group", 20))
    # a sampling seed draws half of the pixels by hash
    draws = F.explode(F.filter(F.array(*[F.when(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(2)) == 0, seed) for seed in range(1, 4)]), lambda x: x.isNotNull())).alias("seed")
    drawn = resample.statistics(df.select("*", draws), "seed", "grp", "spectrum")
    seeds = drawn.select(F.lit("all").alias("key"), F.concat(F.lit("seed_"), F.col("key"), F.lit("|"), F.col("group")).alias("group"), "n", "width", "triangle")
    by_seed = seeds.select(F.substring_index("group", "|", 1).alias("run"), "group", F.lit(1.0).alias("w")).distinct()
    fitted = resample.fits(resample.weighted_sums(stats, runs)).unionByName(resample.fits(resample.weighted_sums(seeds, by_seed)))
    table = pca_metrics.loading_stability(resample.loading_runs(whole, fitted), "candidate", "run", 3)
    return rounded(resample.stability_by_type(table, {"group_fold": "odd/", "seed": "seed_", "bootstrap": "boot_"}), 4)


_FOLDS = "f AS (SELECT DISTINCT 'odd' AS partition, grp, CAST(batch % 2 AS VARCHAR) AS fold FROM q UNION SELECT DISTINCT 'batch', grp, CAST(batch AS VARCHAR) FROM q)"


@query(
    "l7_partition_metrics",
    f"{_GB}, {_FOLDS}, k AS (SELECT DISTINCT partition, fold FROM f), x AS (SELECT q.class, k.partition, k.fold, f.fold = k.fold AS held, q.vec_id, q.band, q.v FROM q JOIN f USING (grp) JOIN k ON k.partition = f.partition), "
    "t AS (SELECT class, partition, fold, band, avg(v) AS m, var_samp(v) AS s, var_pop(v) AS sp, count(*) AS n FROM x WHERE NOT held GROUP BY ALL), h AS (SELECT x.class, x.partition, x.fold, count(DISTINCT x.vec_id) AS n_held, sum(power(x.v - t.m, 2)) AS far FROM x JOIN t USING (class, partition, fold, band) WHERE held GROUP BY ALL), "
    "c AS (SELECT class, partition, fold, band, avg(v) AS hm FROM x WHERE held GROUP BY ALL), g AS (SELECT class, partition, fold, sqrt(sum(power(hm - m, 2))) AS gap, sqrt(sum(s)) AS size, sum(sp) AS train_q, max(n) AS n_train FROM t JOIN c USING (class, partition, fold, band) GROUP BY ALL) "
    "SELECT class AS key, partition, fold, n_train::DOUBLE AS n_train, n_held::DOUBLE AS n_held, round(far / n_held, 6) AS mean_q, round(train_q, 6) AS train_q, round(gap / (size + 1e-12), 6) AS shift FROM g JOIN h USING (class, partition, fold)",
)
def _(s, d):
    """Without components Q is the distance to the mean, which SQL can say; the tests hold H and Q with components."""
    stats = resample.statistics(grouped(s, d), "class", "grp", "spectrum")
    return rounded(resample.partition_metrics(stats, partitions(s, d), 0).select("key", "partition", "fold", "n_train", "n_held", "mean_q", "train_q", "shift"))


@query("l7_partition_sensitivity")
def _(s, d):
    """Every fold of both partitions, re-evaluated with three components."""
    stats = resample.statistics(grouped(s, d), "class", "grp", "spectrum")
    return rounded(resample.partition_metrics(stats, partitions(s, d), 3), 4)


@query(
    "l4_balanced_folds",
    f"{_G}, g0 AS (SELECT grp, min(class) AS class, min(batch) AS batch, count(*) AS n, median(row) AS size FROM q GROUP BY grp), g AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS place, greatest(0, ceil((row_number() OVER (ORDER BY size, grp) - 1) * 3 / greatest(count(*) OVER () - 1, 1)) - 1) AS bin FROM g0), "
    "t AS (SELECT unnest(range(1, 2048)) AS t), a AS (SELECT t, g.*, CASE WHEN place = 0 THEN 0 ELSE (t >> CAST(11 - place AS INT)) & 1 END AS fold FROM t, g), "
    "c AS (SELECT t, sum(2 - k + CAST(k = 1 AS INT)) AS miss FROM (SELECT t, class, count(DISTINCT fold) AS k FROM a GROUP BY ALL) GROUP BY t), b AS (SELECT t, sum(2 - k + CAST(k = 1 AS INT)) AS miss FROM (SELECT t, batch, count(DISTINCT fold) AS k FROM a GROUP BY ALL) GROUP BY t), "
    "s AS (SELECT t, max(n) - min(n) AS range, max(m) - min(m) AS gap FROM (SELECT t, fold, sum(n) AS n, median(size) AS m FROM a GROUP BY ALL) GROUP BY t), z AS (SELECT t, sum(abs(x - y)) AS bins FROM (SELECT t, bin, count_if(fold = 0) AS x, count_if(fold = 1) AS y FROM a GROUP BY ALL) GROUP BY t), "
    "w AS (SELECT t, c.miss + b.miss AS incomplete, range, bins, gap FROM c JOIN b USING (t) JOIN s USING (t) JOIN z USING (t) ORDER BY incomplete, range, bins, round(gap, 9), t LIMIT 1) "
    "SELECT grp AS \"group\", class AS label, CAST(fold AS INT) AS fold, n, CAST(incomplete AS BIGINT) AS incomplete, CAST(range AS BIGINT) AS count_range, CAST(bins AS BIGINT) AS bin_range, round(gap, 6) AS median_range FROM a JOIN w USING (t)",
)
def _(s, d):
    out = folds.balanced_folds(grouped(s, d), "grp", "class", "batch", "row")
    return rounded(out.select("group", "label", "fold", "n", "incomplete", "count_range", "bin_range", "median_range"))


@query("l4_searched_folds")
def _(s, d):
    """Three folds of the images, by seeded search; the tests hold its scores."""
    out = folds.balanced_folds(pixels(s, d), "image", "label", "batch", "row", 3)
    return rounded(folds.coverage(out))


_OBJ = (
    f"{R}, x AS (SELECT image, label, row, col, list_transform(spectrum, lambda v: v - 0.8) AS s FROM r), f AS (SELECT image, min(row) AS a0, max(row) + 1 AS a1, min(col) AS b0, max(col) + 1 AS b1 FROM x GROUP BY image), "
    "o AS (SELECT image, label, count(*) AS area, min(row) AS r0, max(row) + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1, count_if(list_min(s) > 0) AS n_valid_pixels, count_if(list_min(s) <= 0) AS n_nonpositive_pixels FROM x GROUP BY ALL), "
    "n AS (SELECT a.image, a.label, coalesce(min(sqrt(power(greatest(0, a.r0 - b.r1, b.r0 - a.r1), 2) + power(greatest(0, a.c0 - b.c1, b.c0 - a.c1), 2))), 'Infinity'::DOUBLE) AS gap FROM o a LEFT JOIN o b ON a.image = b.image AND a.label <> b.label GROUP BY ALL), "
    "q AS (SELECT o.*, gap, area / ((r1 - r0) * (c1 - c0)) AS fill, r0 <= a0 OR r1 >= a1 OR c0 <= b0 OR c1 >= b1 AS touches FROM o JOIN f USING (image) JOIN n USING (image, label))"
)


@query(
    "q5_object_table",
    f"{_OBJ} SELECT image, label, area, n_valid_pixels, area - n_valid_pixels AS n_invalid_pixels, n_nonpositive_pixels, round((area - n_valid_pixels) / area, 6) AS invalid_pixel_rate, round(fill, 6) AS fill_ratio, touches AS touches_border, round(gap, 6) AS nearest_object_distance, fill < 0.1 OR gap < 1 AS possible_merged, area < 3 AS too_small, "
    "CASE WHEN n_valid_pixels = 0 OR area < 3 THEN 'excluded' WHEN fill < 0.1 OR gap < 1 OR touches THEN 'warning' ELSE 'accepted' END AS qc_status FROM q",
)
def _(s, d):
    df = ras(s, d).withColumn("spectrum", F.transform("spectrum", lambda v: v - 0.8))
    out = object_quality.object_table(df, "label", least_area=3, least_fill=0.1, least_gap=1.0)
    return rounded(out.select("image", "label", "area", "n_valid_pixels", "n_invalid_pixels", "n_nonpositive_pixels", "invalid_pixel_rate", "fill_ratio", "touches_border", "nearest_object_distance", "possible_merged", "too_small", "qc_status"))


@query("q5_object_findings", f"{_OBJ} SELECT finding, severity, count(*) AS n FROM (SELECT CASE WHEN n_valid_pixels = 0 THEN ['no_valid_pixel'] ELSE [] END || CASE WHEN area < 3 THEN ['too_small'] ELSE [] END || CASE WHEN fill < 0.1 OR gap < 1 THEN ['possible_merged'] ELSE [] END || CASE WHEN touches THEN ['touches_border'] ELSE [] END || CASE WHEN (area - n_valid_pixels) / area > 0.2 THEN ['invalid_pixels'] ELSE [] END AS fs FROM q), LATERAL (SELECT unnest(fs) AS finding), (SELECT unnest(['no_valid_pixel', 'too_small', 'possible_merged', 'touches_border', 'invalid_pixels']) AS name, unnest(['error', 'error', 'warning', 'warning', 'info']) AS severity) WHERE name = finding GROUP BY ALL")
def _(s, d):
    df = ras(s, d).withColumn("spectrum", F.transform("spectrum", lambda v: v - 0.8))
    table = materialize(object_quality.object_table(df, "label", least_area=3, least_fill=0.1, least_gap=1.0), "object-table")
    return object_quality.warnings(table, "label").groupBy("finding", "severity").agg(F.count("*").alias("n"))


@query(
    "m12_sampling_grid",
    f"{P}, o AS (SELECT object, min(label) AS label, min(image) AS image, count(*) AS n FROM p GROUP BY object), g AS (SELECT o.*, m, least(n, m) AS take FROM o, (SELECT unnest([1, 2, 4]) AS m)), a AS (SELECT m, count(*) AS n_objects_total, count_if(n < m) AS n_objects_under_m, avg(CAST(n >= m AS DOUBLE)) AS e, CAST(sum(take) AS BIGINT) AS n_rows FROM g GROUP BY m), c AS (SELECT m, min(k) / max(k) AS r, count(*) AS n FROM (SELECT m, label, sum(take) AS k FROM g GROUP BY m, label) GROUP BY m), i AS (SELECT m, min(k) / max(k) AS r, count(*) AS n FROM (SELECT m, image, sum(take) AS k FROM g GROUP BY m, image) GROUP BY m), s AS (SELECT unnest(['random', 'center']) AS strategy) "
    "SELECT a.m, strategy, n_objects_total, n_objects_under_m, round(e, 6) AS eligible_rate, n_rows, c.n AS n_classes, i.n AS n_images, round(c.r, 6) AS class_balance_ratio, round(i.r, 6) AS image_balance_ratio, CASE strategy WHEN 'center' THEN 1.0::DOUBLE END AS stability_of_centre, true AS within, CASE WHEN e >= 0.9 THEN 'accepted' ELSE 'warning' END AS status FROM a JOIN c USING (m) JOIN i USING (m), s",
)
def _(s, d):
    """Sizes, strategies and three seeds; a random selection's stability is between 0 and 1, the tests hold its value."""
    out = sampling_grid.feasibility(pixels(s, d), ["object"], "label", "image", "vec_id", [1, 2, 4], ["random", "center"], [1, 2, 3])
    v = F.col("selection_stability")
    out = out.select("m", "strategy", "n_objects_total", "n_objects_under_m", "eligible_rate", "n_rows", "n_classes", "n_images", "class_balance_ratio", "image_balance_ratio", F.when(F.col("strategy") == "center", v).alias("stability_of_centre"), v.between(0, 1).alias("within"), "status")
    return rounded(out)
