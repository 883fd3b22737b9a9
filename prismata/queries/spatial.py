"""Queries of rasters, objects and spatial agreement. One raster of 25 columns holds all pixels; its images are stretches
of ten rows; labels are the embeddings' classes and runs of five rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.operators import annotations, raster, runs, spatial
from prismata.plans.shared import materialize
from prismata.registry import P, pixels, query, rounded

AT = spatial.AT


def ras(s, d):
    return pixels(s, d).withColumns({"image": F.floor(F.col("row") / 10).cast("int"), "five": F.floor(F.col("row") / 5).cast("int"), "on": F.col("spectrum")[0] > 1.0, "near": F.col("spectrum")[1] > 1.0})


R = P + ", r AS (SELECT vec_id, label, batch, object, CAST(row // 10 AS INTEGER) AS image, row, col, CAST(row // 5 AS INTEGER) AS five, spectrum, spectrum[1] > 1.0 AS on_, spectrum[2] > 1.0 AS near FROM p)"


@query("r1_reference_image", f"{P} SELECT vec_id, round(list_max(spectrum), 6) AS largest, round(list_sum(spectrum) / 64, 6) AS mean, round(spectrum[8], 6) AS band FROM p")
def _(s, d):
    return rounded(pixels(s, d).select("vec_id", spatial.reference_value("spectrum", "max").alias("largest"), spatial.reference_value("spectrum", "mean").alias("mean"), spatial.reference_value("spectrum", "band", 7).alias("band")))


@query("r5_object_extraction", f"{R}, o AS (SELECT image, label, count(*) AS area, avg(row) AS centre_row, min(col) AS min_col, max(col) AS max_col, avg(spectrum[1]) AS m, stddev_pop(spectrum[1]) AS sd, median(spectrum[1]) AS md FROM r GROUP BY image, label HAVING count(*) >= 3) SELECT image || '_obj' || lpad(CAST(row_number() OVER (PARTITION BY image ORDER BY label) AS VARCHAR), 3, '0') AS object_id, label, area, round(centre_row, 6) AS centre_row, min_col, max_col, round(m, 6) AS mean0, round(sd, 6) AS std0, round(md, 6) AS median0 FROM o")
def _(s, d):
    o = spatial.extract_objects(ras(s, d), "label", 3)
    return rounded(o.select("object_id", "label", "area", "centre_row", "min_col", "max_col", F.col("mean_spectrum")[0].alias("mean0"), F.col("std_spectrum")[0].alias("std0"), F.col("median_spectrum")[0].alias("median0")))


@query(
    "r6_border_distance",
    f"{R}, b AS (SELECT image, label, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM r GROUP BY image, label) SELECT x.vec_id, round(min(sqrt(power(y.row - x.row, 2) + power(y.col - x.col, 2))), 6) AS distance_to_border FROM r x JOIN b USING (image, label) LEFT JOIN r y ON y.image = x.image AND y.label <> x.label AND y.row BETWEEN r0 AND r1 AND y.col BETWEEN c0 AND c1 AND power(y.row - x.row, 2) + power(y.col - x.col, 2) <= 4 GROUP BY x.vec_id",
)
def _(s, d):
    # only positions of the table count as a raster here, so the last, unfinished row is left to what it holds
    df = ras(s, d)
    out = spatial.border_distance(df, "label", 2)
    return rounded(out.select("vec_id", "distance_to_border"))


@query(
    "r6_exact_distance",
    f"{R}, b AS (SELECT image, label, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM r GROUP BY image, label), a AS (SELECT image, label, y AS row, x AS col FROM (SELECT image, label, c0, c1, unnest(range(r0, r1 + 1)) AS y FROM b), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS x)), "
    "o AS (SELECT * FROM a ANTI JOIN r USING (image, label, row, col)) SELECT vec_id, round(min(sqrt(power(o.row - r.row, 2) + power(o.col - r.col, 2))), 6) AS distance_to_border FROM r LEFT JOIN o USING (image, label) GROUP BY vec_id",
)
def _(s, d):
    return rounded(spatial.border_distance(ras(s, d), "label").select("vec_id", "distance_to_border"))


_DISK2 = "(VALUES " + ", ".join(f"({a}, {b})" for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4) + ") o(dr, dc)"
_DIL2 = f"d AS (SELECT DISTINCT image, row + dr AS row, col + dc AS col FROM r, {_DISK2} WHERE on_ AND spectrum[3] > 1.0)"


@query("r3_dilation_by_disk", f"{R}, {_DIL2} SELECT image, row, col FROM d")
def _(s, d):
    return raster.dilate(ras(s, d).where(F.col("on") & (F.col("spectrum")[2] > 1.0)), 2)


@query("r3_closing_at_borders", f"{R}, {_DIL2}, n AS (SELECT image, row, col FROM r ANTI JOIN d USING (image, row, col)), hurt AS (SELECT DISTINCT image, row + dr AS row, col + dc AS col FROM n, {_DISK2}) SELECT image, row, col FROM d JOIN r USING (image, row, col) ANTI JOIN hurt USING (image, row, col)")
def _(s, d):
    """Beyond the borders of an image there is neither mask nor background; nor is there where its last row ends early."""
    df = ras(s, d)
    return raster.closing(df.where(F.col("on") & (F.col("spectrum")[2] > 1.0)), 2, runs.runs(df))


@query("r6_core_flag", f"{R}, b AS (SELECT image, label, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM r GROUP BY image, label), x AS (SELECT x.image, x.vec_id, count(y.vec_id) > 0 AS border FROM r x JOIN b USING (image, label) LEFT JOIN r y ON y.image = x.image AND y.label <> x.label AND y.row BETWEEN r0 AND r1 AND y.col BETWEEN c0 AND c1 AND abs(y.row - x.row) + abs(y.col - x.col) = 1 GROUP BY x.image, x.vec_id) SELECT image, count_if(border) AS n_border, count_if(NOT border) AS n_core FROM x GROUP BY image")
def _(s, d):
    out = spatial.border_distance(ras(s, d), "label", 1).withColumn("core", spatial.core_flag("distance_to_border", 1))
    return out.groupBy("image").agg(F.count_if(~F.col("core")).alias("n_border"), F.count_if("core").alias("n_core"))


_KEYED = "CASE WHEN image % 3 = 2 THEN 'alm9pea' || image ELSE 'alm1pea' || (image % 3 + 1) END"


@query(
    "r7_mixture_truth",
    f"{R}, m AS (SELECT image % 2 AS g, row % 10 AS row, col, bool_or(on_) AS on_ FROM r WHERE image < 2 GROUP BY ALL), k AS (SELECT g, row, col FROM m WHERE on_), dil AS (SELECT DISTINCT g, row + dr AS row, col + dc AS col FROM k, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)) "
    "SELECT vec_id, image % 3 < 2 AS available, CASE WHEN image % 3 < 2 THEN EXISTS (SELECT 1 FROM dil WHERE g = image % 3 AND dil.row = r.row % 10 AND dil.col = r.col) END AS truth FROM r",
)
def _(s, d):
    df = ras(s, d)
    refs = df.where("image < 2 AND on").select(F.concat(F.lit("pea"), F.col("image") + 1, F.lit("_pos1")).alias("image"), (F.col("row") % 10).alias("row"), "col")
    keyed = df.withColumn("image", F.when(F.col("image") % 3 == 2, F.concat(F.lit("alm9pea"), F.col("image"))).otherwise(F.concat(F.lit("ALM1pea"), F.col("image") % 3 + 1, F.lit("_sb")))).select("vec_id", "image", (F.col("row") % 10).alias("row"), "col")
    return spatial.mixture_truth(keyed, refs, 1).select("vec_id", "available", "truth")


_CROSS = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)"
_FREE = f"{R}, t AS (SELECT image, row, col FROM r WHERE on_ AND NOT near), hurt AS (SELECT DISTINCT image, row + dr AS row, col + dc AS col FROM r ANTI JOIN t USING (image, row, col), {_CROSS}), e AS (SELECT * FROM t ANTI JOIN hurt USING (image, row, col))"


@query("r8_post_processing", f"{_FREE}, n AS (SELECT DISTINCT image, row + dr AS row, col + dc AS col FROM e, {_CROSS}) SELECT image, row, col FROM n JOIN r USING (image, row, col) WHERE NOT near")
def _(s, d):
    df = ras(s, d)
    return spatial.post_process(df.where("on"), df.where("near"), df, operation="opening", radius=1, pixels=df)


@query("r10_object_decisions", f"{R}, o AS (SELECT image, label, avg(CAST(on_ AS DOUBLE)) >= 0.5 AS decision FROM r GROUP BY image, label) SELECT vec_id, decision FROM r JOIN o USING (image, label)")
def _(s, d):
    df = ras(s, d)
    objects = df.groupBy("image", "label").agg((F.avg(F.col("on").cast("double")) >= 0.5).alias("decision"))
    return spatial.attach_decisions(df, objects, ["image", "label"], ["decision"]).select("vec_id", "decision")


@query("r11_truth_labels", f"{R} SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN on_ WHEN image % 2 = 0 THEN label = 0 WHEN vec_id % 3 = 0 THEN near END AS truth, CASE WHEN vec_id % 5 = 0 THEN 'annotation' WHEN image % 2 = 0 THEN 'weak_object_label' WHEN vec_id % 3 = 0 THEN 'indirect' ELSE 'unavailable' END AS truth_source FROM r")
def _(s, d):
    df = ras(s, d)
    notes = df.where("vec_id % 5 = 0").select(*AT, F.col("on").alias("truth"), F.lit(1).alias("reference_id")).union(df.where("vec_id % 10 = 0").select(*AT, ~F.col("on"), F.lit(2)))
    return spatial.resolve_truth(df, notes, F.when(F.col("image") % 2 == 0, F.col("label") == 0), df.where("vec_id % 3 = 0").select(*AT, F.col("near").alias("truth"))).select("vec_id", "truth", "truth_source")


@query("a2_component_matching")
def _(s, d):
    return rounded(spatial.component_agreement(ras(s, d), "label", "five"))


_IOU = f"{R}, ov AS (SELECT image, label, five, count(*) AS n FROM r GROUP BY ALL), ta AS (SELECT image, label, count(*) AS n FROM r GROUP BY ALL), pa AS (SELECT image, five, count(*) AS n FROM r GROUP BY ALL), i AS (SELECT image, label, five, ov.n / (ta.n + pa.n - ov.n) AS iou FROM ov JOIN ta USING (image, label) JOIN pa USING (image, five)), k AS (SELECT * FROM i WHERE iou > 0.05)"


@query(
    "a3_component_detection",
    f"{_IOU}, t AS (SELECT image, count(*) AS n_detected, count_if(k > 1) AS n_split FROM (SELECT image, label, count(*) AS k FROM k GROUP BY ALL) GROUP BY image), q AS (SELECT image, count(*) AS n_matched, count_if(k > 1) AS n_merged FROM (SELECT image, five, count(*) AS k FROM k GROUP BY ALL) GROUP BY image), n AS (SELECT image, count(DISTINCT label) AS n_truth, count(DISTINCT five) AS n_predicted FROM r GROUP BY image) "
    "SELECT image, n_truth, n_predicted, coalesce(n_detected, 0) AS n_detected, coalesce(n_split, 0) AS n_split, coalesce(n_matched, 0) AS n_matched, coalesce(n_merged, 0) AS n_merged, round(coalesce(n_detected, 0) / n_truth, 6) AS recall, round(coalesce(n_matched, 0) / n_predicted, 6) AS precision, round(coalesce(n_split, 0) / n_truth, 6) AS split_rate, round(coalesce(n_merged, 0) / n_predicted, 6) AS merge_rate FROM n LEFT JOIN t USING (image) LEFT JOIN q USING (image)",
)
def _(s, d):
    return rounded(spatial.component_detection(ras(s, d), "label", "five", 0.05))


@query("a3_fragment_table", f"{_IOU}, b AS (SELECT image, label, max(iou) AS best_iou FROM k GROUP BY ALL) SELECT image, label, n AS area, CASE WHEN n <= 10 THEN 'tiny' WHEN n <= 25 THEN 'small' ELSE 'large' END AS area_class, best_iou IS NOT NULL AS detected, round(coalesce(best_iou, 0), 6) AS best_iou FROM ta LEFT JOIN b USING (image, label)")
def _(s, d):
    return rounded(spatial.fragment_table(ras(s, d), "label", "five", [10, 25], ["tiny", "small", "large"], 0.05).select("image", "label", "area", "area_class", "detected", "best_iou"))


@query(
    "a4_annotation_agreement",
    f"{R}, v AS (SELECT image, 1 AS a, 2 AS b, on_ AS x, near AS y FROM r WHERE vec_id % 7 > 0 UNION ALL SELECT image, 1, 3, on_, on_ FROM r WHERE vec_id % 7 > 0 UNION ALL SELECT image, 2, 3, near, on_ FROM r), w AS (SELECT image, a AS first, b AS second, count_if(x = y) / count(*) AS agreement, coalesce(2 * count_if(x AND y) / nullif(count_if(x) + count_if(y), 0), 1) AS dice, coalesce(count_if(x AND y) / nullif(count_if(x OR y), 0), 1) AS iou FROM v GROUP BY ALL) SELECT image, first, second, round(agreement, 6) AS agreement, round(dice, 6) AS dice, round(iou, 6) AS iou, dice < 0.85 OR iou < 0.75 AS needs_adjudication FROM w",
)
def _(s, d):
    df = ras(s, d)
    notes = [df.select(*AT, F.lit(n).alias("annotator"), F.col(c).alias("truth"), ok.alias("valid")) for n, c, ok in ((1, "on", F.col("vec_id") % 7 > 0), (2, "near", F.lit(True)), (3, "on", F.lit(True)))]
    return rounded(spatial.annotation_agreement(notes[0].union(notes[1]).union(notes[2]), "image"))


def annotated(s, d):
    df = ras(s, d)
    odd = F.col("vec_id") % 7 > 0
    notes = [df.select(*AT, F.lit(n).alias("annotator"), t.alias("truth"), ok.alias("valid")) for n, t, ok in ((1, F.col("on"), odd), (2, F.col("on") & (F.col("vec_id") % 11 > 0), F.lit(True)), (3, F.col("near"), F.lit(True)))]
    return notes[0].union(notes[1]).union(notes[2]), df


_PAIRS = f"{R}, n AS (SELECT image, row, col, vec_id, 1 AS who, on_ AS t, vec_id % 7 > 0 AS v FROM r UNION ALL SELECT image, row, col, vec_id, 2, on_ AND vec_id % 11 > 0, true FROM r UNION ALL SELECT image, row, col, vec_id, 3, near, true FROM r), c AS (SELECT x.image, x.who AS first, y.who AS second, x.t AS a, y.t AS b, x.v AS va, y.v AS vb FROM n x JOIN n y ON x.vec_id = y.vec_id AND x.who < y.who)"


@query(
    "a4_agreement_report",
    f"{_PAIRS} SELECT image, first, second, count(*) AS n_roi_pixels, count_if(va AND vb) AS n_pairwise_valid, round(avg(CAST(va AND vb AS DOUBLE)), 6) AS pairwise_valid_coverage, round(avg(CAST(NOT va AS DOUBLE)), 6) AS ambiguous_rate_first, round(avg(CAST(va = vb AS DOUBLE)), 6) AS validity_agreement, "
    "round(coalesce(2 * count_if(a AND b AND va AND vb) / nullif(count_if(a AND va AND vb) + count_if(b AND va AND vb), 0), 1), 6) AS dice, round(coalesce(count_if(a AND b AND va AND vb) / nullif(count_if((a OR b) AND va AND vb), 0), 1), 6) AS iou FROM c GROUP BY ALL",
)
def _(s, d):
    masks, df = annotated(s, d)
    return rounded(annotations.agreement_report(masks, df).select("image", "first", "second", "n_roi_pixels", "n_pairwise_valid", "pairwise_valid_coverage", "ambiguous_rate_first", "validity_agreement", "dice", "iou"))


@query("a4_component_status")
def _(s, d):
    """Matched components and status of every pair; the tests hold them against plain labelling."""
    masks, df = annotated(s, d)
    return rounded(annotations.agreement_report(masks, df).select("image", "first", "second", "n_components_first", "n_components_second", "n_matched", "unmatched_component_rate", "status"))


@query("a5_annotation_errors", f"{R}, e AS (SELECT image, row, col, CASE WHEN vec_id % 2 = 1 THEN ['outside_area'] ELSE [] END || CASE WHEN NOT near THEN ['invalid_positive'] ELSE [] END AS es FROM r WHERE on_) SELECT image, row, col, unnest(es) AS error FROM e")
def _(s, d):
    df = ras(s, d)
    return annotations.annotation_errors(df.select(*AT, F.col("on").alias("truth"), F.col("near").alias("valid")), ["image"], df.where("vec_id % 2 = 0"))


@query("a5_annotation_checks", f"{R} SELECT image, count(*) AS n_pixels, count_if(vec_id % 2 = 1 AND on_) AS n_outside, count_if(on_ AND NOT near) AS n_positive_invalid, count_if(on_) AS n_positive, CASE WHEN count_if(vec_id % 2 = 1 AND on_) = 0 AND count_if(on_ AND NOT near) = 0 THEN 'accepted' ELSE 'error' END AS status FROM r GROUP BY image")
def _(s, d):
    df = ras(s, d)
    return spatial.annotation_checks(df.select(*AT, F.col("on").alias("truth"), F.col("near").alias("valid")), ["image"], df.where("vec_id % 2 = 0"))


@query("a6_calibration_input", f"{R} SELECT vec_id, spectrum[1] >= (CASE WHEN batch = 1 THEN 1.1 ELSE 1.05 END) AS target, spectrum[1] >= 0.95 AND spectrum[1] < (CASE WHEN batch = 1 THEN 1.1 ELSE 1.05 END) AS uncertain FROM r WHERE batch IN (1, 2)")
def _(s, d):
    df = ras(s, d).where("batch IN (1, 2)").select("vec_id", *AT, "batch", F.col("batch").alias("cfg"), F.col("spectrum")[0].alias("score"))
    t = s.createDataFrame([(1, 0.95, 1.1), (2, 0.95, 1.05)], "cfg int, lower double, upper double")
    return spatial.calibration_input(df, t, "cfg", "score", [1, 2]).select("vec_id", "target", "uncertain")


_NONE = f"{R}, g AS (SELECT label = 0 AS t, on_ AS p FROM r WHERE NOT (spectrum[3] > 1.1))"


@query("a7_spatial_grid", f"{_NONE} SELECT 'none' AS operation, count_if(t AND p) AS tp, count_if(t AND NOT p) AS fn, count_if(NOT t AND p) AS fp, count_if(NOT t AND NOT p) AS tn FROM g")
def _(s, d):
    return _evaluated(s, d).where("operation = 'none' AND least = 0").select("operation", "tp", "fn", "fp", "tn").distinct()


def _evaluated(s, d):
    df = ras(s, d)
    grid = spatial.spatial_grid([8], ["none", "closing"], [1], [0, 4])
    return spatial.evaluate_spatial(grid, df.where("on"), df.where(F.col("spectrum")[2] > 1.1), df.where("label = 0"), df, df)


@query("a7_spatial_choice")
def _(s, d):
    return rounded(spatial.choose_spatial(materialize(_evaluated(s, d), "spatial-grid"), 0.05))


@query("a9_locked_validation", f"{R}, g AS (SELECT image, label = 0 AS t, on_ AS p FROM r WHERE NOT (spectrum[3] > 1.1)) SELECT image, 'raw' AS map, count_if(t AND p) AS tp, count_if(t AND NOT p) AS fn, count_if(NOT t AND p) AS fp, count_if(NOT t AND NOT p) AS tn, round(coalesce(2 * count_if(t AND p) / nullif(count_if(t) + count_if(p), 0), 1), 6) AS dice FROM g GROUP BY image")
def _(s, d):
    df = ras(s, d)
    out = spatial.locked_validation(df.where("on"), df.where(F.col("spectrum")[2] > 1.1), df.where("label = 0"), "object", df, {"connectivity": 8, "operation": "closing", "radius": 1, "least": 4}, df)
    return rounded(out.where("map = 'raw'").select("image", "map", "tp", "fn", "fp", "tn", "dice"))


@query("r4_least_area", f"{R} SELECT image, label, count(*) AS n FROM r GROUP BY image, label HAVING count(*) >= 24")
def _(s, d):
    return raster.remove_small(ras(s, d), 24).groupBy("image", "label").agg(F.count("*").alias("n"))


@query("r4_manual_labels", f"{R} SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN -1 WHEN vec_id % 50 = 1 THEN NULL ELSE label END AS label FROM r WHERE vec_id % 50 <> 1")
def _(s, d):
    df = ras(s, d)
    manual = df.where("vec_id % 50 < 2").select(*AT, F.when(F.col("vec_id") % 50 == 0, -1).cast("long").alias("manual"))
    return raster.manual_labels(df.withColumn("label", F.col("label").cast("long")), manual).select("vec_id", "label")
