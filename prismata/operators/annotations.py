"""Annotation masks against each other and against the area they may cover: agreement of pixels and components, errors, and
whether every disagreement was adjudicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.operators import raster, spatial
from prismata.plans.nulls import join_same
from prismata.plans.shared import materialize

AT = raster.AT


def agreement_report(masks: DataFrame, roi: DataFrame, least_dice: float = 0.85, least_iou: float = 0.75, most_unmatched: float = 0.1, connectivity: int = 8) -> DataFrame:
    """One row per image and pair of annotators of ``masks(image, row, col, annotator, truth, valid)``, over the positions of
    ``roi``: coverage of what both call valid, ambiguous shares of either, agreement of validity; Dice, IoU and pixel
    agreement, and one-to-one matched components with the share left over, on jointly valid pixels. ``status`` is
    accepted, adjudication_required, or no_joint_pixel. A position without a row of an annotator is not valid for them."""
    names = masks.select("image", "annotator").distinct()
    pairs = join_same(names.withColumnRenamed("annotator", "first"), names.withColumnRenamed("annotator", "second"), ["image"]).where("first < second")
    cells = join_same(roi.select(*AT).distinct(), pairs, ["image"])
    for who, t, v in (("first", "a", "_va"), ("second", "b", "_vb")):
        own = masks.select(*AT, F.col("annotator").alias(who), F.coalesce("truth", F.lit(False)).alias(t), F.coalesce("valid", F.lit(False)).alias(v))
        cells = join_same(cells, own, [*AT, who], "left").fillna(False, [t, v])
    cells = materialize(cells, "annotation-cells")
    by = ["image", "first", "second"]
    va, vb, n = F.col("_va"), F.col("_vb"), F.count("*")
    base = cells.groupBy(*by).agg(n.alias("n_roi_pixels"), F.count_if(va & vb).alias("n_pairwise_valid"), F.avg((va & vb).cast("double")).alias("pairwise_valid_coverage"), F.avg((~va).cast("double")).alias("ambiguous_rate_first"), F.avg((~vb).cast("double")).alias("ambiguous_rate_second"), F.avg((va == vb).cast("double")).alias("validity_agreement"))
    joint = cells.where(va & vb)
    pixel = raster.mask_agreement(joint, by, "a", "b")
    # a pair of annotators is an image of its own for its components
    pair = F.to_json(F.struct(*[F.col(c).cast("string") for c in by]), {"ignoreNullFields": "false"})
    named = joint.select(pair.alias("_pair"), "row", "col", "a", "b")
    parts = [raster.components(named.where(F.col(c)).select(F.col("_pair").alias("image"), "row", "col"), connectivity).withColumnRenamed("label", f"_{c}") for c in ("a", "b")]
    both = join_same(join_same(named.select(F.col("_pair").alias("image"), "row", "col"), parts[0], AT, "left"), parts[1], AT, "left")
    comps = spatial.component_agreement(both, "_a", "_b").select(F.col("image").alias("_pair"), F.col("n_a").alias("n_components_first"), F.col("n_b").alias("n_components_second"), "n_matched", "mean_iou", F.col("unmatched_rate").alias("unmatched_component_rate"))
    out = join_same(base, pixel, by, "left").withColumn("_pair", pair).join(comps, "_pair", "left").drop("_pair")
    checks = {"dice_passed": F.col("dice") >= least_dice, "iou_passed": F.col("iou") >= least_iou, "unmatched_rate_passed": F.col("unmatched_component_rate") <= most_unmatched}
    good = F.col("dice_passed") & F.col("iou_passed") & F.col("unmatched_rate_passed")
    return out.withColumns(checks).withColumn("status", F.when(F.col("n_pairwise_valid") == 0, "no_joint_pixel").when(good, "accepted").otherwise("adjudication_required"))


def adjudication_gaps(report: DataFrame, decisions: DataFrame, references: DataFrame) -> DataFrame:
    """Images of which some pair needs adjudication and that lack a valid decision, with the reason: ``missing``,
    ``not_adjudicated``, ``incomplete`` (no adjudicator, date, justification or reference) or ``unknown_reference``.
    ``decisions(image, status, adjudicator, date, justification, reference_id)``; one valid decision is enough. An empty result
    means that the annotations are complete."""
    needed = report.where("status <> 'accepted'").select("image").distinct()
    known = references.select("reference_id", F.lit(True).alias("_known")).distinct()
    d = join_same(decisions, known, ["reference_id"], "left")
    blank = F.lit(False)
    for c in ("adjudicator", "date", "justification", "reference_id"):
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    rank = F.when(~F.col("status").eqNullSafe("adjudicated"), 2).when(blank, 1).when(F.col("_known").isNull(), 0).otherwise(-1)
    best = d.groupBy("image").agg(F.min(rank).alias("_rank"))
    reason = F.when(F.col("_rank").isNull(), "missing").when(F.col("_rank") == 2, "not_adjudicated").when(F.col("_rank") == 1, "incomplete").when(F.col("_rank") == 0, "unknown_reference")
    return join_same(needed, best, ["image"], "left").withColumn("reason", reason).where("reason IS NOT NULL").select("image", "reason")


def annotation_errors(masks: DataFrame, by: list[str], area: DataFrame) -> DataFrame:
    """A row per position that an annotation may not have: ``outside_area`` (positive outside the object area) or
    ``invalid_positive`` (positive without a valid decision); both can hold at one position."""
    inside = area.select(*AT, F.lit(True).alias("_in")).distinct()
    df = join_same(masks.where("truth"), inside, AT, "left")
    found = F.array_compact(F.array(F.when(F.col("_in").isNull(), F.lit("outside_area")), F.when(~F.coalesce("valid", F.lit(False)), F.lit("invalid_positive"))))
    return df.select(*dict.fromkeys([*by, *AT]), F.explode(found).alias("error"))


def refuse_errors(masks: DataFrame, area: DataFrame) -> DataFrame:
    """The masks themselves; an annotation error is an error of the job that reads them."""
    inside = area.select(*AT, F.lit(True).alias("_in")).distinct()
    df = join_same(masks, inside, AT, "left")
    bad = F.col("truth") & (F.col("_in").isNull() | ~F.coalesce("valid", F.lit(False)))
    fault = F.when(bad, F.raise_error(F.lit("a positive pixel is outside the area or has no valid decision")))
    return df.withColumn("truth", F.coalesce(fault.cast("boolean"), F.col("truth"))).drop("_in")
