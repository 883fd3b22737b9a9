"""Balanced folds of whole groups.

An assignment of groups to folds is scored by, in this order: classes and batches that a fold or its training side lacks, the range
of the folds' object counts, the ranges of group counts per size bin, the range of the folds' median sizes, and the
assignment itself. Scores of all assignments are aggregates over (assignment, group) rows in one plan.

Two folds of up to EXHAUSTIVE groups are enumerated, one row per group and subset, the first group being in fold 0. Otherwise
seeded shuffles, each in a task, are improved by swaps of two groups between folds; a swap changes a few counts, and only
where these tie are medians looked at. A task holds one row a group (an image), as does each start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.operators import audit
from prismata.plans.shared import materialize

EXHAUSTIVE = 12


def group_table(objects: DataFrame, group: str, label: str, batch: str, size: str | None = None, n_bins: int = 3) -> DataFrame:
    """Stored ``group, label, batch, n, median_size, size_bin, place`` per group of the rows without a NULL in these columns; a
    group of two classes or batches is an error. ``place`` counts the groups in order of their names."""
    rows = objects.select(F.col(group).cast("string").alias("group"), F.col(label).cast("string").alias("label"), F.col(batch).cast("string").alias("batch"), (F.col(size).cast("double") if size else F.lit(0.0)).alias("size")).dropna()
    per = rows.groupBy("group").agg(F.min("label").alias("label"), F.max("label").alias("_l"), F.min("batch").alias("batch"), F.max("batch").alias("_b"), F.count("*").alias("n"), F.percentile("size", 0.5).alias("median_size"))
    fault = F.when((F.col("label") != F.col("_l")) | (F.col("batch") != F.col("_b")), F.raise_error(F.concat(F.lit("a group has two classes or batches: "), F.col("group"))))
    per = per.withColumn("label", F.coalesce(fault.cast("string"), F.col("label"))).drop("_l", "_b")
    binned = audit.size_bins(per, [], ["median_size", "group"], n_bins)
    place = F.row_number().over(audit.Window.orderBy("group")) - 1  # one row an image
    return materialize(binned.withColumn("place", place), "fold-groups")


def scored(assigned: DataFrame, n_folds: int) -> DataFrame:
    """``try, incomplete, count_range, bin_range, median_range`` per assignment; ``assigned`` has the columns of
    ``group_table``, ``try`` and ``fold``."""

    def missing(column: str) -> DataFrame:
        cells = assigned.groupBy("try", column).agg(F.count_distinct("fold").alias("k"))
        # a value lacks in every fold that has none of it, and in the training side of the only fold that has it
        return cells.groupBy("try").agg(F.sum(n_folds - F.col("k") + F.when(F.col("k") == 1, 1).otherwise(0)).alias(f"_{column}"))

    per = assigned.groupBy("try", "fold").agg(F.sum("n").alias("n"), F.percentile("median_size", 0.5).alias("m"))
    folds = per.groupBy("try").agg((F.max("n") - F.min("n")).alias("count_range"), (F.max("m") - F.min("m")).alias("median_range"))
    bins = assigned.groupBy("try", "size_bin").agg(*[F.count_if(F.col("fold") == f).alias(f"f{f}") for f in range(n_folds)])
    most, least = (g(*[F.col(f"f{f}") for f in range(n_folds)]) for g in (F.greatest, F.least))
    bins = bins.groupBy("try").agg(F.sum(most - least).alias("bin_range"))
    out = missing("label").join(missing("batch"), "try").join(folds, "try").join(bins, "try")
    return out.select("try", (F.col("_label") + F.col("_batch")).alias("incomplete"), "count_range", "bin_range", "median_range")


def _enumerated(groups: DataFrame, n: int) -> DataFrame:
    """Every split into two folds with the first group in fold 0; ``try`` orders them like their assignments."""
    tries = groups.sparkSession.range(1, 1 << (n - 1)).withColumnRenamed("id", "try")
    bit = F.expr(f"CAST(IF(place = 0, 0, shiftright(try, {n - 1} - place) & 1) AS INT)")
    return tries.crossJoin(F.broadcast(groups)).withColumn("fold", bit)  # EXHAUSTIVE groups at most


class _State:
    """Counts of one assignment, and what a swap would make of them."""

    def __init__(self, pdf: pd.DataFrame, n_folds: int, fold: np.ndarray) -> None:
        self.n_folds, self.fold, self.size = n_folds, fold, pdf["median_size"].to_numpy(float)
        self.codes = [pd.factorize(pdf[c])[0] for c in ("label", "batch", "size_bin")]
        self.n = pdf["n"].to_numpy(np.int64)
        self.counts = [np.zeros((n_folds, c.max() + 1), np.int64) for c in self.codes]
        for c, k in zip(self.counts, self.codes, strict=True):
            np.add.at(c, (fold, k), 1)
        self.total = np.bincount(fold, self.n, n_folds)

    def _move(self, i: int, to: int) -> None:
        for c, k in zip(self.counts, self.codes, strict=True):
            c[self.fold[i], k[i]] -= 1
            c[to, k[i]] += 1
        self.total[self.fold[i]] -= self.n[i]
        self.total[to] += self.n[i]
        self.fold[i] = to

    def swap(self, i: int, j: int) -> None:
        a, b = self.fold[i], self.fold[j]
        self._move(i, b)
        self._move(j, a)

    def coarse(self) -> tuple[int, int, int]:
        lacking = sum(int((c == 0).sum() + (c.sum(0) - c == 0).sum()) for c in self.counts[:2])
        return lacking, int(np.ptp(self.total)), int(np.ptp(self.counts[2], 0).sum())

    def medians(self) -> float:
        return float(np.ptp([np.median(self.size[self.fold == f]) for f in range(self.n_folds)]))


def _improved(groups: DataFrame, n_folds: int, seed: int, starts: int, steps: int) -> DataFrame:
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf["try"].iloc[0])])
        fold = np.arange(len(pdf)) % n_folds
        rng.shuffle(fold)
        state = _State(pdf, n_folds, fold)
        best, gap = state.coarse(), state.medians()
        for i, j in rng.integers(0, len(pdf), (steps, 2)):
            if state.fold[i] == state.fold[j]:
                continue
            state.swap(i, j)
            now = state.coarse()
            wide = state.medians() if now == best else None
            if now < best or (wide is not None and wide < gap):
                best, gap = now, state.medians() if wide is None else wide
            else:
                state.swap(i, j)
        return pdf.assign(fold=state.fold.astype("int32"))

    tried = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(starts - 1).cast("long"))).alias("try"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tried.schema) + ", fold int"
    return materialize(tried.groupBy("try").applyInPandas(search, schema), "fold-starts")


def balanced_folds(objects: DataFrame, group: str, label: str, batch: str, size: str | None = None, n_folds: int = 2, n_bins: int = 3, seed: int = 0, starts: int = 32, steps: int = 4000) -> DataFrame:
    """The columns of ``group_table``, ``fold``, and the score of the chosen assignment on every row."""
    groups = group_table(objects, group, label, batch, size, n_bins)
    n = groups.count()
    if n_folds < 2 or n < n_folds:
        raise ValueError(f"{n} groups do not fill {n_folds} folds")
    every = _enumerated(groups, n) if n_folds == 2 and n <= EXHAUSTIVE else _improved(groups, n_folds, seed, starts, steps)
    rank = ["incomplete", "count_range", "bin_range", "median_range", "try"]
    best = scored(every, n_folds).agg(F.min(F.struct(*rank)).alias("b")).select("b.*")  # one row
    return every.join(F.broadcast(best), "try").drop("try", "place")


def coverage(assigned: DataFrame) -> DataFrame:
    """A row per fold: groups and objects on either side, median size, and whether both sides hold all classes and batches."""
    folds = assigned.select("fold").distinct()
    side = folds.withColumnRenamed("fold", "out").join(assigned, F.lit(True))  # folds are few
    held = F.col("fold") == F.col("out")
    in_fold = lambda c, there: F.count_distinct(F.when(there, F.col(c))) == F.count_distinct(c)
    out = side.groupBy(F.col("out").alias("fold")).agg(
        F.count_if(held).alias("n_validation_groups"), F.count_if(~held).alias("n_training_groups"), F.sum(F.when(held, F.col("n")).otherwise(0)).alias("n_validation_objects"), F.percentile(F.when(held, F.col("median_size")), 0.5).alias("median_validation_size"),
        in_fold("label", held).alias("validation_has_all_classes"), in_fold("batch", held).alias("validation_has_all_batches"), in_fold("label", ~held).alias("training_has_all_classes"), in_fold("batch", ~held).alias("training_has_all_batches"),
    )
    checks = [F.col(f"{s}_has_all_{w}") for s in ("validation", "training") for w in ("classes", "batches")]
    return out.withColumn("coverage_complete", checks[0] & checks[1] & checks[2] & checks[3])
