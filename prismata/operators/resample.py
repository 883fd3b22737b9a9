"""Resampling of sufficient statistics: one pass over the spectra, then bootstraps, folds and partitions as weighted sums.

``statistics`` keeps one QR triangle per key and group (an image). A resample is a table of weights ``(run, group, w)``: how
often a bootstrap drew the group, or 1 for the groups of a training side. ``weighted_sums`` adds the groups' Gram matrices for
all runs in one job: a task multiplies its groups into the runs that hold them, and the tasks' sums meet per run. Gram
matrices are taken about the key's mean, which the triangles give, so that a large offset does not cancel. Means, covariances,
their eigenvectors, and mean H and Q of held-out groups follow from these sums alone; no spectrum is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators import factor
from prismata.plans.shared import materialize

HELD = 256 << 20  # bytes of sums that a task holds before it passes them on
SUMS = "key string, run string, n double, centre array<double>, total array<double>, gram array<double>"
FITS = "key string, run string, n double, mean array<double>, eigenvalues array<double>, loadings array<array<double>>"


def statistics(df: DataFrame, key: str, group: str, spectrum: str) -> DataFrame:
    """``key, group, n, width, triangle`` (strings, NULL is a value): the only pass over the spectra."""
    named = df.withColumn("_k", F.to_json(F.struct(F.col(key).cast("string").alias("k"), F.col(group).cast("string").alias("g"))))
    both = F.from_json("model", "k string, g string")
    return factor.factors(named, "_k", spectrum).select(both["k"].alias("key"), both["g"].alias("group"), "n", "width", "triangle")


def bootstrap_weights(groups: DataFrame, group: str, replicates: int, seed: int = 1) -> DataFrame:
    """``run, group, w``: each replicate draws as many groups as there are, with repeats, by hashes of seed, replicate and
    draw. ``groups`` holds every group once."""
    named = groups.select(F.col(group).cast("string").alias("group")).withColumn("_i", F.row_number().over(Window.orderBy("group")) - 1)  # one row an image
    named = materialize(named, "bootstrap-groups")
    n = named.count()
    draws = groups.sparkSession.range(replicates).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(1), F.lit(max(n, 1)))).alias("d"))
    drawn = draws.groupBy("r", F.pmod(F.xxhash64(F.lit(seed), "r", "d"), F.lit(max(n, 1))).alias("_i")).agg(F.count("*").cast("double").alias("w"))
    return drawn.join(named, "_i").select(F.format_string("boot_%05d", "r").alias("run"), "group", "w")


def fold_weights(assignment: DataFrame, partition: str, group: str, fold: str, held: bool = False) -> DataFrame:
    """``run, group, w`` of ``assignment(partition, group, fold)``: per partition and fold the groups of the other folds, or
    with ``held`` its own. A run is called ``<partition>/<fold>``."""
    a = assignment.select(F.col(partition).cast("string").alias("p"), F.col(group).cast("string").alias("group"), F.col(fold).cast("string").alias("f")).distinct()
    run = lambda p, f: F.concat(p, F.lit("/"), f)
    if held:
        return a.select(run(F.col("p"), F.col("f")).alias("run"), "group", F.lit(1.0).alias("w"))
    folds = a.select("p", F.col("f").alias("out")).distinct()
    return a.join(folds, "p").where("f <> out").select(run(F.col("p"), F.col("out")).alias("run"), "group", F.lit(1.0).alias("w"))


def _centres(stats: DataFrame) -> DataFrame:
    """``key, centre``: the mean of all rows of a key, from the first rows of its triangles."""
    first = F.transform(F.slice("triangle", 2, F.col("width")), lambda v: v / F.col("triangle")[0])
    cells = stats.select("key", "n", F.posexplode(first).alias("i", "v")).groupBy("key", "i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
    return cells.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))


def weighted_sums(stats: DataFrame, weights: DataFrame) -> DataFrame:
    """Stored rows of SUMS per key and run: weighted count, and sums and Gram matrix of the rows about ``centre``. Groups
    that a run does not name weigh 0; a run without rows of a key has no row there."""
    centres = _centres(stats).withColumnRenamed("key", "_key")
    runs = weights.where("w <> 0").groupBy("group").agg(F.collect_list(F.struct("run", "w")).alias("runs")).withColumnRenamed("group", "_group")
    df = stats.join(centres, F.col("key").eqNullSafe(F.col("_key"))).join(runs, F.col("group").eqNullSafe(F.col("_group"))).select("key", "n", "width", "triangle", "centre", "runs")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        size = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame([(k, r, n, c.tolist(), s.tolist(), g.ravel().tolist()) for (k, r), (n, c, s, g) in held.items()], columns=[x.split()[0] for x in SUMS.split(", ")])

        for pdf in frames:
            for key, n, width, triangle, centre, runs in pdf.itertuples(index=False):
                mean, rest = factor.centred(np.asarray(triangle, float).reshape(-1, width + 1))
                centre = np.asarray(centre, float)
                gap = mean - centre
                gram = rest.T @ rest + n * np.outer(gap, gap)
                for r in runs:
                    h = held.get((key, r["run"]))
                    if h is None:
                        h = held[key, r["run"]] = [0.0, centre, np.zeros(width), np.zeros((width, width))]
                        size += 8 * width * (width + 2)
                    h[0] += r["w"] * n
                    h[2] += r["w"] * n * gap
                    h[3] += r["w"] * gram
                if size > HELD:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0].to_dict()
        row |= {"n": pdf["n"].sum(), "total": np.sum(np.stack(pdf["total"]), 0).tolist(), "gram": np.sum(np.stack(pdf["gram"]), 0).tolist(), "centre": list(row["centre"])}
        return pd.DataFrame([row])

    return materialize(df.mapInPandas(run, SUMS).groupBy("key", "run").applyInPandas(add, SUMS), "weighted-sums")


def _solved(n: float, centre, total, gram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, eigenvalues (n - 1), descending, and vectors as rows, the largest entry of each positive."""
    total, b = np.asarray(total, float), len(total)
    value, vector = np.linalg.eigh((np.asarray(gram, float).reshape(b, b) - np.outer(total, total) / n) / max(1.0, n - 1))
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1].T
    sign = np.sign(vector[np.arange(b), np.abs(vector).argmax(1)])
    return np.asarray(centre, float) + total / n, value, vector * np.where(sign == 0, 1, sign)[:, None]


def fits(sums: DataFrame) -> DataFrame:
    """Rows of FITS from rows of SUMS."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                mean, value, vector = _solved(r.n, r.centre, r.total, r.gram)
                out.append((r.key, r.run, r.n, mean.tolist(), value.tolist(), vector.tolist()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FITS.split(", ")])

    return sums.mapInPandas(solve, FITS)


def held_out_metrics(train: DataFrame, held: DataFrame, k: int, eps: float = 1e-12) -> DataFrame:
    """``key, run, n_train, n_held, explained, mean_h, mean_q, train_q, shift``: the share that ``k`` components explain, mean
    H and Q of the held-out rows under the model of the training rows, the training rows' mean Q, and the distance of the
    means over the root of the training trace, from the SUMS of either side."""
    schema = "key string, run string, n_train double, n_held double, explained double, mean_h double, mean_q double, train_q double, shift double"
    h = held.select(F.col("key").alias("_key"), F.col("run").alias("_run"), F.col("n").alias("m"), F.col("total").alias("held_total"), F.col("gram").alias("held_gram"))
    both = train.join(h, F.col("key").eqNullSafe(F.col("_key")) & (F.col("run") == F.col("_run"))).drop("_key", "_run")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                mean, value, vector = _solved(r.n, r.centre, r.total, r.gram)
                gap, total, b = mean - np.asarray(r.centre, float), np.asarray(r.held_total, float), len(mean)
                about = np.asarray(r.held_gram, float).reshape(b, b) - np.outer(total, gap) - np.outer(gap, total) + r.m * np.outer(gap, gap)
                scores = np.einsum("ij,jk,ik->i", vector[:k], about, vector[:k])
                whole = value.sum()
                out.append((r.key, r.run, r.n, r.m, value[:k].sum() / whole if whole > eps else None, (scores / np.maximum(value[:k], eps)).sum() / r.m, max(0.0, about.trace() - scores.sum()) / r.m, value[k:].sum() * (r.n - 1) / r.n, np.linalg.norm(total / r.m - gap) / (np.sqrt(whole) + eps)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return both.mapInPandas(measure, schema)


def partition_metrics(stats: DataFrame, assignment: DataFrame, k: int, partition: str = "partition", group: str = "group", fold: str = "fold") -> DataFrame:
    """``held_out_metrics`` of every fold of every partition, with ``partition`` and ``fold``, in one job."""
    a = assignment.select(partition, group, fold)
    train, held = (weighted_sums(stats, fold_weights(a, partition, group, fold, side)) for side in (False, True))
    out = held_out_metrics(train, held, k)
    return out.select("key", F.substring_index("run", "/", 1).alias("partition"), F.substring_index("run", "/", -1).alias("fold"), *[c for c in out.columns if c not in ("key", "run")])


def loading_runs(reference: DataFrame, runs: DataFrame) -> DataFrame:
    """``candidate, run, loadings`` for ``pca_metrics.loading_stability``: the reference's name sorts before all runs."""
    return reference.select(F.col("key").alias("candidate"), F.lit("").alias("run"), "loadings").unionByName(runs.select(F.col("key").alias("candidate"), "run", "loadings"))


def stability_by_type(compared: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per candidate and type of run (``types``: name and the beginning of its runs' names) the number of runs and means over
    them of subspace instability, and of loading correlation and angle of the first component; types are reduced apart."""
    kind = F.coalesce(*[F.when(F.col("run").startswith(p), F.lit(n)) for n, p in types.items()])
    runs = compared.where("run <> ''").withColumn("run_type", kind).where("run_type IS NOT NULL AND component = 1")
    return runs.groupBy("candidate", "run_type").agg(F.count("*").alias("n_runs"), F.avg(1 - F.col("subspace_similarity")).alias("subspace_instability"), F.avg("loading_abs_correlation").alias("loading_abs_correlation"), F.avg("loading_angle_deg").alias("loading_angle_deg"), F.max("max_principal_angle_deg").alias("max_principal_angle_deg"))
