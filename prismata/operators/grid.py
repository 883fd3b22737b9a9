"""Grids of SIMCA configurations as one plan: the candidate is a column.

Every row of spectra is seen under each data setting (split, chain, sampling) that holds it, in one pass; a setting's
models, references and limits are rows. Settings share one job for MSC references (only where a chain has MSC), one for the
eigensystems, one for the training distances and one for the projection, so that the number of jobs does not grow with
the candidates. A row's distances are kept for every number of components at once: H adds a score a component,
Q loses it.

Rows have ``object``, ``image``, ``class``, ``vec_id``, ``spectrum``, and ``roles``: an array of (split, role), where a split is a
fold or any other pair of training and projected rows and a role is ``fit`` or ``project``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from prismata.operators import simca
from prismata.operators.chain import Chain, catalogue, chain_status, mean_spectrum, row_valid
from prismata.operators.decisions import rates
from prismata.operators.models import chi2_inverse
from prismata.plans.nulls import join_same
from prismata.plans.shared import materialize

EPS = simca.EPS


@dataclass(frozen=True)
class Config:
    """A model configuration. ``m`` pixels per object are drawn by seed, or all are taken (None); ``matrix`` says what the model
    is fitted on: pixels, or one mean or median spectrum per object."""

    chain: str
    k: int
    variant: str = "simple_chi2"
    alpha: float = 0.05
    m: int | None = None
    seed: int = 0
    window: int = 9
    order: int = 2
    matrix: str = "pixels"

    @property
    def data(self) -> str:
        """The name of the data setting, without the split."""
        return f"{self.chain}/{self.matrix}/{self.m}/{self.seed}/{self.window}/{self.order}"


def simple_roles(train: DataFrame, projected: DataFrame, split: str = "all") -> DataFrame:
    """Training and projected rows as one table with roles; columns that both have."""
    role = lambda r: F.array(F.struct(F.lit(split).alias("split"), F.lit(r).alias("role")))
    both = [c for c in train.columns if c in projected.columns]
    return train.select(*both, role("fit").alias("roles")).unionByName(projected.select(*both, role("project").alias("roles")))


def fold_roles(rows: DataFrame, fold: str) -> DataFrame:
    """Every row is projected in its own fold and fits all others."""
    folds = [r[0] for r in rows.select(F.col(fold).cast("string").alias("f")).distinct().orderBy("f").collect()]  # a handful by design
    f = F.col(fold).cast("string")
    return rows.withColumn("roles", F.array(*[F.struct(F.lit(x).alias("split"), F.when(f.eqNullSafe(F.lit(x)), "project").otherwise("fit").alias("role")) for x in folds]))


def _sampled(rows: DataFrame, configs: list[Config], pixel: str) -> DataFrame:
    """Rows of every (matrix, m, seed): drawn pixels, and for object matrices the fit rows as one spectrum an object."""
    kinds = sorted({(c.matrix, c.m, c.seed) for c in configs}, key=str)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("matrix"), F.lit(m).cast("int").alias("m"), F.lit(s).alias("seed")) for x, m, s in kinds])).alias("_s")
    df = rows.select("*", each).select("*", "_s.*").drop("_s")
    if any(m is not None for _, m, _ in kinds):
        w = Window.partitionBy("matrix", "m", "seed", "object").orderBy(F.struct(F.xxhash64("seed", "object", pixel), F.col(pixel)))
        df = df.withColumn("_r", F.row_number().over(w)).where(F.col("m").isNull() | (F.col("_r") <= F.col("m"))).drop("_r")
    if all(x == "pixels" for x, _, _ in kinds):
        return df
    whole = df.where("matrix LIKE 'object%' AND role = 'fit'")
    keys = ["split", "role", "matrix", "m", "seed", "object", "image", "class"]
    value = F.when(F.col("matrix") == "object_mean", F.avg("v")).otherwise(F.percentile("v", 0.5))
    long = whole.select(*keys, F.posexplode("spectrum").alias("band", "v")).groupBy(*keys, "band").agg(value.alias("v"))
    one = long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda x: x["v"]).alias("spectrum"))
    return df.where("NOT (matrix LIKE 'object%' AND role = 'fit')").select(*keys, pixel, "spectrum").unionByName(one.select(*keys, F.lit(None).cast(dict(rows.dtypes)[pixel]).alias(pixel), "spectrum"))


@dataclass
class Grid:
    """The stored tables of a grid. ``events`` says per chain and role how many rows were seen, taken and filtered, counted
    in the pass that projects them."""

    pca: DataFrame
    fits: DataFrame
    scored: DataFrame
    events: DataFrame
    errors: DataFrame
    configs: DataFrame
    target: str

    def pixels(self, role: str = "project") -> DataFrame:
        """One row per projected (or ``fit``) pixel and configuration: statistic, limit, ratio, signed margin, acceptance
        (strictly below the limit) and decision (margin of 0 or more)."""
        cells = self.configs.join(self.fits.where("status = 'ok'"), ["setting", "k", "alpha"])
        df = self.scored.where(F.col("role") == role).join(F.broadcast(cells) if self.small else cells, "setting")
        df = df.withColumns({"h": F.element_at("hs", F.col("k")), "q": F.element_at("qs", F.col("k"))})
        stats = simca.statistics()
        names = {v: (s, x) for v, (s, x) in simca.VARIANTS.items() if s != "emp_sum" and (not isinstance(x, str) or x in simca.LIMITS)}
        pick = lambda i: F.coalesce(*[F.when(F.col("variant") == v, stats[n[0]] if i == 0 else (F.col(n[1]) if isinstance(n[1], str) else F.lit(n[1]))) for v, n in names.items()])
        df = df.withColumns({"statistic": pick(0), "limit": pick(1)}).where("limit > 0")
        ratio = F.col("statistic") / F.col("limit")
        df = df.withColumns({"ratio": ratio, "margin": 1 - ratio, "accepted": F.col("statistic") < F.col("limit"), "decision": F.col("statistic") <= F.col("limit"), "truth": F.col("class") == self.target})
        return df.select("setting", "split", *_NAMES, "vec_id", "object", "image", "class", "truth", "h", "q", "statistic", "limit", "ratio", "margin", "accepted", "decision")

    def objects(self, pixels: DataFrame | None = None) -> DataFrame:
        """One row per configuration and object: pixels, share accepted, mean margin."""
        p = self.pixels() if pixels is None else pixels
        return p.groupBy("setting", "split", *_NAMES, "object").agg(F.min("image").alias("image"), F.max("class").alias("class"), F.count("*").alias("n_pixels"), F.avg(F.col("decision").cast("double")).alias("ratio"), F.avg("margin").alias("mean_margin"), F.max(F.col("truth").cast("int")).cast("boolean").alias("truth"))

    def metrics(self, thresholds: list[float], objects: DataFrame | None = None) -> DataFrame:
        """Rates of object decisions per configuration and threshold, and a row with its ``error`` for each that has no fit."""
        o = self.objects() if objects is None else objects
        grid = o.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).withColumn("prediction", F.col("ratio") >= F.col("threshold"))
        good = grid.groupBy("setting", "split", *_NAMES, "threshold").agg(*rates())
        return good.unionByName(self.errors, allowMissingColumns=True).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))

    def shift(self) -> DataFrame:
        """Per split and configuration training rows against projected rows: mean and deviation (ddof 1) of H, Q, ratio and
        margin in training, their standardised shifts (a zero deviation gives 0 or an infinity), ``out_of_domain_rate``, the
        share of projected rows at the limit or beyond, and ``target_rejection_rate``, that of target rows with a margin
        below 0."""
        by = ["setting", "split", *_NAMES]
        both = [self.pixels(r).groupBy(*by) for r in ("fit", "project")]
        values = ("h", "q", "ratio", "margin")
        train = both[0].agg(F.count("*").alias("n_train"), *[x for v in values for x in (F.avg(v).alias(f"train_{v}_mean"), F.stddev_samp(v).alias(f"train_{v}_sd"))])
        proj = both[1].agg(F.count("*").alias("n_projection"), *[F.avg(v).alias(f"_{v}") for v in values], F.avg((F.col("ratio") >= 1).cast("double")).alias("out_of_domain_rate"), F.avg(F.when(F.col("truth"), (F.col("margin") < 0).cast("double"))).alias("target_rejection_rate"))
        out = join_same(train, proj, by)
        for v in values:
            gap, sd = F.col(f"_{v}") - F.col(f"train_{v}_mean"), F.col(f"train_{v}_sd")
            z = F.when(sd > 0, gap / F.nullif(f"train_{v}_sd", F.lit(0.0))).when(gap == 0, 0.0).when(gap > 0, float("inf")).when(gap < 0, float("-inf"))
            out = out.withColumn(f"{v}_shift", z).drop(f"_{v}")
        return out

    def fit_diagnostics(self) -> DataFrame:
        """Per split, data setting and number of components: rows, rank, explained share, limits and status."""
        share = F.aggregate(F.slice("eigenvalues", 1, F.col("k")), F.lit(0.0), lambda a, x: a + x) / F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x)
        e = self.pca.select(F.col("model").alias("setting"), "eigenvalues")
        return self.fits.join(e, "setting", "left").withColumn("explained", share).select("setting", "k", "alpha", "n", "rank", "explained", "h_limit", "q_limit", "dd_limit", "combined_limit", "status")

    def rule_diagnostics(self) -> DataFrame:
        """Per split and configuration: projected rows, share accepted of target rows and of the others, mean margin."""
        rate = lambda when: F.avg(F.when(when, F.col("accepted").cast("double")))
        return self.pixels().groupBy("setting", "split", *_NAMES).agg(F.count("*").alias("n_rows"), rate(F.col("truth")).alias("target_accept_rate"), rate(~F.col("truth")).alias("other_accept_rate"), F.avg("margin").alias("mean_margin"))

    @property
    def small(self) -> bool:
        return self.fits.count() * 200 <= simca.SENT


_NAMES = ["chain", "matrix", "k", "variant", "alpha", "m", "seed"]


def _chain(c: Config) -> Chain:
    return Chain(catalogue()[c.chain], c.window, c.order)


def _setting() -> Column:
    return F.concat_ws("/", "split", "data")


def _views(sampled: DataFrame, configs: list[Config], bands: int, refs: DataFrame | None) -> tuple[DataFrame, Column]:
    """Rows under every chain of their sampling, up to MSC (and through it where ``refs`` are given), with ``_ok``: whether
    the chain can take the row."""
    chains: dict[str, tuple[Config, Chain]] = {}
    for c in configs:
        chains.setdefault(c.data, (c, _chain(c)))
    cells, after = [], None
    for data, (c, chain) in chains.items():
        chain.bands = bands
        n = chain.steps.index("msc") if "msc" in chain.steps else len(chain.steps)
        head = reduce(lambda s, i: chain._step(i, s), range(n), F.col("spectrum"))  # noqa: B023
        ok = row_valid("spectrum", chain.steps, chain.nonpositive)
        mine = (F.col("matrix") == c.matrix) & F.col("m").eqNullSafe(F.lit(c.m).cast("int")) & (F.col("seed") == c.seed)
        cells.append(F.when(mine, F.struct(F.lit(data).alias("data"), F.lit("msc" in chain.steps).alias("_msc"), ok.alias("_ok"), F.when(ok, head).alias("_x"))))
        if n < len(chain.steps):
            rest = F.when(F.col("_msc"), chain.msc_by(F.col("_x"), F.col("_ref"), n))
            after = F.when(F.col("data") == data, rest) if after is None else after.when(F.col("data") == data, rest)
    df = sampled.select("*", F.explode(F.array_compact(F.array(*cells))).alias("_c")).drop("spectrum").select("*", "_c.*").drop("_c").withColumn("setting", _setting())
    if refs is not None:
        df = df.join(F.broadcast(refs), "setting", "left")
        df = df.withColumn("_x", F.when(~F.col("_msc"), F.col("_x")).otherwise(after)).drop("_ref")
    return df, F.col("_ok")


def _distances(views: DataFrame, pca: DataFrame, most: int) -> DataFrame:
    """Rows (without spectra) with ``hs`` and ``qs``: H and Q under their setting's model for 1 to ``most`` components. Models
    are sent to the tasks up to a checked size; beyond it each row meets its own by a join."""
    slim = pca.select(F.col("model").alias("setting"), "mean", F.slice("eigenvalues", 1, most).alias("l"), F.slice("loadings", 1, most).alias("p"))
    keep = [c for c in views.columns if c not in ("_x", "_ok", "_msc")]
    n, b = pca.agg(F.count("*"), F.max(F.size("mean"))).first()
    sent = n * (b or 0) * (most + 1) * 8 <= simca.SENT
    models = {r.setting: (np.array(r.mean), np.array(r.l), np.array(r.p)) for r in slim.collect()} if sent else None
    df = views.select(*keep, "_x") if sent else views.select(*keep, "_x").join(slim, "setting")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column("setting").to_pylist(), object)
            for name in dict.fromkeys(names):
                at = np.flatnonzero(names == name)
                if models is None:
                    one = batch.slice(at[0], 1).to_pylist()[0]
                    mean, values, loadings = np.array(one["mean"]), np.array(one["l"]), np.array(one["p"])
                elif name in models:
                    mean, values, loadings = models[name]
                else:
                    continue
                x = batch.column("_x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) - mean
                t = x @ loadings.T
                t2 = t * t
                hs = np.cumsum(t2 / np.maximum(values, EPS), 1)
                qs = np.maximum(0, (x * x).sum(1)[:, None] - np.cumsum(t2, 1))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in keep], pa.array(list(hs), pa.list_(pa.float64())), pa.array(list(qs), pa.list_(pa.float64()))], names=[*keep, "hs", "qs"])

    schema = views.select(*keep, F.array(F.lit(0.0)).alias("hs"), F.array(F.lit(0.0)).alias("qs")).schema
    return df.mapInArrow(run, schema)


@F.pandas_udf(DoubleType())
def _quantile(dof: pd.Series, p: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=dof.index)
    for level in p.dropna().unique():
        at = (p == level) & dof.notna() & (dof > 0)
        out[at] = chi2_inverse(level, dof[at].to_numpy())
    return out


def _limits(pca: DataFrame, own: DataFrame, cells: DataFrame) -> DataFrame:
    """Limits of every (setting, k, alpha) as ``simca.fit`` has them: k degrees for H, Box's for Q from the residual
    eigenvalues, or the moments of the training rows' Q where none is left, and the scaled combined index."""
    k, p = F.col("k"), 1 - F.col("alpha")
    df = cells.join(pca.select(F.col("model").alias("setting"), "n", "eigenvalues", "rank", F.size("mean").alias("bands")), "setting", "left")
    rest = F.filter(F.slice("eigenvalues", k + 1, 1_000_000), lambda x: x > EPS)
    df = df.withColumns({"h0": F.greatest(k * (F.col("n") - 1) / F.col("n"), F.lit(EPS)), "_rest": rest})
    df = df.withColumns({"_q1": F.aggregate("_rest", F.lit(0.0), lambda a, x: a + x), "_q2": F.aggregate("_rest", F.lit(0.0), lambda a, x: a + x * x)})
    q = own.select("setting", F.posexplode("qs").alias("i", "q")).groupBy("setting", (F.col("i") + 1).alias("k")).agg(F.avg("q").alias("_mq"), F.var_pop("q").alias("_vq"))
    df = df.join(q, ["setting", "k"], "left")
    fallback = F.greatest(F.col("bands") - k, F.lit(1)).cast("double")
    box = F.size("_rest") > 0
    by_moments = F.when((F.col("_vq") <= EPS) | (F.col("_mq") <= EPS), fallback).otherwise(2 * F.col("_mq") * F.col("_mq") / F.nullif("_vq", F.lit(0.0)))
    nq = F.when(box, F.when(F.col("_q2") > EPS, F.col("_q1") * F.col("_q1") / F.nullif("_q2", F.lit(0.0))).otherwise(fallback)).otherwise(by_moments)
    status = F.when(F.col("n").isNull(), "no_target_row").when(F.col("n") <= k, "too_few_rows").when(F.col("rank") < k, "components_above_rank").otherwise("ok")
    df = df.withColumns({"q0": F.greatest(F.when(box, F.col("_q1")).otherwise(F.col("_mq")), F.lit(EPS)), "nq": F.greatest(nq, F.lit(EPS)), "nh": k.cast("double"), "status": status})
    good = F.col("status") == "ok"
    limit = lambda mean, dof: F.when(good, F.greatest(F.col(mean) / F.col(dof) * _quantile(F.col(dof), p), F.lit(EPS)))
    df = df.withColumns({"h_limit": limit("h0", "nh"), "q_limit": limit("q0", "nq"), "dd_limit": F.when(good, _quantile(F.col("nh") + F.col("nq"), p))})
    df = materialize(df.drop("_rest", "_q1", "_q2", "_mq", "_vq"), "grid-limits")
    c = own.join(df.where(good).select("setting", "k", "alpha", "h_limit", "q_limit"), "setting")
    c = c.select("setting", "k", "alpha", (F.element_at("hs", k) / F.col("h_limit") + F.element_at("qs", k) / F.col("q_limit")).alias("c"))
    stats = c.groupBy("setting", "k", "alpha").agg(F.avg("c").alias("_c0"), F.var_pop("c").alias("_vc"))
    nc = F.greatest(F.when(F.col("_vc") <= EPS, 1e6).otherwise(2 * F.col("_c0") * F.col("_c0") / F.nullif("_vc", F.lit(0.0))), F.lit(EPS))
    df = df.join(stats, ["setting", "k", "alpha"], "left").withColumn("_nc", nc)
    return materialize(df.withColumn("combined_limit", F.when(good, F.col("_c0") / F.col("_nc") * _quantile(F.col("_nc"), p))).drop("_c0", "_vc", "_nc", "eigenvalues"), "grid-fits")


def fit_grid(rows: DataFrame, configs: list[Config], target: str, pixel: str = "vec_id") -> Grid:
    """Fit every configuration on every split's fit rows of the ``target`` class (a chain's MSC reference on all its fit rows),
    and score all rows that fit or are projected."""
    for c in configs:
        _chain(c)  # refuses what is no chain
    spark = rows.sparkSession
    base = rows.select("object", "image", F.col("class").cast("string").alias("class"), pixel, "spectrum", F.explode("roles").alias("_r")).select("*", "_r.*").drop("_r")
    bands = rows.select(F.size("spectrum").alias("b")).agg(F.max("b")).first()[0] or 0
    sampled = _sampled(base, configs, pixel)
    refs = None
    if any("msc" in catalogue()[c.chain] for c in configs):
        head, ok = _views(sampled.where("role = 'fit'"), [c for c in configs if "msc" in catalogue()[c.chain]], bands, None)
        refs = mean_spectrum(head.where(ok), ["setting"], "_x").withColumnRenamed("mean", "_ref")
        # without a reference that varies a setting has no rows, and so no model
        refs = materialize(refs.where(F.array_max("_ref") - F.array_min("_ref") > EPS), "grid-references")
    views, ok = _views(sampled, configs, bands, refs)
    kept = (F.col("role") == "project") | (F.col("class") == target)
    train = views.where(ok & F.col("_x").isNotNull() & (F.col("role") == "fit") & (F.col("class") == target))
    pca = simca.eigensystems(train.select("setting", "_x"), "setting", "_x")
    most = max(c.k for c in configs)
    datas = sorted({c.data for c in configs})
    seen = Observation("grid-rows")
    count = lambda d, r, when: F.count_if((F.col("data") == d) & (F.col("role") == r) & when)
    names = [(i, d, r) for i, d in enumerate(datas) for r in ("fit", "project")]
    watched = views.observe(seen, *[x for i, d, r in names for x in (count(d, r, F.lit(True)).alias(f"{i}_{r}_in"), count(d, r, ok).alias(f"{i}_{r}_taken"))])
    scored = _distances(watched.where(kept & ok & F.col("_x").isNotNull()), pca, most)
    scored = materialize(scored.select("setting", "split", "role", "object", "image", "class", F.col(pixel).alias("vec_id"), "hs", "qs"), "grid-scored")
    got = seen.get
    events = spark.createDataFrame([(d, r, int(got[f"{i}_{r}_in"]), int(got[f"{i}_{r}_taken"]), int(got[f"{i}_{r}_in"] - got[f"{i}_{r}_taken"])) for i, d, r in names], "data string, role string, n_input_rows long, n_valid_rows long, n_filtered_rows long")
    splits = base.select("split").distinct()
    named = spark.createDataFrame([(c.data, c.chain, c.matrix, c.k, c.variant, c.alpha, c.m, c.seed) for c in dict.fromkeys(configs)], "data string, chain string, matrix string, k int, variant string, alpha double, m int, seed int")
    named = materialize(splits.crossJoin(F.broadcast(named)).withColumn("setting", _setting()).drop("data"), "grid-configs")  # configurations are a parameter
    cells = named.select("setting", "k", "alpha").distinct()
    fits = _limits(pca, scored.where(F.col("role") == "fit"), cells)
    errors = named.join(fits.where("status <> 'ok'").select("setting", "k", "alpha", F.col("status").alias("error")), ["setting", "k", "alpha"])
    return Grid(pca, fits, scored, events, errors.select("setting", "split", *_NAMES, "error"), named.drop("split"), target)


def leave_out_means(df: DataFrame, key: str, fold: str, spectrum: str) -> DataFrame:
    """``(key, fold, mean)``: band-wise means of a key's rows outside each of its folds, as differences of band sums; none for a
    key of one fold."""
    sums = df.select(key, fold, F.posexplode(spectrum).alias("i", "v")).groupBy(key, fold, "i").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    total = sums.groupBy(key, "i").agg(F.sum("v").alias("_v"), F.sum("n").alias("_n"))
    left = join_same(sums, total, [key, "i"]).where("_n > n").select(key, fold, "i", ((F.col("_v") - F.col("v")) / (F.col("_n") - F.col("n"))).alias("r"))
    return left.groupBy(key, fold).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("mean"))


def cross_validated(rows: DataFrame, chain: Chain, key: str, group: str, k: int, alpha: float, folds: int | None = None, keep: list[str] | None = None, spectrum: str = "spectrum") -> DataFrame:
    """``simca.cv_distances`` for a chain that is fitted anew without each fold: a fold's MSC reference is the class's band
    sums less the fold's own, over the rows left. Rows then meet the references of all folds of their class but their own in one
    pass, which gives the folds' factors, and their own fold's for the held-out distances."""
    rows = rows.where(row_valid(spectrum, chain.steps, chain.nonpositive))
    fold = F.col(group).cast("string") if folds is None else F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(folds)).cast("string")
    first = rows.select(F.size(spectrum)).first()
    chain.bands = first[0] if first else 0
    n = chain.steps.index("msc") if "msc" in chain.steps else len(chain.steps)
    head = reduce(lambda s, i: chain._step(i, s), range(n), F.col(spectrum))
    df = materialize(rows.select(F.col(key).cast("string").alias("_class"), fold.alias("_fold"), *(keep or []), head.alias("_x")), "cv-rows")
    refs = leave_out_means(df, "_class", "_fold", "_x").withColumnRenamed("mean", "_ref")
    refs = materialize(refs, "cv-references").select(F.col("_class").alias("_c"), F.col("_fold").alias("_out"), "_ref")
    refs = F.broadcast(refs) if refs.count() * chain.bands * 8 <= simca.SENT else refs
    met = df.join(refs, F.col("_class").eqNullSafe(F.col("_c")))
    corrected = chain.msc_by(F.col("_x"), F.col("_ref"), n) if n < len(chain.steps) else F.col("_x")
    met = met.withColumns({"_fit": F.to_json(F.struct(F.col("_class").alias("c"), F.col("_out").alias("f"))), "spectrum": corrected, "_own": F.col("_fold") == F.col("_out")})
    models = simca.eigensystems(met.where("NOT _own"), "_fit", "spectrum").where(F.col("n") > k)
    return simca.held_out(met.where("_own").select("_fit", "_class", "_fold", *(keep or []), "spectrum"), materialize(models, "cv-models"), k, alpha, keep or [])


def configuration_status(rows: DataFrame, configs: list[Config], targets: list[str], least_objects: int = 1) -> DataFrame:
    """One row per configuration and target class: ``valid``, or the first reason against fitting it on the rows' fit roles:
    a chain or window that cannot be, a class that is missing or alone, ``m`` that is not positive or that too few of the
    class's objects reach, and k and alpha outside their ranges."""
    spark = rows.sparkSession
    fit = rows.where(F.exists("roles", lambda r: r["role"] == "fit"))
    facts = fit.agg(F.max(F.size("spectrum")).alias("bands"), F.count_distinct("class").alias("n_classes"))
    sizes = fit.groupBy(F.col("class").cast("string").alias("_class"), "object").agg(F.count("*").alias("n"))
    plan = spark.createDataFrame([(c.chain, list(catalogue().get(c.chain, (c.chain,))), c.window, c.order, c.k, c.variant, c.alpha, c.m, c.seed, c.matrix, t) for c in configs for t in targets], "chain string, steps array<string>, window int, order int, k int, variant string, alpha double, m int, seed int, matrix string, target string")
    plan = plan.withColumn("_id", F.monotonically_increasing_id())
    plan = materialize(plan, "grid-plan")
    met = plan.select("_id", "m", "target").join(sizes, F.col("target") == F.col("_class"), "left")
    per = met.groupBy("_id").agg(F.count("object").alias("n_objects"), F.count_if(F.col("n") >= F.col("m")).alias("n_reach"), F.coalesce(F.sum(F.when(F.col("m").isNull(), F.col("n")).otherwise(F.least("n", "m"))), F.lit(0)).alias("n_rows"))
    df = plan.join(per, "_id").crossJoin(F.broadcast(facts))  # one row
    chain = chain_status(F.col("steps"), F.col("bands"), F.col("window"), F.col("order"))
    n = F.when(F.col("matrix").startswith("object"), F.col("n_objects")).otherwise(F.col("n_rows"))
    k, alpha = F.col("k"), F.col("alpha")
    status = (
        F.when(chain != "valid", chain)
        .when(~F.col("variant").isin(*simca.VARIANTS), "unknown_rule")
        .when(~F.col("matrix").isin("pixels", "object_mean", "object_median"), "unknown_matrix")
        .when(F.col("n_objects") == 0, "target_class_missing")
        .when(F.col("n_classes") < 2, "one_class_only")
        .when(F.col("m") <= 0, "m_not_positive")
        .when(F.col("m").isNotNull() & (F.col("n_reach") < least_objects), "too_few_pixels_an_object")
        .when(k < 1, "components_not_positive")
        .when((alpha <= 0) | (alpha >= 1), "alpha_out_of_range")
        .when(k > F.col("bands"), "components_above_bands")
        .when(k >= n, "too_few_target_rows")
        .otherwise("valid")
    )
    return df.select("chain", "window", "order", "k", "variant", "alpha", "m", "seed", "matrix", "target", "n_objects", n.alias("n_rows"), status.alias("status"))
