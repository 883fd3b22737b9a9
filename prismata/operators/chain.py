"""Preprocessing chains: ordered steps on a spectrum, fitted on calibration rows only."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.functions import spectra as sp

# fixed values: step names
STEPS = ("raw", "absorbance", "snv", "msc", "vector_norm", "sg_smooth", "sg_d1", "sg_d2")
SG = {"sg_smooth": 0, "sg_d1": 1, "sg_d2": 2}


def catalogue() -> dict[str, tuple[str, ...]]:
    """Every chain by name: each step alone, absorbance or SNV before a Savitzky-Golay step, absorbance before SNV or
    MSC, and absorbance, SNV and a Savitzky-Golay step."""
    chains = [(s,) for s in STEPS] + [("absorbance", "snv"), ("absorbance", "msc")]
    chains += [(*head, sg) for head in (("absorbance",), ("snv",), ("absorbance", "snv")) for sg in SG]
    return {"_".join(c): c for c in chains}


def parse_steps(text: Column) -> Column:
    """Array of steps from a JSON list or a chain name; compound step names stay whole. NULL gives an empty array."""
    t = F.trim(text)
    listed = F.transform(F.from_json(t, "array<string>"), lambda x: F.trim(x))
    plain = F.regexp_replace(F.lower(t), "[+ -]", "_")
    plain = F.regexp_replace(plain, "savitzky_golay_(smooth|d1|d2)", "sg_$1")
    plain = F.regexp_replace(F.regexp_replace(plain, "(?<=^|_)vector_+norm(?=_|$)", "vector~norm"), "(?<=^|_)sg_+(smooth|d1|d2)(?=_|$)", "sg~$1")
    named = F.transform(F.split(plain, "_"), lambda x: F.replace(x, F.lit("~"), F.lit("_")))
    steps = F.when(t.rlike(r"^\[.*\]$") & listed.isNotNull(), listed).otherwise(named)
    return F.coalesce(F.filter(steps, lambda x: x != ""), F.array().cast("array<string>"))


def chain_status(steps: Column, bands: Column, window: Column, order: Column) -> Column:
    """``valid`` or the first rule that a chain breaks. A chain without a Savitzky-Golay step needs no window."""
    n_sg = F.size(F.filter(steps, lambda x: x.isin(*SG)))
    deriv = F.when(F.array_contains(steps, "sg_d2"), 2).when(F.array_contains(steps, "sg_d1"), 1).otherwise(0)
    return (
        F.when(F.exists(steps, lambda x: ~x.isin(*STEPS)), "unknown_step")
        .when(F.array_contains(steps, "raw") & (F.size(steps) > 1), "raw_not_alone")
        .when(n_sg > 1, "several_sg_steps")
        .when(n_sg == 0, "valid")
        .when(window < 5, "window_too_small")
        .when(window % 2 == 0, "window_even")
        .when(window > bands, "window_exceeds_bands")
        .when((order < 0) | (order >= window), "order_not_below_window")
        .when(deriv > order, "derivative_above_order")
        .otherwise("valid")
    )


def sg_pairs(steps: tuple[str, ...], windows: list[int], orders: list[int], bands: int) -> list[tuple[int, int]]:
    """Window and order pairs that a chain can use; one placeholder pair without a Savitzky-Golay step."""
    deriv = [SG[s] for s in steps if s in SG]
    if not deriv:
        return [(windows[0], orders[0])]
    return [(w, o) for w in windows for o in orders if w >= 5 and w % 2 and w <= bands and 0 <= o < w and deriv[0] <= o]


def row_valid(spectrum: str, steps: tuple[str, ...], nonpositive: str = "error") -> Column:
    """Rows that a chain can take: finite, and positive throughout where strict absorbance needs it."""
    ok = F.forall(spectrum, sp.finite)
    return ok & F.forall(spectrum, lambda x: x > 0) if "absorbance" in steps and nonpositive == "error" else ok


def validity_report(df: DataFrame, by: list[str], spectrum: str, steps: tuple[str, ...], nonpositive: str = "error") -> DataFrame:
    finite, valid = F.forall(spectrum, sp.finite), row_valid(spectrum, steps, nonpositive)
    return df.groupBy(*by).agg(F.count("*").alias("n_input_rows"), F.count_if(valid).alias("n_valid_rows"), F.count_if(~valid).alias("n_filtered_rows"), F.count_if(~finite).alias("n_nonfinite_rows"), F.count_if(finite & ~valid).alias("n_nonpositive_absorbance_rows"))


def mean_spectrum(df: DataFrame, by: list[str], spectrum: str) -> DataFrame:
    """``(by, mean array)`` per group: band-wise means, partial sums per task."""
    long = df.select(*by, F.posexplode(spectrum).alias("band", "v")).groupBy(*by, "band").agg(F.avg("v").alias("v"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda x: x["v"]).alias("mean"))


@dataclass
class Chain:
    """``fit`` on calibration rows, then ``transform`` any rows. Only MSC keeps fitted state, one reference spectrum
    (as many values as there are bands); Savitzky-Golay is a fixed band matrix."""

    steps: tuple[str, ...]
    window: int = 9
    order: int = 2
    eps: float = 1e-12
    nonpositive: str = "error"
    delta: float = 1.0
    references: dict[int, list[float]] = field(default_factory=dict)
    bands: int = 0

    def __post_init__(self) -> None:
        bad = [s for s in self.steps if s not in STEPS]
        if bad or ("raw" in self.steps and len(self.steps) > 1) or sum(s in SG for s in self.steps) > 1 or not self.steps:
            raise ValueError(f"not a chain: {self.steps}")

    def _step(self, i: int, s: Column) -> Column:
        step = self.steps[i]
        if step == "absorbance":
            return sp.absorbance(s, None if self.nonpositive == "error" else self.eps)
        if step == "snv":
            return sp.snv(s, self.eps)
        if step == "vector_norm":
            return sp.l2_normalise(s, self.eps)
        if step == "msc":
            if i not in self.references:
                raise ValueError("fit the chain first")
            return sp.msc(s, F.array(*map(F.lit, self.references[i])), self.eps)
        if step in SG:
            return sp.apply_matrix(s, sp.savgol_matrix(self.bands, self.window, self.order, SG[step], self.delta))
        return s

    def msc_by(self, s: Column, reference: Column, at: int) -> Column:
        """The steps from ``at`` (an MSC) on, with a reference that is a column."""
        return reduce(lambda x, i: self._step(i, x), range(at + 1, len(self.steps)), sp.msc(s, reference, self.eps))

    def fit(self, df: DataFrame, spectrum: str = "spectrum") -> Chain:
        rows = df.where(row_valid(spectrum, self.steps, self.nonpositive)).select(spectrum)
        first = rows.first()
        if first is None:
            raise ValueError("no row that the chain can take")
        self.bands = len(first[0])
        for i, step in enumerate(self.steps):
            if step == "msc":
                ref = mean_spectrum(self._upto(rows, i, spectrum), [], spectrum).first()["mean"]
                if max(ref) - min(ref) <= self.eps:
                    raise ValueError("the MSC reference does not vary")
                self.references[i] = ref
        return self

    def _upto(self, df: DataFrame, n: int, spectrum: str) -> DataFrame:
        return reduce(lambda d, i: d.withColumn(spectrum, self._step(i, F.col(spectrum))), range(n), df)

    def transform(self, df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
        """Rows that the chain can take, transformed; the others are left out (``validity_report`` counts them)."""
        return self._upto(df.where(row_valid(spectrum, self.steps, self.nonpositive)), len(self.steps), spectrum)


def grid_audit(fit_rows: DataFrame, eval_rows: DataFrame, chains: list[Chain], names: list[str], spectrum: str = "spectrum", least_variance: float = 1e-12) -> DataFrame:
    """One row per chain, fitted on one set of rows and applied to the other: rows, values that are not finite, least
    and largest value, share of bands without variance, and accepted or invalid."""
    parts = []
    for name, chain in zip(names, chains, strict=True):
        rows = chain.fit(fit_rows, spectrum).transform(eval_rows, spectrum)
        long = rows.select(F.posexplode(spectrum).alias("band", "v"))
        per = long.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("n_nan"), F.count_if(F.abs("v") == float("inf")).alias("n_inf"), F.min("v").alias("least"), F.max("v").alias("largest"), F.var_pop("v").alias("variance"))
        one = per.agg(F.max("n").alias("n_rows"), F.sum("n_nan").alias("n_nan"), F.sum("n_inf").alias("n_inf"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.avg((F.col("variance") <= least_variance).cast("double")).alias("zero_variance_rate"))
        parts.append(one.select(F.lit(name).alias("chain"), "*"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("status", F.when((F.col("n_nan") > 0) | (F.col("n_inf") > 0) | F.col("n_rows").isNull() | (F.col("zero_variance_rate") >= 1), "invalid").otherwise("accepted"))
