"""All registered queries of the spectral analytics operators, and SQL for those that SQL can express.

The driver's tables stand in for the spectral ones: ``embeddings`` are pixels (spectrum = embedding + 1), ``lineitem``
carries margins with a truth, ``labels`` pairs truth and prediction, ``part`` candidates, ``orders`` seed repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismata.functions import spectra as sp
from prismata.operators import audit, catalog, decisions, fronts, matrices, models, raster, review, selection, simca
from prismata.plans.shared import materialize
from prismata.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("object"), F.col("l_suppkey").alias("image"), (F.col("l_orderkey") % 2).alias("fold"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") / 50 - 0.5).alias("score"), (F.col("l_returnflag") == "R").alias("truth")
    )


M = "WITH m AS (SELECT l_orderkey AS object, l_suppkey AS image, l_orderkey % 2 AS fold, l_linenumber AS line, l_quantity / 50 - 0.5 AS score, l_returnflag = 'R' AS truth FROM lineitem)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("prediction"))


L = "WITH l AS (SELECT doc_id, lang, source, quality = 1 AS truth, toxic = 1 AS prediction FROM labels JOIN documents USING (doc_id))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    batch = (F.col("vec_id") % 4 + 1).cast("int")
    return e.select(
        "vec_id", "label", batch.alias("batch"), F.concat_ws("_", F.col("label"), F.floor(F.col("vec_id") / 5)).alias("object"), F.concat_ws("_", F.col("label"), batch).alias("image"),
        F.floor(F.col("vec_id") / 25).cast("int").alias("row"), (F.col("vec_id") % 25).cast("int").alias("col"), F.transform("embedding", lambda x: x.cast("double") + 1.0).alias("spectrum"),
    )


P = "WITH p AS (SELECT vec_id, label, CAST(vec_id % 4 + 1 AS INTEGER) AS batch, label || '_' || (vec_id // 5) AS object, label || '_' || (vec_id % 4 + 1) AS image, CAST(vec_id // 25 AS INTEGER) AS row, CAST(vec_id % 25 AS INTEGER) AS col, list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 1.0) AS spectrum FROM embeddings)"
BANDS = P + ", b AS (SELECT vec_id, label, batch, object, image, unnest(spectrum) AS v, generate_subscripts(spectrum, 1) - 1 AS band FROM p)"

TP, FN, FP, TN = "count_if(truth AND prediction)", "count_if(truth AND NOT prediction)", "count_if(NOT truth AND prediction)", "count_if(NOT truth AND NOT prediction)"
SENS, SPEC = f"({TP} / nullif({TP} + {FN}, 0))", f"({TN} / nullif({TN} + {FP}, 0))"
RATES = (
    f"{TP} AS tp, {FN} AS fn, {FP} AS fp, {TN} AS tn, round({SENS}, 6) AS sensitivity, round({SPEC}, 6) AS specificity, round(({SENS} + {SPEC}) / 2, 6) AS balanced_accuracy, round(({TP} + {TN}) / nullif({TP} + {TN} + {FP} + {FN}, 0), 6) AS accuracy, "
    f"round({TP} / nullif({TP} + {FP}, 0), 6) AS precision, round(2 * {TP} / nullif(2 * {TP} + {FP} + {FN}, 0), 6) AS f1, round({FN} / nullif({TP} + {FN}, 0), 6) AS fn_rate, round({FP} / nullif({TN} + {FP}, 0), 6) AS fp_rate"
)


# decisions and metrics


@query("d7_detection_metrics", f"{L} SELECT lang, {RATES} FROM l GROUP BY lang")
def _(s, d):
    return rounded(decisions.detection_metrics(labelled(s, d), ["lang"]))


@query("d9_errors_by_image", f"{M}, x AS (SELECT *, score >= 0 AS prediction FROM m) SELECT image, {RATES} FROM x GROUP BY image")
def _(s, d):
    return rounded(decisions.detection_metrics(margins(s, d).withColumn("prediction", decisions.locked_two_way("score")), ["image"]))


@query(
    "d10_confusion_table",
    f"{L}, c AS (SELECT lang, t.t AS truth, a.a AS prediction, (SELECT count(*) FROM l WHERE l.lang = g.lang AND l.truth = t.t AND CAST(l.prediction AS VARCHAR) = a.a) AS n FROM (SELECT DISTINCT lang FROM l) g, (VALUES (true), (false)) t(t), (VALUES ('true'), ('false')) a(a)) "
    "SELECT lang, truth, prediction, n, round(n / nullif(sum(n) OVER (PARTITION BY lang, truth), 0), 6) AS row_rate, round(n / nullif(sum(n) OVER (PARTITION BY lang), 0), 6) AS rate FROM c",
)
def _(s, d):
    return rounded(decisions.confusion_table(labelled(s, d), ["lang"]))


@query(
    "d11_micro_macro_worst",
    f"{L}, g AS (SELECT source, {FN} / nullif({TP} + {FN}, 0) AS a, {FP} / nullif({TN} + {FP}, 0) AS b, ({SENS} + {SPEC}) / 2 AS c FROM l GROUP BY source) SELECT 'micro' AS kind, round({FN} / nullif({TP} + {FN}, 0), 6) AS fn_rate, round({FP} / nullif({TN} + {FP}, 0), 6) AS fp_rate, round(({SENS} + {SPEC}) / 2, 6) AS balanced_accuracy FROM l "
    "UNION ALL SELECT 'macro', round(avg(a), 6), round(avg(b), 6), round(avg(c), 6) FROM g UNION ALL SELECT 'worst', round(max(a), 6), round(max(b), 6), round(min(c), 6) FROM g",
)
def _(s, d):
    return rounded(decisions.micro_macro(labelled(s, d), "source"))


@query("d1_three_way_decision", f"{M} SELECT CASE WHEN score >= 0.2 THEN 'target' WHEN score >= -0.2 THEN 'uncertain' ELSE 'non_target' END AS decision, truth, count(*) AS n FROM m GROUP BY ALL")
def _(s, d):
    return margins(s, d).groupBy(decisions.locked_three_way("score", -0.2, 0.2).alias("decision"), "truth").agg(F.count("*").alias("n"))


@query(
    "d4_pixel_vote",
    f"{M} SELECT object, image, count(*) AS n_pixels, round(avg(CAST(score >= 0 AS DOUBLE)), 6) AS ratio, 1.0::DOUBLE AS truth_share, round(avg(CAST(truth AS DOUBLE)), 6) AS truth_ratio, avg(CAST(score >= 0 AS DOUBLE)) >= 0.75 AS prediction, avg(CAST(truth AS DOUBLE)) >= 0.5 AS truth FROM m GROUP BY object, image",
)
def _(s, d):
    return rounded(decisions.vote(margins(s, d).withColumn("prediction", F.col("score") >= 0), ["object", "image"]))


@query(
    "d6_core_vote",
    f"{M}, v AS (SELECT image, count_if(line <= 3) AS n_core, avg(CASE WHEN line <= 3 THEN CAST(score >= 0 AS DOUBLE) END) AS a, avg(CAST(score >= 0 AS DOUBLE)) AS b FROM m GROUP BY image) SELECT image, n_core, round(a, 6) AS core_ratio, round(b, 6) AS all_ratio, n_core < 20 AS fallback, round(CASE WHEN n_core < 20 THEN b ELSE a END, 6) AS ratio, CASE WHEN n_core < 20 THEN b ELSE a END >= 0.75 AS prediction FROM v",
)
def _(s, d):
    return rounded(decisions.core_vote(margins(s, d).withColumns({"prediction": F.col("score") >= 0, "core": F.col("line") <= 3}), ["image"], "core"))


_T = "count_if(truth AND score >= t) AS tp, count_if(truth AND score < t) AS fn, count_if(NOT truth AND score >= t) AS fp, count_if(NOT truth AND score < t) AS tn"


@query(
    "t1_threshold_grid",
    f"{M}, c AS (SELECT fold, t AS threshold, {_T} FROM m, (VALUES (-0.3), (-0.1), (0.0), (0.1), (0.3)) g(t) GROUP BY fold, t) SELECT fold, CAST(threshold AS DOUBLE) AS threshold, tp, fn, fp, tn, round(fn / (tp + fn), 6) AS miss_rate, round(fp / (fp + tn), 6) AS false_accept_rate, round(1 - (fn / (tp + fn) + fp / (fp + tn)) / 2, 6) AS balanced_accuracy FROM c",
)
def _(s, d):
    return rounded(decisions.threshold_grid(margins(s, d), "score", [-0.3, -0.1, 0.0, 0.1, 0.3], ["fold"]))


_W = "count_if(truth AND d = 'non_target') / nullif(count_if(truth), 0)"
THREE = (
    f"round({_W}, 6) AS miss_rate, round(count_if(NOT truth AND d = 'target') / nullif(count_if(NOT truth), 0), 6) AS false_accept_rate, round(count_if(truth AND d = 'target') / nullif(count_if(truth), 0), 6) AS auto_accept_rate, round(count_if(NOT truth AND d = 'non_target') / nullif(count_if(NOT truth), 0), 6) AS auto_reject_rate, "
    "round(count_if(d = 'uncertain') / count(*), 6) AS uncertain_rate, round(count_if(d <> 'uncertain') / count(*), 6) AS coverage, round((count_if(truth AND d = 'target') / nullif(count_if(truth AND d <> 'uncertain'), 0) + count_if(NOT truth AND d = 'non_target') / nullif(count_if(NOT truth AND d <> 'uncertain'), 0)) / 2, 6) AS decided_balanced_accuracy"
)


@query("d13_three_way_metrics", f"{M}, x AS (SELECT *, CASE WHEN score >= 0.2 THEN 'target' WHEN score >= -0.2 THEN 'uncertain' ELSE 'non_target' END AS d FROM m) SELECT fold, {THREE} FROM x GROUP BY fold")
def _(s, d):
    return rounded(decisions.three_way_rates(margins(s, d).withColumn("decision", decisions.locked_three_way("score", -0.2, 0.2)), ["fold"]))


@query(
    "t2_three_way_grid",
    f"{M}, x AS (SELECT *, CASE WHEN score >= upper THEN 'target' WHEN score <= lower THEN 'non_target' ELSE 'uncertain' END AS d FROM m, (VALUES (-0.2::DOUBLE, 0.2::DOUBLE), (-0.1, 0.1), (-0.3, 0.1)) g(lower, upper)) SELECT fold, lower, upper, {THREE} FROM x GROUP BY fold, lower, upper",
)
def _(s, d):
    return rounded(decisions.three_way_grid(margins(s, d), "score", [(-0.2, 0.2), (-0.1, 0.1), (-0.3, 0.1)], ["fold"]))


_P, _N, _Z = "(k / nullif(n, 0))", "nullif(n, 0)", "1.959963984540054"
_HALF = f"{_Z} * sqrt({_P} * (1 - {_P}) / {_N} + {_Z} * {_Z} / (4 * {_N} * {_N})) / (1 + {_Z} * {_Z} / {_N})"
_MID = f"({_P} + {_Z} * {_Z} / (2 * {_N})) / (1 + {_Z} * {_Z} / {_N})"


@query("d17_wilson_interval", f"{M}, c AS (SELECT image, count_if(truth AND score < 0)::DOUBLE AS k, count_if(truth)::DOUBLE AS n FROM m GROUP BY image) SELECT image, round(greatest(0, {_MID} - {_HALF}), 6) AS low, round(least(1, {_MID} + {_HALF}), 6) AS high FROM c WHERE n > 0")
def _(s, d):
    c = margins(s, d).groupBy("image").agg(F.count_if(F.col("truth") & (F.col("score") < 0)).alias("k"), F.count_if("truth").alias("n")).where("n > 0")
    low, high = decisions.wilson(F.col("k"), F.col("n"))
    return rounded(c.select("image", low.alias("low"), high.alias("high")))


@query(
    "p17_binary_confidence",
    f"{M}, x AS (SELECT object, line, score, score - 0.1 AS margin, least(1, greatest(0, abs(score - 0.1) / CASE WHEN score - 0.1 >= 0 THEN 0.9 ELSE 0.1 END)) AS c FROM m) SELECT object, line, round(margin, 6) AS margin, round(c, 6) AS confidence, CASE WHEN c <= 0.33 THEN 'low' WHEN c <= 0.66 THEN 'medium' ELSE 'high' END AS confidence_bin FROM x",
)
def _(s, d):
    return rounded(decisions.two_way_confidence(margins(s, d), "score", 0.1).select("object", "line", "margin", "confidence", "confidence_bin"))


@query("t4_macro_object_miss", f"{M}, o AS (SELECT fold, object, avg(CAST(score < 0 AS DOUBLE)) AS miss FROM m WHERE truth GROUP BY fold, object) SELECT fold, round(avg(miss), 6) AS macro_miss_rate, count(*) AS n_objects FROM o GROUP BY fold")
def _(s, d):
    return rounded(decisions.macro_miss(margins(s, d), "object", ["fold"], "score", 0.0))


@query(
    "t3_quantile_policies",
    f"{M}, q AS (SELECT fold, quantile_cont(score, [0.5, 0.75]) FILTER (score < 0) AS lo, quantile_cont(score, [0.25, 0.5]) FILTER (score > 0) AS hi FROM m GROUP BY fold) SELECT fold, lq AS lower_quantile, uq AS upper_quantile, round(lo[i], 6) AS lower_threshold, round(hi[j], 6) AS upper_threshold FROM q, (VALUES (1, 0.5::DOUBLE), (2, 0.75)) x(i, lq), (VALUES (1, 0.25::DOUBLE), (2, 0.5)) y(j, uq)",
)
def _(s, d):
    return rounded(decisions.quantile_policies(margins(s, d), "score", ["fold"], 0.0, [0.5, 0.75], [0.25, 0.5]))


# selection


@query(
    "j1_pareto_front",
    "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))",
)
def _(s, d):
    return selection.pareto_front(read(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], ["p_size", "p_retailprice"])


@query("j4_detection_ordering", "SELECT p_partkey, p_brand, CAST(rank AS INTEGER) AS rank FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size NULLS LAST, p_retailprice NULLS LAST, p_partkey) AS rank FROM part) WHERE rank <= 5")
def _(s, d):
    return selection.top_n(read(s, d, "part"), ["p_brand"], [F.asc_nulls_last("p_size"), F.asc_nulls_last("p_retailprice"), "p_partkey"], 5).select("p_partkey", "p_brand", "rank")


@query(
    "j6_lexicographic_choice",
    "WITH a AS (SELECT * FROM part QUALIFY p_size <= min(p_size) OVER (PARTITION BY p_brand) + 2), b AS (SELECT * FROM a QUALIFY p_retailprice >= max(p_retailprice) OVER (PARTITION BY p_brand) - 50) SELECT p_partkey, p_brand, CASE WHEN p_partkey = min(p_partkey) OVER (PARTITION BY p_brand) THEN 'primary' ELSE 'equivalent' END AS role FROM b",
)
def _(s, d):
    return selection.lexicographic(read(s, d, "part"), ["p_brand"], [("p_size", True, 2), ("p_retailprice", False, 50.0)], "p_partkey").select("p_partkey", "p_brand", "role")


@query("j8_deduplicate", "SELECT p_brand, p_size, arg_min(p_type, p_partkey) AS first_source, array_to_string(list_sort(list_distinct(list(p_type))), ';') AS sources, count(*) AS n_rows FROM part GROUP BY p_brand, p_size")
def _(s, d):
    return selection.deduplicate(read(s, d, "part"), ["p_brand", "p_size"], "p_partkey", "p_type")


@query("j10_duplicate_groups", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS representative, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS group_size FROM part")
def _(s, d):
    return selection.duplicate_groups(read(s, d, "part"), ["p_brand", "p_type", "p_size"], "p_partkey").select("p_partkey", "representative", "group_size")


@query(
    "j20_parameter_tendencies",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part), t AS (SELECT * FROM r WHERE r <= greatest(20, ceil(n * 0.15))) SELECT p_brand, 'p_type' AS parameter, p_type AS value, count(*) AS n FROM t GROUP BY p_brand, p_type UNION ALL SELECT p_brand, 'p_size', CAST(p_size AS VARCHAR), count(*) FROM t GROUP BY p_brand, p_size",
)
def _(s, d):
    return selection.parameter_tendencies(read(s, d, "part"), "p_brand", ["p_retailprice", "p_partkey"], ["p_type", "p_size"])


@query(
    "j21_factor_summary",
    "WITH u AS (SELECT 'p_brand' AS factor, p_brand AS value, p_retailprice AS x FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), p_retailprice FROM part) SELECT factor, value, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_pop(x), 4) AS std, round(min(x), 4) AS least, round(max(x), 4) AS largest, count(x) AS n FROM u GROUP BY factor, value",
)
def _(s, d):
    return rounded(selection.factor_summary(read(s, d, "part"), ["p_brand", "p_size"], "p_retailprice"), 4)


@query("j1_epsilon_front")
def _(s, d):
    return fronts.epsilon_front(read(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], ["p_size", "p_retailprice"], 1.0)


# matrices and quality


@query("m1_object_mean", f"{BANDS} SELECT object, band, round(avg(v), 6) AS value FROM b GROUP BY object, band")
def _(s, d):
    return rounded(matrices.object_matrix(pixels(s, d), ["object"]).select("object", F.posexplode("spectrum").alias("band", "value")).withColumn("band", F.col("band").cast("long")))


@query("m1_object_median", f"{BANDS} SELECT image, band, round(median(v), 6) AS value FROM b GROUP BY image, band")
def _(s, d):
    return rounded(matrices.object_matrix(pixels(s, d), ["image"], median=True).select("image", F.posexplode("spectrum").alias("band", "value")).withColumn("band", F.col("band").cast("long")))


@query("m3_balanced_pixels", f"{P} SELECT vec_id, label, CAST(draw AS INTEGER) AS draw, n_available FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS draw, count(*) OVER (PARTITION BY label) AS n_available FROM p) WHERE draw <= 20")
def _(s, d):
    order = F.struct(F.md5(F.concat(F.lit("7:"), F.col("vec_id").cast("string"))), "vec_id")
    return matrices.balanced_pixels(pixels(s, d), ["label"], 20, order).select("vec_id", "label", "draw", "n_available")


@query("m9_coverage", f"{P} SELECT label, batch, count(*) AS n_rows FROM p GROUP BY label, batch")
def _(s, d):
    return matrices.coverage(pixels(s, d), ["label", "batch"])


@query("m10_balance_ratio", f"{P}, c AS (SELECT count(*) AS n FROM p GROUP BY label) SELECT round(min(n) / max(n), 6) AS balance_ratio, count(*) AS n_groups FROM c")
def _(s, d):
    return rounded(matrices.balance_ratio(pixels(s, d), ["label"]))


@query(
    "m11_selection_overlap",
    f"{P}, r AS (SELECT label, vec_id, seed, row_number() OVER (PARTITION BY label, seed ORDER BY md5(seed || ':' || vec_id), vec_id) AS rn FROM p, (VALUES (1), (2), (3)) s(seed)), x AS (SELECT label, seed, list(vec_id) AS v FROM r WHERE rn <= 20 GROUP BY label, seed) SELECT round(avg(len(list_intersect(a.v, b.v)) / (len(a.v) + len(b.v) - len(list_intersect(a.v, b.v)))), 6) AS mean_overlap, count(*) AS n_pairs FROM x a JOIN x b ON a.label = b.label AND a.seed < b.seed",
)
def _(s, d):
    p = pixels(s, d).withColumn("seed", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    order = F.struct(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("vec_id").cast("string"))), "vec_id")
    return rounded(matrices.selection_overlap(matrices.balanced_pixels(p, ["label", "seed"], 20, order), "label", "seed", "vec_id"))


@query("m17_evenly_spaced", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey FROM r WHERE n <= 10 OR i = 0 OR floor(i * 9 / greatest(n - 1, 1)) > floor((i - 1) * 9 / greatest(n - 1, 1))")
def _(s, d):
    return matrices.evenly_spaced(read(s, d, "part"), ["p_brand"], ["p_retailprice", "p_partkey"], 10).select("p_brand", "p_partkey")


@query("q1_spectral_integrity", f"{P} SELECT image, count(*) AS n_rows, sum(len(spectrum)) AS n_values, sum(len(list_filter(spectrum, lambda x: isnan(x)))) AS n_nan, sum(len(list_filter(spectrum, lambda x: isinf(x)))) AS n_inf FROM p GROUP BY image")
def _(s, d):
    return matrices.spectral_integrity(pixels(s, d), ["image"])


@query("q3_pixel_quality", f"{P} SELECT vec_id, CAST(len(list_filter(spectrum, lambda x: x = 0)) AS INTEGER) AS n_zero, CAST(len(list_filter(spectrum, lambda x: x <= 0)) AS INTEGER) AS n_nonpositive, round(len(list_filter(spectrum, lambda x: x = 0)) / len(spectrum), 6) AS zero_fraction, round(list_min(spectrum), 6) AS min_reflectance FROM p")
def _(s, d):
    return rounded(matrices.pixel_quality(pixels(s, d)).select("vec_id", "n_zero", "n_nonpositive", "zero_fraction", "min_reflectance"))


@query("q4_band_quality", f"{BANDS} SELECT band, count(*) AS n, count_if(v - 1.3 < 0) AS n_negative, count_if(v - 1.3 = 0) AS n_zero, count_if(v - 1.3 <= 0) AS n_nonpositive, round(min(v - 1.3), 6) AS least, round(quantile_cont(v - 1.3, 0.01), 6) AS q01, round(quantile_cont(v - 1.3, 0.001), 6) AS q001, round(count_if(v - 1.3 < 0) / count(*), 6) AS negative_rate, round(count_if(v - 1.3 = 0) / count(*), 6) AS zero_rate, round(count_if(v - 1.3 <= 0) / count(*), 6) AS nonpositive_rate, band >= 59 AND count_if(v - 1.3 < 0) > 0 AS failed FROM b GROUP BY band")
def _(s, d):
    lowered = pixels(s, d).withColumn("spectrum", F.transform("spectrum", lambda x: x - 1.3))
    return rounded(matrices.band_quality(lowered).withColumn("band", F.col("band").cast("long")))


@query(
    "q7_robust_outliers",
    f"{BANDS}, c AS (SELECT *, abs(v - median(v) OVER (PARTITION BY label, band)) AS gap FROM b), m AS (SELECT *, median(gap) OVER (PARTITION BY label, band) AS mad FROM c) SELECT label, vec_id, round(median(gap / mad), 6) AS distance, median(gap / mad) > 6 AS outlier FROM m GROUP BY label, vec_id",
)
def _(s, d):
    return rounded(matrices.robust_outliers(pixels(s, d), ["label"], "vec_id"))


_BOX = P + ", b AS (SELECT image, object, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM p GROUP BY image, object)"


@query("q6_nearest_box", f"{_BOX} SELECT a.image, a.object, round(coalesce(min(sqrt(power(greatest(0, a.r0 - b.r1, b.r0 - a.r1), 2) + power(greatest(0, a.c0 - b.c1, b.c0 - a.c1), 2))), 'Infinity'::DOUBLE), 6) AS nearest FROM b a LEFT JOIN b ON a.image = b.image AND a.object <> b.object GROUP BY a.image, a.object")
def _(s, d):
    boxes = pixels(s, d).groupBy("image", "object").agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    return rounded(matrices.nearest_box(boxes, "image", "object"))


# spectra


@query("x1_pixel_validity", f"{P} SELECT CASE WHEN len(list_filter(s, lambda x: x <= 0)) > 0 THEN 'nonpositive_reflectance' ELSE 'valid' END AS reason, count(*) AS n FROM (SELECT list_transform(spectrum, lambda x: x - 0.75) AS s FROM p) GROUP BY ALL")
def _(s, d):
    return pixels(s, d).select(sp.validity_reason(F.transform("spectrum", lambda x: x - 0.75)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _bands(df: DataFrame, column) -> DataFrame:
    return rounded(df.select("vec_id", F.posexplode(column).alias("band", "value")).withColumn("band", F.col("band").cast("long")))


@query("x2_absorbance", f"{BANDS} SELECT vec_id, band, round(-log10(v), 6) AS value FROM b")
def _(s, d):
    return _bands(pixels(s, d), sp.absorbance(F.col("spectrum")))


@query("x4_snv", f"{BANDS} SELECT vec_id, band, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS value FROM b WINDOW w AS (PARTITION BY vec_id)")
def _(s, d):
    return _bands(pixels(s, d), sp.snv(F.col("spectrum")))


@query("x5_l2_normalisation", f"{BANDS} SELECT vec_id, band, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM b")
def _(s, d):
    return _bands(pixels(s, d), sp.l2_normalise(F.col("spectrum")))


@query("x7_msc", f"{BANDS}, r AS (SELECT band, avg(v) AS r FROM b WHERE batch <= 2 GROUP BY band), j AS (SELECT vec_id, band, v, r, regr_slope(v, r) OVER w AS k, avg(v) OVER w AS mv, avg(r) OVER w AS mr FROM b JOIN r USING (band) WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, band, round((v - (mv - k * mr)) / k, 5) AS value FROM j")
def _(s, d):
    p = pixels(s, d)
    ref = matrices.object_matrix(p.where("batch <= 2").withColumn("all", F.lit(1)), ["all"]).select(F.col("spectrum").alias("reference"))
    joined = p.crossJoin(F.broadcast(ref))  # one row
    return rounded(joined.select("vec_id", F.posexplode(sp.msc(F.col("spectrum"), F.col("reference"))).alias("band", "value")).withColumn("band", F.col("band").cast("long")), 5)


@query("x8_savgol_first_derivative")
def _(s, d):
    return _bands(pixels(s, d), sp.apply_matrix(F.col("spectrum"), sp.savgol_matrix(64, 11, 2, 1, 12.9)))


@query("p4_wavelength_window", f"{BANDS} SELECT vec_id, band - 9 AS band, round(v, 6) AS value FROM b WHERE 889 + band * 12.9 BETWEEN 1000 AND 1200")
def _(s, d):
    axis = [889 + i * 12.9 for i in range(64)]
    return _bands(pixels(s, d), sp.window(F.col("spectrum"), axis, 1000, 1200))


# models


@query("g1_gram_totals", f"{BANDS} SELECT CAST(label AS VARCHAR) AS model, band, count(*) AS n, round(avg(v), 6) AS mean FROM b GROUP BY label, band")
def _(s, d):
    m = models.fit_pca(pixels(s, d), "label", "spectrum")
    return rounded(m.select("model", "n", F.posexplode("mean").alias("band", "mean")).withColumn("band", F.col("band").cast("long")))


@query("g1_total_variance", f"{BANDS}, v AS (SELECT label, band, var_samp(v) AS v FROM b GROUP BY label, band) SELECT CAST(label AS VARCHAR) AS model, round(sum(v), 6) AS total_variance FROM v GROUP BY label")
def _(s, d):
    m = models.fit_pca(pixels(s, d), "label", "spectrum")
    return rounded(m.select("model", F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x).alias("total_variance")))


@query("g4_component_variance")
def _(s, d):
    return rounded(models.component_table(models.fit_pca(pixels(s, d), "batch", "spectrum")))


def class_scores(s: SparkSession, d: str, k: int = 3, alpha: float = 0.05) -> DataFrame:
    p = pixels(s, d).withColumn("spectrum", sp.snv(F.col("spectrum")))
    fitted = materialize(models.limits(models.fit_pca(p.where("batch <= 3"), "label", "spectrum"), k, alpha), "class-models")
    return simca.distances(p.select("vec_id", "label", "spectrum"), fitted, k, "spectrum").join(fitted.select("model", "h0", "nh", "q0", "nq", "h_limit", "q_limit", "dd_limit"), "model")


@query("c7_rule_variants")
def _(s, d):
    return rounded(models.rule_variants(class_scores(s, d)).select("vec_id", "model", "rule", "statistic", "limit", "margin", "accepted"), 5)


@query("c8_multiclass_decision")
def _(s, d):
    return models.multiclass(class_scores(s, d), "vec_id")


@query("quantile_higher", f"{M} SELECT image, list_sort(list(score))[CAST(ceil(0.95 * (count(score) - 1)) AS INTEGER) + 1] AS threshold FROM m GROUP BY image")
def _(s, d):
    return simca.higher_quantiles(margins(s, d), ["image"], "score", 0.95).withColumnRenamed("quantile", "threshold")


@query("quantile_linear", f"{M} SELECT image, round(quantile_cont(score, 0.95), 6) AS threshold FROM m GROUP BY image")
def _(s, d):
    return rounded(margins(s, d).groupBy("image").agg(F.percentile("score", 0.95).alias("threshold")))


@query("simca_minimum_slice")
def simca_minimum_slice(s, d):
    """SNV, a class model per label, data-driven margins, two-way decision, rates per model."""
    scored = models.rule_variants(class_scores(s, d)).where("rule = 'data_driven'")
    told = scored.select("model", (F.col("label").cast("string") == F.col("model")).alias("truth"), decisions.locked_two_way("margin").alias("prediction"))
    return rounded(decisions.detection_metrics(told, ["model"]))


# splits, shift, stability


@query("l2_split_leakage", "SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS n_roles, count(*) AS n_rows FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def _(s, d):
    return audit.split_leakage(read(s, d, "orders").withColumn("role", F.col("o_orderkey") % 3), "o_custkey", "role")


@query("l3_split_diagnostics", "SELECT l_orderkey % 2 AS fold, l_returnflag, count(DISTINCT l_orderkey) AS n_objects, count(DISTINCT l_suppkey) AS n_images, min(l_quantity) AS least_area, median(l_quantity) AS median_area, max(l_quantity) AS largest_area FROM lineitem GROUP BY ALL")
def _(s, d):
    return audit.split_diagnostics(read(s, d, "lineitem").withColumn("fold", F.col("l_orderkey") % 2), ["fold", "l_returnflag"], "l_orderkey", "l_suppkey", "l_quantity")


@query("l5_size_bins", "SELECT p_partkey, CAST(greatest(0, ceil((r - 1) * 4 / greatest(n - 1, 1)) - 1) AS INTEGER) AS size_bin FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)")
def _(s, d):
    return audit.size_bins(read(s, d, "part"), ["p_brand"], ["p_retailprice", "p_partkey"], 4).select("p_partkey", "size_bin")


@query("l4_grouped_folds")
def _(s, d):
    groups = read(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return audit.fold_assignment(groups.withColumn("g", F.concat_ws("/", "source", "lang")), 2, "g", "lang", "n")


_EV = "WITH e AS (SELECT event_type, value, CASE WHEN event_id < (SELECT count(*) / 2 FROM events) THEN 'train' ELSE 'projection' END AS role FROM events)"


@query("h1_domain_shift", f"{_EV} SELECT event_type, round(avg(value) FILTER (role = 'train'), 6) AS value_mean, round(stddev_samp(value) FILTER (role = 'train'), 6) AS value_sd, round(avg(value) FILTER (role = 'projection'), 6) AS value_projection, round((avg(value) FILTER (role = 'projection') - avg(value) FILTER (role = 'train')) / stddev_samp(value) FILTER (role = 'train'), 6) AS value_shift FROM e GROUP BY event_type")
def _(s, d):
    e = read(s, d, "events")
    half = e.agg((F.count("*") / 2).alias("half"))
    e = e.crossJoin(F.broadcast(half)).withColumn("role", F.when(F.col("event_id") < F.col("half"), "train").otherwise("projection"))  # one row
    return rounded(audit.domain_shift(e, "role", ["event_type"], ["value"]))


@query("b1_seed_statistics", "WITH p AS (SELECT o_custkey % 50 AS model, o_orderkey % 3 AS seed, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT model, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 3) AS least, round(max(v), 3) AS largest, count(*) AS n_seeds, round(max(v), 3) AS worst FROM p GROUP BY model")
def _(s, d):
    o = read(s, d, "orders").select((F.col("o_custkey") % 50).alias("model"), (F.col("o_orderkey") % 3).alias("seed"), "o_totalprice")
    return rounded(audit.seed_statistics(o, "model", F.avg("o_totalprice"), "seed"), 3)


@query("b2_seed_disagreement", f"{M}, e AS (SELECT image % 10 AS model, object, count(DISTINCT line % 3) AS s, count(DISTINCT score >= 0) AS d FROM m GROUP BY ALL HAVING count(DISTINCT line % 3) = 3) SELECT model, round(avg(CAST(d > 1 AS DOUBLE)), 6) AS disagreement, count(*) AS n_entities FROM e GROUP BY model")
def _(s, d):
    m = margins(s, d).select((F.col("image") % 10).alias("model"), "object", (F.col("line") % 3).alias("seed"), (F.col("score") >= 0).alias("decision"))
    return rounded(audit.seed_disagreement(m, "model", "object", "seed", "decision", 3))


@query("b6_leave_one_image_out", f"{M}, i AS (SELECT fold, image, avg(CAST(score < 0 AS DOUBLE)) AS v FROM m GROUP BY fold, image) SELECT fold, image, round((sum(v) OVER w - v) / (count(v) OVER w - 1), 6) AS left_out_mean, round(avg(v) OVER w, 6) AS full_mean FROM i WINDOW w AS (PARTITION BY fold)")
def _(s, d):
    i = margins(s, d).groupBy("fold", "image").agg(F.avg((F.col("score") < 0).cast("double")).alias("v"))
    return rounded(audit.leave_one_out(i, ["fold"], "v").select("fold", "image", "left_out_mean", "full_mean"))


@query(
    "b12_risk_coverage",
    f"{M}, c AS (SELECT *, abs(score) AS conf FROM m), q AS (SELECT fold, quantile_cont(conf, [0.75, 0.5, 0.0]) AS t FROM c GROUP BY fold), g AS (SELECT fold, coverage, t[i] AS t FROM q, (VALUES (1, 0.25::DOUBLE), (2, 0.5), (3, 1.0)) g(i, coverage)) SELECT fold, coverage, count(*) AS n, round(avg(CAST(truth <> (score >= 0) AS DOUBLE)), 6) AS risk FROM c JOIN g USING (fold) WHERE conf >= t GROUP BY fold, coverage",
)
def _(s, d):
    m = margins(s, d).withColumns({"confidence": F.abs("score"), "prediction": F.col("score") >= 0})
    return rounded(audit.risk_coverage(m, ["fold"], "confidence", [0.25, 0.5, 1.0]))


# rasters: pixel (image = label, row, col) is foreground where its first value is above the mean level


def mask(s: SparkSession, d: str) -> DataFrame:
    return pixels(s, d).where(F.col("spectrum")[0] > 1.0).select(F.lit(0).alias("image"), "row", "col")


K = P + ", k AS (SELECT row, col FROM p WHERE spectrum[1] > 1.0)"


@query("r3_dilation", f"{K} SELECT DISTINCT 0 AS image, row + dr AS row, col + dc AS col FROM k, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)")
def _(s, d):
    return raster.dilate(mask(s, d), 1)


@query("r3_erosion", f"{K} SELECT 0 AS image, row + dr AS row, col + dc AS col FROM k, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc) GROUP BY ALL HAVING count(*) = 5")
def _(s, d):
    return raster.erode(mask(s, d), 1)


@query(
    "r4_connected_components",
    P + ", k AS (SELECT row, col, row * 100 + col AS id FROM p WHERE spectrum[1] > 1.0), w AS (WITH RECURSIVE r AS (SELECT id, row, col, id AS root FROM k UNION SELECT n.id, n.row, n.col, r.root FROM r JOIN k n ON abs(n.row - r.row) <= 1 AND abs(n.col - r.col) <= 1) SELECT id, row, col, min(root) AS root FROM r GROUP BY id, row, col) SELECT count(*) AS area, min(row) AS min_row, min(col) AS min_col, max(row) AS max_row, max(col) AS max_col FROM w GROUP BY root",
)
def _(s, d):
    return raster.component_table(raster.components(mask(s, d))).select("area", "min_row", "min_col", "max_row", "max_col")


@query("a1_mask_agreement", f"{P}, x AS (SELECT label, spectrum[1] > 1 AS a, spectrum[2] > 1 AS b FROM p) SELECT label, round(count_if(a = b) / count(*), 6) AS agreement, round(2 * count_if(a AND b) / (count_if(a) + count_if(b)), 6) AS dice, round(count_if(a AND b) / count_if(a OR b), 6) AS iou FROM x GROUP BY label")
def _(s, d):
    return rounded(raster.mask_agreement(pixels(s, d).withColumns({"a": F.col("spectrum")[0] > 1, "b": F.col("spectrum")[1] > 1}), ["label"], "a", "b"))


@query("a2_component_iou", f"{P}, o AS (SELECT label, row, count(*) AS n FROM p GROUP BY label, row) SELECT o.label, o.row, n AS overlap, x.n_a AS area_a, y.n_b AS area_b, round(n / (x.n_a + y.n_b - n), 6) AS iou FROM o JOIN (SELECT label, count(*) AS n_a FROM p GROUP BY label) x ON o.label = x.label JOIN (SELECT row, count(*) AS n_b FROM p GROUP BY row) y ON o.row = y.row")
def _(s, d):
    return rounded(raster.component_iou(pixels(s, d).withColumn("one", F.lit(1)), ["one"], "label", "row").drop("one"))


@query("r9_error_codes", f"{L} SELECT CAST(CASE WHEN truth AND prediction THEN 1 WHEN NOT truth AND NOT prediction THEN 2 WHEN NOT truth THEN 3 ELSE 4 END AS INTEGER) AS code, count(*) AS n FROM l GROUP BY ALL")
def _(s, d):
    return raster.error_codes(labelled(s, d)).groupBy("code").agg(F.count("*").alias("n"))


# tables


@query("s5_selected_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def _(s, d):
    keys = read(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.selected_rows(read(s, d, "lineitem"), keys, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("s7_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return tables.duplicate_keys(read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("s8_schema_diagnostics", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_values, count({c}) = 0 AS all_null FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def _(s, d):
    return tables.schema_diagnostics(read(s, d, "orders"))


@query("s10_row_batches", "SELECT o_orderstatus, o_orderkey, 'batch_' || lpad(CAST(CAST(ceil(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) / 100) AS BIGINT) AS VARCHAR), 4, '0') AS batch_id FROM orders")
def _(s, d):
    return tables.row_batches(read(s, d, "orders"), ["o_orderstatus"], ["o_orderkey"], 100).select("o_orderstatus", "o_orderkey", "batch_id")


@query("p15_stable_ids", "SELECT p_partkey, 'cfg_' || substring(sha256(to_json({'p_brand': p_brand, 'p_size': p_size})), 1, 20) AS id FROM part")
def _(s, d):
    return read(s, d, "part").select("p_partkey", tables.stable_id("cfg", ["p_size", "p_brand"]).alias("id"))


@query("s14_fingerprint", "WITH h AS (SELECT lang, sha256(to_json({'doc_id': doc_id, 'n_chars': n_chars})) AS h FROM documents), b AS (SELECT lang, substring(h, 1, 4) AS b, sha256(array_to_string(list_sort(list(h)), '|')) AS h FROM h GROUP BY ALL) SELECT lang, sha256(array_to_string(list_sort(list(b || h)), '|')) AS fingerprint FROM b GROUP BY lang")
def _(s, d):
    return tables.fingerprint(read(s, d, "documents"), ["doc_id", "n_chars"], ["lang"])


@query("s15_equality_report", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)) AS only_left, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)) AS only_right, false AS equal")
def _(s, d):
    o = read(s, d, "orders")
    return tables.equality_report(o.where("o_orderkey % 2 = 0").select("o_custkey"), o.where("o_orderkey % 2 = 1").select("o_custkey"))


@query(
    "p1_name_parser",
    "WITH k AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ALM' || (s_suppkey % 5) WHEN 1 THEN 'pea' || (s_suppkey % 5) || '_pos' || s_suppkey WHEN 2 THEN ' alm1pea2_sb' ELSE 'x' || s_suppkey END AS key FROM supplier), n AS (SELECT s_suppkey, regexp_replace(lower(trim(key)), '_sb$', '') AS k FROM k), t AS (SELECT *, CASE WHEN regexp_matches(k, '^(alm|pea)\\d+_pos\\d+$') THEN 'position_reference' WHEN regexp_matches(k, '^(alm|pea)\\d+$') THEN 'pure' WHEN regexp_matches(k, '^alm\\d+pea\\d+$') THEN 'mixture' ELSE 'unknown' END AS kind FROM n), u AS (SELECT s_suppkey, kind, CASE WHEN kind IN ('pure', 'position_reference') THEN CAST(regexp_extract(k, '^(?:alm|pea)(\\d+)', 1) AS INTEGER) END AS batch FROM t) "
    "SELECT s_suppkey, kind, batch, CASE WHEN kind = 'mixture' THEN 'application' WHEN kind = 'position_reference' THEN 'spatial_reference' WHEN batch IN (1, 2) THEN 'calibration' WHEN batch = 3 THEN 'validation' WHEN batch = 4 THEN 'test' ELSE 'unknown' END AS role FROM u",
)
def _(s, d):
    k = F.col("s_suppkey")
    n = (k % 5).cast("string")
    key = F.when(k % 4 == 0, F.concat(F.lit("ALM"), n)).when(k % 4 == 1, F.concat(F.lit("pea"), n, F.lit("_pos"), k.cast("string"))).when(k % 4 == 2, " alm1pea2_sb").otherwise(F.concat(F.lit("x"), k.cast("string")))
    return read(s, d, "supplier").select("s_suppkey", *[c.alias(x) for x, c in tables.parse_key(key).items()])


@query("p8_binary_label", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true END AS label FROM orders")
def _(s, d):
    values = F.array(*map(F.lit, ("True", " no", "1", "Almond", "PEANUT ", "maybe")))
    return read(s, d, "orders").select("o_orderkey", tables.binary_label(F.element_at(values, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("label"))


# alerts and reviews: high and low order totals raise alerts, urgent and high orders have been reviewed


def order_alerts(s, d):
    rules = [("high_total", F.col("o_totalprice") > 300000, "warning", ["o_custkey"]), ("open_order", F.col("o_orderstatus") == "O", "info", ["o_orderkey", "o_custkey"])]
    return review.alerts(read(s, d, "orders"), "order", "o_orderkey", rules)


def order_reviews(s, d):
    o = read(s, d, "orders")
    stored = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").cast("string").alias("record_id"), F.when(F.col("o_custkey") < 30, "exclude").when(F.col("o_orderstatus") == "F", "accept_as_is").when(F.col("o_orderstatus") == "P", "correct_segmentation").otherwise("later").alias("review_decision"),
        F.concat(F.lit("clerk"), F.col("o_custkey")).alias("reviewer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("review_date"), F.when(F.col("o_totalprice") > 50000, "seen").otherwise(" ").alias("review_comment"))
    return review.merge_reviews(order_alerts(s, d), stored, "record_id")


_AL = (
    "WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS record_id FROM orders), a AS (SELECT *, 'high_total' AS flag_type, 'warning' AS severity, '{\"o_custkey\":' || o_custkey || '}' AS evidence_json FROM o WHERE o_totalprice > 300000 "
    "UNION ALL SELECT *, 'open_order', 'info', '{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || '}' FROM o WHERE o_orderstatus = 'O'), "
    "v AS (SELECT record_id, flag_type, severity, CASE WHEN NOT done THEN NULL WHEN o_custkey < 30 THEN 'exclude' WHEN o_orderstatus = 'F' THEN 'accept_as_is' WHEN o_orderstatus = 'P' THEN 'correct_segmentation' ELSE 'later' END AS review_decision, "
    "done, o_totalprice > 50000 AS commented FROM (SELECT *, o_orderpriority IN ('1-URGENT', '2-HIGH') AS done FROM a)), "
    "q AS (SELECT *, CASE WHEN NOT done THEN 'pending' WHEN review_decision = 'accept_as_is' THEN 'accepted' WHEN review_decision = 'exclude' THEN 'excluded' WHEN review_decision = 'correct_segmentation' THEN 'needs_new_cycle' ELSE 'pending' END AS qc_status FROM v)"
)


@query("q8_alerts", f"{_AL} SELECT 'order' AS record_type, record_id, flag_type, sha256(to_json({{'record_type': 'order', 'record_id': record_id, 'flag_type': flag_type}})) AS alert_id, severity, evidence_json FROM a")
def _(s, d):
    return order_alerts(s, d)


@query("q9_missing_fields", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority = '5-LOW' THEN 'priority' END, CASE WHEN o_orderstatus = 'O' THEN 'status' END) AS missing FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'O'")
def _(s, d):
    o = read(s, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.nullif("o_orderstatus", F.lit("O")).alias("status"))
    return review.missing_fields(o, "o_orderkey", ["priority", "status"])


@query("q12_review_merge", f"{_AL} SELECT record_id, flag_type, review_decision, CASE WHEN done THEN 'reviewed' ELSE 'pending' END AS review_status FROM v")
def _(s, d):
    return order_reviews(s, d).select("record_id", "flag_type", "review_decision", "review_status")


@query("q13_open_reviews", f"{_AL} SELECT record_id, flag_type, CASE WHEN NOT done THEN 'pending' WHEN review_decision = 'later' THEN 'invalid_decision' ELSE 'no_comment' END AS reason FROM v WHERE NOT done OR review_decision = 'later' OR NOT commented")
def _(s, d):
    return review.open_reviews(order_reviews(s, d)).select("record_id", "flag_type", "reason")


@query("q14_apply_reviews", f"{_AL} SELECT record_id, flag_type, qc_status, qc_status = 'excluded' AS excluded, qc_status = 'needs_new_cycle' AS new_cycle FROM q")
def _(s, d):
    return review.apply_reviews(order_reviews(s, d)).select("record_id", "flag_type", "qc_status", "excluded", "new_cycle")


@query("q15_closure", f"{_AL} SELECT severity, count(*) AS n_alerts, count_if(qc_status = 'pending') AS n_pending, count_if(qc_status = 'excluded') AS n_excluded, count_if(qc_status = 'needs_new_cycle') AS n_new_cycle, CASE WHEN count_if(qc_status = 'pending') = 0 THEN 'closed' ELSE 'pending' END AS state FROM q GROUP BY severity")
def _(s, d):
    return review.closure(review.apply_reviews(order_reviews(s, d)), ["severity"])


_FUNNEL = "SELECT p_brand, count(*) AS a, count_if(p_size <= 35) AS b, count_if(p_size <= 35 AND p_retailprice <= 1500) AS c FROM part GROUP BY p_brand"


@query("j16_retention_funnel", f"WITH f AS ({_FUNNEL}) SELECT p_brand, 1 AS stage_no, 'size' AS stage, a AS n_entering, b AS n_retained, a - b AS n_failed FROM f UNION ALL SELECT p_brand, 2, 'price', b, c, b - c FROM f")
def _(s, d):
    return review.retention_funnel(read(s, d, "part"), ["p_brand"], [("size", F.col("p_size") <= 35), ("price", F.col("p_retailprice") <= 1500)])


@query("j17_shortlist", "SELECT p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice % 20 > 19.5 AND b.p_brand = a.p_brand AND b.p_size = a.p_size)")
def _(s, d):
    p = read(s, d, "part")
    return review.in_shortlist(p, p.where("p_retailprice % 20 > 19.5"), ["p_brand", "p_size"]).select("p_partkey")


@query(
    "t6_crossfit_rates",
    f"{M}, e AS (SELECT DISTINCT line AS e FROM m UNION ALL SELECT -1), q AS (SELECT fold, e, quantile_cont(score, 0.5) FILTER (score < 0) AS lo, quantile_cont(score, 0.5) FILTER (score > 0) AS hi FROM m JOIN e ON line <> e GROUP BY fold, e), "
    f"x AS (SELECT m.fold, e, lo, hi, truth, CASE WHEN score >= hi THEN 'target' WHEN score <= lo THEN 'non_target' ELSE 'uncertain' END AS d FROM m JOIN q ON m.fold = q.fold AND (e = -1 OR e = line)) "
    f"SELECT fold, CAST(e AS BIGINT) AS evaluation_fold, round(lo, 6) AS lower, round(hi, 6) AS upper, {THREE} FROM x GROUP BY fold, e, lo, hi",
)
def _(s, d):
    return rounded(review.crossfit_rates(margins(s, d), "score", ["fold"], "line", 0.0, 0.5, 0.5))


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query("t8_policy_aggregation", "SELECT o_custkey, count(DISTINCT o_orderdate) AS n_runs, " + ", ".join(f"round(avg({_CENTS}) FILTER (o_orderstatus = '{m}'), 4) AS {m}_mean, max({_CENTS}) FILTER (o_orderstatus = '{m}') AS {m}_worst" for m in "FOP") + " FROM orders GROUP BY o_custkey")
def _(s, d):
    o = read(s, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))  # whole cents sum exactly in any order
    return rounded(review.aggregate_policies(o, ["o_custkey"], ["o_orderdate"], "o_orderstatus", "cents", list("FOP")), 4)


@query("t11_snapped_keys", "SELECT CASE WHEN l_discount < 0.0125 THEN 0.0 WHEN l_discount < 0.0375 THEN 0.025 WHEN l_discount < 0.0625 THEN 0.05 WHEN l_discount < 0.0875 THEN 0.075 ELSE 0.1 END::DOUBLE AS policy, count(*) AS n FROM lineitem GROUP BY ALL")
def _(s, d):
    return read(s, d, "lineitem").groupBy(review.snap(F.col("l_discount").cast("double"), [0.0, 0.025, 0.05, 0.075, 0.1]).alias("policy")).agg(F.count("*").alias("n"))


@query("t12_audit_summary", "SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(s, d):
    return review.audit_summary(read(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "t13_model_metrics",
    f"{L}, g AS (SELECT source, lang, {RATES} FROM l GROUP BY source, lang), u AS (SELECT source, lang, 'fn_rate' AS metric, fn_rate AS value FROM g UNION ALL SELECT source, lang, 'fp_rate', fp_rate FROM g) "
    "SELECT source, concat_ws('.', lang, metric) AS key, value FROM u UNION ALL SELECT source, 'safety.' || metric, max(value) FROM u GROUP BY source, metric",
)
def _(s, d):
    return review.model_metrics(rounded(decisions.detection_metrics(labelled(s, d), ["source", "lang"])), "source", "lang", ["fn_rate", "fp_rate"])


@query(
    "b13_search_efficiency",
    "WITH g AS (SELECT o_orderpriority AS track, count(*) AS t, count(DISTINCT o_custkey) AS u, count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 8000)) / (SELECT count(*) FROM customer WHERE c_acctbal >= 8000) AS r FROM orders GROUP BY ALL), "
    "x AS (SELECT *, 1 - power(1 - 1 / n, t) AS e FROM g, (SELECT count(*)::DOUBLE AS n FROM customer)) SELECT track, CAST(t AS BIGINT) AS n_trials, u AS n_unique, round(r, 6) AS front_recall, round(1 - u / t, 6) AS duplicate_rate, round(u / n, 6) AS coverage, round(e, 6) AS expected, round(r - e, 6) AS delta, round(r / e, 6) AS lift FROM x",
)
def _(s, d):
    c = read(s, d, "customer").withColumnRenamed("c_custkey", "config")
    trials = read(s, d, "orders").select(F.col("o_orderpriority").alias("track"), F.col("o_custkey").alias("config"))
    return rounded(review.search_efficiency(trials, c, c.where("c_acctbal >= 8000"), "track", "config"))


@query("b14_first_trials", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(s, d):
    return review.first_trials(read(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "k1_configuration_grid",
    "WITH b AS (SELECT DISTINCT p_brand AS chain FROM part), g AS (SELECT chain, m, k, alpha FROM b, (SELECT unnest(['mean', 'pixels']) AS m), (SELECT unnest([3, 5, 8]) AS k), (SELECT unnest(['0.01', '0.05']) AS alpha)) "
    "SELECT *, sha256(to_json({'chain': chain, 'm': m, 'k': k, 'alpha': alpha})) AS config_id FROM g WHERE m = 'pixels' OR k <= 5",
)
def _(s, d):
    base = read(s, d, "part").select(F.col("p_brand").alias("chain")).distinct()
    return catalog.configuration_grid(base, {"m": ["mean", "pixels"], "k": [3, 5, 8], "alpha": ["0.01", "0.05"]}, F.expr("m = 'pixels' OR k <= 5"), ["chain", "m", "k", "alpha"])


@query("k3_additional_seeds", "SELECT c_custkey, seed FROM customer, (SELECT unnest([0, 1, 2]) AS seed) WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = seed)")
def _(s, d):
    done = read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3).alias("seed"))
    return catalog.additional_seeds(read(s, d, "customer"), "c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), [0, 1, 2], done)


@query("k4_execution_registry", "SELECT o_orderkey, o_custkey, c_nationkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def _(s, d):
    models = read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    tracks = read(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return catalog.join_once(catalog.join_once(read(s, d, "orders").select("o_orderkey", "o_custkey"), models, ["o_custkey"]), tracks, ["c_nationkey"])


@query("t10_materialised_thresholds", "SELECT l_orderkey, l_linenumber, o_totalprice AS threshold FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(s, d):
    cuts = read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("threshold"))
    return catalog.join_covered(read(s, d, "lineitem").select("l_orderkey", "l_linenumber"), cuts, ["l_orderkey"], "threshold")


@query(
    "q10_position_check",
    "SELECT *, n_parts = n_positions AND first = 1 AND last = n_parts AS consistent FROM (SELECT l_orderkey, count(*) AS n_parts, count(DISTINCT l_linenumber) AS n_positions, min(l_linenumber) AS first, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey)",
)
def _(s, d):
    return catalog.position_check(read(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "t9_policy_selection",
    "WITH a AS (SELECT p_partkey, p_brand, p_size, p_retailprice, CASE WHEN p_size < 5 THEN 'incomplete' WHEN p_retailprice > 1800 THEN 'limit:price' END AS g FROM part), "
    "b AS (SELECT *, coalesce(g, CASE WHEN p_size > min(p_size) FILTER (g IS NULL) OVER (PARTITION BY p_brand) + 5 THEN 'plateau:p_size' END) AS h FROM a), "
    "c AS (SELECT *, coalesce(h, CASE WHEN p_retailprice < max(p_retailprice) FILTER (h IS NULL) OVER (PARTITION BY p_brand) - 200 THEN 'plateau:p_retailprice' END) AS i FROM b) "
    "SELECT p_partkey, p_brand, coalesce(i, CASE WHEN p_partkey = min(p_partkey) FILTER (i IS NULL) OVER (PARTITION BY p_brand) THEN 'selected' ELSE 'tie_break' END) AS stage FROM c",
)
def _(s, d):
    p = read(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return catalog.select_policies(p, ["p_brand"], F.col("p_size") >= 5, [("price", F.col("p_retailprice") <= 1800)], [("p_size", True, 5), ("p_retailprice", False, 200)], "p_partkey").select("p_partkey", "p_brand", "stage")


@query(
    "b16_acceptability",
    "WITH n AS (SELECT c_custkey, count(o_orderkey) AS n_stored, max(o_totalprice) AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey) "
    "SELECT c_custkey, n_stored, CASE WHEN n_stored = 0 THEN 'missing' WHEN n_stored > 1 THEN 'duplicated' WHEN x >= 1000 AND x <= 200000 THEN 'acceptable' ELSE 'calculable_but_not_acceptable' END AS status FROM n",
)
def _(s, d):
    stored = read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return catalog.acceptability(read(s, d, "customer"), stored, "c_custkey", {"o_totalprice": (1000.0, 200000.0)})


@query(
    "b15_paired_plan",
    "WITH r AS (SELECT p_brand, p_type, min(p_partkey) AS reference FROM part WHERE p_size = 1 GROUP BY ALL) SELECT p_partkey, p_size, reference, CASE WHEN reference IS NULL THEN 'not_estimable' ELSE 'planned' END AS status FROM part LEFT JOIN r USING (p_brand, p_type) WHERE p_size <> 1",
)
def _(s, d):
    return catalog.paired_plan(read(s, d, "part"), "p_partkey", "p_size", 1, ["p_brand", "p_type"])


@query(
    "a8_area_classes",
    "WITH x AS (SELECT l_returnflag, CASE WHEN l_quantity <= 5 THEN 'tiny' WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 20 THEN 'medium' WHEN l_quantity <= 40 THEN 'large' ELSE 'huge' END AS area_class, l_discount FROM lineitem), "
    "g AS (SELECT l_returnflag, area_class, count(*) AS n, count_if(l_discount > 0.05) AS n_detected, round(avg(l_discount), 6) AS mean_iou FROM x GROUP BY ALL), "
    "f AS (SELECT l_returnflag, area_class, i FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES ('tiny', 1), ('small', 2), ('medium', 3), ('large', 4), ('huge', 5)) v(area_class, i)) "
    "SELECT l_returnflag, area_class, coalesce(n, 0) AS n, CAST(coalesce(n_detected, 0) AS BIGINT) AS n_detected, round(n_detected / n, 6) AS recall, mean_iou, coalesce(i = min(i) FILTER (n > 0) OVER (PARTITION BY l_returnflag), false) AS smallest FROM f LEFT JOIN g USING (l_returnflag, area_class)",
)
def _(s, d):
    li = read(s, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") > 0.05).alias("detected"), F.col("l_discount").cast("double").alias("iou"))
    return rounded(catalog.area_classes(li, ["l_returnflag"], "l_quantity", "detected", "iou", [5, 10, 20, 40], ["tiny", "small", "medium", "large", "huge"]))


@query("u3_output_summary", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_totalprice) AS o_totalprice_least, round(median(o_totalprice), 6) AS o_totalprice_median, max(o_totalprice) AS o_totalprice_largest FROM orders GROUP BY ALL")
def _(s, d):
    return rounded(catalog.output_summary(read(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_totalprice"]))


@query(
    "r2_otsu_threshold",
    "WITH v AS (SELECT l_returnflag, l_quantity::DOUBLE AS v, min(l_quantity) OVER (PARTITION BY l_returnflag)::DOUBLE AS lo, max(l_quantity) OVER (PARTITION BY l_returnflag)::DOUBLE AS hi FROM lineitem), "
    "h AS (SELECT l_returnflag, lo, hi, least(255, floor((v - lo) * 256 / (hi - lo)))::BIGINT AS b, count(*) AS n FROM v GROUP BY ALL), "
    "c AS (SELECT *, sum(n) OVER w AS w1, sum(n * b) OVER w AS s1, sum(n) OVER (PARTITION BY l_returnflag) AS wt, sum(n * b) OVER (PARTITION BY l_returnflag) AS st FROM h WINDOW w AS (PARTITION BY l_returnflag ORDER BY b)), "
    "x AS (SELECT *, w1::DOUBLE * (wt - w1)::DOUBLE * power(s1 / w1 - (st - s1) / nullif(wt - w1, 0), 2) AS g FROM c) "
    "SELECT l_returnflag, round(lo + (b + 0.5) * (hi - lo) / 256, 6) AS threshold FROM x QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY g DESC NULLS LAST, b) = 1",
)
def _(s, d):
    return rounded(catalog.otsu(read(s, d, "lineitem"), "l_returnflag", "l_quantity"))


_KB = f"{P}, b AS (SELECT row, col FROM p WHERE spectrum[1] <= 1.0), e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM p), "
_OPEN = "w AS (WITH RECURSIVE r AS (SELECT row, col FROM b, e WHERE row IN (r0, r1) OR col IN (c0, c1) UNION SELECT n.row, n.col FROM r JOIN b n ON abs(n.row - r.row) + abs(n.col - r.col) = 1) SELECT * FROM r)"


@query("r3_hole_filling", f"{_KB}{_OPEN} SELECT 0 AS image, row, col FROM p ANTI JOIN w USING (row, col)")
def _(s, d):
    return raster.fill_holes(mask(s, d), pixels(s, d).select(F.lit(0).alias("image"), "row", "col"))


@query(
    "k5_reference_audit",
    "WITH a AS (SELECT o_orderkey, o_totalprice::DOUBLE AS stored FROM orders), b AS (SELECT l_orderkey AS o_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS rebuilt FROM lineitem GROUP BY ALL) "
    "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, 'price' AS metric, stored, rebuilt::DOUBLE AS rebuilt, CASE WHEN a.o_orderkey IS NULL THEN 'not_stored' WHEN b.o_orderkey IS NULL THEN 'not_rebuilt' WHEN abs(stored - rebuilt) <= 50000 THEN 'equal' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey",
)
def _(s, d):
    stored = read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))  # whole cents sum exactly in any order
    rebuilt = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((cents / 100.0).alias("price"))
    return catalog.reference_audit(stored, rebuilt, ["o_orderkey"], ["price"], 50000.0)


@query(
    "u4_per_image_errors",
    f"{L} SELECT lang, source, count(*) AS n, CAST(count_if(truth AND NOT prediction) AS BIGINT) AS n_fn, CAST(count_if(NOT truth AND prediction) AS BIGINT) AS n_fp, round(count_if(truth <> prediction) / count(*), 6) AS error_rate FROM l GROUP BY ALL",
)
def _(s, d):
    return rounded(catalog.per_image_errors(labelled(s, d), ["lang", "source"]))
