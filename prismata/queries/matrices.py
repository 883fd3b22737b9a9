"""Queries of matrices, samples and PCA diagnostics. Where a diagnostic needs scores, the first three values of a spectrum
stand for them, so that SQL can follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from prismata.operators import chain, chain_audit, factor, matrices, models, pca_metrics, sampling, simca
from prismata.plans.shared import materialize
from prismata.registry import BANDS, P, pixels, query, read, rounded


@query("m2_all_pixels", f"{P}, v AS (SELECT *, list_transform(spectrum, lambda x: x - 0.75) AS s FROM p) SELECT vec_id, n_object FROM v JOIN (SELECT object, count(*) AS n_object FROM p GROUP BY object) USING (object) WHERE len(list_filter(s, lambda x: x <= 0)) = 0")
def _(s, d):
    p = pixels(s, d).withColumn("spectrum", F.transform("spectrum", lambda x: x - 0.75))
    return sampling.all_pixels(p, p.groupBy("object").agg(F.count("*").alias("n_object")), "object").select("vec_id", "n_object")


@query("m4_centre_closest", f"{P}, c AS (SELECT *, sqrt(power(row - avg(row) OVER w, 2) + power(col - avg(col) OVER w, 2)) AS dist FROM p WINDOW w AS (PARTITION BY image)) SELECT image, vec_id, round(dist, 6) AS centre_distance FROM c QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(dist, 9), vec_id) <= 3")
def _(s, d):
    p = sampling.centre_distance(pixels(s, d), ["image"])
    return rounded(sampling.draw(p, ["image"], 3, [F.round("centre_distance", 9), "vec_id"]).select("image", "vec_id", "centre_distance"))


_DRAW = f"{P}, w AS (SELECT object, vec_id, row_number() OVER (PARTITION BY object ORDER BY md5('7:' || vec_id), vec_id) AS draw, count(*) OVER (PARTITION BY object) AS n FROM p)"


def drawn(s, d, policy, m=2):
    return sampling.draw(pixels(s, d), ["object"], m, [sampling.hash_order(F.lit(7), "vec_id"), "vec_id"], policy)


@query("m5_exclude_short", f"{_DRAW} SELECT object, vec_id FROM w WHERE draw <= 2 AND n >= 2")
def _(s, d):
    return drawn(s, d, "exclude").select("object", "vec_id")


@query("m5_replace_short", f"{_DRAW} SELECT object, CAST(draw + t * n AS INTEGER) AS draw, vec_id, CASE WHEN n < 3 THEN 'replaced' ELSE 'complete' END AS status FROM w, (SELECT unnest([0, 1, 2]) AS t) WHERE draw + t * n <= 3 AND (n < 3 OR t = 0)")
def _(s, d):
    return drawn(s, d, "replace", 3).select("object", "draw", "vec_id", "status")


@query("m6_selection_diagnostics", f"{_DRAW} SELECT object, n AS n_raw, n AS n_available, 0 AS n_invalid, count(*) AS n_selected, sha256(array_to_string(list_sort(list(vec_id)), ',')) AS selection_hash, CASE WHEN n < 2 THEN 'short' ELSE 'complete' END AS status FROM w WHERE draw <= 2 GROUP BY object, n")
def _(s, d):
    return sampling.selection_diagnostics(pixels(s, d), drawn(s, d, "short"), ["object"], "vec_id", F.lit(True)).select("object", "n_raw", "n_available", "n_invalid", "n_selected", "selection_hash", "status")


@query(
    "m7_matrix_registry",
    f"{P}, o AS (SELECT count(DISTINCT object) AS n FROM p), b AS (SELECT sum(least(n, 2)) AS n FROM (SELECT count(*) AS n FROM p GROUP BY object)), a AS (SELECT count(*) AS n FROM p) SELECT m AS matrix_method, f AS matrix_family, CAST(n AS BIGINT) AS n_rows FROM (SELECT 'object_mean' AS m, 'object_matrix' AS f, n FROM o UNION ALL SELECT 'object_median', 'object_matrix', n FROM o UNION ALL SELECT 'balanced_pixels', 'pixel_matrix', n FROM b UNION ALL SELECT 'all_pixels', 'pixel_matrix', n FROM a)",
)
def _(s, d):
    parts = [sampling.build_matrix(pixels(s, d), m, ["object"], "vec_id", 2).select("matrix_method", "matrix_family") for m in ("object_mean", "object_median", "balanced_pixels", "all_pixels")]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("matrix_method", "matrix_family").agg(F.count("*").alias("n_rows"))


@query(
    "m8_matrix_contract",
    f"{P}, n AS (SELECT count(DISTINCT label) AS k FROM p), o AS (SELECT count(*) AS k FROM (SELECT DISTINCT object FROM p WHERE vec_id % 10 = 3 EXCEPT SELECT object FROM p WHERE vec_id % 10 <> 3)) SELECT unnest(['not_empty', 'aligned', 'finite', 'varying_bands', 'rank_above_zero', 'classes_present', 'classes_expected', 'two_classes', 'objects_expected', 'spatial_columns']) AS \"check\", unnest([0, 0, 0, 0, 0, 1, n.k - 2, 0, o.k, 0]) AS n_broken, unnest([true, true, true, true, true, false, n.k = 2, true, o.k = 0, true]) AS passed FROM n, o",
)
def _(s, d):
    p = pixels(s, d)
    known = p.where("vec_id % 10 <> 3").select("object").distinct()
    return sampling.matrix_contract(p, "label", "image", "object", ["0", "1", "none"], known, level="pixel", spatial=("row", "col", "vec_id"))


_NOBJ = P + ", o AS (SELECT object, min(label) AS label, min(image) AS image, count(*) AS n FROM p GROUP BY object)"


@query(
    "m12_sampling_feasibility",
    f"{_NOBJ}, g AS (SELECT o.*, m, least(n, m) AS take FROM o, (SELECT unnest([1, 2, 3]) AS m)), a AS (SELECT m, count(*) AS n_objects, avg(CAST(n >= m AS DOUBLE)) AS e, CAST(sum(take) AS BIGINT) AS n_rows FROM g GROUP BY m), c AS (SELECT m, min(k) / max(k) AS r, count(*) AS n FROM (SELECT m, label, sum(take) AS k FROM g GROUP BY m, label) GROUP BY m), i AS (SELECT m, min(k) / max(k) AS r, count(*) AS n FROM (SELECT m, image, sum(take) AS k FROM g GROUP BY m, image) GROUP BY m) "
    "SELECT a.m, n_objects, round(e, 6) AS eligible_rate, n_rows, round(c.r, 6) AS class_balance_ratio, c.n AS n_class_groups, round(i.r, 6) AS image_balance_ratio, i.n AS n_image_groups, CASE WHEN e >= 0.9 THEN 'accepted' ELSE 'too_few_eligible' END AS status FROM a JOIN c USING (m) JOIN i USING (m)",
)
def _(s, d):
    objects = pixels(s, d).groupBy("object").agg(F.min("label").alias("label"), F.min("image").alias("image"), F.count("*").alias("n"))
    return rounded(sampling.feasibility_grid(objects, "label", "image", "n", [1, 2, 3]))


@query("m13_matrix_summary", f"{P} SELECT count(*) AS n_rows, 64 AS n_bands, count(DISTINCT label) AS n_classes, count(DISTINCT image) AS n_images, 0 AS n_non_finite, 0.0::DOUBLE AS zero_variance_rate, CAST(least(count(*), 64) AS INT) AS matrix_rank, 1.0::DOUBLE AS rank_ratio, 'accepted' AS status FROM p")
def _(s, d):
    return sampling.matrix_summary(pixels(s, d), "label", "image").select("n_rows", "n_bands", "n_classes", "n_images", "n_non_finite", "zero_variance_rate", "matrix_rank", "rank_ratio", "status")


@query(
    "m13_rank_at_offset",
    f"{BANDS}, v AS (SELECT label, band, var_samp(v) AS v FROM b GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM p GROUP BY label) SELECT CAST(label AS VARCHAR) AS model, n, 67 AS width, CAST(least(n, 64) AS INT) AS rank, CAST(least(n - 1, 64) AS INT) AS centred_rank, CAST(least(n, 64) AS BIGINT) AS n_independent, round(sum(v.v), 4) AS total_variance FROM n JOIN v USING (label) GROUP BY label, n",
)
def _(s, d):
    """A million is added to every value, and three bands are sums of two others: rank, and the eigenvalues' sum without these."""
    x = F.transform("spectrum", lambda v: v + 1e6)
    p = pixels(s, d).select("label", x.alias("x")).withColumn("y", F.concat("x", F.array(F.col("x")[0] + F.col("x")[1], F.col("x")[2] - F.col("x")[3], F.col("x")[4] + F.col("x")[5])))
    stored = factor.factors(p, "label", "y")
    variance = models.fit_pca(p, "label", "x").select("model", F.aggregate("eigenvalues", F.lit(0.0), lambda a, v: a + v).alias("total_variance"))
    found = factor.independent_bands(stored).groupBy("model").agg(F.count("*").alias("n_independent"))
    return rounded(factor.ranks(stored).select("model", "n", "width", "rank", "centred_rank").join(found, "model").join(variance, "model"), 4)


@query("m14_preprocessing_grid", f"{P}, e AS (SELECT vec_id, unnest(spectrum) AS v, generate_subscripts(spectrum, 1) AS band FROM p WHERE batch = 3), x AS (SELECT 'raw' AS chain, v FROM e UNION ALL SELECT 'absorbance', -log10(v) FROM e UNION ALL SELECT 'snv', (v - avg(v) OVER w) / stddev_samp(v) OVER w FROM e WINDOW w AS (PARTITION BY vec_id)) SELECT chain, (SELECT count(DISTINCT vec_id) FROM e) AS n_rows, 0 AS n_nan, 0 AS n_inf, round(min(v), 6) AS least, round(max(v), 6) AS largest, 0.0::DOUBLE AS zero_variance_rate, 'accepted' AS status FROM x GROUP BY chain")
def _(s, d):
    p = pixels(s, d)
    names = ["raw", "absorbance", "snv"]
    return rounded(chain.grid_audit(p.where("batch IN (1, 2)"), p.where("batch = 3"), [chain.Chain(chain.catalogue()[n]) for n in names], names))


@query(
    "m14_chain_audit",
    f"{P}, e AS (SELECT vec_id, batch < 3 AS fit, unnest(spectrum) AS v, generate_subscripts(spectrum, 1) AS band FROM p WHERE batch < 4), x AS (SELECT 'raw' AS chain, * FROM e UNION ALL SELECT 'absorbance', vec_id, fit, -log10(v), band FROM e UNION ALL SELECT 'snv', vec_id, fit, (v - avg(v) OVER w) / stddev_samp(v) OVER w, band FROM e WINDOW w AS (PARTITION BY vec_id)) "
    "SELECT chain, count(DISTINCT vec_id) FILTER (fit) AS n_fit, count(DISTINCT vec_id) FILTER (NOT fit) AS n_eval, 64 AS n_features, round(min(v), 6) AS least, round(max(v), 6) AS largest, round(count_if(v <= -2 OR v >= 2) / count(*), 6) AS saturation_rate, 0.0::DOUBLE AS repeatability_error, CASE WHEN count_if(v <= -2 OR v >= 2) > 0 THEN 'invalid' ELSE 'accepted' END AS status FROM x GROUP BY chain",
)
def _(s, d):
    p = pixels(s, d)
    chains = {n: chain.Chain(chain.catalogue()[n]) for n in ("raw", "absorbance", "snv")}
    summary, _ = chain_audit.audit(p.where("batch IN (1, 2)"), p.where("batch = 3"), chains, saturation=(-2.0, 2.0))
    return rounded(summary.select("chain", "n_fit", "n_eval", "n_features", "least", "largest", "saturation_rate", "repeatability_error", "status"))


@query("m15_minhash_sketch", f"{P}, h AS (SELECT image, salt, min(substring(sha256(salt || '|' || object || '|' || row || '|' || col), 1, 16)) AS h FROM p, (SELECT unnest(range(0, 8)) AS salt) GROUP BY image, salt) SELECT image, string_agg(h, ',' ORDER BY salt) AS sketch FROM h GROUP BY image")
def _(s, d):
    return sampling.minhash_sketch(pixels(s, d), ["image"], F.concat_ws("|", "object", F.col("row").cast("string"), F.col("col").cast("string")))


@query("m16_stratified_sample", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('5:' || p_partkey), p_partkey) <= 4")
def _(s, d):
    return sampling.stratified(read(s, d, "part"), ["p_brand"], 4, 5, "p_partkey").select("p_brand", "p_partkey")


@query("m17_keep_chosen", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey FROM r WHERE p_size = 50 OR n <= 3 OR i = 0 OR floor(i * 2 / greatest(n - 1, 1)) > floor((i - 1) * 2 / greatest(n - 1, 1))")
def _(s, d):
    part = read(s, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return sampling.keep_chosen(matrices.evenly_spaced(part, ["p_brand"], ["p_retailprice", "p_partkey"], 3), part, part.where("p_size = 50"), ["p_partkey"]).select("p_brand", "p_partkey")


@query("m18_annotation_subset", "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) <= greatest(1, ceil(count(*) OVER (PARTITION BY c_mktsegment) * 0.1))")
def _(s, d):
    return sampling.annotation_subset(read(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], 0.1, 3, "c_custkey")


# PCA diagnostics


def scored(s, d):
    return pixels(s, d).withColumn("scores", F.slice("spectrum", 1, 3)).withColumn("two", (F.col("label") % 2).cast("string")).withColumn("q", F.col("spectrum")[3])


T = P + ", t AS (SELECT *, spectrum[1] AS a, spectrum[2] AS b, spectrum[3] AS c, spectrum[4] AS q, label % 2 AS two FROM p)"


@query("g2_reconstruction", f"{P}, e AS (SELECT label, avg(list_sum(list_transform(spectrum, lambda x: x))) AS m FROM p GROUP BY label) SELECT count(*) AS n, true AS exact FROM p")
def _(s, d):
    """With all components the reconstruction is the spectrum."""
    p = pixels(s, d).withColumn("one", F.lit("all"))
    fit = simca.eigensystems(p, "one", "spectrum").first()
    loads = [list(x) for x in fit["loadings"]]
    centred = F.zip_with("spectrum", F.array(*map(F.lit, fit["mean"])), lambda x, m: x - m)
    dot = lambda w: F.aggregate(F.zip_with(centred, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    t = materialize(p.select("vec_id", "spectrum", F.array(*[dot(w) for w in loads]).alias("scores")), "scores")
    back = pca_metrics.reconstruct(t, list(fit["mean"]), loads)
    near = F.forall(F.zip_with("spectrum", "reconstruction", lambda x, y: F.abs(x - y)), lambda e: e < 1e-9)
    return back.agg(F.count("*").alias("n"), F.every(near).alias("exact"))


@query("g3_hotelling", f"{T} SELECT vec_id, round(a * a / 0.5 + b * b / 0.25 + c * c / 0.1, 3) AS t2 FROM t")
def _(s, d):
    return rounded(scored(s, d).select("vec_id", pca_metrics.hotelling(F.col("scores"), [0.5, 0.25, 0.1]).alias("t2")), 3)


@query(
    "g5_class_separation",
    f"{T}, m AS (SELECT two, avg(a) AS a, avg(b) AS b, avg(c) AS c, var_samp(a) AS va, var_samp(b) AS vb, var_samp(c) AS vc, covar_samp(a, b) AS ab, count(*) AS n FROM t GROUP BY two), x AS (SELECT l.a - r.a AS da, l.b - r.b AS db, l.c - r.c AS dc, l.va + r.va AS va, l.vb + r.vb AS vb, l.vc + r.vc AS vc, ((l.n - 1) * l.va + (r.n - 1) * r.va) / (l.n + r.n - 2) + 1e-6 AS p, ((l.n - 1) * l.vb + (r.n - 1) * r.vb) / (l.n + r.n - 2) + 1e-6 AS q, ((l.n - 1) * l.ab + (r.n - 1) * r.ab) / (l.n + r.n - 2) AS o FROM m l, m r WHERE l.two = 0 AND r.two = 1) "
    "SELECT round(sqrt(da * da + db * db), 6) AS centroid_distance_2, round(sqrt(da * da + db * db + dc * dc), 6) AS centroid_distance_3, round(da * da / (va + 1e-12), 6) AS fisher_1, round(db * db / (vb + 1e-12), 6) AS fisher_2, round(dc * dc / (vc + 1e-12), 6) AS fisher_3, round(sqrt((q * da * da - 2 * o * da * db + p * db * db) / (p * q - o * o)), 6) AS mahalanobis_2 FROM x",
)
def _(s, d):
    return rounded(pca_metrics.class_separation(scored(s, d), "two").drop("mahalanobis_3"))


@query("g6_trace_ratio", f"{T}, g AS (SELECT *, avg(a) OVER () AS ga, avg(b) OVER () AS gb, avg(c) OVER () AS gc, avg(a) OVER w AS ma, avg(b) OVER w AS mb, avg(c) OVER w AS mc FROM t WINDOW w AS (PARTITION BY label)) SELECT round(sum(power(ma - ga, 2) + power(mb - gb, 2) + power(mc - gc, 2)) / sum(power(a - ma, 2) + power(b - mb, 2) + power(c - mc, 2)), 6) AS trace_ratio, count(DISTINCT label) AS n_groups FROM g")
def _(s, d):
    return rounded(pca_metrics.trace_ratio(scored(s, d), "label"))


@query("g7_compactness", f"{T}, g AS (SELECT label, sqrt(power(a - avg(a) OVER w, 2) + power(b - avg(b) OVER w, 2) + power(c - avg(c) OVER w, 2)) AS d, a, b, c FROM t WINDOW w AS (PARTITION BY label)), h AS (SELECT label, var_samp(a) + var_samp(b) + var_samp(c) AS tr, avg(d) AS m, quantile_cont(d, 0.95) AS q FROM g GROUP BY label) SELECT round(avg(tr), 6) AS within_class_trace, round(avg(m), 6) AS mean_distance_to_class_centroid, round(avg(q), 6) AS q95_distance_to_class_centroid FROM h")
def _(s, d):
    return rounded(pca_metrics.compactness(scored(s, d), "label"))


@query("g8_centroid_displacement", f"{T}, g AS (SELECT avg(a) AS a, avg(b) AS b, avg(c) AS c FROM t) SELECT batch, round(sqrt(power(avg(t.a) - max(g.a), 2) + power(avg(t.b) - max(g.b), 2) + power(avg(t.c) - max(g.c), 2)), 6) AS centroid_shift FROM t, g GROUP BY batch")
def _(s, d):
    return rounded(pca_metrics.displacements(scored(s, d), "batch"))


@query("g9_distance_summary", f"{T} SELECT round(avg(q), 6) AS train_q_mean, round(median(q), 6) AS train_q_median, round(quantile_cont(q, 0.95), 6) AS train_q_q95 FROM t")
def _(s, d):
    return rounded(pca_metrics.distance_summary(scored(s, d), ["q"], "train"))


_SHIFT = f"{T}, x AS (SELECT label, count(*) FILTER (batch < 3) AS n, avg(a) FILTER (batch < 3) - avg(a) FILTER (batch = 3) AS da, avg(b) FILTER (batch < 3) - avg(b) FILTER (batch = 3) AS db, avg(c) FILTER (batch < 3) - avg(c) FILTER (batch = 3) AS dc, sqrt(var_samp(a) FILTER (batch < 3) + var_samp(b) FILTER (batch < 3) + var_samp(c) FILTER (batch < 3)) AS sc FROM t GROUP BY label), y AS (SELECT sqrt(da * da + db * db + dc * dc) AS s, CASE WHEN n > 1 THEN sc ELSE 1e-12 END AS sc FROM x WHERE da IS NOT NULL)"


@query("g10_projection_shift", f"{_SHIFT} SELECT round(avg(s), 6) AS mean_shift, round(max(s), 6) AS max_shift, round(avg(s / sc), 6) AS mean_shift_norm, round(max(s / sc), 6) AS max_shift_norm FROM y")
def _(s, d):
    t = scored(s, d)
    return rounded(pca_metrics.projection_shift(t.where("batch < 3"), t.where("batch = 3"), "label"))


@query("g11_object_scores", f"{T} SELECT object, round(avg(a), 6) AS s1, round(CASE WHEN count(*) > 1 THEN var_samp(a) + var_samp(b) + var_samp(c) END, 6) AS trace, count(*) AS n_pixels FROM t GROUP BY object")
def _(s, d):
    return rounded(pca_metrics.object_scores(scored(s, d), ["object"]).select("object", F.col("scores")[0].alias("s1"), "trace", "n_pixels"))


@query("g11_object_metrics", f"{T}, i AS (SELECT object, var_samp(a) + var_samp(b) + var_samp(c) AS tr FROM t GROUP BY object), o AS (SELECT object, label, batch, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM t GROUP BY object, label, batch), w AS (SELECT var_samp(a) + var_samp(b) + var_samp(c) AS bt FROM o) SELECT round((SELECT avg(tr) FROM i), 6) AS mean_intra_object_trace, round(bt / (SELECT avg(tr) FROM i), 5) AS object_over_intra_ratio FROM w")
def _(s, d):
    return rounded(rounded(pca_metrics.object_metrics(scored(s, d), "object", "label", "batch").select("mean_intra_object_trace", "object_over_intra_ratio")).select("mean_intra_object_trace", F.round("object_over_intra_ratio", 5).alias("object_over_intra_ratio")))


@query("g12_pca_summary", f"{_SHIFT} SELECT round(avg(s), 6) AS mean_shift, (SELECT round(avg(q), 6) FROM t WHERE batch < 3) AS train_q_mean, (SELECT round(abs(avg(q) FILTER (batch = 3) / avg(q) FILTER (batch < 3) - 1), 6) FROM t) AS projection_q_deviation FROM y")
def _(s, d):
    t = scored(s, d)
    return rounded(pca_metrics.summary(t.where("batch < 3"), t.where("batch = 3"), "label", "object", "batch").select("mean_shift", "train_q_mean", "projection_q_deviation"))


_PLAN = "WITH m AS (SELECT 'cal_m' || p_size || '_' || CASE WHEN p_size % 2 = 0 THEN 'random' ELSE 'center' END AS matrix_id, CAST(p_size AS INTEGER) AS m, CASE WHEN p_size % 2 = 0 THEN 'random' ELSE 'center' END AS strategy FROM part WHERE p_size % 3 = 0 GROUP BY p_size)"


@query("g13_candidate_plan", f"{_PLAN} SELECT matrix_id, m, strategy, chain, 'pca_' || substring(sha256(to_json({{'matrix_id': matrix_id, 'chain': chain}})), 1, 20) AS candidate_id FROM m, (VALUES ('snv'), ('sg_d1')) c(chain) WHERE m > 10")
def _(s, d):
    sizes = read(s, d, "part").select(F.col("p_size").cast("int").alias("m")).distinct().withColumn("strategy", F.when(F.col("m") % 2 == 0, "random").otherwise("center"))
    ids = sizes.select(F.concat(F.lit("cal_m"), F.col("m"), F.lit("_"), "strategy").alias("matrix_id"), F.when(F.col("m") % 3 == 0, "accepted").otherwise("rejected").alias("status"))
    chains = s.createDataFrame([("snv", 5, "accepted"), ("sg_d1", 9, "accepted"), ("sg_d2", 5, "accepted"), ("raw", 5, "invalid")], "chain string, window int, status string")
    return pca_metrics.candidate_plan(ids, chains, sizes.withColumn("status", F.when(F.col("m") > 10, "accepted").otherwise("too_few_eligible")), 9)


def _models(s, d):
    """A model per label and batch, and one over both calibration batches."""
    p = pixels(s, d).where("batch < 3")
    rows = p.select("label", F.concat(F.lit("1_"), F.col("batch")).alias("run"), "spectrum").union(p.select("label", F.lit("0_all"), "spectrum"))
    fit = simca.eigensystems(rows.withColumn("key", F.concat_ws("|", "label", "run")), "key", "spectrum")
    return fit.select(F.split("model", r"\|")[0].alias("candidate"), F.split("model", r"\|")[1].alias("run"), "loadings", "eigenvalues", "n")


@query("g15_loading_stability")
def _(s, d):
    return rounded(pca_metrics.loading_stability(_models(s, d), "candidate", "run", 3), 4)


@query("g14_representation_comparison")
def _(s, d):
    """Each label's chains compared: explained share of three components and the shift of batch 3."""
    p = pixels(s, d)
    out = []
    for name in ("raw", "snv", "absorbance"):
        c = chain.Chain(chain.catalogue()[name]).fit(p.where("batch < 3"))
        train, proj = c.transform(p.where("batch < 3")).withColumn("key", F.lit(name)), c.transform(p.where("batch = 3"))
        fit = simca.eigensystems(train, "key", "spectrum")
        q = lambda df: simca.distances(df.select("vec_id", "spectrum"), fit, 3, "spectrum").agg(F.avg("q").alias("q"))  # noqa: B023, E731
        share = fit.select((F.aggregate(F.slice("eigenvalues", 1, 3), F.lit(0.0), lambda a, x: a + x) / F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x)).alias("explained"))
        out.append(share.crossJoin(q(train).withColumnRenamed("q", "train_q")).crossJoin(q(proj).withColumnRenamed("q", "projection_q")).select(F.lit(name).alias("chain"), "explained", "train_q", "projection_q"))
    return rounded(reduce(lambda a, b: a.unionByName(b), out))
