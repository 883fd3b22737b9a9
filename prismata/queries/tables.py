"""Queries of sources, sinks, contracts and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.operators import evaluation
from prismata.plans.shared import new_path
from prismata.registry import P, labelled, pixels, query, read, rounded
from prismata.sources import contracts, tables


@query("s1_batch_load", f"{P} SELECT vec_id, batch FROM p WHERE batch IN (1, 3)")
def _(s, d):
    path = new_path(s, "by-batch")
    tables.save(pixels(s, d).select("vec_id", "batch"), path, ["batch"])
    return tables.load_batches(s, path, [1, 3]).select("vec_id", "batch")


@query("s2_parquet_sink", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def _(s, d):
    path = new_path(s, "sink")
    df = read(s, d, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    tables.save_nonempty(df, path, keep_empty=True)
    return s.read.schema(df.schema).parquet(path)


_FIT = "CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"


@query("s3_type_shrinking", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_FIT.format(c=c)} AS type FROM lineitem" for c in ("l_orderkey", "l_suppkey", "l_linenumber")))
def _(s, d):
    small = tables.shrink(read(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"))
    types = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in small.dtypes])
    return small.agg(F.count("*").alias("n")).select(F.explode(types).alias("x")).select("x.*")


@query("s4_nested_to_json", "SELECT event_type, to_json({'user_id': user_id, 'event_id': event_id}) AS pair, to_json([user_id, event_id]) AS list FROM events")
def _(s, d):
    return tables.nested_to_json(read(s, d, "events").select("event_type", F.struct("user_id", "event_id").alias("pair"), F.array("user_id", "event_id").alias("list")))


@query("s9_empty_safe_concat", "SELECT s_suppkey AS key, s_nationkey, NULL AS c_mktsegment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def _(s, d):
    a = read(s, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey")
    b = read(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    return tables.concat_tables([a, b, a.where("false")]).select("key", "s_nationkey", "c_mktsegment")


@query("s11_image_manifest", f"{P} SELECT image, max(row) - min(row) + 1 AS height, max(col) - min(col) + 1 AS width, count(*) AS n_pixels, 64 AS n_bands, 0 AS n_nan, 0 AS n_inf, 'ok' AS status FROM p GROUP BY image")
def _(s, d):
    return tables.image_manifest(pixels(s, d), ["image"], 64)


@query("s12_image_summary", f"{P} SELECT image, count(DISTINCT object) AS n_objects, count(*) AS n_pixels, round(avg(CAST(spectrum[1] > 1 AS DOUBLE)), 6) AS mask_area_ratio FROM p GROUP BY image")
def _(s, d):
    return rounded(tables.image_summary(pixels(s, d), ["image"], "object", F.col("spectrum")[0] > 1))


@query("s12_object_summary", f"{P} SELECT object, count(*) AS n_pixels, 64 AS n_bands, (max(row) - min(row) + 1) * (max(col) - min(col) + 1) AS box_area FROM p GROUP BY object")
def _(s, d):
    return tables.object_summary(pixels(s, d), ["object"])


@query("s13_database_manifest", f"{P}, h AS (SELECT sha256(to_json({{'vec_id': vec_id, 'label': label}})) AS h FROM p), b AS (SELECT substring(h, 1, 4) AS b, sha256(array_to_string(list_sort(list(h)), '|')) AS h FROM h GROUP BY ALL) SELECT (SELECT count(DISTINCT image) FROM p) AS n_images, (SELECT count(DISTINCT object) FROM p) AS n_objects, (SELECT count(*) FROM p) AS n_pixels, 64 AS n_bands, sha256(array_to_string(list_sort(list(b || h)), '|')) AS fingerprint FROM b")
def _(s, d):
    return tables.database_manifest(pixels(s, d), "image", "object", ["vec_id", "label"])


_KEYS = "WITH k AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ALM' || (s_suppkey % 5) WHEN 1 THEN 'pea' || (s_suppkey % 5) || '_pos' || s_suppkey WHEN 2 THEN ' alm1pea2_sb' ELSE 'x' || s_suppkey END AS key FROM supplier)"


@query("p2_role_and_label", f"{_KEYS} SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN CASE s_suppkey % 5 WHEN 1 THEN 'calibration' WHEN 2 THEN 'calibration' WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'unknown' END WHEN 1 THEN 'spatial_reference' WHEN 2 THEN 'application' ELSE 'unknown' END AS role, CASE s_suppkey % 4 WHEN 0 THEN 'almond' WHEN 1 THEN 'peanut' END AS label FROM k")
def _(s, d):
    k = F.col("s_suppkey")
    n = (k % 5).cast("string")
    key = F.when(k % 4 == 0, F.concat(F.lit("ALM"), n)).when(k % 4 == 1, F.concat(F.lit("pea"), n, F.lit("_pos"), k.cast("string"))).when(k % 4 == 2, " alm1pea2_sb").otherwise(F.concat(F.lit("x"), k.cast("string")))
    parts = tables.parse_key(key)
    return read(s, d, "supplier").select("s_suppkey", parts["role"].alias("role"), tables.object_label(parts["kind"], key).alias("label"))


@query("p3_dict_filter", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#12', 'Brand#21') AND p_size = 7")
def _(s, d):
    return tables.filter_values(read(s, d, "part"), {"p_brand": ["Brand#1", "Brand#2", "Brand#12", "Brand#21"], "p_size": 7, "p_type": None, "no_such": None}).select("p_partkey")


@query("p5_band_trim", f"{P} SELECT vec_id, len(spectrum[7:60]) AS n_bands, round(spectrum[7], 6) AS first, round(spectrum[60], 6) AS last FROM p")
def _(s, d):
    from prismata.functions.spectra import trim

    t = pixels(s, d).select("vec_id", trim(F.col("spectrum"), 64, 6, 4).alias("t"))
    return rounded(t.select("vec_id", F.size("t").alias("n_bands"), F.col("t")[0].alias("first"), F.element_at("t", -1).alias("last")))


@query("p6_wavelength_axis", f"{P} SELECT vec_id, round(889.0 + 6 * (1702.0 - 889.0) / 63 + 12.904761904761905 * (list_position(spectrum[7:60], list_max(spectrum[7:60])) - 1), 3) AS peak_nm FROM p")
def _(s, d):
    from prismata.functions.spectra import trim, wavelength_axis

    axis = F.array(*map(F.lit, wavelength_axis(889.0, 1702.0, 64, 6, 4)))
    t = pixels(s, d).select("vec_id", trim(F.col("spectrum"), 64, 6, 4).alias("t"))
    return rounded(t.select("vec_id", F.element_at(axis, F.array_position("t", F.array_max("t")).cast("int")).alias("peak_nm")), 3)


@query("p7_axis_lock", f"{P}, x AS (SELECT batch, CASE WHEN batch = 4 AND vec_id % 8 = 3 THEN 63 ELSE len(spectrum) END AS n FROM p) SELECT batch, count(DISTINCT n) AS n_axes, count(DISTINCT n) = 1 AS locked FROM x GROUP BY batch")
def _(s, d):
    n = F.when((F.col("batch") == 4) & (F.col("vec_id") % 8 == 3), 63).otherwise(F.size("spectrum"))
    return tables.axis_lock(pixels(s, d).select("batch", F.sequence(F.lit(1), n).alias("axis")), "batch", "axis").select("batch", "n_axes", "locked")


_MIXED = "CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'nan' WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN 'inf' ELSE ' x ' END"


def mixed(s, d):
    k = F.col("o_orderkey") % 5
    return read(s, d, "orders").withColumn("t", F.when(k == 0, "true").when(k == 1, "nan").when(k == 2, F.col("o_custkey").cast("string")).when(k == 3, "inf").otherwise(" x "))


@query("p9_first_finite", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN CAST(o_custkey AS DOUBLE) ELSE round(o_totalprice, 2) END AS value FROM orders")
def _(s, d):
    return rounded(mixed(s, d).select("o_orderkey", tables.first_finite("t", "o_totalprice").alias("value")), 2)


@query("p10_numeric_audit", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN CAST(o_custkey AS DOUBLE) END AS value FROM orders")
def _(s, d):
    return mixed(s, d).select("o_orderkey", tables.audit_number(F.col("t")).alias("value"))


@query("p11_operator_comparison", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size = 20 WHEN 1 THEN p_size <= 20 WHEN 2 THEN p_size >= 20 WHEN 3 THEN p_size < 20 WHEN 4 THEN p_size > 20 ELSE false END AS met FROM part")
def _(s, d):
    op = F.element_at(F.array(*map(F.lit, ("==", "<=", ">=", "<", ">", "~"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(s, d, "part").select("p_partkey", tables.compare(F.col("p_size").cast("double"), op, F.lit(20.0)).alias("met"))


@query("p12_suffix_repair", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) AS v FROM orders")
def _(s, d):
    df = read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("v_x"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("v_y"))
    return tables.repair_suffixes(df).select("o_orderkey", "v")


@query("p13_candidate_columns", "SELECT p_partkey, p_brand AS family, coalesce(CASE WHEN p_size > 10 THEN p_size END, 5) AS n_components, 'simple' AS rule FROM part")
def _(s, d):
    df = read(s, d, "part").select("p_partkey", F.col("p_brand").alias("matrix_family"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("k"))
    return tables.normalise_columns(df, {"family": ["matrix_family"], "n_components": ["k", "ncomp"], "rule": ["rule_name"]}, {"n_components": 5, "rule": "simple"}).select("p_partkey", "family", "n_components", "rule")


@query("p16_check_table", "SELECT unnest(['positive', 'small', 'dated']) AS \"check\", unnest([count_if(NOT l_quantity > 0), count_if(NOT l_quantity <= 40), count_if(l_shipdate IS NULL)]) AS n_failed, unnest([count_if(NOT l_quantity > 0) = 0, count_if(NOT l_quantity <= 40) = 0, count_if(l_shipdate IS NULL) = 0]) AS passed FROM lineitem")
def _(s, d):
    return tables.checks(read(s, d, "lineitem"), {"positive": F.col("l_quantity") > 0, "small": F.col("l_quantity") <= 40, "dated": F.col("l_shipdate").isNotNull()})


@query("p19_config_metadata", "SELECT l_orderkey, l_linenumber, o_orderpriority, o_orderstatus FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def _(s, d):
    return evaluation.attach(read(s, d, "lineitem").select("l_orderkey", "l_linenumber"), read(s, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"], ["o_orderpriority", "o_orderstatus"])


@query("p20_class_labels", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'peanut' WHEN 1 THEN 'almond' WHEN 2 THEN 'unknown' WHEN 3 THEN lower(trim(lang)) ELSE 'unknown' END AS label FROM documents")
def _(s, d):
    k = F.col("doc_id") % 5
    text = F.when(k == 0, " PEA ").when(k == 1, "Non_Target").when(k == 2, "  ").when(k == 3, F.concat(F.lit(" "), F.upper("lang")))
    return read(s, d, "documents").select("doc_id", tables.class_label(text).alias("label"))


@query("s7_contract_form", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def _(s, d):
    """The contract's columns in its order, unique by key, without the column that holds nothing."""
    o = read(s, d, "orders").withColumn("note", F.lit(None).cast("string"))
    return contracts.conform(o, contracts.Contract(("o_custkey", "note", "o_orderkey", "o_totalprice"), ("o_orderkey",)))


@query("s10_numbered_batches", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, 'batch_' || lpad(CAST(i // 100 + 1 AS VARCHAR), 4, '0') AS batch_id, CAST(i // 100 * 100 AS BIGINT) AS row_start, CAST(least(i // 100 * 100 + 100, n) AS BIGINT) AS row_stop FROM r")
def _(s, d):
    return contracts.numbered_batches(read(s, d, "orders"), ["o_orderstatus", "o_orderkey"], 100).select("o_orderkey", "batch_id", "row_start", "row_stop")


@query("s3_category_columns", " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) / count(*) <= 0.5 AS few FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def _(s, d):
    o = read(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    found = contracts.category_columns(o)
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c in found).alias("few")) for c in ("o_orderstatus", "o_orderpriority")])).alias("x")
    return o.agg(F.count("*").alias("n")).select(names).select("x.*")
