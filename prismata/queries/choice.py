"""Queries of choices among candidates; the parts stand for configurations, orders for runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from prismata.operators import choice, leaders, review
from prismata.operators.selection import pareto_front
from prismata.registry import query, read, rounded


def part(s, d):
    return read(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


_DOM = "b.p_brand = a.p_brand AND b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice)"
_FRONT = f"f AS (SELECT * FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE {_DOM}))"


@query("j2_front_with_witness", f"WITH {_FRONT} SELECT a.p_partkey, min(b.p_partkey) AS witness, min(b.p_partkey) IS NULL AS on_front FROM part a LEFT JOIN f b ON {_DOM} GROUP BY a.p_partkey")
def _(s, d):
    return choice.front_with_witness(part(s, d), ["p_brand"], ["p_size", "p_retailprice"], "p_partkey").select("p_partkey", "witness", "on_front")


_TYPE = "x.p_type = y.p_type AND x.p_retailprice <= y.p_retailprice AND x.p_partkey <= y.p_partkey AND (x.p_retailprice < y.p_retailprice OR x.p_partkey < y.p_partkey)"


@query("j3_sequential_fronts", "WITH a AS (SELECT * FROM part y WHERE NOT EXISTS (SELECT 1 FROM part x WHERE x.p_size < y.p_size)), b AS (SELECT * FROM a y WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.p_retailprice < y.p_retailprice)) SELECT 'small' AS pass, (SELECT count(*) FROM part) AS n_before, (SELECT count(*) FROM a) AS n_after UNION ALL SELECT 'cheap', (SELECT count(*) FROM a), (SELECT count(*) FROM b)")
def _(s, d):
    df = part(s, d).withColumn("all", F.lit(0))
    return choice.sequential_fronts(df, ["all"], [("small", ["p_size"]), ("cheap", ["p_retailprice"])])[1]


_CAL = (
    "WITH a AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'error' WHEN p_partkey % 3 < 1 THEN 'coverage' END AS s0, floor(p_retailprice / 100) AS risk FROM part), b AS (SELECT *, min(CASE WHEN s0 IS NULL THEN risk END) OVER (PARTITION BY p_brand) AS best FROM a), "
    "c AS (SELECT *, coalesce(s0, CASE WHEN risk > best + 2 THEN 'plateau' END) AS s1 FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY p_brand, risk, s1 IS NULL ORDER BY p_size, p_partkey) AS rn FROM c), f AS (SELECT *, coalesce(s1, CASE WHEN rn > 1 THEN 'larger' END) AS s2 FROM e) "
    "SELECT p_partkey, coalesce(s2, CASE WHEN EXISTS (SELECT 1 FROM f y WHERE y.s2 IS NULL AND y.p_brand = f.p_brand AND y.risk <= f.risk AND y.p_size <= f.p_size AND (y.risk < f.risk OR y.p_size < f.p_size)) THEN 'dominated' ELSE 'selected' END) AS stage FROM f"
)


@query("j5_calibrated_models", _CAL)
def _(s, d):
    df = part(s, d).withColumns({"error": F.when(F.col("p_partkey") % 11 == 0, "failed"), "n_folds": F.col("p_partkey") % 3, "risk": F.floor(F.col("p_retailprice") / 100).cast("double"), "size": F.col("p_size").cast("double")})
    return choice.calibrated_models(df, "p_brand", "p_partkey", 1, "risk", 2.0, "p_size", "p_partkey", ["risk", "size"]).select("p_partkey", "stage")


@query(
    "j7_input_guardrails",
    "SELECT 'split' AS \"check\", 'error' AS level, count_if(o_orderstatus <> 'F') AS n, count_if(o_orderstatus <> 'F') = 0 AS passed, count_if(o_orderstatus <> 'F') > 0 AS blocks FROM orders UNION ALL SELECT 'thresholds', 'error', count(*), count(*) = 0, count(*) > 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) "
    "UNION ALL SELECT 'unique_models', 'error', 0, true, false UNION ALL SELECT 'tracks', 'warning', 1, false, false",
)
def _(s, d):
    o, c = read(s, d, "orders"), read(s, d, "customer")
    return choice.input_guardrails(c, o.select(F.col("o_custkey").alias("c_custkey")).distinct(), o, "c_custkey", ["BUILDING", "MACHINERY", "NO SUCH TRACK"], "c_mktsegment", "o_orderstatus", "F")


_EQ = "WITH a AS (SELECT *, round(p_retailprice / 500, 0) AS m, p_size % 2 AS u FROM part), b AS (SELECT *, min(p_partkey) OVER (PARTITION BY m, p_brand, u) AS f1 FROM a), c AS (SELECT *, min(p_partkey) OVER (PARTITION BY m, p_brand, p_type) AS f2 FROM b WHERE p_partkey = f1)"


@query("j9_metric_equivalent", f"{_EQ} SELECT p_partkey, f1 AS representative, 0 AS parameter_group FROM b WHERE p_partkey <> f1 UNION ALL SELECT p_partkey, f2, 1 FROM c WHERE p_partkey <> f2")
def _(s, d):
    df = part(s, d).withColumns({"m": F.round(F.col("p_retailprice") / 500, 0), "u": F.col("p_size") % 2})
    return choice.metric_equivalent(df, "p_partkey", ["m"], ["p_brand"], [["p_type"], ["u"]])[1]


def variants(s, d):
    df = part(s, d).withColumns({"m": F.round(F.col("p_retailprice") / 200, 0), "u": F.col("p_size") % 3})
    return leaders.collapse(df, "p_partkey", ["m"], ["p_brand", "p_type", "u"], ["p_partkey"], 1)


@query("j9_greedy_kept")
def _(s, d):
    """What is left when every part drops later ones of equal price class that differ in one of three parameters; the tests
    hold it against a plain loop."""
    return variants(s, d)[0].select("p_partkey")


@query("j9_greedy_dropped")
def _(s, d):
    return variants(s, d)[1]


@query("j9_greedy_summary")
def _(s, d):
    return variants(s, d)[2]


@query("j10_output_signatures", "WITH p AS (SELECT l_suppkey % 4 AS cfg, l_orderkey % 3 AS item, l_linenumber AS v FROM lineitem), q AS (SELECT DISTINCT 0 AS x, cfg, item FROM p) SELECT cfg, n AS n_predictions, CASE WHEN cfg % 2 = 0 THEN min(cfg) FILTER (cfg % 2 = 0) OVER () ELSE min(cfg) FILTER (cfg % 2 = 1) OVER () END AS representative, 2 AS group_size FROM (SELECT c.cfg, count(*) AS n FROM orders, (SELECT unnest([0, 1, 2, 3]) AS cfg) c GROUP BY c.cfg)")
def _(s, d):
    runs = read(s, d, "orders").select("o_orderkey", "o_totalprice", F.explode(F.array(*map(F.lit, range(4)))).alias("cfg"))
    runs = runs.withColumn("v", F.col("o_totalprice") * (1 + F.col("cfg") % 2))
    return choice.output_signatures(runs, "cfg", "o_orderkey", "v").select("cfg", "n_predictions", "representative", "group_size")


@query("j11_configuration_catalogue", "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_run, count(DISTINCT o_orderkey % 5) AS n_seeds, list_sort(list(DISTINCT o_orderkey % 5)) AS seeds FROM orders GROUP BY ALL")
def _(s, d):
    runs = read(s, d, "orders").withColumn("seed", F.col("o_orderkey") % 5)
    return choice.configuration_catalogue(runs, ["o_custkey", "o_orderstatus"], "o_orderkey", "seed")


_DOM2 = _DOM.replace("part", "w")


@query(
    "j12_front_reference",
    f"WITH w AS (SELECT * FROM part WHERE p_size > 10), x AS (SELECT a.p_brand, a.p_partkey, NOT EXISTS (SELECT 1 FROM part b WHERE {_DOM}) AS diagnostic_front, a.p_size > 10 AND NOT EXISTS (SELECT 1 FROM w b WHERE {_DOM}) AS protocol_front, a.p_size > 10 AS ok FROM part a) SELECT p_brand, p_partkey, diagnostic_front, protocol_front, CASE WHEN protocol_front THEN 'on_front' WHEN NOT ok THEN 'not_allowed' ELSE 'dominated' END AS reason FROM x UNION ALL SELECT 'Brand#none', NULL, false, false, 'empty_track'",
)
def _(s, d):
    tracks = read(s, d, "part").select("p_brand").distinct().union(s.createDataFrame([("Brand#none",)], "p_brand string"))
    return choice.front_reference(part(s, d), tracks, "p_brand", ["p_size", "p_retailprice"], F.col("p_size") > 10, "p_partkey")


@query("j13_unit_diagnostics", "WITH c AS (SELECT p_brand, list_sort(list(DISTINCT p_size % 3)) = [0, 1, 2] AS covered FROM part GROUP BY p_brand), l AS (SELECT p_brand, unnest(['p_size', 'p_retailprice']) AS metric, unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS v FROM part) SELECT p_brand, metric, round(min(v), 4) AS least, round(median(v), 4) AS median, round(max(v), 4) AS largest, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr, covered FROM l JOIN c USING (p_brand) GROUP BY p_brand, metric, covered")
def _(s, d):
    return rounded(choice.unit_diagnostics(part(s, d).withColumn("v", F.col("p_size") % 3), ["p_brand"], "v", ["p_size", "p_retailprice"], ["0", "1", "2"]), 4)


@query("j14_artifact_gate", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' WHEN o_orderkey % 4 = 1 AND o_orderstatus <> 'F' THEN 'stale' WHEN o_orderkey % 5 = 0 THEN 'undocumented' ELSE 'accepted' END AS state, o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND o_orderstatus <> 'F') OR o_orderkey % 5 = 0 AS blocks FROM orders")
def _(s, d):
    o = read(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("print"))
    k = F.col("o_orderkey")
    reviews = o.where("o_orderkey % 4 <> 0").select("o_orderkey", F.when(k % 4 == 1, "F").otherwise(F.col("print")).alias("print"), F.lit("accepted").alias("decision"), F.lit("clerk").alias("reviewer"), F.when(k % 5 == 0, " ").otherwise("seen").alias("comment"))
    return choice.artifact_gate(o, reviews, "o_orderkey", "print").select("o_orderkey", "state", "blocks")


@query("j15_selection_events", f"WITH {_FRONT}, e AS (SELECT a.p_brand, a.p_partkey, b.p_partkey AS dominator, CAST(a.p_size AS DOUBLE) AS s, CAST(b.p_size AS DOUBLE) AS t, a.p_retailprice AS u, b.p_retailprice AS v FROM part a JOIN f b ON {_DOM}) SELECT p_brand, p_partkey, dominator, 'p_size' AS metric, s AS value, t AS dominator_value, t < s AS strictly_better FROM e UNION ALL SELECT p_brand, p_partkey, dominator, 'p_retailprice', u, v, v < u FROM e")
def _(s, d):
    return choice.selection_events(part(s, d), "p_brand", "p_partkey", ["p_size", "p_retailprice"])


@query("j18_audit_consistency", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN 'unknown_candidate' ELSE 'verdict_differs' END AS fault FROM lineitem WHERE l_orderkey % 9 = 0 OR (l_quantity <= 25) <> (l_linenumber < 4)")
def _(s, d):
    audit = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_linenumber") < 4).alias("passed"))
    known = read(s, d, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return choice.audit_consistency(choice.no_score_columns(audit), known, "l_orderkey", F.col("l_quantity") <= 25).select("l_orderkey", "l_linenumber", "fault")


@query("j19_diverse_picks", "WITH f AS (SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) <= 2) SELECT p_brand, p_partkey FROM f ORDER BY p_retailprice, p_partkey LIMIT 12")
def _(s, d):
    return choice.diverse_picks(part(s, d), "p_brand", ["p_retailprice", "p_partkey"], 12, 2).select("p_brand", "p_partkey")


@query("j19_picked_images", "WITH m AS (SELECT p_brand, p_partkey, p_retailprice, median(p_retailprice) OVER (PARTITION BY p_brand) AS md FROM part) SELECT p_brand, first(p_partkey ORDER BY p_retailprice DESC, p_partkey) AS worst, first(p_partkey ORDER BY p_retailprice, p_partkey) AS best, first(p_partkey ORDER BY abs(p_retailprice - md), p_partkey) AS middle FROM m GROUP BY p_brand")
def _(s, d):
    return choice.picked_images(part(s, d), "p_brand", "p_partkey", "p_retailprice")


@query("b14_trial_fronts", "WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderkey % 7 AS study FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderdate, o_orderkey) = 1) SELECT study, o_orderkey FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.study = a.study AND b.o_totalprice <= a.o_totalprice AND b.o_custkey <= a.o_custkey AND (b.o_totalprice < a.o_totalprice OR b.o_custkey < a.o_custkey))")
def _(s, d):
    trials = read(s, d, "orders").withColumn("study", F.col("o_orderkey") % 7)
    first = review.first_trials(trials, ["o_custkey", "study"], ["o_orderdate", "o_orderkey"])
    return pareto_front(first, ["study"], ["o_totalprice", "o_custkey"]).select("study", "o_orderkey")
