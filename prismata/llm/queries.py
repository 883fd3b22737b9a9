"""The registered queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismata.llm import decontaminate, fingerprints, lexical_search, licenses, line_dedup, mixing, ngram_join, pii, quality, sharding, substring_dedup, token_alignment, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.signals(docs).select(F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_symbol_runs", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", quality.votes().alias("votes"))
    out = quality.judge(quality.materialize(scored, "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).documents()


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.spelled().alias("spans"), F.expr("n_email + n_ip + n_card + n_phone").alias("n_base"), F.size("spans").cast("long").alias("n_spans"))


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.histogram_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    out = fingerprints.fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    near_edited, near_next = fingerprints.likeness("f", "g"), fingerprints.likeness("f", "after")
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprints.spelled("f").alias("fingerprint"), fingerprints.spelled("g").alias("edited_fingerprint"), near_edited.alias("near_edited"), near_next.alias("near_next"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under both tokenizers."""
    return token_alignment.Alignment(_table(spark, sf_dir, "documents").select("doc_id", "text")).documents()


QUERIES: dict[str, Query] = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_pii": op5_pii,
    "op6_histogram_sharding": op6_histogram_sharding,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_fingerprints": op12_fingerprints,
    "op13_token_alignment": op13_token_alignment,
}

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND kept < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND kept < page_id THEN kept END AS refers_to FROM q""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c * 10 >= 8 * (na.n + nb.n - c)),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT doc_id, coalesce((SELECT min(root) FROM r WHERE node = doc_id), doc_id) AS class_id, (SELECT count(*) FROM e WHERE a = doc_id) AS n_links FROM d""",
    "op11_lexical_search": """
WITH i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
f AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY term),
x AS (SELECT item_id, doc_id, CAST(sum(k * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN g USING (term), s GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) WHERE len(w) >= 50),
m AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + k AS place FROM v JOIN m USING (h), (SELECT unnest(range(0, 50)) AS k) WHERE doc_id > least),
x AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id),
y AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ')) AS kept_sha256 FROM y""",
}
