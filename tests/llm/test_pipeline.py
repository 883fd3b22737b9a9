"""The pipeline's stages on small rows: what each keeps, its columns, and edges."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prismata.llm import decontaminate, ngram_join, quality

from .test_operators import ROWS, SCHEMA


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    good = [(1000 + i, " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[(i * 7 + k * k) % 26]}{'aeiou'[k % 5]} stays" for k in range(40)) + f". Only here {'xyz'[i % 3] * (i + 2)} ends it.", "en", f"s{i % 3}", 0, "r", 1, "p") for i in range(60)]
    item = "The parrot of my aunt counted forty two green bottles on the wall before the clock struck noon again"
    good += [(2000, good[0][1] + " " + item, "en", "s0", 0, "r", 1, "p")]
    rows = spark.createDataFrame([*ROWS, *good, good[1]], SCHEMA)
    rows.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.subtract(docs).count() == 0, name
        if name == "quality rules":
            assert ids(out) == {r.doc_id for r in quality.score(docs).where("kept").select("_row.doc_id").collect()}
        if name == "n-gram Jaccard join":
            classes = ngram_join.jaccard_classes(docs).where("doc_id IS NOT NULL")
            assert ids(out) - {None} == {r.class_id for r in classes.collect()}
        if name == "benchmark decontamination":
            bad = ids(decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")))
            assert ids(out) == ids(docs) - bad and 2000 not in ids(out)
        out.write.mode("overwrite").parquet(f"{sf}/stage-{n}")
        docs = spark.read.schema(out.schema).parquet(f"{sf}/stage-{n}")
    for r in docs.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("k")).collect():
        assert (r.lo, r.hi, r.k) == (0, r.n - 1, r.n)


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
