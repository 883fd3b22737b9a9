"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary folder; on
    a cluster that is an error, since executors do not see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="prismata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: its lineage ends at files that
    outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``materialize``, with files cut by the hash of ``column``, as the shuffles of the session are: a join by it does not
    shuffle the table again. After an aggregation by ``column`` alone each of the files is written by one task. The
    table's name stays in the session's catalog."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    write = df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, name))
    write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(table)
    return spark.table(table)
