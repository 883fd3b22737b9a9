"""Contracts of stored tables: their columns in order, and the natural key that may not repeat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """``columns`` in their order (none: whatever there is) and the ``key``; ``unique``: whether a key may occur once only."""

    columns: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    unique: bool = True


def facts(df: DataFrame, contract: Contract) -> tuple[int, dict[str, bool], bool]:
    """Rows, which columns hold no value at all, and whether a key repeats, from one pass over the table: keys are counted
    per key, and each key's row says which of its columns have a value."""
    some = [F.count(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(df.columns)]
    if contract.key and set(contract.key) <= set(df.columns):
        per = df.groupBy(*[F.col(f"`{c}`") for c in contract.key]).agg(F.count("*").alias("_n"), *some)
        one = per.agg(F.sum("_n").alias("_n"), F.max("_n").alias("_most"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(df.columns))]).first()
    else:
        one = df.agg(F.count("*").alias("_n"), F.lit(1).alias("_most"), *some).first()
    n = one["_n"] or 0
    return n, {c: n > 0 and not one[f"v{i}"] for i, c in enumerate(df.columns)}, (one["_most"] or 0) > 1


def conform(df: DataFrame, contract: Contract, remaining: bool = False, drop_empty: bool = True, require_all: bool = False, check_key: bool = True) -> DataFrame:
    """The table as its contract has it: the contract's columns in order (then the others with ``remaining``; all of them where
    the contract names none), without columns that hold no value, except those of the key. A column of the key, or with
    ``require_all`` any, that is missing is a KeyError; a key that repeats a ValueError. A table without rows keeps its
    columns."""
    if require_all and (lost := [c for c in contract.columns if c not in df.columns]):
        raise KeyError(f"missing columns: {lost}")
    n, empty, repeats = facts(df, contract)
    if check_key and n:
        if lost := [c for c in contract.key if c not in df.columns]:
            raise KeyError(f"missing key columns: {lost}")
        if contract.unique and repeats:
            raise ValueError(f"a key repeats: {contract.key}")
    names = [c for c in contract.columns if c in df.columns] + [c for c in df.columns if c not in contract.columns and (remaining or not contract.columns)]
    kept = [c for c in names if not (drop_empty and empty[c] and c not in contract.key)]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def read_table(spark, path: str, contract: Contract, **options) -> DataFrame:
    return conform(spark.read.parquet(path), contract, **options)


def write_table(df: DataFrame, path: str, contract: Contract, **options) -> DataFrame:
    """Write what ``conform`` leaves; an older table of that path goes."""
    out = conform(df, contract, **options)
    out.write.mode("overwrite").parquet(path)
    return out


def numbered_batches(df: DataFrame, order: list[str], size: int, prefix: str = "batch") -> DataFrame:
    """``batch_id, row_start, row_stop`` beside every row: stable runs of ``size`` rows of the whole table in ``order`` (which
    must be unique), ``row_stop`` being the first row beyond. Rows are ranged by the order and ranked inside a range; a
    range's offset is the number of rows before it, so that no task sorts the table."""
    if size <= 0:
        raise ValueError("a batch holds a row at least")
    from pyspark.sql import Window

    from prismata.plans.shared import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_o", F.struct(*order))
    ranged = materialize(keyed.repartitionByRange(parts, "_o").withColumn("_part", F.spark_partition_id()), "numbered-rows")
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("n").over(Window.partitionBy()).alias("_total"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_o")) - 1
    out = ranged.withColumn("_rank", rank).join(F.broadcast(offsets), "_part").withColumn("_row", F.col("_before") + F.col("_rank"))
    start = (F.floor(F.col("_row") / size) * size).cast("long")
    out = out.withColumns({"row_start": start, "row_stop": F.least(start + size, F.col("_total")).cast("long"), "batch_id": F.concat(F.lit(prefix + "_"), F.lpad((F.floor(F.col("_row") / size) + 1).cast("string"), 4, "0"))})
    return out.select(*df.columns, "batch_id", "row_start", "row_stop")


def category_columns(df: DataFrame, most: float = 0.5) -> list[str]:
    """Text columns of which at most this share of all rows are different values: those that Parquet's dictionaries suit."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return []
    one = df.agg(F.count("*").alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if one["n"] and one[f"d{i}"] / one["n"] <= most]
