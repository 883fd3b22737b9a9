"""Sources, sinks and table contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_batches(spark: SparkSession, path: str, batches: list | None = None, column: str = "batch") -> DataFrame:
    """A table partitioned by batch; with ``batches`` only those partitions are read, and rows without a batch go."""
    df = spark.read.parquet(path)
    return df if batches is None else df.where(F.col(column).isin(batches))


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def selected_rows(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a large table whose key is selected (null keys match)."""
    k = keys.select(*[F.col(c).alias(f"_k_{c}") for c in on]).distinct()
    return big.join(k, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on]), "left_semi")


def missing_keys(keys: DataFrame, big: DataFrame, on: list[str]) -> DataFrame:
    return keys.select(*on).distinct().join(big.select(*on), on, "left_anti")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; a contract holds when this is empty."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def schema_diagnostics(df: DataFrame) -> DataFrame:
    """Per column: rows and nulls, from one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    return one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in df.columns])).alias("x")).select("x.column", F.col("_n").alias("n_rows"), "x.n_values", (F.col("x.n_values") == 0).alias("all_null"))


def concat_tables(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def row_batches(df: DataFrame, by: list[str], order: list, size: int) -> DataFrame:
    """Stable batches of ``size`` rows within each group."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("batch_id", F.concat(F.lit("batch_"), F.lpad(F.ceil(rn / size).cast("string"), 4, "0")))


def canonical(columns: list[str]) -> Column:
    """The named values as JSON in the given order: text is escaped, and a null is not the word null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def stable_id(prefix: str, columns: list[str], length: int = 20) -> Column:
    """Prefix and the first hex digits of SHA-256 over the JSON of the named values, sorted by name; nulls count."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(canonical(sorted(columns)), 256), 1, length))


def fingerprint(df: DataFrame, columns: list[str], by: list[str], digits: int = 4) -> DataFrame:
    """Order-free SHA-256 of a group's rows. Row hashes are counted per bucket, the first ``digits`` hex digits, and
    folded there, so that no task holds a large group's row hashes; 16 ** digits buckets a group are folded at last."""
    row = F.sha2(canonical(columns), 256)
    level = df.select(*by, row.alias("h")).groupBy(*by, F.substring("h", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "|"), 256).alias("h"))
    return level.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), "|"), 256).alias("fingerprint"))


def equality_report(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.crossJoin(right).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


# fixed values: tokens of a binary label
def binary_label(c: Column, target: str = "peanut", other: str = "almond") -> Column:
    """Nullable boolean from mixed booleans, numbers and text; tokens of false win over those of true."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("false", "0", "0.0", "no", "n", "negative", "non_target", "non-target", "non_peanut", other), False).when(s.isin("true", "1", "1.0", "yes", "y", "positive", "target", target), True)


def first_finite(*columns: str) -> Column:
    return F.coalesce(*[F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for x in (F.expr(f"try_cast(`{c}` AS double)") for c in columns)])


def compare(a: Column, operator: Column, b: Column, atol: float = 1e-12) -> Column:
    """Row-wise comparison by an operator column; what is not finite compares false."""
    near = F.abs(a - b) <= atol
    ok = F.when(operator == "==", near).when(operator == "<=", (a < b) | near).when(operator == ">=", (a > b) | near).when(operator == "<", (a < b) & ~near).when(operator == ">", (a > b) & ~near)
    return F.coalesce(ok & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


# fixed values: patterns of image keys
def parse_key(key: Column) -> dict[str, Column]:
    """Parts of an image key: ``alm1pea2`` is a mixture, ``pea3_pos2`` a position reference, ``alm1`` pure."""
    k = F.regexp_replace(F.lower(F.trim(key)), "_sb$", "")
    position, pure, mixture = r"^(alm|pea)(\d+)_pos(\d+)$", r"^(alm|pea)(\d+)$", r"^alm(\d+)pea(\d+)$"
    kind = F.when(k.rlike(position), "position_reference").when(k.rlike(pure), "pure").when(k.rlike(mixture), "mixture").otherwise("unknown")
    batch = F.when(kind.isin("pure", "position_reference"), F.regexp_extract(k, r"^(?:alm|pea)(\d+)", 1).cast("int"))
    role = F.when(kind == "mixture", "application").when(kind == "position_reference", "spatial_reference").when(batch.isin(1, 2), "calibration").when(batch == 3, "validation").when(batch == 4, "test").otherwise("unknown")
    return {"kind": kind, "batch": batch, "role": role}


def object_label(kind: Column, key: Column) -> Column:
    """The class that a clean image key names: of a pure image or a position reference its own, of a mixture none."""
    return F.when(kind.isin("pure", "position_reference"), F.when(F.lower(F.trim(key)).startswith("alm"), "almond").when(F.lower(F.trim(key)).startswith("pea"), "peanut"))


def save_nonempty(df: DataFrame, path: str, keep_empty: bool = False) -> bool:
    """Whether the table was written: an empty one is only with ``keep_empty`` (a file with the schema alone)."""
    if df.isEmpty() and not keep_empty:
        return False
    save(df, path)
    return True


def shrunk_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type of each numeric column, from one pass: float for double, the smallest integer that holds the
    values."""
    whole = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]
    ends = df.agg(*[x for c in whole for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first() if whole else None
    out = {}
    for f in df.schema:
        if f.name in whole:
            lo, hi = ends[f"lo_{f.name}"], ends[f"hi_{f.name}"]
            fits = [t for t, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)) if lo is not None and -(1 << (bits - 1)) <= lo and hi < 1 << (bits - 1)]
            out[f.name] = (fits or ["bigint"])[0] if lo is not None else f.dataType.simpleString()
        elif f.dataType.typeName() == "double":
            out[f.name] = "float"
    return out


def shrink(df: DataFrame) -> DataFrame:
    types = shrunk_types(df)
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def nested_to_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema])


def filter_values(df: DataFrame, wanted: dict, strict: bool = True) -> DataFrame:
    """Rows whose columns have the wanted value or one of the wanted values; a None is no filter. A column that is not
    there is an error, or, if not ``strict``, no filter."""
    missing = [c for c, v in wanted.items() if v is not None and c not in df.columns]
    if missing and strict:
        raise ValueError(f"no such column: {missing}")
    tests = [F.col(c).isin(list(v) if isinstance(v, list | tuple | set) else [v]) for c, v in wanted.items() if v is not None and c in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def image_manifest(pixels: DataFrame, by: list[str], bands: int, spectrum: str = "spectrum") -> DataFrame:
    """Per image its extent, bands, values that are not finite, and ok or the first fault."""
    bad = lambda f: F.sum(F.size(F.filter(spectrum, f))).alias
    df = pixels.groupBy(*by).agg((F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"), F.count("*").alias("n_pixels"), F.min(F.size(spectrum)).alias("n_bands"), F.max(F.size(spectrum)).alias("most_bands"), bad(lambda x: F.isnan(x))("n_nan"), bad(lambda x: F.abs(x) == float("inf"))("n_inf"))
    status = F.when(F.col("n_bands") != F.col("most_bands"), "ragged_bands").when(F.col("n_bands") != bands, "wrong_band_count").when(F.col("n_nan") + F.col("n_inf") > 0, "non_finite").otherwise("ok")
    return df.withColumn("status", status).drop("most_bands")


def image_summary(pixels: DataFrame, by: list[str], item: str, mask: Column) -> DataFrame:
    return pixels.groupBy(*by).agg(F.count_distinct(item).alias("n_objects"), F.count("*").alias("n_pixels"), F.avg(mask.cast("double")).alias("mask_area_ratio"))


def object_summary(pixels: DataFrame, by: list[str], spectrum: str = "spectrum") -> DataFrame:
    return pixels.groupBy(*by).agg(F.count("*").alias("n_pixels"), F.max(F.size(spectrum)).alias("n_bands"), ((F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)).alias("box_area"))


def database_manifest(pixels: DataFrame, image: str, item: str, columns: list[str], spectrum: str = "spectrum") -> DataFrame:
    """One row: counts of images, objects, pixels and bands, and the fingerprint of the named columns."""
    counts = pixels.agg(F.count_distinct(image).alias("n_images"), F.count_distinct(item).alias("n_objects"), F.count("*").alias("n_pixels"), F.max(F.size(spectrum)).alias("n_bands"))
    return counts.crossJoin(fingerprint(pixels, columns, []))  # one row each


def axis_lock(axes: DataFrame, version: str, axis: str) -> DataFrame:
    """Per version the number of different axes, the id of the first and whether the version is locked to one."""
    hashed = axes.select(version, F.substring(F.sha2(F.to_json(F.col(axis)), 256), 1, 16).alias("axis_id"))
    return hashed.groupBy(version).agg(F.count_distinct("axis_id").alias("n_axes"), F.min("axis_id").alias("axis_id")).withColumn("locked", F.col("n_axes") == 1)


def audit_number(c: Column) -> Column:
    """A number from any text or boolean; NULL where there is none or it is not finite."""
    text = F.lower(F.trim(c.cast("string")))
    x = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.expr("NULL").cast("double"))
    n = F.coalesce(x, c.try_cast("double"))
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def repair_suffixes(df: DataFrame, prefer: str = "left") -> DataFrame:
    """Columns ``c_x`` and ``c_y`` of a merge become ``c``: the preferred side's value, else the other's, else c's own."""
    bases = [c[:-2] for c in df.columns if c.endswith("_x") and c[:-2] + "_y" in df.columns]
    order = ("_x", "_y") if prefer == "left" else ("_y", "_x")
    for b in bases:
        own = [F.col(b)] if b in df.columns else []
        df = df.withColumn(b, F.coalesce(*[F.col(b + s) for s in order], *own)).drop(b + "_x", b + "_y")
    return df


def normalise_columns(df: DataFrame, aliases: dict[str, list[str]], defaults: dict) -> DataFrame:
    """Each column from the first of its aliases that is there and not null, then its default."""
    out = {}
    for name, names in aliases.items():
        found = [F.col(c) for c in [name, *names] if c in df.columns]
        out[name] = F.coalesce(*found, F.lit(defaults.get(name))) if found else F.lit(defaults.get(name))
    gone = [c for names in aliases.values() for c in names if c in df.columns and c not in aliases]
    return df.withColumns(out).drop(*gone)


def checks(df: DataFrame, tests: dict[str, Column], strict: bool = False) -> DataFrame:
    """One row per test: the rows that fail it and whether it passed; with ``strict`` a failed one is an error."""
    one = df.agg(*[F.count_if(~F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_failed")) for n in tests])).alias("x")).select("x.*").withColumn("passed", F.col("n_failed") == 0)
    if strict and (bad := [r["check"] for r in out.where("NOT passed").collect()]):
        raise ValueError(f"failed checks: {bad}")
    return out


def clean_text(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


# fixed values: synonyms of class labels
SYNONYMS = {"peanut": ["peanut", "pea", "target", "positive"], "almond": ["almond", "alm", "non_target", "negative", "non-target"]}


def class_label(c: Column) -> Column:
    """The canonical class of a label; others are cleaned and lower case, missing ones unknown."""
    t = F.lower(clean_text(c))
    known = reduce(lambda acc, x: acc.when(t.isin(x[1]), x[0]), SYNONYMS.items(), F.when(t == "", "unknown"))
    return F.coalesce(known, t)
