"""Exact Euclidean distance of pixels to the background inside their object's box.

The transform is separable. Along columns, a pixel's distance to the next background pixel follows from the ends of its
vertical run. Along rows, the squared distance is the lower envelope of the parabolas that stand on these column
distances, and no parabola beyond a background pixel of the row can be lowest, so a horizontal run and its two neighbours
are all that counts. Columns and rows of an object are separate groups, so an object may be as large as it likes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 20


def envelope(f: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per row of ``f`` (padded with infinity beyond ``size``) the least (q - p)^2 + f(p) at every q; infinite where f is.

    All rows go through a column together: parabolas that a new one beats everywhere to its left's boundary are taken
    off the row's stack, and the new one is put on it.
    """
    m, width = f.shape
    foot = np.zeros((m, width), np.int64)  # which parabola holds a stretch
    start = np.full((m, width + 1), np.inf)  # where the stretch begins
    top = np.full(m, -1)
    rows = np.arange(m)
    for q in range(width):
        live = rows[(q < size) & np.isfinite(f[:, q])]
        at = np.full(len(live), -np.inf)
        open_ = np.flatnonzero(top[live] >= 0)
        while len(open_):
            r = live[open_]
            p = foot[r, top[r]]
            at[open_] = ((f[r, q] + q * q) - (f[r, p] + p * p)) / (2 * (q - p))
            beaten = at[open_] <= start[r, top[r]]
            top[r[beaten]] -= 1
            at[open_[beaten & (top[r] < 0)]] = -np.inf
            open_ = open_[beaten & (top[r] >= 0)]
        top[live] += 1
        foot[live, top[live]], start[live, top[live]] = q, at
    out, k = np.full(f.shape, np.inf), np.zeros(m, np.int64)
    some = rows[top >= 0]
    for q in range(width):
        live = some[q < size[some]]
        ahead = live[k[live] < top[live]]
        while len(ahead):
            ahead = ahead[start[ahead, k[ahead] + 1] < q]
            k[ahead] += 1
            ahead = ahead[k[ahead] < top[ahead]]
        p = foot[live, k[live]]
        out[live, q] = (q - p) ** 2 + f[live, p]
    return out


def _row_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, first, last = batch.column("g"), batch.column("left").to_numpy(zero_copy_only=False), batch.column("right").to_numpy(zero_copy_only=False)
        offs, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
        offs = offs - offs[0]
        n = np.diff(offs)
        order, done = np.argsort(n, kind="stable"), np.zeros(len(flat))
        at = 0
        while at < len(order):  # rows of like length, a bounded table of them at a time
            to = at + 1
            while to < len(order) and (n[order[to]] + 2) * (to + 1 - at) <= CELLS:
                to += 1
            pick = order[at:to]
            f = np.full((len(pick), int(n[pick].max()) + 2), np.inf)
            row = np.repeat(np.arange(len(pick)), n[pick])
            col = np.arange(len(row)) - np.repeat(np.cumsum(n[pick]) - n[pick], n[pick])
            place = offs[pick][row] + col
            f[row, col + 1] = flat[place] ** 2
            f[first[pick], 0] = 0.0
            f[np.flatnonzero(last[pick]), n[pick][last[pick]] + 1] = 0.0
            done[place] = np.sqrt(envelope(f, n[pick] + 2))[row, col + 1]
            at = to
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(done))], names=["_key", "d"])


def to_background(pixels: DataFrame, item: str) -> DataFrame:
    """``image, item, row, col, distance`` for every position of an object: to the nearest position of the object's box that is
    not the object's. The edge of the box is no background; an object that fills its box has NULL."""
    own = pixels.select("image", item, "row", "col").distinct()
    column, line = Window.partitionBy("image", item, "col"), Window.partitionBy("image", item, "row")
    # the box first, so that the two passes below read it from the row
    box = own.groupBy("image", item).agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    keys = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in ("image", item)]
    box = box.select(F.col("image").alias("_b_image"), F.col(item).alias(f"_b_{item}"), F.struct("_r0", "_r1", "_c0", "_c1").alias("_b"))
    df = own.join(box, keys[0] & keys[1]).drop("_b_image", f"_b_{item}")
    df = df.withColumn("_s", F.col("row") - F.row_number().over(column.orderBy("row")))
    run = Window.partitionBy("image", item, "col", "_s")
    df = df.withColumns({"_first": F.min("row").over(run), "_last": F.max("row").over(run)})
    up = F.when(F.col("_first") > F.col("_b._r0"), F.col("row") - F.col("_first") + 1)
    down = F.when(F.col("_last") < F.col("_b._r1"), F.col("_last") + 1 - F.col("row"))
    df = df.withColumn("_g", F.coalesce(F.least(up, down).cast("double"), F.lit(float("inf"))))
    df = df.withColumn("_s", F.col("col") - F.row_number().over(line.orderBy("col")))
    rows = df.groupBy("image", item, "row", "_s").agg(F.min("col").alias("_first"), F.first("_b").alias("_b"), F.transform(F.array_sort(F.collect_list(F.struct("col", "_g"))), lambda x: x["_g"]).alias("g"))
    rows = rows.select(F.struct("image", item, "row", F.col("_first").alias("col")).alias("_key"), "g", (F.col("_first") > F.col("_b._c0")).alias("left"), (F.col("_first") + F.size("g") - 1 < F.col("_b._c1")).alias("right"))
    schema = rows.select("_key", F.col("g").alias("d")).schema
    found = rows.mapInArrow(_row_pass, schema).select("_key.*", F.posexplode("d").alias("_p", "distance"))
    return found.select("image", item, "row", (F.col("col") + F.col("_p")).alias("col"), F.when(F.col("distance") < float("inf"), F.col("distance")).alias("distance"))
