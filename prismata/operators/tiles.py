"""Connected components by tiles: union-find inside a tile, then a contraction of what meets at tile borders.

A task labels one tile of SIDE x SIDE pixels at a time, on its runs. Only components that reach a tile's border are
linked, so the distributed contraction sees border labels and no pixels; a component inside a tile is final at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.plans.components import connected_components
from prismata.plans.shared import materialize

SIDE = 512


def label_runs(row: np.ndarray, col: np.ndarray, reach: int) -> np.ndarray:
    """Component number of every pixel; pixels are sorted by row and column and unique. Runs of neighbouring rows are linked
    where their columns come within ``reach`` (0: edges, 1: corners as well)."""
    first = np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)]
    run = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    r, c0, c1 = row[start], col[start], col[np.r_[start[1:], len(row)] - 1]
    # runs are in order of (row, c0) and (row, c1) alike, so those of the next row that meet a run are a stretch
    wide = int(max(c1.max(initial=0) - c0.min(initial=0), 0)) + 2 * reach + 3
    base = int(c0.min(initial=0)) - reach - 1
    key = lambda rows, cols: rows.astype(np.int64) * wide + (cols - base)
    lo = np.searchsorted(key(r, c1), key(r + 1, c0 - reach))
    hi = np.searchsorted(key(r, c0), key(r + 1, c1 + reach), "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(r)), n)
    b = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    root = np.arange(len(r))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root[run]


def components(mask: DataFrame, connectivity: int = 8, side: int = SIDE) -> DataFrame:
    """``(image, row, col, label)`` per pixel: label is the smallest hash of a pixel of its component. A repeated pixel counts
    once."""
    kind = mask.schema["image"].dataType.simpleString()
    schema = f"image {kind}, label long, rows array<int>, cols array<int>, edge_rows array<int>, edge_cols array<int>"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"]).drop_duplicates(["row", "col"])
        row, col, ident = pdf["row"].to_numpy(np.int64), pdf["col"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
        part = label_runs(row, col, int(connectivity == 8))
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
        edge = np.isin(row % side, (0, side - 1)) | np.isin(col % side, (0, side - 1))
        out = []
        for at in np.split(order, cuts[1:]):
            rim = at[edge[at]]
            out.append((pdf["image"].iloc[0], int(ident[at].min()), row[at], col[at], row[rim], col[rim]))
        return pd.DataFrame(out, columns=["image", "label", "rows", "cols", "edge_rows", "edge_cols"])

    tile = lambda c: F.floor(F.col(c) / side)
    placed = mask.select("image", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    placed = placed.select("*", F.xxhash64("image", "row", "col").alias("id"), tile("row").alias("_r"), tile("col").alias("_c"))
    parts = materialize(placed.groupBy("image", "_r", "_c").applyInPandas(label, schema), "tile-components")
    rim = parts.select("image", "label", F.explode(F.arrays_zip("edge_rows", "edge_cols")).alias("x")).select("image", "label", F.col("x.edge_rows").alias("row"), F.col("x.edge_cols").alias("col"))
    offsets = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in offsets])).alias("o")
    near = rim.select("image", "label", "row", "col", o).select("image", F.col("label").alias("a"), (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
    meet = near.join(rim.withColumnRenamed("image", "_image"), F.col("image").eqNullSafe(F.col("_image")) & (near["row"] == rim["row"]) & (near["col"] == rim["col"])).select("a", F.col("label").alias("b"))
    found = connected_components(meet.where("a <> b"), "tile-borders").select(F.col("node").alias("label"), "component")
    # one row a component and tile meets here, however many pixels it has
    whole = parts.join(found, "label", "left").select("image", F.coalesce("component", "label").alias("label"), F.explode(F.arrays_zip("rows", "cols")).alias("x"))
    return whole.select("image", F.col("x.rows").alias("row"), F.col("x.cols").alias("col"), "label")
