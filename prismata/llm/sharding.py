"""Sharding by histogram sort (DataFrame functions only): shards of near equal bytes.

Rows are placed on a line by a 62-bit key. Rows of equal text have equal keys, so they stay in one shard, except for
the few groups that hold more than ``tolerance`` of a shard: these come first on the line, largest first, each spread
by the hash of doc_id, so that one can be cut where nothing else keeps the shards equal.

Splitters are found without a sort: each round counts the exact bytes in a fixed number of equal cells of every open
key interval, over all partitions with map-side sums, and narrows the interval around each shard boundary until it
meets the tolerance or its cell holds a single key. Then rows are exchanged once, to (shard, cell), where their place
in the shard is the cell's offset, known from exact counts, plus their rank in the cell. Cells are as many as it takes
for one to hold about CELL_BYTES, 1,024 at least, so that the sort of one cell stays the same size at any input.

Defined results: a null text counts as empty (size 1, CRC 0); rows without a doc_id and rows that repeat one are
placed like any others (ties are ranked by the whole key, then by size); an empty table gives an empty table; the
operator's own columns are added only where asked for, the row's own columns travel in a struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismata.plans.shared import materialize

N_SHARDS, TOLERANCE, CELLS = 8, 0.01, 1024
CELL_BYTES, MOST_CELL_BITS = 64 << 20, 30
TOP = 62
HEAVY_BITS = 40  # a heavy group's rows spread over 2 ** HEAVY_BITS keys
HEAVY_RANKS = 1 << 16
START = HEAVY_RANKS << HEAVY_BITS  # where the light keys begin


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row in ``_row`` with its bytes + 1, CRC-32 and the hashes of text and doc_id."""
    raw = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), (F.octet_length(raw) + 1).cast("long").alias("_size"), F.crc32(raw).alias("_crc"), F.xxhash64(raw).alias("_text"), F.xxhash64(F.col("doc_id").cast("string")).alias("_id"))


def _keyed(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``_key``: heavy groups by rank and doc_id hash, then the light ones by text hash."""
    df = rows.join(F.broadcast(heavy), "_text", "left")  # fewer than HEAVY_RANKS rows: each holds a set share of all bytes
    spread = F.shiftleft(F.col("_rank"), HEAVY_BITS) + F.shiftrightunsigned("_id", 64 - HEAVY_BITS)
    light = F.lit(START) + F.shiftrightunsigned("_text", 64 - TOP + 1)
    return df.withColumn("_key", F.when(F.col("_rank").isNotNull(), spread).otherwise(light)).drop("_rank")


class Splitters:
    """Boundaries of ``n_shards`` shards: ``keys[i]`` is the first key of shard i + 1."""

    def __init__(self, rows: DataFrame, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE, max_rounds: int = 12) -> None:
        if n_shards / tolerance >= HEAVY_RANKS:
            raise ValueError("the tolerance is too fine for this number of shards")
        self.n_shards = n_shards
        groups = rows.groupBy("_text").agg(F.sum("_size").alias("_b"))
        self.total = rows.agg(F.sum("_size")).first()[0] or 0
        least = max(1, int(self.total / n_shards * tolerance))
        heavy = groups.where(F.col("_b") > least)
        # at most n_shards / tolerance groups, so the window and the broadcast are bounded
        self.heavy = materialize(heavy.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_b"), "_text")).cast("long") - 1).select("_text", "_rank"), "heavy-groups")
        keyed = _keyed(rows.select("_text", "_id", "_size"), self.heavy)
        goals = [self.total * i / n_shards for i in range(1, n_shards)]
        self.keys = self._search(keyed, goals, least, max_rounds)

    def _search(self, keyed: DataFrame, goals: list[float], least: int, max_rounds: int) -> list[int]:
        """First round: heavy groups by rank and the light keys in equal cells; later rounds: cells of open intervals."""
        step = 1 << (TOP - 11)
        cell = F.when(F.col("_key") < START, F.shiftright("_key", HEAVY_BITS)).otherwise(F.lit(HEAVY_RANKS) + F.floor((F.col("_key") - START) / step))
        counted = [(int(r["c"]), r["b"]) for r in keyed.groupBy(cell.cast("long").alias("c")).agg(F.sum("_size").alias("b")).collect()]
        edges = [((c << HEAVY_BITS, (c + 1) << HEAVY_BITS) if c < HEAVY_RANKS else (START + (c - HEAVY_RANKS) * step, START + (c - HEAVY_RANKS + 1) * step), b) for c, b in sorted(counted)]
        best: list[tuple[float, int] | None] = [None] * len(goals)
        open_ = self._narrow(edges, 0, goals, dict(enumerate(goals)), least, best)
        for _ in range(max_rounds):
            if not open_:
                break
            spans = sorted({(lo, hi, under) for lo, hi, under in open_.values()})
            which, at = F.lit(None).cast("long"), F.lit(None).cast("long")
            for n, (lo, hi, _) in enumerate(spans):  # one per boundary at most
                width = max(1, -(-(hi - lo) // CELLS))
                inside = (F.col("_key") >= lo) & (F.col("_key") < hi)
                which = F.when(inside, n).otherwise(which)
                at = F.when(inside, F.floor((F.col("_key") - lo) / width).cast("long")).otherwise(at)
            counted = keyed.select(which.alias("s"), at.alias("c"), "_size").where("s IS NOT NULL").groupBy("s", "c").agg(F.sum("_size").alias("b")).collect()
            still: dict[int, tuple[int, int, int]] = {}
            for n, (lo, hi, under) in enumerate(spans):
                width = max(1, -(-(hi - lo) // CELLS))
                edges = [((lo + r["c"] * width, min(hi, lo + (r["c"] + 1) * width)), r["b"]) for r in sorted((r for r in counted if r["s"] == n), key=lambda r: r["c"])]
                mine = {i: goals[i] for i, span in open_.items() if span == (lo, hi, under)}
                still |= self._narrow(edges, under, goals, mine, least, best)
            open_ = still
        return [k[1] if k is not None else 1 << TOP for k in best]

    @staticmethod
    def _narrow(edges: list, under: int, goals: list[float], mine: dict[int, float], least: int, best: list) -> dict[int, tuple[int, int, int]]:
        """Set ``best[i]`` to the edge nearest to goal i; give back the cell to open where that is not near enough."""
        again = {}
        for i, goal in mine.items():
            below = under
            for (lo, hi), b in edges:
                if below + b >= goal:
                    near = (goal - below, lo) if goal - below <= below + b - goal else (below + b - goal, hi)
                    if best[i] is None or near[0] <= best[i][0]:
                        best[i] = near
                    if near[0] > least and hi - lo > 1:
                        again[i] = (lo, hi, below)
                    break
                below += b
        return again


def histogram_shards(docs: DataFrame, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE, text: str = "text") -> DataFrame:
    """Rows in ``_row`` with ``_size``, ``_crc``, ``_shard`` (int) and ``_slot`` (long, gapless from 0 in each shard)."""
    rows = sized(docs, text)
    found = Splitters(rows.drop("_row", "_crc"), n_shards, tolerance)
    keyed = _keyed(rows, found.heavy)
    shard = sum((F.when(F.col("_key") >= k, 1).otherwise(0) for k in found.keys), F.lit(0)).cast("int")
    bits = min(MOST_CELL_BITS, max(10, (found.total // CELL_BYTES).bit_length()))
    light = F.lit(HEAVY_RANKS << bits) + F.shiftright(F.col("_key") - START, TOP - 1 - bits)
    # a heavy group may hold all bytes, so it gets as many cells as all light ones
    cell = F.when(F.col("_key") < START, F.shiftright("_key", HEAVY_BITS - bits)).otherwise(light)
    placed = keyed.withColumns({"_shard": shard, "_cell": cell})
    counts = placed.groupBy("_shard", "_cell").agg(F.count("*").alias("_n"))
    line = Window.partitionBy("_shard").orderBy("_cell")  # a row per cell that holds rows
    offsets = counts.select("_shard", "_cell", (F.sum("_n").over(line) - F.col("_n")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_shard", "_cell").orderBy("_key", "_id", "_size")) - 1
    out = placed.withColumn("_rank", rank).join(offsets, ["_shard", "_cell"])  # rows lie by (shard, cell) already
    return out.select("_row", "_size", "_crc", "_shard", (F.col("_offset") + F.col("_rank")).cast("long").alias("_slot"))


def shard_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with two more columns, ``shard`` and ``slot`` (which replace columns of these names)."""
    out = histogram_shards(docs, **options)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    return out.select(*[F.col(f"_row.`{c}`") for c in names], F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
