"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Targets. Sources by code point, null last, weigh 1, 2, 3, repeating, and share the words of all documents; a target
stops at ``limit`` times its source's size, and what is above goes to the others by weight until none is above. The
common level is found by rounds over the table of sources, each one aggregate.

Blocks. Documents of a source stand in the order of a 62-bit hash of seed and doc_id; a block is a stretch of equal
leading bits, 2 to 3 documents on average (more from 2 ** 20 blocks a source on). A target is a number of whole passes
over the source's blocks and a part of one more. Where that part ends is found by rounds that count the words in 64
cells of the open stretch, so that no window holds more than 64 rows of a source, whatever its size, until a cell has
some hundred documents (1,024 on average at most). Of these, those that still fit are taken in order; then the one
document of the source whose size is nearest to what is left, if it brings the mix nearer. So no document that is not
taken in that pass would bring a source nearer to its target.

Shards. A root node holds each source's number of taken blocks; every node splits it between two children by a
multivariate hypergeometric draw (conditional univariate draws, by inversion), down to the shards. A shard's
quota is then a stretch of the source's block order, so shards draw disjoint blocks, and ``apply`` puts every repeat into
its shard and shuffles it there: rows go to (shard, range of a hash) and are sorted by that hash. All draws are
hashes of seed, node and source: reruns agree. The tree's node is one array row, an entry a source.

Defined results: a null text has size 0; null is a source of its own; rows without a doc_id are ordered by a hash of
their text; rows that repeat a doc_id (or, without one, a text) are taken or left together; an empty table gives an empty
table; the operator's own columns stand in a struct next to the row's, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.llm.text import SPACES
from prismata.plans.shared import materialize

LIMIT, SEED, LEAST_BLOCK, MOST_BLOCK_BITS = 3, 1729, 2, 20
BITS, CELL, LAST_CELL = 62, 6, 1024
PIECE = 4_000_000  # words of a shard that one task sorts
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def order_hash(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """BITS bits."""
    named = F.xxhash64(F.lit(seed), doc_id.cast("string"))
    return F.shiftrightunsigned(F.when(doc_id.isNotNull(), named).otherwise(F.xxhash64(F.lit(seed), text)), 64 - BITS)


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``rank`` of the source by code point, null last: ranges are sorted apart, then counted up."""
    rows = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    rows = materialize(rows.select("*", F.spark_partition_id().alias("part"), F.expr("monotonically_increasing_id() & 8589934591").alias("at")), "ranked-sources")
    upto = Window.orderBy("part")  # one row a partition
    parts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    return rows.join(parts, "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``sizes(source, n_docs, source_size)`` with ``target``."""
    df = ranked(sizes).withColumn("weight", F.lit(1) + F.col("rank") % 3).withColumn("cap", F.col("source_size") * limit)
    df = materialize(df.withColumn("level", F.col("cap") / F.col("weight")).drop("rank"), "weights")
    total, level, n_full = df.agg(F.sum("source_size")).first()[0] or 0, -1.0, -1
    while True:  # the level only rises, and every round but the last finds a source that is full
        full = F.col("level") <= level
        r = df.agg(F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.count_if(full).alias("n")).first()
        if r["n"] == n_full or not r["weights"]:
            break
        n_full, level = r["n"], (total - (r["caps"] or 0)) / r["weights"]
    full = F.col("level") <= level
    return df.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(level * F.col("weight"))).select("source", "n_docs", "source_size", "target")


def _hypergeometric(size: str, good: str, drawn: str, u: str) -> str:
    """SQL of one hypergeometric draw by inversion over the support within 12 standard deviations of the mean."""
    step = "IF(x < z.hi, ln(CAST(z.k - x AS double) * (z.n - x) / (CAST(x + 1 AS double) * (z.t - z.k - z.n + x + 1))), 0D)"
    mean = f"({drawn}) * CAST({good} AS double) / greatest({size}, 1)"
    reach = f"12 * sqrt({mean}) + 12"
    lo = f"CAST(greatest(0L, ({drawn}) - ({size}) + ({good}), CAST(floor({mean} - {reach}) AS bigint)) AS bigint)"
    hi = f"CAST(least({good}, {drawn}, CAST(ceil({mean} + {reach}) AS bigint)) AS bigint)"
    z = f"array(struct(CAST({size} AS bigint) AS t, CAST({good} AS bigint) AS k, CAST({drawn} AS bigint) AS n, {lo} AS lo, {hi} AS hi, {u} AS u))"
    top = f"aggregate(sequence(z.lo, z.hi), struct(0D AS w, 0D AS m), (a, x) -> struct(a.w + {step} AS w, greatest(a.m, a.w) AS m), a -> a.m)"
    total = f"aggregate(sequence(y.z.lo, y.z.hi), struct(0D AS w, 0D AS s), (a, x) -> struct(a.w + {step.replace('z.', 'y.z.')} AS w, a.s + exp(a.w - y.m) AS s), a -> a.s)"
    pick = f"aggregate(sequence(q.y.z.lo, q.y.z.hi), struct(0D AS w, 0D AS s, q.y.z.lo AS v), (a, x) -> struct(a.w + {step.replace('z.', 'q.y.z.')} AS w, a.s + exp(a.w - q.y.m) AS s, IF(a.s < q.y.z.u * q.total, x, a.v) AS v), a -> a.v)"
    inner = f"transform(transform({z}, z -> struct(z AS z, {top} AS m)), y -> struct(y AS y, {total} AS total))"
    return f"transform({inner}, q -> {pick})[0]"


def split_quotas(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """``quotas(quota array)``, one row with a number of blocks per source -> ``(shard, quota)``: 2 ** depth rows whose
    sums per source are exact and whose totals differ by one at most."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), F.expr("transform(quota, x -> CAST(x AS bigint))").alias("quota"))
    u = f"(xxhash64({seed}, node, i) & 9223372036854775807) / 9.223372036854775807E18D"
    draw = _hypergeometric("a.t", "quota[i]", "a.n", u)
    for _ in range(depth):
        total = "aggregate(quota, 0L, (s, x) -> s + x)"
        left = f"aggregate(sequence(0, size(quota) - 1), struct(array() AS l, {total} AS t, {total} DIV 2 AS n), (a, i) -> transform(array({draw}), d -> struct(concat(a.l, array(d)) AS l, a.t - quota[i] AS t, a.n - d AS n))[0], a -> a.l)"
        left = left.replace("array() AS l", "CAST(array() AS array<bigint>) AS l")
        nodes = nodes.withColumn("left", F.expr(left))
        nodes = nodes.select(F.explode(F.expr("array(struct(node * 2 AS node, left AS quota), struct(node * 2 + 1 AS node, transform(quota, (x, i) -> x - left[i]) AS quota))")).alias("c")).select("c.*")
    return nodes.select((F.col("node") - (1 << depth)).cast("int").alias("shard"), "quota")


class Mix:
    """The mix of ``docs(doc_id, source, text)``: what every source and block gives. Small tables are written once."""

    def __init__(self, docs: DataFrame, depth: int = 3, seed: int = SEED, limit: int = LIMIT, text: str = "text") -> None:
        self.seed, self.depth, self.text = seed, depth, text
        t = F.col(text).cast("string")
        self.sized = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(t).alias("size"), order_hash(F.col("doc_id"), t, seed).alias("h")), "sizes")
        sizes = self.sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
        plan = targets(sizes, limit).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        rest = F.when(F.col("passes") >= limit, F.lit(-1.0)).otherwise(F.col("target") - F.col("passes") * F.col("source_size"))
        bits = F.greatest(F.lit(0), F.least(F.lit(MOST_BLOCK_BITS), F.floor(F.log2(F.col("n_docs") / LEAST_BLOCK)).cast("int")))
        self.plan = materialize(plan.withColumns({"rest": rest, "bits": bits}), "targets")
        self.sources = materialize(self._cut(), "sources")
        self.shards = self._shards(depth)

    @staticmethod
    def _with(small: DataFrame, large: DataFrame, how: str = "left") -> DataFrame:
        """``large`` with the columns of ``small`` by source (null is a source)."""
        key = small.withColumnRenamed("source", "_source")
        return large.join(key, large["source"].eqNullSafe(key["_source"]), how).drop("_source")

    def _cut(self) -> DataFrame:
        """The plan with where the last pass ends: all hashes below ``cut``, those in ``more``, and ``fill``."""
        at = self.plan.where("rest >= 0").select("source", "rest", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"))
        most, shift = self.plan.agg(F.max("n_docs")).first()[0] or 0, BITS
        while most >> (BITS - shift) > LAST_CELL and shift > CELL:
            inside = self._with(at, self.sized, "inner").where(F.shiftright("h", shift) == F.col("cell"))
            shift -= CELL
            cells = inside.groupBy("source", "rest", "before", F.shiftright("h", shift).alias("to")).agg(F.sum("size").alias("words"))
            line = Window.partitionBy("source").orderBy("to")  # 64 rows at most
            cells = cells.withColumn("below", F.col("before") + F.sum("words").over(line) - F.col("words")).where("below <= rest")
            at = materialize(cells.groupBy("source").agg(F.first("rest").alias("rest"), F.max("to").alias("cell"), F.max_by("below", "to").alias("before")), "border")
        inside = self._with(at, self.sized, "inner").where(F.shiftright("h", shift) == F.col("cell"))
        listed = inside.groupBy("source", "h").agg(F.sum("size").alias("size")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("h", "size"))).alias("docs"))
        fit = "aggregate(docs, struct(CAST(rest - before AS double) AS room, CAST(array() AS array<bigint>) AS more), (a, x) -> IF(x.size <= a.room, struct(a.room - x.size AS room, array_append(a.more, x.h) AS more), a))"
        taken = self._with(listed, at).withColumn("x", F.expr(fit)).select("source", F.shiftleft("cell", shift).alias("cut"), "x.more", "x.room").withColumn("last", F.array_max("more"))
        taken = materialize(taken, "taken")
        left = self._with(taken, self.sized, "inner").where("h >= cut AND NOT array_contains(more, h) AND size > 0 AND size < 2 * room")
        fill = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("room")).alias("gap"), "h"))["h"].alias("fill"))
        return self._with(fill, self._with(taken, self.plan))

    @staticmethod
    def repeats() -> Column:
        more = (F.col("h") < F.col("cut")) | ((F.col("h") <= F.col("last")) & F.array_contains("more", F.col("h"))) | F.coalesce(F.col("h") == F.col("fill"), F.lit(False))
        return (F.col("passes") + F.coalesce(more, F.lit(False)).cast("int")).cast("long")

    def _shards(self, depth: int) -> DataFrame:
        """Per source and shard, how many block draws come before it ends; a draw is a block of a pass. The last
        pass draws the blocks up to that of the last document taken in order."""
        last = f"coalesce(shiftright(greatest(cut - 1, last), {BITS} - bits) + 1, 0L)"
        quota = self.sources.select("source", F.expr(f"passes * shiftleft(1L, bits) + {last}").alias("quota"))
        listed = quota.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota"))).alias("q"))
        tree = split_quotas(listed.where("size(q) > 0").select(F.expr("transform(q, x -> x.quota)").alias("quota")), depth, self.seed)
        per = tree.select("shard", F.posexplode("quota").alias("i", "n")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("parts"))
        named = listed.select(F.posexplode("q").alias("i", "x")).select("i", "x.source").join(per, "i")
        ends = F.expr("transform(parts, (p, i) -> aggregate(slice(parts, 1, i + 1), 0L, (s, y) -> s + y.n))")
        return materialize(named.select("source", ends.alias("ends")), "shard-quotas")

    @staticmethod
    def _shard(repeat: str) -> str:
        """SQL: the shard of a document's ``repeat``-th repeat; ``fill`` may lie behind the last block drawn, and goes
        with that."""
        return f"size(filter(ends, x -> x <= least({repeat} * shiftleft(1L, bits) + shiftright(h, {BITS} - bits), element_at(ends, -1) - 1)))"

    def documents(self) -> DataFrame:
        """``(doc_id, size, source_size, target, taken, shards)``: one row per document; shards lists where its
        repeats go, one entry each."""
        small = self._with(self.shards, self.sources.select("source", "source_size", "target", "passes", "bits", "cut", "last", "more", "fill"))
        df = self._with(small, self.sized).withColumn("repeats", self.repeats())
        shards = F.expr(f"IF(repeats > 0, transform(sequence(0L, repeats - 1), e -> {self._shard('e')}), CAST(array() AS array<int>))")
        return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), shards.alias("shards"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, each as often as the mix takes it, with its own columns: shard by shard, and in random
        order inside a shard."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        rows = rows.select("_row", F.col("_row.source").cast("string").alias("source"), order_hash(F.col("_row.doc_id"), F.col(f"_row.`{self.text}`").cast("string"), self.seed).alias("h"))
        small = self._with(self.shards, self.sources.select("source", "passes", "bits", "cut", "last", "more", "fill"))
        rows = self._with(small, rows).withColumn("n", self.repeats()).where("n > 0")
        rows = rows.select("_row", "h", "ends", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("e"))
        rows = rows.select("_row", F.expr(self._shard("e")).alias("shard"), F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "h", "e"), 2).alias("order"))
        words = self.plan.agg(F.sum("target")).first()[0] or 0
        pieces = max(1, int(words / PIECE) >> self.depth)
        return rows.repartition("shard", F.col("order") % pieces).sortWithinPartitions("shard", "order").select("_row.*")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed to the targets, rows repeated or left out, in shards that are shuffled each."""
    return Mix(docs, **options).apply(docs)
