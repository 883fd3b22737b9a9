"""Document fingerprints by I-Match (DataFrame and SQL functions only).

The lexicon is the band of terms whose inverse document frequency, ln(documents / documents with the term), lies between
two bounds. A document keeps its terms in the lexicon; the distinct ones, sorted, are hashed for several randomised
subsets of the lexicon. Two documents that differ by some terms still agree on the subsets that hold none of these.

Subsets are drawn so that each holds about one or two terms of the document, whatever its length: at level l the
lexicon is thinned to one term in 2 ** l by hash and dealt to SLOTS subsets. A fingerprint has two levels, chosen by the
number of distinct terms, so documents of like length share one at least. ``likeness`` is the share of agreeing
subsets among those that hold a term of either document, at the levels that both have. A document without a term in its subsets
is known by a hash of all its distinct terms instead.

The frequency bounds are shares of the documents, so the lexicon has at most (mean number of distinct terms) / least share
terms at any input, and it is broadcast where that count is below MOST_BROADCAST; otherwise the join shuffles it.

``next_texts`` walks the documents in descending doc_id order. They are dealt once to cells between quantiles of doc_id
(rows of one doc_id fall into as many cells as that doc_id holds quantiles), and every cell also gets the first row of the next cell as a guest, so that all
neighbours meet inside a cell.

Defined results: a null text counts as empty; rows without a doc_id come last, rows of equal doc_id in order of the
hash of their texts; the last row is followed by the first, a single row by itself; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.plans.shared import materialize

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_IDF, MOST_IDF = math.log(4), math.log(2000)
SLOTS, RATE = 32, 64
MOST_BROADCAST = 2_000_000
CELLS_PER_PARTITION = 4


def _terms(text: str) -> Column:
    """Hashes of the distinct terms: lower case runs of anything but ASCII other than letters and digits."""
    words = F.split(F.lower(text), SEPARATOR)
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, text: str = "text", least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """``(h, df)``: hash and number of documents of each term in the band, as a stored table."""
    each = docs.select(_terms(text).alias("t"))
    n = each.where("size(t) > 0").count()
    df = each.select(F.explode("t").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(n)) / F.col("df"))
    return materialize(df.where((idf >= least_idf - 1e-9) & (idf <= most_idf + 1e-9)), "lexicon")


def _level(n: str) -> Column:
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.col(n), F.lit(1)) / RATE))).cast("int")


def _thinned(terms: str, level: Column | str) -> Column:
    """The terms of a level: those whose bits 20 to 20 + level - 1 are 0."""
    return F.expr(f"filter({terms}, h -> shiftright(h, 20) % shiftleft(1L, {level}) = 0)")


def _slots(terms: str) -> str:
    """Per subset the hash of its sorted terms in 16 bits, -1 where it has none."""
    return f"transform(transform(sequence(0, {SLOTS - 1}), s -> filter({terms}, h -> (h & {SLOTS - 1}) = s)), g -> IF(size(g) = 0, -1, CAST(pmod(xxhash64(g), 65536) AS INT)))"


def fingerprint_of(terms: str, level: str, plain: str) -> Column:
    """The struct ``(level, slots, plain)`` from the sorted lexicon terms of ``level``; ``plain`` is the hash of all terms."""
    both = f"concat({_slots(terms)}, {_slots(f'filter({terms}, h -> shiftright(h, 20) % shiftleft(2L, {level}) = 0)')})"
    return F.expr(f"transform(array({both}), x -> named_struct('level', {level}, 'slots', x, 'plain', IF(exists(x, v -> v >= 0), NULL, {plain})))[0]")


def spelled(f: str) -> Column:
    """A fingerprint as text: level, then four hexadecimal digits per subset."""
    return F.expr(f"concat({f}.level, ':', coalesce(lower(lpad(hex({f}.plain), 16, '0')), array_join(transform({f}.slots, v -> IF(v < 0, '----', lower(lpad(hex(v), 4, '0')))), '')))")


def likeness(a: str, b: str) -> Column:
    """Between 0 and 1: agreeing subsets among those with a term on either side, at common levels."""

    def zipped(x: str, y: str) -> str:
        return f"zip_with({x}, {y}, (x, y) -> struct(x, y))"

    low, high = f"slice({{}}.slots, 1, {SLOTS})", f"slice({{}}.slots, {SLOTS + 1}, {SLOTS})"
    pairs = f"""CASE {a}.level - {b}.level WHEN 0 THEN {zipped(f"{a}.slots", f"{b}.slots")} WHEN 1 THEN {zipped(low.format(a), high.format(b))}
        WHEN -1 THEN {zipped(high.format(a), low.format(b))} ELSE filter({zipped(f"{a}.slots", f"{b}.slots")}, p -> false) END"""
    alike = f"IF({a}.plain = {b}.plain, 1D, 0D)"
    return F.expr(f"aggregate({pairs}, struct(0 AS n, 0 AS k), (s, p) -> struct(s.n + IF(p.x >= 0 OR p.y >= 0, 1, 0) AS n, s.k + IF(p.x >= 0 AND p.x = p.y, 1, 0) AS k), s -> IF(s.n = 0, coalesce({alike}, 0D), s.k / s.n))")


def _cells(docs: DataFrame, parts: int) -> Column:
    """The cell of a row, ascending as doc_id and then ``_text`` descend: how many of the quantiles of doc_id lie below it,
    counted from the top. Rows of a doc_id that holds several quantiles, and rows without one, are dealt to several cells by
    ``_text``."""
    shares = [(i + 0.5) / parts for i in range(parts)]
    quantiles = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * parts)).alias("q")).first()[0] or []
    width = max(1, math.isqrt(len(quantiles)))
    literal = lambda x: f"array({', '.join(f'{v}L' for v in x)})" if x else "array(0L)"
    # looked up in two steps: among every width-th quantile, then among those after it
    start = f"greatest(0, (size(filter({literal(quantiles[::width])}, c -> c < doc_id)) - 1) * {width})"
    below = f"({start} + size(filter(slice({literal(quantiles)}, {start} + 1, {width}), c -> c < doc_id)))"
    equal = f"size(filter(slice({literal(quantiles)}, {below} + 1, {parts}), c -> c = doc_id))" if len(set(quantiles)) < len(quantiles) else "0"
    place = "(_text / 18446744073709551616D + 0.5D)"  # from 0 to 1
    return F.expr(f"CAST(IF(doc_id IS NULL, {len(quantiles) + 1} + floor((1 - {place}) * {parts}), {len(quantiles)} - {below} - floor({place} * greatest(1, {equal}))) AS INT)")


def next_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, text, next, _cell, _row, _guest``: every row with the text of the next one in descending doc_id order.
    A row's place is (_cell, _row). Guests are copies of the first rows of the next cells, last in their cell."""
    parts = CELLS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    rows = rows.withColumn("_cell", _cells(rows.select("doc_id"), parts))
    heads = rows.groupBy("_cell").agg(F.max(F.struct("doc_id", "_text")).alias("h"))  # a row a cell
    line = Window.orderBy("_cell")
    after = heads.select("_cell", F.coalesce(F.lead("h").over(line), F.first("h").over(line)).alias("h"))
    after = materialize(after.select(F.col("_cell").alias("_into"), F.col("h.doc_id").alias("_d"), F.col("h._text").alias("_t")), "next-heads")
    met = rows.join(F.broadcast(after), rows["doc_id"].eqNullSafe(after["_d"]) & (rows["_text"] == after["_t"]))
    guests = met.select("doc_id", "text", "_text", F.col("_into").alias("_cell")).dropDuplicates(["_cell"])
    every = rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    walk = Window.partitionBy("_cell").orderBy("_guest", F.desc_nulls_last("doc_id"), F.desc("_text"))
    return every.select("doc_id", "text", F.lead("text").over(walk).alias("next"), "_cell", F.row_number().over(walk).alias("_row"), "_guest")


def edited(text: str = "text", following: str = "next") -> Column:
    """The text whose last third is replaced by as many first characters of the following one."""
    third = f"CAST(floor(char_length({text}) / 3) AS INT)"
    return F.expr(f"concat(substring({text}, 1, char_length({text}) - {third}), substring(coalesce({following}, ''), 1, {third}))")


def fingerprints(docs: DataFrame, text: str = "text", least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """For every row of ``docs``: ``doc_id, n_chars, edited_sha256``, the structs ``f`` and ``g`` of its text's and its edited
    text's fingerprint, and ``after``, the fingerprint of the next document."""
    words = lexicon(docs, text, least_idf, most_idf).select("h", F.lit(True).alias("_in"))
    bounded = words.count() <= MOST_BROADCAST
    rows = next_texts(docs, text).withColumn("_edited", edited())
    rows = rows.withColumns({"_a": F.array_sort(_terms("text")), "_b": F.array_sort(_terms("_edited"))})
    rows = rows.select("doc_id", "_cell", "_row", "_guest", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(F.encode("_edited", "UTF-8"), 256)).alias("_sha"), "_a", "_b", F.size("_a").alias("_na"), F.size("_b").alias("_nb"))
    rows = rows.withColumns({"_la": _level("_na"), "_lb": _level("_nb"), "_pa": F.xxhash64("_a"), "_pb": F.xxhash64("_b")})
    kept = F.concat(F.transform(_thinned("_a", "_la"), lambda h: F.struct(F.lit(0).alias("side"), h.alias("h"))), F.transform(_thinned("_b", "_lb"), lambda h: F.struct(F.lit(1).alias("side"), h.alias("h"))), F.array(F.struct(F.lit(2).alias("side"), F.lit(0).cast("long").alias("h"))))
    own = ["doc_id", "_guest", "n_chars", "_sha", "_la", "_lb", "_pa", "_pb"]
    each = rows.select("_cell", "_row", *own, F.explode(kept).alias("x")).select("_cell", "_row", *own, "x.side", "x.h")
    # the element of side 2 stands for the row itself
    each = each.join(F.broadcast(words) if bounded else words, "h", "left").where("_in OR side = 2")
    met = each.groupBy("_cell", "_row").agg(*[F.first(c).alias(c) for c in own], F.array_sort(F.collect_list(F.expr("IF(side = 0, h, NULL)"))).alias("_a"), F.array_sort(F.collect_list(F.expr("IF(side = 1, h, NULL)"))).alias("_b"))
    done = met.select("_cell", "_row", "_guest", "doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), fingerprint_of("_a", "_la", "_pa").alias("f"), fingerprint_of("_b", "_lb", "_pb").alias("g"))
    return done.withColumn("after", F.lead("f").over(Window.partitionBy("_cell").orderBy("_row"))).where("NOT _guest").drop("_cell", "_row", "_guest")


def near_duplicates_of_next(docs: DataFrame, least: float = 0.8, **options) -> DataFrame:
    """``doc_id, near_next`` of the rows that are this like to the next document."""
    return fingerprints(docs, **options).select("doc_id", likeness("f", "after").alias("near_next")).where(F.col("near_next") >= least)
