"""Line dedup by a segment-partition edit join (DataFrame and SQL functions only).

Lines are the parts of a text between newlines that hold a word. Equal lines are one node, found by hash with map-side
combining. Two lines may differ by one edit for each ``least`` / ``threshold`` characters (12) of the shorter one, by
``threshold`` at most. A node that allows t edits is cut into t + 1 segments: within t edits of another line, one
segment at least survives. Lines of CLASS lengths are cut alike, by the shortest of them: the first half of the segments is
counted from the line's begin, the others from its end, and what a longer line has more lies between. A line is indexed by
number, class and content of its segments, and probes the index of its own class, and of the class below where a line
there may be within the edits, at the few positions where an edit can have moved a segment to (multi-match-aware, so the
number of segments before or after bounds the shift).

A segment that many lines share is no good key: it is found by counting the keys of one line in SAMPLE, and refined.
What is left of these lines without the segment is within the same edits, so it is cut into t + 1 segments in turn,
and the key becomes both segments; up to LEVELS times. Lines that still share a key after that are alike nearly
everywhere. They are cut into blocks of about BUCKET lines, each pair of which meets in a task of its own. The counts only
plan the work: whatever the sample says, no pair is lost.

Lines that share no key with another are left before the join; the characters of the others are counted. A filter inside
the join drops pairs whose counts differ by more than the edits can explain. The text of a line is shuffled once: the table
of lines is cut by the hash that keys and candidates name, so that only these are sent to it.
Candidates are verified by an edit distance that is bit-parallel over the 2 * threshold + 1 diagonals of its band. Near
lines are linked, linked lines form a class.

A line is kept where its class occurs first by doc_id and line number (then by hashes of text and line); every other
occurrence is removed.

Defined results: a null or empty text has no lines; lines of equal characters are equal whatever their doc; lines
too short for one edit (under 12 characters) are compared for equality only; rows without a doc_id give a row but their lines
neither remove nor are removed; rows that repeat a doc_id are one document with the lines of all, and where they repeat
the text too the first copy stands before the others; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismata.plans.components import connected_components
from prismata.plans.hot import join_hot
from prismata.plans.shared import materialize, materialize_by

THRESHOLD, LEAST = 2, 24
BUCKET, SAMPLE, LEVELS = 512, 16, 8
CLASS = 4  # lengths of a class: its lines are cut alike
MARKS = 39  # characters are counted by their code point modulo MARKS, which keeps lower-case letters and digits apart
BLANKS = " \t\n\x0b\x0c\r"


def entries(t: int, below: int = 0) -> list[tuple[int, int]]:
    """All (segment, shift) at which a line that is ``below`` classes of lengths above an indexed line of t edits probes."""
    least = max(0, (below - 1) * CLASS + 1)  # so much shorter is the indexed line at least
    shifts = lambda i: range(max(-i, least - (t - i)), i + 1) if i <= t // 2 else range(i - t, min(t - i, i - least) + 1)
    return [(i, off) for i in range(t + 1) for off in shifts(i)]


def _listed(t: int, below: int = 0) -> str:
    return f"array({', '.join(f'struct({below} AS below, {i} AS i, {off} AS off)' for i, off in entries(t, below))})"


def allowed(length: str, threshold: int = THRESHOLD, least: int = LEAST) -> str:
    """SQL: the edits that a line of this length allows."""
    return f"least({threshold}, CAST({length} * {threshold} DIV {least} AS int))"


def probes(threshold: int = THRESHOLD, least: int = LEAST) -> str:
    """SQL array of the ``entries`` of a line of ``len`` characters, with the class they are for."""
    parts = []
    for below in range((threshold - 1) // CLASS + 2):
        edits = edits_of(f"(len - len % {CLASS} - {below * CLASS})", threshold, least)
        cases = " ".join(f"WHEN {edits} = {t} AND len % {CLASS} + {(below - 1) * CLASS} < {t} THEN {_listed(t, below)}" for t in range(1, threshold + 1) if entries(t, below))
        parts.append(f"CASE {cases} ELSE array() END")
    return f"concat({', '.join(parts)})"


def edits_of(base: str, threshold: int = THRESHOLD, least: int = LEAST) -> str:
    """SQL: the most edits that a line of the class from ``base`` on allows."""
    return allowed(f"({base} + {CLASS - 1})", threshold, least)


# where a key's segment begins in ``rest`` (from 0), and its size: one of t + 1 parts of ``base`` characters, the last ones longer;
# segments of the second half are counted from the end
START = "(i * CAST(base DIV (t + 1) AS int) + greatest(0, i - (t + 1 - base % (t + 1))) + off + IF(i > CAST(t DIV 2 AS int), len - base, 0))"
SIZE = "(CAST(base DIV (t + 1) AS int) + IF(i >= t + 1 - base % (t + 1), 1, 0))"
# bytes are found at once, characters by counting; the bytes hashed are the same
SEGMENT = f"IF(octets = len, substring(bytes, {START} + 1, {SIZE}), CAST(substring(rest, {START} + 1, {SIZE}) AS binary))"
BYTES = ["CAST(rest AS binary) AS bytes", "octet_length(rest) AS octets"]


def character_counts(line: str = "line") -> str:
    """SQL struct of the longs ``low`` and ``high``: the lower and the upper bit of each count of characters modulo 4."""
    bits = f"transform(split({line}, ''), c -> shiftleft(1L, ascii(c) % {MARKS}))"
    return f"aggregate({bits}, named_struct('low', 0L, 'high', 0L), (s, b) -> named_struct('low', s.low ^ b, 'high', s.high ^ (s.low & b)))"


def counts_apart(x: str, y: str) -> str:
    """SQL: a lower bound of the summed differences of two ``character_counts``. A substitution adds two to the sum at most, an
    insertion or deletion one, so lines within t edits are at most 2 * t apart."""
    low, high = f"({x}.low ^ {y}.low)", f"({x}.high ^ {y}.high)"
    return f"bit_count({low}) + 2 * bit_count({high} & ~{low})"


def banded_distance(threshold: int = THRESHOLD) -> str:
    """SQL: edit distance of the character arrays ``ca`` and ``cb``, null above the threshold. Bit d of a level's word
    says that the cell on diagonal d of the current row is within that many edits; once no cell is, rows pass by."""
    width = 2 * threshold + 1
    full = (1 << width) - 1
    match = " | ".join(f"IF(get(ca, i) <=> get(cb, i + {d - threshold}), {1 << d}, 0)" for d in range(width))
    start = ", ".join(f"{sum(1 << (threshold + j) for j in range(e + 1))} AS r{e}" for e in range(threshold + 1))
    step = "r.r0 & x"
    levels = [f"({step}) AS r0"]
    for e in range(1, threshold + 1):
        step = f"((r.r{e} & x) | r.r{e - 1} | shiftright(r.r{e - 1}, 1) | shiftleft({step}, 1)) & {full}"
        levels.append(f"({step}) AS r{e}")
    row = f"transform(array({match}), x -> struct({', '.join(levels)}))[0]"
    last = f"shiftleft(1, size(cb) - size(ca) + {threshold})"
    verdict = " ".join(f"WHEN r.r{e} & {last} <> 0 THEN {e}" for e in range(threshold + 1))
    return f"CASE WHEN abs(size(ca) - size(cb)) > {threshold} THEN NULL WHEN size(ca) = 0 THEN size(cb) ELSE aggregate(sequence(0, size(ca) - 1), struct({start}), (r, i) -> IF(r.r{threshold} = 0, r, {row}), r -> CASE {verdict} END) END"


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, row, line_no, line, l1, l2)``: every line with a word, a hash of its text, and the two hashes that
    stand for the line."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("row"), F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    rows = rows.where(F.btrim("line", F.lit(BLANKS)) != "")
    return rows.select("doc_id", "row", "line_no", "line", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit("second"), "line").alias("l2"))


def _hot(keyed: DataFrame) -> DataFrame:
    """``(hot, n)``: keys of BUCKET rows or more, and about how many, by the lines of a sample."""
    some = keyed.where(F.pmod("l1", F.lit(SAMPLE)) == 0).groupBy(F.col("key").alias("hot")).agg((F.count("*") * SAMPLE).alias("n"))
    return materialize(some.where(F.col("n") >= BUCKET), "hot-segments")


def _keyed(nodes: DataFrame, threshold: int, least: int) -> DataFrame:
    """``(l1, rest, len, base, t, start, size, key, own)``: the keys of every line (``l1, line``)."""
    rows = nodes.select("l1", F.col("line").alias("rest"), F.char_length("line").alias("len")).select("*", *map(F.expr, BYTES))
    rows = rows.select("*", F.inline(F.expr(probes(threshold, least))))
    rows = rows.withColumn("base", F.expr(f"len - len % {CLASS} - below * {CLASS}")).withColumn("t", F.expr(edits_of("base", threshold, least)))
    return rows.selectExpr("l1", "rest", "len", "base", "t", f"{START} AS start", f"{SIZE} AS size", f"xxhash64(i, base, {SEGMENT}) AS key", "below = 0 AND off = 0 AS own")


def _refined(keyed: DataFrame, hot: DataFrame, threshold: int) -> DataFrame:
    """The keys of hot rows become keys of two segments, where what is left is long enough for another."""
    rows = keyed.join(hot.select("hot"), F.col("key") == F.col("hot"), "left").withColumn("refine", F.expr("hot IS NOT NULL AND base - size >= 3 * (t + 1)"))
    rows = rows.selectExpr("l1", "own", "key", "t", "refine", "start", "size", "IF(refine, concat(substring(rest, 1, start), substring(rest, start + size + 1)), rest) AS rest", "len - IF(refine, size, 0) AS len", "base - IF(refine, size, 0) AS base")
    cases = " ".join(f"WHEN t = {t} THEN {_listed(t)}" for t in range(1, threshold + 1))
    rows = rows.selectExpr("*", *BYTES).select("*", F.inline(F.expr(f"CASE WHEN NOT refine THEN array(struct(0 AS below, 0 AS i, 0 AS off)) {cases} END")))
    return rows.selectExpr("l1", "rest", "len", "base", "t", f"IF(refine, {START}, start) AS start", f"IF(refine, {SIZE}, size) AS size", f"IF(refine, xxhash64(key, i, base, {SEGMENT}), key) AS key", "own AND off = 0 AS own")


def _blocks(keyed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``(cell, own, probe, l1)``: rows that meet, as indexed line or as probe; hot keys in pairs of blocks."""
    slim = keyed.select("key", "l1", "own")
    if hot is None:
        return slim.select(F.col("key").alias("cell"), "own", F.lit(True).alias("probe"), "l1")
    rows = slim.join(hot, F.col("key") == F.col("hot"), "left").withColumn("m", F.ceil(F.col("n") / BUCKET))
    row_, column = "transform(sequence(0L, m - 1), b -> struct(xxhash64(key, pmod(l1, m), b) AS cell, true AS own, false AS probe))", "transform(sequence(0L, m - 1), a -> struct(xxhash64(key, a, pmod(l1, m)) AS cell, false AS own, true AS probe))"
    cells = F.expr(f"CASE WHEN m IS NULL THEN array(struct(key AS cell, own AS own, true AS probe)) WHEN own THEN concat({row_}, {column}) ELSE {column} END")
    return rows.withColumn("c", F.explode(cells)).select("c.cell", "c.own", "c.probe", "l1")


def near_pairs(rows: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """``(a, b, distance)``: pairs of different lines (by their first hash) within the threshold."""
    long = rows.withColumn("len", F.char_length("line")).where(f"{allowed('len', threshold, least)} > 0")
    nodes = materialize_by(long.groupBy("l1").agg(F.min("line").alias("line")), "line-nodes", "l1")
    keyed = _keyed(nodes, threshold, least)
    hot: DataFrame | None = None
    for level in range(LEVELS):
        hot = _hot(keyed)
        if hot.isEmpty():
            hot = None
            break
        if level < LEVELS - 1:
            keyed = _refined(keyed, hot, threshold)
    # most cells hold one line: the join sorts only what is left of them
    cell = Window.partitionBy("cell")
    met = _blocks(keyed, hot).withColumns({"n": F.count("*").over(cell), "index": F.max("own").over(cell)}).where("n > 1 AND index").drop("n", "index")
    met = materialize(met, "line-cells")
    # only hashes are sent to the lines, which stay where they are
    texts = materialize_by(nodes.join(met.select("l1").distinct().hint("shuffle_hash"), "l1", "left_semi"), "line-texts", "l1")
    counted = materialize(texts.select("l1", F.expr(character_counts()).alias("counts")), "line-counts")
    met = met.join(counted, "l1").repartition("cell")  # one exchange serves both sides of the join
    index = met.select("cell", F.explode(F.expr("IF(own, array(struct(l1 AS l1, counts AS counts, probe AS probe)), array())")).alias("x")).select("cell", "x.l1", "x.counts")
    probe = met.select("cell", F.explode(F.expr("IF(probe, array(struct(l1 AS other, counts AS other_counts, own AS own)), array())")).alias("x")).select("cell", "x.other", "x.other_counts")
    near = index.join(probe, "cell").where(f"l1 <> other AND {counts_apart('counts', 'other_counts')} <= {2 * threshold}").select(F.least("l1", "other").alias("a"), F.greatest("l1", "other").alias("b"))
    pairs = materialize(near.distinct(), "line-candidates")
    sides = pairs.join(texts.select(F.col("l1").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("l1").alias("b"), F.col("line").alias("y")), "b")
    # stored before it is filtered: a filter would be pushed through the steps and repeat each of them in itself
    return materialize(differing(sides).select("a", "b", F.expr(allowed("least(char_length(x), char_length(y))", threshold, least)).alias("allowed"), F.expr(banded_distance(threshold)).alias("distance")), "line-distances").where("distance <= allowed").drop("allowed")


def differing(pairs: DataFrame) -> DataFrame:
    """Cut the equal beginning and the equal end off ``x`` and ``y`` (no edit is needed there); what is left comes as
    the character arrays ``ca`` and ``cb``. The lengths of both are found by bisection."""
    halves = "transform(sequence(0, 31), k -> shiftright(1073741824, k))"

    def common(side: str, room: str) -> str:
        return f"aggregate(filter({halves}, h -> h <= {room}), 0, (n, h) -> IF(n + h <= {room} AND {side}(x, n + h) = {side}(y, n + h), n + h, n))"

    room = "least(char_length(x), char_length(y))"
    ends = F.expr(f"transform(array({common('left', room)}), h -> struct(h AS head, {common('right', f'({room} - h)').replace('(n, h)', '(n, g)').replace('n + h', 'n + g').replace('h -> h <=', 'g -> g <=')} AS tail))[0]")
    df = pairs.withColumn("ends", ends).select("*", "ends.head", "ends.tail")
    for name, text in (("ca", "x"), ("cb", "y")):
        rest = F.expr(f"substring({text}, head + 1, char_length({text}) - head - tail)")
        df = df.withColumn(name, F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, "")))
    return df


def line_classes(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """``(doc_id, row, line_no, line, class_line, links, first_of_line, kept)`` per line of each row: the hashes of
    the line and of the line that names its class, its links to different lines, whether it is the first of its
    characters, and whether it stays."""
    rows = lines(docs, text)
    links = near_pairs(rows, threshold, least)
    classes = connected_components(links.select("a", "b"), "line-classes")
    degree = links.select(F.col("a").alias("l1")).union(links.select(F.col("b").alias("l1"))).groupBy("l1").agg(F.count("*").alias("links"))
    seen = materialize(rows.drop("line"), "lines")
    here = F.struct("doc_id", "line_no", "row", "l1", "l2")
    first = seen.groupBy("l1", "l2").agg(F.min(F.when(F.col("doc_id").isNotNull(), here)).alias("first"), F.count("*").alias("n"))
    near = first.join(classes.withColumnRenamed("node", "l1"), "l1").groupBy("component").agg(F.min("first").alias("lead"))
    near = classes.join(near, "component").select(F.col("node").alias("l1"), "component", "lead").join(degree, "l1")
    known = materialize(first.join(near, "l1", "left"), "line-firsts")
    told = join_hot(seen, known, ["l1", "l2"], seen.count())
    lead = F.coalesce("lead", "first")
    return told.select("doc_id", "row", "line_no", F.col("l1").alias("line"), F.coalesce("component", "l1").alias("class_line"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce(here == F.col("first"), F.lit(False)).alias("first_of_line"), (F.col("doc_id").isNull() | (here == lead)).alias("kept"))


def dedup_lines(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_near, n_links)`` per document: its lines, those removed, those of them that
    equal no earlier line and went as a near copy, and the links of its lines to different lines."""
    per = line_classes(docs, text, threshold, least).groupBy("doc_id", "row").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept") & F.col("first_of_line")).alias("near"), F.sum("links").alias("links"))
    copies = docs.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_r")).groupBy("_d", "_r").agg(F.count("*").alias("copies"))
    out = copies.join(per, per["doc_id"].eqNullSafe(F.col("_d")) & (per["row"] == F.col("_r")), "left")
    once = F.when(F.col("_d").isNotNull(), F.col("copies")).otherwise(1)  # of equal rows the first keeps its lines
    sums = {"n_lines": F.sum("n"), "n_removed": F.sum(F.expr("n") - F.col("n_kept") / once), "n_near": F.sum(F.col("near") / once), "n_links": F.sum("links")}
    return out.groupBy(F.col("_d").alias("doc_id")).agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in sums.items()])


def remove_lines(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """``(doc_id, text)`` per row of ``docs``: texts without the removed lines (lines without a word stay); of rows
    that repeat both doc_id and text each keeps what the first keeps."""
    gone = line_classes(docs, text, threshold, least).where("NOT kept").groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(gone, (F.col("doc_id") == F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_r")), "left")
    cut = F.expr("array_join(filter(split(text, '\n'), (x, i) -> NOT array_contains(gone, i)), '\n')")
    return rows.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias("text"))
