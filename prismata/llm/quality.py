"""Quality rules by weak supervision (DataFrame and SQL functions only).

Every rule votes good (1), bad (0) or abstains (-1) on a document. Expectation-maximisation over the counts of the
vote patterns, of which there are at most 3 ** len(RULES), estimates how often each rule is right on good and on bad
documents, and a document is kept when its posterior probability of being good reaches ``threshold``; no single rule
has to pass. The counts are map-side combined; EM itself is one SQL expression over that bounded pattern table.

Defined results: a null text counts as empty; a document without words has zero counts, fails the base check and is
not kept; repeated rows are judged alike, each on its own; an empty table gives an empty table; other columns of the
input, whatever their names, are carried in a struct and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.llm.text import SPACES
from prismata.plans.shared import materialize

WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: (name, good when, bad when) over the signal columns; a document for which neither holds gets no vote.
RULES = [
    ("length", "n_words >= 50", "n_words < 20"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 7 * n_words", "word_chars > 9 * n_words OR word_chars < 2 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("symbol_runs", "50 * n_symbol_runs <= n_words", "10 * n_symbol_runs > n_words"),
    ("line_copies", "10 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    ("repeats", "10 * n_repeat_words <= n_words", "100 * n_repeat_words > 30 * n_words"),
    ("stutter", "20 * n_stutter <= n_words", "4 * n_stutter > n_words"),
]
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its columns in the struct ``_row``, and the signals."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), t.alias("_t"))
    df = df.withColumn("_words", F.split(F.btrim("_t", F.lit(BLANKS)), SPACES))
    df = df.withColumn("_words", F.when(F.col("_words")[0] == "", F.array().cast("array<string>")).otherwise(F.col("_words")))
    df = df.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit(SYMBOLS + "+")).cast("long").alias("n_symbol_runs"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"),
        F.expr("size(filter(_words, (w, i) -> i > 0 AND w = _words[i - 1]))").cast("long").alias("n_stutter"),
        F.expr(f"IF(size(_words) < {WINDOW}, array(), transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))))").alias("_win"),
    )
    df = df.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_again": F.size(F.array_distinct("_win")) < F.size("_win")}).drop("_lines")
    # only documents in which some window occurs again are sorted; equal windows then stand side by side
    df = df.withColumn("_sorted", F.expr("IF(_again, sort_array(transform(_win, (h, i) -> struct(h AS h, i AS i))), NULL)")).drop("_win")
    df = df.withColumn("_at", F.expr("IF(_again, sort_array(transform(filter(_sorted, (p, k) -> (k > 0 AND _sorted[k - 1].h = p.h) OR (k < size(_sorted) - 1 AND _sorted[k + 1].h = p.h)), p -> p.i)), NULL)")).drop("_sorted", "_again")
    covered = F.expr(f"coalesce(aggregate(_at, struct(0 AS upto, 0L AS n), (a, p) -> struct(p + {WINDOW} AS upto, a.n + p + {WINDOW} - greatest(a.upto, p) AS n), a -> a.n), 0L)")
    return df.withColumn("n_repeat_words", covered).drop("_at")


def votes() -> Column:
    """The votes of RULES as an array of 1 (good), 0 (bad) and -1 (no vote)."""
    return F.array(*[F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END") for _, good, bad in RULES])


def posterior_of_patterns(voted: DataFrame, rounds: int = 40, prior: float = 0.8, on_good: float = 0.99, on_bad: float = 0.3) -> DataFrame:
    """``voted(votes)`` -> ``(votes, posterior)`` per occurring vote pattern, by two-sided EM with add-one smoothing.

    EM starts from rules that seldom blame a good document (``on_good`` of their votes are right) and each catch a
    part of the bad ones (``on_bad``): bad documents are of several kinds, and no rule sees them all. Each kind is
    seen by two rules at least, so that the kinds stand out as one class against the good documents.
    One row holds all patterns (at most 3 ** len(RULES) of them, whatever the input), sorted, so sums repeat exactly.
    """
    k = len(RULES)
    each = range(k)
    good = " * ".join(f"CASE p.v[{j}] WHEN 1 THEN s.g[{j}] WHEN 0 THEN 1 - s.g[{j}] ELSE 1D END" for j in each)
    bad = " * ".join(f"CASE p.v[{j}] WHEN 0 THEN s.b[{j}] WHEN 1 THEN 1 - s.b[{j}] ELSE 1D END" for j in each)
    post = f"transform(pats, p -> struct(p.v AS v, p.n AS n, (s.prior * {good}) / (s.prior * {good} + (1 - s.prior) * {bad}) AS q))"

    def total(weight: str, having: str) -> str:
        return f"aggregate(e, 0D, (t, p) -> t + IF({having}, {weight}, 0D))"

    g = ", ".join(f"(1 + {total('p.n * p.q', f'p.v[{j}] = 1')}) / (2 + {total('p.n * p.q', f'p.v[{j}] >= 0')})" for j in each)
    b = ", ".join(f"(1 + {total('p.n * (1 - p.q)', f'p.v[{j}] = 0')}) / (2 + {total('p.n * (1 - p.q)', f'p.v[{j}] >= 0')})" for j in each)
    new = f"struct((1 + {total('p.n * p.q', 'true')}) / (2 + {total('p.n', 'true')}) AS prior, array({g}) AS g, array({b}) AS b)"
    start = f"struct({prior}D AS prior, array({', '.join([f'{on_good}D'] * k)}) AS g, array({', '.join([f'{on_bad}D'] * k)}) AS b)"
    one = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("pats"))
    fit = one.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, r) -> transform(array({post}), e -> {new})[0])"))
    return fit.select(F.explode(F.expr(post)).alias("x")).select(F.col("x.v").alias("votes"), F.col("x.q").alias("posterior"))


def judge(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``posterior`` and ``kept`` to a stored table of signals with ``votes``."""
    fitted = posterior_of_patterns(scored.select("votes"))
    df = scored.join(F.broadcast(fitted), "votes", "left")  # at most 3 ** len(RULES) rows
    df = df.withColumn("base_failed", F.expr(BASE_FAILED))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs`` (in ``_row``) with signals, votes, posterior and verdict. The signals are written once to
    the shared folder: the fit and the verdict both read that table."""
    return judge(materialize(signals(docs).withColumn("votes", votes()), "quality"), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns."""
    return score(docs, threshold).where("kept").select("_row.*")
