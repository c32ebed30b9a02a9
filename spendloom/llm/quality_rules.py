"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a text. How often a rule casts each vote on good
and on bad texts is not known beforehand; expectation-maximisation estimates it from the votes alone, and
the posterior probability of "good" replaces a filter that all rules must pass.

The votes of all rows are counted per vote pattern (at most 3^rules patterns, whatever the input), and the
estimation runs over these counts inside one Spark expression. Nothing but built-in functions is used.

Defined cases: a null text counts as empty; an empty text has no words, fails the base test and is not
kept. Rows are judged one by one, so repeated rows and repeated or null ids do no harm. Over an empty table
the result is empty. Extra columns of any name are carried in `row` and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendloom.llm.common import let, removed, words_of

#: A text is kept if its posterior is at least this.
KEEP = 0.5
ROUNDS = 25
#: Before any vote is seen: the share of good texts, and (bad, abstain, good) votes of a useful rule.
PRIOR = 0.8
VOTES_IF_GOOD = (0.05, 0.25, 0.7)
VOTES_IF_BAD = (0.5, 0.3, 0.2)
#: The first guess counts as this share of all rows in every round, which holds the two classes apart.
ANCHOR = 0.05
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Number of words in windows of five words that the array holds twice or more."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda at: F.xxhash64(*[F.element_at(words, at + k) for k in range(WINDOW)]),
    )

    def covered(hashes: Column) -> Column:
        def sorted_covered(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]),
            )
            return let(
                F.array_sort(F.transform(twice, lambda x: x["at"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
            )

        pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, sorted_covered))

    return F.when(F.size(words) > WINDOW, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """(row, measures of the text) for every row."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    with_words = packed.select("row", text.alias("text"), words_of(F.col("row.text")).alias("words"), lines.alias("lines"))
    words = F.col("words")
    found = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.length(w)).alias("word_chars"),
        removed(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        removed(F.col("text"), CAPITALS).cast("long").alias("n_capitals"),
        removed(F.col("text"), "!?").cast("long").alias("n_shouts"),
        removed(F.col("text"), ".").cast("long").alias("n_stops"),
    )
    # a generator keeps the optimizer from copying the measures into every rule and filter that reads them
    return with_words.select("row", F.inline(F.array(found)))


#: (name, bad if, good if), as SQL over the measures. Whole numbers only, so that every engine agrees.
RULES = [
    ("symbols", "5 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    ("lines", "2 * n_dup_lines > n_lines", "n_lines >= 2 AND n_dup_lines = 0"),
    ("length", "n_words < 10", "n_words >= 50"),
    ("capitals", "5 * n_capitals > word_chars", "10 * n_capitals <= word_chars"),
    ("shouts", "3 * n_shouts > n_words", "20 * n_shouts <= n_words"),
    ("word_length", "word_chars < 3 * n_words OR 2 * word_chars > 13 * n_words", "word_chars >= 4 * n_words AND word_chars <= 6 * n_words"),
    ("distinct", "10 * n_distinct < 3 * n_words", "2 * n_distinct >= n_words"),
    ("stops", "n_words >= 30 AND n_stops = 0", "n_stops * 40 >= n_words AND n_stops * 2 <= n_words"),
]
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0))


def with_votes(measured: DataFrame) -> DataFrame:
    return measured.withColumn("votes", F.array(*[vote(bad, good) for _, bad, good in RULES]))


def posterior(votes: Column, model: Column) -> Column:
    """Probability of "good" given the votes; model: prior, and per rule the probability of each vote in either class."""
    odds = F.aggregate(
        F.zip_with(votes, model["rules"], lambda v, r: F.ln(r["good"][v + 1]) - F.ln(r["bad"][v + 1])),
        F.ln(model["prior"] / (1 - model["prior"])),
        lambda total, x: total + x,
    )
    return 1 / (1 + F.exp(-odds))


def first_guess() -> Column:
    one = F.struct(F.array(*map(F.lit, VOTES_IF_GOOD)).alias("good"), F.array(*map(F.lit, VOTES_IF_BAD)).alias("bad"))
    return F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(one, len(RULES)).alias("rules"))


def improved(patterns: Column, model: Column) -> Column:
    """One round: posteriors of the patterns, then prior and vote probabilities from the weighted counts."""

    def total(rows: Column, of) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda t, x: t + of(x))

    def estimate(rows: Column) -> Column:
        def smoothed(rule: Column, at: int, weight, mass: Column, guess: float, n: Column) -> Column:
            seen = total(rows, lambda x: F.when(F.get(x["votes"], rule) == at - 1, weight(x)).otherwise(F.lit(0.0)))
            return (seen + ANCHOR * n * guess) / (mass + ANCHOR * n)

        def rules(n: Column, good: Column) -> Column:
            return F.struct(
                ((good + ANCHOR * n * PRIOR) / (n + ANCHOR * n)).alias("prior"),
                F.transform(
                    F.sequence(F.lit(0), F.lit(len(RULES) - 1)),
                    lambda j: F.struct(
                        F.array(*[smoothed(j, at, lambda x: x["n"] * x["p"], good, g, n) for at, g in enumerate(VOTES_IF_GOOD)]).alias("good"),
                        F.array(*[smoothed(j, at, lambda x: x["n"] * (1 - x["p"]), n - good, g, n) for at, g in enumerate(VOTES_IF_BAD)]).alias("bad"),
                    ),
                ).alias("rules"),
            )

        return let(
            F.struct(total(rows, lambda x: x["n"]).alias("n"), total(rows, lambda x: x["n"] * x["p"]).alias("good")),
            lambda sums: rules(sums["n"], sums["good"]),
        )

    scored = F.transform(patterns, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), posterior(x["votes"], model).alias("p")))
    return let(scored, estimate)


def fit(voted: DataFrame) -> DataFrame:
    """One row with the column model. Only the counts per vote pattern, 3^rules at most, meet in one task."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    gathered = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return gathered.select(
        F.when(F.size("patterns") == 0, first_guess())
        .otherwise(F.aggregate(rounds, first_guess(), lambda model, _: improved(F.col("patterns"), model)))
        .alias("model")
    )


def judged(voted: DataFrame, model: DataFrame) -> DataFrame:
    """Adds base_failed, quality (the posterior) and kept."""
    return (
        voted.select("*", F.expr(BASE_FAILED).alias("base_failed"), F.explode(F.array(model.scalar())).alias("model"))
        .withColumn("quality", posterior(F.col("votes"), F.col("model")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))
        .drop("model")
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """(row, measures, votes, base_failed, quality, kept) for every row of docs."""
    voted = with_votes(measures(docs))
    return judged(voted, fit(voted))
