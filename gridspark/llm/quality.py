"""Quality by weak supervision: rules vote or abstain, EM weighs them, the posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import staged, words

WINDOW = 8  # words in a repeated window


def _kept_chars(pattern: str) -> Column:
    return F.length(F.regexp_replace(F.col("_text"), pattern, "")).cast("long")


def _repeat_words() -> Column:
    """Words inside windows that occur twice or more, from the ordered hashes of all windows.

    A hash set tells whether any window repeats; only then are windows ordered by hash to find equal
    neighbours, and their positions ordered to measure what they cover.
    """
    spots = F.array_sort(F.transform(F.col("_win"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    one = F.array(spots)  # binds the sorted array, so that it is computed once
    twice = F.transform(one, lambda s: F.filter(s, lambda x, k: (
        ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))))
    at = F.transform(twice, lambda s: F.array_sort(F.transform(s, lambda x: x["i"])))
    cover = F.transform(at, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.get(cover, F.lit(0))).otherwise(0).cast("long")


def text_stats(docs: DataFrame) -> DataFrame:
    """Per document the counts the rules look at, from its whole text.

    A missing text counts as empty.  Every row has its own result, repeated rows included.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    base = base.withColumn("_words", words("_text")).withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.size("_words") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        *[F.get(F.col("_hash"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    base = base.withColumn("_lines", lines).withColumn("_win", windows)
    return base.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"),
        _kept_chars(r"[\x20\x09-\x0D]+").alias("word_chars"), _kept_chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
        _kept_chars(r"[^A-Z]+").alias("n_capitals"), _kept_chars(r"[^!?]+").alias("n_marks"))


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) where ``bad`` holds, else good (1) where ``good`` holds, else abstains (0)."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END")


RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words", "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "n_words > 0 AND 50 * n_symbols <= n_words"),
    Rule("lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "n_lines >= 3 AND 20 * n_dup_lines <= n_lines"),
    Rule("repeats", "10 * n_repeat_words > 3 * n_words", "n_words >= 20 AND 20 * n_repeat_words <= n_words"),
    Rule("capitals", "5 * n_capitals > 2 * word_chars", "n_words > 0 AND 10 * n_capitals <= word_chars"),
    Rule("marks", "4 * n_marks > n_words", "n_words > 0 AND 20 * n_marks <= n_words"),
)


VOTES = (-1, 0, 1)
#: How often a rule votes bad, abstains, votes good: start values and prior beliefs of EM, for good and for bad documents.
GOOD_VOTES, BAD_VOTES = (0.005, 0.095, 0.90), (0.30, 0.10, 0.60)
BELIEF = 5.0  # documents the prior beliefs count as
MOST_FALSE = 0.005  # a rule accuses no larger share of the good documents: rules are written so that accusations are safe


def _posterior(votes: Column, prior: Column, good: Column, bad: Column) -> Column:
    """Probability of being good; ``good`` and ``bad`` hold three shares of votes per rule."""
    gains = F.transform(votes, lambda v, j: F.log(F.get(good, 3 * j + v + 1) / F.get(bad, 3 * j + v + 1)))
    odds = F.aggregate(gains, F.log(prior / (1 - prior)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, n_rules: int, rounds: int = 50) -> Column:
    """EM over vote patterns: a scalar struct ``prior double, good array<double>, bad array<double>``.

    A rule's accuracy is its shares of votes among good and among bad documents, so a rule that hardly ever accuses a good
    document outweighs many that rarely notice a bad one.  A pattern is one of 3^rules, so the table of their counts
    has a bounded size; it is folded ``rounds`` times inside one expression.  Without any row the prior beliefs hold.
    """
    counts = votes.groupBy("votes").agg(F.count("*").alias("n"))
    table = counts.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("pats"))

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)

    def shares(seen: Column, weight: str, belief: tuple[float, ...]) -> Column:
        all_ = total(F.transform(seen, lambda p: p[weight])) + F.lit(BELIEF)
        held = F.array(*[F.lit(BELIEF * x) for x in belief])
        return F.transform(F.sequence(F.lit(0), F.lit(3 * n_rules - 1)), lambda c: (
            total(F.transform(seen, lambda p: F.when(F.get(p["votes"], F.floor(c / 3).cast("int")) == c % 3 - 1, p[weight]).otherwise(0.0)))
            + F.get(held, c % 3)) / all_)

    def bounded(good: Column) -> Column:
        return F.transform(good, lambda x, c: F.when(c % 3 == 0, F.least(x, F.lit(MOST_FALSE))).otherwise(x))

    def step(state: Column, _: Column) -> Column:
        q = lambda p: _posterior(p["votes"], state["prior"], state["good"], state["bad"])
        seen = F.transform(F.col("pats"), lambda p: F.struct(p["votes"].alias("votes"), p["n"].cast("double").alias("n"), q(p).alias("q")))
        seen = F.transform(seen, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * p["q"]).alias("g"),
                                                    (p["n"] * (1 - p["q"])).alias("b")))
        # a one-element array binds the weighted patterns, so that they are computed once a round
        return F.get(F.transform(F.array(seen), lambda s: F.struct(
            ((total(F.transform(s, lambda p: p["g"])) + BELIEF) / (total(F.transform(s, lambda p: p["n"])) + 2 * BELIEF)).alias("prior"),
            bounded(shares(s, "g", GOOD_VOTES)).alias("good"), shares(s, "b", BAD_VOTES).alias("bad"))), F.lit(0))

    first = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(x) for x in GOOD_VOTES * n_rules]).alias("good"),
                     F.array(*[F.lit(x) for x in BAD_VOTES * n_rules]).alias("bad"))
    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step).alias("model")).scalar()


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Counts, ``votes``, ``quality`` (posterior of being good), ``base_failed`` and ``kept`` per document.

    ``base_failed``: under 20 words or over 30 % of the words in repeated windows.  ``kept`` is false
    then, else tells whether ``quality`` reaches ``least``; EM learns from the documents this question arises for.  Missing and empty texts fail; an empty table gives no rows.
    """
    stats = staged(text_stats(docs), "text_stats")
    voted = stats.withColumn("votes", F.array(*[r.vote() for r in rules]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    model = estimate(voted.where(~failed), len(rules))
    return (voted.withColumn("_model", model)
            .withColumn("quality", _posterior(F.col("votes"), F.col("_model")["prior"], F.col("_model")["good"], F.col("_model")["bad"]))
            .withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least)).drop("_model"))
