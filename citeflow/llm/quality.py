"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs the votes."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.tables import GAP, Scratch

BLANK = " \t\n\x0b\f\r"
MIN_WORDS = 50
# Words inside repeated three-word windows, in percent of all words.
MAX_REPEAT = 50
# Documents go whose posterior probability of being good is below this.
THRESHOLD = 0.2
PRIOR, PRIOR_RIGHT = 10.0, (0.9, 0.5)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeated(found: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first occurrence included.

    Texts without a repeated window, told by a hash set, are done at once; in the others equal windows
    are brought together by sorting, so long texts of one word cost no more than others.
    """
    def marked(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s: Column, i: Column, step: int) -> Column:
            return F.coalesce(F.get(s, i + step)["h"] == F.get(s, i)["h"], F.lit(False))

        def words_in(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(s, i, 1) | ((i > 0) & same(s, i, -1)))
            spans = F.transform(at, lambda i: F.transform(F.array(*map(F.lit, range(3))), lambda d: F.get(s, i)["i"] + d))
            return F.size(F.array_distinct(F.flatten(spans)))

        return let(pairs, words_in)

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

    counted = let(
        found,
        lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(marked(h))),
    )
    return F.when(F.size(found) < 4, 0).otherwise(counted).cast("long")


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` and the struct ``_q`` of counts over the whole text; null and blank texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANK))
    found = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP, -1))
    first = docs.withColumn("_words", found)
    full = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    first = first.withColumn("_lines", full)
    w, rows = F.col("_words"), F.col("_lines")
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size(rows).cast("long").alias("n_lines"),
        (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        _repeated(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))).cast("long").alias("n_unlettered"),
        F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>]"))).cast("long").alias("n_symbol_words"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaimed"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        F.size(F.filter(rows, lambda x: x.rlike(r"[.!?:;…。！？]['\"\)»”]*[\x20\x09-\x0D]*$")))
        .cast("long").alias("n_ended"),
    )
    # As a generated column the counts are made once a row: a filter on what follows from them can't be moved below
    # and repeat them. The outer form adds no filter of its own.
    return first.withColumn("_q", F.explode_outer(F.array(counts))).drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where one of the conditions holds, and abstains otherwise."""

    name: str
    good: Callable[[Callable[[str], Column]], Column]
    bad: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("length", lambda q: q("n_words") >= 80, lambda q: q("n_words") < 30),
    Rule(
        "word_length",
        lambda q: q("word_chars").between(q("n_words") * 3, q("n_words") * 10),
        lambda q: (q("word_chars") < q("n_words") * 2) | (q("word_chars") > q("n_words") * 16),
    ),
    Rule("symbols", lambda q: q("n_symbols") * 50 <= q("n_words"), lambda q: q("n_symbols") * 10 > q("n_words")),
    Rule(
        "symbol_words",
        lambda q: q("n_symbol_words") * 20 <= q("n_words"), lambda q: q("n_symbol_words") * 10 > q("n_words") * 3,
    ),
    Rule(
        "lines",
        lambda q: q("n_dup_lines") * 20 <= q("n_lines"),
        lambda q: (q("n_dup_lines") >= 3) & (q("n_dup_lines") * 2 > q("n_lines")),
    ),
    Rule(
        "windows", lambda q: q("n_repeat_words") * 10 <= q("n_words"), lambda q: q("n_repeat_words") * 10 > q("n_words") * 3
    ),
    Rule("letters", lambda q: q("n_unlettered") * 10 <= q("n_words"), lambda q: q("n_unlettered") * 10 > q("n_words") * 3),
    Rule("capitals", lambda q: q("n_capitals") * 5 <= q("word_chars"), lambda q: q("n_capitals") * 2 > q("word_chars")),
    Rule("exclamations", lambda q: q("n_exclaimed") * 20 <= q("n_words"), lambda q: q("n_exclaimed") * 5 > q("n_words")),
    Rule("endings", lambda q: q("n_ended") * 2 >= q("n_lines"), lambda q: q("n_ended") * 10 < q("n_lines")),
)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """One letter a rule: g, b or a."""
    def q(name: str) -> Column:
        return F.col("_q")[name]

    letters = [F.when(r.bad(q), "b").when(r.good(q), "g").otherwise("a") for r in rules]
    return F.when(q("n_words") == 0, F.lit("b" + "a" * (len(rules) - 1))).otherwise(F.concat(*letters))


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and for each rule the chance that it votes right on a good and on a bad
    document, given that it votes."""

    good_share: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def log_odds(self, letter: str, i: int) -> float:
        if letter == "a":
            return 0.0
        on_good, on_bad = self.right_on_good[i], self.right_on_bad[i]
        return math.log(on_good / (1 - on_bad)) if letter == "g" else math.log((1 - on_good) / on_bad)

    def probability(self, pattern: str) -> float:
        odds = math.log(self.good_share / (1 - self.good_share))
        odds += sum(self.log_odds(x, i) for i, x in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))

    def column(self, pattern: Column) -> Column:
        odds = F.lit(math.log(self.good_share / (1 - self.good_share)))
        for i in range(len(self.right_on_good)):
            letter = F.substring(pattern, i + 1, 1)
            odds = odds + F.when(letter == "g", self.log_odds("g", i)).when(letter == "b", self.log_odds("b", i)).otherwise(0.0)
        return F.round(1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds)))), 9)


def fit(patterns: DataFrame, n_rules: int = len(RULES), rounds: int = 60) -> VoteModel:
    """Expectation-maximisation over ``patterns(_votes, _n)``.

    Only the counts of the vote patterns come to the driver: at most ``3 ** n_rules`` rows, 59,049
    for ten rules, whatever the corpus. A prior worth `PRIOR` documents a rule (right on nine good documents in ten, and on half of the bad
    ones, as a rule knows one defect) defines the accuracy of rules nobody trips and of empty tables. A
    vote never counts against what it says: that names the two classes.
    """
    counts = sorted((r["_votes"], r["_n"]) for r in patterns.collect())
    total = sum(n for _, n in counts)
    model = VoteModel(0.8, (PRIOR_RIGHT[0],) * n_rules, (PRIOR_RIGHT[1],) * n_rules)
    if not total:
        return model
    for _ in range(rounds):
        good_sum = 0.0
        hit = [[PRIOR * x for x in PRIOR_RIGHT] for _ in range(n_rules)]
        cast = [[PRIOR, PRIOR] for _ in range(n_rules)]
        for pattern, n in counts:
            p = model.probability(pattern)
            good_sum += n * p
            for i, x in enumerate(pattern):
                if x != "a":
                    cast[i][0] += n * p
                    cast[i][1] += n * (1 - p)
                    hit[i][0 if x == "g" else 1] += n * (p if x == "g" else 1 - p)
        on_good = [min(0.999, max(0.5, h[0] / c[0])) for h, c in zip(hit, cast, strict=True)]
        on_bad = [min(0.999, max(1 - g, h[1] / c[1])) for h, c, g in zip(hit, cast, on_good, strict=True)]
        share = min(0.999, max(0.001, (good_sum + 0.8 * PRIOR) / (total + PRIOR)))
        model = VoteModel(share, tuple(on_good), tuple(on_bad))
    return model


def _judged(featured: DataFrame, model: VoteModel) -> DataFrame:
    q = F.col("_q")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT * q["n_words"])
    return featured.withColumn("_p", model.column(F.col("_votes"))).withColumn("_failed", failed).withColumn(
        "_kept", ~F.col("_failed") & (F.col("_p") >= THRESHOLD)
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` with its counts, ``base_failed``, the posterior
    ``quality`` and ``kept``.

    Defined cases: null, empty and blank texts have no words and fail. doc_id may be null or repeated;
    rows are judged one by one. No rows give no rows. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    features = with_features(docs.select("doc_id", "text")).select("doc_id", "_q", votes().alias("_votes"))
    features = scratch.write(features, "features")
    model = fit(features.groupBy("_votes").agg(F.count("*").alias("_n")))
    return _judged(features, model).select(
        "doc_id",
        *[F.col("_q")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_p").alias("quality"),
        F.col("_votes").alias("votes"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that `verdicts` keeps, with their columns as they are. The counts are made
    twice, once for the model and once to filter, so that no text is shuffled."""
    featured = with_features(docs.select(F.struct("*").alias("row"), "text")).withColumn("_votes", votes())
    model = fit(featured.groupBy("_votes").agg(F.count("*").alias("_n")))
    return _judged(featured, model).where("_kept").select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
