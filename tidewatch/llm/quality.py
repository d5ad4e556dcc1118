"""Quality by weak supervision, with DataFrame functions only.

Rules over a few measures of a text vote that it is good or bad, or abstain. Expectation-maximisation
over the counts of vote patterns (at most 3 to the number of rules, whatever the corpus) estimates how
often each rule votes bad on bad and on good texts and how many texts are good. The posterior
probability of a text's pattern decides, so that one failed rule is evidence and not a veto.

Measures are built-in expressions over whole texts and written once to the shared folder. Repeated
five-word windows are found inside the row by sorting the windows' hashes.

Defined cases: null or empty text has no words and fails the base rules; rows count as often as they
occur; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.text import materialised, prepare

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
ROUNDS = 15

#: name -> (votes bad if, votes good if), over the measures
RULES = {
    "symbols": ("n_symbols > 0.3 * n_words", None),
    "shouting": ("n_exclaims > 0.5 * n_words", None),
    "capitals": ("n_capitals > 0.3 * word_chars", None),
    "word_length": ("word_chars > 9 * n_words or word_chars < 3 * n_words", "word_chars between 3.5 * n_words and 7.5 * n_words"),
    "variety": ("n_words >= 30 and n_distinct < 0.25 * n_words", "n_words >= 30 and n_distinct > 0.45 * n_words"),
    "repeats": ("n_repeat_words > 0.2 * n_words", None),
    "short_words": ("n_words >= 20 and n_short < 0.08 * n_words", "n_words >= 20 and n_short > 0.15 * n_words"),
    "lines": ("n_dup_lines > 0.5 * n_lines", None),
    "length": ("n_words < 5", "n_words >= 40"),
}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    def places(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]))
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
                           F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = _bound(_bound(pairs, places), total)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)


def measures(docs: DataFrame) -> DataFrame:
    """The counts the rules look at, one row a document."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
                       F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.trim(x, F.lit(BLANK))) > 0).alias("lines"))
    words = F.col("words")
    five = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    rows = rows.select(
        "doc_id", "text", "words", "lines", F.slice(five, F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(0))).alias("windows"))
    size, length = lambda c: F.size(c).cast("long"), F.char_length("text")
    return rows.select(
        "doc_id", size("words").alias("n_words"), _without(text, BLANK).cast("long").alias("word_chars"),
        (length - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"), size("lines").alias("n_lines"),
        (length - _without(text, "!")).alias("n_exclaims"), (length - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
        size(F.array_distinct("words")).alias("n_distinct"),
        size(F.filter("words", lambda w: (F.char_length(w) <= 3) & (F.upper(w) != F.lower(w)))).alias("n_short"))


def votes(measured: DataFrame) -> DataFrame:
    """-1 bad, 1 good, 0 abstains: one column a rule."""
    out = {}
    for name, (bad, good) in RULES.items():
        vote = F.when(F.expr(bad), -1)
        out[f"vote_{name}"] = (vote.when(F.expr(good), 1) if good else vote).otherwise(0).cast("int")
    return measured.withColumns(out)


def _log_odds(model: dict) -> Column:
    """Log odds that a text with these votes is good."""
    odds = F.log(F.lit(model["good"] / (1 - model["good"])))
    for name in RULES:
        on_bad, on_good = model[name]
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote == -1, F.log(F.lit(on_good / on_bad))).when(vote == 1, F.log(F.lit((1 - on_good) / (1 - on_bad)))).otherwise(0.0)
    return odds


def posterior(model: dict) -> Column:
    return 1 / (1 + F.exp(-_log_odds(model)))


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """Per rule (how often it votes bad on bad texts, on good texts), and the share of good texts.

    The share is among the rule's votes, or among all texts for a rule that never votes good.
    Starts from rules that are right more often than not; shares stay inside (0, 1), and a rule's
    share on bad texts above that on good ones, so that the classes can't change places.
    """
    model: dict = {"good": 0.8} | {name: (0.5, 0.03) for name in RULES}
    patterns = materialised(voted.groupBy(*[f"vote_{name}" for name in RULES]).agg(F.count("*").alias("n")), "vote-patterns")
    for _ in range(rounds):
        good = F.col("n") * F.col("p")
        bad = F.col("n") * (1 - F.col("p"))
        sums = [F.sum(good).alias("good"), F.sum("n").alias("n")]
        for name in RULES:
            vote = F.col(f"vote_{name}")
            for kind, share in (("good", good), ("bad", bad)):
                sums += [F.sum(F.when(vote == -1, share).otherwise(0.0)).alias(f"{name}_{kind}_down"),
                         F.sum(F.when((vote != 0) | F.lit(RULES[name][1] is None), share).otherwise(0.0)).alias(f"{name}_{kind}_all")]
        r = patterns.withColumn("p", posterior(model)).agg(*sums).first()
        if not r["n"]:
            break
        model = {"good": min(0.99, max(0.01, r["good"] / r["n"]))}
        for name in RULES:
            on_bad, on_good = ((r[f"{name}_{k}_down"] + a) / (r[f"{name}_{k}_all"] + 2.0) for k, a in (("bad", 1.0), ("good", 0.06)))
            on_good = min(0.9, max(0.001, on_good))
            model[name] = (min(0.999, max(on_bad, on_good * 1.05)), on_good)
    return model


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts, base_failed, the posterior `quality` and `kept` of every document."""
    prepare(docs.sparkSession)
    voted = votes(materialised(measures(docs), "quality-measures"))
    model = estimate(voted)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (voted.withColumn("base_failed", base_failed).withColumn("quality", posterior(model))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept"), "quality"))
