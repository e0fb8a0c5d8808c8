"""Quality rules as weak supervision.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counts of
the vote patterns estimates each rule's accuracy and the share of good documents; a document
stays when its posterior probability of being good is at least `threshold`.

The patterns number at most 3 ** len(RULES), whatever the corpus; only their counts reach
the driver. Sums run over integers or over patterns in a fixed order, so reruns agree.

Null texts count as empty and, with fewer than ten words, fail the base rules. Repeated rows
get equal verdicts. An empty table gives an empty result. Further columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.llm.text import many, saved, settled, whole, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
ROUNDS = 25
START_ACCURACY = 0.8
START_GOOD = 0.5
BOUNDS = (0.55, 0.99)

# rule: (votes good when, votes bad when); conditions over the base columns, as SQL
RULES = {
    "symbols": (None, "n_symbols * 100 > 20 * n_words"),
    "shouting": (None, "n_upper * 100 > 45 * word_chars"),
    "exclaiming": (None, "n_exclaim * 100 > 20 * n_words"),
    "repeating": (None, "n_repeat_words * 100 > 15 * n_words"),
    "monotony": (None, "n_words >= 20 AND n_distinct * 100 < 50 * n_windows"),
    "repeated_lines": (None, "n_dup_lines >= 3 AND n_dup_lines * 100 > 30 * n_lines"),
    "word_length": (None, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "clean_words": (
        "n_symbols * 100 <= 10 * n_words AND n_exclaim * 100 <= 10 * n_words",
        "n_symbols * 100 > 35 * n_words OR n_exclaim * 100 > 35 * n_words",
    ),
    "sentences": (
        "n_upper * 100 <= 30 * word_chars AND n_symbols * 100 <= 10 * n_words",
        "n_upper * 100 > 60 * word_chars OR n_symbols * 100 > 45 * n_words",
    ),
    "varied": (
        "n_distinct * 100 >= 90 * n_windows AND n_repeat_words * 100 <= 5 * n_words"
        " AND n_symbols * 100 <= 10 * n_words AND n_upper * 100 <= 45 * word_chars",
        "n_distinct * 100 < 30 * n_windows",
    ),
}


def base_columns(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key column and the counts that the rules look at, one row per document, without a shuffle."""
    d = docs.select(key, whole().alias("t"))
    d = d.select(key, "t", words(F.col("t")).alias("w"), F.split("t", "\n").alias("lines"))
    lines = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        key,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        many(F.col("t"), SYMBOLS).alias("n_symbols"),
        many(F.col("t"), "!").alias("n_exclaim"),
        many(F.col("t"), r"\p{Lu}").alias("n_upper"),
        lines.alias("lines"),
        F.transform(
            "w", lambda x, i: F.xxhash64(x, *[F.get("w", i + k) for k in range(1, WINDOW)])
        ).alias("h"),
    )
    d = d.withColumn("h", F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))))
    d = d.withColumns(
        {
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_windows": F.size("h").cast("long"),
            "n_distinct": F.size(F.array_distinct("h")).cast("long"),
        }
    ).drop("lines")
    return _repeats(d)


def _repeats(d: DataFrame) -> DataFrame:
    """n_repeat_words from the window hashes h: places of windows met twice, then what they cover.

    Sorting the places by hash is done only in texts where some window comes back.
    """
    d = d.withColumn(
        "s",
        F.when(
            F.col("n_distinct") < F.col("n_windows"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    ).drop("h")
    again = F.transform(
        "s",
        lambda x, j: F.when(
            (F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"]), x["i"]
        ),
    )
    d = d.withColumn("p", F.sort_array(F.filter(again, lambda x: x.isNotNull()))).drop("s")
    reach = F.transform(
        "p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW)))
    )
    total = F.aggregate(reach, F.lit(0), lambda a, x: a + x).cast("long")
    return settled(d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("p"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vote(rule: str) -> Column:
    good, bad = RULES[rule]
    out = F.when(F.expr(bad), -1)
    return (out.when(F.expr(good), 1) if good else out).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[float]]:
    """(share of good documents, accuracy of each rule) from vote patterns and their counts."""
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    good, accuracy = START_GOOD, [START_ACCURACY] * len(RULES)
    for _ in range(ROUNDS if total else 0):
        p = [posterior(v, good, accuracy) for v, _ in patterns]
        good = min(max(sum(n * q for (_, n), q in zip(patterns, p, strict=True)) / total, 0.05), 0.95)
        for j in range(len(RULES)):
            voted = sum(n for v, n in patterns if v[j])
            if voted:
                right = sum(
                    n * (q if v[j] > 0 else 1 - q) for (v, n), q in zip(patterns, p, strict=True) if v[j]
                )
                accuracy[j] = min(max(right / voted, BOUNDS[0]), BOUNDS[1])
    return good, accuracy


def posterior(votes: tuple[int, ...], good: float, accuracy: list[float]) -> float:
    """Probability of a good document; a rule that abstains says nothing."""
    odds = math.log(good / (1 - good)) + sum(
        v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True)
    )
    return 1 / (1 + math.exp(-odds))


def posterior_column(good: float, accuracy: list[float]) -> Column:
    odds = F.lit(math.log(good / (1 - good)))
    for name, a in zip(RULES, accuracy, strict=True):
        odds = odds + F.col(f"v_{name}") * F.lit(math.log(a / (1 - a)))
    return F.round(1 / (1 + F.exp(-odds)), 6)


def voted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Base columns and votes."""
    d = base_columns(docs, key).withColumn("base_failed", base_failed())
    return d.withColumns({f"v_{r}": vote(r) for r in RULES})


def fit(d: DataFrame) -> tuple[float, list[float]]:
    """The estimate from voted documents; those that fail the base rules take no part."""
    names = [f"v_{r}" for r in RULES]
    counts = d.filter(~F.col("base_failed")).groupBy(*names).count().collect()  # <= 3 ** rules rows
    return estimate([(tuple(r[n] for n in names), r["count"]) for r in counts])


def judged(d: DataFrame, good: float, accuracy: list[float], threshold: float) -> DataFrame:
    d = d.withColumn("p_good", posterior_column(good, accuracy))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def verdicts(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Base columns, base_failed, p_good and kept for every document."""
    d = saved(voted(docs))  # a few numbers a document, so that the texts are read once
    return judged(d, *fit(d), threshold)


def accepted(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept. The texts are read twice, to estimate and to judge; they
    are never shuffled or joined, so ids need not be unique."""
    model = fit(voted(docs))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return judged(voted(d, "row"), *model, threshold).filter("kept").select("row.*")
