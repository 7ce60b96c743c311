"""Quality by weak supervision: rules vote good, bad or abstain, and EM weighs them by their estimated accuracies.

All text measures are DataFrame expressions of one row, so no words are shuffled; words of repeated windows come from sorting the
windows' hashes within the row. Votes are counted by pattern (at most 3 to the power of the rules), EM runs on those
counts, and the posterior that a document is good is a sum of the rules' log odds.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are judged each; an empty table gives
no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

#: name -> (good when, bad when); neither: the rule abstains.
RULES = {
    "length": ("n_words >= 80", "n_words < 50"),
    "word_length": ("word_chars between 3 * n_words and 12 * n_words", "word_chars < 2.5 * n_words or word_chars > 16 * n_words"),
    "symbols": ("n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    "dup_lines": ("n_dup_lines <= 0.05 * n_lines", "n_dup_lines > 0.3 * n_lines"),
    "repeats": ("n_repeat_words <= 0.1 * n_words", "n_repeat_words > 0.3 * n_words"),
    "line_words": ("n_words >= 8 * n_lines", "n_words < 3 * n_lines"),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def repeat_words(words: str) -> Column:
    """Words that windows of three cover which the row holds twice or more; `words` names an array column."""
    w = F.col(words)
    windows = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(w) < 4, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.array_sort(F.slice(windows, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))))


def covered(windows: str) -> Column:
    """`windows` names an array of (h, i), sorted."""
    s = F.col(windows)
    twice = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
    return F.array_sort(F.filter(twice, lambda x: x.isNotNull()))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    full = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", words_of(F.col("text")).alias("words"), full.alias("lines"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    rows = rows.select("doc_id", "words", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeat_words("words").alias("windows"))
    rows = rows.select("doc_id", "words", "n_symbols", "n_lines", "n_dup_lines", covered("windows").alias("at"))
    at = F.col("at")
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.aggregate(F.transform(at, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - x), F.lit(3))), F.lit(0).cast("long"), lambda n, x: n + x).alias("n_repeat_words"),
    )


def em(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100, prior: float = 0.8, start: tuple[float, float] = (0.95, 0.5), weight: float = 20.0) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, accuracy of each rule) from vote patterns (1 good, -1 bad, 0 abstains) and their counts.

    A rule's accuracy is a pair: how often its vote is right on good documents, and on bad ones. Both start from
    `weight` pseudo-votes, and a rule stays better than chance, which keeps "good" and "bad" from changing places.
    """
    share, accuracy = prior, [start] * n_rules
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        right = [[a * weight for a in start] for _ in range(n_rules)]
        voted = [[weight, weight] for _ in range(n_rules)]
        good = prior * weight
        for votes, count in patterns:
            p = posterior(votes, share, accuracy)
            good += p * count
            for j, v in enumerate(votes):
                if v:
                    voted[j][0] += count * p
                    voted[j][1] += count * (1 - p)
                    right[j][v < 0] += count * (p if v > 0 else 1 - p)
        share = min(0.99, max(0.01, good / (total + weight)))
        accuracy = [bounded(r[0] / v[0], r[1] / v[1]) for r, v in zip(right, voted, strict=True)]
    return share, accuracy


def bounded(on_good: float, on_bad: float) -> tuple[float, float]:
    on_good = min(0.99, max(0.5, on_good))
    return on_good, min(0.99, max(1.05 - on_good, on_bad))


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def vote_odds(accuracy: tuple[float, float]) -> tuple[float, float]:
    """What a good vote and a bad vote add to the log odds of "good"."""
    on_good, on_bad = accuracy
    return math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)


def posterior(votes: tuple[int, ...], share: float, accuracy: list[tuple[float, float]]) -> float:
    odds = logit(share) + sum(vote_odds(a)[v < 0] for v, a in zip(votes, accuracy, strict=True) if v)
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, keep_from: float = 0.5) -> DataFrame:
    """The measures with `p_good` and each rule's vote."""
    votes = [F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0).alias(f"vote_{k}") for k, (good, bad) in rules.items()]
    voted = written(measures(docs).select("*", *votes), "quality")
    names = [f"vote_{k}" for k in rules]
    counts = voted.groupBy(*names).count().collect()
    share, accuracy = em(sorted((tuple(r[:-1]), r[-1]) for r in counts), len(names))
    odds = F.lit(logit(share))
    for name, a in zip(names, accuracy, strict=True):
        up, down = vote_odds(a)
        odds = odds + F.when(F.col(name) > 0, up).when(F.col(name) < 0, down).otherwise(0.0)
    return voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("good", F.col("p_good") >= keep_from)
