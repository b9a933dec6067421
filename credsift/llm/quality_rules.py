"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Base rules fail very short and very repetitive texts. Each further rule rejects a text whose
signal exceeds a cutoff. The cutoffs are chosen per stratum (language) from labelled texts of good
quality: a rule's cutoffs are tried from the mildest to the strictest, and a cutoff is accepted
while the exact binomial (Clopper-Pearson) upper bound on the share of good texts it rejects stays
within the rule's part of ``LIMIT``. Trying in a fixed order and stopping at the first failure
needs no correction over cutoffs; over rules and strata the confidence is divided (Bonferroni). So
with probability ``1 - RISK`` at least, no stratum loses more than ``LIMIT`` of its good texts.
A stratum with too few labels to prove anything keeps all that passes the base rules.

The labels are never sampled: violations are counted by one grouped sum over all labelled texts.

Defined results: NULL and blank texts have no words and fail; repeated rows are judged alike; a
NULL language is a stratum of its own; rows without a doc_id have no label; conflicting labels
count as bad, NULL labels not at all; an empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.llm.text_stats import FIELDS, stats_of
from credsift.session import cut

LIMIT = 0.02
RISK = 0.05
LEAST_WORDS = 50
# Percent of words in repeated windows from which a text fails.
REPEATED_PERCENT = 50

# Rule -> cutoffs from the mildest to the strictest.
CUTOFFS = {
    "symbols": (2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05),
    "dup_lines": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeats": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "sameness": (0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6),
    "capitals": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}


def signals() -> dict[str, Column]:
    """The rules' signals, higher for worse texts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "sameness": 1 - F.col("n_distinct") / words,
        "capitals": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, summed downwards from k until terms no longer count."""
    if k >= n:
        return 1.0
    if k >= n * p:  # no bound of use from the median on
        return 1.0
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    total, j = 0.0, k
    while j >= 0 and term > total * 1e-17:
        total += term
        term *= j / (n - j + 1) * (1 - p) / p
        j -= 1
    return total


def certified(rejected: int, good: int, limit: float, risk: float) -> bool:
    """Whether the Clopper-Pearson upper bound at confidence 1 - risk is at most ``limit``."""
    return good > 0 and binomial_tail(rejected, good, limit) <= risk


def choose(counts: dict[str, list[int]], good: int, strata: int) -> dict[str, float | None]:
    """The strictest certified cutoff of each rule, None if even the mildest one is not."""
    chosen: dict[str, float | None] = {}
    for rule, cutoffs in CUTOFFS.items():
        chosen[rule] = None
        for cutoff, rejected in zip(cutoffs, counts[rule], strict=True):
            risk = RISK / (len(CUTOFFS) * strata)
            if not certified(rejected, good, LIMIT / len(CUTOFFS), risk):
                break
            chosen[rule] = cutoff
    return chosen


def good_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids that all their labels call good."""
    return (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_q"))
        .filter("_q > 0")
        .select("doc_id")
    )


def thresholds(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, rule columns): the cutoffs of every stratum that has good labelled texts.

    Rows of one doc_id, and copies of one text, are one trial each, rejected if any row is.
    """
    of = signals()
    good = stats.filter(~base_failed()).join(good_ids(labels), "doc_id", "left_semi")
    trials = good.select("stratum", "doc_id", "copy_of", *(of[r].alias(r) for r in CUTOFFS))
    worst = [F.max(r).alias(r) for r in CUTOFFS]
    trials = trials.groupBy("stratum", "doc_id").agg(F.min("copy_of").alias("copy_of"), *worst)
    trials = trials.groupBy("stratum", "copy_of").agg(*worst)
    counts = cut(
        trials.groupBy("stratum").agg(
            F.count("*").alias("good"),
            *(
                F.array(*(F.sum((F.col(r) > c).cast("long")) for c in cutoffs)).alias(r)
                for r, cutoffs in CUTOFFS.items()
            ),
        ),
        "rules-counts",
    )
    strata = max(counts.count(), 1)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                choose({r: list(row[r]) for r in CUTOFFS}, int(row["good"]), strata)
                for row in batch.to_dict("records")
            ]
            out = pd.DataFrame(rows, columns=list(CUTOFFS)).astype("float64")
            out.insert(0, "stratum", batch["stratum"].to_numpy())
            yield out

    schema = "stratum string, " + ", ".join(f"{rule} double" for rule in CUTOFFS)
    return counts.mapInPandas(pick, schema)


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    stats = cut(
        docs.select(
            "doc_id",
            F.col(stratum).alias("stratum"),
            F.xxhash64("text").alias("copy_of"),
            stats_of(F.col("text")).alias("s"),
        ).select("doc_id", "stratum", "copy_of", "s.*"),
        "rules-stats",
    )
    limits = cut(
        thresholds(stats, labels).withColumnsRenamed(
            {"stratum": "_of", **{rule: f"_{rule}" for rule in CUTOFFS}}
        ),
        "rules-limits",
    )
    broken = F.lit(False)
    for rule, signal in signals().items():
        # pandas hands a missing cutoff over as NaN, above which nothing is
        broken = broken | F.coalesce(signal > F.col(f"_{rule}"), F.lit(False))
    return stats.join(limits, F.col("stratum").eqNullSafe(F.col("_of")), "left").select(
        "doc_id", *FIELDS, base_failed().alias("base_failed"), (~base_failed() & ~broken).alias("kept")
    )


def rules_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )
