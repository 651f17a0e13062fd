"""Scores of segments: rule score, thresholds, summary and histogram.

The rule score is counted in tenths, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut, word_count

# The rules, in tenths, and their names in order.
BASE, LOW_CONFIDENCE, GOOD_LENGTH, TOO_SHORT, QUESTION = 5, -1, 2, -2, 1
REASONS = ("good length", "too short", "engaging questions", "low confidence")
LOW_BELOW = 0.7
SKIPPED_SCORE, FAILED_SCORE = 0.75, 0.5
EDGES = ("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")
# End of the fixed values.


def rule_score(rows: DataFrame, text: str = "text", confidence: str = "confidence") -> DataFrame:
    """With n_words, score_tenths and reasons: length, questions, confidence. A null text has no words, a null confidence isn't low."""
    words = word_count(F.coalesce(F.col(text), F.lit("")))
    flags: list[tuple[Column, int]] = [
        (words >= 10, GOOD_LENGTH), (words < 5, TOO_SHORT), (F.contains(F.coalesce(F.col(text), F.lit("")), F.lit("?")), QUESTION),
        (F.coalesce(F.col(confidence) < LOW_BELOW, F.lit(False)), LOW_CONFIDENCE),
    ]
    score = F.lit(BASE)
    for flag, tenths in flags:
        score = score + F.when(flag, tenths).otherwise(0)
    named = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for (flag, _), name in zip(flags, REASONS)]))
    return rows.withColumn("n_words", words).withColumn("score_tenths", score).withColumn("reasons", F.array_join(named, ", "))


def score_bin(score: Column) -> Column:
    """Bin 0 to 4 of a score from 0 to 1; a score on an edge goes up, 1 to the last."""
    return F.least(F.floor(F.round(score * 1000) / 200), F.lit(4)).cast("int")


def histogram(rows: DataFrame, group: list[str], score: str = "value_score") -> DataFrame:
    """group, bin, n: all five bins of every group that has a score."""
    good = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("b", score_bin(F.col(score)))
    counts = good.groupBy(*group).agg(*[F.count_if(F.col("b") == i).alias(str(i)) for i in range(5)])
    bins = F.explode(F.array(*[F.struct(F.lit(e).alias("bin"), F.col(str(i)).alias("n")) for i, e in enumerate(EDGES)]))
    return counts.select(*group, bins.alias("x")).select(*group, "x.bin", "x.n")


def high_value(rows: DataFrame, threshold: float = 0.5, score: str = "value_score") -> DataFrame:
    """Rows of at least the threshold; null and NaN scores are below any."""
    return rows.where((F.col(score) >= threshold) & ~F.isnan(score))


def summary(rows: DataFrame, group: list[str], threshold: float = 0.5, score: str = "value_score", min_duration_s: float | None = None) -> DataFrame:
    """group, total, high, success_permille, avg_milli, min_milli, max_milli: scores in thousandths, so sums are exact."""
    if min_duration_s is not None:
        rows = rows.where(F.col("duration") >= min_duration_s)
    m = F.when(F.col(score).isNotNull() & ~F.isnan(score), F.round(F.col(score) * 1000).cast("bigint"))
    return rows.withColumn("__m", m).groupBy(*group).agg(
        F.count("*").alias("total"), F.count_if(F.col("__m") >= round(threshold * 1000)).alias("high"),
        F.floor(F.count_if(F.col("__m") >= round(threshold * 1000)) * 1000 / F.count("*")).alias("success_permille"),
        F.floor(F.sum("__m") / F.count("__m")).alias("avg_milli"), F.min("__m").alias("min_milli"), F.max("__m").alias("max_milli"),
    )


def means(rows: DataFrame, group: list[str], duration: str = "duration", confidence: str = "confidence") -> DataFrame:
    """group, n, mean_duration_cs, mean_confidence_milli: means over the values there are, as whole hundredths and thousandths, so sums are exact; null where a group has none."""
    whole = lambda c, n: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.round(F.col(c) * n).cast("bigint"))
    mean = lambda c, n: F.floor(F.sum(whole(c, n)) / F.count(whole(c, n))).cast("bigint")
    return rows.groupBy(*group).agg(F.count("*").alias("n"), mean(duration, 100).alias("mean_duration_cs"), mean(confidence, 1000).alias("mean_confidence_milli"))


def with_fallback(score: Column, reasoning: Column) -> Column:
    """The score, or where there is none the constant that stands for why: evaluation skipped, or failed."""
    skipped = F.contains(F.lower(F.coalesce(reasoning, F.lit(""))), F.lit("skipped"))
    return F.when(score.isNotNull() & ~F.isnan(score), score).when(skipped, F.lit(SKIPPED_SCORE)).otherwise(F.lit(FAILED_SCORE))


def top_report(rows: DataFrame, ties: list[str], n: int = 10, threshold: float = 0.5, score: str = "value_score", text: str = "text") -> DataFrame:
    """The n best of the high-value rows, with the text cut for display. A sorted limit: each task keeps n rows."""
    return high_value(rows, threshold, score).orderBy(F.desc(score), *ties).limit(n).withColumn(text, cut(F.col(text), 100, "..."))
