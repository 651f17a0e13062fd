"""The N highest-scoring items of every group.

A histogram of the scores of each group, combined before it is shuffled, gives
the lowest bin above which at least N items lie; rows under it are dropped
before anything is sorted. What is left is ranked exactly by score and tie
keys; the rank's limit is applied in each task before the shuffle, so a group
of equal scores costs N rows a task. Rows meet their group's threshold spread
over salts, so a group that holds a third of all rows is never in one task.

Defined results: rows with a null in a group column or with a null or NaN
score are left out, an infinite score is a score, repeated rows count each,
ties go to the smaller tie keys in turn, null keys first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts over which a group's rows are spread where they meet its threshold.
SALTS = 16


def score_bin(score: Column, width: float) -> Column:
    """Order-preserving bin of a score; scores beyond any bin share the outermost."""
    return F.floor(F.greatest(F.least(score / F.lit(width), F.lit(9e15)), F.lit(-9e15))).cast("bigint")


def thresholds(rows: DataFrame, group: list[str], score: str, n: int, width: float) -> DataFrame:
    """group, least_bin: at least n rows of the group, or all, lie in it or above. One pre-aggregated shuffle."""
    bins = rows.groupBy(*group, score_bin(F.col(score), width).alias("__bin")).agg(F.count("*").alias("__n"))
    above = F.sum("__n").over(Window.partitionBy(*group).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1))
    return bins.withColumn("__above", F.coalesce(above, F.lit(0))).where(F.col("__above") < n).groupBy(*group).agg(F.min("__bin").alias("__least_bin"))


def salt_of(*keys: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"), F.lit(0))


def top_n(rows: DataFrame, group: list[str], score: str, ties: list[str], n: int = 3, width: float = 1 / 64, rank: str = "rank_no", salt: str | None = None) -> DataFrame:
    """The n rows of highest score of every group with their rank from 1.

    Scores below the threshold can't be among the n; no row at or above it is
    dropped. ``salt`` names a column that spreads the rows already.
    """
    kept = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    for g in group:
        kept = kept.where(F.col(g).isNotNull())
    kept = kept.withColumn("__salt", F.col(salt) if salt else salt_of(*ties))
    least = thresholds(kept, group, score, n, width).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    survivors = kept.join(least, [*group, "__salt"]).where(score_bin(F.col(score), width) >= F.col("__least_bin")).drop("__least_bin", "__salt")
    order = Window.partitionBy(*group).orderBy(F.desc(score), *[F.asc(t) for t in ties])
    return survivors.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def best_of_array(scores: Column, n: int) -> Column:
    """Of an array of scores the n highest, as structs (score, seg_no), null and NaN scores left out; ties to the smaller place. Narrows a row before any shuffle."""
    numbered = F.filter(F.transform(scores, lambda x, i: F.struct(x.alias("score"), (-i).cast("bigint").alias("minus"))), lambda x: x["score"].isNotNull() & ~F.isnan(x["score"]))
    return F.transform(F.slice(F.sort_array(numbered, asc=False), 1, n), lambda x: F.struct(x["score"].alias("score"), (-x["minus"]).alias("seg_no")))


def best_segments(reports: DataFrame, n: int = 3, width: float = 1 / 64) -> DataFrame:
    """audio_path, rank_no, report_id, seg_no: the n evaluated segments of highest value_score of every audio path.

    Null paths, null and NaN scores and empty arrays are left out; a report
    delivered again counts once, those of a path without an id as one. Each
    report hands on its n best, as no other can be among the path's, so the
    histograms count reports and not deliveries. One shuffle by path and salt
    serves both the deliveries and the thresholds.
    """
    rows = reports.select(F.col("metadata.audio_path").alias("audio_path"), "report_id", F.explode(best_of_array(F.col("segments.evaluated.value_score"), n)).alias("x")).where("audio_path is not null")
    spread = rows.select("audio_path", "report_id", F.col("x.seg_no").alias("seg_no"), F.col("x.score").alias("score"), salt_of("report_id").alias("salt")).repartition("audio_path", "salt")
    once = spread.groupBy("audio_path", "salt", "report_id", "seg_no").agg(F.max("score").alias("score"))
    best = top_n(once, ["audio_path"], "score", ["report_id", "seg_no"], n, width, salt="salt")
    return best.select("audio_path", F.col("rank_no").cast("bigint").alias("rank_no"), "report_id", F.col("seg_no").cast("bigint").alias("seg_no"))
