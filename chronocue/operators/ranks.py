"""The best rows of every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_rows(rows: DataFrame, group: list[str], score: str, ties: list[str], n: int = 3, rank: str = "rank_no") -> DataFrame:
    """The n rows of highest score of every group, ties to the smaller tie keys in turn, with their rank from 1.

    Rows with a null in a group column or with a null or NaN score are left
    out. The limit is applied in each task before the shuffle, so a hot group
    costs n rows a task.
    """
    kept = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    for g in group:
        kept = kept.where(F.col(g).isNotNull())
    order = Window.partitionBy(*group).orderBy(F.desc(score), *[F.asc(t) for t in ties])
    return kept.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)
