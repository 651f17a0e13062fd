"""Topics across texts and along a sequence of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import best_rows
from .sweep import with_previous, with_running_sum


def common(rows: DataFrame, key: str, topic: str, least: int = 2) -> DataFrame:
    """topic, n: topics that at least ``least`` keys share. Counted without pairing keys."""
    return rows.where(F.col(topic).isNotNull()).select(key, topic).distinct().groupBy(topic).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cooccurring(rows: DataFrame, key: str, topics: str, least: int = 2) -> DataFrame:
    """topic_a, topic_b, n: pairs of topics that at least ``least`` rows hold together. Pairs are made within a row's own list, no join."""
    t = F.array_sort(F.array_distinct(F.col(topics)))
    pairs = F.flatten(F.transform(t, lambda a, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda b: F.struct(a.alias("topic_a"), b.alias("topic_b")))))
    return rows.select(key, F.explode(pairs).alias("x")).groupBy("x.topic_a", "x.topic_b").agg(F.count_distinct(key).alias("n")).where(F.col("n") >= least)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def drift(rows: DataFrame, group: list[str], order: list[str], vector: str, width: float = 1000) -> DataFrame:
    """With similarity: cosine with the vector before, null at a group's first. width is of the first ordering number."""
    r = with_previous(rows, group, order, [vector], width)
    return r.withColumn("similarity", cosine(F.col(f"prev_{vector}"), F.col(vector))).drop(f"prev_{vector}")


def chapters(rows: DataFrame, group: list[str], order: list[str], vector: str, below: float = 0.0, width: float = 1000) -> DataFrame:
    """With chapter, from 1: a new one begins where the similarity to the row before falls under ``below``."""
    d = drift(rows, group, order, vector, width)
    n = with_running_sum(d, group, order, F.coalesce((F.col("similarity") < below).cast("bigint"), F.lit(0).cast("bigint")), width, "chapter")
    return n.withColumn("chapter", F.col("chapter") + 1)


def best_per_source(rows: DataFrame, item: list[str], source: str, score: str, n: int, *ties: str) -> DataFrame:
    """The n best answers of every source for each item."""
    return best_rows(rows, [*item, source], score, list(ties), n)


def voted(rows: DataFrame, item: list[str], answer: str) -> DataFrame:
    """item, answer, votes: the answer most sources gave, ties to the smallest."""
    n = rows.where(F.col(answer).isNotNull()).groupBy(*item, answer).agg(F.count("*").alias("votes"))
    return n.groupBy(*item).agg(F.min(F.struct((-F.col("votes")).alias("m"), F.col(answer).alias("a"))).alias("x")).select(*item, F.col("x.a").alias(answer), (-F.col("x.m")).alias("votes"))
