"""Ordered operations over long sequences, without one task for a whole sequence.

A window over a sequence that holds a third of all rows would be one task. Here
the sequence is cut into slabs of its ordering number; the window runs within
(key, slab), and what a slab needs of those before it comes from one summary
row a slab.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slab_of(at: str, width: float) -> Column:
    return F.floor(F.col(at) / F.lit(width)).cast("bigint")


def spread(rows: DataFrame, name: str, first: Column, last: Column, at_once: int = 10_000) -> DataFrame:
    """Rows once for each whole number from first to last, as ``name``; none where last is smaller. In two steps, so however far a bound lies off no row holds an array of more than about the square root of it or ``at_once``."""
    blocks = rows.withColumn("__first", first.cast("bigint")).withColumn("__last", last.cast("bigint")).where("__last >= __first")
    blocks = blocks.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__last") - F.col("__first")) / at_once))))
    own = F.col("__first") + F.col("__block") * at_once
    return blocks.withColumn(name, F.explode(F.sequence(own, F.least(own + (at_once - 1), "__last")))).drop("__first", "__last", "__block")


def joined(rows: DataFrame, slabs: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their slab's summary; nulls in a key or as ordering number are values of their own."""
    named = slabs.withColumnsRenamed({c: f"__s_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    return rows.join(named, same).drop(*[f"__s_{c}" for c in on])


def with_previous(rows: DataFrame, key: list[str], order: list[str], columns: list[str], width: float, prefix: str = "prev_") -> DataFrame:
    """Rows with the values of ``columns`` in the row before, in the order of ``order``, whose first is the number the slabs are cut of."""
    r = rows.withColumn("__slab", slab_of(order[0], width))
    w = Window.partitionBy(*key, "__slab").orderBy(*order)
    what = F.struct(*columns)
    last = r.groupBy(*key, "__slab").agg(F.max_by(what, F.struct(*order)).alias("__last"))
    carried = last.select(*key, "__slab", F.lag("__last").over(Window.partitionBy(*key).orderBy("__slab")).alias("__carry"))
    both = joined(r, carried, [*key, "__slab"]).withColumn("__prev", F.coalesce(F.lag(what).over(w), "__carry"))
    return both.select(*rows.columns, *[F.col(f"__prev.{c}").alias(prefix + c) for c in columns])


def with_running_sum(rows: DataFrame, key: list[str], order: list[str], value: Column, width: float, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over the sequence up to and with each."""
    r = rows.withColumn("__slab", slab_of(order[0], width)).withColumn("__v", value)
    w = Window.partitionBy(*key, "__slab").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = r.groupBy(*key, "__slab").agg(F.sum("__v").alias("__s"))
    before = sums.select(*key, "__slab", F.coalesce(F.sum("__s").over(Window.partitionBy(*key).orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return joined(r, before, [*key, "__slab"]).select(*rows.columns, (F.col("__before") + F.sum("__v").over(w)).alias(name))
