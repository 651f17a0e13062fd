"""Overlapping, nested and gapped intervals per entity.

``IntervalMap`` is an ordered map of disjoint intervals: an insertion finds
what it overlaps or touches by binary search and merges it. ``merged`` keeps
one map per entity and slab of time, first over each input partition, which
shrinks what is shuffled, then over each (entity, slab) group; slabs are put
together again from one summary row each, so an entity that holds a third of
all rows is never in one task and an interval may span any number of slabs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLAB = 60_000
#: Intervals that a task holds before it hands on what it has merged.
HELD = 200_000


class IntervalMap:
    """Disjoint intervals in order. Intervals that touch belong together."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts: list[int] = list(starts or [])
        self.ends: list[int] = list(ends or [])

    def insert(self, a: int, b: int) -> int:
        """Add [a, b); returns by how many intervals the map grew, negative where it shrank."""
        i = bisect_left(self.ends, a)
        j = bisect_right(self.starts, b, lo=i)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
            if j - i == 1:
                self.starts[i], self.ends[i] = a, b
                return 0
        self.starts[i:j] = [a]
        self.ends[i:j] = [b]
        return 1 - (j - i)

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))

    def __len__(self) -> int:
        return len(self.starts)


def whole_cs(seconds: str) -> Column:
    """Seconds rounded to whole hundredths; null where missing, not a number or beyond a BIGINT of them."""
    c = F.col(seconds).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < 9e15), F.round(c * 100).cast("bigint"))


def clean(rows: DataFrame, entity: str, start: str, end: str, slab: int = SLAB) -> DataFrame:
    """entity, slab, a, b in hundredths, without rows that lack an entity or a bound or end at or before their start."""
    return (
        rows.select(F.col(entity).alias("entity"), whole_cs(start).alias("a"), whole_cs(end).alias("b"))
        .where("entity is not null and a is not null and b is not null and b > a")
        .withColumn("slab", F.expr(f"a div {slab} - if(a < 0 and a % {slab} != 0, 1, 0)"))
        .select("entity", "slab", "a", "b")
    )


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge within each (entity, slab), in bounded memory, whatever the order of the rows."""
    maps: dict[tuple, IntervalMap] = {}
    held = 0

    def handed_on() -> pd.DataFrame:
        rows = [(*k, a, b) for k, m in maps.items() for a, b in m.periods()]
        maps.clear()
        return pd.DataFrame(rows, columns=["entity", "slab", "a", "b"])

    for p in batches:
        for e, s, a, b in zip(p["entity"].tolist(), p["slab"].tolist(), p["a"].tolist(), p["b"].tolist()):
            m = maps.get((e, s))
            if m is None:
                m = maps[e, s] = IntervalMap()
            held += m.insert(a, b)
        if held > HELD:
            yield handed_on()
            held = 0
    if maps:
        yield handed_on()


def _merge_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge rows that come (entity, slab) by (entity, slab), one keyed map at a time: its periods with the end of the one before each, so its gaps, and whether it is the last."""
    key, m = None, IntervalMap()

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["entity", "slab", "a", "b", "ended", "last"])
        return out.astype({"ended": "Int64"})

    def rows_of() -> list[tuple]:
        n = len(m)
        return [(*key, a, b, m.ends[i - 1] if i else None, i == n - 1) for i, (a, b) in enumerate(m.periods())]

    for p in batches:
        out = []
        for e, s, a, b in zip(p["entity"].tolist(), p["slab"].tolist(), p["a"].tolist(), p["b"].tolist()):
            if (e, s) != key:
                out += rows_of() if key is not None else []
                key, m = (e, s), IntervalMap()
            m.insert(a, b)
        if out:
            yield table(out)
    if key is not None:
        yield table(rows_of())


def merged(rows: DataFrame, entity: str, start: str, end: str, slab: int = SLAB) -> DataFrame:
    """Periods and gaps of every entity: entity, kind ('period' or 'gap'), from_cs, to_cs.

    start and end are in seconds. Rows without an entity, with a bound missing
    or not a number, or with an end not after the start are left out; repeated
    rows change nothing; an empty table gives an empty result; other columns
    aren't read.
    """
    kind = dict(rows.dtypes)[entity]
    schema = f"entity {kind}, slab bigint, a bigint, b bigint"
    islands = (
        clean(rows, entity, start, end, slab).mapInPandas(_combine, schema)
        .repartition("entity", "slab").sortWithinPartitions("entity", "slab", "a").mapInPandas(_merge_sorted, schema + ", ended bigint, last boolean")
    )
    slabs = Window.partitionBy("entity").orderBy("slab")
    reach = islands.groupBy("entity", "slab").agg(F.max("b").alias("most"))
    reach = reach.select("entity", "slab", F.max("most").over(slabs.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("most").over(Window.partitionBy("entity")).alias("all_most"))
    marked = (
        islands.join(reach, ["entity", "slab"])
        .withColumn("opens", F.col("carry").isNull() | (F.col("a") > F.col("carry")))
        .withColumn("before", F.greatest("carry", "ended"))
    )
    opening = marked.where("opens")
    # The last period that opens in a slab ends where the next slab with an opening says.
    ends = (
        opening.groupBy("entity", "slab").agg(F.max("a").alias("a"), F.min_by("before", "a").alias("before"), F.first("all_most").alias("all_most"))
        .select("entity", F.lit("period").alias("kind"), F.col("a").alias("from_cs"), F.coalesce(F.lead("before").over(slabs), "all_most").alias("to_cs"))
    )
    # The others end where they end, and each opening but an entity's first closes a gap.
    period = F.struct(F.lit("period").alias("kind"), F.col("a").alias("from_cs"), F.col("b").alias("to_cs"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("before").alias("from_cs"), F.col("a").alias("to_cs"))
    rest = opening.select("entity", F.explode(F.array_compact(F.array(F.when(~F.col("last"), period), F.when(F.col("before").isNotNull(), gap)))).alias("x")).select("entity", "x.*")
    return ends.unionByName(rest).withColumnRenamed("entity", entity)
