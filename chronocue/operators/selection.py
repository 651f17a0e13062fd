"""Validation of chosen time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import format_cs, parse_range, to_cs
from .sweep import joined, with_running_sum

MIN_PART_S, GRACE_S = 5, 10


def parts_of(selections: DataFrame, key: list[str], parts: str = "parts", empty: bool = False) -> DataFrame:
    """key, part_no (from 1), time_range, start, end: a selection's parts in order; bounds are null where they can't be read. With empty a selection without parts has one row of nulls."""
    rows = selections.select(*key, (F.posexplode_outer if empty else F.posexplode)(parts).alias("pos", "part"))
    # A generator of the one value, so a range is read once and not once for each bound.
    read = rows.select(*key, (F.col("pos") + 1).alias("part_no"), F.col("part.time_range").alias("time_range"), F.explode(F.array(parse_range(F.col("part.time_range")))).alias("r"))
    return read.select(*key, "part_no", "time_range", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def totals(parts: DataFrame, key: list[str]) -> DataFrame:
    """key, n_parts, readable, long_enough, total_s, total: whole seconds, cut not rounded, 0 if any part can't be read, and the total of those that can as a time code. A row without a part_no is a selection without parts."""
    length = F.col("end") - F.col("start")
    real = F.col("part_no").isNotNull()
    readable = F.bool_and(F.when(real, F.col("start").isNotNull() & F.col("end").isNotNull()))
    return parts.groupBy(*key).agg(
        F.count("part_no").alias("n_parts"), readable.alias("readable"), F.bool_and(F.when(real, F.coalesce(length >= MIN_PART_S, F.lit(False)))).alias("long_enough"),
        F.when(readable, F.floor(F.round(F.sum(length), 6))).otherwise(0).cast("bigint").alias("total_s"), format_cs(F.coalesce(F.sum(to_cs(length)), F.lit(0))).alias("total"),
    )


def validated(selections: DataFrame, key: list[str], min_s: int = 45, max_s: int = 70, parts: str = "parts") -> DataFrame:
    """key, n_parts, total_s, valid, in_range, reason of every selection, those without parts too.

    Valid: some parts, all readable and of five seconds or more, and a total
    from min_s to ten seconds over max_s. in_range is without that grace.
    """
    t = totals(parts_of(selections, key, parts, empty=True), key)
    total = F.col("total_s")
    reason = (
        F.when(F.col("n_parts") == 0, "no parts").when(~F.col("readable"), "unreadable part").when(~F.col("long_enough"), "part too short")
        .when(total < min_s, "total too short").when(total > max_s + GRACE_S, "total too long")
    )
    in_range = (F.col("n_parts") > 0) & F.coalesce(F.col("readable"), F.lit(False)) & total.between(min_s, max_s)
    return t.withColumn("reason", reason).select(*key, "n_parts", "total_s", F.col("reason").isNull().alias("valid"), in_range.alias("in_range"), "reason")


def first_valid(attempts: DataFrame, key: list[str], attempt: str = "attempt", most: int = 3) -> DataFrame:
    """key, chosen, fallback: the first valid attempt of at most ``most``, else the first of all as fallback."""
    a = attempts.where(F.col(attempt) <= most)
    good = F.min(F.when(F.col("valid"), F.col(attempt)))
    return a.groupBy(*key).agg(F.coalesce(good, F.min(attempt)).alias("chosen"), good.isNull().alias("fallback"))


def out_of_bounds(ranges: DataFrame, media: DataFrame, key: str, duration: str = "duration") -> DataFrame:
    """Ranges with ``known``, whether their medium's duration is, and ``out``: whether they start before 0 or end after their medium, null where that isn't known. media has a row a key."""
    m = media.select(key, F.col(duration).alias("__d")).where(F.col(key).isNotNull())
    return ranges.join(m, key, "left").select(*ranges.columns, F.col("__d").isNotNull().alias("known"), outside(F.col("start"), F.col("end"), F.col("__d")).alias("out"))


def outside(start: Column, end: Column, duration: Column) -> Column:
    """Whether a range starts before 0 or ends after the duration; null where a value that decides is missing."""
    return (start < 0) | (end > duration)


def cut_plan(parts: DataFrame, media: DataFrame, key: list[str], medium: str, duration: str = "duration") -> DataFrame:
    """The cuts of every selection in the order given: key, part_no, start, end, at_s (where the part begins in what is made), total_s, ok, all_ok.

    A part is ok if it can be read and lies within its medium, whose duration
    has to be known; a selection can be cut only if all its parts are ok.
    parts: key, part_no, start, end, with ``medium`` among the key.
    """
    m = media.select(F.col(medium).alias("__m"), F.col(duration).alias("__d")).where("__m is not null")
    r = parts.join(m, F.col(medium) == F.col("__m"), "left")
    ok = F.coalesce(~outside(F.col("start"), F.col("end"), F.col("__d")) & F.col("start").isNotNull() & F.col("end").isNotNull() & ~F.isnan("__d"), F.lit(False))
    # Lengths are added as whole hundredths. A selection is a list of parts, small by what it is.
    length, whole = F.coalesce(to_cs(F.col("end")) - to_cs(F.col("start")), F.lit(0)), Window.partitionBy(*key)
    before = whole.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("ok", ok).withColumn("__n", length)
    return r.select(
        *key, "part_no", "start", "end", (F.coalesce(F.sum("__n").over(before), F.lit(0)) / 100).alias("at_s"), (F.sum("__n").over(whole) / 100).alias("total_s"), "ok", F.min("ok").over(whole).alias("all_ok"),
    )


def first_suggestion(suggestions: DataFrame, key: str, order: str) -> DataFrame:
    """The first suggestion of each text."""
    w = Window.partitionBy(key).orderBy(order)
    return suggestions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def clustered(ranges: DataFrame, key: list[str], start: str = "start_cs", end: str = "end_cs", within_cs: int = 1000, slab: float = 60_000) -> DataFrame:
    """Ranges with ``cluster``, from 1: a range starts a new one where it begins more than within_cs after all before it have ended."""
    # The latest end so far, by slab: within it by a window, before it from one row a slab.
    r = ranges.where(F.col(start).isNotNull()).withColumn("__slab", F.floor(F.col(start) / slab)).withColumn("__e", F.greatest(start, end)).withColumn("__id", F.xxhash64(*ranges.columns))
    w = Window.partitionBy(*key, "__slab").orderBy(start, "__e", "__id").rowsBetween(Window.unboundedPreceding, -1)
    reach = r.groupBy(*key, "__slab").agg(F.max("__e").alias("m"))
    reach = reach.select(*key, "__slab", F.max("m").over(Window.partitionBy(*key).orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    o = joined(r, reach, [*key, "__slab"]).withColumn("__ended", F.greatest(F.max("__e").over(w), "__carry"))
    o = o.withColumn("__new", F.coalesce((F.col(start) - F.col("__ended") > within_cs).cast("int"), F.lit(1)))
    return with_running_sum(o, key, [start, "__e", "__id"], F.col("__new"), slab, "cluster").select(*ranges.columns, "cluster")
