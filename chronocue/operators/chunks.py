"""Segments in fixed chunks of media time.

Segments are rows video_id, seg_index, start_cs, end_cs, text. A segment
belongs whole to the chunk in which it starts. The chunk number is an equi
key, so nothing here is a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_rtl, word_count
from ..functions.timecode import chunk_of, chunk_start_cs, to_cs
from .sweep import spread


def segments(rows: DataFrame, start: str = "start_time", end: str = "end_time", measures: bool = False) -> DataFrame:
    """Segments once each, in hundredths: rows without a video, number or start are left out, of repeated deliveries the smallest row_id counts.

    With measures also n_chars and n_words of the text, taken before the
    deliveries are made one, so what only counts doesn't shuffle texts.
    """
    picked = rows.select("row_id", "video_id", "seg_index", to_cs(F.col(start)).alias("start_cs"), to_cs(F.col(end)).alias("end_cs"), clean_rtl(F.col("text")).alias("text"))
    picked = picked.where("video_id is not null and seg_index is not null and start_cs is not null")
    columns = ["start_cs", "end_cs", "text"]
    if measures:
        said = F.coalesce("text", F.lit(""))
        picked = picked.withColumn("n_chars", F.length(said)).withColumn("n_words", word_count(said))
        columns += ["n_chars", "n_words"]
    # One aggregate a column, so columns that aren't asked for are neither aggregated nor read.
    # A delivery without a row_id comes after those with one.
    order = F.coalesce("row_id", F.lit((1 << 63) - 1))
    return picked.groupBy("video_id", "seg_index").agg(*[F.min_by(c, order).alias(c) for c in columns])


def chars(rows: DataFrame) -> Column:
    """Characters of a segment's text, measured already or not."""
    return F.col("n_chars") if "n_chars" in rows.columns else F.length(F.coalesce("text", F.lit("")))


def words(rows: DataFrame) -> Column:
    """Words of a segment's text, measured already or not."""
    return F.col("n_words") if "n_words" in rows.columns else word_count(F.coalesce("text", F.lit("")))


def assigned(segs: DataFrame, chunk_s: int = 120) -> DataFrame:
    """Segments with chunk_num and their times relative to the chunk's start."""
    c = segs.withColumn("chunk_num", chunk_of(F.col("start_cs"), chunk_s))
    off = chunk_start_cs(F.col("chunk_num"), chunk_s)
    return c.withColumn("rel_start_cs", F.col("start_cs") - off).withColumn("rel_end_cs", F.col("end_cs") - off)


def rebased(chunked: DataFrame, chunk_s: int = 120) -> DataFrame:
    """Absolute times again from chunk and relative times."""
    off = chunk_start_cs(F.col("chunk_num"), chunk_s)
    return chunked.withColumn("start_cs", F.col("rel_start_cs") + off).withColumn("end_cs", F.col("rel_end_cs") + off)


def rollup(chunked: DataFrame) -> DataFrame:
    """Per video and chunk: n_segments, spoken_cs, text_length, first and last start. Counts only, so map-side combined."""
    return chunked.groupBy("video_id", "chunk_num").agg(
        F.count("*").alias("n_segments"), F.sum(F.greatest(F.col("end_cs") - F.col("start_cs"), F.lit(0))).alias("spoken_cs"),
        F.sum(chars(chunked)).alias("text_length"), F.min("start_cs").alias("first_cs"), F.max("start_cs").alias("last_cs"),
    )


def ordered_text(parts: Column, *order: Column, sep: str = "") -> Column:
    """Texts of a group in the order given, null ones as empty."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.coalesce(parts, F.lit("")).alias("v")))), lambda x: x["v"]), sep)


def chunk_texts(chunked: DataFrame) -> DataFrame:
    """video_id, chunk_num, text: the segments of each chunk in order, without anything between. A group is one chunk of media."""
    return chunked.groupBy("video_id", "chunk_num").agg(ordered_text(F.col("text"), F.col("start_cs"), F.col("seg_index")).alias("text"))


def cumulative_length(chunked: DataFrame, sep: int = 2) -> DataFrame:
    """video_id, chunk_num, total_length of the text up to and with each chunk, ``sep`` characters after each."""
    w = Window.partitionBy("video_id").orderBy("chunk_num").rowsBetween(Window.unboundedPreceding, 0)
    sizes = chunked.groupBy("video_id", "chunk_num").agg(F.sum(chars(chunked)).alias("n"))
    return sizes.select("video_id", "chunk_num", F.sum(F.col("n") + sep).over(w).alias("total_length"))


def offsets(chunked: DataFrame, sep: int = 2) -> DataFrame:
    """Segments with text_offset: the place of their text in the video's whole text, ``sep`` characters after each chunk. Swept by chunk, so a long video isn't one task."""
    w = Window.partitionBy("video_id", "chunk_num").orderBy("start_cs", "seg_index").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("video_id").orderBy("chunk_num").rowsBetween(Window.unboundedPreceding, -1)
    n = chars(chunked)
    sizes = chunked.groupBy("video_id", "chunk_num").agg(F.sum(n).alias("n"))
    sizes = sizes.select("video_id", "chunk_num", F.coalesce(F.sum(F.col("n") + sep).over(before), F.lit(0)).alias("__at"))
    return chunked.join(sizes, ["video_id", "chunk_num"]).withColumn("text_offset", F.col("__at") + F.sum(n).over(w) - n).drop("__at")


def whole_text(texts: DataFrame) -> DataFrame:
    """video_id, text: the chunks' texts in order, an empty line after each. One ordered concatenation instead of every prefix, for media whose text fits one value; ``offsets`` is for any length."""
    return texts.groupBy("video_id").agg(F.concat(ordered_text(F.col("text"), F.col("chunk_num"), sep="\n\n"), F.lit("\n\n")).alias("text"))


def cumulative_text(texts: DataFrame) -> DataFrame:
    """video_id, chunk_num, so_far: every prefix of the video's text, quadratic in its length, for where each is wanted."""
    w = Window.partitionBy("video_id").orderBy("chunk_num").rowsBetween(Window.unboundedPreceding, 0)
    return texts.select("video_id", "chunk_num", F.concat(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), "\n\n"), F.lit("\n\n")).alias("so_far"))


def transcript(texts: DataFrame, sep: str = "\n\n") -> DataFrame:
    """video_id, part_no (from 1), chunk_num, part: the whole text of a video as ordered parts, each chunk's text with ``sep`` after it, so no video is ever one value. Put together in order they are ``whole_text``."""
    w = Window.partitionBy("video_id").orderBy("chunk_num")
    numbers = texts.select("video_id", "chunk_num").withColumn("part_no", F.row_number().over(w).cast("bigint"))
    return texts.join(numbers, ["video_id", "chunk_num"]).select("video_id", "part_no", "chunk_num", F.concat(F.coalesce("text", F.lit("")), F.lit(sep)).alias("part"))


def so_far(texts: DataFrame, most: int = 3000, sep: str = "\n\n") -> DataFrame:
    """video_id, chunk_num, so_far, total_length: of the video's text up to and with each chunk the first ``most`` characters, and how long it is. Of a video no more than ``most`` characters are ever collected."""
    w = Window.partitionBy("video_id").orderBy("chunk_num").rowsBetween(Window.unboundedPreceding, 0)
    part = F.concat(F.coalesce("text", F.lit("")), F.lit(sep))
    # Texts don't go through the ordered window: lengths and heads do.
    parts = texts.select("video_id", "chunk_num", F.length(part).alias("n"), F.left(part, F.lit(most)).alias("head"))
    placed = parts.select("video_id", "chunk_num", "n").withColumn("total_length", F.sum("n").over(w))
    near = parts.join(placed.where(F.col("total_length") - F.col("n") < most).select("video_id", "chunk_num"), ["video_id", "chunk_num"])
    heads = near.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("chunk_num", "head"))).alias("heads"))
    until = F.transform(F.filter("heads", lambda h: h["chunk_num"] <= F.col("chunk_num")), lambda h: h["head"])
    return placed.join(heads, "video_id").select("video_id", "chunk_num", F.left(F.array_join(until, ""), F.lit(most)).alias("so_far"), "total_length")


def first_value(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """key, value of the first row by the order that has one: the language of a video is that of its first chunk with one."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def with_gaps(present: DataFrame) -> DataFrame:
    """video_id, chunk_num, present: every chunk up to the video's last, those without a row too."""
    have = present.select("video_id", "chunk_num").where("video_id is not null and chunk_num is not null").distinct()
    all_ = have.groupBy("video_id").agg(F.max("chunk_num").cast("bigint").alias("last"))
    all_ = spread(all_, "chunk_num", F.lit(1), F.col("last")).select("video_id", "chunk_num")
    return all_.join(have.withColumn("present", F.lit(True)), ["video_id", "chunk_num"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def range_joined(points: DataFrame, ranges: DataFrame, on: list[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Points joined to the half-open ranges of the same key that hold them.

    Ranges are spread over buckets of ``bucket`` width, points have one, so the
    join is an equi join with few candidates. An end at or before the start
    holds nothing; choose a width near the usual range's.
    """
    wide = spread(ranges.where(F.col(end) > F.col(start)), "__b", F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))
    return points.withColumn("__b", F.floor(F.col(at) / bucket)).join(wide, [*on, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def latest(rows: DataFrame, key: str, by: str, *ties: str) -> DataFrame:
    """The row of each key that is last by ``by``, then by the tie columns."""
    rest = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(by, *ties)).alias("x"))
    return best.select(key, "x.*")

