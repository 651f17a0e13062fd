"""Overlapping windows over the media time of each video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import ordered_text
from .sweep import spread


def overlapping(segs: DataFrame, target_cs: int = 4500, overlap_cs: int = 1000) -> DataFrame:
    """video_id, window_no (from 0), ws, we: windows of ``target`` that step by target less overlap from a video's first start until one reaches its last end.

    The last window is cut at the last end. Segments without an end count
    their start.
    """
    if not 0 <= overlap_cs < target_cs:
        raise ValueError("the overlap has to be shorter than the window")
    step = target_cs - overlap_cs
    span = segs.groupBy("video_id").agg(F.min("start_cs").alias("t0"), F.max(F.greatest("start_cs", F.coalesce("end_cs", "start_cs"))).alias("t1"))
    last = F.greatest(F.lit(0), F.ceil((F.col("t1") - F.col("t0") - target_cs) / step)).cast("bigint")
    w = spread(span, "window_no", F.lit(0), last)
    start = F.col("t0") + F.col("window_no") * step
    return w.select("video_id", "window_no", start.alias("ws"), F.least(start + target_cs, F.col("t1")).alias("we"))


def members(segs: DataFrame, windows: DataFrame, bucket_cs: int = 6000, how: str = "overlap") -> DataFrame:
    """Segments with the windows they overlap (``overlap``) or start in (``start``).

    Both sides go to buckets of media time, so it is an equi join; a pair is
    kept in the bucket of its later start only and so comes once.
    """
    w = spread(windows, "b", F.floor(F.col("ws") / bucket_cs), F.floor(F.greatest(F.col("ws"), F.col("we") - 1) / bucket_cs))
    end = F.greatest(F.coalesce("end_cs", "start_cs"), "start_cs")
    s = spread(segs.withColumn("__e", end), "b", F.floor(F.col("start_cs") / bucket_cs), F.floor(F.greatest(F.col("start_cs"), F.col("__e") - 1) / bucket_cs))
    near: Column = (F.col("start_cs") < F.col("we")) & (F.col("__e") > F.col("ws"))
    if how == "start":
        near = (F.col("start_cs") >= F.col("ws")) & (F.col("start_cs") < F.col("we"))
    owner = F.floor(F.greatest("start_cs", "ws") / bucket_cs)
    return s.join(w, ["video_id", "b"]).where(near & (F.col("b") == owner)).drop("b", "__e")


def window_texts(pairs: DataFrame) -> DataFrame:
    """video_id, window_no, ws, we, n_segments, text of windows with a segment."""
    return pairs.groupBy("video_id", "window_no", "ws", "we").agg(F.count("*").alias("n_segments"), ordered_text(F.col("text"), F.col("start_cs"), F.col("seg_index"), sep=" ").alias("text"))
