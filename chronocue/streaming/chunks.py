"""Chunks of media time as segments arrive.

Chunk counts are a keyed running aggregate. Files that show the newest state
(the cumulative transcript, the progressive summary) are rewritten from the
stored rows by ``foreachBatch``, those of the videos that a batch touches: a
batch that runs again overwrites what it wrote, so results are the same after
a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.timecode import chunk_of, to_cs
from ..operators.chunks import chunk_texts, whole_text


def stream_of(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream of rows of the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def chunk_counts(stream: DataFrame, chunk_s: int = 120) -> DataFrame:
    """video_id, chunk_num, n_segments, spoken_cs, running; for complete or update output. Rows without a video or start are left out."""
    s = stream.select("video_id", to_cs(F.col("start_time")).alias("start_cs"), to_cs(F.col("end_time")).alias("end_cs")).where("video_id is not null and start_cs is not null")
    return s.groupBy("video_id", chunk_of(F.col("start_cs"), chunk_s).alias("chunk_num")).agg(F.count("*").alias("n_segments"), F.sum(F.greatest(F.coalesce(F.col("end_cs") - F.col("start_cs"), F.lit(0)), F.lit(0))).alias("spoken_cs"))


def once_by(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Rows without repeated deliveries within ``late`` of event time; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """key, from, to, n over tumbling event-time windows; final once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def sessions(stream: DataFrame, at: str, key: str, pause: str, late: str) -> DataFrame:
    """key, from, to, n over runs of events that no pause of ``pause`` parts."""
    return stream.withWatermark(at, late).groupBy(key, F.session_window(at, pause).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def rewriting(stream: DataFrame, store: str, checkpoint: str, render: Callable[[DataFrame], DataFrame], out: str, key: str = "video_id", buckets: int = 64) -> StreamingQuery:
    """Keep a stream's rows in ``store`` and write ``render`` of all of them to ``out`` after each batch. Runs until what is there is read.

    Rows are stored by a hash of ``key``; a batch reads again and rewrites the
    buckets it touches only, so render has to work key by key. Both folders
    are partitioned by bucket, the store by batch too: a batch that runs again
    overwrites what it wrote, so results are the same after a restart.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def batch(rows: DataFrame, number: int) -> None:
        spark, own = rows.sparkSession, rows.schema.fields
        stored = StructType([*own, StructField("batch", LongType()), StructField("__bucket", IntegerType())])
        rows.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{store}/batch={number}")
        # At most ``buckets`` numbers come to the driver.
        touched = sorted(r[0] for r in spark.read.schema(StructType([*own, stored["__bucket"]])).parquet(f"{store}/batch={number}").select("__bucket").distinct().collect())
        if not touched:
            return
        kept = spark.read.schema(stored).parquet(store).where(F.col("batch") <= number)
        for_these = render(kept.where(F.col("__bucket").isin(touched)).drop("batch", "__bucket"))
        # A bucket whose rows render to nothing keeps what it has; keys don't go.
        for_these.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_text(chunked: DataFrame) -> DataFrame:
    """video_id, chunk_num, so_far of the newest chunk of each video: the cumulative transcript."""
    t = chunk_texts(chunked)
    return whole_text(t).withColumnRenamed("text", "so_far").join(t.groupBy("video_id").agg(F.max("chunk_num").alias("chunk_num")), "video_id")
