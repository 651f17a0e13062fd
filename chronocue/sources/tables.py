"""Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of one parquet file or folder for each table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def table_stream(spark: SparkSession, directory: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """The same table as a stream of its files, in no particular order."""
    path = f"{directory}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, directory, name).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    # A stream's source is a folder: of this one only the table's file.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
