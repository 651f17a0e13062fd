"""Text reports and the older CSV and JSON result files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_COLUMNS = {
    "index": "int", "start_time": "string", "end_time": "string", "start_seconds": "double", "end_seconds": "double", "duration": "string",
    "text": "string", "confidence": "double", "value_score": "double", "reasoning": "string",
}

REPORT_SCHEMA = """
metadata struct<timestamp: string, audio_path: string, duration: double, processing_profile: string>,
segments struct<
  evaluated: array<struct<start_time: double, end_time: double, duration: double, text: string, confidence: double, value_score: double, reasoning: string, technical_terms: array<string>>>,
  high_value: array<struct<start_time: double, end_time: double, value_score: double>>>,
summaries struct<
  evaluation: struct<total_segments: int, high_value_segments: int, average_score: double, threshold_used: double, score_distribution: map<string, int>>,
  transcription: struct<total_segments: int, total_duration: double, primary_language: string>>
"""


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def segment_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One shape of segment CSV as it is, text and reasoning with line breaks and doubled quotes inside; all columns are strings. Nothing between two commas is null, a pair of quotes the empty text. With the columns given the files' heads aren't read to find them."""
    # The reader takes what reads as nullValue for null, by default the empty text too; no field holds a new name.
    reader = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", uuid.uuid4().hex)
    return (reader.schema(", ".join(f"`{c}` string" for c in columns)) if columns else reader).csv(path)


def unified(*shapes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Segment files of several shapes as one table with all of SEGMENT_COLUMNS, after ``keys`` that all shapes have; what a shape lacks is null, what can't be cast too. Names are told apart without case."""
    out = None
    for s in shapes:
        have = {c.lower(): c for c in s.columns}
        one = s.select(*(keys or []), *[(F.col(f"`{have[c]}`").try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in SEGMENT_COLUMNS.items()])
        out = one if out is None else out.unionByName(one)
    return out


def run_reports(spark: SparkSession, path: str) -> DataFrame:
    """Nested run reports, one JSON document a file, with a given schema, so nothing is read twice."""
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", "true").json(path)


def evaluated_segments(reports: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, seg_no (from 0) and the columns of the evaluated segments; reports without any give no row."""
    rows = reports.select(*keys, F.posexplode("segments.evaluated").alias("seg_no", "__s"))
    return rows.select(*rows.columns[:-1], "__s.*")


def score_distribution(reports: DataFrame, *keys: str) -> DataFrame:
    """keys, bin, n of the reports' own histograms."""
    return reports.select(*keys, F.explode("summaries.evaluation.score_distribution").alias("bin", "n"))
