"""Media files and run folders, from file metadata only.

``binaryFile`` lists files as rows in parallel; their content isn't read
unless a probe asks for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of media files, all lower or all upper case, and folders that aren't searched.
ENDINGS = ("mp4", "mov", "avi", "mkv", "MP4", "MOV", "AVI", "MKV")
PRUNED = ("node_modules", "venv", "reels_extractor_env", "__pycache__")
# End of the fixed values.


def is_media(path: Column) -> Column:
    """By its ending, case as listed: ``.Mp4`` isn't."""
    return path.rlike(r"\.(" + "|".join(ENDINGS) + ")$")


def is_pruned(path: Column) -> Column:
    """Whether a folder on the way is hidden or never searched."""
    return path.rlike(r"/(\.[^/]+|" + "|".join(PRUNED) + ")/")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def listing(spark: SparkSession, base: str, recursive: bool = True) -> DataFrame:
    """path, modified, length of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", F.col("modificationTime").alias("modified"), "length")
    if recursive:
        return files
    own = "/" + re.sub(r"^[A-Za-z0-9]+:/*", "", base).strip("/")
    return files.where(F.regexp_replace(_folder(F.col("path")), "^[A-Za-z0-9]+:/*", "/") == own)


def media_info(files: DataFrame, probe: Callable[[str], float | None] | None = None) -> DataFrame:
    """path, name, duration, size_mb, modified_date of media files. probe gives a file's seconds; where it fails or is missing they are null."""
    rows = files.where(is_media(F.col("path")) & ~is_pruned(F.col("path"))).select(
        "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), (F.col("length") / 1048576).alias("size_mb"), F.date_format("modified", "yyyy-MM-dd").alias("modified_date"),
    )
    if probe is None:
        return rows.select("path", "name", F.lit(None).cast("double").alias("duration"), "size_mb", "modified_date")

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(p: str) -> float | None:
            try:
                return probe(p)
            except Exception:  # an unreadable file is a null, not an error
                return None

        for b in batches:
            yield b.assign(duration=pd.Series([one(p) for p in b["path"]], dtype="float64"))[["path", "name", "duration", "size_mb", "modified_date"]]

    return rows.mapInPandas(probed, "path string, name string, duration double, size_mb double, modified_date string")


def in_folder(files: DataFrame, folder: str) -> DataFrame:
    """Files of one folder, not of those in it."""
    return files.where(_folder(F.col("path")) == folder.rstrip("/"))


def scan_folder(spark: SparkSession, folder: str, probe: Callable[[str], float | None] | None = None) -> DataFrame:
    """Media of one folder, not of those in it, in order of path."""
    return media_info(listing(spark, folder, recursive=False), probe).orderBy("path")


def media_folders(files: DataFrame) -> DataFrame:
    """folder, n_media of the folders that hold media, and seconds, their whole seconds, if files have a duration."""
    f = files.where(is_media(F.col("path")) & ~is_pruned(F.col("path")))
    more = []
    if "duration" in files.columns:
        more = [F.sum(F.when(F.col("duration").isNull() | F.isnan("duration"), 0).otherwise(F.floor("duration"))).cast("bigint").alias("seconds")]
    return f.groupBy(_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("n_media"), *more)


def folders_with_media(spark: SparkSession, base: str) -> DataFrame:
    """folder, n_media of all folders under base that hold media, in order."""
    return media_folders(listing(spark, base)).orderBy("folder")


def named(path: Column, prefix: str = "", suffix: str = "") -> Column:
    """Whether a file's name begins and ends so."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.startswith(name, F.lit(prefix)) & F.endswith(name, F.lit(suffix)) & (F.length(name) >= len(prefix) + len(suffix))


def latest_run(files: DataFrame) -> DataFrame:
    """folder: the run folder whose files changed last, ties to the greatest name."""
    return files.select(F.max_by(_folder(F.col("path")), F.struct("modified", _folder(F.col("path")))).alias("folder"))


def media_of_runs(runs: DataFrame, files: DataFrame, endings: tuple[str, ...] = ("MP4", "MOV", "mp4", "mov")) -> DataFrame:
    """folder, path: of each run folder the first of its video's names with the endings, in that order, that exists."""
    video = F.regexp_extract(F.regexp_extract("folder", r"([^/]*)$", 1), r"^[^_]*_[^_]*_(.*)$", 1)
    wanted = runs.select("folder", F.posexplode(F.array(*[F.concat(video, F.lit("." + e)) for e in endings])).alias("k", "name"))
    have = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    return wanted.join(have, "name").groupBy("folder").agg(F.min_by("path", F.struct("k", "path")).alias("path"))


def rotation(degrees: Column) -> Column:
    """Degrees from 0 to 359; what isn't a whole number is 0."""
    return F.coalesce(F.abs(degrees.cast("string").try_cast("int")) % 360, F.lit(0))


def rotation_command(path: Column) -> Column:
    """Arguments that print a medium's rotation, one number or nothing."""
    return F.array(*map(F.lit, ("ffprobe", "-v", "error", "-select_streams", "v:0", "-show_entries", "stream_side_data=rotation", "-of", "default=noprint_wrappers=1:nokey=1")), path)


def probed_rotation(output: Column) -> Column:
    """Degrees from 0 to 359 of what ``rotation_command`` printed: a number, its fraction cut; anything else is 0."""
    read = F.when(output.rlike(r"(?U)^\s*[+-]?([0-9]{1,9}(\.[0-9]*)?|\.[0-9]+)\s*$"), F.regexp_replace(output, r"(?U)\s", "").try_cast("double"))
    return F.coalesce(F.abs(read.cast("int")) % 360, F.lit(0))
