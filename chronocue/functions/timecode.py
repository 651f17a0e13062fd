"""Media time: seconds, hundredths of a second, and their written forms.

Bad input gives null, never an error. Hundredths (``cs``) are whole numbers, so
subtracting and adding an offset returns the number it began with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
_WHOLE = r"^[+-]?[0-9]{1,9}$"
#: A time range as it stands in a line of text.
RANGE = r"[0-9]+:[0-9]+\.?[0-9]*\s*-\s*[0-9]+:[0-9]+\.?[0-9]*"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _number(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), c.cast("double"))


def parse_timestamp(c: Column) -> Column:
    """Seconds of ``M:SS.ff`` or of plain seconds. Whatever follows a second colon is ignored, so 1:02:03 is 62."""
    t = strip(c)
    parts = F.split(t, ":")
    minutes, seconds = strip(parts[0]), strip(F.get(parts, F.lit(1)))
    return F.when(F.contains(t, F.lit(":")), F.when(minutes.rlike(_WHOLE), minutes.cast("int")) * 60 + _number(seconds)).otherwise(_number(t))


def parse_range(c: Column) -> Column:
    """struct(start, end) of ``a-b`` with a before b, else null."""
    parts = F.split(strip(c), r"\s*-\s*")
    pair = F.struct(parse_timestamp(parts[0]).alias("start"), parse_timestamp(F.get(parts, F.lit(1))).alias("end"))
    # As an array of one, so each bound is read once.
    return F.when(F.size(parts) == 2, F.get(F.filter(F.array(pair), lambda p: p["start"] < p["end"]), F.lit(0)))


def range_list(c: Column) -> Column:
    """Array of struct(pos, text, start, end) of comma-separated ranges in the order given; blank pieces are skipped, bad ones have null bounds."""
    pieces = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    read = F.transform(pieces, lambda x, i: F.struct((i + 1).alias("pos"), x.alias("text"), parse_range(x).alias("r")))
    return F.transform(read, lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), x["r"]["start"].alias("start"), x["r"]["end"].alias("end")))


def to_cs(seconds: Column) -> Column:
    """Seconds to the nearest hundredth; null for NaN and what no BIGINT holds."""
    return F.when(~F.isnan(seconds) & (F.abs(seconds) < 9e15), F.round(seconds * 100).cast("bigint"))


def format_cs(cs: Column) -> Column:
    """``M:SS.ff``; minutes don't roll into hours."""
    return F.concat(F.floor(cs / 6000).cast("string"), F.lit(":"), F.lpad(F.floor((cs % 6000) / 100).cast("string"), 2, "0"), F.lit("."), F.lpad((cs % 100).cast("string"), 2, "0"))


def format_seconds(seconds: Column) -> Column:
    """``M:SS.ff`` with the seconds rounded on their own, so 59.999 is 0:60.00."""
    minutes = F.floor(seconds / 60)
    return F.format_string("%d:%05.2f", minutes, seconds - minutes * 60)


def srt_time(cs: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    return _clock(cs, ",")


def vtt_time(cs: Column) -> Column:
    """``HH:MM:SS.mmm``."""
    return _clock(cs, ".")


def _clock(cs: Column, point: str) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(cs / 360_000)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(cs / 6000) % 60), F.lit(":"), two(F.floor(cs / 100) % 60), F.lit(point), F.lpad(((cs % 100) * 10).cast("string"), 3, "0"))


def chunk_of(cs: Column, chunk_s: int = 120) -> Column:
    """Number, from 1, of the chunk in which a segment starts; the end of a chunk belongs to the next."""
    return (F.floor(cs / (chunk_s * 100)) + 1).cast("bigint")


def chunk_start_cs(chunk: Column, chunk_s: int = 120) -> Column:
    return (chunk - 1) * (chunk_s * 100)


def chunk_count(duration: Column, chunk_s: int = 120) -> Column:
    """Chunks of a medium: one up to a chunk's length, else as many as begin in it."""
    return F.when(F.isnan(duration), None).when(duration <= chunk_s, F.lit(1)).otherwise(F.ceil(duration / chunk_s)).cast("bigint")
