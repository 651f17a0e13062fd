"""Text of transcripts, replies and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timecode import RANGE, strip

# What is deleted from recognised text.
RTL_MARKS = "‪‫‬‏‎"
PAD = "[PAD]"
# End of the fixed values.


def clean_rtl(c: Column) -> Column:
    """Without direction marks and padding marks; U+202D, U+202E and isolates stay."""
    return F.replace(F.translate(c, RTL_MARKS, ""), F.lit(PAD), F.lit(""))


def sanitized_stem(path: Column) -> Column:
    """File name without folder and ending, blanks as ``_`` and dots as ``-``."""
    return F.translate(stem(path), " .", "_-")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last ending; a leading dot begins no ending."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def cut(c: Column, n: int, suffix: str = "") -> Column:
    """The first n characters and the suffix where there are more, else the text."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(suffix))).otherwise(c)


def cut_within(c: Column, n: int, suffix: str = "...") -> Column:
    """At most n characters, the suffix counted."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - len(suffix))), F.lit(suffix))).otherwise(c)


def preview(c: Column, n: int = 60) -> Column:
    """The first n characters, always with an ellipsis."""
    return F.concat(F.left(c, F.lit(n)), F.lit("..."))


def canonical_range(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(" - "), F.lit("-")), F.lit(" "), F.lit(""))


def has(c: Column, *needles: str) -> Column:
    """Whether the text holds all needles, in any case."""
    up = F.upper(c)
    out = F.contains(up, F.lit(needles[0]))
    for n in needles[1:]:
        out = out & F.contains(up, F.lit(n))
    return out


def first_range(c: Column) -> Column:
    """The first time range of a line, null without one."""
    return F.nullif(F.regexp_extract(c, f"({RANGE})", 1), F.lit(""))


def reason_after(line: Column, time_range: Column, default: str, bracket: bool = True) -> Column:
    """What follows the time range, less one ``]`` (unless bracket is False) and one ``-``; the default where nothing does."""
    at = F.instr(line, time_range)
    rest = strip(F.substr(line, at + F.length(time_range)))
    if bracket:
        rest = F.when(F.startswith(rest, F.lit("]")), strip(F.substr(rest, F.lit(2)))).otherwise(rest)
    rest = F.when(F.startswith(rest, F.lit("-")), strip(F.substr(rest, F.lit(2)))).otherwise(rest)
    return F.when(rest == "", F.lit(default)).otherwise(rest)


def bracketed(c: Column) -> Column:
    """struct(time_range, reason) of a line whose first ``[`` and first ``]`` enclose exactly one ``-``, else null."""
    inner = F.regexp_extract(c, r"^[^\[\]]*\[([^\]]*)\]", 1)
    rest = F.regexp_extract(c, r"^[^\]]*\](.*)$", 1)
    return F.when(F.size(F.split(inner, "-")) == 2, F.struct(strip(inner).alias("time_range"), strip(rest).alias("reason")))


def hash_words(c: Column) -> Column:
    """Words that begin with ``#``, punctuation kept, repeated ones too."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: F.startswith(x, F.lit("#")))


def hashtags(c: Column) -> Column:
    """``#`` and the letters, digits and underscores after it."""
    return F.regexp_extract_all(c, F.lit(r"(#[\p{L}\p{M}\p{N}_]+)"), 1)


def bullet(c: Column, marks: str = "-•") -> Column:
    """Text of a bulleted line, null of another or an empty one."""
    return F.when(F.substr(c, F.lit(1), F.lit(1)).isin(*marks), F.nullif(strip(F.substr(c, F.lit(2))), F.lit("")))


def seconds_named(c: Column) -> Column:
    """The first whole number followed by ``s``; 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"([0-9]{1,9})s", 1).try_cast("int"), F.lit(0))


def occurrences(c: Column, needle: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def line_after(c: Column, marker: str, window: int = 500) -> Column:
    """The line after the one on which the marker first stands, read within ``window`` characters of the marker; null without a marker."""
    at = F.instr(c, marker)
    return F.when(at > 0, strip(F.get(F.split(F.substr(c, at, F.lit(window)), "\n"), F.lit(1))))


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(c, r"[ \n\t\r]+"), lambda x: x != ""))


def smart_cut(c: Column, n: int, how: str = "smart") -> Column:
    """At most about n characters: ``start``, ``end``, ``smart`` (half from either end around an ellipsis) or ``full``."""
    if how == "full":
        return c
    if how == "start":
        return F.left(c, F.lit(n))
    if how == "end":
        return F.right(c, F.lit(n))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n // 2)), F.lit("\n...\n"), F.right(c, F.lit(n // 2))))


def cache_key(text: Column, kind: str, model: str) -> Column:
    """First 16 hex digits of the SHA-256 of text, kind and model joined by ``_``."""
    return F.left(F.sha2(F.concat_ws("_", text, F.lit(kind), F.lit(model)), 256), F.lit(16))


def padded(number: Column, width: int = 2) -> Column:
    """A whole number with leading zeros up to the width; a longer one stays whole."""
    s = number.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def fresh(stored_at: Column, now: Column, days: int = 7) -> Column:
    """Whether something stored then still counts now: for so many days, the last moment not included."""
    return (now >= stored_at) & (now < stored_at + F.make_dt_interval(F.lit(days)))


def json_or_raw(c: Column) -> Column:
    """struct(json, raw, parse_error): the object in a reply if it can be read, else the reply as it is and that it couldn't."""
    found = json_object(c)
    good = F.try_parse_json(found).isNotNull()
    return F.when(c.isNotNull(), F.struct(F.when(good, found).alias("json"), F.when(~F.coalesce(good, F.lit(False)), c).alias("raw"), (~F.coalesce(good, F.lit(False))).alias("parse_error")))


def json_object(c: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a reply, null without them."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
