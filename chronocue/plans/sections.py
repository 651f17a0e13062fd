"""Section grammars over the lines of a text.

A text becomes numbered lines; a line that is a header opens its section, the
section holds for the lines under it. Headers are data: an ordered list of
(section, needles), the first whose needles a line holds in any case wins.
``strict`` drops what follows a header on its own line and takes only the
wordings the original prompts named; ``lenient`` takes the tail and the other
wordings too.

All of it happens within a row, in linear time: lines get their numbers,
header lines become marks, the text is split at the marks. Nothing is shuffled
or collected. The control characters U+0001 to U+0004 are the marks and are
taken out of the text before. Null texts give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bracketed, bullet, cut_within, first_range, has, hash_words, hashtags, line_after, reason_after, seconds_named
from ..functions.timecode import parse_range, parse_timestamp, strip

RULE = "═"
# Headers by section, in the order in which they are tried. An empty section name closes what is open.
ANALYSIS = [("summary", ("SUMMARY:",)), ("topics", ("TOPICS:",)), ("hashtags", ("HASHTAGS:",)), ("reels", ("REEL", "SEGMENT"))]
ANALYSIS_LENIENT = ANALYSIS + [("reels", ("REEL:",)), ("reels", ("REELS:",)), ("topics", ("MAIN TOPICS",)), ("hashtags", ("SUGGESTED HASHTAGS",))]
SELECTION = [("parts", ("PARTS:",)), ("", ("TOTAL_DURATION:",)), ("narrative", ("NARRATIVE:",)), ("title", ("TITLE:",))]
# End of the fixed values.


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line: the stripped lines of each text."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).select(key, (F.col("line_no") + 1).alias("line_no"), strip(F.col("line")).alias("line"))


OPEN, CLOSE, NUMBER, TAIL = "\u0001", "\u0002", "\u0003", "\u0004"


#: Blanks at the ends of all lines.
_AROUND = r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*"


def _lines(text: Column, numbered: bool) -> Column:
    """The text with its lines stripped; numbered with each line's number and U+0003 before it."""
    clean = strip(F.regexp_replace(F.concat(F.lit("|"), F.translate(text, OPEN + CLOSE + NUMBER + TAIL, "")), _AROUND, "\n"))
    clean = strip(F.substr(clean, F.lit(2))) if not numbered else clean
    if not numbered:
        return clean
    return F.array_join(F.transform(F.split(clean, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(NUMBER), F.when(i == 0, strip(F.substr(x, F.lit(2)))).otherwise(x))), "\n")


def _read(x: Column) -> Column:
    """struct(line_no, line) of a numbered line."""
    return F.struct(F.substring_index(x, NUMBER, 1).cast("int").alias("line_no"), F.substr(x, F.instr(x, NUMBER) + 1).alias("line"))


def may_hold(text: Column, headers: list[tuple[str, tuple[str, ...]]]) -> Column:
    """Whether a text can have a section: it holds the needles of some header that opens one."""
    out = F.lit(False)
    for needles in sorted({n for name, n in headers if name}):
        out = out | has(text, *needles)
    return out


def section_lines(text: Column, headers: list[tuple[str, tuple[str, ...]]], tails: bool = False, numbered: bool = True) -> Column:
    """Array of struct(section, line, and line_no if numbered) of the non-blank lines inside a section; with tails also what follows a header's colon."""
    marked = _lines(text, numbered)
    number = f"([0-9]+{NUMBER})" if numbered else "()"
    for name, needles in headers:
        held = "".join(f"(?=[^\\n]*{re.escape(n)})" for n in needles)
        # A tail is marked, so that no later header is seen in it.
        own = f"(?!{TAIL})" if tails else ""
        tail = f"\n{TAIL}$1$2" if tails else ""
        marked = F.regexp_replace(marked, f"(?imud)^{own}{number}{held}[^\\n:]*:?([^\\n]*)$", f"{OPEN}{name}{CLOSE}{tail}")
    parts = F.filter(F.slice(F.split(marked, OPEN), 2, 1 << 30), lambda p: ~F.startswith(p, F.lit(CLOSE)))

    def read(p: Column) -> Column:
        name = F.substring_index(p, CLOSE, 1)

        def one(x: Column) -> Column:
            if not numbered:
                return F.struct(name.alias("section"), (strip(F.replace(x, F.lit(TAIL), F.lit(""))) if tails else x).alias("line"))
            r = _read(F.replace(x, F.lit(TAIL), F.lit("")) if tails else x)
            return F.struct(name.alias("section"), r["line_no"].alias("line_no"), (strip(r["line"]) if tails else r["line"]).alias("line"))

        lines = F.filter(F.split(F.substr(p, F.instr(p, CLOSE) + 1), "\n"), lambda x: x != "")
        return F.filter(F.transform(lines, one), lambda r: r["line"] != "")

    return F.flatten(F.transform(parts, read))


def sectioned(texts: DataFrame, key: str, text: str, headers: list[tuple[str, tuple[str, ...]]], tails: bool = False) -> DataFrame:
    """key, line_no, section, line of the non-blank lines inside a section; with tails also what follows a header's colon."""
    x = texts.where(may_hold(F.col(text), headers)).select(key, F.explode(section_lines(F.col(text), headers, tails)).alias("x"))
    return x.select(key, "x.line_no", "x.section", "x.line")


def _once(c: Column, holds: Callable[[Column], Column]) -> Column:
    """A generator of the value if it holds, so it is worked out once and not again for a filter."""
    return F.explode(F.filter(F.array(c), holds))


def _in_section(lines: Column, name: str) -> Column:
    return F.transform(F.filter(lines, lambda x: x["section"] == name), lambda x: x["line"])


def parse_analysis(texts: DataFrame, key: str, text: str, strict: bool = True) -> DataFrame:
    """key, summary, topics, hashtags, reels of analysis replies; a text without a line in a section gives no row."""
    headers = ANALYSIS if strict else ANALYSIS_LENIENT
    found = texts.where(may_hold(F.col(text), headers)).select(key, _once(section_lines(F.col(text), headers, not strict, numbered=False), lambda s: F.size(s) > 0).alias("s"))
    s = F.col("s")
    return found.select(
        key, F.array_join(_in_section(s, "summary"), " ").alias("summary"), F.array_compact(F.transform(_in_section(s, "topics"), lambda x: bullet(x))).alias("topics"),
        F.flatten(F.transform(_in_section(s, "hashtags"), lambda x: hash_words(x))).alias("hashtags"), F.array_compact(F.transform(_in_section(s, "reels"), lambda x: bracketed(x))).alias("reels"),
    )


def parse_selection(texts: DataFrame, key: str, text: str, strict: bool = True) -> DataFrame:
    """key, parts (array of struct(time_range, reason)), total_duration, narrative, title of selection replies; every non-null text gives a row."""

    def part(line: Column) -> Column:
        rng = first_range(line)
        return F.when(rng.isNotNull(), F.struct(rng.alias("time_range"), reason_after(line, rng, "Selected segment").alias("reason")))

    c = F.col(text)
    named = F.filter(F.split(c, "\n"), lambda x: has(x, "TOTAL_DURATION:") & ~has(x, "PARTS:") & x.rlike("[0-9]s"))
    read = texts.where(c.isNotNull()).select(key, F.when(F.size(named) > 0, F.element_at(named, -1)).alias("t"), _once(section_lines(c, SELECTION, not strict, numbered=False), lambda s: F.lit(True)).alias("s"))
    s = F.col("s")
    return read.select(
        key, F.array_compact(F.transform(_in_section(s, "parts"), part)).alias("parts"), F.coalesce(seconds_named(F.col("t")), F.lit(0)).alias("total_duration"),
        F.array_join(_in_section(s, "narrative"), " ").alias("narrative"), F.array_join(_in_section(s, "title"), " ").alias("title"),
    )


def region_lines(text: Column, opens: Callable[[Column], Column], closes: Callable[[Column], Column], first_only: bool = False) -> Column:
    """Array of struct(region, line_no, line) of the lines between an opening line and the next closing one, neither included.

    An opening line inside a region goes on with it. first_only ends with the
    first region.
    """

    def mark(x: Column) -> Column:
        line = F.substr(x, F.instr(x, NUMBER) + 1)
        return F.when(opens(line), F.lit(OPEN)).when(closes(line), F.lit(CLOSE)).otherwise(x)

    marked = F.array_join(F.transform(F.split(_lines(text, True), "\n"), mark), "\n")
    # Between two closings there is at most one region: what follows its first opening.
    spans = F.filter(F.split(marked, CLOSE), lambda p: F.contains(p, F.lit(OPEN)))
    if first_only:
        spans = F.slice(spans, 1, 1)

    def read(p: Column, i: Column) -> Column:
        lines = F.filter(F.split(F.substr(p, F.instr(p, OPEN) + 1), "\n"), lambda x: F.contains(x, F.lit(NUMBER)))
        return F.transform(lines, lambda x: F.struct((i + 1).alias("region"), _read(x)["line_no"].alias("line_no"), _read(x)["line"].alias("line")))

    return F.flatten(F.transform(spans, read))


def regions(texts: DataFrame, key: str, text: str, opens: Callable[[Column], Column], closes: Callable[[Column], Column], first_only: bool = False) -> DataFrame:
    """key, line_no, region, line of the lines inside the regions of each text."""
    x = texts.where(F.col(text).isNotNull()).select(key, F.explode(region_lines(F.col(text), opens, closes, first_only)).alias("x"))
    return x.select(key, "x.line_no", "x.region", "x.line")


def suggestions(texts: DataFrame, key: str, text: str, first_only: bool = False) -> DataFrame:
    """key, line_no, time_range, reason of the reel suggestions of a summary; with first_only of its first such section."""
    line = F.col("line")
    rng = first_range(line)
    r = regions(texts, key, text, lambda x: has(x, "REEL", "SUGGESTION"), lambda x: F.startswith(x, F.lit(RULE)), first_only)
    return r.where(rng.isNotNull()).select(key, "line_no", rng.alias("time_range"), reason_after(line, rng, "Engaging content", bracket=False).alias("reason"))


def summary_topics(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, topic: the bullets under any line with ``topics:``, those of all chunks, of the whole and of the archive together."""
    line = F.col("line")
    r = regions(texts, key, text, lambda x: has(x, "TOPICS:"), lambda x: F.startswith(x, F.lit(RULE)) | F.startswith(x, F.lit("Suggested Hashtags")))
    topic = strip(F.substr(line, F.lit(2)))
    return r.where(F.startswith(line, F.lit("•"))).select(key, "line_no", topic.alias("topic"))


def first_hashtags(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, hashtags of the first line that has any."""
    return texts.where(F.col(text).isNotNull()).select(key, hashtags(F.regexp_extract(text, r"(?m)^(.*?#[\p{L}\p{M}\p{N}_].*)$", 1)).alias("hashtags"))


def overall_summary(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, cumulative_summary: the line under ``Overall Summary:``, empty without one."""
    return texts.where(F.col(text).isNotNull()).select(key, F.coalesce(line_after(F.col(text), "Overall Summary:"), F.lit("")).alias("cumulative_summary"))


def chunk_summaries(texts: DataFrame, key: str, text: str, most: int = 300) -> DataFrame:
    """key, chunk, time_range, summary of every chunk block that has them all.

    The text is cut into blocks first, so a block without a summary takes
    nothing of the next.
    """
    blocks = texts.select(key, F.posexplode(F.split(text, r"(?i)(?=CHUNK\s+\d+\s+ANALYSIS)")).alias("block_no", "block"))
    chunk = F.regexp_extract("block", r"(?i)^CHUNK\s+(\d{1,9})\s+ANALYSIS", 1)
    time = strip(F.regexp_extract("block", r"(?is)Time:\s*([\d:.]+\s*-\s*[\d:.]+)", 1))
    said = strip(F.regexp_extract("block", r"(?is)Time:\s*[\d:.]+\s*-\s*[\d:.]+.*?(?<!Overall )Summary:\s*(.*?)(?:Topics:|═|$(?![\s\S]))", 1))
    return blocks.select(key, chunk.try_cast("int").alias("chunk"), time.alias("time_range"), cut_within(said, most).alias("summary")).where("chunk is not null and time_range <> '' and summary <> ''")


def segment_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, start, end, said of the ``[a - b] text`` lines."""
    pattern = r"^\[([0-9]+:[0-9.]+) - ([0-9]+:[0-9.]+)\] ?(.*)$"
    at = lambda n: F.regexp_extract("line", pattern, n)
    return lines(texts, key, text).where(F.col("line").rlike(pattern)).select(key, "line_no", parse_timestamp(at(1)).alias("start"), parse_timestamp(at(2)).alias("end"), at(3).alias("said"))


def key_values(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, value of the ``name: value`` lines."""
    parts = F.split("line", ": ", 2)
    return lines(texts, key, text).where(F.contains("line", F.lit(": "))).select(key, "line_no", parts[0].alias("name"), parts[1].alias("value"))


def after_marker(texts: DataFrame, key: str, text: str, marker: str = "Full transcript so far:") -> DataFrame:
    """key, transcript: what stands under the marker line and the rule line after it, the whole text without a marker, empty for a null text."""
    c = F.col(text)
    under = F.regexp_replace(F.substr(c, F.instr(c, marker) + len(marker)), r"^[ \t]*\n-*\n?", "")
    # The separators \x1c to \x1f are blanks too, as for the first programs.
    bare = lambda x: F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return texts.select(key, F.when(c.isNull(), F.lit("")).when(F.instr(c, marker) > 0, bare(under)).otherwise(bare(c)).alias("transcript"))


def run_directory(name: Column) -> Column:
    """struct(run_date, run_time, video) of a run folder's name, date and time and the rest at its first two ``_``; null without them."""
    at = lambda n: F.regexp_extract(name, r"^([^_]*)_([^_]*)_(.*)$", n)
    return F.when(name.rlike(r"^[^_]*_[^_]*_"), F.struct(at(1).alias("run_date"), at(2).alias("run_time"), at(3).alias("video")))


def analysis_documents(texts: DataFrame, key: str, text: str, strict: bool = True) -> DataFrame:
    """key, document: the parsed analysis as one nested struct with counts, null where a text has no section."""
    p = parse_analysis(texts, key, text, strict)
    doc = F.struct(
        F.struct(F.col("summary").alias("text"), F.length("summary").alias("n_chars")).alias("summary"), F.struct(F.col("topics").alias("items"), F.size("topics").alias("n")).alias("topics"),
        F.struct(F.col("hashtags").alias("items"), F.size("hashtags").alias("n")).alias("hashtags"), F.struct(F.col("reels").alias("items"), F.size("reels").alias("n")).alias("reels"),
    )
    return texts.select(key).join(p.select(key, doc.alias("document")), key, "left")


def summary_record(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, reel_suggestions, cumulative_summary, topics, hashtags: everything a summary file says, one record of each non-null text, within the row.

    reel_suggestions is an array of struct(time_range, reason) of all its
    suggestion sections, topics the bullets under any topics line, hashtags
    those of its first line with any.
    """
    c = F.col(text)
    rng = lambda x: first_range(x["line"])
    reels = region_lines(c, lambda x: has(x, "REEL", "SUGGESTION"), lambda x: F.startswith(x, F.lit(RULE)))
    named = F.transform(F.filter(reels, lambda x: rng(x).isNotNull()), lambda x: F.struct(rng(x).alias("time_range"), reason_after(x["line"], rng(x), "Engaging content", bracket=False).alias("reason")))
    topics = region_lines(c, lambda x: has(x, "TOPICS:"), lambda x: F.startswith(x, F.lit(RULE)) | F.startswith(x, F.lit("Suggested Hashtags")))
    bulleted = F.transform(F.filter(topics, lambda x: F.startswith(x["line"], F.lit("•"))), lambda x: strip(F.substr(x["line"], F.lit(2))))
    return texts.where(c.isNotNull()).select(
        key, F.coalesce(named, F.array().cast("array<struct<time_range:string,reason:string>>")).alias("reel_suggestions"), F.coalesce(line_after(c, "Overall Summary:"), F.lit("")).alias("cumulative_summary"),
        F.coalesce(bulleted, F.array().cast("array<string>")).alias("topics"), hashtags(F.regexp_extract(c, r"(?m)^(.*?#[\p{L}\p{M}\p{N}_].*)$", 1)).alias("hashtags"),
    )


def pasted_ranges(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, pos (from 1, of the good ones), time_range, start, end: ranges pasted one a line, up to a line ``done`` in any case. Lines that are no range, and blank ones, are skipped."""
    one = lines(texts, key, text).where(F.col("line") != "")
    stop = one.groupBy(key).agg(F.min(F.when(F.lower("line") == "done", F.col("line_no"))).alias("__stop"))
    r = parse_range(F.col("line"))
    good = one.join(stop, key).where(F.col("__stop").isNull() | (F.col("line_no") < F.col("__stop"))).withColumn("r", r).where("r is not null")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    return good.select(key, "line_no", pos.alias("pos"), F.col("line").alias("time_range"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))
