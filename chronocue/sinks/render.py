"""Reports as ordered line frames: key columns, part, line_no, line.

A frame is a table; ``write_files`` makes one text file of each key, the lines
in order. Nothing is rendered on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_range, padded
from ..functions.timecode import chunk_start_cs, format_cs, srt_time, strip, to_cs, vtt_time
from ..session import shared_folder

# The rules that part the sections of the reports. So are the titles and names of
# fields in the reports below, which are formats that other programs read.
HEAVY, WIDE, LIGHT, DOUBLE, SINGLE = "=" * 60, "=" * 70, "-" * 40, "═" * 70, "─" * 70
# End of the fixed values.


def _numbered(parts: list[Column]) -> Column:
    """Explode to (line_no, line), null lines left out."""
    return F.posexplode(F.array_compact(F.array(*parts)))


def _lit(s: str) -> Column:
    return F.lit(s)


def segment_line(start: Column, end: Column, text: Column) -> Column:
    return F.concat(_lit("["), format_cs(start), _lit(" - "), format_cs(end), _lit("] "), strip(F.coalesce(text, _lit(""))))


def one_decimal(tenths: Column) -> Column:
    """A whole number of tenths as a decimal."""
    return F.concat(F.floor(tenths / 10).cast("string"), _lit("."), (tenths % 10).cast("string"))


def chunk_files(chunked: DataFrame, chunk_s: int = 120) -> DataFrame:
    """Lines of chunk_NN.txt: video_id, chunk_num, part, line_no, line. Header, time range, text, one line a segment with absolute times."""
    heads = chunked.groupBy("video_id", "chunk_num").agg(F.max("end_cs").alias("to_cs"))
    start = chunk_start_cs(F.col("chunk_num"), chunk_s)
    head = heads.select(
        "video_id", "chunk_num", _lit("0").cast("int").alias("part"),
        _numbered([
            F.concat(_lit("CHUNK "), F.col("chunk_num").cast("string"), _lit(" TRANSCRIPT")), _lit(HEAVY), _lit(""),
            F.concat(_lit("Time range: "), format_cs(start), _lit(" - "), format_cs(start + chunk_s * 100)), _lit(""), _lit("Segments with timestamps:"), _lit(LIGHT),
        ]).alias("line_no", "line"),
    )
    body = chunked.select("video_id", "chunk_num", _lit("1").cast("int").alias("part"), F.col("seg_index").cast("int").alias("line_no"), segment_line(F.col("start_cs"), F.coalesce("end_cs", "start_cs"), F.col("text")).alias("line"))
    return head.unionByName(body)


def chunk_metadata(chunks: DataFrame, chunk_s: int = 120) -> DataFrame:
    """Lines of chunk_NN_metadata.txt from rows video_id, chunk_num, duration_cs, processing_tenths, language, n_segments."""
    d, p = F.floor(F.col("duration_cs") / 10), F.col("processing_tenths")
    minutes = lambda tenths: one_decimal(F.floor((tenths * 2 + 60) / 120))
    line = lambda name, value: F.concat(_lit(name + ": "), value)
    return chunks.select(
        "video_id", "chunk_num",
        _numbered([
            F.concat(_lit("CHUNK "), F.col("chunk_num").cast("string"), _lit(" METADATA")), _lit(HEAVY), _lit(""),
            line("Chunk number", F.col("chunk_num").cast("string")), line("Start time", format_cs(chunk_start_cs(F.col("chunk_num"), chunk_s))),
            line("Duration", F.concat(one_decimal(d), _lit(" seconds ("), minutes(d), _lit(" minutes)"))),
            line("Processing time", F.concat(one_decimal(p), _lit(" seconds ("), minutes(p), _lit(" minutes)"))),
            line("Language", F.coalesce("language", _lit("N/A"))), line("Number of segments", F.col("n_segments").cast("string")),
        ]).alias("line_no", "line"),
    )


def cumulative_report(texts: DataFrame, updated_at: Column) -> DataFrame:
    """Lines of the cumulative transcript: video_id, part, line_no, line of rows video_id, chunk_num, text: a head that names the newest chunk, then the chunks' texts in order, as lines, so no video is one value."""
    newest = texts.groupBy("video_id").agg(F.max("chunk_num").alias("chunk_num"))
    head = newest.select(
        "video_id", F.lit(0).cast("int").alias("part"),
        _numbered([
            _lit("CUMULATIVE FULL TRANSCRIPT"), _lit(HEAVY), F.concat(_lit("Last updated: Chunk "), F.col("chunk_num").cast("string")),
            F.concat(_lit("Updated at: "), F.date_format(updated_at, "yyyy-MM-dd HH:mm:ss")), _lit(""), _lit("Full transcript so far:"), _lit(LIGHT),
        ]).alias("line_no", "line"),
    )
    return head.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(_text_lines(texts, 1))


def _line(part: int) -> Column:
    return F.lit(part).cast("int").alias("part")


def final_summary(videos: DataFrame, texts: DataFrame, segs: DataFrame, timings: DataFrame) -> DataFrame:
    """Lines of the final summary: video_id, part, line_no, line.

    videos: video_id, path, model, language, duration_cs (null: N/A); texts:
    video_id, chunk_num, text, each a line with an empty one after it, numbered
    by chunk, so a long video's transcript is never one value; timings:
    video_id, chunk_num, tenths, which stand at the end of videos that have
    more than one chunk. Parts: 0 head, 1 transcript, 2 its end, 3 segments, 4
    and 5 timings.
    """
    length = F.coalesce(format_cs(F.col("duration_cs")), _lit("N/A"))
    head = videos.select(
        "video_id", _line(0),
        _numbered([
            _lit("FINAL TRANSCRIPTION SUMMARY"), _lit(HEAVY), _lit(""), F.concat(_lit("Video: "), F.coalesce("path", _lit(""))), F.concat(_lit("Model used: "), F.coalesce("model", _lit("N/A"))),
            F.concat(_lit("Language detected: "), F.coalesce("language", _lit("N/A"))), F.concat(_lit("Video Length: "), length), _lit(""), _lit("Full transcript:"), _lit(LIGHT),
        ]).alias("line_no", "line"),
    )
    below = videos.select("video_id", _line(2), _numbered([_lit(""), _lit(""), _lit("Segments with timestamps:"), _lit(LIGHT)]).alias("line_no", "line"))
    body = segs.select("video_id", _line(3), F.col("seg_index").alias("line_no"), segment_line(F.col("start_cs"), F.coalesce("end_cs", "start_cs"), F.col("text")).alias("line"))
    total = timings.groupBy("video_id").agg(F.sum("tenths").alias("t"), F.count("*").alias("n"))
    tail = total.select("video_id", _line(4), _numbered([_lit(""), _lit("PROCESSING INFORMATION"), _lit(LIGHT), F.concat(_lit("Total processing time: "), one_decimal(F.col("t")), _lit(" seconds"))]).alias("line_no", "line"))
    per = timings.join(total.where("n > 1").select("video_id"), "video_id", "left_semi").select("video_id", _line(5), F.col("chunk_num").alias("line_no"), F.concat(_lit("Chunk "), F.col("chunk_num").cast("string"), _lit(" processing time: "), one_decimal(F.col("tenths")), _lit(" seconds")).alias("line"))
    out = _text_lines(texts, 1)
    for lines in (head, below, body, tail, per):
        out = out.unionByName(lines.withColumn("line_no", F.col("line_no").cast("bigint")))
    return out


def _text_lines(texts: DataFrame, part: int) -> DataFrame:
    """Each chunk's text as a line with an empty one after it, numbered by chunk."""
    said = texts.select("video_id", "chunk_num", _line(part), F.posexplode(F.array(F.coalesce("text", _lit("")), _lit(""))).alias("i", "line"))
    return said.select("video_id", "part", (F.col("chunk_num") * 2 + F.col("i")).cast("bigint").alias("line_no"), "line")


def suggested_reels(suggestions: DataFrame, key: str, media: str = "path") -> DataFrame:
    """Lines of the suggestions file: key, item, line_no, line of rows key, item (from 1), time_range, reason, path. A text without suggestions has no file."""
    return suggestions.select(
        key, "item",
        _numbered([
            F.concat(_lit("SEGMENT "), F.col("item").cast("string")), F.concat(_lit("Time: "), F.col("time_range")), F.concat(_lit("Why: "), F.col("reason")), _lit(""),
            F.concat(_lit("Cut: --video "), F.coalesce(media, _lit("")), _lit(' --ranges "'), canonical_range(F.col("time_range")), _lit('"')), _lit(SINGLE), _lit(""),
        ]).alias("line_no", "line"),
    )


def _bullets(topics: str) -> Column:
    return F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.concat(_lit("  • "), t))


def _titled(title: Column, lines: Column) -> Column:
    """A section's title, its lines and an empty line; nothing where it has no lines."""
    return F.when(F.size(lines) > 0, F.flatten(F.array(F.array(title), lines, F.array(_lit(""))))).otherwise(F.array().cast("array<string>"))


def _one(c: str) -> Column:
    """A text as a list of one, an empty list where it is missing or empty."""
    return F.when(F.coalesce(c, _lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def progressive_summary(chunks: DataFrame, whole: DataFrame, updated_at: Column, model: str = "model") -> DataFrame:
    """Lines of the progressive summary: video_id, part, chunk_num, line_no, line.

    chunks: video_id, chunk_num, summary, topics, reels (array of
    struct(time_range, reason), the first is shown), total_chunks. whole:
    video_id, summary, topics, reels, hashtags over all chunks so far. Parts: 0
    head, 1 the newest chunk, 2 the analysis of the whole, 3 the archive: the
    chunks before, newest first. Rendered from rows, so what was written before
    isn't read again. A section that has nothing is left out, and so is the
    archive of a video of one chunk.
    """
    tops = chunks.groupBy("video_id").agg(F.max("chunk_num").alias("newest"), F.max("total_chunks").alias("total"))
    number = F.col("newest").cast("string")
    out = ["video_id", "part", F.col("chunk_num").cast("bigint").alias("chunk_num"), F.posexplode("block").alias("line_no", "line")]
    head = tops.select(
        "video_id", _line(0), F.col("newest").alias("chunk_num"),
        F.array(
            _lit("AI CONTENT ANALYSIS (Real-Time)"), F.concat(_lit("Updated after: Chunk "), number, _lit(" of "), F.col("total").cast("string")),
            F.concat(_lit("Last update: "), F.date_format(updated_at, "yyyy-MM-dd HH:mm:ss")), _lit(f"Generated with: {model}"), _lit(DOUBLE), _lit(""),
        ).alias("block"),
    )
    start = chunk_start_cs(F.col("chunk_num"))
    first = F.transform(F.slice(F.coalesce("reels", F.array().cast("array<struct<time_range:string,reason:string>>")), 1, 1), lambda r: F.concat(_lit("  "), r["time_range"], _lit(" - "), r["reason"]))
    block = F.flatten(F.array(
        F.array(F.concat(_lit("CHUNK "), F.col("chunk_num").cast("string"), _lit(" ANALYSIS (Individual)")), F.concat(_lit("Time: "), format_cs(start), _lit(" - "), format_cs(start + 12_000)), _lit(SINGLE)),
        F.transform(_one("summary"), lambda x: F.concat(_lit("Summary: "), x)), F.when(F.size(_one("summary")) > 0, F.array(_lit(""))).otherwise(F.array().cast("array<string>")),
        _titled(_lit("Topics:"), _bullets("topics")), _titled(_lit("Reel Suggestion:"), first),
    ))
    joined = chunks.join(tops, "video_id").withColumn("block", block).withColumn("part", F.when(F.col("chunk_num") == F.col("newest"), 1).otherwise(3).cast("int"))
    rule = F.array(_lit(DOUBLE), _lit(""))
    joined = joined.withColumn("block", F.when(F.col("part") == 1, F.concat("block", rule)).otherwise(F.col("block")))
    reels = F.transform(F.coalesce("reels", F.array().cast("array<struct<time_range:string,reason:string>>")), lambda r, i: F.concat(_lit("  "), (i + 1).cast("string"), _lit(". "), r["time_range"], _lit(" - "), r["reason"]))
    tags = F.coalesce("hashtags", F.array().cast("array<string>"))
    of_all = whole.join(tops, "video_id").select(
        "video_id", _line(2), F.col("newest").alias("chunk_num"),
        F.concat(
            F.array(F.concat(_lit("CUMULATIVE ANALYSIS (Chunks 1-"), number, _lit(")")), _lit(SINGLE)), _titled(_lit("Overall Summary:"), _one("summary")), _titled(_lit("All Topics:"), _bullets("topics")),
            _titled(F.concat(_lit("Best Reel Suggestions (Top "), F.size(reels).cast("string"), _lit("):")), reels),
            _titled(_lit("Suggested Hashtags:"), F.when(F.size(tags) > 0, F.array(F.concat(_lit("  "), F.array_join(tags, " ")))).otherwise(F.array().cast("array<string>"))), rule,
        ).alias("block"),
    )
    archive = joined.where("part = 3").select("video_id").distinct().select("video_id", _line(3), F.lit(None).cast("bigint").alias("chunk_num"), F.array(_lit("PREVIOUS CHUNKS"), _lit(SINGLE)).alias("block"))
    result = head.select(*out)
    for lines in (joined, of_all, archive):
        result = result.unionByName(lines.select(*out))
    return result


def filter_graph(ranges: Column) -> Column:
    """Filter graph that trims ranges (array of struct(start, end), seconds) and joins them in the order given; null without ranges."""
    def at(seconds: Column) -> Column:
        cs = to_cs(seconds)
        return F.concat(F.floor(cs / 100).cast("string"), _lit("."), F.lpad((cs % 100).cast("string"), 2, "0"))

    video = F.transform(ranges, lambda r, i: F.format_string("[0:v]trim=start=%s:end=%s,setpts=PTS-STARTPTS[v%d];[0:a]atrim=start=%s:end=%s,asetpts=PTS-STARTPTS[a%d]", at(r["start"]), at(r["end"]), i, at(r["start"]), at(r["end"]), i))
    labels = F.array_join(F.transform(ranges, lambda r, i: F.format_string("[v%d][a%d]", i, i)), "")
    return F.when(F.size(ranges) > 0, F.concat(F.array_join(video, ";"), _lit(";"), labels, F.format_string("concat=n=%d:v=1:a=1[outv][outa]", F.size(ranges))))


def captions(segs: DataFrame, form: str = "srt") -> DataFrame:
    """video_id, n, line: SubRip or WebVTT cues of segments with text and an end after their start, numbered in order."""
    from ..operators.sweep import with_running_sum

    clock = {"srt": srt_time, "vtt": vtt_time}[form]
    good = segs.where((strip(F.coalesce("text", _lit(""))) != "") & (F.col("end_cs") > F.col("start_cs")))
    n = with_running_sum(good, ["video_id"], ["start_cs", "seg_index"], F.lit(1).cast("bigint"), 60_000, "n")
    head = [F.col("n").cast("string")] if form == "srt" else []
    return n.select("video_id", "n", F.concat_ws("\n", *head, F.concat(clock(F.col("start_cs")), _lit(" --> "), clock(F.col("end_cs"))), strip(F.col("text")), _lit("")).alias("cue"))


def unique_names(wanted: DataFrame, existing: DataFrame, base: str = "base", name: str = "name") -> DataFrame:
    """base, chosen: the base name if it is free, else with the least of _2, _3, ... that is.

    Taken are the existing names and, with a counter, the other names wanted.
    A taken name can be in the way of two bases only: itself, and what it is
    without a counter at its end. Repeated wanted names get one name.
    """
    bases = wanted.where(F.col(base).isNotNull()).select(F.col(base).alias("__base")).distinct()
    names = existing.where(F.col(name).isNotNull()).select(F.col(name).alias("__name"))
    counter = r"^(.*)_([1-9][0-9]{0,8})$"
    counted = names.unionByName(bases.select(F.col("__base").alias("__name"))).select(F.regexp_extract("__name", counter, 1).alias("__base"), F.regexp_extract("__name", counter, 2).try_cast("bigint").alias("__n"))
    taken = names.select(F.col("__name").alias("__base"), F.lit(1).cast("bigint").alias("__n")).unionByName(counted.where("__n >= 2")).distinct()
    # The least number from 1 that isn't taken is the first that its rank among the taken ones passes by.
    rank = F.row_number().over(Window.partitionBy("__base").orderBy("__n"))
    free = bases.join(taken, "__base").withColumn("__r", rank).groupBy("__base").agg(F.coalesce(F.min(F.when(F.col("__n") > F.col("__r"), F.col("__r"))), F.max("__r") + 1).alias("__free"))
    both = bases.join(free, "__base", "left")
    return both.select(F.col("__base").alias(base), F.when(F.col("__free") > 1, F.concat("__base", _lit("_"), F.col("__free").cast("string"))).otherwise(F.col("__base")).alias("chosen"))


def run_directory_name(started: Column, path: Column, collides: Column | None = None) -> Column:
    """``DATE_TIME_Name`` of a run, with microseconds where the name is taken."""
    from ..functions.text import sanitized_stem

    plain = F.date_format(started, "yyyy-MM-dd_HHmmss")
    stamp = plain if collides is None else F.when(collides, F.date_format(started, "yyyy-MM-dd_HHmmss_SSSSSS")).otherwise(plain)
    return F.concat(stamp, _lit("_"), sanitized_stem(path))


def chunk_file_name(chunk: Column, kind: str = "") -> Column:
    """``chunk_NN.txt``, or ``chunk_NN_kind.txt``: two digits or more."""
    return F.concat(_lit("chunk_"), padded(chunk), _lit(f"_{kind}.txt" if kind else ".txt"))


def write_files(frame: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """One text file a key: lines of a key meet in one task in order. A key is one report, bounded by its medium."""
    frame.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, F.col("line").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def write_named(frame: DataFrame, path: str, name: str, order: list[str]) -> DataFrame:
    """One text file of each ``name`` (which may hold folders) under a folder all executors share: name, n_lines of what was written.

    The lines of a name meet in one task in order and are written as they
    come, to a file of the task's own that is moved into place when it is
    whole, so a task that runs twice leaves one file. Null names have none.
    """
    kind = frame.schema[name].dataType.simpleString()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        own, current, out, n, done = uuid.uuid4().hex, None, None, 0, []

        def close() -> None:
            out.close()
            system.move(f"{base}/{current}.{own}", f"{base}/{current}")
            done.append((current, n))

        for b in batches:
            for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != current:
                    if out:
                        close()
                    current, n = file, 0
                    system.create_dir(f"{base}/{file}".rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(f"{base}/{file}.{own}")
                out.write(((line or "") + "\n").encode())
                n += 1
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "n_lines"])

    if kind != "string":
        raise ValueError("a file's name has to be a string")
    rows = frame.where(F.col(name).isNotNull()).repartition(name).sortWithinPartitions(name, *order).select(name, "line")
    result = rows.mapInArrow(written, "name string, n_lines bigint")
    # Written once, here; what comes back is a table and doesn't write again.
    at = shared_folder(frame.sparkSession)
    result.write.parquet(at)
    return frame.sparkSession.read.schema(result.schema).parquet(at)


def reel_metadata(reels: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines of a reel's metadata file: reel_id, part, line_no, line of reels (reel_id, title, narrative, path, run, total_s) and their parts (reel_id, part_no, time_range, reason)."""
    n = parts.groupBy("reel_id").agg(F.count("*").alias("__n"))
    text = lambda c: F.coalesce(c, _lit(""))
    head = reels.join(n, "reel_id", "left").select(
        "reel_id", _line(0),
        _numbered([
            _lit("AUTO-GENERATED REEL METADATA"), _lit(WIDE), _lit(""), F.concat(_lit("Source Video: "), text("path")), F.concat(_lit("Transcription Results: "), text("run")),
            F.concat(_lit("Duration: "), F.col("total_s").cast("string"), _lit("s")), F.concat(_lit("Parts: "), F.coalesce("__n", _lit(0)).cast("string")), _lit(""),
            F.concat(_lit("Title: "), text("title")), F.concat(_lit("Narrative: "), text("narrative")), _lit(""), _lit("SEGMENTS:"),
        ]).alias("line_no", "line"),
    )
    body = parts.select("reel_id", _line(1), F.col("part_no").cast("int").alias("line_no"), F.concat(F.col("part_no").cast("string"), _lit(". "), F.col("time_range"), _lit(" - "), text("reason")).alias("line"))
    return head.unionByName(body)


def hundredths(milli: Column) -> Column:
    """Thousandths as a number of two decimals, the half up."""
    c = F.floor((milli + 5) / 10)
    return F.concat(F.floor(c / 100).cast("string"), _lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def analysis_report(histogram: DataFrame, top: DataFrame, key: list[str]) -> DataFrame:
    """Lines of the analysis report: key, part, line_no, line of a histogram (key, bin, n) and the top segments (key, rank_no, score_milli, start_cs, end_cs, text). Without top segments their section is left out."""
    title = histogram.select(*key).distinct().select(*key, _lit("0").cast("int").alias("part"), _numbered([_lit("=== DETAILED ANALYSIS REPORT ==="), _lit(""), _lit("SCORE DISTRIBUTION")]).alias("line_no", "line"))
    bins = histogram.select(*key, _lit("1").cast("int").alias("part"), (F.substring("bin", 3, 1).cast("int")).alias("line_no"), F.concat(_lit("  "), "bin", _lit(": "), F.col("n").cast("string"), _lit(" segments")).alias("line"))
    heads = top.select(*key).distinct().select(*key, _lit("2").cast("int").alias("part"), _numbered([_lit(""), _lit("TOP SEGMENTS")]).alias("line_no", "line"))
    whole = lambda c: F.when(c >= 0, F.regexp_replace(format_cs(c), r"\.\d\d$", "")).otherwise("N/A")
    shown = F.when(F.length("text") > 100, F.concat(F.left("text", F.lit(100)), _lit("..."))).otherwise(F.col("text"))
    body = F.array(
        F.concat(F.col("rank_no").cast("string"), _lit(". Score: "), hundredths(F.col("score_milli")), _lit(" | "), whole(F.col("start_cs")), _lit("-"), whole(F.col("end_cs"))),
        F.concat(_lit("   Text: "), F.coalesce(shown, _lit(""))),
    )
    items = top.select(*key, _lit("3").cast("int").alias("part"), "rank_no", F.posexplode(body).alias("i", "line")).select(*key, "part", (F.col("rank_no") * 2 + F.col("i")).cast("int").alias("line_no"), "line")
    return title.unionByName(bins).unionByName(heads).unionByName(items)


def run_summary(summary: DataFrame, key: list[str]) -> DataFrame:
    """Lines of the run summary of rows key, total, high, success_permille, avg_milli, min_milli, max_milli."""
    return summary.select(
        *key,
        _numbered([
            _lit("=== CONTENT EXTRACTION SUMMARY ==="), F.concat(_lit("Total Segments: "), F.col("total").cast("string")), F.concat(_lit("High-Value Segments: "), F.col("high").cast("string")),
            F.concat(_lit("Success Rate: "), one_decimal(F.col("success_permille")), _lit("%")), F.concat(_lit("Average Score: "), F.coalesce(hundredths(F.col("avg_milli")), _lit("N/A"))),
            F.concat(_lit("Score Range: "), F.coalesce(hundredths(F.col("min_milli")), _lit("N/A")), _lit(" - "), F.coalesce(hundredths(F.col("max_milli")), _lit("N/A"))),
        ]).alias("line_no", "line"),
    )


def analysis_files(analyses: DataFrame, key: str, model: str = "model") -> DataFrame:
    """Lines of the two files of one analysis of a whole text: key, file ('summary' or 'reels'), part, line_no, line of rows key, name, summary, topics, hashtags, reels (array of struct(time_range, reason)). An analysis without reels says so."""
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    reels = F.coalesce("reels", F.array().cast("array<struct<time_range:string,reason:string>>"))
    titled = lambda title, lines: F.concat(F.array(_lit(title), _lit(SINGLE)), lines, F.array(_lit("")))
    summary = F.concat(
        F.array(_lit("AI CONTENT ANALYSIS"), _lit(f"Generated with: {model}"), _lit(DOUBLE), _lit("")), titled("SUMMARY", F.array(F.coalesce("summary", _lit("")))),
        titled("MAIN TOPICS", F.transform(strings("topics"), lambda t: F.concat(_lit("• "), t))), titled("SUGGESTED HASHTAGS", F.array(F.array_join(strings("hashtags"), " "))),
    )
    head = F.array(_lit("SUGGESTED REEL SEGMENTS"), _lit("AI-identified engaging moments for short-form content"), _lit(DOUBLE), _lit(""))
    one = lambda r, i: F.array(
        F.concat(_lit("SEGMENT "), (i + 1).cast("string")), F.concat(_lit("Time: "), r["time_range"]), F.concat(_lit("Why: "), r["reason"]), _lit(""),
        F.concat(_lit("Cut: --video "), F.coalesce("name", _lit("")), _lit(' --ranges "'), F.replace(r["time_range"], _lit(" - "), _lit("-")), _lit('"')), _lit(SINGLE), _lit(""),
    )
    none = F.array(_lit("No specific reel segments identified."), _lit("Try cutting interesting moments manually."))
    suggested = F.concat(head, F.when(F.size(reels) > 0, F.flatten(F.transform(reels, one))).otherwise(none))
    files = F.array(F.struct(_lit("summary").alias("file"), summary.alias("l")), F.struct(_lit("reels").alias("file"), suggested.alias("l")))
    return analyses.select(key, F.explode(files).alias("f")).select(key, "f.file", F.posexplode("f.l").alias("line_no", "line"))


def digest_entry() -> Column:
    """A chunk's summary as a prompt takes it."""
    return F.concat(_lit("Chunk "), F.col("chunk").cast("string"), _lit(" ["), "time_range", _lit("]\n"), "summary", _lit("\n"))


def chunk_digest(summaries: DataFrame, key: str) -> DataFrame:
    """key, digest: the chunks' summaries of a report in order, as one prompt, for reports that fit one; ``digest_entry`` makes one of each row."""
    from ..operators.chunks import ordered_text

    one = digest_entry()
    return summaries.groupBy(key).agg(ordered_text(one, F.col("chunk"), F.col("time_range"), sep="\n").alias("digest"))
