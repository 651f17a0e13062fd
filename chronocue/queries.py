"""Queries of the core operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import timecode as tc
from .models import adapters
from .operators import chunks, scoring, selection, speakers, topics, windows
from .operators.intervals import merged
from .operators.ranks import best_rows
from .plans import sections
from .session import shared_folder
from .sinks import render
from .sources import media, reports
from .sources.tables import table, table_stream
from .streaming import chunks as chunk_streams
from .streaming import intervals as interval_streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL it is held against."""

    def registered(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return registered


@query(
    """with c as (
         select distinct video_id, cast(round(start_seconds * 100) as bigint) a, cast(round(end_seconds * 100) as bigint) b
         from results_qwen15b
         where video_id is not null and not isnan(start_seconds) and not isnan(end_seconds)),
       d as (select *, max(b) over (partition by video_id order by a, b rows between unbounded preceding and 1 preceding) m from c where b > a),
       e as (select *, sum(case when m is null or a > m then 1 else 0 end) over (partition by video_id order by a, b rows unbounded preceding) i from d),
       p as (select video_id, i, min(a) f, max(b) t from e group by 1, 2),
       g as (select video_id, lag(t) over (partition by video_id order by i) f, f t from p)
       select video_id, 'period' as kind, f as from_cs, t as to_cs from p
       union all select video_id, 'gap', f, t from g where f is not null"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of every video and the gaps between them."""
    return merged(table(spark, d, "results_qwen15b"), "video_id", "start_seconds", "end_seconds").select("video_id", "kind", "from_cs", "to_cs")


REPORTS = "reels_extraction_20250825_215033_complete"

# SQL of the segments that most queries below begin with.
SEG = """seg as (
  select video_id, seg_index, start_cs, end_cs, text from (
    select *, row_number() over (partition by video_id, seg_index order by row_id) n from (
      select row_id, video_id, seg_index, cast(round(start_time * 100) as bigint) start_cs, cast(round(end_time * 100) as bigint) end_cs,
             replace(translate(text, chr(8234) || chr(8235) || chr(8236) || chr(8207) || chr(8206), ''), '[PAD]', '') as text
      from results_simplified where video_id is not null and seg_index is not null and start_time is not null)) where n = 1),
chunked as (select *, start_cs // 12000 + 1 as chunk_num, start_cs % 12000 as rel_start_cs, end_cs - start_cs // 12000 * 12000 as rel_end_cs from seg)"""
CS = lambda c: f"({c} // 6000) || ':' || lpad(cast({c} % 6000 // 100 as varchar), 2, '0') || '.' || lpad(cast({c} % 100 as varchar), 2, '0')"
CLOCK = lambda c, p: f"lpad(cast({c} // 360000 as varchar), cast(greatest(2, len(cast({c} // 360000 as varchar))) as int), '0') || ':' || lpad(cast({c} // 6000 % 60 as varchar), 2, '0') || ':' || lpad(cast({c} // 100 % 60 as varchar), 2, '0') || '{p}' || lpad(cast({c} % 100 * 10 as varchar), 3, '0')"
STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\pZ\\x0b\\x85]+|[\\s\\pZ\\x0b\\x85]+$', '', 'g')"
WORDS = lambda c: f"len(list_filter(string_split_regex({c}, '[ \\n\\t\\r]+'), lambda w: w <> ''))"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return chunks.segments(table(spark, d, "results_simplified"), measures=True)


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return chunks.assigned(_segments(spark, d))


# Time codes


@query(
    """select line_id, case when cast(split_part(start_label, ':', 1) as int) is not null then
         cast(round((cast(split_part(start_label, ':', 1) as int) * 60 + cast(split_part(start_label, ':', 2) as double)) * 100) as bigint) end as cs
       from full_transcript where start_label is not null"""
)
def timecode_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "full_transcript").where("start_label is not null").select("line_id", tc.to_cs(tc.parse_timestamp(F.col("start_label"))).alias("cs"))


@query(f"with {SEG} select video_id, seg_index, {CS('start_cs')} as label from seg")
def timecode_format(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("video_id", "seg_index", tc.format_cs(F.col("start_cs")).alias("label"))


@query(
    f"""with {SEG}, lists as (select video_id, chunk_num, string_agg({CS('start_cs')} || '-' || {CS('end_cs')}, ', ' order by start_cs, seg_index) l from chunked where end_cs is not null group by 1, 2),
        parts as (select video_id, chunk_num, unnest(string_split(l, ', ')) p, unnest(range(1, len(string_split(l, ', ')) + 1)) pos from lists),
        ab as (select *, split_part(p, '-', 1) a, split_part(p, '-', 2) b from parts),
        n as (select *, cast(split_part(a, ':', 1) as bigint) * 6000 + cast(round(cast(split_part(a, ':', 2) as double) * 100) as bigint) x,
              cast(split_part(b, ':', 1) as bigint) * 6000 + cast(round(cast(split_part(b, ':', 2) as double) * 100) as bigint) y from ab)
        select video_id, chunk_num, pos, p as range_text, case when x < y then x end as from_cs, case when x < y then y end as to_cs from n"""
)
def range_list_explode(spark: SparkSession, d: str) -> DataFrame:
    """Range lists, one a chunk, taken apart and read."""
    c = _chunked(spark, d).where("end_cs is not null")
    one = F.concat(tc.format_cs(F.col("start_cs")), F.lit("-"), tc.format_cs(F.col("end_cs")))
    lists = c.groupBy("video_id", "chunk_num").agg(chunks.ordered_text(one, F.col("start_cs"), F.col("seg_index"), sep=", ").alias("l"))
    x = lists.select("video_id", "chunk_num", F.explode(tc.range_list(F.col("l"))).alias("x"))
    return x.select("video_id", "chunk_num", F.col("x.pos").cast("bigint").alias("pos"), F.col("x.text").alias("range_text"), tc.to_cs(F.col("x.start")).alias("from_cs"), tc.to_cs(F.col("x.end")).alias("to_cs"))


@query("select row_id, replace(translate(text, chr(8234) || chr(8235) || chr(8236) || chr(8207) || chr(8206), ''), '[PAD]', '') as text from results_simplified")
def rtl_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results_simplified").select("row_id", tx.clean_rtl(F.col("text")).alias("text"))


@query("select video_id, case when duration is null or isnan(duration) then null when duration <= 120 then 1 else cast(ceil(duration / 120) as bigint) end as n_chunks, round(size_mb, 1) as size_mb from videos")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "videos").select("video_id", tc.chunk_count(F.col("duration")).alias("n_chunks"), F.round("size_mb", 1).alias("size_mb"))


# Chunks


@query(f"with {SEG} select video_id, seg_index, chunk_num, rel_start_cs, rel_end_cs from chunked")
def chunk_assign(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).select("video_id", "seg_index", "chunk_num", "rel_start_cs", "rel_end_cs")


@query(f"with {SEG} select video_id, seg_index, start_cs, end_cs from seg")
def segment_rebase(spark: SparkSession, d: str) -> DataFrame:
    """Times of segments after taking the chunk's start off and adding it again."""
    c = _chunked(spark, d).select("video_id", "seg_index", "chunk_num", "rel_start_cs", "rel_end_cs")
    return chunks.rebased(c).select("video_id", "seg_index", "start_cs", "end_cs")


@query(
    f"""with {SEG} select video_id, chunk_num, count(*) as n_segments, cast(sum(greatest(end_cs - start_cs, 0)) as bigint) as spoken_cs,
        cast(sum(len(coalesce(text, ''))) as bigint) as text_length, min(start_cs) as first_cs, max(start_cs) as last_cs from chunked group by 1, 2"""
)
def chunk_rollup(spark: SparkSession, d: str) -> DataFrame:
    return chunks.rollup(_chunked(spark, d))


@query(f"with {SEG} select video_id, chunk_num, string_agg(coalesce(text, ''), '' order by start_cs, seg_index) as text from chunked group by 1, 2")
def chunk_text_concat(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_texts(_chunked(spark, d))


@query(f"with {SEG}, n as (select video_id, chunk_num, sum(len(coalesce(text, ''))) + 2 l from chunked group by 1, 2) select video_id, chunk_num, cast(sum(l) over (partition by video_id order by chunk_num) as bigint) as total_length from n")
def cumulative_text_len(spark: SparkSession, d: str) -> DataFrame:
    return chunks.cumulative_length(_chunked(spark, d))


@query(f"with {SEG}, t as (select video_id, chunk_num, string_agg(coalesce(text, ''), '' order by start_cs, seg_index) || chr(10) || chr(10) as part from chunked group by 1, 2) select video_id, row_number() over (partition by video_id order by chunk_num) as part_no, chunk_num, part from t")
def transcript_parts(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of every video as ordered parts."""
    return chunks.transcript(chunks.chunk_texts(_chunked(spark, d)))


@query(
    f"""with {SEG}, t as (select video_id, chunk_num, string_agg(coalesce(text, ''), '' order by start_cs, seg_index) || chr(10) || chr(10) as part from chunked group by 1, 2)
        select video_id, chunk_num, left(string_agg(part, '') over w, 3000) as so_far, cast(sum(len(part)) over w as bigint) as total_length from t window w as (partition by video_id order by chunk_num rows unbounded preceding)"""
)
def cumulative_text(spark: SparkSession, d: str) -> DataFrame:
    """The head of every video's text up to and with each chunk, as a prompt takes it, and its whole length."""
    return chunks.so_far(chunks.chunk_texts(_chunked(spark, d)))


@query("select video_id, arg_min(primary_language, (chunk_num, row_id)) as primary_language from results_simplified where video_id is not null and primary_language is not null and chunk_num is not null group by 1")
def first_language(spark: SparkSession, d: str) -> DataFrame:
    """The language of every video: that of its first chunk that names one."""
    return chunks.first_value(table(spark, d, "results_simplified").where("chunk_num is not null"), "video_id", "primary_language", "chunk_num", "row_id")


@query(
    f"""with {SEG} select video_id, seg_index, cast(sum(len(coalesce(text, ''))) over (partition by video_id order by start_cs, seg_index rows unbounded preceding) - len(coalesce(text, '')) + 2 * (dense_rank() over (partition by video_id order by chunk_num) - 1) as bigint) as text_offset from chunked"""
)
def transcript_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where in its video's whole transcript the text of each segment begins: the transcript as a table, whatever its length."""
    return chunks.offsets(_chunked(spark, d)).select("video_id", "seg_index", "text_offset")


@query(
    """with p as (select distinct video_id, chunk_num from full_transcript where video_id is not null and chunk_num is not null),
       m as (select video_id, max(chunk_num) m from p group by 1), a as (select video_id, cast(unnest(generate_series(1, m)) as bigint) chunk_num from m)
       select a.video_id, a.chunk_num, p.chunk_num is not null as present from a left join p on a.video_id = p.video_id and a.chunk_num = p.chunk_num"""
)
def chunk_gap_join(spark: SparkSession, d: str) -> DataFrame:
    return chunks.with_gaps(table(spark, d, "full_transcript"))


@query(
    f"""with {SEG}, r as (select video_id, window_no, t0 + window_no * 3500 as ws from (select video_id, t0, unnest(generate_series(0, (t1 - t0) // 3500)) window_no from (select video_id, min(start_cs) t0, max(start_cs) t1 from seg group by 1)))
        select s.video_id, s.seg_index, cast(r.window_no as bigint) as window_no from seg s join r on s.video_id = r.video_id and s.start_cs >= r.ws and s.start_cs < r.ws + 4500"""
)
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Segments with every range that holds their start; each video has ranges up to its last start."""
    s = _segments(spark, d)
    r = s.groupBy("video_id").agg(F.min("start_cs").alias("t0"), F.max("start_cs").alias("t1"))
    r = r.select("video_id", "t0", F.explode(F.expr("sequence(0L, (t1 - t0) div 3500)")).alias("window_no"))
    r = r.select("video_id", "window_no", (F.col("t0") + F.col("window_no") * 3500).alias("ws"), (F.col("t0") + F.col("window_no") * 3500 + 4500).alias("we"))
    return chunks.range_joined(s, r, ["video_id"], "start_cs", "ws", "we", 4500).select("video_id", "seg_index", "window_no")


@query(
    """with l as (select video_id, line_id, text, row_number() over (partition by video_id order by updated_at desc nulls last, line_id desc) n from full_transcript where video_id is not null)
       select video_id, line_id, text from l where n = 1"""
)
def latest_per_video(spark: SparkSession, d: str) -> DataFrame:
    return chunks.latest(table(spark, d, "full_transcript").select("video_id", "line_id", "text", "updated_at"), "video_id", "updated_at", "line_id").select("video_id", "line_id", "text")


@query(
    f"""with {SEG}, n as (select video_id, chunk_num, count(*) c from chunked group by 1, 2)
        select video_id, chunk_num, grouping(video_id, chunk_num) as level, cast(sum(c) as bigint) as n_segments from n group by rollup (video_id, chunk_num)"""
)
def rollup_levels(spark: SparkSession, d: str) -> DataFrame:
    """Segment counts by chunk, by video and in all."""
    n = _chunked(spark, d).groupBy("video_id", "chunk_num").agg(F.count("*").alias("c"))
    return n.rollup("video_id", "chunk_num").agg(F.grouping_id().alias("level"), F.sum("c").alias("n_segments"))


@query(
    r"""select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, count(*) as n_media, cast(sum(case when duration is null or isnan(duration) then 0 else floor(duration) end) as bigint) as seconds
       from videos where path is not null and regexp_matches(path, '\.(mp4|mov|avi|mkv|MP4|MOV|AVI|MKV)$') and not regexp_matches(path, '/(\.[^/]+|node_modules|venv|reels_extractor_env|__pycache__)/') group by 1"""
)
def media_by_folder(spark: SparkSession, d: str) -> DataFrame:
    """Media files of each folder that holds any."""
    return media.media_folders(table(spark, d, "videos").select("path", "duration"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The videos' files as a listing has them: path, modified, length."""
    v = table(spark, d, "videos").where("path is not null")
    return v.select("path", F.to_timestamp(F.col("modified_date").try_cast("date")).alias("modified"), F.round(F.col("size_mb") * 1048576).cast("bigint").alias("length"))


@query(
    r"""select path, regexp_extract(path, '([^/]*)$', 1) as name, cast(null as double) as duration, cast(round(size_mb * 1048576) as bigint) / 1048576 as size_mb, strftime(try_cast(modified_date as date), '%Y-%m-%d') as modified_date
       from videos where path is not null and regexp_matches(path, '\.(mp4|mov|avi|mkv|MP4|MOV|AVI|MKV)$') and not regexp_matches(path, '/(\.[^/]+|node_modules|venv|reels_extractor_env|__pycache__)/')"""
)
def media_info(spark: SparkSession, d: str) -> DataFrame:
    """Name, size and date of every media file of a listing."""
    return media.media_info(_files(spark, d))


@query(r"select path, regexp_extract(path, '([^/]*)$', 1) as name from videos where path like '/data/in/%' and path not like '/data/in/%/%' and regexp_matches(path, '\.(mp4|mov|avi|mkv|MP4|MOV|AVI|MKV)$')")
def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """Media of one folder of a listing, not of those in it."""
    return media.media_info(media.in_folder(_files(spark, d), "/data/in")).select("path", "name")


@query(
    r"""select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder from videos where path is not null and try_cast(modified_date as date) is not null
       order by cast(modified_date as date) desc, folder desc limit 1"""
)
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The folder whose files changed last."""
    return media.latest_run(_files(spark, d).where("modified is not null")).where("folder is not null")


@query(r"select video_id, starts_with(regexp_extract(path, '([^/]*)$', 1), 'IMG_') and ends_with(path, '.MOV') and len(regexp_extract(path, '([^/]*)$', 1)) >= 8 as chosen from videos")
def files_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Whether each file's name begins and ends as asked."""
    return table(spark, d, "videos").select("video_id", media.named(F.col("path"), "IMG_", ".MOV").alias("chosen"))


@query("select video_id, cast(case when video_id % 5 = 0 then 0 when video_id % 5 = 4 then 359 else abs(90 * (video_id % 5) - 450) % 360 end as int) as rotation from videos")
def probed_rotations(spark: SparkSession, d: str) -> DataFrame:
    """Rotations out of what a probe prints for each video: a number with a fraction and line end, or nothing, or words."""
    k = F.col("video_id") % 5
    printed = F.when(k == 0, F.when(F.col("video_id") % 2 == 0, "").otherwise("N/A")).when(k == 4, F.lit(" -359.9\n")).otherwise(F.concat((k * 90 - 450).cast("string"), F.lit(".000\n")))
    return table(spark, d, "videos").select("video_id", media.probed_rotation(printed).alias("rotation"))


@query(
    """select video_id, 'ffmpeg -y -i ' || path || ' -vn -ac 1 -ar 16000 ' || path || '.wav' as audio,
       'ffprobe -v error -select_streams v:0 -show_entries stream_side_data=rotation -of default=noprint_wrappers=1:nokey=1 ' || path as probe from videos where path is not null"""
)
def media_commands(spark: SparkSession, d: str) -> DataFrame:
    """Arguments that extract each video's sound and print its rotation."""
    v = table(spark, d, "videos").where("path is not null")
    audio, probe = adapters.audio_command(F.col("path"), F.concat("path", F.lit(".wav"))), media.rotation_command(F.col("path"))
    return v.select("video_id", F.array_join(audio, " ").alias("audio"), F.array_join(probe, " ").alias("probe"))


@query(r"select video_id, replace(replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '([^.])\.[^.]*$', '\1'), ' ', '_'), '.', '-') as stem from videos")
def sanitized_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "videos").select("video_id", tx.sanitized_stem(F.col("path")).alias("stem"))


# Replies and reports, read by section. Lines are stripped of blanks of any kind.

LINES = r"""lines as (
  select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no,
         unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g'))) as line from documents where text is not null),
marked as (select *, case when contains(upper(line), 'SUMMARY:') then 'summary' when contains(upper(line), 'TOPICS:') then 'topics' when contains(upper(line), 'HASHTAGS:') then 'hashtags'
                          when contains(upper(line), 'REEL') and contains(upper(line), 'SEGMENT') then 'reels' end as h from lines),
filled as (select *, last_value(h ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as section from marked),
body as (select doc_id, line_no, section, line from filled where h is null and section is not null and line <> '')"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"with {LINES} select doc_id, section, count(*) as n_lines, min(line_no) as first_line, sha256(string_agg(line, chr(10) order by line_no)) as lines_sha from body group by 1, 2")
def section_fill(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every section of every document that has any."""
    s = sections.sectioned(_documents(spark, d), "doc_id", "text", sections.ANALYSIS)
    joined = chunks.ordered_text(F.col("line"), F.col("line_no"), sep="\n")
    return s.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.min("line_no").cast("bigint").alias("first_line"), F.sha2(joined, 256).alias("lines_sha"))


@query(
    f"""with {LINES}, t as (select *, regexp_replace(substr(line, 2), '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') as topic,
          regexp_extract(line, '^[^\\[\\]]*\\[([^\\]]*)\\]', 1) as inside, regexp_replace(regexp_extract(line, '^[^\\]]*\\](.*)$', 1), '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') as outside from body)
        select doc_id, coalesce(string_agg(line, ' ' order by line_no) filter (section = 'summary'), '') as summary,
               coalesce(string_agg(topic, '|' order by line_no) filter (section = 'topics' and substr(line, 1, 1) in ('-', '•') and topic <> ''), '') as topics,
               coalesce(string_agg(list_aggregate(list_filter(regexp_split_to_array(line, '[\\s\\pZ]+'), lambda x: starts_with(x, '#')), 'string_agg', ' '), ' ' order by line_no)
                 filter (section = 'hashtags' and len(list_filter(regexp_split_to_array(line, '[\\s\\pZ]+'), lambda x: starts_with(x, '#'))) > 0), '') as hashtags,
               coalesce(string_agg(regexp_replace(inside, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') || '=' || outside, '|' order by line_no) filter (section = 'reels' and len(string_split(inside, '-')) = 2), '') as reels
        from t group by 1"""
)
def section_parse_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Summary, topics, hashtags and reels of every document with a section."""
    p = sections.parse_analysis(_documents(spark, d), "doc_id", "text")
    reels = F.array_join(F.transform("reels", lambda x: F.concat(x["time_range"], F.lit("="), x["reason"])), "|")
    return p.select("doc_id", "summary", F.array_join("topics", "|").alias("topics"), F.array_join("hashtags", " ").alias("hashtags"), reels.alias("reels"))


@query(
    f"""with {SEG}, l as (select *, {CS('start_cs')} a, {CS('greatest(coalesce(end_cs, start_cs), start_cs)')} b from chunked where start_cs >= 0)
        select video_id * 100000 + chunk_num as reply_id, count(*) as n_lines, coalesce(string_agg(case when seg_index % 4 = 0 then a || ' - ' || b || '=said ' || seg_index else a || '-' || b || '=' end, '|' order by start_cs, seg_index) filter (seg_index % 4 in (0, 1)), '') as reels from l group by 1"""
)
def analysis_reels(spark: SparkSession, d: str) -> DataFrame:
    """The reel lines of an analysis reply written for every chunk and read again: in brackets with one hyphen, others are passed over."""
    c = _chunked(spark, d).where("start_cs >= 0")
    a, b, k = tc.format_cs(F.col("start_cs")), tc.format_cs(F.greatest(F.coalesce("end_cs", "start_cs"), "start_cs")), F.col("seg_index") % 4
    line = (
        F.when(k == 0, F.concat(F.lit("["), a, F.lit(" - "), b, F.lit("] said "), F.col("seg_index").cast("string"))).when(k == 1, F.concat(F.lit("  • [ "), a, F.lit("-"), b, F.lit(" ]")))
        .when(k == 2, F.concat(a, F.lit(" - "), b, F.lit("] early ["))).otherwise(F.concat(F.lit("["), a, F.lit("-"), b, F.lit("-x] three")))
    )
    g = c.groupBy((F.col("video_id") * 100000 + F.col("chunk_num")).alias("reply_id")).agg(F.count("*").alias("n"), chunks.ordered_text(line, F.col("start_cs"), F.col("seg_index"), sep="\n").alias("l"))
    replies = g.select("reply_id", "n", F.concat(F.lit("SUMMARY:\nshort\nREEL SEGMENTS:\n"), "l").alias("reply"))
    p = sections.parse_analysis(replies, "reply_id", "reply").join(replies.select("reply_id", "n"), "reply_id")
    return p.select("reply_id", F.col("n").alias("n_lines"), F.array_join(F.transform("reels", lambda x: F.concat(x["time_range"], F.lit("="), x["reason"])), "|").alias("reels"))


@query(
    f"""with {SEG}, t as (select video_id, chunk_num, count(*) n, cast(sum(greatest(coalesce(end_cs, start_cs) - start_cs, 0)) // 100 as int) total,
          string_agg({CS('start_cs')} || '-' || {CS('greatest(coalesce(end_cs, start_cs), start_cs)')}, '|' order by start_cs, seg_index) parts,
          string_agg(case seg_index % 3 when 0 then 'why ' || seg_index when 1 then 'Selected segment' else 'because' end, '|' order by start_cs, seg_index) reasons from chunked where start_cs >= 0 group by 1, 2)
        select video_id * 100000 + chunk_num as reply_id, n as n_parts, parts as ranges, reasons, total as total_duration, 'second line of ' || n as narrative, '' as title from t"""
)
def section_parse_selection(spark: SparkSession, d: str) -> DataFrame:
    """A selection reply written for every chunk and read again; text on a header's own line is dropped."""
    c = _chunked(spark, d).where("start_cs >= 0")
    end = F.greatest(F.coalesce("end_cs", "start_cs"), "start_cs")
    k = F.col("seg_index") % 3
    part = F.concat(F.lit("1. ["), tc.format_cs(F.col("start_cs")), F.lit("-"), tc.format_cs(end), F.when(k == 0, F.concat(F.lit("] - why "), F.col("seg_index").cast("string"))).when(k == 1, "]").otherwise(" because"))
    g = c.groupBy("video_id", "chunk_num").agg(F.count("*").alias("n"), F.floor(F.sum(end - F.col("start_cs")) / 100).alias("total"), chunks.ordered_text(part, F.col("start_cs"), F.col("seg_index"), sep="\n").alias("parts"))
    reply = F.concat(F.lit("Parts:\n"), "parts", F.lit("\nTotal_Duration: "), F.col("total").cast("string"), F.lit("s\nnot here\nNARRATIVE: lost\n second line of "), F.col("n").cast("string"), F.lit(" \nTITLE: lost too"))
    texts = g.select((F.col("video_id") * 100000 + F.col("chunk_num")).alias("reply_id"), reply.alias("reply"))
    p = sections.parse_selection(texts, "reply_id", "reply")
    return p.select("reply_id", F.size("parts").cast("bigint").alias("n_parts"), F.array_join(F.transform("parts", lambda x: x["time_range"]), "|").alias("ranges"), F.array_join(F.transform("parts", lambda x: x["reason"]), "|").alias("reasons"), "total_duration", "narrative", "title")


REGIONS = """l as (
  select doc_id, unnest(range(1, len(string_split(t, chr(10))) + 1)) as line_no, unnest(list_transform(string_split(t, chr(10)), lambda x: trim(x))) as line from (
    select chunk_id as doc_id, 'head' || chr(10) || 'Best Reel Suggestions' || chr(10) || parts || chr(10) || '═══' || chr(10) || '0:01-0:02 outside' || chr(10) || 'TOP REEL SUGGESTION:' || chr(10) || '9:00 - 9:30] - again' as t from (
      select video_id * 100000 + chunk_num as chunk_id, string_agg('[' || a || ' - ' || b || '] reason ' || seg_index, chr(10) order by start_cs, seg_index) as parts from (
        select *, %s as a, %s as b from chunked where start_cs >= 0) group by 1))),
m as (select *, case when contains(upper(line), 'REEL') and contains(upper(line), 'SUGGESTION') then 1 when starts_with(line, '═') then 0 end as mark from l),
f as (select *, last_value(mark ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as inside, sum(case when mark = 0 then 1 else 0 end) over (partition by doc_id order by line_no rows unbounded preceding) as closed from m),
s as (select doc_id, line_no, closed, regexp_extract(line, '([0-9]+:[0-9]+\\.?[0-9]*\\s*-\\s*[0-9]+:[0-9]+\\.?[0-9]*)', 1) as time_range, line from f where inside = 1 and mark is null)""" % (
    CS("start_cs"),
    CS("greatest(coalesce(end_cs, start_cs), start_cs)"),
)


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """A summary report with two suggestion sections for every chunk."""
    c = _chunked(spark, d).where("start_cs >= 0")
    part = F.concat(F.lit("["), tc.format_cs(F.col("start_cs")), F.lit(" - "), tc.format_cs(F.greatest(F.coalesce("end_cs", "start_cs"), "start_cs")), F.lit("] reason "), F.col("seg_index").cast("string"))
    g = c.groupBy((F.col("video_id") * 100000 + F.col("chunk_num")).alias("doc_id")).agg(chunks.ordered_text(part, F.col("start_cs"), F.col("seg_index"), sep="\n").alias("parts"))
    return g.select("doc_id", F.concat(F.lit("head\nBest Reel Suggestions\n"), "parts", F.lit("\n═══\n0:01-0:02 outside\nTOP REEL SUGGESTION:\n9:00 - 9:30] - again")).alias("text"))


@query(f"with {SEG}, {REGIONS} select doc_id, count(*) as n, min(time_range) as least, max(time_range) as greatest_range, sum(case when line_no > 0 and contains(line, 'again') then 1 else 0 end)::bigint as reopened from s where time_range <> '' group by 1")
def region_toggle_parse(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions of all sections of a report."""
    s = sections.suggestions(_reports(spark, d), "doc_id", "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("time_range").alias("least"), F.max("time_range").alias("greatest_range"), F.count_if(F.col("reason") == "] - again").alias("reopened"))


@query(f"with {SEG}, {REGIONS} select doc_id, line_no, time_range, regexp_replace(regexp_extract(line, '\\](.*)$', 1), '^ ', '') as reason from s where time_range <> '' and closed = 0")
def region_first_only(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions of a report's first section only."""
    s = sections.suggestions(_reports(spark, d), "doc_id", "text", first_only=True)
    return s.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "time_range", F.regexp_replace("reason", r"^\] ?", "").alias("reason"))


@query(f"with {SEG}, {REGIONS} select doc_id, line_no, time_range from (select *, row_number() over (partition by doc_id order by line_no) n from s where time_range <> '') where n = 1")
def first_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """The first suggestion of every report, which is taken where no selection is valid."""
    s = selection.first_suggestion(sections.suggestions(_reports(spark, d), "doc_id", "text"), "doc_id", "line_no")
    return s.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "time_range")


@query(
    r"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g'))) as line from documents where text is not null),
        m as (select *, case when contains(upper(line), 'TOPICS:') then 1 when starts_with(line, '═') or starts_with(line, 'Suggested Hashtags') then 0 end as t, case when contains(upper(line), 'REEL') and contains(upper(line), 'SUGGESTION') then 1 when starts_with(line, '═') then 0 end as r from l),
        f as (select *, last_value(t ignore nulls) over w as topic, last_value(r ignore nulls) over w as reel from m window w as (partition by doc_id order by line_no rows unbounded preceding)),
        g as (select doc_id, string_agg(regexp_replace(substr(line, 2), '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g'), '|' order by line_no) filter (topic = 1 and t is null and starts_with(line, '•')) as topics,
              count(*) filter (reel = 1 and r is null and regexp_matches(line, '[0-9]+:[0-9]+\.?[0-9]*\s*-\s*[0-9]+:[0-9]+\.?[0-9]*')) as n_reels from f group by 1)
        select d.doc_id, coalesce(g.topics, '') as topics, coalesce(n_reels, 0) as n_reels, coalesce(array_to_string(regexp_extract_all(regexp_extract(text, '(?m)^(.*?#[\p{L}\p{M}\p{N}_].*)$', 1), '(#[\p{L}\p{M}\p{N}_]+)', 1), ' '), '') as hashtags,
               case when instr(text, 'Overall Summary:') > 0 then regexp_replace(coalesce(string_split(substr(text, instr(text, 'Overall Summary:'), 500), chr(10))[2], ''), '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') else '' end as cumulative_summary
        from documents d left join g on d.doc_id = g.doc_id where d.text is not null"""
)
def summary_records(spark: SparkSession, d: str) -> DataFrame:
    """Every document read as a summary file, as one record."""
    r = sections.summary_record(_documents(spark, d), "doc_id", "text")
    return r.select("doc_id", F.array_join("topics", "|").alias("topics"), F.size("reel_suggestions").cast("bigint").alias("n_reels"), F.array_join("hashtags", " ").alias("hashtags"), "cumulative_summary")


@query(
    f"""with {SEG}, {REGIONS} select doc_id, string_agg(time_range || '=' || regexp_replace(regexp_extract(line, '\\](.*)$', 1), '^ ', ''), '|' order by line_no) as reels from s where time_range <> '' group by 1"""
)
def summary_record_reels(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions in the record of a summary file written for every chunk."""
    r = sections.summary_record(_reports(spark, d), "doc_id", "text")
    one = F.transform("reel_suggestions", lambda x: F.concat(x["time_range"], F.lit("="), F.regexp_replace(x["reason"], r"^\] ?", "")))
    return r.where(F.size("reel_suggestions") > 0).select("doc_id", F.array_join(one, "|").alias("reels"))


@query(
    f"""with {SEG}, p as (select *, row_number() over (partition by video_id, chunk_num order by start_cs, seg_index) i, max(case when seg_index % 50 = 49 then start_cs * 100000 + seg_index end) over (partition by video_id, chunk_num) as x,
          min(case when seg_index % 50 = 49 then start_cs * 100000 + seg_index end) over (partition by video_id, chunk_num) as stop from chunked where start_cs >= 0)
        select video_id * 100000 + chunk_num as paste_id, row_number() over (partition by video_id, chunk_num order by start_cs, seg_index) as pos, {CS('start_cs')} || '-' || {CS('end_cs')} as time_range, start_cs / 100 as start, end_cs / 100 as end
        from p where (stop is null or start_cs * 100000 + seg_index < stop) and end_cs > start_cs and seg_index % 7 <> 0"""
)
def pasted_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges pasted one a line for every chunk, with bad and empty lines between and one that ends it."""
    c = _chunked(spark, d).where("start_cs >= 0")
    k, good = F.col("seg_index"), F.concat(tc.format_cs(F.col("start_cs")), F.lit("-"), tc.format_cs(F.coalesce("end_cs", "start_cs")))
    line = F.when(k % 50 == 49, F.lit(" Done ")).when(k % 7 == 0, F.lit("not a range\n")).otherwise(F.concat(F.lit("  "), good))
    g = c.groupBy((F.col("video_id") * 100000 + F.col("chunk_num")).alias("paste_id")).agg(chunks.ordered_text(line, F.col("start_cs"), F.col("seg_index"), sep="\n").alias("text"))
    p = sections.pasted_ranges(g, "paste_id", "text")
    return p.select("paste_id", F.col("pos").cast("bigint").alias("pos"), "time_range", "start", "end")


@query(r"select doc_id, list_aggregate(regexp_extract_all(regexp_extract(text, '(?m)^(.*?#[\p{L}\p{M}\p{N}_].*)$', 1), '(#[\p{L}\p{M}\p{N}_]+)', 1), 'string_agg', ' ') as hashtags from documents where text is not null and regexp_matches(text, '#[\p{L}\p{M}\p{N}_]')")
def hashtag_extract(spark: SparkSession, d: str) -> DataFrame:
    h = sections.first_hashtags(_documents(spark, d), "doc_id", "text")
    return h.where(F.size("hashtags") > 0).select("doc_id", F.array_join("hashtags", " ").alias("hashtags"))


@query(
    r"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as raw from documents where text is not null),
        s as (select doc_id, line_no, regexp_replace(raw, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') as line from l)
        select doc_id, line_no, regexp_replace(substr(line, 2), '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') as topic from s
        where substr(line, 1, 1) in ('-', '•') and regexp_replace(substr(line, 2), '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') <> ''"""
)
def bullet_extract(spark: SparkSession, d: str) -> DataFrame:
    lines = sections.lines(_documents(spark, d), "doc_id", "text")
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), tx.bullet(F.col("line")).alias("topic")).where("topic is not null")


@query(
    r"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as raw from documents where text is not null),
        s as (select doc_id, line_no, regexp_replace(raw, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') as line from l)
        select doc_id, line_no, regexp_extract(line, '^\[([0-9]+:[0-9.]+) - ([0-9]+:[0-9.]+)\] ?(.*)$', 1) as from_label, regexp_extract(line, '^\[([0-9]+:[0-9.]+) - ([0-9]+:[0-9.]+)\] ?(.*)$', 3) as said
        from s where regexp_matches(line, '^\[([0-9]+:[0-9.]+) - ([0-9]+:[0-9.]+)\] ?(.*)$')"""
)
def segment_line_parse(spark: SparkSession, d: str) -> DataFrame:
    s = sections.segment_lines(_documents(spark, d), "doc_id", "text")
    return s.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), tc.format_cs(tc.to_cs(F.col("start"))).alias("from_label"), "said")


@query(
    r"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as raw from documents where text is not null),
        s as (select doc_id, line_no, regexp_replace(raw, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') as line from l)
        select doc_id, line_no, split_part(line, ': ', 1) as name, substr(line, len(split_part(line, ': ', 1)) + 3) as value from s where contains(line, ': ')"""
)
def key_value_parse(spark: SparkSession, d: str) -> DataFrame:
    return sections.key_values(_documents(spark, d), "doc_id", "text").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "name", "value")


@query(
    f"""with {SEG}, c as (select video_id, chunk_num, count(*) n, {CS('((chunk_num - 1) * 12000)')} as a, {CS('(chunk_num * 12000)')} as b from chunked group by 1, 2)
        select video_id, cast(chunk_num as int) as chunk, a || ' - ' || b as time_range, case when chunk_num % 7 = 0 then repeat('x', 297) || '...' else 'Said ' || n end as summary from c where chunk_num % 5 <> 0"""
)
def chunk_summary_parse(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a report written for every video and read again; a block without a summary takes nothing of the next."""
    c = _chunked(spark, d).groupBy("video_id", "chunk_num").agg(F.count("*").alias("n"))
    start = tc.chunk_start_cs(F.col("chunk_num"))
    said = F.when(F.col("chunk_num") % 7 == 0, F.repeat(F.lit("x"), F.lit(301))).otherwise(F.concat(F.lit("Said "), F.col("n").cast("string")))
    block = F.concat(F.lit("CHUNK "), F.col("chunk_num").cast("string"), F.lit(" ANALYSIS\nTime: "), tc.format_cs(start), F.lit(" - "), tc.format_cs(start + 12_000), F.lit("\n───\n"), F.when(F.col("chunk_num") % 5 != 0, F.concat(F.lit("Summary: "), said, F.lit("\n\n"))).otherwise(""), F.lit("Topics:\n  • one\n"))
    texts = c.withColumn("block", block).groupBy("video_id").agg(chunks.ordered_text(F.col("block"), -F.col("chunk_num")).alias("text"))
    return sections.chunk_summaries(texts, "video_id", "text")


@query(
    f"""with {SEG}, c as (select video_id, chunk_num, count(*) n, {CS('((chunk_num - 1) * 12000)')} as a, {CS('(chunk_num * 12000)')} as b from chunked group by 1, 2)
        select video_id, cast(chunk_num as int) as chunk, 'Chunk ' || chunk_num || ' [' || a || ' - ' || b || ']' || chr(10) || case when chunk_num % 7 = 0 then repeat('x', 297) || '...' else 'Said ' || n end || chr(10) as entry from c where chunk_num % 5 <> 0"""
)
def chunk_digest_entries(spark: SparkSession, d: str) -> DataFrame:
    """The summaries of every report's chunks, each as a prompt takes it."""
    return chunk_summary_parse(spark, d).select("video_id", "chunk", render.digest_entry().alias("entry"))


@query(
    r"""select doc_id, regexp_replace(regexp_replace(substr(text, instr(text, 'TOPICS:') + 7), '^[ \t]*\n-*\n?', ''), '^[\s\pZ\x0b\x1c-\x1f\x85]+|[\s\pZ\x0b\x1c-\x1f\x85]+$', '', 'g') as tail
        from documents where text is not null and instr(text, 'TOPICS:') > 0"""
)
def text_after_marker(spark: SparkSession, d: str) -> DataFrame:
    """What stands under a marker line, of every document that has one, whatever its text ends in."""
    t = _documents(spark, d).where("text is not null and instr(text, 'TOPICS:') > 0")
    return sections.after_marker(t, "doc_id", "text", "TOPICS:").withColumnRenamed("transcript", "tail")


# Selections

PARTS = """parts as (
  select video_id, chunk_num, cast((row_number() over (partition by video_id, chunk_num order by start_cs, seg_index) - 1) // 4 + 1 as bigint) as selection_no,
         seg_index, start_cs, greatest(coalesce(end_cs, start_cs), start_cs) as end_cs from chunked)"""
OR_NA = lambda c: f"case when {c} >= 0 then {CS(c)} else 'N/A' end"


def _time_range() -> Column:
    """A segment's range in words; a bound before 0 has no time code, so it can't be read again."""
    at = lambda c: F.when(c >= 0, tc.format_cs(c)).otherwise("N/A")
    return F.concat(at(F.col("start_cs")), F.lit(" - "), at(F.greatest(F.coalesce("end_cs", "start_cs"), "start_cs")))


def _selections(spark: SparkSession, d: str) -> DataFrame:
    """Every segment, in selections of four that follow each other in a chunk; the last has what is left."""
    part = F.struct("start_cs", "seg_index", F.struct(_time_range().alias("time_range")).alias("part"))
    c = _chunked(spark, d).groupBy("video_id", "chunk_num").agg(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]).alias("all"))
    fours = F.expr("transform(sequence(0L, cast((size(all) - 1) div 4 as bigint)), i -> struct(i + 1 as selection_no, slice(all, cast(i * 4 + 1 as int), 4) as parts))")
    return c.select("video_id", "chunk_num", F.inline(fours))


@query(f"with {SEG}, {PARTS} select video_id, chunk_num, selection_no, row_number() over (partition by video_id, chunk_num, selection_no order by start_cs, seg_index) as part_no, {OR_NA('start_cs')} || ' - ' || {OR_NA('end_cs')} as time_range, case when end_cs > start_cs and start_cs >= 0 then end_cs - start_cs >= 500 end as long_enough from parts")
def part_validation(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every selection, of all segments."""
    p = selection.parts_of(_selections(spark, d), ["video_id", "chunk_num", "selection_no"])
    return p.select("video_id", "chunk_num", "selection_no", F.col("part_no").cast("bigint").alias("part_no"), "time_range", (tc.to_cs(F.col("end")) - tc.to_cs(F.col("start")) >= 500).alias("long_enough"))


@query(
    f"""with {SEG}, {PARTS},
        t as (select video_id, chunk_num, selection_no, count(*) n, bool_and(end_cs > start_cs and start_cs >= 0) readable, bool_and(end_cs - start_cs >= 500) long_enough, cast(sum(end_cs - start_cs) // 100 as bigint) s from parts group by 1, 2, 3)
        select video_id, chunk_num, selection_no, n as n_parts, case when readable then s else 0 end as total_s, readable and long_enough and s between 10 and 30 as valid, readable and s between 10 and 20 as in_range,
               case when not readable then 'unreadable part' when not long_enough then 'part too short' when s < 10 then 'total too short' when s > 30 then 'total too long' end as reason from t"""
)
def selection_total(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every selection, of all segments."""
    return selection.validated(_selections(spark, d), ["video_id", "chunk_num", "selection_no"], min_s=10, max_s=20)


@query(
    """select report_id, s.start_time as from_s, s.end_time as to_s, s.start_time < 0 or s.end_time > metadata.duration as out
       from (select report_id, metadata, unnest(segments.high_value) s from reels_extraction_20250825_215033_complete)"""
)
def bounds_check_theta(spark: SparkSession, d: str) -> DataFrame:
    """Chosen ranges against their medium's duration; the duration comes with the report, so nothing is joined."""
    r = table(spark, d, REPORTS).select("report_id", F.col("metadata.duration").alias("d"), F.explode("segments.high_value").alias("s"))
    return r.select("report_id", F.col("s.start_time").alias("from_s"), F.col("s.end_time").alias("to_s"), selection.outside(F.col("s.start_time"), F.col("s.end_time"), F.col("d")).alias("out"))


@query(
    """select r.row_id, v.duration is not null as known, r.start_seconds < 0 or r.end_seconds > v.duration as out from results_qwen15b r left join videos v on r.video_id = v.video_id"""
)
def bounds_check_join(spark: SparkSession, d: str) -> DataFrame:
    """Ranges against the duration of their video."""
    r = table(spark, d, "results_qwen15b").select("row_id", "video_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    return selection.out_of_bounds(r, table(spark, d, "videos"), "video_id").select("row_id", "known", "out")


@query(
    f"""with {SEG}, {PARTS}, p as (select p.*, row_number() over w as part_no, coalesce(start_cs >= 0 and end_cs > start_cs and not isnan(v.duration) and end_cs <= v.duration * 100, false) as ok,
          case when start_cs >= 0 and end_cs > start_cs then end_cs - start_cs else 0 end as n from parts p left join videos v on p.video_id = v.video_id window w as (partition by p.video_id, chunk_num, selection_no order by start_cs, seg_index))
        select video_id, chunk_num, selection_no, part_no, case when start_cs >= 0 and end_cs > start_cs then start_cs / 100 end as start, case when start_cs >= 0 and end_cs > start_cs then end_cs / 100 end as end,
          coalesce(sum(n) over (w rows between unbounded preceding and 1 preceding), 0)::bigint / 100 as at_s, sum(n) over (partition by video_id, chunk_num, selection_no)::bigint / 100 as total_s, ok, bool_and(ok) over (partition by video_id, chunk_num, selection_no) as all_ok
        from p window w as (partition by video_id, chunk_num, selection_no order by part_no)"""
)
def cut_plan(spark: SparkSession, d: str) -> DataFrame:
    """Cuts of every selection in their order, checked against their video's duration, with where each begins in what is made."""
    key = ["video_id", "chunk_num", "selection_no"]
    p = selection.parts_of(_selections(spark, d), key)
    return selection.cut_plan(p.withColumn("part_no", F.col("part_no").cast("bigint")), table(spark, d, "videos"), key, "video_id")


@query(
    f"""with {SEG}, {PARTS}, k as (select distinct video_id, chunk_num, selection_no from parts), t as (select video_id, chunk_num, selection_no, count(*) n, cast(sum(case when end_cs > start_cs and start_cs >= 0 then end_cs - start_cs else 0 end) as bigint) s from parts group by 1, 2, 3)
        select video_id, chunk_num, selection_no, n as n_parts, {CS('s')} as total from t"""
)
def selection_label(spark: SparkSession, d: str) -> DataFrame:
    """The total of every selection's readable parts, as a time code."""
    key = ["video_id", "chunk_num", "selection_no"]
    return selection.totals(selection.parts_of(_selections(spark, d), key), key).select(*key, "n_parts", "total")


@query(
    """with a as (select video_id, chunk_num, row_number() over (partition by video_id, chunk_num order by start_time nulls last, row_id) as attempt, coalesce(value_score >= 0.5 and not isnan(value_score), false) as valid
         from results_simplified where video_id is not null and chunk_num is not null)
       select video_id, chunk_num, coalesce(min(attempt) filter (valid), min(attempt)) as chosen, min(attempt) filter (valid) is null as fallback from a where attempt <= 3 group by 1, 2"""
)
def first_valid_attempt(spark: SparkSession, d: str) -> DataFrame:
    """Of three attempts a chunk the first valid one, else the first."""
    w = Window.partitionBy("video_id", "chunk_num").orderBy(F.asc_nulls_last("start_time"), "row_id")
    a = table(spark, d, "results_simplified").where("video_id is not null and chunk_num is not null")
    a = a.select("video_id", "chunk_num", F.row_number().over(w).alias("attempt"), F.coalesce((F.col("value_score") >= 0.5) & ~F.isnan("value_score"), F.lit(False)).alias("valid"))
    return selection.first_valid(a, ["video_id", "chunk_num"]).select("video_id", "chunk_num", F.col("chosen").cast("bigint").alias("chosen"), "fallback")


# Windows

WIN = """span as (select video_id, min(start_cs) t0, max(greatest(start_cs, coalesce(end_cs, start_cs))) t1 from seg group by 1),
win as (select video_id, window_no, t0 + window_no * 3500 as ws, least(t0 + window_no * 3500 + 4500, t1) as we from (
  select video_id, t0, t1, cast(unnest(generate_series(0, greatest(0, cast(ceil((t1 - t0 - 4500) / 3500.0) as bigint)))) as bigint) as window_no from span))"""


@query(f"with {SEG}, {WIN} select * from win")
def overlap_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.overlapping(_segments(spark, d))


@query(
    f"""with {SEG}, {WIN} select w.video_id, w.window_no, count(*) as n_segments, sha256(string_agg(coalesce(s.text, ''), ' ' order by s.start_cs, s.seg_index)) as text_sha
        from win w join seg s on s.video_id = w.video_id and s.start_cs < w.we and greatest(coalesce(s.end_cs, s.start_cs), s.start_cs) > w.ws group by 1, 2"""
)
def window_membership(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    t = windows.window_texts(windows.members(s, windows.overlapping(s)))
    return t.select("video_id", "window_no", "n_segments", F.sha2("text", 256).alias("text_sha"))


# Scores


@query(
    f"""select row_id, n_words, 5 + case when n_words >= 10 then 2 else 0 end - case when n_words < 5 then 2 else 0 end + case when q then 1 else 0 end - case when low then 1 else 0 end as score_tenths,
        concat_ws(', ', case when n_words >= 10 then 'good length' end, case when n_words < 5 then 'too short' end, case when q then 'engaging questions' end, case when low then 'low confidence' end) as reasons
        from (select row_id, cast({WORDS("coalesce(text, '')")} as int) as n_words, contains(coalesce(text, ''), '?') as q, coalesce(confidence < 0.7 and not isnan(confidence), false) as low from results_qwen15b)"""
)
def rule_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rule_score(table(spark, d, "results_qwen15b")).select("row_id", "n_words", "score_tenths", "reasons")


@query(
    """with s as (select video_id, cast(least(floor(round(value_score * 1000) / 200), 4) as int) b from results_qwen15b where video_id is not null and value_score is not null and not isnan(value_score)),
       v as (select distinct video_id from s), e as (select unnest([0, 1, 2, 3, 4]) b, unnest(['0.0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1.0']) bin)
       select v.video_id, e.bin, count(s.b) as n from v cross join e left join s on s.video_id = v.video_id and s.b = e.b group by 1, 2"""
)
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scoring.histogram(table(spark, d, "results_qwen15b").where("video_id is not null"), ["video_id"])


@query("select row_id, value_score from results_qwen15b where value_score >= 0.5 and not isnan(value_score)")
def high_value_filter(spark: SparkSession, d: str) -> DataFrame:
    return scoring.high_value(table(spark, d, "results_qwen15b")).select("row_id", "value_score")


@query(
    """with m as (select video_id, case when value_score is not null and not isnan(value_score) then cast(round(value_score * 1000) as bigint) end m from results_qwen15b where video_id is not null)
       select video_id, count(*) as total, count(*) filter (m >= 500) as high, cast(floor(count(*) filter (m >= 500) * 1000 / count(*)) as bigint) as success_permille,
              cast(floor(sum(m) / count(m)) as bigint) as avg_milli, min(m) as min_milli, max(m) as max_milli from m group by 1"""
)
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return scoring.summary(table(spark, d, "results_qwen15b").where("video_id is not null"), ["video_id"])


@query(
    """select row_id, value_score, case when len(text) > 100 then left(text, 100) || '...' else text end as text from results_qwen15b
       where value_score >= 0.5 and not isnan(value_score) order by value_score desc, row_id limit 10"""
)
def top_segments(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_report(table(spark, d, "results_qwen15b").select("row_id", "value_score", "text"), ["row_id"])


@query(
    """select k as bin, cast(sum(v) as bigint) as n from (select unnest(map_keys(summaries.evaluation.score_distribution)) k, unnest(map_values(summaries.evaluation.score_distribution)) v from reels_extraction_20250825_215033_complete) group by 1"""
)
def reported_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the reports' own histograms."""
    return reports.score_distribution(table(spark, d, REPORTS)).groupBy("bin").agg(F.sum("n").alias("n"))


@query(
    """with s as (select metadata.audio_path p, s.* from (select metadata, unnest(segments.evaluated) s from (select distinct on (report_id) * from reels_extraction_20250825_215033_complete)) where metadata.audio_path is not null and s.duration >= 15),
            m as (select p, case when value_score is not null and not isnan(value_score) then cast(round(value_score * 1000) as bigint) end m from s)
       select p as audio_path, count(*) as total, count(*) filter (m >= 500) as high, cast(floor(count(*) filter (m >= 500) * 1000 / count(*)) as bigint) as success_permille, cast(floor(sum(m) / count(m)) as bigint) as avg_milli, min(m) as min_milli, max(m) as max_milli from m group by 1"""
)
def evaluated_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the evaluated segments of at least 15 seconds, a report counted once."""
    e = reports.evaluated_segments(table(spark, d, REPORTS), "report_id", F.col("metadata.audio_path").alias("audio_path")).where("audio_path is not null")
    once = e.groupBy("report_id", "seg_no", "audio_path").agg(F.min(F.struct("duration", "value_score")).alias("x")).select("audio_path", "x.*")
    return scoring.summary(once, ["audio_path"], min_duration_s=15.0)


@query(
    """with s as (select metadata.audio_path p, s.* from (select metadata, unnest(segments.evaluated) s from (select distinct on (report_id) * from reels_extraction_20250825_215033_complete)) where metadata.audio_path is not null),
            m as (select p, case when not isnan(duration) then cast(round(duration * 100) as bigint) end d, case when not isnan(confidence) then cast(round(confidence * 1000) as bigint) end c from s)
       select p as audio_path, count(*) as n, cast(floor(sum(d) / count(d)) as bigint) as mean_duration_cs, cast(floor(sum(c) / count(c)) as bigint) as mean_confidence_milli from m group by 1"""
)
def segment_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean duration and confidence of the evaluated segments of every path, a report counted once."""
    e = reports.evaluated_segments(table(spark, d, REPORTS), "report_id", F.col("metadata.audio_path").alias("audio_path")).where("audio_path is not null")
    once = e.groupBy("report_id", "seg_no", "audio_path").agg(F.min(F.struct("duration", "confidence")).alias("x")).select("audio_path", "x.*")
    return scoring.means(once, ["audio_path"])


@query(
    """select row_id, case when value_score is not null and not isnan(value_score) then value_score when contains(lower(r), 'skipped') then 0.75 else 0.5 end as score
       from (select row_id, value_score, case when row_id % 2 = 0 then 'Evaluation skipped for speed' else coalesce(reasoning, '') end r from results_qwen15b)"""
)
def score_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Scores with the constants that stand for those that weren't made."""
    why = F.when(F.col("row_id") % 2 == 0, "Evaluation skipped for speed").otherwise(F.col("reasoning"))
    return table(spark, d, "results_qwen15b").select("row_id", scoring.with_fallback(F.col("value_score"), why).alias("score"))


# Seconds as a time code, a negative one with its sign before it.
SIGNED_CS = lambda c: f"case when isnan({c}) or abs({c}) >= 9e15 then null else case when round({c} * 100) < 0 then '-' else '' end || {CS(f'cast(abs(round({c} * 100)) as bigint)')} end"


@query(
    f"""select row_id, cast(index as int) as index, start_time, end_time, start_seconds, end_seconds, duration, text, confidence, value_score, reasoning from (
         select row_id, seg_index as index, start_time, end_time, start_seconds, end_seconds, duration, text, confidence, value_score, reasoning from results_qwen15b
         union all by name select row_id, seg_index as index, {SIGNED_CS('start_time')} as start_time, {SIGNED_CS('end_time')} as end_time, null as duration, text, confidence, value_score, reasoning from results_simplified)"""
)
def union_legacy_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Segment tables of two shapes as one, every row of both; the second's seconds are written as time codes from whole hundredths, NaN as null."""

    def written(c: str) -> Column:
        cs = tc.to_cs(F.col(c))
        return F.concat(F.when(cs < 0, "-").otherwise(""), tc.format_cs(F.abs(cs)))

    a = table(spark, d, "results_qwen15b").withColumnRenamed("seg_index", "Index").drop("video_id", "loaded_at")
    b = table(spark, d, "results_simplified").select("row_id", F.col("seg_index").alias("index"), written("start_time").alias("start_time"), written("end_time").alias("end_time"), "text", "confidence", "value_score", "reasoning")
    return reports.unified(a, b, keys=["row_id"])


@query("select seg_index as index, start_time, end_time, start_seconds, end_seconds, duration, text, confidence, value_score, reasoning from results_qwen15b")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Segments written as CSV, texts with line breaks and quotes inside, and read again in their shape."""
    at = shared_folder(spark)
    rows = table(spark, d, "results_qwen15b").withColumnRenamed("seg_index", "index").drop("row_id", "video_id", "loaded_at")
    rows.write.option("header", "true").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(at)
    return reports.unified(reports.segment_csv(spark, at, rows.columns))


# Speakers and pacing. As labels stand in: long segments are the teacher's.

LABELLED = f"labelled as (select *, case when {WORDS("coalesce(text, '')")} >= 8 then 'teacher' else 'student' end as label from seg)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).withColumn("label", F.when(F.col("n_words") >= 8, "teacher").otherwise("student"))


@query(
    f"""with {SEG}, {LABELLED}, b as (select video_id, label, count(*) n_segments, cast(sum(greatest(coalesce(end_cs - start_cs, 0), 0)) as bigint) spoken_cs, cast(sum({WORDS("coalesce(text, '')")}) as bigint) n_words from labelled group by 1, 2)
        select *, cast(floor(n_words * 1000 / n_segments) as bigint) as words_milli, cast(floor(spoken_cs * 1000 / greatest(sum(spoken_cs) over (partition by video_id), 1)) as bigint) as time_permille, cast(floor(n_segments * 1000 / greatest(sum(n_segments) over (partition by video_id), 1)) as bigint) as segment_permille from b"""
)
def speaker_share(spark: SparkSession, d: str) -> DataFrame:
    return speakers.shares(_labelled(spark, d))


@query(
    f"""with {SEG}, l as (select video_id, seg_index, min(speaker_id) label from results_simplified where video_id is not null and seg_index is not null and speaker_id is not null group by 1, 2)
        select s.video_id, s.seg_index, coalesce(l.label, 'unknown') as label from seg s left join l on s.video_id = l.video_id and s.seg_index = l.seg_index"""
)
def labels_zipped(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the label that a labeller gave for their place."""
    labels = table(spark, d, "results_simplified").select("video_id", "seg_index", F.col("speaker_id").alias("label"))
    return speakers.labelled(_segments(spark, d).select("video_id", "seg_index"), labels, ["video_id", "seg_index"])


@query(
    f"""with {SEG}, {LABELLED}, l as (select *, lag(label) over w before, lag(text) over w said from labelled window w as (partition by video_id order by start_cs, seg_index))
        select video_id, seg_index, label, case when before = 'teacher' and contains(said, '?') and label = 'teacher' and not contains(coalesce(text, ''), '?') and {WORDS("coalesce(text, '')")} < 10 then 'student' else label end as refined from l"""
)
def flow_refine_lag(spark: SparkSession, d: str) -> DataFrame:
    return speakers.refined(_labelled(spark, d)).select("video_id", "seg_index", "label", "refined")


@query(
    f"""with {SEG}, {LABELLED}, c as (select *, case when lag(label) over w is distinct from label then 1 else 0 end ch from labelled window w as (partition by video_id order by start_cs, seg_index)),
        g as (select *, sum(ch) over (partition by video_id order by start_cs, seg_index rows unbounded preceding) g from c)
        select video_id, label, min(start_cs) as from_cs, max(end_cs) as to_cs, count(*) as n_segments from g group by video_id, label, g"""
)
def speaker_timeline_islands(spark: SparkSession, d: str) -> DataFrame:
    return speakers.timeline(_labelled(spark, d))


@query(f"with {SEG}, {LABELLED} select video_id, count(distinct label) as n_speakers from labelled group by 1")
def speakers_counted(spark: SparkSession, d: str) -> DataFrame:
    return speakers.speakers_counted(_labelled(spark, d))


@query(
    f"""with {SEG}, b as (select video_id, cast(sum({WORDS("coalesce(text, '')")}) as bigint) n_words, cast(sum(greatest(coalesce(end_cs - start_cs, 0), 0)) as bigint) spoken_cs from seg group by 1)
        select *, case when spoken_cs > 0 then cast(floor(n_words * 6000000 / spoken_cs) as bigint) end as milli_wpm from b"""
)
def pacing_wpm(spark: SparkSession, d: str) -> DataFrame:
    return speakers.pacing(_segments(spark, d))


@query(f"with {SEG}, p as (select video_id, seg_index, start_cs - lag(end_cs) over (partition by video_id order by start_cs, seg_index) as pause_cs from seg) select * from p where pause_cs >= 1")
def pause_gaps(spark: SparkSession, d: str) -> DataFrame:
    return speakers.pauses(_segments(spark, d))


@query(
    """with w as (select row_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\n\\t\\r]+'), lambda w: w <> '') w, lower(coalesce(text, '')) t from results_qwen15b)
       select row_id, cast(len(w) as int) as n_words, contains(t, '?') as is_question, cast(len(string_split(t, ',')) as int) as n_clauses, cast(len(list_distinct(w)) as int) as n_distinct,
              cast(len(array_to_string(w, '')) as int) as n_letters,
              case when len(w) > 0 then cast(len(list_distinct(w)) * 1000 // len(w) as int) else 0 end as distinct_permille, case when len(w) > 0 then cast(len(array_to_string(w, '')) * 1000 // len(w) as int) else 0 end as letters_milli, cast(contains(t, 'please') as int) + cast(contains(t, 'we ') as int) - cast(contains(t, 'why') as int) as marker_score from w"""
)
def speaker_features(spark: SparkSession, d: str) -> DataFrame:
    f = speakers.features(table(spark, d, "results_qwen15b").select("row_id", "text"), ["please", "we "], ["why"])
    return f.select("row_id", "n_words", "is_question", "n_clauses", "n_distinct", "n_letters", "distinct_permille", "letters_milli", "marker_score")


@query()
def speaker_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Roles by two clusters of the features; no SQL, as the clustering is iterative."""
    f = speakers.features(_segments(spark, d), ["please", "we "], ["why"]).withColumn("q", F.col("is_question").cast("int"))
    r = speakers.cluster_roles(f, ["n_words", "q", "n_clauses", "n_distinct", "n_letters", "marker_score"])
    return r.select("video_id", "seg_index", "role")


@query(f"with {SEG} select count(*) as n_rows, count(distinct video_id || ' ' || seg_index) as n_segments, 2::bigint as n_roles, true as teacher_speaks_longer, true as teacher_is_the_longer_cluster from seg having count(*) > 0")
def speaker_roles_hold(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the roles by clusters, whatever the clusters are: each segment once, two roles, the teacher's mean length the greater."""
    f = speakers.features(_segments(spark, d), ["please", "we "], ["why"]).withColumn("q", F.col("is_question").cast("int"))
    r = speakers.cluster_roles(f, ["n_words", "q", "n_clauses", "n_distinct", "n_letters", "marker_score"])
    by = r.groupBy("cluster", "role").agg(F.count("*").alias("n"), F.count_distinct("video_id", "seg_index").alias("s"), F.sum("n_words").alias("w"))
    mean = lambda role: F.sum(F.when(F.col("role") == role, F.col("w"))) / F.sum(F.when(F.col("role") == role, F.col("n")))
    return by.agg(
        F.sum("n").alias("n_rows"), F.sum("s").alias("n_segments"), F.count_distinct("role").alias("n_roles"), (mean("teacher") > mean("student")).alias("teacher_speaks_longer"),
        (F.max_by("role", F.col("w") / F.col("n")) == "teacher").alias("teacher_is_the_longer_cluster"),
    ).where("n_rows > 0")


# Captions, plans and names


@query(
    f"""with {SEG}, g as (select *, row_number() over (partition by video_id order by start_cs, seg_index) n from seg where {STRIP("coalesce(text, '')")} <> '' and end_cs > start_cs)
        select video_id, n, n || chr(10) || {CLOCK('start_cs', ',')} || ' --> ' || {CLOCK('end_cs', ',')} || chr(10) || {STRIP('text')} || chr(10) as cue from g where start_cs >= 0"""
)
def srt_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.captions(_segments(spark, d))


@query(
    f"""with {SEG}, g as (select *, row_number() over (partition by video_id order by start_cs, seg_index) n from seg where {STRIP("coalesce(text, '')")} <> '' and end_cs > start_cs)
        select video_id, n, {CLOCK('start_cs', '.')} || ' --> ' || {CLOCK('end_cs', '.')} || chr(10) || {STRIP('text')} || chr(10) as cue from g where start_cs >= 0"""
)
def vtt_cues(spark: SparkSession, d: str) -> DataFrame:
    return render.captions(_segments(spark, d), "vtt")


@query(
    f"""with {SEG}, h as (select video_id, chunk_num from chunked group by 1, 2), lines as (
          select video_id, chunk_num, 0 part, unnest(range(0, 7)) line_no, unnest(['CHUNK ' || chunk_num || ' TRANSCRIPT', repeat('=', 60), '', 'Time range: ' || {CS('((chunk_num - 1) * 12000)')} || ' - ' || {CS('(chunk_num * 12000)')}, '', 'Segments with timestamps:', repeat('-', 40)]) line from h
          union all select video_id, chunk_num, 1, seg_index, '[' || {CS('start_cs')} || ' - ' || {CS('coalesce(end_cs, start_cs)')} || '] ' || {STRIP("coalesce(text, '')")} from chunked)
        select video_id, chunk_num, cast(part as int) as part, cast(line_no as int) as line_no, line from lines"""
)
def chunk_file_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.chunk_files(_chunked(spark, d))


@query(
    f"""with {SEG}, m as (select video_id, chunk_num, count(*) n from chunked group by 1, 2)
        select video_id, chunk_num, cast(unnest(range(0, 9)) as int) line_no, unnest(['CHUNK ' || chunk_num || ' METADATA', repeat('=', 60), '', 'Chunk number: ' || chunk_num, 'Start time: ' || {CS('((chunk_num - 1) * 12000)')},
               'Duration: 120.0 seconds (2.0 minutes)', 'Processing time: ' || (n // 10) || '.' || (n % 10) || ' seconds (' || ((n * 2 + 60) // 120 // 10) || '.' || ((n * 2 + 60) // 120 % 10) || ' minutes)', 'Language: N/A', 'Number of segments: ' || n]) line from m"""
)
def chunk_metadata_lines(spark: SparkSession, d: str) -> DataFrame:
    c = _chunked(spark, d).groupBy("video_id", "chunk_num").agg(F.count("*").alias("n_segments"))
    return render.chunk_metadata(c.select("video_id", "chunk_num", F.lit(12_000).cast("bigint").alias("duration_cs"), F.col("n_segments").alias("processing_tenths"), F.lit(None).cast("string").alias("language"), "n_segments"))


@query(
    f"""with {SEG}, {PARTS}, p as (select video_id, chunk_num, selection_no, (start_cs // 100) || '.' || lpad(cast(start_cs % 100 as varchar), 2, '0') a, (end_cs // 100) || '.' || lpad(cast(end_cs % 100 as varchar), 2, '0') b, row_number() over (partition by video_id, chunk_num, selection_no order by start_cs, seg_index) - 1 i from parts where end_cs > start_cs and start_cs >= 0)
        select video_id, chunk_num, selection_no, string_agg('[0:v]trim=start=' || a || ':end=' || b || ',setpts=PTS-STARTPTS[v' || i || '];[0:a]atrim=start=' || a || ':end=' || b || ',asetpts=PTS-STARTPTS[a' || i || ']', ';' order by i) || ';' || string_agg('[v' || i || '][a' || i || ']', '' order by i) || 'concat=n=' || count(*) || ':v=1:a=1[outv][outa]' as graph
        from p group by 1, 2, 3"""
)
def filter_graph_render(spark: SparkSession, d: str) -> DataFrame:
    """Filter graph of every selection of all segments, however late they start; a part without a length has nothing to trim."""
    key = ["video_id", "chunk_num", "selection_no"]
    p = selection.parts_of(_selections(spark, d), key).where("start is not null")
    g = p.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("r"))
    return g.select(*key, render.filter_graph(F.col("r")).alias("graph"))


@query(
    r"""with b as (select distinct channel as base from documents where channel is not null), k as (select base, ascii(right(base, 1)) % 5 as k from b),
         w as (select base from k union select base || '_1' from k where k = 4 union select base || '_3' from k where k = 3),
         t as (select base as name from k where k <> 0 union all select base || '_2' from k where k = 2 or k = 3 union all select base || '_4' from k where k = 2 union all select base || '_1' from k where k = 4 union all select base || '_1_2' from k where k = 4),
         n as (select base, cast(unnest(generate_series(1, 6)) as bigint) i from w), c as (select base, i, case when i = 1 then base else base || '_' || i end as name from n)
       select c.base, arg_min(c.name, c.i) as chosen from c where c.name not in (select name from t) and (c.i = 1 or c.name not in (select base from w)) group by 1"""
)
def unique_name_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Output names that don't exist yet, of every channel's; some names end in a counter themselves."""
    b = table(spark, d, "documents").where("channel is not null").select(F.col("channel").alias("base")).distinct().withColumn("k", F.ascii(F.right("base", F.lit(1))) % 5)
    also = lambda end, *ks: b.where(F.col("k").isin(*ks)).select(F.concat("base", F.lit(end)).alias("name"))
    wanted = b.select("base").unionByName(also("_1", 4).unionByName(also("_3", 3)).withColumnRenamed("name", "base"))
    taken = also("", 1, 2, 3, 4).unionByName(also("_2", 2, 3)).unionByName(also("_4", 2)).unionByName(also("_1", 4)).unionByName(also("_1_2", 4))
    return render.unique_names(wanted, taken)


@query(f"with {SEG}, c as (select distinct video_id, chunk_num n from chunked) select video_id, n as chunk_num, 'chunk_' || case when len(n::varchar) < 2 then lpad(n::varchar, 2, '0') else n::varchar end || '.txt' as name, 'chunk_' || case when len(n::varchar) < 2 then lpad(n::varchar, 2, '0') else n::varchar end || '_metadata.txt' as metadata_name from c")
def chunk_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of every chunk's files."""
    c = _chunked(spark, d).select("video_id", "chunk_num").distinct()
    return c.select("video_id", "chunk_num", render.chunk_file_name(F.col("chunk_num")).alias("name"), render.chunk_file_name(F.col("chunk_num"), "metadata").alias("metadata_name"))


@query(
    f"""with {SEG}, c as (select video_id, chunk_num n, count(*) + 7 k from chunked group by 1, 2)
        select video_id || '/chunk_' || case when len(n::varchar) < 2 then lpad(n::varchar, 2, '0') else n::varchar end || '.txt' as name, k as n_lines from c"""
)
def chunk_files_written(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's transcript written to a file of its name, with the lines it has."""
    lines = render.chunk_files(_chunked(spark, d))
    name = F.concat(F.col("video_id").cast("string"), F.lit("/"), render.chunk_file_name(F.col("chunk_num")))
    return render.write_named(lines.withColumn("name", name), shared_folder(spark), "name", ["part", "line_no"])


@query(
    """select line_id, strftime(updated_at, '%Y-%m-%d_%H%M%S') || case when line_id % 3 = 0 then '_' || lpad(cast(microsecond(updated_at) % 1000000 as varchar), 6, '0') else '' end || '_my_video-v2' as folder
       from full_transcript where updated_at is not null"""
)
def run_directory_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of run folders of a time and a video, with microseconds where the name is taken."""
    t = table(spark, d, "full_transcript").where("updated_at is not null")
    return t.select("line_id", render.run_directory_name(F.col("updated_at"), F.lit("/in/my video.v2.mp4"), F.col("line_id") % 3 == 0).alias("folder"))


@query(
    f"""with {SEG}, {PARTS}, p as (select *, video_id || '-' || chunk_num || '-' || selection_no as reel_id, row_number() over (partition by video_id, chunk_num, selection_no order by start_cs, seg_index) i from parts),
        r as (select reel_id, video_id, count(*) n, max(chunk_num) c from p group by 1, 2),
        h as (select reel_id, ['AUTO-GENERATED REEL METADATA', repeat('=', 70), '', 'Source Video: ' || coalesce(v.path, ''), 'Transcription Results: runs/' || r.video_id, 'Duration: ' || r.c || 's', 'Parts: ' || n, '', 'Title: Part ' || r.c, 'Narrative: ', '', 'SEGMENTS:'] l
              from r left join videos v on v.video_id = r.video_id)
        select reel_id, 0::int as part, cast(unnest(range(0, 12)) as int) as line_no, unnest(l) as line from h
        union all select reel_id, 1::int, cast(i as int), i || '. ' || {OR_NA('start_cs')} || ' - ' || {OR_NA('end_cs')} || ' - why ' || i from p"""
)
def reel_metadata_lines(spark: SparkSession, d: str) -> DataFrame:
    """Metadata files of reels made of every selection, as lines."""
    reel_id = F.concat_ws("-", "video_id", "chunk_num", "selection_no").alias("reel_id")
    s = _selections(spark, d)
    p = selection.parts_of(s, ["video_id", "chunk_num", "selection_no"]).select(reel_id, "part_no", "time_range", F.concat(F.lit("why "), F.col("part_no").cast("string")).alias("reason"))
    r = s.join(table(spark, d, "videos").select("video_id", "path"), "video_id", "left")
    r = r.select(reel_id, F.concat(F.lit("Part "), F.col("chunk_num").cast("string")).alias("title"), F.lit(None).cast("string").alias("narrative"), "path", F.concat(F.lit("runs/"), F.col("video_id").cast("string")).alias("run"), F.col("chunk_num").alias("total_s"))
    return render.reel_metadata(r, p)


@query(
    r"""with c as (select video_id, k, 'IMG_' || video_id || e as name from videos, (select unnest(range(0, 4)) k, unnest(['.MP4', '.MOV', '.mp4', '.mov']) e)),
        f as (select path, regexp_extract(path, '([^/]*)$', 1) as name from videos where path is not null)
        select video_id, arg_min(path, (k, path)) as path from c join f using (name) group by 1"""
)
def candidate_semijoin(spark: SparkSession, d: str) -> DataFrame:
    """Of every video's possible file names the first that exists."""
    v = table(spark, d, "videos")
    runs = v.select(F.concat(F.lit("2025-01-01_000000_IMG_"), F.col("video_id").cast("string")).alias("folder"), "video_id")
    found = media.media_of_runs(runs, v.where("path is not null"))
    return found.select(F.regexp_extract("folder", "([0-9]+)$", 1).cast("bigint").alias("video_id"), "path")


@query(r"select row_id, case when instr(reasoning, '{') > 0 and regexp_matches(reasoning, '(?s)\{.*\}') then cast(round(cast(json_extract_string(regexp_extract(reasoning, '(?s)(\{.*\})', 1), '$.score') as double) * 10) as int) end as score_tenths from results_simplified where reasoning is not null")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """Scores out of the JSON that replies wrap in text."""
    r = table(spark, d, "results_simplified").where("reasoning is not null")
    return r.select("row_id", F.round(F.get_json_object(tx.json_object(F.col("reasoning")), "$.score").try_cast("double") * 10).cast("int").alias("score_tenths"))


@query("select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    """select doc_id, case when len(text) <= 200 then text else left(text, 100) || chr(10) || '...' || chr(10) || right(text, 100) end as cut, case when len(text) > 60 then left(text, 57) || '...' else text end as within,
       left(text, 50) as head, right(text, 50) as tail, text as whole from documents"""
)
def truncate_smart(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", tx.smart_cut(F.col("text"), 200).alias("cut"), tx.cut_within(F.col("text"), 60).alias("within"), tx.smart_cut(F.col("text"), 50, "start").alias("head"), tx.smart_cut(F.col("text"), 50, "end").alias("tail"), tx.smart_cut(F.col("text"), 50, "full").alias("whole"))


@query("select doc_id, left(sha256(concat_ws('_', text, 'summary', 'model-a')), 16) as cache_key from documents")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", tx.cache_key(F.col("text"), "summary", "model-a").alias("cache_key"))


@query("select doc_id, crawled_at <= timestamp '2025-09-01 00:00:00' and timestamp '2025-09-01 00:00:00' < crawled_at + interval 7 days as fresh from documents")
def cache_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was stored at a document's time would still be taken from a cache of seven days."""
    return table(spark, d, "documents").select("doc_id", tx.fresh(F.col("crawled_at"), F.lit("2025-09-01 00:00:00").cast("timestamp_ntz")).alias("fresh"))


@query(
    """select event_id, case when event_id % 3 = 0 then null else props end as json, case when event_id % 3 = 0 then 'Sure: {' || props || ' }' end as raw, event_id % 3 = 0 as parse_error from events where props is not null"""
)
def json_or_raw(spark: SparkSession, d: str) -> DataFrame:
    """The JSON in a reply, or the reply as it is where there is none that can be read."""
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure: {"), "props", F.lit(" }"))).otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" done")))
    return table(spark, d, "events").where("props is not null").select("event_id", tx.json_or_raw(reply).alias("r")).select("event_id", "r.*")


# Topics


@query(
    """with t as (select row_id, list_sort(list_distinct(technical_terms)) l from results_simplified where technical_terms is not null), p as (select row_id, unnest(l) a, l from t),
       q as (select row_id, a, unnest(l) b from p) select a as topic_a, b as topic_b, count(distinct row_id) as n from q where a < b group by 1, 2"""
)
def topic_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of terms that a row holds together, with how many rows do."""
    return topics.cooccurring(table(spark, d, "results_simplified"), "row_id", "technical_terms", least=1)


@query("select t as topic, count(distinct video_id) as n from (select video_id, unnest(technical_terms) t from results_simplified) where t is not null and video_id is not null group by 1 having count(distinct video_id) >= 2")
def common_topics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "results_simplified").where("video_id is not null").select("video_id", F.explode("technical_terms").alias("topic"))
    return topics.common(t, "video_id", "topic")


@query(
    """with v as (select label, vec_id, list_transform(embedding, lambda x: cast(x as double)) e, lag(list_transform(embedding, lambda x: cast(x as double))) over (partition by label order by vec_id) p from embeddings)
       select vec_id, cast(floor(list_cosine_similarity(p, e) * 1000000 + 0.5) as bigint) as similarity_ppm from v"""
)
def topic_drift(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each embedding with the one before it of its label."""
    s = topics.drift(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding", width=10_000)
    return s.select("vec_id", F.floor(F.col("similarity") * 1000000 + 0.5).alias("similarity_ppm"))


@query(
    """with v as (select label, vec_id, list_transform(embedding, lambda x: cast(x as double)) e, lag(list_transform(embedding, lambda x: cast(x as double))) over (partition by label order by vec_id) p from embeddings),
       c as (select label, vec_id, case when list_cosine_similarity(p, e) < 0.05 then 1 else 0 end c from v)
       select vec_id, cast(1 + sum(c) over (partition by label order by vec_id rows unbounded preceding) as bigint) as chapter from c"""
)
def chapter_markers(spark: SparkSession, d: str) -> DataFrame:
    return topics.chapters(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding", below=0.05, width=10_000).select("vec_id", "chapter")


@query(
    """with n as (select video_id, seg_index, primary_language l, count(*) v from results_simplified where video_id is not null and seg_index is not null and primary_language is not null group by 1, 2, 3)
       select video_id, seg_index, l as primary_language, v as votes from (select *, row_number() over (partition by video_id, seg_index order by v desc, l) k from n) where k = 1"""
)
def ensemble_vote(spark: SparkSession, d: str) -> DataFrame:
    """The language most deliveries of a segment name."""
    r = table(spark, d, "results_simplified").where("video_id is not null and seg_index is not null")
    return topics.voted(r, ["video_id", "seg_index"], "primary_language")


@query(
    """select user_id, event_type, event_id, k as rank_no from (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) k from events
       where user_id is not null and event_type is not null and value is not null and not isnan(value)) where k <= 2"""
)
def best_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The two highest events of every user and type."""
    best = topics.best_per_source(table(spark, d, "events"), ["user_id"], "event_type", "value", 2, "event_id")
    return best.select("user_id", "event_type", "event_id", F.col("rank_no").cast("bigint").alias("rank_no"))


# Models, dry


@query(
    """with v as (select video_id, duration from videos where duration is not null and not isnan(duration) and duration > 0), n as (select *, case when duration <= 120 then 1 else cast(ceil(duration / 120) as bigint) end n from v),
       c as (select video_id, duration, cast(unnest(generate_series(1, n)) as bigint) chunk_num from n)
       select video_id, chunk_num, cast(floor(least(120.0, duration - (chunk_num - 1) * 120.0) / 4.0) as bigint) as n_segments from c where floor(least(120.0, duration - (chunk_num - 1) * 120.0) / 4.0) > 0"""
)
def transcription_plan(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every video through the stub model."""
    plan = adapters.plan_chunks(table(spark, d, "videos"))
    made = adapters.transcribed(plan, [("stub", adapters.stub_transcriber)])
    return made.groupBy("video_id", "chunk_num").agg(F.count("*").alias("n_segments"))


@query(
    """with s as (select report_id, metadata.duration p, unnest(segments.evaluated) e, unnest(range(0, len(segments.evaluated))) i from reels_extraction_20250825_215033_complete)
       select report_id, i as seg_index, case when e.start_time is not null and e.end_time is not null then p + e.start_time else p end as start, case when e.start_time is not null and e.end_time is not null then p + e.end_time else p + 30 end as end, e.text as text from s"""
)
def recogniser_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a recogniser as segments: times from the pass's start, thirty seconds for one without both times."""
    r = table(spark, d, REPORTS)
    timed = F.transform("segments.evaluated", lambda e: F.struct(F.when(e["start_time"].isNotNull(), F.array(e["start_time"], e["end_time"])).alias("timestamp"), e["text"].alias("text")))
    out = adapters.normalised_chunks(r.select("report_id", F.col("metadata.duration").alias("at"), timed.alias("c")), ["report_id"], "c", "at")
    return out.select("report_id", F.col("seg_index").cast("bigint").alias("seg_index"), "start", "end", "text")


@query("select doc_id, case when text is null or doc_id % 10 = 0 then null else 'heard ' || len(text) end as reply from documents")
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a stub to every document; what it can't answer is null."""

    def ask():
        def client(prompt: str) -> str | None:
            at, _, text = prompt.partition("\n")
            if int(at) % 10 == 0:
                raise TimeoutError
            return f"heard {len(text)}"

        return client

    prompts = _documents(spark, d).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("prompt"))
    return adapters.replies(prompts, "doc_id", "prompt", ask)


@query("select row_id, coalesce(len(list_filter(technical_terms, lambda t: contains(t, 'P'))) > 0, false) as served, coalesce(len(list_filter(technical_terms, lambda t: t is not null)), 0) as n_models from results_simplified")
def models_served(spark: SparkSession, d: str) -> DataFrame:
    """Whether a service's list of models, one for every row, holds the family of a model."""
    listed = F.to_json(F.struct(F.transform("technical_terms", lambda t: F.struct(t.alias("name"))).alias("models")))
    reply = F.when(F.col("technical_terms").isNotNull(), listed).otherwise(F.lit("no service"))
    names = adapters.served_names(reply)
    return table(spark, d, "results_simplified").select("row_id", adapters.model_served(names, "P:8b").alias("served"), F.size(names).cast("bigint").alias("n_models"))


@query(
    r"""select doc_id, 'This is one passage of two minutes of a video. Say what THIS passage holds.' || chr(10) || chr(10) || 'Passage:' || chr(10) || left(text, 1500) || chr(10) || chr(10) || 'Answer with exactly these sections:' || chr(10) || 'SUMMARY:' || chr(10) || '<two or three sentences>' || chr(10) || 'TOPICS:' || chr(10) || '- <topic>' || chr(10) || 'REEL:' || chr(10) || '[M:SS] <why this moment>' || chr(10) as chunk_prompt,
          'These are chunks 1-' || doc_id || ' of 99 of a video. Say what ALL of it holds so far.' || chr(10) || chr(10) || 'Transcript:' || chr(10) || left(text, 3000) || chr(10) || case when len(text) > 3000 then '... (content continues, ' || len(text) || ' total chars)' else '' end || chr(10) || chr(10) || 'Answer with exactly these sections:' || chr(10) || 'SUMMARY:' || chr(10) || '<three to five sentences>' || chr(10) || 'TOPICS:' || chr(10) || '- <topic>' || chr(10) || 'HASHTAGS:' || chr(10) || '#<tag> #<tag>' || chr(10) || 'TOP REELS:' || chr(10) || '[M:SS] <why>' || chr(10) as cumulative_prompt,
          'Analyse this passage of a lesson and answer in English.' || chr(10) || chr(10) || 'Passage:' || chr(10) || left(text, 1500) || chr(10) || chr(10) || 'Answer with exactly these sections:' || chr(10) || 'SUMMARY:' || chr(10) || '<two or three sentences>' || chr(10) || 'TOPICS:' || chr(10) || '- <topic>' || chr(10) || 'HASHTAGS:' || chr(10) || '#<tag>' || chr(10) || 'REEL SEGMENTS:' || chr(10) || '[M:SS - M:SS] <reason>' || chr(10) as analysis_prompt,
          'Choose parts of this video for a reel of 45 to 70 seconds.' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Answer in this form:' || chr(10) || 'PARTS:' || chr(10) || '1. [M:SS - M:SS] <reason>' || chr(10) || 'TOTAL_DURATION: <n>s' || chr(10) || 'NARRATIVE:' || chr(10) || '<one paragraph>' || chr(10) || 'TITLE:' || chr(10) || '<title>' || chr(10) as selection_prompt
       from documents where text is not null"""
)
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of the four kinds over every document's text."""
    t = F.col("text")
    return _documents(spark, d).where("text is not null").select(
        "doc_id", adapters.chunk_prompt(t).alias("chunk_prompt"), adapters.cumulative_prompt(t, F.length(t), F.col("doc_id"), F.lit(99)).alias("cumulative_prompt"),
        adapters.analysis_prompt(t, "English").alias("analysis_prompt"), adapters.selection_prompt(t).alias("selection_prompt"),
    )


# Reports as lines


@query(
    f"""with {SEG}, t as (select video_id, chunk_num, count(*) n, max(chunk_num) over (partition by video_id) newest from chunked group by 1, 2),
        b as (select *, ['CHUNK ' || chunk_num || ' ANALYSIS (Individual)', 'Time: ' || {CS('((chunk_num - 1) * 12000)')} || ' - ' || {CS('(chunk_num * 12000)')}, repeat('─', 70)]
                || case when n % 3 <> 0 then ['Summary: ' || n || ' segments', ''] else []::varchar[] end || ['Topics:', '  • t' || n, ''] || case when n % 2 = 0 then ['Reel Suggestion:', '  0:0' || n % 10 || '-0:30 - first', ''] else []::varchar[] end
                || case when chunk_num = newest then [repeat('═', 70), ''] else []::varchar[] end l from t),
        v as (select video_id, max(chunk_num) newest, count(*) c, cast(sum(n) as bigint) n from t group by 1),
        h as (select *, ['AI CONTENT ANALYSIS (Real-Time)', 'Updated after: Chunk ' || newest || ' of ' || newest + 1, 'Last update: 2025-01-02 03:04:05', 'Generated with: m', repeat('═', 70), ''] l from v),
        w as (select *, ['CUMULATIVE ANALYSIS (Chunks 1-' || newest || ')', repeat('─', 70), 'Overall Summary:', n || ' segments in all', '', 'All Topics:', '  • a', '  • b' || c, ''] || case when c > 1 then ['Best Reel Suggestions (Top 2):', '  1. 0:01-0:02 - x', '  2. 0:03-0:04 - y', ''] else []::varchar[] end
                || ['Suggested Hashtags:', '  #a #b' || c, '', repeat('═', 70), ''] l from v),
        a as (select video_id, unnest([0, 1]) line_no, unnest(['PREVIOUS CHUNKS', repeat('─', 70)]) line from v where c > 1)
        select video_id, 0::int as part, newest as chunk_num, cast(unnest(range(0, len(l))) as int) as line_no, unnest(l) as line from h
        union all select video_id, case when chunk_num = newest then 1 else 3 end, chunk_num, cast(unnest(range(0, len(l))) as int), unnest(l) from b
        union all select video_id, 2, newest, cast(unnest(range(0, len(l))) as int), unnest(l) from w
        union all select video_id, 3, null, cast(line_no as int), line from a"""
)
def progressive_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Progressive summaries as lines: head, newest chunk, analysis of the whole, archive."""
    return _progressive(_chunked(spark, d))


def _progressive(chunked: DataFrame) -> DataFrame:
    c = chunked.groupBy("video_id", "chunk_num").agg(F.count("*").alias("n"))
    n, reel = F.col("n").cast("string"), lambda r, why: F.struct(r.alias("time_range"), F.lit(why).alias("reason"))
    each = c.select(
        "video_id", "chunk_num", F.when(F.col("n") % 3 != 0, F.concat(n, F.lit(" segments"))).alias("summary"), F.array(F.concat(F.lit("t"), n)).alias("topics"),
        F.when(F.col("n") % 2 == 0, F.array(reel(F.concat(F.lit("0:0"), (F.col("n") % 10).cast("string"), F.lit("-0:30")), "first"), reel(F.lit("9:00-9:01"), "second"))).alias("reels"),
        (F.max("chunk_num").over(Window.partitionBy("video_id")) + 1).alias("total_chunks"),
    )
    v = c.groupBy("video_id").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    k = F.col("c").cast("string")
    whole = v.select(
        "video_id", F.concat(n, F.lit(" segments in all")).alias("summary"), F.array(F.lit("a"), F.concat(F.lit("b"), k)).alias("topics"),
        F.when(F.col("c") > 1, F.array(reel(F.lit("0:01-0:02"), "x"), reel(F.lit("0:03-0:04"), "y"))).alias("reels"), F.array(F.lit("#a"), F.concat(F.lit("#b"), k)).alias("hashtags"),
    )
    return render.progressive_summary(each, whole, F.lit("2025-01-02 03:04:05").cast("timestamp"), "m")


@query(
    f"""with {SEG}, t as (select video_id, chunk_num, string_agg(coalesce(text, ''), '' order by start_cs, seg_index) as line from chunked group by 1, 2), n as (select video_id, max(chunk_num) c from t group by 1)
        select video_id, 0::int as part, cast(unnest(range(0, 7)) as bigint) as line_no, unnest(['CUMULATIVE FULL TRANSCRIPT', repeat('=', 60), 'Last updated: Chunk ' || c, 'Updated at: 2025-01-02 03:04:05', '', 'Full transcript so far:', repeat('-', 40)]) as line from n
        union all select video_id, 1, chunk_num * 2, line from t union all select video_id, 1, chunk_num * 2 + 1, '' from t"""
)
def cumulative_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative transcripts as lines, every chunk's text in order."""
    return render.cumulative_report(chunks.chunk_texts(_chunked(spark, d)), F.lit("2025-01-02 03:04:05").cast("timestamp"))


@query(
    f"""with {SEG}, {PARTS}, s as (select video_id, seg_index as item, {OR_NA('start_cs')} || ' - ' || {OR_NA('end_cs')} as r from parts),
        l as (select *, ['SEGMENT ' || item, 'Time: ' || r, 'Why: because', '', 'Cut: --video v.mp4 --ranges "' || replace(replace(r, ' - ', '-'), ' ', '') || '"', repeat('─', 70), ''] l from s)
        select video_id, item, cast(unnest(range(0, 7)) as int) as line_no, unnest(l) as line from l"""
)
def suggested_reel_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the suggestions file with every segment as one."""
    s = _segments(spark, d).select("video_id", F.col("seg_index").alias("item"), _time_range().alias("time_range"), F.lit("because").alias("reason"), F.lit("v.mp4").alias("path"))
    return render.suggested_reels(s, "video_id")


@query(
    f"""with {SEG}, {PARTS}, c as (select video_id, chunk_num, count(*) n, list({OR_NA('start_cs')} || '-' || {OR_NA('end_cs')} order by start_cs, seg_index) r from parts where selection_no = 1 group by 1, 2),
        k as (select video_id * 100000 + chunk_num as analysis_id, chunk_num, n, case when n % 4 = 0 then r else [] end r from c),
        s as (select analysis_id, 'summary' as file, ['AI CONTENT ANALYSIS', 'Generated with: m', repeat('═', 70), '', 'SUMMARY', repeat('─', 70), n || ' parts', '', 'MAIN TOPICS', repeat('─', 70)] || case when n > 1 then ['• a', '• b'] else []::varchar[] end || ['', 'SUGGESTED HASHTAGS', repeat('─', 70), '#x #y' || n, ''] l from k),
        g as (select analysis_id, 'reels' as file, ['SUGGESTED REEL SEGMENTS', 'AI-identified engaging moments for short-form content', repeat('═', 70), ''] || case when len(r) > 0 then flatten(list_transform(r, lambda x, i: ['SEGMENT ' || i, 'Time: ' || x, 'Why: ' || i, '', 'Cut: --video v.mp4 --ranges "' || x || '"', repeat('─', 70), '']))
                else ['No specific reel segments identified.', 'Try cutting interesting moments manually.'] end l from k),
        b as (select * from s union all select * from g)
        select analysis_id, file, cast(unnest(range(0, len(l))) as int) as line_no, unnest(l) as line from b"""
)
def analysis_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """The two files of an analysis of every chunk's first selection, as lines."""
    s = _selections(spark, d).where("selection_no = 1").withColumn("n", F.size("parts"))
    reels = F.transform("parts", lambda p, i: F.struct(F.replace(p["time_range"], F.lit(" - "), F.lit("-")).alias("time_range"), (i + 1).cast("string").alias("reason")))
    a = s.select(
        (F.col("video_id") * 100000 + F.col("chunk_num")).alias("analysis_id"), F.lit("v.mp4").alias("name"), F.concat(F.col("n").cast("string"), F.lit(" parts")).alias("summary"),
        F.when(F.col("n") > 1, F.array(F.lit("a"), F.lit("b"))).alias("topics"), F.array(F.lit("#x"), F.concat(F.lit("#y"), F.col("n").cast("string"))).alias("hashtags"), F.when(F.col("n") % 4 == 0, reels).alias("reels"),
    )
    return render.analysis_files(a, "analysis_id", "m")


@query(
    """with h as (select distinct video_id from results_qwen15b where video_id is not null and value_score is not null and not isnan(value_score)),
       s as (select video_id, cast(least(floor(round(value_score * 1000) / 200), 4) as int) b, row_id, cast(round(value_score * 1000) as bigint) m, seg_index,
               case when not isnan(start_seconds) then cast(round(start_seconds * 100) as bigint) end a, cast(round(case when isnan(end_seconds) then null else end_seconds end * 100) as bigint) z, text
             from results_qwen15b where video_id is not null and value_score is not null and not isnan(value_score)),
       bins as (select h.video_id, e.b, e.bin, count(s.b) n from h cross join (select unnest([0, 1, 2, 3, 4]) b, unnest(['0.0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1.0']) bin) e left join s on s.video_id = h.video_id and s.b = e.b group by 1, 2, 3),
       t as (select * from (select *, row_number() over (partition by video_id order by m desc, row_id) k from s where m >= 500) where k <= 3),
       lines as (
         select video_id, 0 part, unnest([0, 1, 2]) line_no, unnest(['=== DETAILED ANALYSIS REPORT ===', '', 'SCORE DISTRIBUTION']) line from h
         union all select video_id, 1, b * 2, '  ' || bin || ': ' || n || ' segments' from bins
         union all select video_id, 2, unnest([0, 1]), unnest(['', 'TOP SEGMENTS']) from (select distinct video_id from t)
         union all select video_id, 3, k * 2, k || '. Score: ' || ((m + 5) // 10 // 100) || '.' || lpad(cast((m + 5) // 10 % 100 as varchar), 2, '0') || ' | ' || case when a >= 0 then (a // 6000) || ':' || lpad(cast(a % 6000 // 100 as varchar), 2, '0') else 'N/A' end || '-' || case when z >= 0 then (z // 6000) || ':' || lpad(cast(z % 6000 // 100 as varchar), 2, '0') else 'N/A' end from t
         union all select video_id, 3, k * 2 + 1, '   Text: ' || case when len(text) > 100 then left(text, 100) || '...' else coalesce(text, '') end from t)
       select video_id, cast(part as int) as part, cast(line_no as int) as line_no, line from lines"""
)
def analysis_report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Histogram and three top segments of every video, as lines, with or without bounds; one that is missing or before 0 is N/A."""
    r = table(spark, d, "results_qwen15b").where("video_id is not null and value_score is not null and not isnan(value_score)")
    s = r.select("video_id", "row_id", "text", F.round(F.col("value_score") * 1000).cast("bigint").alias("score_milli"), tc.to_cs(F.col("start_seconds")).alias("start_cs"), tc.to_cs(F.col("end_seconds")).alias("end_cs"))
    top = best_rows(s.where("score_milli >= 500"), ["video_id"], "score_milli", ["row_id"], 3)
    return render.analysis_report(scoring.histogram(r, ["video_id"]), top, ["video_id"])


@query(
    """with m as (select video_id, case when value_score is not null and not isnan(value_score) then cast(round(value_score * 1000) as bigint) end m from results_qwen15b where video_id is not null),
       s as (select video_id, count(*) t, count(*) filter (m >= 500) h, cast(floor(count(*) filter (m >= 500) * 1000 / count(*)) as bigint) p, cast(floor(sum(m) / count(m)) as bigint) a, min(m) lo, max(m) hi from m group by 1)
       select video_id, cast(unnest([0, 1, 2, 3]) as int) as line_no, unnest(['=== CONTENT EXTRACTION SUMMARY ===', 'Total Segments: ' || t, 'High-Value Segments: ' || h, 'Success Rate: ' || (p // 10) || '.' || (p % 10) || '%']) as line from s
       union all select video_id, 4, 'Average Score: ' || coalesce(((a + 5) // 10 // 100) || '.' || lpad(cast((a + 5) // 10 % 100 as varchar), 2, '0'), 'N/A') from s
       union all select video_id, 5, 'Score Range: ' || coalesce(((lo + 5) // 10 // 100) || '.' || lpad(cast((lo + 5) // 10 % 100 as varchar), 2, '0'), 'N/A') || ' - ' || coalesce(((hi + 5) // 10 // 100) || '.' || lpad(cast((hi + 5) // 10 % 100 as varchar), 2, '0'), 'N/A') from s"""
)
def run_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.run_summary(scoring.summary(table(spark, d, "results_qwen15b").where("video_id is not null"), ["video_id"]), ["video_id"])


@query(
    """with e as (select report_id, s.start_time a, s.end_time b, count(*) n from (select report_id, unnest(segments.evaluated) s from (select distinct on (report_id) * from reels_extraction_20250825_215033_complete)) group by 1, 2, 3),
       h as (select report_id, s.start_time a, s.end_time b, count(*) n from (select report_id, unnest(segments.high_value) s from (select distinct on (report_id) * from reels_extraction_20250825_215033_complete)) group by 1, 2, 3)
       select count(*) as n_missing from h left join e on h.report_id = e.report_id and h.a is not distinct from e.a and h.b is not distinct from e.b where e.n is null or e.n < h.n"""
)
def high_value_subset(spark: SparkSession, d: str) -> DataFrame:
    """How many of the reports' high-value segments aren't among their evaluated ones."""
    r = table(spark, d, REPORTS)

    def part(name: str) -> DataFrame:
        s = r.select("report_id", F.posexplode(f"segments.{name}").alias("i", "s")).groupBy("report_id", "i").agg(F.min(F.struct("s.start_time", "s.end_time")).alias("s"))
        return s.groupBy("report_id", F.col("s.start_time").alias("a"), F.col("s.end_time").alias("b")).agg(F.count("*").alias(name))

    h, e = part("high_value"), part("evaluated")
    both = h.join(e.withColumnsRenamed({"report_id": "r", "a": "x", "b": "y"}), (F.col("report_id") == F.col("r")) & F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y")), "left")
    return both.agg(F.count_if(F.coalesce("evaluated", F.lit(0)) < F.col("high_value")).alias("n_missing"))


@query(
    f"""with {SEG}, c as (select *, case when start_cs - max(greatest(start_cs, coalesce(end_cs, start_cs))) over (partition by video_id order by start_cs, seg_index rows between unbounded preceding and 1 preceding) > 300 then 1 else 0 end g,
          row_number() over (partition by video_id order by start_cs, seg_index) k from seg)
        select video_id, count(*) filter (k = 1 or g = 1) as n_clusters from c group by 1"""
)
def time_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of segments with at most three seconds of silence inside."""
    c = selection.clustered(_segments(spark, d), ["video_id"], within_cs=300)
    return c.groupBy("video_id").agg(F.max("cluster").alias("n_clusters"))


@query(
    f"""with {LINES}, t as (select doc_id, count(*) filter (section = 'topics' and substr(line, 1, 1) in ('-', '•') and regexp_replace(substr(line, 2), '^[\\\\s\\\\pZ]+|[\\\\s\\\\pZ]+$', '', 'g') <> '') n_topics from body group by 1)
        select d.doc_id, t.doc_id is not null as parsed, cast(t.n_topics as int) as n_topics from documents d left join t on d.doc_id = t.doc_id"""
)
def analysis_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a nested analysis where it has sections."""
    a = sections.analysis_documents(_documents(spark, d), "doc_id", "text")
    return a.select("doc_id", F.col("document").isNotNull().alias("parsed"), F.col("document.topics.n").alias("n_topics"))


# Smaller pieces of reports


@query(
    r"""select doc_id, (len(text) - len(replace(text, 'SUMMARY:', ''))) // 8 as n_summaries, left(text, 60) || '...' as shown, upper(text) like '%TOPICS:%' as has_topics from documents"""
)
def text_probes(spark: SparkSession, d: str) -> DataFrame:
    """How often a marker stands in a document, its preview, and whether a word is in it in any case."""
    t = F.col("text")
    return _documents(spark, d).select("doc_id", tx.occurrences(t, "SUMMARY:").alias("n_summaries"), tx.preview(t).alias("shown"), tx.has(t, "TOPICS:").alias("has_topics"))


@query(
    r"""select doc_id, case when instr(text, 'SUMMARY:') > 0 then regexp_replace(coalesce(string_split(substr(text, instr(text, 'SUMMARY:'), 500), chr(10))[2], ''), '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') end as said
        from documents where text is not null and instr(text, 'SUMMARY:') > 0"""
)
def line_after_marker(spark: SparkSession, d: str) -> DataFrame:
    """The line after the one that first holds a marker, of every text that holds it."""
    t = _documents(spark, d).where(F.instr("text", "SUMMARY:") > 0)
    return t.select("doc_id", tx.line_after(F.col("text"), "SUMMARY:").alias("said"))


@query(
    r"""with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no, unnest(string_split(text, chr(10))) as raw from documents where text is not null),
        s as (select doc_id, line_no, regexp_replace(raw, '^[\s\pZ\x0b\x85]+|[\s\pZ\x0b\x85]+$', '', 'g') as line from l),
        m as (select *, case when contains(upper(line), 'TOPICS:') then 1 when starts_with(line, '═') or starts_with(line, 'Suggested Hashtags') then 0 end as mark from s),
        f as (select *, last_value(mark ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding) as inside from m)
        select doc_id, count(*) as n_topics from f where inside = 1 and mark is null and starts_with(line, '•') group by 1"""
)
def pooled_topics(spark: SparkSession, d: str) -> DataFrame:
    """Bullets under any topics line of a document, up to a rule line."""
    return sections.summary_topics(_documents(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_topics"))


@query(
    """select video_id, regexp_extract(n, '^([^_]*)_([^_]*)_(.*)$', 1) as run_date, regexp_extract(n, '^([^_]*)_([^_]*)_(.*)$', 2) as run_time, regexp_extract(n, '^([^_]*)_([^_]*)_(.*)$', 3) as video
       from (select video_id, '2025-11-17_221415_' || replace(replace(name, ' ', '_'), '.', '-') as n from videos where name is not null)"""
)
def run_directory_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.lit("2025-11-17_221415_"), F.translate("name", " .", "_-"))
    return table(spark, d, "videos").where("name is not null").select("video_id", sections.run_directory(n).alias("r")).select("video_id", "r.*")


@query(
    f"""with {SEG}, t as (select video_id, count(*) n_chunks, cast(sum(n) as bigint) tenths from (select video_id, chunk_num, count(*) n from chunked group by 1, 2) group by 1), v as (select v.video_id, path, duration, l.l from videos v left join (select video_id, arg_min(primary_language, (chunk_num, row_id)) l from results_simplified where primary_language is not null and chunk_num is not null group by 1) l on l.video_id = v.video_id),
        lines as (
          select video_id, 0 part, unnest(range(0, 14)) line_no, unnest(['FINAL TRANSCRIPTION SUMMARY', repeat('=', 60), '', 'Video: ' || coalesce(path, ''), 'Model used: N/A', 'Language detected: ' || coalesce(l, 'N/A'),
            'Video Length: ' || case when duration is null or isnan(duration) then 'N/A' else {CS('cast(round(duration * 100) as bigint)')} end, '', 'Full transcript:', repeat('-', 40), '', '', 'Segments with timestamps:', repeat('-', 40)]) line from v
          union all select video_id, 1, seg_index, '[' || {CS('start_cs')} || ' - ' || {CS('coalesce(end_cs, start_cs)')} || '] ' || {STRIP("coalesce(text, '')")} from seg
          union all select video_id, 2, unnest(range(0, 4)), unnest(['', 'PROCESSING INFORMATION', repeat('-', 40), 'Total processing time: ' || (tenths // 10) || '.' || (tenths % 10) || ' seconds']) from t
          union all select c.video_id, 3, c.chunk_num, 'Chunk ' || c.chunk_num || ' processing time: ' || (c.n // 10) || '.' || (c.n % 10) || ' seconds' from (select video_id, chunk_num, count(*) n from chunked group by 1, 2) c join t on t.video_id = c.video_id and t.n_chunks > 1)
        , texts as (select video_id, chunk_num, string_agg(coalesce(text, ''), '' order by start_cs, seg_index) as line from chunked group by 1, 2)
        select video_id, cast(case when part > 0 then part + 2 when line_no < 10 then 0 else 2 end as int) as part, cast(case when part = 0 and line_no >= 10 then line_no - 10 else line_no end as bigint) as line_no, line from lines
        union all select video_id, 1, chunk_num * 2, line from texts
        union all select video_id, 1, chunk_num * 2 + 1, '' from texts"""
)
def final_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Final summaries as lines, with the whole transcript: the texts of a video's chunks in order, each a line of its own."""
    c = _chunked(spark, d)
    v = table(spark, d, "videos").select("video_id", "path", F.lit(None).cast("string").alias("model"), tc.to_cs(F.col("duration")).alias("duration_cs"))
    v = v.join(first_language(spark, d).withColumnRenamed("primary_language", "language"), "video_id", "left")
    timings = c.groupBy("video_id", "chunk_num").agg(F.count("*").alias("tenths"))
    return render.final_summary(v, chunks.chunk_texts(c), c, timings)


# Streams over the same tables, read to their end


@query(SQL["p3_found"])
def stream_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Periods and gaps from interval maps kept as keyed state of a stream."""
    folder, stream = shared_folder(spark), table_stream(spark, d, "results_qwen15b")
    out = interval_streams.slab_periods(stream, "video_id", "start_seconds", "end_seconds", slab=360_000)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    newest = interval_streams.newest(spark.read.schema(out.schema).parquet(f"{folder}/out"))
    both = merged(newest.select("entity", (F.col("a") / 100).alias("s"), (F.col("b") / 100).alias("e")), "entity", "s", "e")
    return both.select(F.col("entity").alias("video_id"), "kind", "from_cs", "to_cs")


@query(
    """select video_id, start_cs // 12000 + 1 as chunk_num, count(*) as n_segments, cast(sum(greatest(coalesce(end_cs - start_cs, 0), 0)) as bigint) as spoken_cs from (
         select video_id, cast(round(start_time * 100) as bigint) start_cs, cast(round(end_time * 100) as bigint) end_cs from results_simplified where video_id is not null and start_time is not null) group by 1, 2"""
)
def stream_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every chunk as a keyed running aggregate of a stream of deliveries."""
    folder, counts = shared_folder(spark), chunk_streams.chunk_counts(table_stream(spark, d, "results_simplified"))
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/out")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/out")



@query(SQL["transcript_parts"])
def stream_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Whole transcripts as parts, rewritten for the videos that each batch of a stream of deliveries touches; the stream is started a second time and goes on where it was."""
    folder, stream = shared_folder(spark), table_stream(spark, d, "results_simplified").where("video_id is not null")
    render_ = lambda rows: chunks.transcript(chunks.chunk_texts(chunks.assigned(chunks.segments(rows))))
    out = "video_id bigint, part_no bigint, chunk_num bigint, part string, __bucket int"
    spark.createDataFrame([], out).write.partitionBy("__bucket").parquet(f"{folder}/out")  # so there is a table if the stream is empty
    for _ in range(2):
        chunk_streams.rewriting(stream, f"{folder}/store", f"{folder}/state", render_, f"{folder}/out").awaitTermination()
    return spark.read.schema(out).parquet(f"{folder}/out").drop("__bucket")


@query(SQL["progressive_summary_lines"])
def stream_progressive_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Progressive summaries rewritten for the videos that each batch of a stream touches: the newest chunk moves to the archive when the next arrives."""
    folder, stream = shared_folder(spark), table_stream(spark, d, "results_simplified").where("video_id is not null")
    out = "video_id bigint, part int, chunk_num bigint, line_no int, line string, __bucket int"
    spark.createDataFrame([], out).write.partitionBy("__bucket").parquet(f"{folder}/out")
    render_ = lambda rows: _progressive(chunks.assigned(chunks.segments(rows)))
    chunk_streams.rewriting(stream, f"{folder}/store", f"{folder}/state", render_, f"{folder}/out").awaitTermination()
    return spark.read.schema(out).parquet(f"{folder}/out").drop("__bucket")


@query("select video_id, chunk_num, seg_index, text from results_simplified where video_id is not null and chunk_num is not null")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a stream appended to their chunk's folder as they come."""
    folder = shared_folder(spark)
    s = table_stream(spark, d, "results_simplified").where("video_id is not null and chunk_num is not null").select("video_id", "chunk_num", "seg_index", "text")
    s.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{folder}/out")