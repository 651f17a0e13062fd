"""Speaker turns from the timed segments of an automatic transcript.

Segments are swept in time within (video, slab) groups, a slab being a stretch
of media time, so a video that holds a third of all rows spreads over as many
groups as it has slabs. What a slab needs from the ones before it (who spoke
last) and after it (where its last turn ends) goes through one summary row per
slab. Everything but taking the text apart is built-in expressions.

Defined results: rows without a video or segment number are left out; of
repeated deliveries of a segment one counts whole, of those with spoken words
the one of the least row_id, then of the least content; segments without
spoken words belong to no turn and part none, words before anybody was named
belong to nobody, segments with neither a start nor a time mark at their head
come last in their video, in the order of their numbers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .arrow import map_rows
from .speech import Labels, head_seconds, pieces

SLAB_S = 300.0
#: Segments without any time to a slab, by number.
SLAB_SEGMENTS = 128
MAX_ROSTER = 100_000
_LAST = 1e15


def labels_of(roster: DataFrame, key: str = "speaker_key", names: tuple[str, ...] = ("display_name", "name_he"), role: str | None = "role") -> Labels:
    """Label resolver of a roster. Its size is checked, as it goes to every task."""
    rows = roster.select(key, *names, *([role] if role else [])).where(F.col(key).isNotNull()).orderBy(key).limit(MAX_ROSTER + 1).collect()
    if len(rows) > MAX_ROSTER:
        raise ValueError(f"a roster of more than {MAX_ROSTER} speakers: split it by channel and call once for each")
    return Labels([(r[key], [r[n] for n in names if r[n]], r[role] if role else None) for r in rows])


def overlap(before: list[str], now: list[str], least: int = 2) -> int:
    """Length of the longest suffix of ``before`` that is a prefix of ``now``, 0 if under ``least``; linear, by the failure function."""
    if not before or not now:
        return 0
    fail = [0] * len(now)
    k = 0
    for i in range(1, len(now)):
        while k and now[i] != now[k]:
            k = fail[k - 1]
        k += now[i] == now[k]
        fail[i] = k
    k = 0
    for w in before[-len(now) :]:
        while k and (k == len(now) or w != now[k]):
            k = fail[k - 1]
        k += w == now[k]
    return k if k >= least else 0


def spoken_pieces(segments: DataFrame, labels: Labels, keep_text: bool = True, slab_s: float = SLAB_S, delivery: str = "row_id") -> DataFrame:
    """One row per stretch of words: video_id, slab, at (s), until (s), seg_index, piece, speaker (as labelled, null if not), words, said.

    A delivery is taken apart before one of each segment is chosen, so texts
    aren't shuffled where they aren't kept.
    """
    shared = segments.sparkSession.sparkContext.broadcast(labels)
    schema = StructType.fromDDL("video_id bigint, seg_index bigint, delivery bigint, at double, until double, parts array<struct<piece: int, speaker: string, words: int, said: string>>")

    def start():
        known = shared.value

        def one(video, seg, row, start, end, text, speaker):
            parts = pieces(text, known)
            if not parts:
                return []
            if start is None or start != start:
                start = head_seconds(text)
            named = [(i, known.resolve(speaker) if key is None and i == 0 else key, len(words), " ".join(words) if keep_text else None) for i, (key, words) in enumerate(parts)]
            return [(video, seg, row, _LAST if start is None else start, None if end != end else end, [dict(zip(("piece", "speaker", "words", "said"), x)) for x in named])]

        return one

    picked = segments.select(
        F.col("video_id").cast("bigint").alias("video_id"), F.col("seg_index").cast("bigint").alias("seg_index"), (F.col(delivery) if delivery in segments.columns else F.lit(None)).cast("bigint").alias("delivery"),
        F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), "text", "speaker_id",
    ).where("video_id is not null and seg_index is not null and text is not null")
    content = F.struct("at", "until", "parts")
    once = map_rows(picked, start, schema).groupBy("video_id", "seg_index").agg(F.min(F.struct(F.col("delivery").isNull().alias("n"), "delivery", content.alias("x"))).alias("d"))
    pieces_ = once.select("video_id", "seg_index", F.col("d.x.at").alias("at"), F.col("d.x.until").alias("until"), F.inline("d.x.parts"))
    slab = F.floor(F.col("at") / F.lit(slab_s)).cast("bigint") + F.when(F.col("at") >= _LAST, F.floor(F.col("seg_index") / SLAB_SEGMENTS)).otherwise(0)
    return pieces_.withColumn("slab", slab)


def _numbered(segments: DataFrame, labels: Labels, pause_s: float | None, with_text: bool, slab_s: float) -> DataFrame:
    """Stretches of words with their speaker (who), turn (its number in the slab, 0 where it goes on from before) and with_text carried (what was said last before the slab)."""
    parts = spoken_pieces(segments, labels, with_text, slab_s)
    w = Window.partitionBy("video_id", "slab").orderBy("at", "seg_index", "piece")
    before = Window.partitionBy("video_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    place = ["at", "seg_index", "piece"]
    slabs = parts.groupBy("video_id", "slab").agg(
        F.max(F.when(F.col("speaker").isNotNull(), F.struct(*place, "speaker"))).alias("m"), F.max("until").alias("most"),
        *([F.max(F.struct(*place, "said")).alias("l")] if with_text else []),
    )
    carried = slabs.select(
        "video_id", "slab", F.last("m.speaker", True).over(before).alias("carry"), F.max("most").over(before).alias("most_before"), *([F.last("l.said").over(before).alias("carried")] if with_text else []),
    )
    swept = (
        parts.join(carried, ["video_id", "slab"])
        .withColumn("who", F.coalesce(F.last("speaker", True).over(w), "carry"))
        .where(F.col("who").isNotNull())
        .withColumn("prev", F.coalesce(F.lag("who").over(w), "carry"))
    )
    starts = F.col("prev").isNull() | (F.col("who") != F.col("prev"))
    if pause_s is not None:
        ended = F.greatest(F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("most_before"))
        starts = starts | F.coalesce(F.col("at") - ended > F.lit(pause_s), F.lit(False))
    return swept.withColumn("turn", F.sum(starts.cast("int")).over(w))


def _by_slab(numbered: DataFrame, *more: Column) -> DataFrame:
    """Turns within their slabs: who, first and last place (a, z), to_s, n_words, and open: whether one may be part of a turn in another slab."""
    place = F.struct("at", "seg_index", "piece")
    turns = numbered.groupBy("video_id", "slab", "turn", "who").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.max("until").alias("to_s"), F.sum("words").alias("n_words"), *more)
    last = F.max("turn").over(Window.partitionBy("video_id", "slab"))
    # Of a slab only its first stretch, if it goes on from before, and its last can be part of a turn in another slab.
    return turns.withColumn("open", (F.col("turn") == 0) | (F.col("turn") == last))



def speaker_turns(segments: DataFrame, labels: Labels, pause_s: float | None = None, with_text: bool = True, slab_s: float = SLAB_S) -> DataFrame:
    """Turns: video_id, speaker_key, first_seg, last_seg, from_s, to_s, n_words, and said if with_text.

    A turn is a longest run of words of one speaker; with pause_s also a
    silence longer than that parts two turns. said joins the texts of the
    turn in order, without the words at a segment's start that repeat the
    end of the one before it, as rolling captions do; it is one value, for
    turns that fit one: ``turn_texts`` is for any length.
    """
    texts = [F.sort_array(F.collect_list(F.struct("at", "seg_index", "piece", "said"))).alias("texts")] if with_text else []
    turns = _by_slab(_numbered(segments, labels, pause_s, with_text, slab_s), *texts)
    out = ["video_id", "who", "a", "z", "to_s", "n_words"] + (["texts"] if with_text else [])
    joined = (
        turns.where("open").withColumn("run", _run()).groupBy("video_id", "run", "who")
        .agg(F.min("a").alias("a"), F.max("z").alias("z"), F.max("to_s").alias("to_s"), F.sum("n_words").alias("n_words"), *([F.flatten(F.sort_array(F.collect_list("texts"))).alias("texts")] if with_text else []))
    )
    whole = turns.where("not open").select(*out).unionByName(joined.select(*out))
    result = whole.select(
        "video_id", F.col("who").alias("speaker_key"), F.col("a.seg_index").alias("first_seg"), F.col("z.seg_index").alias("last_seg"),
        F.when(F.col("a.at") < _LAST, F.col("a.at")).alias("from_s"), "to_s", "n_words", *(["texts"] if with_text else []),
    )
    return result.withColumn("said", _rolled(F.transform("texts", lambda x: x["said"]), F.lit(None).cast("string"))).drop("texts") if with_text else result


def _run() -> Column:
    """Number of the turn in its video among those that may span slabs."""
    return F.sum((F.col("turn") > 0).cast("int")).over(Window.partitionBy("video_id").orderBy("slab", "turn"))


def turn_texts(segments: DataFrame, labels: Labels, pause_s: float | None = None, slab_s: float = SLAB_S) -> DataFrame:
    """What was said in each turn, in parts: video_id, speaker_key, turn_seg (first segment of the turn), part_no (from 1), first_seg, last_seg, n_words, said.

    A part is what a turn holds of one slab of media time, so no turn is ever
    one value, however long. The words with which a segment repeats the end of
    the turn so far are left out; across two slabs, of its segment before.
    """
    texts = F.sort_array(F.collect_list(F.struct("at", "seg_index", "piece", "said"))).alias("texts")
    turns = _by_slab(_numbered(segments, labels, pause_s, True, slab_s), texts, F.first("carried").alias("carried"))
    said = _rolled(F.transform("texts", lambda x: x["said"]), F.when(F.col("turn") == 0, F.col("carried")))
    parts = turns.withColumn("said", said).drop("texts", "carried")
    # The places of open turns, at most two rows a slab, say where each began and which part of it this is.
    each = Window.partitionBy("video_id", "run")
    runs = parts.where("open").select("video_id", "slab", "turn", "a").withColumn("run", _run())
    runs = runs.select("video_id", "slab", "turn", F.min("a").over(each)["seg_index"].alias("turn_seg"), F.row_number().over(each.orderBy("slab")).alias("part_no"))
    return parts.join(runs, ["video_id", "slab", "turn"], "left").select(
        "video_id", F.col("who").alias("speaker_key"), F.coalesce("turn_seg", "a.seg_index").alias("turn_seg"), F.coalesce("part_no", F.lit(1)).cast("bigint").alias("part_no"),
        F.col("a.seg_index").alias("first_seg"), F.col("z.seg_index").alias("last_seg"), "n_words", "said",
    )


def roll_up(texts: list[str], before: str | None = None) -> str:
    """Texts joined, each without the words with which it repeats the end of what is there, ``before`` standing before them all."""
    words = before.split() if before else []
    own = len(words)
    for t in texts:
        now = t.split()
        words += now[overlap([x.casefold() for x in words[-len(now) :]], [x.casefold() for x in now]) :]
    return " ".join(words[own:])


def _rolled(texts: Column, before: Column) -> Column:
    @F.pandas_udf(StringType())
    def rolled(t: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([roll_up(x, y) for x, y in zip(t, b)], dtype=object)

    return rolled(texts, before)


def calibrated_pause(segments: DataFrame, quantile: float = 0.95, floor_s: float = 0.5) -> float:
    """The pause that parts turns: a quantile of the pauses between neighbouring segments of all videos, at least floor_s."""
    t = segments.select("video_id", "seg_index", "start_time", "end_time").where("video_id is not null and seg_index is not null and not isnan(start_time) and not isnan(end_time)")
    t = t.groupBy("video_id", "seg_index").agg(F.min("start_time").alias("s"), F.min("end_time").alias("e")).withColumn("slab", F.floor(F.col("s") / SLAB_S))
    gap = F.col("s") - F.max("e").over(Window.partitionBy("video_id", "slab").orderBy("s", "seg_index").rowsBetween(Window.unboundedPreceding, -1))
    row = t.select(gap.alias("gap")).where("gap > 0").agg(F.percentile_approx("gap", quantile, 1000)).first()
    return max(floor_s, float(row[0])) if row and row[0] is not None else floor_s
