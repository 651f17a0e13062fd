"""Queries of the training-text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .encode import encoded
from .forms import canonical_form, look_key, prototypes, same_look_pairs
from .language import MIN_WORDS, fit, labelled_sample, languages
from .leaks import leaks
from .stuffing import stuffed_pages
from .topn import best_segments
from .turns import calibrated_pause, labels_of, speaker_turns, turn_texts


def _languages(spark: SparkSession, d: str) -> DataFrame | None:
    try:
        model = fit(labelled_sample(table(spark, d, "documents")))
    except ValueError:  # without a labelled text no language is known
        return None
    return languages(table(spark, d, "results_simplified"), model, "row_id", label="primary_language", labels=labels_of(table(spark, d, "speaker_roster")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose language label is missing or wrong, with their language, and mixed rows with each of theirs."""
    rows = _languages(spark, d)
    if rows is None:  # none is missing or wrong
        return table(spark, d, "results_simplified").select("row_id", F.lit(None).cast("string").alias("lang")).limit(0)
    return cases(rows, "row_id").select("row_id", "lang")


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language or languages of every row of speech, each with its confidence and words."""
    rows = _languages(spark, d)
    if rows is None:
        return table(spark, d, "results_simplified").selectExpr("row_id", "'' as lang", "0D as confidence", "0 as words", "0 as n_languages").limit(0)
    return rows.select("row_id", "lang", "confidence", "words", "n_languages")


def cases(found: DataFrame, key: str) -> DataFrame:
    """Of the result of ``languages`` the rows of mixed texts and of texts whose label names no language or another one."""
    return found.where(F.col("spoken") >= MIN_WORDS).where((F.col("n_languages") > 1) | F.col("labelled").isNull() | (F.col("labelled") != F.col("lang")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Segments and transcript lines that look the same, but aren't equal as stored."""
    return same_look_pairs(table(spark, d, "results_simplified"), table(spark, d, "full_transcript"), ["video_id", "chunk_num"], "row_id", "line_id")


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text of segments and transcript lines in one form, with the digest of its look, which is equal exactly for texts that look the same."""
    known = prototypes(spark)
    rows = table(spark, d, "results_simplified").select(F.lit("row").alias("kind"), F.col("row_id").alias("id"), "text")
    lines = table(spark, d, "full_transcript").select(F.lit("line").alias("kind"), F.col("line_id").alias("id"), "text")
    return rows.unionByName(lines).select("kind", "id", canonical_form("text", known).alias("form"), F.md5(look_key("text", known)).alias("look"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Speaker turns of every video."""
    turns = speaker_turns(table(spark, d, "results_simplified"), labels_of(table(spark, d, "speaker_roster")), with_text=False)
    return turns.select("video_id", "speaker_key", "first_seg", "last_seg")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """What was said in every turn, parted at changes of the speaker and at pauses of a calibrated length, without what rolling captions repeat."""
    s = table(spark, d, "results_simplified")
    return turn_texts(s, labels_of(table(spark, d, "speaker_roster")), pause_s=calibrated_pause(s))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The three evaluated segments of highest score of every audio path."""
    return best_segments(table(spark, d, "reels_extraction_20250825_215033_complete"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoded(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items they leak."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_covered(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items of which they hold two fifths or more in passages of at least six words, in any order."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), least=6, least_cover=0.4)
    return found.select("doc_id", "item_id", "tiles", "longest", F.floor(F.col("coverage") * 1000).alias("covered_permille"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Keyword-stuffed pages and link lists."""
    return stuffed_pages(table(spark, d, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_languages": p1_languages,
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p4_found": p4_found,
    "p4_turns": p4_turns,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_covered": p7_covered,
    "p8_found": p8_found,
}

#: What the other queries compute isn't expressible in SQL; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "p5_found": """with r as (select distinct on (report_id) report_id, metadata.audio_path p, segments.evaluated e from reels_extraction_20250825_215033_complete where metadata.audio_path is not null),
       x as (select p, report_id, unnest(range(0, len(e))) i, unnest(e) s from r)
       select p as audio_path, k as rank_no, report_id, i as seg_no from (
         select *, row_number() over (partition by p order by s.value_score desc, report_id, i) k from x
         where s.value_score is not null and not isnan(s.value_score)) where k <= 3"""
}
