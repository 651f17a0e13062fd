import pytest
from pyspark.sql import functions as F

from chronocue.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean_rtl(spark):
    assert one(spark, "‫x[PAD]y‏‮", tx.clean_rtl) == "xy‮"
    assert one(spark, None, tx.clean_rtl) is None


@pytest.mark.parametrize("path, stem", [("a/my video.v2.mp4", "my_video-v2"), ("x.MP4", "x"), ("/p/noend", "noend"), (".hidden", "-hidden"), ("", "")])
def test_sanitized_stem(spark, path, stem):
    assert one(spark, path, tx.sanitized_stem) == stem


def test_cuts(spark):
    assert one(spark, "abcdef", lambda c: tx.cut(c, 3, "..")) == "abc.."
    assert one(spark, "abc", lambda c: tx.cut(c, 3, "..")) == "abc"
    assert one(spark, "x" * 301, lambda c: tx.cut_within(c, 300)) == "x" * 297 + "..."
    assert one(spark, "why", lambda c: tx.preview(c)) == "why..."
    assert one(spark, "abcdefgh", lambda c: tx.smart_cut(c, 4)) == "ab\n...\ngh"
    assert one(spark, "abcdefgh", lambda c: tx.smart_cut(c, 4, "end")) == "efgh"


def test_lines_of_replies(spark):
    line = "1. [0:10.0 - 0:20] - because"
    df = spark.createDataFrame([(line,)], "x string")
    r = tx.first_range(F.col("x"))
    got = df.select(r.alias("r"), tx.reason_after(F.col("x"), r, "d").alias("why"), tx.bracketed(F.col("x")).alias("b")).first()
    assert (got.r, got.why) == ("0:10.0 - 0:20", "because") and tuple(got.b) == ("0:10.0 - 0:20", "- because")
    assert one(spark, "[0:10]", tx.bracketed) is None
    assert one(spark, "] 1-2 [", tx.bracketed) is None
    assert one(spark, "0:10 - 0:20 - 0:30", lambda c: tx.canonical_range(c)) == "0:10-0:20-0:30"


def test_hashtags_and_bullets(spark):
    assert one(spark, "#שלום_a x #b, c#d", tx.hashtags) == ["#שלום_a", "#b", "#d"]
    assert one(spark, "#a, b #c", tx.hash_words) == ["#a,", "#c"]
    assert one(spark, "• topic ", tx.bullet) == "topic"
    assert one(spark, "-", tx.bullet) is None and one(spark, "x", tx.bullet) is None


def test_small_ones(spark):
    assert one(spark, "TOTAL_DURATION: 65s", tx.seconds_named) == 65 and one(spark, "none", tx.seconds_named) == 0
    assert one(spark, "Chunk 1 Chunk 2", lambda c: tx.occurrences(c, "Chunk ")) == 2
    assert one(spark, "Overall Summary:\n the line \nmore", lambda c: tx.line_after(c, "Overall Summary:")) == "the line"
    assert one(spark, 'a {"b": {"c": 1}} d', tx.json_object) == '{"b": {"c": 1}}'
    assert one(spark, " a  b\n", tx.word_count) == 2
