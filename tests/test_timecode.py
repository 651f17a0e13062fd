import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronocue.functions import timecode as tc


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, seconds",
    [("1:00.26", 60.26), ("1:42.30", 102.3), ("2:06.68", 126.68), ("45.50", 45.5), ("1:23", 83.0), ("0:15", 15.0), ("10:00.25", 600.25), ("1:02:03", 62.0), (" 2:45.50 ", 165.5), ("", None), ("x", None), ("1:x", None), (":5", None), (None, None), ("nan", None), ("1.5:2", None)],
)
def test_parse_timestamp(spark, text, seconds):
    got = one(spark, text, "string", tc.parse_timestamp)
    assert got == (None if seconds is None else pytest.approx(seconds))


@pytest.mark.parametrize("text, pair", [("1:00.26-1:07.16", (60.26, 67.16)), ("0:10 - 0:20", (10, 20)), ("5:00-4:00", None), ("1-2-3", None), ("", None), (None, None), ("3-3", None), ("-1-2", None)])
def test_parse_range(spark, text, pair):
    got = one(spark, text, "string", tc.parse_range)
    assert got == (None if pair is None else pytest.approx(pair))


def test_range_list_keeps_order_and_skips_blanks(spark):
    got = one(spark, "0:30-0:40, ,0:10-0:20,bad", "string", tc.range_list)
    assert [(r.pos, r.text, r.start, r.end) for r in got] == [(1, "0:30-0:40", 30.0, 40.0), (2, "0:10-0:20", 10.0, 20.0), (3, "bad", None, None)]


@pytest.mark.parametrize("seconds, text", [(60.26, "1:00.26"), (120.08, "2:00.08"), (0.0, "0:00.00"), (45.0, "0:45.00"), (125.0, "2:05.00"), (3661.0, "61:01.00"), (59.999, "0:60.00")])
def test_format_seconds(spark, seconds, text):
    assert one(spark, seconds, "double", tc.format_seconds) == text


def test_captions_clock(spark):
    assert one(spark, 366_123, "bigint", tc.srt_time) == "01:01:01,230"
    assert one(spark, 36_612_345, "bigint", tc.vtt_time) == "101:42:03.450"


@pytest.mark.parametrize("duration, n", [(120.0, 1), (120.01, 2), (280.84, 3), (5.0, 1), (float("nan"), None), (None, None)])
def test_chunk_count(spark, duration, n):
    assert one(spark, duration, "double", tc.chunk_count) == n


def test_chunk_of_a_boundary_is_the_next(spark):
    got = spark.createDataFrame([(0,), (11_999,), (12_000,)], "x bigint").select(tc.chunk_of(F.col("x"))).collect()
    assert [r[0] for r in got] == [1, 1, 2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=40))
def test_parse_of_format_is_the_same(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    got = df.select("x", tc.to_cs(tc.parse_timestamp(tc.format_cs(F.col("x")))).alias("y")).collect()
    assert all(r.x == r.y for r in got)
