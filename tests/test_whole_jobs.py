"""Queries over whole tables leave no row out."""

import pytest

from chronocue import queries as core

from .conftest import rows


@pytest.fixture
def tables(spark, tmp_path):
    """Writes one small table and gives the folder of tables."""

    def write(name, data, schema):
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


SIMPLIFIED = "row_id bigint, video_id bigint, chunk_num int, seg_index int, start_time double, end_time double, text string, value_score double, confidence double, reasoning string, primary_language string"


def segments(*at, video=1):
    return [(i, video, 1, i, a, b, f"t{i}", 0.5, 0.5, "r", "he") for i, (a, b) in enumerate(at)]


def test_selections_take_every_segment(spark, tables):
    d = tables("results_simplified", segments((0.0, 6.0), (7.0, 13.0), (14.0, 20.0), (21.0, 27.0), (28.0, 34.0), (2e6, 2e6 + 6), (50.0, None), (-3.0, 2.0)), SIMPLIFIED)
    parts = core.QUERIES["part_validation"](spark, d)
    assert [(r[0], r[1]) for r in rows(parts.select("chunk_num", "time_range").where("chunk_num < 9"))] == [(0, "N/A - 0:02.00")] + [(1, x) for x in ("0:00.00 - 0:06.00", "0:07.00 - 0:13.00", "0:14.00 - 0:20.00", "0:21.00 - 0:27.00", "0:28.00 - 0:34.00", "0:50.00 - 0:50.00")]
    assert parts.count() == 8
    totals = core.QUERIES["selection_total"](spark, d).select("chunk_num", "selection_no", "n_parts", "total_s", "valid", "reason")
    assert rows(totals) == [(0, 1, 1, 0, False, "unreadable part"), (1, 1, 4, 24, True, None), (1, 2, 2, 0, False, "unreadable part"), (16667, 1, 1, 6, False, "total too short")]
    graphs = dict(rows(core.QUERIES["filter_graph_render"](spark, d).selectExpr("struct(chunk_num, selection_no)", "graph")))
    assert {tuple(k): g.count("atrim") for k, g in graphs.items()} == {(1, 1): 4, (1, 2): 1, (16667, 1): 1} and "start=2000000.00:end=2000006.00" in graphs[(16667, 1)]
    assert [r[0] for r in rows(core.QUERIES["suggested_reel_lines"](spark, d).select("item").distinct())] == list(range(8))


def test_union_takes_every_row_of_both_shapes(spark, tables):
    tables("results_qwen15b", [(1, 0, "0:01", "0:02", "1s", "a", 0.5, 1.0, 2.0, 0.5, "r", 1, None)], "row_id bigint, seg_index int, start_time string, end_time string, duration string, text string, value_score double, start_seconds double, end_seconds double, confidence double, reasoning string, video_id bigint, loaded_at timestamp")
    d = tables("results_simplified", segments((61.5, 3600.0), (None, 2.0), (-0.5, float("nan"))), SIMPLIFIED)
    u = core.QUERIES["union_legacy_shapes"](spark, d)
    assert rows(u.select("row_id", "start_time", "end_time", "duration")) == [(0, "1:01.50", "60:00.00", None), (1, "0:01", "0:02", "1s"), (1, None, "0:02.00", None), (2, "-0:00.50", None, None)]


def test_ranges_reach_the_last_start(spark, tables):
    d = tables("results_simplified", segments((0.0, 1.0), (34.99, 36.0), (184.0, 190.0), (185.0, 190.0), (7000.0, 7001.0)), SIMPLIFIED)
    assert rows(core.QUERIES["band_join"](spark, d).select("seg_index", "window_no")) == [(0, 0), (1, 0), (2, 4), (2, 5), (3, 5), (4, 199), (4, 200)]


def test_marker_text_may_end_in_any_blank(spark, tables):
    ends = ["", " ", " ", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "　\n"]
    d = tables("documents", [(i, f"head TOPICS:\n---\n- one{e}") for i, e in enumerate(ends)], "doc_id bigint, text string")
    assert rows(core.QUERIES["text_after_marker"](spark, d)) == [(i, "- one") for i in range(len(ends))]


def test_the_final_summary_has_the_whole_transcript(spark, tables):
    tables("videos", [(1, "a.mp4", 300.0)], "video_id bigint, path string, duration double")
    d = tables("results_simplified", segments((0.0, 6.0), (7.0, 13.0), (130.0, 136.0)), SIMPLIFIED)
    lines = [r.line for r in core.QUERIES["final_summary_lines"](spark, d).orderBy("part", "line_no").collect()]
    at = lines.index("Full transcript:")
    assert lines[at : at + 8] == ["Full transcript:", "-" * 40, "t0t1", "", "t2", "", "", ""] and lines[at + 8] == "Segments with timestamps:"
    assert lines[at + 10] == "[0:00.00 - 0:06.00] t0" and lines[-1].startswith("Chunk 2 processing time")


def test_top_segments_need_no_bounds(spark, tables):
    data = [(1, 1, 0, None, 5.0, "a", 0.9), (2, 1, 1, -1.0, float("nan"), "b", 0.8), (3, 1, 2, 61.0, 65.0, "c", 0.7), (4, 1, 3, 70.0, 75.0, "d", 0.6)]
    d = tables("results_qwen15b", data, "row_id bigint, video_id bigint, seg_index int, start_seconds double, end_seconds double, text string, value_score double")
    lines = [r.line for r in core.QUERIES["analysis_report_lines"](spark, d).where("part = 3").orderBy("line_no").collect()]
    assert lines[::2] == ["1. Score: 0.90 | N/A-0:05", "2. Score: 0.80 | N/A-N/A", "3. Score: 0.70 | 1:01-1:05"]


def test_a_csv_round_trip_keeps_every_value(spark, tables):
    odd = ["", None, " ", "\ta ", "\n", "\r", "a\r\nb", "\\", 'a\\"', '"', '""', '"a', 'a"b,c', '","', "#x", "NaN", "null", "\\N", "\0", "\u2028", "\ufeffx", "ש,😀", "x" * 70_000]
    numbers = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 5e-324, 1.7976931348623157e308, -7e-12, 0.1 + 0.2, 1e23]
    at = lambda i: numbers[i % len(numbers)]
    data = [(i, i, i, t, odd[i - 1], at(i), at(i + 1), odd[i - 2], odd[i - 3], at(i + 2), at(i + 3), odd[i - 4], None) for i, t in enumerate(odd)] + [(None,) * 13]
    d = tables("results_qwen15b", data, "row_id bigint, video_id bigint, seg_index int, start_time string, end_time string, start_seconds double, end_seconds double, duration string, text string, confidence double, value_score double, reasoning string, loaded_at timestamp")
    assert list(map(repr, rows(core.QUERIES["csv_round_trip"](spark, d)))) == sorted(repr(r[2:12]) for r in data)
