from tests.conftest import rows
from pyspark.sql import functions as F

from chronocue.plans import sections

REPLY = "Sure.\nPARTS:\n1. [0:10 - 0:25] first\n[0:30-0:50.5] - second\nno range\nTOTAL_DURATION: 35s\nignored\nNARRATIVE: inline\nline one\n line two \nTITLE: inline\nThe title"


def df(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def test_selection_strict_drops_inline_text(spark):
    r = sections.parse_selection(df(spark, REPLY, None, "", "nothing here"), "id", "t").orderBy("id").collect()
    assert [x.id for x in r] == [0, 2, 3]
    assert [tuple(p) for p in r[0].parts] == [("0:10 - 0:25", "first"), ("0:30-0:50.5", "second")]
    assert (r[0].total_duration, r[0].narrative, r[0].title) == (35, "line one line two", "The title")
    assert (r[1].parts, r[1].total_duration, r[1].narrative, r[1].title) == ([], 0, "", "")


def test_selection_lenient_takes_inline_text(spark):
    r = sections.parse_selection(df(spark, REPLY), "id", "t", strict=False).first()
    assert r.narrative == "inline line one line two" and r.title == "inline The title"


def test_analysis(spark):
    t = "x\nSUMMARY: gone\none\ntwo\nTopics:\n- a\n• b\nc\n-\nHASHTAGS:\n#x y #z,\nREEL SEGMENTS\n[0:01 - 0:02] why\n[0:01] no\nREEL:\n[0:03 - 0:04] lenient"
    strict = sections.parse_analysis(df(spark, t), "id", "t").first()
    assert (strict.summary, strict.topics, strict.hashtags) == ("one two", ["a", "b"], ["#x", "#z,"])
    assert [tuple(x) for x in strict.reels] == [("0:01 - 0:02", "why"), ("0:03 - 0:04", "lenient")]
    assert sections.parse_analysis(df(spark, t), "id", "t", strict=False).first().summary == "gone one two"
    assert sections.parse_analysis(df(spark, None, "", "no header"), "id", "t").count() == 0


def test_regions_reopen_or_stop(spark):
    t = "0:00-0:01 before\nREEL SUGGESTIONS\n1. [0:10 - 0:20] - a\n═══\n0:30-0:40 outside\nTop reel suggestion\n0:50-1:00\n═══"
    every = sections.suggestions(df(spark, t), "id", "t").orderBy("line_no").collect()
    assert [(r.time_range, r.reason) for r in every] == [("0:10 - 0:20", "] - a"), ("0:50-1:00", "Engaging content")]
    assert sections.suggestions(df(spark, t), "id", "t", first_only=True).count() == 1


def test_summary_pieces(spark):
    t = "CHUNK 2 ANALYSIS\nTime: 2:00.00 - 4:00.00\nTopics:\n • a\nCHUNK 1 analysis\nTime: 0:00.00 - 2:00.00\nSummary: said\nthis\n\nTopics:\n  • b\n═══\n• no\nOverall Summary:\n whole \nSuggested Hashtags:\n #One #two\n#three"
    d = df(spark, t)
    assert rows(sections.chunk_summaries(d, "id", "t")) == [(0, 1, "0:00.00 - 2:00.00", "said\nthis")]
    assert [r.topic for r in sections.summary_topics(d, "id", "t").orderBy("line_no").collect()] == ["a", "b"]
    assert sections.first_hashtags(d, "id", "t").first().hashtags == ["#One", "#two"]
    assert sections.overall_summary(d, "id", "t").first().cumulative_summary == "whole"


def test_written_lines_and_names(spark):
    d = df(spark, "Language: he\n[0:01.50 - 0:02.00] hi: there\n[0:03.00 - 0:03.00] ")
    assert rows(sections.segment_lines(d, "id", "t").select("start", "end", "said")) == [(1.5, 2.0, "hi: there"), (3.0, 3.0, "")]
    assert ("Language", "he") in rows(sections.key_values(d, "id", "t").select("name", "value"))
    n = spark.createDataFrame([("2025-11-17_221415_IMG_43_14",), ("short",), (None,)], "n string").select(sections.run_directory(F.col("n")).alias("r")).collect()
    assert tuple(n[0].r) == ("2025-11-17", "221415", "IMG_43_14") and n[1].r is None and n[2].r is None
    m = sections.after_marker(df(spark, "a\nFull transcript so far:\n----\n text \n", "plain ", None), "id", "t").orderBy("id").collect()
    assert [r.transcript for r in m] == ["text", "plain", ""]


def test_headers_within_headers_and_odd_characters(spark):
    t = "SUMMARY: topics: hashtags:\n\x01 a\x02 \n\nTOPICS:\r\n- b\r\n  SUMMARY:\nc d\nhashtags: reel segment\n#x\nReel and SEGMENT\n[0:01 - 0:02] e"
    strict = sections.parse_analysis(df(spark, t), "id", "t").first()
    assert (strict.summary, strict.topics, strict.hashtags, [tuple(r) for r in strict.reels]) == ("a c d", ["b"], ["#x"], [("0:01 - 0:02", "e")])
    lenient = sections.parse_analysis(df(spark, t), "id", "t", strict=False).first()
    assert lenient.summary == "topics: hashtags: a c d"
    lines = rows(sections.sectioned(df(spark, t), "id", "t", sections.ANALYSIS).select("line_no", "section"))
    assert sorted(lines) == [(2, "summary"), (5, "topics"), (7, "summary"), (9, "hashtags"), (11, "reels")]


def test_long_texts_of_headers_and_of_lines(spark):
    d = df(spark, "SUMMARY:\nx\n" * 20_000, "TOPICS:\n" + "- y\n" * 40_000)
    r = sections.parse_analysis(d, "id", "t").orderBy("id").collect()
    assert len(r[0].summary) == 2 * 20_000 - 1 and len(r[1].topics) == 40_000
    assert sections.regions(d, "id", "t", lambda x: x == "SUMMARY:", lambda x: x == "x").count() == 0
