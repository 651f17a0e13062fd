import datetime
import os

from pyspark.sql import functions as F
from tests.conftest import rows

from chronocue.models import adapters
from chronocue.operators import chunks
from chronocue.sinks import render
from chronocue.sources import media, reports

SEG = "video_id bigint, seg_index int, start_cs bigint, end_cs bigint, text string"


def text_of(frame, *order):
    return "\n".join(r.line for r in frame.orderBy(*order).collect())


def test_chunk_file(spark):
    c = chunks.assigned(spark.createDataFrame([(1, 7, 12_050, 12_300, " hi "), (1, 8, 12_400, 12_400, None)], SEG))
    assert text_of(render.chunk_files(c), "part", "line_no") == "CHUNK 2 TRANSCRIPT\n" + "=" * 60 + "\n\nTime range: 2:00.00 - 4:00.00\n\nSegments with timestamps:\n" + "-" * 40 + "\n[2:00.50 - 2:03.00] hi\n[2:04.00 - 2:04.00] "


def test_metadata_and_summaries(spark):
    m = spark.createDataFrame([(1, 1, 12_000, 1983, None, 30)], "video_id bigint, chunk_num bigint, duration_cs bigint, processing_tenths bigint, language string, n_segments bigint")
    t = text_of(render.chunk_metadata(m), "line_no")
    assert "Duration: 120.0 seconds (2.0 minutes)" in t and "Processing time: 198.3 seconds (3.3 minutes)" in t and "Language: N/A" in t
    v = spark.createDataFrame([(1, "a.mp4", None, "he", None)], "video_id bigint, path string, model string, language string, duration_cs bigint")
    texts = spark.createDataFrame([(1, 1, "all"), (1, 2, None)], "video_id bigint, chunk_num bigint, text string")
    s = spark.createDataFrame([(1, 0, 0, 100, "x")], SEG)
    timings = spark.createDataFrame([(1, 1, 1766), (1, 2, 1921)], "video_id bigint, chunk_num bigint, tenths bigint")
    t = text_of(render.final_summary(v, texts, s, timings), "part", "line_no")
    assert "Video Length: N/A" in t and "Total processing time: 368.7 seconds" in t and t.endswith("Chunk 2 processing time: 192.1 seconds")
    assert "Full transcript:\n" + "-" * 40 + "\nall\n\n\n\n\n\nSegments with timestamps:" in t
    reels = "array<struct<time_range:string,reason:string>>"
    p = spark.createDataFrame([(1, 1, "old", ["a"], None, 3), (1, 2, "new", None, [("0:01-0:02", "x"), ("0:03-0:04", "y")], 3)], f"video_id bigint, chunk_num bigint, summary string, topics array<string>, reels {reels}, total_chunks bigint")
    whole = spark.createDataFrame([(1, "both", ["a", "b"], [("0:01-0:02", "x")], ["#a", "#b"])], f"video_id bigint, summary string, topics array<string>, reels {reels}, hashtags array<string>")
    at = F.lit(datetime.datetime(2025, 1, 2, 3, 4, 5))
    t = text_of(render.progressive_summary(p, whole, at, "m"), "part", F.desc_nulls_first("chunk_num"), "line_no").splitlines()
    assert t[:4] == ["AI CONTENT ANALYSIS (Real-Time)", "Updated after: Chunk 2 of 3", "Last update: 2025-01-02 03:04:05", "Generated with: m"]
    new = t.index("CHUNK 2 ANALYSIS (Individual)")
    assert t[new + 1 : new + 9] == ["Time: 2:00.00 - 4:00.00", "─" * 70, "Summary: new", "", "Reel Suggestion:", "  0:01-0:02 - x", "", "═" * 70]
    all_ = t.index("CUMULATIVE ANALYSIS (Chunks 1-2)")
    assert new < all_ and t[all_ + 2 : all_ + 13] == ["Overall Summary:", "both", "", "All Topics:", "  • a", "  • b", "", "Best Reel Suggestions (Top 1):", "  1. 0:01-0:02 - x", "", "Suggested Hashtags:"]
    old = t.index("PREVIOUS CHUNKS")
    assert all_ < old and t[old + 2 : old + 9] == ["CHUNK 1 ANALYSIS (Individual)", "Time: 0:00.00 - 2:00.00", "─" * 70, "Summary: old", "", "Topics:", "  • a"]
    assert "PREVIOUS CHUNKS" not in text_of(render.progressive_summary(p.where("chunk_num = 2"), whole, at), "part", "line_no")
    u = render.cumulative_report(texts, at)
    assert text_of(u, "part", "line_no").splitlines()[2:] == ["Last updated: Chunk 2", "Updated at: 2025-01-02 03:04:05", "", "Full transcript so far:", "-" * 40, "all", "", "", ""][:-1]


def test_plans_and_names(spark):
    r = spark.createDataFrame([(1, [(3.5, 5.0), (1.0, 2.25)]), (2, [])], "id int, r array<struct<start:double,end:double>>")
    g = r.orderBy("id").select(render.filter_graph(F.col("r")).alias("g")).collect()
    assert g[0].g.endswith("[v0][a0][v1][a1]concat=n=2:v=1:a=1[outv][outa]") and "trim=start=3.50:end=5.00" in g[0].g and g[1].g is None
    w = spark.createDataFrame([("reel",), ("new",), (None,)], "base string")
    e = spark.createDataFrame([("reel",), ("reel_2",), ("reel_4",), ("other",)], "name string")
    assert rows(render.unique_names(w, e)) == [("new", "new"), ("reel", "reel_3")]
    w = spark.createDataFrame([("chan_1",), ("a",), ("a_2",), ("b_02",), ("a",)], "base string")
    e = spark.createDataFrame([("chan_1",), ("a",), ("a_3",), ("b_02",), ("b_02_2",), (None,), ("a",)], "name string")
    assert rows(render.unique_names(w, e)) == [("a", "a_4"), ("a_2", "a_2"), ("b_02", "b_02_3"), ("chan_1", "chan_1_2")]
    assert rows(render.unique_names(w, e.limit(0))) == [(x, x) for x in ("a", "a_2", "b_02", "chan_1")] and render.unique_names(w.limit(0), e).count() == 0
    d = spark.createDataFrame([(datetime.datetime(2025, 11, 17, 22, 14, 15, 123456), "v/a b.c.mp4", True)], "t timestamp, p string, x boolean")
    assert d.select(render.run_directory_name(F.col("t"), F.col("p"), F.col("x")).alias("n")).first().n == "2025-11-17_221415_123456_a_b-c"
    s = spark.createDataFrame([(1, "0:10 - 0:20", "why", "a.mp4")], "item int, time_range string, reason string, path string").withColumn("k", F.lit(1))
    assert '--ranges "0:10-0:20"' in text_of(render.suggested_reels(s, "k"), "line_no")
    c = spark.createDataFrame([(1, 3, 100, 200, "b"), (1, 1, 0, 50, "a"), (1, 4, 300, 300, "zero"), (1, 5, 400, 500, "  ")], SEG)
    assert [r.cue for r in render.captions(c).orderBy("n").collect()] == ["1\n00:00:00,000 --> 00:00:00,500\na\n", "2\n00:00:01,000 --> 00:00:02,000\nb\n"]


def test_files_are_written_in_order(spark, tmp_path):
    c = chunks.assigned(spark.createDataFrame([(v, i, i * 100, i * 100 + 50, f"t{i}") for v in (1, 2) for i in range(50)], SEG)).repartition(8)
    render.write_files(render.chunk_files(c), str(tmp_path / "out"), ["video_id", "chunk_num"], ["part", "line_no"])
    folder = tmp_path / "out/video_id=2/chunk_num=1"
    (f,) = [x for x in os.listdir(folder) if x.endswith(".txt")]
    body = (folder / f).read_text().splitlines()
    assert body[0] == "CHUNK 1 TRANSCRIPT" and [x.split()[-1] for x in body[7:]] == [f"t{i}" for i in range(50)]


def test_media_scan(spark, tmp_path):
    for p in ("a.mp4", "b.MOV", "c.Mp4", "sub/d.mkv", ".hidden/e.mp4", "venv/x/f.mp4", "sub/deep/g.avi", "h.txt", "bad.mp4"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x" * 1048576 if p == "a.mp4" else b"x")
    base = f"file://{tmp_path}"

    def probe(path):
        if "bad" in path:
            raise OSError
        return 12.5

    got = media.scan_folder(spark, base, probe).collect()
    assert [(r.name, r.duration) for r in got] == [("a.mp4", 12.5), ("b.MOV", 12.5), ("bad.mp4", None)] and got[0].size_mb == 1.0
    assert [(r.folder.rsplit("/", 1)[-1], r.n_media) for r in media.folders_with_media(spark, base).collect()] == [(tmp_path.name, 3), ("sub", 1), ("deep", 1)]
    assert media.scan_folder(spark, base).first().duration is None
    assert media.latest_run(media.listing(spark, base)).count() == 1
    runs = spark.createDataFrame([("r/2025-01-01_000000_b",), ("r/2025-01-01_000000_zz",)], "folder string")
    assert [r.path.rsplit("/", 1)[-1] for r in media.media_of_runs(runs, media.listing(spark, base)).collect()] == ["b.MOV"]
    d = spark.createDataFrame([("-90",), ("450",), ("x",), (None,)], "x string")
    assert [r[0] for r in d.select(media.rotation(F.col("x"))).collect()] == [90, 90, 0, 0]


def test_legacy_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('index,start_time,end_time,start_seconds,end_seconds,duration,text,confidence,value_score,reasoning\n0,0:00,0:04,0.32,4.84,4.5s,"a, b",0.461,0.50,"line one\nsays ""two"""\n')
    (tmp_path / "b.csv").write_text("index,start_time,end_time,duration,text,confidence,value_score,reasoning\n1,0.5,2.0,1.5s,t,bad,0.2,r\n")
    u = reports.unified(reports.segment_csv(spark, str(tmp_path / "a.csv")), reports.segment_csv(spark, str(tmp_path / "b.csv"))).orderBy("index").collect()
    assert u[0].reasoning == 'line one\nsays "two"' and u[0].start_seconds == 0.32 and u[1].start_seconds is None and u[1].confidence is None
    (tmp_path / "r.json").write_text('{"metadata": {"audio_path": "p", "duration": 3.5}, "segments": {"evaluated": [{"start_time": 0.1, "value_score": 0.5}, {"start_time": 1.0}]}, "summaries": {"evaluation": {"score_distribution": {"0.4-0.6": 1}}}}')
    r = reports.run_reports(spark, str(tmp_path / "r.json"))
    assert [x.seg_no for x in reports.evaluated_segments(r.select(F.lit(1).alias("k"), "segments"), "k").collect()] == [0, 1]
    assert rows(reports.score_distribution(r.select(F.lit(1).alias("k"), "summaries"), "k")) == [(1, "0.4-0.6", 1)]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert reports.whole_texts(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo"


def test_adapters(spark):
    m = spark.createDataFrame([(1, "a", 250.0), (2, "b", 120.0), (3, "c", None), (4, "d", float("nan")), (5, "e", 0.0)], "video_id bigint, path string, duration double")
    plan = adapters.plan_chunks(m)
    assert rows(plan.select("video_id", "chunk_num", "start", "length")) == [(1, 1, 0.0, 120.0), (1, 2, 120.0, 120.0), (1, 3, 240.0, 10.0), (2, 1, 0.0, 120.0)]

    def fails():
        raise MemoryError

    t = adapters.transcribed(plan, [("big", fails), ("stub", lambda: adapters.stub_transcriber(5.0))])
    assert t.count() == 24 + 24 + 2 + 24 and t.first().model == "stub"

    def ask():
        def call(p):
            if "bad" in p:
                raise OSError
            return p.upper()

        return call

    p = spark.createDataFrame([(1, "x"), (2, "bad"), (3, None)], "id bigint, p string")
    assert rows(adapters.replies(p, "id", "p", ask)) == [(1, "X"), (2, None), (3, None)]
    c = p.select("id", F.array(F.lit("true")).alias("c"))
    assert rows(adapters.run_commands(c, "id", "c", lambda a: len(a))) == [(1, 1), (2, 1), (3, 1)]
    s = spark.createDataFrame([(["model-x:8b", "other"],)], "m array<string>")
    assert s.select(adapters.model_served(F.col("m"), "model-x")).first()[0]
    q = p.select(adapters.analysis_prompt(F.col("p"), "English").alias("a"), adapters.selection_prompt(F.col("p")).alias("b")).first()
    assert "REEL SEGMENTS:" in q.a and "45 to 70 seconds" in q.b
    assert p.select(adapters.encode_command(F.lit("i"), F.lit("g"), F.lit("o")).alias("c")).first().c[-1] == "o"


def test_reports_of_scores_and_reels(spark):
    h = spark.createDataFrame([(1, b, n) for b, n in zip(("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0"), (0, 1, 5, 0, 0))], "k int, bin string, n bigint")
    t = spark.createDataFrame([(1, 1, 558, 34, 4534, "x" * 101)], "k int, rank_no int, score_milli bigint, start_cs bigint, end_cs bigint, text string")
    lines = text_of(render.analysis_report(h, t, ["k"]), "part", "line_no").splitlines()
    assert lines[3:8] == ["  0.0-0.2: 0 segments", "  0.2-0.4: 1 segments", "  0.4-0.6: 5 segments", "  0.6-0.8: 0 segments", "  0.8-1.0: 0 segments"]
    assert lines[-2:] == ["1. Score: 0.56 | 0:00-0:45", "   Text: " + "x" * 100 + "..."]
    assert "TOP SEGMENTS" not in text_of(render.analysis_report(h, t.limit(0), ["k"]), "part", "line_no")
    s = spark.createDataFrame([(1, 6, 3, 500, 490, 400, 560)], "k int, total bigint, high bigint, success_permille bigint, avg_milli bigint, min_milli bigint, max_milli bigint")
    assert text_of(render.run_summary(s, ["k"]), "line_no").splitlines()[3:] == ["Success Rate: 50.0%", "Average Score: 0.49", "Score Range: 0.40 - 0.56"]
    r = spark.createDataFrame([(1, "T", None, "a.mp4", "r", 55)], "reel_id int, title string, narrative string, path string, run string, total_s int")
    p = spark.createDataFrame([(1, 1, "0:10 - 0:20", "why")], "reel_id int, part_no int, time_range string, reason string")
    assert text_of(render.reel_metadata(r, p), "part", "line_no").endswith("Title: T\nNarrative: \n\nSEGMENTS:\n1. 0:10 - 0:20 - why")
    d = spark.createDataFrame([(1, 2, "b", "two"), (1, 1, "a", "one")], "k int, chunk int, time_range string, summary string")
    assert render.chunk_digest(d, "k").first().digest == "Chunk 1 [a]\none\n\nChunk 2 [b]\ntwo\n"


def test_named_files(spark, tmp_path):
    c = chunks.assigned(spark.createDataFrame([(v, i, i * 900, i * 900 + 50, f"t{i}") for v in (1, 2) for i in range(50)], SEG)).repartition(8)
    lines = render.chunk_files(c).withColumn("name", F.concat(F.col("video_id").cast("string"), F.lit("/"), render.chunk_file_name(F.col("chunk_num"))))
    for _ in range(2):  # again: the same files
        got = dict(rows(render.write_named(lines, str(tmp_path / "out"), "name", ["part", "line_no"])))
    assert sorted(os.listdir(tmp_path / "out/2")) == ["chunk_01.txt", "chunk_02.txt", "chunk_03.txt", "chunk_04.txt"] and len(got) == 8
    text = (tmp_path / "out/2/chunk_02.txt").read_text().splitlines()
    assert text[0] == "CHUNK 2 TRANSCRIPT" and text[7].endswith("t14") and len(text) == got["2/chunk_02.txt"]
    assert render.write_named(lines.limit(0), str(tmp_path / "none"), "name", ["part"]).count() == 0
    n = spark.createDataFrame([(1,), (10,), (100,), (None,)], "n int").select(render.chunk_file_name(F.col("n"), "metadata").alias("x"))
    assert [r.x for r in n.collect()] == ["chunk_01_metadata.txt", "chunk_10_metadata.txt", "chunk_100_metadata.txt", None]


def test_probes_and_lists(spark):
    out = ["-90", "450.7\n", " 0 ", "", "N/A", None, "1e3", "90 90", "9999999999"]
    d = spark.createDataFrame([(x,) for x in out], "o string")
    assert [r.r for r in d.select(media.probed_rotation(F.col("o")).alias("r")).collect()] == [90, 90, 0, 0, 0, 0, 0, 0, 0]
    lists = ['{"models": [{"name": "m:8b"}, {"size": 1}]}', '{"models": []}', "[]", "no", None]
    d = spark.createDataFrame([(x,) for x in lists], "o string").select(adapters.served_names(F.col("o")).alias("n"))
    assert [(r.n, r.s) for r in d.select("n", adapters.model_served(F.col("n"), "m:1b").alias("s")).collect()] == [(["m:8b"], True)] + [([], False)] * 4
    assert adapters.model_list("http://127.0.0.1:9/none", 0.2) is None
    p = spark.createDataFrame([("a/IMG_1.MOV",), ("IMG_.MOV",), ("x/IMG.MOV",), (None,)], "p string")
    assert [r.x for r in p.select(media.named(F.col("p"), "IMG_", ".MOV").alias("x")).collect()] == [True, True, False, None]


def test_recogniser_chunks(spark):
    d = spark.createDataFrame([(1, 120.0, [([0.5, 2.0], "a"), ([3.0, None], "b"), (None, "c")])], "v int, s double, c array<struct<timestamp:array<double>,text:string>>")
    assert rows(adapters.normalised_chunks(d, ["v"], "c", "s")) == [(1, 0, 120.5, 122.0, "a"), (1, 1, 120.0, 150.0, "b"), (1, 2, 120.0, 150.0, "c")]
