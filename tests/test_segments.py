"""Chunks, windows, selections, scores, speakers, topics."""

import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from chronocue.operators import chunks, scoring, selection, speakers, sweep, topics, windows

RAW = "row_id bigint, video_id bigint, seg_index int, start_time double, end_time double, text string, start_cs string"
SEG = "video_id bigint, seg_index int, start_cs bigint, end_cs bigint, text string"


def test_segments_once_each(spark):
    raw = [(2, 1, 0, 1.0, 2.0, "b", "clash"), (1, 1, 0, 1.0, 2.0, "a[PAD]", "x"), (3, None, 0, 1.0, 2.0, "c", "x"), (4, 1, None, 1.0, 2.0, "d", "x"), (5, 1, 2, None, 2.0, "e", "x"), (6, 1, 3, float("nan"), 2.0, "f", "x"), (7, 1, 4, 119.999, None, None, "x")]
    assert rows(chunks.segments(spark.createDataFrame(raw, RAW))) == [(1, 0, 100, 200, "a"), (1, 4, 12000, None, None)]


def segs(spark, n=400, seed=1):
    r = random.Random(seed)
    out, at = [], {1: 0, 2: 50}
    for i in range(n):
        v = r.choice([1, 1, 1, 2])
        at[v] += r.randint(0, 900)
        out.append((v, i, at[v], r.choice([None, at[v] - 5, at[v] + r.randint(0, 1500)]), r.choice([None, "", "a b c?", "one two three four five six seven eight nine ten", "x"])))
    return out


def test_every_segment_is_in_one_chunk_and_comes_back(spark):
    data = segs(spark)
    c = chunks.assigned(spark.createDataFrame(data, SEG))
    assert c.count() == len(data)
    assert all(0 <= r.rel_start_cs < 12000 for r in c.collect())
    assert rows(chunks.rebased(c).select("video_id", "seg_index", "start_cs", "end_cs")) == sorted([d[:4] for d in data], key=repr)
    assert chunks.rollup(c).agg(F.sum("n_segments")).first()[0] == len(data)


def test_texts_in_order(spark):
    c = chunks.assigned(spark.createDataFrame([(1, 1, 500, 600, "b"), (1, 0, 100, 200, "a"), (1, 2, 12000, 12100, None), (1, 3, 12001, 12100, "c")], SEG))
    t = chunks.chunk_texts(c)
    assert rows(t) == [(1, 1, "ab"), (1, 2, "c")]
    assert chunks.whole_text(t).first().text == "ab\n\nc\n\n"
    assert rows(chunks.cumulative_text(t)) == [(1, 1, "ab\n\n"), (1, 2, "ab\n\nc\n\n")]
    assert rows(chunks.cumulative_length(c)) == [(1, 1, 4), (1, 2, 7)]


def test_gaps_and_latest(spark):
    p = spark.createDataFrame([(1, 1), (1, 4), (1, 4), (2, None), (None, 3), (3, 0)], "video_id bigint, chunk_num int")
    assert rows(chunks.with_gaps(p)) == [(1, 1, True), (1, 2, False), (1, 3, False), (1, 4, True)]
    d = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, None, "c"), (None, 9, "d")], "k int, t int, v string")
    assert rows(chunks.latest(d, "k", "t", "v")) == [(1, 5, "b"), (2, None, "c")]


def test_range_join_is_as_nested_loops(spark):
    r = random.Random(2)
    pts = [(r.choice([1, 2]), r.randint(-50, 500)) for _ in range(200)]
    rng = [(r.choice([1, 2]), a, a + r.randint(-3, 120), i) for i, a in enumerate(r.randint(-60, 480) for _ in range(60))]
    got = rows(chunks.range_joined(spark.createDataFrame(pts, "k int, x int"), spark.createDataFrame(rng, "k int, a int, b int, i int"), ["k"], "x", "a", "b", 37).select("k", "x", "i"))
    assert got == sorted([(k, x, i) for k, x in pts for k2, a, b, i in rng if k == k2 and a <= x < b], key=repr)


@pytest.mark.parametrize("target, overlap, t0, t1, n, last", [(45, 10, 34, 21810, 6, (17534, 21810)), (90, 20, 0, 58394, 9, (56000, 58394))])
def test_overlapping_windows(spark, target, overlap, t0, t1, n, last):
    w = windows.overlapping(spark.createDataFrame([(1, 0, t0, t1, "x")], SEG), target * 100, overlap * 100).orderBy("window_no").collect()
    assert len(w) == n and (w[-1].ws, w[-1].we) == last and w[0].ws == t0


def test_window_members_are_as_nested_loops(spark):
    data = segs(spark, 150, 4)
    s = spark.createDataFrame(data, SEG)
    w = windows.overlapping(s)
    wins = w.collect()
    for how in ("overlap", "start"):
        exp = []
        for v, i, a, b, _ in data:
            e = max(a, b if b is not None else a)
            for x in wins:
                if x.video_id == v and ((a < x.we and e > x.ws) if how == "overlap" else (x.ws <= a < x.we)):
                    exp.append((v, i, x.window_no))
        assert rows(windows.members(s, w, 800, how).select("video_id", "seg_index", "window_no")) == sorted(exp, key=repr)
    with pytest.raises(ValueError):
        windows.overlapping(s, 10, 10)


@pytest.mark.parametrize(
    "parts, valid, reason, total",
    [
        (["0:00-0:44"], False, "total too short", 44), (["0:00-0:45"], True, None, 45), (["0:00-1:20"], True, None, 80), (["0:00-1:21"], False, "total too long", 81),
        (["0:00-0:50", "1:00-1:04.9"], False, "part too short", 54), (["0:00-0:50", "1:00-1:05"], True, None, 55), (["0:00-0:15", "bad"], False, "unreadable part", 0), ([], False, "no parts", 0), (["0:00-0:55.9"], True, None, 55),
    ],
)
def test_validation_bounds(spark, parts, valid, reason, total):
    d = spark.createDataFrame([(1, [{"time_range": p} for p in parts])], "id int, parts array<struct<time_range:string>>")
    r = selection.validated(d, ["id"]).first()
    assert (r.valid, r.reason, r.total_s) == (valid, reason, total)


def test_attempts_bounds_and_suggestions(spark):
    a = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (2, 4, True)], "id int, attempt int, valid boolean")
    assert rows(selection.first_valid(a, ["id"])) == [(1, 2, False), (2, 1, True)]
    r = spark.createDataFrame([(1, -1.0, 2.0), (1, 0.0, 5.0), (1, 0.0, 5.1), (9, 0.0, 1.0)], "id int, start double, end double")
    m = spark.createDataFrame([(1, 5.0), (None, 1.0)], "id int, duration double")
    assert [x.out for x in selection.out_of_bounds(r, m, "id").orderBy("id", "start", "end").collect()] == [True, False, True, None]
    assert selection.first_suggestion(a, "id", "attempt").count() == 2


def test_scores(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven eight nine ten?", 0.5), (2, "a b", 0.9), (3, None, None), (4, "a b c d e f", float("nan"))], "id int, text string, confidence double")
    assert rows(scoring.rule_score(d).select("id", "score_tenths", "reasons")) == [(1, 7, "good length, engaging questions, low confidence"), (2, 3, "too short"), (3, 3, "too short"), (4, 5, "")]
    s = spark.createDataFrame([("a", x) for x in (0.25, 0.41, 0.5, 0.5, 0.59, 0.55, None, float("nan"))] + [("b", None)], "g string, value_score double")
    assert [r.n for r in scoring.histogram(s, ["g"]).orderBy("bin").collect()] == [0, 1, 5, 0, 0]
    assert scoring.high_value(s).count() == 4
    r = scoring.summary(s, ["g"]).orderBy("g").collect()
    assert (r[0].total, r[0].high, r[0].min_milli, r[0].max_milli, r[0].avg_milli) == (8, 4, 250, 590, 466) and r[1].avg_milli is None
    assert [x.text for x in scoring.top_report(d.withColumn("value_score", F.lit(0.5)), ["id"], 1).collect()] == ["one two three four five six seven eight nine ten?"]


def test_sweeps_are_as_windows(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame(segs(spark, 300, 7), SEG)
    w = Window.partitionBy("video_id").orderBy("start_cs", "seg_index")
    got = sweep.with_previous(df, ["video_id"], ["start_cs", "seg_index"], ["end_cs", "text"], 3000).select("video_id", "seg_index", "prev_end_cs", "prev_text")
    assert rows(got) == rows(df.select("video_id", "seg_index", F.lag("end_cs").over(w), F.lag("text").over(w)))
    got = sweep.with_running_sum(df, ["video_id"], ["start_cs", "seg_index"], F.col("start_cs"), 3000, "s").select("video_id", "seg_index", "s")
    assert rows(got) == rows(df.select("video_id", "seg_index", F.sum("start_cs").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def test_timeline_is_as_islands(spark):
    r = random.Random(5)
    data = [(*d, r.choice(["t", "t", "s", None])) for d in segs(spark, 300, 8)]
    got = rows(speakers.timeline(spark.createDataFrame(data, SEG + ", label string"), slab_cs=5000).select("video_id", "label", "from_cs", "n_segments"))
    exp = []
    for v in (1, 2):
        last = object()
        for d in sorted((d for d in data if d[0] == v), key=lambda d: (d[2], d[1])):
            if d[5] != last:
                exp.append([v, d[5], d[2], 0])
            exp[-1][3] += 1
            last = d[5]
    assert got == sorted(map(tuple, exp), key=repr)


def test_flow_reads_original_labels(spark):
    d = [(1, 0, 0, 10, "why?", "teacher"), (1, 1, 20, 30, "because", "teacher"), (1, 2, 40, 50, "and so", "teacher"), (1, 3, 60, 70, None, "student")]
    assert [r.refined for r in speakers.refined(spark.createDataFrame(d, SEG + ", label string")).orderBy("seg_index").collect()] == ["teacher", "student", "teacher", "student"]


def test_shares_pacing_features_roles(spark):
    d = spark.createDataFrame([(1, 0, 0, 600, "a b c", "t"), (1, 1, 700, 600, None, "s"), (2, 0, 0, None, "x", "t")], SEG + ", label string")
    assert rows(speakers.shares(d).select("video_id", "label", "time_permille", "segment_permille")) == [(1, "s", 0, 500), (1, "t", 1000, 500), (2, "t", 0, 1000)]
    assert rows(speakers.pacing(d)) == [(1, 3, 600, 30000), (2, 1, 0, None)]
    assert rows(speakers.pauses(d)) == [(1, 1, 100)]
    assert rows(speakers.speakers_counted(d)) == [(1, 2), (2, 1)]
    f = speakers.features(d.select("text"), ["a", "a"], ["x"]).where("text is not null").orderBy("text").collect()
    assert [r.marker_score for r in f] == [2, -1]
    long, short = [("word " * 20,)] * 8, [("hi",)] * 8
    r = speakers.cluster_roles(speakers.features(spark.createDataFrame(long + short, "text string"), [], []), ["n_words", "n_letters"]).groupBy("role", "text").count()
    assert rows(r) == [("student", "hi", 8), ("teacher", "word " * 20, 8)]
    one = speakers.cluster_roles(speakers.features(spark.createDataFrame([("hi",)] * 3, "text string"), [], []), ["n_words"])
    assert {x.role for x in one.collect()} == {"teacher"}


def test_topics(spark):
    d = spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["a", "b", "c"]), (3, None), (4, [])], "id int, t array<string>")
    assert rows(topics.cooccurring(d, "id", "t")) == [("a", "b", 2)]
    e = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [0.0, 0.0])], "g int, i int, v array<float>")
    assert [(r.i, r.chapter) for r in topics.chapters(e, ["g"], ["i"], "v", 0.5, 2).orderBy("i").collect()] == [(0, 1), (1, 1), (2, 2), (3, 2)]
    v = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "b"), (2, "a"), (3, None)], "k int, a string")
    assert rows(topics.voted(v, ["k"], "a")) == [(1, "y", 2), (2, "a", 1)]
    assert rows(topics.common(v, "k", "a", 1)) == [("a", 1), ("b", 1), ("x", 1), ("y", 1)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], SEG)
    c = chunks.assigned(e)
    labelled = e.withColumn("label", F.lit("t"))
    for df in (chunks.rollup(c), chunks.chunk_texts(c), chunks.with_gaps(c), windows.overlapping(e), windows.members(e, windows.overlapping(e)), speakers.timeline(labelled), speakers.pauses(e), speakers.refined(labelled), speakers.shares(labelled)):
        assert df.count() == 0


def test_clusters_of_ranges(spark):
    r = random.Random(9)
    data = [(r.choice([1, 1, 2]), a, r.choice([None, a + r.randint(0, 4000), a - 5])) for a in (r.randint(0, 100_000) for _ in range(120))]
    got = rows(selection.clustered(spark.createDataFrame(data, "k int, start_cs bigint, end_cs bigint"), ["k"], within_cs=500, slab=3000).groupBy("k", "cluster").count())
    exp = {}
    for k in (1, 2):
        reach, n = None, 0
        for a, e in sorted((a, max(a, e if e is not None else a)) for q, a, e in data if q == k):
            n += reach is None or a - reach > 500
            exp[k, n] = exp.get((k, n), 0) + 1
            reach = e if reach is None else max(reach, e)
    assert got == sorted([(k, c, n) for (k, c), n in exp.items()], key=repr)


def test_null_keys_and_ids_are_kept(spark):
    raw = [(None, 1, 0, 1.0, 2.0, "a", "x"), (5, 1, 0, 3.0, 4.0, "b", "x"), (None, 1, 1, 5.0, 6.0, "c", "x")]
    assert rows(chunks.segments(spark.createDataFrame(raw, RAW))) == [(1, 0, 300, 400, "b"), (1, 1, 500, 600, "c")]
    e = spark.createDataFrame([(None, 0, 1), (None, 1, 2), (1, None, 3), (1, 5, 4)], "g int, i int, v int")
    assert rows(sweep.with_previous(e, ["g"], ["i"], ["v"], 10).select("g", "i", "v", "prev_v")) == [(1, 5, 4, 3), (1, None, 3, None), (None, 0, 1, None), (None, 1, 2, 1)]


def test_clusters_of_ranges_without_a_key(spark):
    df = spark.createDataFrame([(None, 0, 10), (1, 0, 10), (None, 5000, 5001), (None, 100_000, 100_001)], "k int, start_cs bigint, end_cs bigint")
    assert rows(selection.clustered(df, ["k"], within_cs=100)) == sorted([(1, 0, 10, 1), (None, 0, 10, 1), (None, 5000, 5001, 2), (None, 100_000, 100_001, 3)], key=repr)


def test_spread_is_as_a_sequence(spark):
    from chronocue.operators.sweep import spread

    df = spark.createDataFrame([(1, -3, 25), (2, 5, 5), (3, 6, 5), (4, None, 5)], "i int, a bigint, b bigint")
    for at_once in (1, 7, 1000):
        assert rows(spread(df, "n", F.col("a"), F.col("b"), at_once).select("i", "n")) == sorted([(1, n) for n in range(-3, 26)] + [(2, 5)], key=repr)
    far = spark.createDataFrame([(1, 0, 30_000_000)], "i int, a bigint, b bigint")
    assert spread(far, "n", F.col("a"), F.col("b")).agg(F.sum("n")).first()[0] == 30_000_000 * 30_000_001 // 2


def test_cut_plans(spark):
    nan = float("nan")
    p = [(1, 1, 1, 0.0, 5.5), (1, 1, 2, 7.0, 9.0), (1, 2, 1, 9.0, 11.0), (1, 2, 2, None, None), (2, 3, 1, 0.0, 1.0), (3, 4, 1, 0.0, 1.0), (None, 5, 1, 0.0, 1.0), (1, 6, 1, -1.0, 2.0)]
    parts = spark.createDataFrame(p, "v int, r int, part_no int, start double, end double")
    m = spark.createDataFrame([(1, 10.0), (2, None), (3, nan), (None, 99.0)], "v int, duration double")
    got = {(r.v, r.r, r.part_no): (r.at_s, r.total_s, r.ok, r.all_ok) for r in selection.cut_plan(parts, m, ["v", "r"], "v").collect()}
    assert got == {
        (1, 1, 1): (0.0, 7.5, True, True), (1, 1, 2): (5.5, 7.5, True, True), (1, 2, 1): (0.0, 2.0, False, False), (1, 2, 2): (2.0, 2.0, False, False), (2, 3, 1): (0.0, 1.0, False, False),
        (3, 4, 1): (0.0, 1.0, False, False), (None, 5, 1): (0.0, 1.0, False, False), (1, 6, 1): (0.0, 3.0, False, False),
    }


def test_selections_without_parts(spark):
    s = spark.createDataFrame([(1, []), (2, None), (3, [("0:00-0:50",)]), (None, [("0:00-0:50",)]), (4, [("x",), ("0:00-0:50",)])], "k int, parts array<struct<time_range:string>>")
    assert rows(selection.validated(s, ["k"]).select("k", "n_parts", "total_s", "valid", "in_range", "reason")) == sorted(
        [(1, 0, 0, False, False, "no parts"), (2, 0, 0, False, False, "no parts"), (3, 1, 50, True, True, None), (None, 1, 50, True, True, None), (4, 2, 0, False, False, "unreadable part")], key=repr)


def test_labels_at_their_place(spark):
    r = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "v int, i int")
    l = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 9, "c"), (1, 2, None)], "v int, i int, label string")
    exp = sorted([(1, 1, "a"), (1, 2, "unknown"), (None, 3, "unknown")], key=repr)
    assert rows(speakers.labelled(r, l, ["v", "i"])) == exp == rows(speakers.labelled(r.withColumn("label", F.lit("old")), l, ["v", "i"]))


def test_means_and_fallbacks(spark):
    nan = float("nan")
    d = spark.createDataFrame([(1, 1.5, 0.5), (1, None, nan), (1, 2.5, 0.25), (2, None, None)], "k int, duration double, confidence double")
    assert rows(scoring.means(d, ["k"])) == [(1, 3, 200, 375), (2, 1, None, None)]
    f = spark.createDataFrame([(0.1, "x"), (None, "Evaluation skipped for speed"), (nan, None), (None, "Batch parsing failed")], "s double, r string")
    assert [r.f for r in f.select(scoring.with_fallback(F.col("s"), F.col("r")).alias("f")).collect()] == [0.1, 0.75, 0.5, 0.5]
