import random

from tests.conftest import rows
from pyspark.sql import functions as F

from chronocue.llm.topn import best_segments, thresholds, top_n

REPORT = "report_id bigint, metadata struct<audio_path:string>, segments struct<evaluated:array<struct<text:string,value_score:double>>>, rank_no int"


def brute(data, n):
    by = {}
    for g, i, s in data:
        if g is not None and s is not None and s == s:
            by.setdefault(g, []).append((-s, i))
    return sorted([(g, k + 1, i) for g, l in by.items() for k, (_, i) in enumerate(sorted(l)[:n])], key=repr)


def test_top_n_is_as_sorting(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([0.5, 0.9, 0.9, None, float("nan"), r.random(), -3.0, float("inf")])) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i int, s double").withColumn("extra", F.lit(1))
    assert rows(top_n(df, ["g"], "s", ["i"], 3).select("g", "rank_no", "i")) == brute(data, 3)


def test_threshold_leaves_at_least_n(spark):
    data = [("a", i / 100) for i in range(100)] + [("b", 0.1)]
    t = {r.g: r["__least_bin"] for r in thresholds(spark.createDataFrame(data, "g string, s double"), ["g"], "s", 3, 1 / 64).collect()}
    assert sum(1 for g, s in data if g == "a" and s * 64 // 1 >= t["a"]) >= 3 and t["b"] == 6


def test_ties_repeats_and_dirty_reports(spark):
    nan = float("nan")
    seg = lambda *s: {"evaluated": [{"text": "t", "value_score": x} for x in s]}
    data = [
        (2, {"audio_path": "p"}, seg(0.9, 0.5, None, 0.9), 7), (2, {"audio_path": "p"}, seg(0.9, 0.5, None, 0.9), 7), (1, {"audio_path": "p"}, seg(nan, 0.9), 7),
        (3, {"audio_path": None}, seg(1.0), 7), (4, {"audio_path": "q"}, seg(), 7), (5, {"audio_path": "q"}, {"evaluated": None}, 7), (6, {"audio_path": "r"}, seg(0.0, -0.0), 7), (7, None, None, 7),
    ]
    got = rows(best_segments(spark.createDataFrame(data, REPORT)).select("audio_path", "rank_no", "report_id", "seg_no"))
    assert got == [("p", 1, 1, 1), ("p", 2, 2, 0), ("p", 3, 2, 3), ("r", 1, 6, 0), ("r", 2, 6, 1)]


def test_a_long_array_of_equal_scores(spark):
    data = [(r, {"audio_path": "p"}, {"evaluated": [{"text": "", "value_score": 0.5}] * 2000}, 0) for r in (5, 6)]
    got = rows(best_segments(spark.createDataFrame(data, REPORT)).select("report_id", "seg_no"))
    assert got == [(5, 0), (5, 1), (5, 2)]


def test_empty(spark):
    assert best_segments(spark.createDataFrame([], REPORT)).count() == 0


def test_a_hot_group_is_spread(spark):
    data = [("hot", i, (i * 7919) % 1000 / 1000) for i in range(5000)]
    df = spark.createDataFrame(data, "g string, i int, s double")
    assert rows(top_n(df, ["g"], "s", ["i"], 5).select("g", "rank_no", "i")) == brute(data, 5)
    plan = top_n(df, ["g"], "s", ["i"], 5)._jdf.queryExecution().toString()
    assert "__salt" in plan and "WindowGroupLimit" in plan
