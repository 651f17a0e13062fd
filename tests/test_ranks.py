import random

from pyspark.sql import functions as F

from chronocue.operators.ranks import best_rows

from .conftest import rows


def test_as_sorting(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 6 + ["a", "b", None]), i, r.choice([0.5, 0.9, 0.9, None, float("nan"), r.random(), -3.0, float("inf")])) for i in range(3000)]
    by = {}
    for g, i, s in data:
        if g is not None and s is not None and s == s:
            by.setdefault(g, []).append((-s, i))
    exp = sorted([(g, k + 1, i) for g, l in by.items() for k, (_, i) in enumerate(sorted(l)[:3])], key=repr)
    df = spark.createDataFrame(data, "g string, i int, s double").withColumn("extra", F.lit(1))
    best = best_rows(df, ["g"], "s", ["i"], 3)
    assert rows(best.select("g", "rank_no", "i")) == exp
    assert "WindowGroupLimit" in best._jdf.queryExecution().toString()
    assert best_rows(df.limit(0), ["g"], "s", ["i"]).count() == 0
