import random

from pyspark.sql import functions as F
from tests.conftest import rows

from chronocue.operators import chunks
from chronocue.operators.intervals import merged
from chronocue.streaming import chunks as sc
from chronocue.streaming import intervals as si


def files(spark, tmp_path, df, n):
    path = str(tmp_path / "in")
    df.repartition(n).write.parquet(path)
    return path


def test_intervals_as_they_arrive(spark, tmp_path):
    r = random.Random(1)
    data = [(r.choice([1, 1, 2]), s, s + r.choice([0.1, 2, 15])) for s in (r.random() * 200 for _ in range(300))]
    df = spark.createDataFrame(data, "video_id bigint, s double, e double")
    stream = sc.stream_of(spark, files(spark, tmp_path, df, 4), df)
    out = si.slab_periods(stream, "video_id", "s", "e", slab=1000)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    newest = si.newest(spark.read.parquet(str(tmp_path / "out")))
    got = merged(newest.select("entity", (F.col("a") / 100).alias("s"), (F.col("b") / 100).alias("e")), "entity", "s", "e").withColumnRenamed("entity", "video_id")
    assert rows(got.select("video_id", "kind", "from_cs", "to_cs")) == rows(merged(df, "video_id", "s", "e").select("video_id", "kind", "from_cs", "to_cs"))


def test_chunk_counts_stream_is_as_batch(spark, tmp_path):
    r = random.Random(2)
    data = [(r.choice([1, 2, None]), r.choice([None, r.random() * 500]), 600.0) for _ in range(200)]
    df = spark.createDataFrame(data, "video_id bigint, start_time double, end_time double")
    stream = sc.stream_of(spark, files(spark, tmp_path, df, 3), df)
    q = sc.chunk_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("counts")) == rows(sc.chunk_counts(df))


def test_rewritten_transcript_is_the_batch_one(spark, tmp_path):
    seg = "video_id bigint, seg_index int, start_cs bigint, end_cs bigint, text string"
    df = spark.createDataFrame([(v, i, i * 900, i * 900 + 10, f"t{i} ") for v in (1, 2) for i in range(40)], seg)
    seen = []

    def render(d):
        seen.append({r[0] for r in d.select("video_id").distinct().collect()})
        return sc.newest_text(chunks.assigned(d))

    folder = files(spark, tmp_path, df, 3)
    run = lambda: sc.rewriting(sc.stream_of(spark, folder, df), str(tmp_path / "store"), str(tmp_path / "cp"), render, str(tmp_path / "out")).awaitTermination()
    run()
    batches = len(seen)
    run()  # nothing new: nothing is rendered
    assert len(seen) == batches
    more = spark.createDataFrame([(2, 40, 36_000, 36_010, "late")], seg)
    more.coalesce(1).write.mode("append").parquet(folder)
    run()
    assert seen[-1] == {2}
    df = df.unionByName(more)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("video_id", "so_far")) == rows(chunks.whole_text(chunks.chunk_texts(chunks.assigned(df))))


def test_event_time(spark, tmp_path):
    df = spark.sql("select timestamp'2025-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) at, m % 2 k, m id from (select explode(sequence(0, 100, 5)) m)")
    path = files(spark, tmp_path, df, 1)
    for name, f in (("w", lambda s: sc.windowed(s, "at", "k", "10 minutes", "5 minutes")), ("s", lambda s: sc.sessions(s, "at", "k", "11 minutes", "5 minutes")), ("o", lambda s: sc.once_by(s, ["id"], "at", "1 hour"))):
        q = f(sc.stream_of(spark, path, df)).writeStream.outputMode("append").format("memory").queryName(f"e_{name}").option("checkpointLocation", str(tmp_path / f"cp{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("e_o").count() == 21
    assert spark.table("e_w").count() > 0
