from chronocue.__main__ import main


def test_commands(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "chunk_rollup" in capsys.readouterr().out.split()
    assert main(["cut", "-v", "a b.mp4", "-r", "0:10-0:20, 1:05.5-1:30", "-o", "o.mp4"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("ffmpeg -y -i 'a b.mp4' -filter_complex '[0:v]trim=start=10.00:end=20.00") and "trim=start=65.50:end=90.00" in out and out.strip().endswith("o.mp4")
    assert main(["cut", "-v", "a", "-r", "0:10-0:20, 5-4", "-o", "o"]) == 1 and "5-4" in capsys.readouterr().out
    assert main(["cut", "-v", "a", "-r", " , ", "-o", "o"]) == 1
    assert main(["run", "nothing", "--tables", "x", "--out", "y"]) == 2
    spark.createDataFrame([(1, 200.0, 1.26)], "video_id bigint, duration double, size_mb double").write.parquet(f"{tmp_path}/videos.parquet")
    assert main(["run", "chunk_counts", "--tables", str(tmp_path), "--out", f"{tmp_path}/out"]) == 0
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 2, 1.3)]
