"""Queries and checks from the command line.

    python -m chronocue list
    python -m chronocue run chunk_rollup --tables /data --out /out
    python -m chronocue cut --video a.mp4 --ranges "0:10-0:20, 1:05.5-1:30" --output reel.mp4

``run`` writes a query's rows as parquet; ``cut`` prints the encoder's command
for time ranges in the order given, or which of them can't be read.
"""

from __future__ import annotations

import argparse
import shlex

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.timecode import range_list
from .models.adapters import encode_command
from .sinks.render import filter_graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronocue", description="Time-coded transcripts on Spark.")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="write a query's rows")
    run.add_argument("name")
    run.add_argument("--tables", required=True, help="folder of the tables")
    run.add_argument("--out", required=True, help="folder to write parquet to; one that exists is an error")
    cut = commands.add_parser("cut", help="the command that cuts a video")
    cut.add_argument("--video", "-v", required=True)
    cut.add_argument("--ranges", "-r", required=True, help="M:SS.ff-M:SS.ff, parted by commas")
    cut.add_argument("--output", "-o", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from . import queries
    from .session import ship

    if args.command == "list":
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    if args.command == "run" and args.name not in queries.QUERIES:
        print(f"no query {args.name}")
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args.command == "run":
        ship(spark)
        queries.QUERIES[args.name](spark, args.tables).write.parquet(args.out)
        return 0
    r = F.col("r")
    one = spark.createDataFrame([(args.video, args.ranges, args.output)], "v string, l string, o string").withColumn("r", range_list(F.col("l")))
    command = encode_command(F.col("v"), filter_graph(F.transform(r, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))), F.col("o"))
    row = one.select(command.alias("c"), F.transform(F.filter(r, lambda x: x["start"].isNull() | x["end"].isNull()), lambda x: x["text"]).alias("bad")).first()
    if row.bad or None in row.c:
        print("no ranges" if not row.bad else "\n".join(f"can't be read: {b}" for b in row.bad))
        return 1
    print(shlex.join(row.c))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
