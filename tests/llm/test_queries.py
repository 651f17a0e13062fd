import os

import pytest
from pyspark.sql import functions as F

from chronocue.llm import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "p1_found": "row_id bigint, lang string", "p1_languages": "row_id bigint, lang string, confidence double, words int, n_languages int", "p2_forms": "kind string, id bigint, form string, look string",
    "p2_found": "row_id bigint, line_id bigint", "p4_found": "video_id bigint, speaker_key string, first_seg bigint, last_seg bigint",
    "p4_turns": "video_id bigint, speaker_key string, turn_seg bigint, part_no bigint, first_seg bigint, last_seg bigint, n_words bigint, said string",
    "p5_found": "audio_path string, rank_no bigint, report_id bigint, seg_no bigint",
    "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id bigint", "p7_covered": "doc_id bigint, item_id bigint, tiles int, longest int, covered_permille bigint", "p8_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, name):
    df = q.QUERIES[name](spark, DATA)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    assert df.count() > 0


@pytest.mark.parametrize("name", list(q.SQL))
def test_agrees_with_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    r = c.execute(q.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(map(tuple, q.QUERIES[name](spark, DATA).select(*names).collect()), key=repr) == sorted(r.fetchall(), key=repr)


def test_pairs_are_those_of_equal_looks(spark):
    f = q.p2_forms(spark, DATA)
    s, t = q.table(spark, DATA, "results_simplified").select("row_id", "video_id", "chunk_num", F.col("text").alias("a")), q.table(spark, DATA, "full_transcript").select("line_id", "video_id", "chunk_num", F.col("text").alias("b"))
    x, y = (f.where(F.col("kind") == k).select(F.col("id").alias(i), "look", "form") for k, i in (("row", "row_id"), ("line", "line_id")))
    both = s.join(x, "row_id").join(t.join(y.withColumnsRenamed({"form": "form_b"}), "line_id"), ["video_id", "chunk_num", "look"]).where("a <> b and form <> ''")
    got = sorted(map(tuple, q.p2_found(spark, DATA).collect()))
    assert sorted(map(tuple, both.select("row_id", "line_id").collect())) == got
    # A form has no accidents of writing left: nearly all pairs have one form, the rest differ in letters that look alike in a script of their own.
    assert both.where("form = form_b").count() >= 0.95 * len(got)


def test_labels_of_held_out_items(spark):
    """Language of the test items, whose labels are clean and which the fit hasn't seen."""
    d = "/root/testdata/sf0.01"
    model = q.fit(q.labelled_sample(q.table(spark, d, "documents")))
    items = q.table(spark, d, "eval_items")
    found = q.languages(items, model, "item_id", label="lang")
    right = found.where((F.col("n_languages") == 1) & (F.col("lang") == F.col("labelled"))).count()
    assert right >= 0.97 * items.count()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return d


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_empty_tables(spark, empty, name):
    df = q.QUERIES[name](spark, empty)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    assert df.count() == 0
