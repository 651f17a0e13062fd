"""Every query runs at the smallest scale, and agrees with its SQL."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from chronocue import queries as core  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    import decimal

    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in core.SQL:
        r = con.execute(core.SQL[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in sorted(names)]
        assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return d


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_of_empty_tables(spark, empty, name):
    totals = {"high_value_subset", "rollup_levels"}  # these have a row for the whole, whatever it holds
    assert core.QUERIES[name](spark, empty).count() <= (1 if name in totals else 0)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "chronocue")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, n)).read(), n


def test_the_package_is_shipped_once(spark):
    from chronocue import session

    session.ship(spark)
    before = list(spark.sparkContext._python_includes)
    session.ship(spark)
    assert spark.sparkContext._python_includes == before and any(n.endswith("chronocue.zip") for n in before)
