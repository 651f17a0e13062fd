import random

from tests.conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from chronocue.operators.intervals import IntervalMap, merged

SCHEMA = "video_id bigint, s double, e double, entity string, a int"


def brute(data):
    """Periods and gaps by sorting."""
    by = {}
    for v, s, e, *_ in data:
        if v is None or s is None or e is None or s != s or e != e:
            continue
        a, b = round(s * 100), round(e * 100)
        if b > a:
            by.setdefault(v, []).append((a, b))
    out = []
    for v, l in by.items():
        periods = []
        for a, b in sorted(l):
            if periods and a <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out += [(v, "period", a, b) for a, b in periods] + [(v, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:])]
    return sorted(out, key=repr)


def run(spark, data, slab):
    full = [(v, s, e, "clash", 1) for v, s, e in data]
    return rows(merged(spark.createDataFrame(full, SCHEMA).repartition(3), "video_id", "s", "e", slab).select("video_id", "kind", "from_cs", "to_cs"))


def test_map_inserts_by_binary_search():
    m = IntervalMap()
    for a, b in [(10, 20), (30, 40), (20, 25), (0, 5), (4, 12), (50, 60), (45, 46)]:
        m.insert(a, b)
    assert m.periods() == [(0, 25), (30, 40), (45, 46), (50, 60)] and m.gaps() == [(25, 30), (40, 45), (46, 50)]


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=40))
def test_map_is_as_sorting(pairs):
    m = IntervalMap()
    size = 0
    for a, n in pairs:
        size += m.insert(a, a + n)
    assert size == len(m)
    points = sorted({x for a, n in pairs for x in range(2 * a, 2 * (a + n) + 1)})
    runs = []
    for x in points:
        if runs and x == runs[-1][1] + 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    assert m.periods() == [(a // 2, b // 2) for a, b in runs]


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(None, 1.0, 2.0), (1, None, 2.0), (1, 1.0, None), (1, nan, 2.0), (1, 1.0, nan), (1, 5.0, 5.0), (1, 6.0, 5.0), (1, 1.0, 1.001), (1, inf, inf), (2, 1.0, 2.0), (2, 2.0, 3.0), (2, 2.0, 3.0), (2, 3.0100000001, 4.0), (3, -7.8e-12, 1.0), (4, -5.0, -1.0), (4, -3.0, 2.0)]
    assert run(spark, data, 100) == sorted([(2, "period", 100, 300), (2, "gap", 300, 301), (2, "period", 301, 400), (3, "period", 0, 100), (4, "period", -500, 200)], key=repr)


def test_empty(spark):
    assert run(spark, [], 100) == []


def test_a_hot_entity_over_many_slabs(spark):
    r = random.Random(3)
    data = [(r.choice([1, 1, 1, 2, 3]), s, s + r.choice([0.05, 0.5, 3, 40])) for s in (r.random() * 400 for _ in range(1500))]
    for slab in (7, 100, 1000, 10**9):
        assert run(spark, data, slab) == brute(data)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 50), st.integers(0, 30)), max_size=25))
def test_any_small_table(spark, data):
    table = [(v, a / 10, (a + n) / 10) for v, a, n in data]
    assert run(spark, table, 37) == brute(table)


def test_one_interval_over_all_slabs(spark):
    data = [(1, 0.0, 1e9), (1, 5.0, 6.0), (1, 2e9, 2e9 + 1)]
    assert run(spark, data, 50) == brute(data)
