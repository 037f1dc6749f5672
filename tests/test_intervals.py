from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cairn.operators.intervals import merge_intervals, rows_in, subtract_intervals, to_intervals

numbers = st.sets(st.integers(0, 60), max_size=40)
few = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def _covered(df):
    rows = sorted((r["lo"], r["hi"]) for r in df.collect())
    assert all(a[1] + 1 < b[0] for a, b in zip(rows, rows[1:])), rows  # disjoint and maximal
    return {x for lo, hi in rows for x in range(lo, hi + 1)}


@few
@given(a=numbers, b=numbers)
def test_interval_algebra(spark, a, b):
    ia, ib = (to_intervals(_frame(spark, x), "n", 8) for x in (a, b))
    assert _covered(ia) == a
    assert _covered(merge_intervals(ia, ib, 8)) == a | b
    gaps = subtract_intervals(ia, ib, 8)
    assert _covered(gaps) == a - b
    assert {r[0] for r in rows_in(_frame(spark, a | b), "n", gaps, 8).collect()} == a - b


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,), (9,)], "n long")
    assert sorted(map(tuple, to_intervals(df, "n").collect())) == [(1, 2), (9, 9)]
    empty = spark.createDataFrame([], "lo long, hi long")
    assert to_intervals(spark.createDataFrame([], "n long"), "n").collect() == []
    assert merge_intervals(empty, empty).collect() == []
    assert rows_in(df, "n", empty).collect() == []
