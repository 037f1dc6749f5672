import datetime as dt

from pyspark.sql import functions as F

from cairn.functions.ids import canonical_hash, canonical_path
from cairn.operators.references import orphan_references, parent_lifetimes


def test_canonical_spellings(spark):
    df = spark.createDataFrame([(" ./a\\b//c.py ",), ("a/./b",), (None,), ("A/b",), ("",)], "p string")
    assert [r[0] for r in df.select(canonical_path("p")).collect()] == ["a/b/c.py", "a/b", None, "A/b", ""]
    df = spark.createDataFrame([(" SHA256:AbC ",), ("abc",), (None,), ("sha256: abc",)], "h string")
    assert [r[0] for r in df.select(canonical_hash("h")).collect()] == ["abc", "abc", None, "abc"]


def test_orphans_at_the_end_of_the_day(spark):
    day = lambda d, h=0: dt.datetime(2025, 1, d, h)
    raw = spark.createDataFrame(
        [("late", day(3), None), ("gone", day(1), day(2, 5)), ("back", day(1), day(2)), ("back", day(1), None), ("ok", day(1, 23), None), (None, day(1), None)],
        "k string, since timestamp, until timestamp",
    )
    parents = parent_lifetimes(raw, F.col("k"), F.col("since"), F.col("until"))
    refs = spark.createDataFrame(
        [("late", day(2)), ("late", day(3)), ("gone", day(1)), ("gone", day(2)), ("back", day(5)), ("ok", day(1)), ("never", day(1)), ("never", day(1)), (None, day(1)), ("ok", None)],
        "fk string, at timestamp",
    ).withColumn("day", F.to_date("at")).withColumn("key", F.lit("clash"))
    got = sorted((r["fk"], r["at"].day) for r in orphan_references(refs, parents).collect())
    assert got == [("gone", 2), ("late", 2), ("never", 1), ("never", 1)]
    assert orphan_references(refs.limit(0), parents).collect() == []
    assert orphan_references(refs, parents.limit(0)).count() == 8
