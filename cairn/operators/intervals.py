"""Sets of sequence numbers kept as disjoint closed intervals (lo, hi).

Every step works on blocks of `block` consecutive numbers, so no window partition holds more than one block and the
cost is a sort of the rows in it. Only the intervals that touch a block's edge (at most two per block) meet in one
window when neighbouring blocks are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive sequence numbers that are handled in one window partition.
BLOCK = 1 << 20


def _block(c, block: int):
    return F.floor(F.col(c) / F.lit(block))


def _join_blocks(parts: DataFrame, block: int) -> DataFrame:
    """Merge intervals (block, lo, hi), disjoint and maximal inside their block, across block borders."""
    at_edge = (F.col("lo") == F.col("block") * block) | (F.col("hi") == F.col("block") * block + block - 1)
    inner = parts.filter(~at_edge).select("lo", "hi")
    w = Window.orderBy("lo")
    edges = (
        parts.filter(at_edge)
        .withColumn("new", (F.col("lo") != F.lag("hi").over(w) + 1) | F.lag("hi").over(w).isNull())
        .withColumn("grp", F.sum(F.col("new").cast("long")).over(w))
        .groupBy("grp")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("lo", "hi")
    )
    return inner.unionByName(edges)


def to_intervals(df: DataFrame, seq: str, block: int = BLOCK) -> DataFrame:
    """Disjoint maximal intervals (lo, hi) that hold exactly the distinct non-null values of `seq`."""
    w = Window.partitionBy("block").orderBy("seq")
    parts = (
        df.select(F.col(seq).cast("long").alias("seq"))
        .filter(F.col("seq").isNotNull())
        .distinct()
        .withColumn("block", _block("seq", block))
        .withColumn("grp", F.col("seq") - F.row_number().over(w))
        .groupBy("block", "grp")
        .agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    )
    return _join_blocks(parts, block)


def _pieces(intervals: DataFrame, block: int) -> DataFrame:
    """Intervals cut at block borders: (block, lo, hi)."""
    return (
        intervals.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
        .filter(F.col("lo") <= F.col("hi"))
        .withColumn("block", F.explode(F.sequence(_block("lo", block), _block("hi", block))))
        .select(
            "block",
            F.greatest("lo", F.col("block") * block).alias("lo"),
            F.least("hi", F.col("block") * block + block - 1).alias("hi"),
        )
    )


def _sweep(events: DataFrame, keep, block: int) -> DataFrame:
    """Events (block, at, a, b) are changes of two coverages; keep the stretches where `keep(a, b)` holds."""
    w = Window.partitionBy("block").orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    covered = (
        events.groupBy("block", "at")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .withColumn("a", F.sum("a").over(run))
        .withColumn("b", F.sum("b").over(run))
        .withColumn("until", F.coalesce(F.lead("at").over(w), F.col("block") * block + block) - 1)
        .withColumn("on", keep(F.col("a"), F.col("b")))
        .withColumn("new", F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False)))
        .withColumn("grp", F.sum(F.col("new").cast("long")).over(run))
        .filter("on")
        .groupBy("block", "grp")
        .agg(F.min("at").alias("lo"), F.max("until").alias("hi"))
    )
    return _join_blocks(covered, block)


def _events(intervals: DataFrame, a: int, b: int, block: int) -> DataFrame:
    edge = F.explode(
        F.array(
            F.struct(F.col("lo").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")),
            F.struct((F.col("hi") + 1).alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b")),
        )
    )
    return (
        _pieces(intervals, block)
        .select("block", edge.alias("e"))
        .select("block", "e.*")
        .filter(F.col("at") < F.col("block") * block + block)
    )


def merge_intervals(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """The union of two interval sets; overlapping and touching intervals become one."""
    events = _events(left, 1, 0, block).unionByName(_events(right, 1, 0, block))
    return _sweep(events, lambda a, b: a > 0, block)


def subtract_intervals(available: DataFrame, processed: DataFrame, block: int = BLOCK) -> DataFrame:
    """What of `available` is not in `processed`: the gaps, as disjoint maximal intervals."""
    events = _events(available, 1, 0, block).unionByName(_events(processed, 0, 1, block))
    return _sweep(events, lambda a, b: (a > 0) & (b <= 0), block)


def rows_in(df: DataFrame, seq: str, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of `df` whose `seq` lies in one of the disjoint `intervals`; null lies in none.

    Rows and intervals are sorted together inside each block and every row looks at the last interval that began, so
    the work does not grow with rows times intervals. All columns of `df` are kept.
    """
    cols = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col(f"`{seq}`").cast("long").alias("__at"))
    rows = rows.filter(F.col("__at").isNotNull()).select(
        "__row", "__at", _block("__at", block).alias("__block"), F.lit(None).cast("long").alias("__hi"), F.lit(1).alias("__o")
    )
    marks = _pieces(intervals, block).select(
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"),
        F.col("lo").alias("__at"),
        F.col("block").alias("__block"),
        F.col("hi").alias("__hi"),
        F.lit(0).alias("__o"),
    )
    w = Window.partitionBy("__block").orderBy("__at", "__o").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(marks)
        .withColumn("__last", F.last("__hi", ignorenulls=True).over(w))
        .filter((F.col("__o") == 1) & (F.col("__at") <= F.col("__last")))
        .select("__row.*")
    )
