"""Ranks inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint


def group_ranks(df: DataFrame, group: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """One row for each distinct (group, order): with `less` and `equal`, how many rows of the group sort before it
    and with it, and `total`, how many rows the group has. Nulls sort first and equal each other.

    Rows are counted by value before anything is moved, the distinct values are range-partitioned over (group, order),
    so a hot group is spread over many partitions, and each partition adds the totals of those before it. The
    partitioned counts are checkpointed: both uses of the partition number must see the same partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("equal"))
    parts = checkpoint(counts.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id()))
    inner = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = (
        parts.groupBy("__part", *group)
        .agg(F.sum("equal").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(across), F.lit(0)))
        .withColumn("total", F.sum("__n").over(whole))
    )
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__part", *group)]
    local = parts.withColumn("__less", F.coalesce(F.sum("equal").over(inner), F.lit(0)))
    return local.alias("a").join(offsets.alias("b"), cond).select(
        *[F.col(f"a.{c}") for c in (*group, *order)],
        (F.col("a.__less") + F.col("b.__before")).alias("less"),
        F.col("a.equal").alias("equal"),
        F.col("b.total").alias("total"),
    )
