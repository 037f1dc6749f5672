"""Watching a source tree: poll, diff against the baseline, wait until it is quiet, then hand on one batch."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.delta import diff
from cairn.sources.scan import read_repository


@dataclass
class ChangeBatch:
    """Sorted paths; a merge is the union of each."""

    changed: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.changed or self.added or self.removed)

    def merge(self, other: "ChangeBatch") -> "ChangeBatch":
        join = lambda a, b: sorted({*a, *b})
        return ChangeBatch(join(self.changed, other.changed), join(self.added, other.added), join(self.removed, other.removed))


class Watcher:
    """Finds what changed below `root` since the baseline; a batch comes out once nothing changed for `debounce` seconds.

    The state of a poll is a table (path, source_hash) kept as a version of files, not in memory; only the paths that
    differ reach the driver.
    """

    def __init__(self, spark: SparkSession, root: str, state: str, debounce: float = 3.0, ignores: list[str] = ()):
        self.spark, self.root, self.state, self.debounce, self.ignores = spark, root, state.rstrip("/"), debounce, list(ignores)
        self.n, self.pending, self.since = 0, ChangeBatch(), None
        self.baseline = self.latest = self._scan()

    def _scan(self) -> str:
        self.n += 1
        path = f"{self.state}/poll={self.n % 3}"
        rows = read_repository(self.spark, self.root, ignores=self.ignores).select("path", "source_hash")
        rows.write.mode("overwrite").parquet(path)
        return path

    def _diff(self, old: str, new: str) -> ChangeBatch:
        rows = diff(self.spark.read.parquet(old), self.spark.read.parquet(new), "path", "source_hash").collect()
        pick = lambda kind: sorted(r["path"] for r in rows if r["change"] == kind)
        return ChangeBatch(pick("changed"), pick("added"), pick("removed"))

    def poll(self, now: float) -> ChangeBatch | None:
        """One poll at time `now` (seconds); the batch that is due, or None."""
        latest = self._scan()
        fresh = self._diff(self.latest, latest)
        if fresh:
            self.pending, self.since = self.pending.merge(fresh), now
        self.latest = latest
        if self.pending and self.since is not None and now - self.since >= self.debounce:
            batch, self.pending, self.since = self.pending, ChangeBatch(), None
            return batch
        return None


def watch(spark: SparkSession, watcher: Watcher, on_batch: Callable[[ChangeBatch], None], interval: str = "2 seconds", checkpoint: str | None = None):
    """A streaming query that polls on every trigger (a rate source only ticks) and calls `on_batch` for each due batch."""
    import time

    def tick(_: DataFrame, __: int) -> None:
        batch = watcher.poll(time.time())
        if batch:
            on_batch(batch)

    writer = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(tick).trigger(processingTime=interval)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def debounced_stream(changes: DataFrame, gap: str = "3 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Change events (repo, path, kind, ts) of a stream as batches: one session for each repository that ends after a gap."""
    return (
        changes.withWatermark("ts", lateness)
        .groupBy("repo", F.session_window("ts", gap).alias("w"))
        .agg(F.array_sort(F.collect_set(F.struct("kind", "path"))).alias("changes"), F.count(F.lit(1)).alias("events"))
        .select("repo", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "changes", "events")
    )
