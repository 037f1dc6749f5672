"""Processing only new or changed records, with a ledger of processed sequence numbers.

The ledger holds the sequence numbers (here `scan_id`) that earlier calls decided, as disjoint intervals. A call skips
what the ledger covers already when it reads, subtracts the ledger from what is available, and processes just the gaps -
rows that are new, and rows that were committed late below numbers already processed. Output, handled rows, the state
of the files that were touched and the merged ledger are committed as one version. A call that fails before its commit
leaves the former version current, so the next one processes the same gaps again: nothing is skipped and nothing is
repeated. What a call reads and writes follows from what is new, not from the history.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_hash
from cairn.operators.intervals import merge_intervals, rows_in, subtract_intervals, to_intervals
from cairn.session import broadcast_if_small, ensure_checkpoint_dir, table
from cairn.store import VersionedStore

STATE_COLUMNS = ["scan_id", "run_id", "file_id", "started_at", "h1", "h2"]
#: Intervals of the ledger, the longest first, that a read skips by a filter; and steps after which states are merged.
SKIPPED, MERGE_EVERY = 64, 16


def eligible_scans(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """The scan rows that a succeeded run handles, one for each run and file, with columns `STATE_COLUMNS`.

    A run handles its own rows that arrived by its end; of several for one file the one with the latest seen_at counts
    (ties: latest arrived_at, then the highest scan_id). Runs without an end or a start, and rows without a file, an
    arrival or a run, take no part. Exact duplicates of runs and rows count once. Hash renderings are made one and
    hashes are kept as 64-bit fingerprints, null as null.
    """
    done = (
        runs.filter(F.lower(F.trim("status")) == "succeeded")
        .select("run_id", "started_at", "finished_at")
        .filter(F.col("run_id").isNotNull() & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull())
        .distinct()
    )
    rows = scans.select(
        F.col("scan_id").cast("long").alias("scan_id"),
        "run_id",
        "file_id",
        "seen_at",
        "arrived_at",
        F.when(F.col("source_hash").isNotNull(), F.xxhash64(canonical_hash("source_hash"))).alias("h1"),
        F.when(F.col("input_hash").isNotNull(), F.xxhash64(canonical_hash("input_hash"))).alias("h2"),
    ).filter(F.col("file_id").isNotNull() & F.col("scan_id").isNotNull())
    joined = rows.join(broadcast_if_small(done), "run_id").filter(F.col("arrived_at") <= F.col("finished_at"))
    # one group per (run, file): map-side combine, and no sort of whole runs
    latest = F.max_by(F.struct("scan_id", "started_at", "h1", "h2"), F.struct("seen_at", "arrived_at", "scan_id"))
    return joined.groupBy("file_id", "run_id").agg(latest.alias("r")).select(
        "r.scan_id", "run_id", "file_id", "r.started_at", "r.h1", "r.h2"
    )


def final_runs(runs: DataFrame) -> DataFrame:
    """(run_id): the runs whose rows can be decided. They have a start and an end and succeeded or failed; rows of others
    stay gaps, for a later call."""
    status = F.lower(F.trim("status"))
    ended = F.col("run_id").isNotNull() & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull()
    return runs.filter(status.isin("succeeded", "failed") & ended).select("run_id").distinct()


def skip_processed(df: DataFrame, seq: str, ledger: DataFrame, most: int = SKIPPED) -> DataFrame:
    """`df` without the rows in the `most` longest intervals of `ledger`, by a filter that reaches the scan, where row
    groups inside them are not read. Null sequence numbers go too."""
    rows = ledger.orderBy(F.desc(F.col("hi") - F.col("lo")), "lo").limit(most).collect()
    keep = [F.col(seq).isNotNull(), *((F.col(seq) < r["lo"]) | (F.col(seq) > r["hi"]) for r in rows)]
    while len(keep) > 1:  # a flat tree: deep ones overflow the planner's stack
        keep = [reduce(and_, keep[i : i + 2]) for i in range(0, len(keep), 2)]
    return df.filter(keep[0])


def gap_rows(df: DataFrame, seq: str, ledger: DataFrame) -> DataFrame:
    """The rows of `df` whose sequence number `ledger` does not hold."""
    rest = skip_processed(df, seq, ledger)
    return rows_in(rest, seq, subtract_intervals(to_intervals(rest, seq), ledger))


def due_in_runs(todo: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The rows of `todo` that are due: no earlier run handled the file, or a hash differs from the last that did.

    `history` holds what former calls handled; it takes part as history only. Runs are ordered by (started_at, run_id),
    which for one file is the order within its repository.
    """
    rows = todo.select(*STATE_COLUMNS).withColumn("fresh", F.lit(True))
    if history is not None:
        rows = rows.unionByName(history.select(*STATE_COLUMNS).withColumn("fresh", F.lit(False)))
    w = Window.partitionBy("file_id").orderBy("started_at", "run_id")
    changed = ~F.col("h1").eqNullSafe(F.lag("h1").over(w)) | ~F.col("h2").eqNullSafe(F.lag("h2").over(w))
    first = F.lag("run_id").over(w).isNull()
    return rows.withColumn("due", first | changed).filter(F.col("fresh") & F.col("due")).select("run_id", "file_id", "scan_id")


def last_states(handled: DataFrame) -> DataFrame:
    """One row of `STATE_COLUMNS` for each file: what its last run handled."""
    last = F.max_by(F.struct(*STATE_COLUMNS), F.struct("started_at", "run_id"))
    return handled.groupBy("file_id").agg(last.alias("r")).select("r.*")


class IncrementalFiles:
    """Successive increments over growing tables, kept in a :class:`VersionedStore` below `root`.

    `step` processes what is new and commits it as one version: `due` and `handled` are appended, `state` gets a row for
    each file that was touched (and is merged every `MERGE_EVERY` steps), `ledger` is replaced. A row that comes late for
    a run that handled its file already is not handled again, whatever it says. One that comes late for an older run is
    compared with what came before that run, so only for such files the handled rows are read back; what later runs gave
    out is not taken back.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, VersionedStore(spark, root)

    def _ledger(self) -> DataFrame:
        return self.store.read("ledger") if self.store.current() else self.spark.createDataFrame([], "lo long, hi long")

    def _history(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of `fresh` to handle, their files' history): one state for most files, all handled rows where one is late."""
        touched = broadcast_if_small(fresh.select("file_id").distinct())
        states = last_states(self.store.read("state").join(touched, "file_id", "left_semi"))
        late_by = (F.col("f.started_at") < F.col("s.started_at")) | ((F.col("f.started_at") == F.col("s.started_at")) & (F.col("f.run_id") <= F.col("s.run_id")))
        late = fresh.alias("f").join(states.alias("s"), "file_id").filter(late_by).select("file_id").distinct()
        if late.isEmpty():
            return fresh, states
        late = broadcast_if_small(late)
        handled = self.store.read("handled").select(*STATE_COLUMNS).join(late, "file_id", "left_semi")
        again = handled.select("run_id", "file_id")
        return fresh.join(again, ["run_id", "file_id"], "left_anti"), states.join(late, "file_id", "left_anti").unionByName(handled)

    def step(self, scans: DataFrame, runs: DataFrame) -> DataFrame:
        """What is due because of rows that no former step decided: (run_id, file_id, scan_id)."""
        ledger = self._ledger()
        columns = ["scan_id", "run_id", "file_id", "source_hash", "input_hash", "seen_at", "arrived_at"]
        with self.store.commit() as version:
            version.write("gaps", gap_rows(scans.select(F.col("scan_id").cast("long").alias("scan_id"), *columns[1:]), "scan_id", ledger))
            gaps = version.reread("gaps")
            decided = gaps.join(broadcast_if_small(final_runs(runs)), "run_id", "left_semi")
            version.write("decided", to_intervals(decided, "scan_id"))
            version.write("batch", eligible_scans(gaps, runs))
            # the rest follows from what was just written, so a task that is run again cannot change what is committed
            fresh = version.reread("batch")
            fresh, history = self._history(fresh) if version.number > 1 else (fresh, None)
            version.append("handled", fresh.select(*STATE_COLUMNS))
            version.append("due", due_in_runs(version.reread("handled"), history))
            version.append("state", last_states(version.reread("handled")))
            if version.number % MERGE_EVERY == 0:
                states = last_states(version.read("state"))
                version.folder += "-merged"
                version.write("state", states)
                version.folder = version.folder.removesuffix("-merged")
            version.write("ledger", merge_intervals(ledger, version.reread("decided")))
            for passing in ("gaps", "batch", "decided"):
                version.tables.pop(passing)
        return self.last()

    def last(self) -> DataFrame:
        """What was due in the last step."""
        return self.spark.read.parquet(self.store.tables()["due"][-1])

    def due(self) -> DataFrame:
        """What has been due in all steps."""
        return self.store.read("due")


def _increments(spark: SparkSession) -> IncrementalFiles:
    return IncrementalFiles(spark, f"{ensure_checkpoint_dir(spark)}/increments-{uuid.uuid4().hex}")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, file_id): the files due in each succeeded run, all handled in one step."""
    return _increments(spark).step(table(spark, sf_dir, "file_scans"), table(spark, sf_dir, "index_runs")).select("run_id", "file_id")


def p2_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lo, hi): the ledger after all of file_scans has been handled."""
    job = _increments(spark)
    job.step(table(spark, sf_dir, "file_scans"), table(spark, sf_dir, "index_runs"))
    return job.store.read("ledger")


class _Lost(RuntimeError):
    pass


def p2_runs(spark: SparkSession, sf_dir: str, steps: int = 3) -> DataFrame:
    """(run_id, file_id): the union of what `steps` steps found due, as the tables grew. A step sees the rows that had
    arrived and the runs that had ended by its time, so most of what it handles lies in gaps below numbers that former
    ones decided; the second step is lost just before its commit and then done again."""
    scans, runs = table(spark, sf_dir, "file_scans"), table(spark, sf_dir, "index_runs")
    job = _increments(spark)
    shares = [i / steps for i in range(1, steps)]
    cuts = runs.agg(F.percentile_approx(F.unix_micros("finished_at"), shares)).first()[0] or []
    for i, cut in enumerate([*cuts, None]):
        seen = scans if cut is None else scans.filter(F.unix_micros("arrived_at") <= cut)
        ended = runs if cut is None else runs.withColumn("status", F.when(F.unix_micros("finished_at") <= cut, F.col("status")))
        if i == 1:
            try:
                with job.store.commit() as version:
                    version.append("due", eligible_scans(seen, ended).select("run_id", "file_id", "scan_id"))
                    raise _Lost
            except _Lost:
                pass
        job.step(seen, ended)
    return job.due().select("run_id", "file_id")


_HASH = "trim(regexp_replace(lower(trim({c})), '^[a-z0-9_.-]+:', ''))"
_ELIGIBLE = f"""
  runs AS (SELECT DISTINCT run_id, started_at, finished_at FROM index_runs
           WHERE lower(trim(status)) = 'succeeded' AND started_at IS NOT NULL),
  elig AS (SELECT s.scan_id, s.run_id, s.file_id, r.started_at, {_HASH.format(c="s.source_hash")} AS h1,
             {_HASH.format(c="s.input_hash")} AS h2
           FROM (SELECT DISTINCT * FROM file_scans) s JOIN runs r ON s.run_id = r.run_id
           WHERE s.arrived_at <= r.finished_at AND s.file_id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY s.run_id, s.file_id ORDER BY s.seen_at DESC, s.arrived_at DESC, s.scan_id DESC) = 1)
"""
SQL = {
    "p2_found": f"""WITH {_ELIGIBLE},
  seq AS (SELECT *, lag(run_id) OVER w AS prev, lag(h1) OVER w AS p1, lag(h2) OVER w AS p2 FROM elig
          WINDOW w AS (PARTITION BY file_id ORDER BY started_at, run_id))
SELECT run_id, file_id FROM seq WHERE prev IS NULL OR h1 IS DISTINCT FROM p1 OR h2 IS DISTINCT FROM p2""",
    "p2_ledger": """WITH final AS (SELECT DISTINCT run_id FROM index_runs WHERE lower(trim(status)) IN ('succeeded', 'failed')
             AND run_id IS NOT NULL AND started_at IS NOT NULL AND finished_at IS NOT NULL),
  ids AS (SELECT DISTINCT scan_id FROM file_scans JOIN final USING (run_id) WHERE scan_id IS NOT NULL),
  g AS (SELECT scan_id, scan_id - row_number() OVER (ORDER BY scan_id) AS grp FROM ids)
SELECT min(scan_id) AS lo, max(scan_id) AS hi FROM g GROUP BY grp""",
}
SQL["p2_runs"] = SQL["p2_found"]
QUERIES = {"p2_found": p2_found, "p2_ledger": p2_ledger, "p2_runs": p2_runs}
