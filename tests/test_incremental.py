import datetime as dt

import pytest

from cairn.operators.incremental import IncrementalFiles, gap_rows, skip_processed
from cairn.store import Conflict

T0 = dt.datetime(2025, 1, 1)
SCAN = "scan_id long, run_id long, repo string, file_id string, source_hash string, input_hash string, seen_at timestamp, arrived_at timestamp, status string"
RUN = "run_id long, repo string, started_at timestamp, finished_at timestamp, status string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def scan(i, run, file, h, minute, arrived=None, inp=None):
    return (i, run, "r", file, h, inp, at(minute), at(minute if arrived is None else arrived), "extra")


def runs(spark, *rows):
    return spark.createDataFrame([(i, "r", at(s), None if f is None else at(f), status) for i, s, f, status in rows], RUN)


def plain(scans, run_rows):
    """The rule, read off directly."""
    done = sorted({(s, i, f) for i, s, f, st in run_rows if st == "succeeded" and f is not None})
    norm = lambda h: None if h is None else h.strip().lower().removeprefix("sha256:").strip()
    state, out = {}, set()
    for s, i, f in done:
        latest = {}
        for x in set(scans):
            if x[1] == i and x[3] is not None and x[7] <= at(f):
                if x[3] not in latest or (x[6], x[7], x[0]) > (latest[x[3]][6], latest[x[3]][7], latest[x[3]][0]):
                    latest[x[3]] = x
        for file, x in latest.items():
            v = (norm(x[4]), norm(x[5]))
            if file not in state or state[file] != v:
                out.add((i, file))
            state[file] = v
    return out


RUNS = [(7, 0, 10, "succeeded"), (3, 20, 30, "failed"), (5, 40, 50, "succeeded"), (1, 60, None, "running"), (2, 80, 90, "succeeded"), (2, 80, 90, "succeeded"), (9, 100, 110, None)]
SCANS = [
    scan(1, 7, "a", "H1", 1), scan(2, 7, "b", "x", 2), scan(3, 7, "a", "H2", 5), scan(4, 7, "c", "y", 3, arrived=15),
    scan(5, 3, "a", "zzz", 21), scan(6, 5, "a", "sha256:h2 ", 41), scan(7, 5, "b", "x", 42, inp="i"), scan(8, 5, "c", "y", 43),
    scan(9, 1, "a", "q", 61), scan(10, 2, "a", "h3", 81), scan(11, 2, "b", "X", 82, inp="I"), scan(11, 2, "b", "X", 82, inp="I"),
    scan(12, 2, None, "n", 83), scan(13, 2, "c", None, 84),
]


def test_due_files_follow_the_rule(spark, tmp_path):
    due = IncrementalFiles(spark, str(tmp_path)).step(spark.createDataFrame(SCANS, SCAN), runs(spark, *RUNS))
    assert {(r["run_id"], r["file_id"]) for r in due.collect()} == plain(SCANS, RUNS)


def test_steps_neither_skip_nor_repeat(spark, tmp_path):
    job = IncrementalFiles(spark, str(tmp_path / "ledger"))
    frame = lambda n: spark.createDataFrame(SCANS[:n], SCAN)
    first = {(r["run_id"], r["file_id"]) for r in job.step(frame(5), runs(spark, *RUNS[:2])).collect()}
    assert first == plain(SCANS[:5], RUNS[:2])
    # a step that fails before its commit leaves the version as it was
    commit = job.store.commit
    with pytest.raises(RuntimeError):
        with commit() as v:
            v.write("due", frame(1))
            raise RuntimeError("lost")
    assert job.store.current() == 1
    job.step(frame(len(SCANS)), runs(spark, *RUNS))
    assert job.step(frame(len(SCANS)), runs(spark, *RUNS)).count() == 0
    every = [(r["run_id"], r["file_id"]) for r in job.due().collect()]
    assert len(every) == len(set(every)) and set(every) == plain(SCANS, RUNS)


def test_late_commits_fill_gaps(spark, tmp_path):
    job = IncrementalFiles(spark, str(tmp_path / "ledger"))
    rows = [scan(1, 7, "a", "1", 1), scan(3, 7, "c", "1", 1)]
    job.step(spark.createDataFrame(rows, SCAN), runs(spark, RUNS[0]))
    late = job.step(spark.createDataFrame([*rows, scan(2, 7, "b", "1", 1)], SCAN), runs(spark, RUNS[0]))
    assert [(r["file_id"]) for r in late.collect()] == ["b"]
    assert [tuple(r) for r in job.store.read("ledger").collect()] == [(1, 3)]


def test_a_late_row_does_not_repeat_its_run(spark, tmp_path):
    job = IncrementalFiles(spark, str(tmp_path))
    rows = [scan(1, 7, "a", "1", 1), scan(5, 5, "a", "2", 41)]
    assert job.step(spark.createDataFrame(rows, SCAN), runs(spark, RUNS[0], RUNS[2])).count() == 2
    later = [*rows, scan(2, 7, "a", "9", 5), scan(3, 7, "a", "1", 6), scan(6, 5, "b", "1", 42)]
    got = job.step(spark.createDataFrame(later, SCAN), runs(spark, RUNS[0], RUNS[2])).collect()
    assert [(r["run_id"], r["file_id"]) for r in got] == [(5, "b")]
    assert [tuple(r) for r in job.store.read("ledger").orderBy("lo").collect()] == [(1, 3), (5, 6)]


def test_a_late_row_of_an_older_run_sees_what_came_before_it(spark, tmp_path):
    job = IncrementalFiles(spark, str(tmp_path))
    rows = [scan(1, 7, "a", "1", 1), scan(9, 2, "a", "2", 81)]
    job.step(spark.createDataFrame(rows, SCAN), runs(spark, RUNS[0], RUNS[2], RUNS[4]))
    same = job.step(spark.createDataFrame([*rows, scan(4, 5, "a", "1", 41)], SCAN), runs(spark, RUNS[0], RUNS[2], RUNS[4]))
    assert same.count() == 0 and job.store.read("handled").count() == 3


def test_a_step_reads_only_gaps(spark, tmp_path):
    path = str(tmp_path / "scans")
    rows = [scan(i, 7, f"f{i:05}", "1", 1) for i in range(20_000)]
    spark.createDataFrame(rows, SCAN).repartitionByRange(10, "scan_id").sortWithinPartitions("scan_id").write.parquet(path)
    job = IncrementalFiles(spark, str(tmp_path / "job"))
    assert job.step(spark.read.parquet(path), runs(spark, RUNS[0])).count() == 20_000
    spark.createDataFrame([scan(i, 5, f"f{i:05}", "2", 41) for i in range(30_000, 30_007)], SCAN).write.mode("append").parquet(path)
    ledger = job.store.read("ledger")
    pruned = skip_processed(spark.read.parquet(path), "scan_id", ledger)
    assert "PushedFilters" in pruned._jdf.queryExecution().executedPlan().toString() and pruned.count() == 7
    assert gap_rows(spark.read.parquet(path), "scan_id", ledger).count() == 7
    # the new file, and nothing of the old ones, is read
    plan = pruned._jdf.queryExecution().executedPlan()
    pruned._jdf.queryExecution().toRdd().count()
    scanned = [m.value() for m in [plan.collectLeaves().head().metrics().apply("numOutputRows")]]
    assert scanned[0] <= 7
    assert job.step(spark.read.parquet(path), runs(spark, RUNS[0], RUNS[2])).count() == 7


def test_of_two_writers_one_loses(spark, tmp_path):
    a, b = (IncrementalFiles(spark, str(tmp_path)).store for _ in range(2))
    frame = lambda x: spark.createDataFrame([(x,)], "x string")
    with pytest.raises(Conflict):
        with a.commit() as one:
            one.write("t", frame("a"))
            with b.commit() as two:
                two.write("t", frame("b"))
    assert a.current() == 1 and a.read("t").first()[0] == "b"
    with a.commit() as v:
        v.append("t", frame("c"))
        v.write("u", frame("d"))
    assert sorted(r[0] for r in b.read("t").collect()) == ["b", "c"] and b.read("t", 1).count() == 1
    assert a.vacuum(1) == 1 and b.read("t").count() == 2


def test_states_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("cairn.operators.incremental.MERGE_EVERY", 2)
    job = IncrementalFiles(spark, str(tmp_path))
    frame = lambda n: spark.createDataFrame(SCANS[:n], SCAN)
    for n in (2, 5, 8, len(SCANS)):
        job.step(frame(n), runs(spark, *RUNS))
    assert len(job.store.tables()["state"]) == 1
    every = [(r["run_id"], r["file_id"]) for r in job.due().collect()]
    assert len(every) == len(set(every))


def test_empty_tables(spark, tmp_path):
    job = IncrementalFiles(spark, str(tmp_path))
    assert job.step(spark.createDataFrame([], SCAN), spark.createDataFrame([], RUN)).collect() == []
    assert job.store.read("ledger").collect() == []
