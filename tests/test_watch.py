import datetime as dt
import io
import json

from cairn.cli import parser, run
from cairn.streaming.watch import ChangeBatch, Watcher, debounced_stream


def test_batches_are_debounced(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    (root / "b.py").write_text("x = 1\n")
    w = Watcher(spark, str(root), str(tmp_path / "state"), debounce=3.0)
    assert w.poll(0.0) is None
    (root / "a.py").write_text("x = 2\n")
    assert w.poll(1.0) is None
    (root / "c.py").write_text("x = 3\n")
    (root / "b.py").unlink()
    assert w.poll(2.0) is None and w.poll(4.0) is None
    assert w.poll(5.5) == ChangeBatch(["a.py"], ["c.py"], ["b.py"])
    assert w.poll(9.0) is None


def test_session_batches_of_a_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
    rows = [("r", "a", "changed", at(0)), ("r", "b", "added", at(2)), ("r", "c", "added", at(20)), ("r", "z", "added", at(59))]
    spark.createDataFrame(rows, "repo string, path string, kind string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, path string, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    q = debounced_stream(stream).writeStream.format("memory").queryName("batches").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["events"], [x["path"] for x in r["changes"]]) for r in spark.table("batches").collect())
    assert (2, ["b", "a"]) in [(n, sorted(p, reverse=True)) for n, p in got] and (1, ["c"]) in got


def test_command_line(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("def unique_marker():\n    return 1\n")

    def call(*args):
        out = io.StringIO()
        run(parser().parse_args([args[0], str(root), *args[1:], "--store", str(tmp_path / "s"), "--primary", "fts"]), spark, out)
        return out.getvalue()

    assert json.loads(call("prepare", "--query", "marker"))["dense"] is False
    assert json.loads(call("search", "unique_marker", "--compact").splitlines()[0])["path"] == "a.py"
    assert json.loads(call("chunks").splitlines()[0])["summary_source"] == "empty"
    assert json.loads(call("read", "a.py"))["total_symbols"] == 1
