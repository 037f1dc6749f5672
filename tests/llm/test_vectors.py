import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import vectors as V

SCHEMA = "record string, vec array<float>, extra string"


def exact(rows, k, least):
    usable = {}
    for name, v, _ in rows:
        if name is not None and v is not None and len(v) == 8 and np.isfinite(v).all() and any(v):
            usable[name] = min(usable.get(name, list(v)), list(v))
    names = sorted(usable)
    m = np.array([usable[n] for n in names], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(m @ m.T, 6)
    out = set()
    for i, a in enumerate(names):
        best = sorted((-cos[i, j], b) for j, b in enumerate(names) if j != i and cos[i, j] >= least)[:k]
        out |= {(a, b) for _, b in best}
    return out


def test_neighbours_equal_brute_force_with_copies_and_dirt(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 8))
    rows = [(f"r{i:02}", [float(x) for x in v], "e") for i, v in enumerate(base)]
    rows += [(f"n{i:02}", [float(x) for x in v + rng.normal(size=8) * 0.02], "e") for i, v in enumerate(base[:8])]
    rows += [(f"c{i:02}", rows[0][1], "e") for i in range(9)]  # a group of copies
    rows += [("dup", rows[1][1], "e")] * 3
    rows += [("nul", None, ""), ("zero", [0.0] * 8, ""), ("nan", [float("nan")] + [1.0] * 7, ""), ("short", [1.0], ""), ("empty", [], ""), (None, rows[0][1], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = V.most_similar(df, 5, 0.93, 8)
    assert {(r["record"], r["neighbour"]) for r in got.collect()} == exact(rows, 5, 0.93)


def test_empty_table(spark):
    assert V.most_similar(spark.createDataFrame([], SCHEMA), 5, 0.93, 8).collect() == []


def test_recall_of_a_small_crowd(spark, monkeypatch):
    monkeypatch.setattr(V, "FULL", 8)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    rows = [(f"r{i:03}", [float(x) for x in centre + rng.normal(size=8) * s], "") for i, s in enumerate([0.3] * 20 + [0.01] * 20)]
    want = exact(rows, 3, 0.9)
    got = {(r["record"], r["neighbour"]) for r in V.most_similar(spark.createDataFrame(rows, SCHEMA), 3, 0.9, 8).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_perturbations_come_in_order_of_success():
    sets = V.perturbation_sets(4, 6)
    assert sets[0] == (0,) and len(set(sets)) == 6
    assert all(7 - p not in s for s in sets for p in s)
    assert V.sketch_limit(1.0) == 0 and V.sketch_limit(0.93) < 24


def test_blocks_of_queries_equal_the_index(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(10, 8))
    rows = [(f"{i}-{j}", [float(x) for x in v + rng.normal(size=8) * 0.03], "") for i, v in enumerate(base) for j in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    exact_rows = {(r["record"], r["neighbour"]) for r in V.brute_force(df, 3, 0.93, 1, 8).collect()}
    assert exact_rows == exact(rows, 3, 0.93)


def clustered(n, spread, seed):
    """A third of the rows in one cluster, the rest apart."""
    rng = np.random.default_rng(seed)
    centre, v = rng.normal(size=64), rng.normal(size=(n, 64))
    centre /= np.linalg.norm(centre)
    jitter = rng.normal(size=(n // 3, 64)) / 8
    v[: n // 3] = centre + jitter * spread
    return [(f"r{i:05}", [float(x) for x in row], "") for i, row in enumerate(v)]


def test_crowded_buckets_are_compared_whole(spark, monkeypatch):
    rows = [(name, v[:64], "") for name, v, _ in clustered(1500, 0.23, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    classes = V.usable(df).select(F.xxhash64("key").alias("id"), "vec", F.col("record").alias("first"))
    everything = {tuple(r) for r in V.candidate_pairs(classes, 10**6, 0.93).collect()}
    monkeypatch.setattr(V, "FULL", 4)
    monkeypatch.setattr(V, "BLOCK", 16)
    crowded = {tuple(r) for r in V.candidate_pairs(classes, 10**6, 0.93).collect()}
    v = {r["id"]: np.array(r["vec"]) / np.linalg.norm(r["vec"]) for r in classes.collect()}
    near = {(a, b) for a, b in everything if v[a] @ v[b] >= 0.930001}
    assert len(near) > 1000 and near <= crowded


def test_nearest_five_of_all_without_a_threshold(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 20)
    monkeypatch.setattr(V, "SLICE", 7)
    rng = np.random.default_rng(5)
    rows = [(f"r{i:03}", [float(x) for x in rng.normal(size=8)], "") for i in range(90)]
    rows += [(f"c{i:03}", rows[0][1], "") for i in range(9)] + [(f"s{i}", [2 * x for x in rows[1][1]], "") for i in range(3)]
    got = V.most_similar(spark.createDataFrame(rows, SCHEMA), 5, None, 8).collect()
    assert {(r["record"], r["neighbour"]) for r in got} == exact(rows, 5, -2)
    assert len(got) == 5 * len(rows)


def test_shape_keeps_success_and_occupancy_at_any_size():
    for n in (10, 20_000, 200_000, 20_000_000, 10**9, 10**11):
        hashes, tables = V.index_shape(n, 0.93)
        assert n * V.same_cell(2**0.5) ** hashes <= V.OCCUPANCY
        assert 1 - (1 - V.table_success(hashes, 0.14**0.5)) ** tables >= V.SUCCESS
        assert tables * (2 + V.PROBES) <= 60 * max(1, n / 10**5) ** 0.3


@pytest.mark.parametrize("size", [20_000, 20_000_000])
def test_planted_pairs_meet_in_a_table(size):
    """Pairs of cosine 0.93 to 0.97, in the index of a table of `size` vectors."""
    rng = np.random.default_rng(7)
    a, shape = rng.normal(size=(3000, 64)), V.index_shape(size, 0.93)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.normal(size=a.shape)
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    for cosine in (0.93, 0.95, 0.97):
        b = cosine * a + np.sqrt(1 - cosine**2) * off
        ka, kb = (V.bucket_keys(x, *shape, V.PROBES) for x in (a, b))
        met = (ka == kb[:, :, :1]).any(axis=(1, 2)) | (kb == ka[:, :, :1]).any(axis=(1, 2))
        assert met.mean() >= 0.9


def test_recall_in_a_crowd_of_thousands(spark, monkeypatch):
    """7,000 of 21,000 vectors in one cluster, nearest ones at cosines of 0.93 to 0.97."""
    monkeypatch.setattr(V, "FULL", 100)
    rows = clustered(21_000, 0.27, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in V.most_similar(df).select("record", "cosine").collect():
        got.setdefault(r[0], []).append(r[1])
    m = np.array([v for _, v, _ in rows[:7000]], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    wanted = found = 0
    for i in range(0, 7000, 20):
        cos = np.round(m[i] @ m.T, 6)
        cos[i] = -1
        best = np.sort(cos[cos >= 0.93])[::-1][:5]
        wanted += len(best)
        found += min(len(best), sum(c >= best[-1] - 2e-6 for c in got.get(rows[i][0], []))) if len(best) else 0
    assert wanted > 500 and found >= 0.9 * wanted
