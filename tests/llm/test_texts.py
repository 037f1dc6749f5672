"""Leakage, shared spans, chunk splitting, packing and fusion against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import chunking, fusion, leakage, packing, spans
from cairn.llm.hashing import all_windows, code_points, text_prefix, window_minima


def test_window_minima_cover_every_window():
    random.seed(1)
    for text in ["a" * 300, "ab" * 200, "".join(random.choice("ab") for _ in range(500)), "short"]:
        h = all_windows(text_prefix(code_points(text)), 5)
        at = set(window_minima(h, 20).tolist())
        for s in range(len(h) - 19):
            assert any(p in at and h[p] == h[s : s + 20].min() for p in range(s, s + 20))


# ---------------------------------------------------------------- p9
def test_leaks_equal_brute_force(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(random.choice([5, 12, 13, 60])))) for i in range(12)] + [(99, None), (100, "")]
    docs = []
    for d in range(40):
        ws = say(80)
        if d % 3 == 0:
            source = items[d % 12][1].split()
            cut = source[: random.choice([11, 12, 30])]
            ws[20:20] = [w.upper() for w in cut]
        docs.append((d, " ,".join(ws) if d % 2 else "_".join(ws), "x"))
    docs += [(50, None, ""), (51, "", ""), (52, items[3][1], ""), (52, items[3][1], "")]
    grams = lambda t: {tuple(leakage.words(t)[i : i + 12]) for i in range(len(leakage.words(t)) - 11)} if t else set()
    want = {(d, i) for d, t, _ in docs for i, s in items if grams(t) & grams(s)}
    dd = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    ii = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_items(dd, ii).collect()} == want and want
    assert leakage.leaked_items(dd, ii.limit(0)).collect() == [] and leakage.leaked_items(dd.limit(0), ii).collect() == []


def test_containment_search_equals_brute_force(spark):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, say(random.choice([5, 9, 40, 63, 159]))) for i in range(25)] + [(30, None), (31, ""), (32, "four words are few"), (3, None)]
    items += [items[4], (40, items[5][1].upper().replace(" ", "_; "))]
    docs = []
    for d in range(150):
        ws = items[d % 25][1].split()
        cut = ws[: max(1, int(len(ws) * random.choice([0.5, 0.7, 0.9, 1.0])))]
        docs.append((d, " ".join([say(random.choice([0, 3, 60, 900])), *cut, say(random.choice([0, 5, 300]))])))
    docs += [(200, None), (201, ""), (202, items[6][1]), (203, items[6][1] + " " + say(6000)), docs[0], (None, items[0][1])]
    want = {}
    for d, t in docs:
        for i, x in items:
            if d is not None and t and x and (c := leakage.containment(x, t)) >= 0.8:
                want[d, i] = round(c, 6)
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7))
    ii = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = {(r[0], r[1]): r[2] for r in leakage.contained_items(dd, ii).collect()}
    assert got.items() <= want.items() and len(got) >= 0.97 * len(want) > 50
    assert leakage.contained_items(dd, ii.limit(0)).collect() == [] and leakage.contained_items(dd.limit(0), ii).collect() == []


# ---------------------------------------------------------------- p10
def test_shared_spans_equal_brute_force(spark, monkeypatch):
    random.seed(4)
    say = lambda n: "".join(random.choice("abcdefgh é\n😀") for _ in range(n))
    parts = {n: say(n) for n in (319, 320, 321, 400, 700)}
    docs = [(i, say(random.randrange(50, 600)) + parts[n] + say(random.randrange(0, 500))) for i, n in enumerate([319, 319, 320, 320, 321, 321, 400, 400, 700, 700, 700])]
    docs += [(20, say(900)), (21, "x" * 1000), (22, "x" * 400), (23, docs[0][1]), (24, None), (25, ""), (26, say(319)), (27, docs[7][1]), (27, docs[7][1])]
    texts = {i: t for i, t in docs if t}
    where = {}
    for i, t in texts.items():
        for p in range(len(t) - 319):
            where.setdefault(t[p : p + 320], set()).add(i)
    cover = {}
    for i, t in texts.items():
        on = np.zeros(len(t), bool)
        for p in range(len(t) - 319):
            if len(where[t[p : p + 320]]) > 1:
                on[p : p + 320] = True
        if on.any():
            cover[i] = int(on.sum())
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash"))
    assert {r[0] for r in spans.documents_sharing(df).collect()} == set(cover)
    got = {}
    for r in spans.shared_spans(df).collect():
        got[r["id"]] = got.get(r["id"], 0) + r["hi"] - r["lo"]
    assert got == cover
    assert spans.documents_sharing(df.limit(0)).collect() == []
    monkeypatch.setattr(spans, "BROADCAST_LOG", 0)
    monkeypatch.setattr(spans, "BLOCK", 3)
    assert {r[0] for r in spans.documents_sharing(df).collect()} == set(cover)


@pytest.mark.parametrize("seeds", [3_700_000, 37_000_000, 370_000_000, 10**12])
def test_sketch_filters_at_any_size(seeds):
    """The seeds of one range of the sketch, which hold 1/ranges of all, of three partitions; some are in two texts."""
    rng, log_width = np.random.default_rng(5), spans.sketch_width(seeds)
    bits = log_width - spans.RANGE_LOG
    some = seeds >> bits
    h = (rng.integers(0, 1 << (64 - bits), some, dtype=np.uint64)) | np.uint64(3 << (64 - bits))
    twice = h[:500]
    parts = [(np.arange(len(x)), x) for x in (h[: some // 2], np.concatenate([h[some // 2 :], h[some // 2 :]]))]
    parts[1] = (np.tile(np.arange(some - some // 2), 2) + some, parts[1][1])  # a text that has its seeds twice
    parts.append((np.full(500, -1), twice))
    rows = []
    for ids, seed in parts:
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seed.view(np.int64))], ["id", "seed"])
        rows += [r for b in spans._partial_sketches(log_width)([batch]) for r in b.to_pylist()]
    assert {r["range"] for r in rows} == {3}
    merged = spans._merge([pa.scalar(3)], pa.Table.from_pylist(rows))
    packed = np.frombuffer(spans.zlib.decompress(merged.column("bits")[0].as_py()), np.uint8)
    passed = spans._passes(h, np.zeros(len(h), np.int64), packed)
    assert passed[:500].all()
    assert passed[500:].mean() < 0.05


# ---------------------------------------------------------------- p4
def test_pieces_cover_overlap_and_fit():
    random.seed(5)
    for n in (0, 1, 60, 61, 65, 130, 1000):
        lines = [random.choice(["x = 1", "", "foo(", "  a,", ")", "if y:"]) + str(i % 7) for i in range(n)]
        cuts = chunking.cut_lines(lines)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(0 < b - a <= 60 for a, b in cuts if n)
        assert all(b[0] == a[1] - 5 for a, b in zip(cuts, cuts[1:]))


def test_cuts_are_natural_and_local():
    lines = [f"call_{i}(value)" if i % 9 else "" for i in range(400)]
    cuts = chunking.cut_lines(lines)
    assert all(chunking.statement_borders(lines)[b] for _, b in cuts[:-1])
    edited = [*lines[:10], "new line here", *lines[10:]]
    moved = {(a - 1, b - 1) for a, b in chunking.cut_lines(edited)}
    assert len(set(cuts) - moved) <= 3  # an edit changes the neighbouring pieces only


def test_chunk_frame(spark):
    long = "\r\n".join(f"line {i}" for i in range(100))
    rows = [
        ("a", " r\\f.py", 1, 2, long, None), ("b", "r/f.py", 3, 80, None, None), ("c", "r/none.py", 1, 70, None, None), ("d", None, None, None, None, None), ("e", "r/f.py", 1, 60, None, None),
        ("f", "r/f.py", 9, 1, "x\n" * 60, None), ("g", "r/f.py", 1, 1, "x\n" * 60 + "y", None), ("g", "r/f.py", 1, 1, "x\n" * 60 + "y", None), (None, "r/f.py", 1, 99, None, None), ("h", "r/f.py", 1, 99, "", None),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, start_line int, end_line int, code string, written_at timestamp").withColumn("text", F.lit("clash"))
    docs = spark.createDataFrame([("source_file", "r//f.py", long), ("readme", "r/f.py", "no")], "kind string, file_id string, text string")
    got = chunking.split_chunks(chunks, docs).collect()
    assert sorted({r["chunk_id"] for r in got}) == ["a", "b", "c", "g"]
    b = sorted((r["piece"], r["first_line"], r["last_line"], r["text"]) for r in got if r["chunk_id"] == "b")
    assert b[0][3].startswith("line 2\n") and b[-1][2] == 78
    assert chunking.split_chunks(chunks.limit(0), docs.limit(0)).collect() == []


# ---------------------------------------------------------------- p8
def test_packing_uses_every_item_once_and_fits(spark):
    random.seed(6)
    rows = [(i, random.choice([0, 1, 3, 100, 555, 2047, 2048, 2049, 5000, None]) if i % 2 else random.randrange(1, 900)) for i in range(600)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long")).collect()
    size, parts, used = {i: n or 0 for i, n in rows}, {}, {}
    for r in packed:
        parts.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
    assert all(sum(t for _, t in parts[i]) == n and (n <= 2048) == (len(parts[i]) == 1) for i, n in size.items())
    assert max(used.values()) <= 2048
    assert len(used) <= math.ceil(sum(size.values()) / 2048 * 1.02) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long")).collect() == []


@pytest.mark.parametrize("capacity", [1, 7, 100, 511, 513, 2050, 2051, 4099])
def test_packing_takes_any_capacity(spark, capacity):
    random.seed(capacity)
    rows = [(i, random.randrange(0, capacity + 1)) for i in range(150)] + [(900, capacity), (901, capacity - 1), (902, capacity + 1), (903, 3 * capacity)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    used, placed = {}, 0
    for r in packing.pack(df, capacity).collect():
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
        placed += r["tokens"]
    pieces, volume, bound = packing.lower_bounds(df, capacity, 20)
    assert placed == sum(n for _, n in rows) and max(used.values()) <= capacity
    assert volume == math.ceil(placed / capacity) and volume - 1 <= bound + 1e-6 <= len(used) + 1e-5 and pieces >= len(used)


def test_the_bound_of_halves_exceeds_the_volume():
    assert packing.covering_lp(np.array([60]), np.array([10]), 100, 5)[1] == 10


def test_histogram_solution_is_close_to_the_bound():
    sizes, need = np.array([3, 5, 7, 11, 64, 100]), np.array([400, 300, 200, 100, 50, 37])
    plan = packing.pack_histogram(sizes, need, 128)
    assert (sum(p * k for p, k in plan) == need).all() and all((p * sizes).sum() <= 128 for p, _ in plan)
    assert sum(k for _, k in plan) <= math.ceil((sizes * need).sum() / 128 * 1.1)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r[0]: r[1] for r in packing.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# ---------------------------------------------------------------- p5
EVIDENCE = "query_id long, record_id string, fts_rank float, dense_rank int, exact_score float, graph_score float, top string"


def test_dominant_and_dirty_candidates(spark):
    nan = float("nan")
    rows = [
        (1, "a", -9.0, 1, 5.0, 5.0, ""), (1, "b", -1.0, 2, 900.0, 0.0, ""), (1, "c", None, None, nan, None, ""),
        (2, "a", -9.0, 1, 5.0, 5.0, ""), (2, "b", -9.0, 2, 5.0, nan, ""), (2, "b", -9.0, 2, 5.0, nan, ""),
        (3, "a", -9.0, 1, 5.0, 5.0, ""), (3, "b", -9.0, 1, 5.0, 5.0, ""), (4, "only", None, None, None, None, ""), (None, "x", 1.0, 1, 1.0, 1.0, ""), (5, None, 1.0, 1, 1.0, 1.0, ""),
    ]
    df = spark.createDataFrame(rows, EVIDENCE)
    assert sorted(tuple(r) for r in fusion.dominant_candidates(df).collect()) == [(2, "a"), (4, "only")]
    ranks = sorted((r["query_id"], r["rank"], r["record_id"]) for r in fusion.fused_ranking(df).collect())
    assert [r for r in ranks if r[0] == 2] == [(2, 1, "a"), (2, 2, "b")]
    assert [r for r in ranks if r[0] == 3] == [(3, 1, "a"), (3, 2, "b")]
    assert fusion.fused_ranking(df.limit(0)).collect() == []


def test_normal_scores_match_the_distribution(spark):
    from statistics import NormalDist

    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.999999]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(fusion.inverse_normal(F.col("p")))
    got = [r[0] for r in df.collect()]
    assert all(math.isclose(g, NormalDist().inv_cdf(p), abs_tol=1e-9) for g, p in zip(got, ps)) and got[-2:] == [None, None]


def test_ndcg(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, record_id string, rank long")
    labels = spark.createDataFrame([(1, "a", 0), (1, "c", 3), (1, "c", 3), (2, "a", 0)], "query_id long, record_id string, grade int")
    assert [(r[0], r[2]) for r in fusion.ndcg(ranking, labels).collect()] == [(1, round(1 / math.log2(3), 6))]


def test_the_fused_ranking_is_not_ruled_by_a_range(spark):
    """One score with an outlier of a million times the others' range; labels follow the mean rank of all four."""
    random.seed(3)
    rows, labels = [], []
    for i in range(40):
        a, b, c, d = (random.random() for _ in range(4))
        rows.append((1, f"r{i:02}", -a, int(1000 * (1 - b)), c, d * (1e9 if i == 7 else 1.0)))
        labels.append((1, f"r{i:02}", int(min(3, (a + b + c + d)))))
    df = spark.createDataFrame(rows, "query_id long, record_id string, fts_rank double, dense_rank int, exact_score double, graph_score double")
    got = {r["ranking"]: r["ndcg"] for r in fusion.compared(df, spark.createDataFrame(labels, "query_id long, record_id string, grade int")).collect()}
    assert set(got) == {"fused", "min_max", *fusion.EVIDENCE} and got["fused"] >= max(got[c] for c in fusion.EVIDENCE) and got["fused"] >= got["min_max"]
    ranks = {r["record_id"]: r["rank"] for r in fusion.min_max_ranking(df).collect()}
    assert sorted(ranks.values()) == list(range(1, 41)) and fusion.min_max_ranking(df.limit(0)).collect() == []
