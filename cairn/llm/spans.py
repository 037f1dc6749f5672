"""Long exact spans shared between documents: a count-min prefilter, then exact grouping of what may be repeated.

Two texts that share `SPAN` characters share, inside that stretch, the least-hash window of `SEED` characters among its
`SPAN - SEED + 1` ones. One pass over the texts writes these seeds, about one for eighty characters, with the hashes of
the `SPAN`-character windows that begin and that end with the seed. Then

1. every partition enters its seeds into a count-min sketch, a text each of its seeds once; the partial sketches are
   merged (a counter stops at two), which can only overestimate, so an estimate of one is no repetition. The sketch is as
   wide as the seeds are many (`sketch_width`): at most one once-only seed in twenty passes, at any size;
2. a second pass over the seeds keeps those that are estimated in two texts and groups them exactly;
3. a seed repeated in several texts whose two windows are not may still lie inside a shared stretch: for those seeds the
   `STEP`-spaced windows of `SPAN - STEP` characters around them are grouped first, one of which every shared stretch
   holds, and only around repeated ones all windows of `SPAN` characters;
4. what is left is grouped again by a second, independent hash of 128 bits of the characters themselves.

The sketch is cut into ranges of the hash. Up to `BROADCAST_LOG` it is sent to all executors (64 MB at most); beyond
that each range stays where it was merged and the seeds of the range come to it, in blocks of bounded size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.hashing import code_points, mix, text_prefix, window_hash, window_minima
from cairn.session import broadcast_if_small, checkpoint, table

SPAN, SEED, STEP = 320, 160, 20
#: Rows of the sketch, counters of a row for each seed (at least), and of a range (2^RANGE_LOG).
DEPTH, SPARE, RANGE_LOG = 2, 4, 18
#: The widest row (2^BROADCAST_LOG counters) that is broadcast, rows of a block beyond, and hashes handled at once.
BROADCAST_LOG, BLOCK, HELD = 28, 1 << 19, 1 << 20


def text_seeds(codes: np.ndarray, span: int = SPAN, seed: int = SEED):
    """(prefix, positions, hashes) of a text's seeds; none for texts shorter than `span`."""
    prefix = text_prefix(codes)
    if len(codes) < span:
        return prefix, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_hash(prefix, np.arange(len(codes) - seed + 1), seed)
    at = window_minima(h, span - seed + 1)
    return prefix, at, h[at]


def sketch_width(seeds: int) -> int:
    """The binary logarithm of the counters of a row: so many that a row is filled to a quarter at most, and a once-only
    seed meets another one in all rows with a probability of at most (1 - exp(-1/4))^2 = 0.049."""
    return max(RANGE_LOG, int(np.ceil(np.log2(max(1, SPARE * seeds)))))


def _range(h: np.ndarray, log_width: int) -> np.ndarray:
    bits = log_width - RANGE_LOG
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _counters(h: np.ndarray) -> np.ndarray:
    """(DEPTH, n) counters of each hash inside its range."""
    h = mix(h)  # independent of the range, which is in the upper bits
    mask = np.uint64((1 << RANGE_LOG) - 1)
    return np.stack([((h >> np.uint64(RANGE_LOG * i)) & mask) + np.uint64(i << RANGE_LOG) for i in range(DEPTH)]).astype(np.uint32)


_TWICE = np.uint32(1 << 31)


def _partial_sketches(log_width: int):
    """Sketches of up to `HELD` seeds as (range, cells): the counters that are not 0, with the upper bit where they are 2."""

    def sketch(ids, seeds):
        order = np.lexsort((ids, seeds))
        ids, seeds = ids[order], seeds[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (seeds[1:] != seeds[:-1])
        h = seeds[new]
        where = (np.tile(_range(h, log_width), DEPTH) << (RANGE_LOG + 2)) + _counters(h).ravel().astype(np.int64)
        where, n = np.unique(where, return_counts=True)
        cells = (where & ((1 << (RANGE_LOG + 2)) - 1)).astype(np.uint32) | np.where(n > 1, _TWICE, np.uint32(0))
        number = where >> (RANGE_LOG + 2)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        bits = [x.tobytes() for x in np.split(cells, first[1:])] if len(first) else []
        return pa.RecordBatch.from_arrays([pa.array(number[first], pa.int64()), pa.array(bits, pa.binary())], ["range", "cells"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows >= HELD:
                yield sketch(*(np.concatenate(x) for x in zip(*held)))
                held, rows = [], 0
        if rows:
            yield sketch(*(np.concatenate(x) for x in zip(*held)))

    return run


def _merge(key, rows):
    """The bits of a range's counters that stand at two or more."""
    cells = np.concatenate([np.frombuffer(b, np.uint32) for b in rows.column("cells").to_pylist()])
    where, n = np.unique(cells & ~_TWICE, return_counts=True)
    bits = np.zeros(DEPTH << RANGE_LOG, bool)
    bits[where[n > 1]] = True
    bits[cells[cells >= _TWICE] & ~_TWICE] = True
    packed = zlib.compress(np.packbits(bits).tobytes(), 1)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([packed], pa.binary())], ["range", "bits"])


def sketch_bits(seeds: DataFrame, log_width: int) -> DataFrame:
    """(range, bits): the merged sketch of (id, seed); ranges without a repeated counter have no row."""
    parts = seeds.select("id", "seed").mapInArrow(_partial_sketches(log_width), "range long, cells binary")
    return parts.groupBy("range").applyInArrow(_merge, "range long, bits binary")


def _passes(h: np.ndarray, place: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes are estimated at two or more; `place` is the first byte of each one's range in `bits`."""
    keep = np.ones(len(h), bool)
    for cells in _counters(h):
        cells = cells.astype(np.int64)
        keep &= (bits[place + (cells >> 3)] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
    return keep


_RANGE_BYTES = (DEPTH << RANGE_LOG) // 8


def _kept_by_broadcast(seeds: DataFrame, log_width: int) -> DataFrame:
    bits = np.zeros((1 << (log_width - RANGE_LOG), _RANGE_BYTES), np.uint8)
    for row in sketch_bits(seeds, log_width).toLocalIterator():
        bits[row["range"]] = np.frombuffer(zlib.decompress(bytes(row["bits"])), np.uint8)
    shared = seeds.sparkSession.sparkContext.broadcast(bits.ravel())

    def run(batches):
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(_passes(h, _range(h, log_width) * _RANGE_BYTES, shared.value)))

    return seeds.mapInArrow(run, seeds.schema)


def _kept_by_range(seeds: DataFrame, log_width: int) -> DataFrame:
    bits = log_width - RANGE_LOG
    number = F.shiftrightunsigned("seed", 64 - bits) if bits else F.lit(0).cast("long")
    seeds = seeds.withColumn("range", number)
    sizes = seeds.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sketch = sketch_bits(seeds, log_width).join(sizes, "range")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    # a seed in a third of all texts fills many blocks of its range, each with a copy of the range's 64 KB
    spread = seeds.join(sizes, "range").withColumn("block", F.pmod(F.xxhash64("id", "pos"), F.col("blocks")).cast("int"))
    columns = [f.name for f in seeds.schema if f.name != "range"]

    def run(rows: pa.Table, sketches: pa.Table) -> pa.Table:
        rows = rows.select(columns)
        if not sketches.num_rows:
            return rows.slice(0, 0)
        packed = np.frombuffer(zlib.decompress(sketches.column("bits")[0].as_py()), np.uint8)
        h = rows.column("seed").to_numpy().view(np.uint64)
        return rows.filter(pa.array(_passes(h, np.zeros(len(h), np.int64), packed)))

    left = spread.select("range", "block", *columns).groupBy("range", "block")
    right = sketch.select("range", every, "bits").groupBy("range", "block")
    return left.cogroup(right).applyInArrow(run, seeds.drop("range").schema)


def maybe_repeated(seeds: DataFrame) -> DataFrame:
    """The rows of `seeds` (id, pos, seed, ...), already written, whose seed the sketch estimates in two texts or more."""
    log_width = sketch_width(seeds.count())
    return (_kept_by_broadcast if log_width <= BROADCAST_LOG else _kept_by_range)(seeds, log_width)


def _ids(column: pa.Array, sizes: list[int]) -> np.ndarray:
    return np.repeat(column.to_numpy(zero_copy_only=False), sizes)


def _joined(parts, dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _seed_rows(batches):
    for batch in batches:
        cols = [[] for _ in range(6)]
        for text in batch.column(1).to_pylist():
            codes = code_points(text)
            prefix, at, h = text_seeds(codes)
            starts, ends = at, at + SEED - SPAN
            has_head, has_tail = starts + SPAN <= len(codes), ends >= 0
            head, tail = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            head[has_head] = window_hash(prefix, starts[has_head], SPAN)
            tail[has_tail] = window_hash(prefix, ends[has_tail], SPAN)
            for c, v in zip(cols, (at, h, head, tail, ~has_head, ~has_tail)):
                c.append(v)
        ids = _ids(batch.column(0), [len(x) for x in cols[0]])
        at, h, head, tail, no_head, no_tail = (_joined(c, np.int64) for c in cols)
        as_long = lambda x, mask=None: pa.array(x.astype(np.uint64).view(np.int64), mask=mask)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(at, pa.int32()), as_long(h), as_long(head, no_head.astype(bool)), as_long(tail, no_tail.astype(bool))],
            ["id", "pos", "seed", "head", "tail"],
        )


def seed_rows(texts: DataFrame) -> DataFrame:
    """(id, pos, seed, head, tail): the seeds of every text; head and tail are the hashes of the windows that begin and
    that end with the seed (null where the text is too short)."""
    return texts.mapInArrow(_seed_rows, "id long, pos int, seed long, head long, tail long")


def _of_two(rows: DataFrame, *key: str) -> DataFrame:
    """The values of `key` that two different ids have: min and max are combined before the shuffle, so a value in a
    third of all texts costs one row for each map task."""
    return rows.groupBy(*key).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter(F.col("lo") < F.col("hi")).select(*key)


def _places(places: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, positions, text) of the texts that have places (id, pos); an array is bounded by its text's length."""
    sets = places.groupBy("id").agg(F.collect_set("pos").alias("positions"))
    return texts.join(broadcast_if_small(sets), "id").select("id", "positions", "text")


def _windows(width: int, offsets: range, strong: bool = False):
    """For every place the windows of `width` characters that begin at it or at one of `offsets` from it."""

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for doc, positions, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codes = code_points(text)
                at = np.unique(np.add.outer(np.array(positions, np.int64), np.array(offsets, np.int64)))
                at = at[(at >= 0) & (at + width <= len(codes))]
                if strong:
                    window = [xxhash.xxh3_128_digest(codes[p : p + width].tobytes()) for p in at.tolist()]
                else:
                    window = window_hash(text_prefix(codes), at, width).view(np.int64)
                out[0].append(np.full(len(at), doc, np.int64)), out[1].append(at), out[2].append(window)
            ids, at = (_joined(x, np.int64) for x in out[:2])
            window = pa.array([w for x in out[2] for w in x], pa.binary()) if strong else pa.array(_joined(out[2], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at, pa.int32()), window], ["id", "pos", "window"])

    return run


def _shared(places: DataFrame, texts: DataFrame, width: int, offsets: range) -> DataFrame:
    """(id, pos): the windows of `width` characters around the places (id, pos) that two texts share."""
    around = checkpoint(_places(places, texts).mapInArrow(_windows(width, offsets), "id long, pos int, window long"))
    return around.join(_of_two(around, "window"), "window", "left_semi").select("id", "pos")


def _verified(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """The windows (id, pos) of `SPAN` characters whose characters have an equal hash of 128 bits in another text."""
    strong = checkpoint(_places(windows, texts).mapInArrow(_windows(SPAN, range(1), True), "id long, pos int, window binary"))
    return strong.join(_of_two(strong, "window"), "window", "left_semi").select("id", "pos")


def _texts(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return documents.filter(F.col(key).isNotNull() & (F.length("text") >= SPAN)).select(F.col(key).cast("long").alias("id"), "text")


def _seeds_and_windows(texts: DataFrame):
    """(seeds repeated in two texts, windows at them that two texts share)."""
    seeds = checkpoint(maybe_repeated(checkpoint(seed_rows(texts))))
    repeated = checkpoint(seeds.join(_of_two(seeds, "seed"), "seed", "left_semi"))
    ends = F.explode(F.array(F.struct(F.col("pos"), F.col("head").alias("window")), F.struct((F.col("pos") + SEED - SPAN).alias("pos"), F.col("tail").alias("window"))))
    windows = repeated.select("id", ends.alias("w")).select("id", "w.pos", "w.window").filter("window IS NOT NULL")
    shared = windows.join(_of_two(windows, "window"), "window", "left_semi").select("id", "pos")
    return repeated, checkpoint(_verified(shared, texts))


def _expanded(texts: DataFrame, repeated: DataFrame, open_seeds: DataFrame) -> DataFrame:
    """(id, pos): shared windows among all those around the rows of `repeated` whose seed is in `open_seeds`.

    A shared window that begins d characters before its seed holds the whole window of `SPAN - STEP` characters that
    begins STEP * floor(d / STEP) before it, so only around shared ones of those all windows are looked at."""
    todo = repeated.join(open_seeds.select("seed").distinct(), "seed", "left_semi").select("id", "pos")
    likely = checkpoint(_shared(todo, texts, SPAN - STEP, range(SEED - SPAN, 1, STEP)))
    return _verified(_shared(likely, texts, SPAN, range(1 - STEP, 1)), texts)


def documents_sharing(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id): texts that have at least `SPAN` consecutive characters which occur verbatim in the text of another id.

    Null and shorter texts have none; repeated rows of one id are one text, so they do not count as another.
    """
    texts = _texts(documents, key)
    repeated, windows = _seeds_and_windows(texts)
    sure = windows.select("id").distinct()
    open_seeds = repeated.join(sure, "id", "left_anti")
    return sure.unionByName(_expanded(texts, repeated, open_seeds).select("id")).distinct()


def _covered(windows: DataFrame) -> DataFrame:
    """(id, lo, hi): disjoint stretches [lo, hi) covered by windows (id, pos); a partition holds one text's windows."""
    w = Window.partitionBy("id").orderBy("pos")
    return (
        windows.distinct()
        .withColumn("new", F.coalesce(F.col("pos") - F.lag("pos").over(w) > SPAN, F.lit(True)))
        .withColumn("grp", F.sum(F.col("new").cast("int")).over(w))
        .groupBy("id", "grp")
        .agg(F.min("pos").alias("lo"), (F.max("pos") + SPAN).alias("hi"))
        .select("id", "lo", "hi")
    )


def shared_spans(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, lo, hi): every maximal stretch [lo, hi) of a text that is covered by windows of `SPAN` characters which
    occur in another text too; character positions from 0."""
    texts = _texts(documents, key)
    repeated, windows = _seeds_and_windows(texts)
    cover = _covered(windows)
    # a seed is open unless all windows around it lie in a stretch that is covered already
    inside = repeated.join(cover, "id").filter((F.col("lo") <= F.col("pos") + SEED - SPAN) & (F.col("pos") + SPAN <= F.col("hi")))
    open_seeds = repeated.join(inside.select("id", "pos").distinct(), ["id", "pos"], "left_anti")
    return _covered(windows.unionByName(_expanded(texts, repeated, open_seeds)))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_sharing(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, spans, shared_chars, share): how much of each text with a shared span occurs elsewhere."""
    docs = table(spark, sf_dir, "documents")
    spans = shared_spans(docs).groupBy("id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("shared_chars"))
    sizes = docs.filter("text IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.length("text")).alias("size"))
    return spans.join(sizes, "id").select(
        F.col("id").alias("doc_id"), "spans", "shared_chars", F.round(F.col("shared_chars") / F.col("size"), 6).alias("share")
    )


#: All windows of `SPAN` characters, by brute force; equal ones are grouped by the characters themselves.
SQL = {
    "p10_found": f"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= {SPAN}),
  w AS (SELECT doc_id, md5_number(substring(text, i, {SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {SPAN - 2})) AS i FROM d)),
  g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
SELECT DISTINCT doc_id FROM w WHERE h IN (FROM g)"""
}
QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares}
