"""The most similar vectors for every vector, by multiprobe p-stable hashing and exact reranking.

Equal vectors are one class: one representative is hashed, members are put back at the end. Each table hashes a unit
vector by projections h_i = floor((a_i . v + b_i) / WIDTH). A vector is stored in its own bucket and looks into that and
`PROBES` perturbed ones, in the order of the estimated success of their perturbations (squared distances to the cell
borders). Pairs that meet in any table carry a 64-bit sign sketch each; pairs whose sketches are too far apart for
`min_cosine` are dropped before the vectors are joined and the exact cosine is taken.

How many hashes and tables there are follows from the number of vectors (`index_shape`): so many hashes that a bucket
holds `OCCUPANCY` vectors of no relation, whatever their number, and so many tables that a pair of cosine `min_cosine`
meets in one of them with a probability of `SUCCESS`. So neither the recall nor the pairs for each vector depend on the
size; the rows for each vector grow as about its power of 0.22.

A bucket of more than `FULL` vectors is compared by matrix products instead of pair by pair: its members and all vectors
that look into it are split into blocks of `BLOCK`, and each vector keeps its nearest ones of every block. In the other
buckets a vector meets at most `FULL` others for each probe; a bucket that very many look into is one side of a join
whose other side adaptive execution splits.
"""

from __future__ import annotations

import heapq
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.hashing import mix
from cairn.session import broadcast_if_small, checkpoint, table

DIMENSION, NEIGHBOURS, MIN_COSINE = 64, 5, 0.93
PROBES, WIDTH, OCCUPANCY, SUCCESS = 4, 2.0, 8.0, 0.97
#: With few tables the pairs of a cluster, which lie alike in the cells, are all lost or all found: never fewer than these.
LEAST_TABLES = 6
FULL, BLOCK, SLICE, SEED = 400, 4096, 512, 20240229


def perturbation_sets(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The first `probes` sets of perturbations, as places in the ascending order of border distances.

    Scores are the expected squared distances of the j-th nearest of 2*hashes borders; sets are made in the order of
    their sum by shifting or extending the last place. A set never moves one hash both ways.
    """
    m, n = hashes, 2 * hashes
    low = np.arange(1, m + 1)
    score = low * (low + 1) / (4 * (m + 1) * (m + 2))
    high = np.arange(m + 1, n + 1)
    k = n + 1 - high
    score = np.concatenate([score, 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))])
    out, heap = [], [(score[0], (0,))]
    while len(out) < probes and heap:
        s, places = heapq.heappop(heap)
        if not any(n - 1 - p in places for p in places):
            out.append(places)
        last = places[-1]
        if last + 1 < n:
            heapq.heappush(heap, (s - score[last] + score[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last + 1], (*places, last + 1)))
    return out


def same_cell(distance: float, width: float = WIDTH) -> float:
    """The probability that one hash of two vectors at a distance is equal."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - math.sqrt(2 / math.pi) / c * (1 - math.exp(-c * c / 2))


@cache
def table_success(hashes: int, distance: float, probes: int = PROBES, samples: int = 4000) -> float:
    """The share of pairs at `distance` of which one looks into the other's bucket of one table, by simulation."""
    place_of = {frozenset(s): i for i, s in enumerate(perturbation_sets(hashes, probes))}
    rng = np.random.default_rng([SEED, hashes])
    x = rng.uniform(size=(samples, hashes))
    y = x + rng.normal(size=x.shape) * (distance / WIDTH)
    moved = np.floor(y).astype(int)
    found = ~moved.any(axis=1)
    for below, to in ((x, moved), (y - moved, -moved)):
        order = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1)
        place = np.argsort(order, axis=1)
        for i in np.flatnonzero(~found & (np.abs(to) <= 1).all(axis=1)):
            found[i] = frozenset(int(place[i, j if to[i, j] < 0 else j + hashes]) for j in np.flatnonzero(to[i])) in place_of
    return float(found.mean())


def index_shape(vectors: int, min_cosine: float) -> tuple[int, int]:
    """(hashes, tables) for so many vectors: see the module's text. Vectors of no relation are at a distance of sqrt(2)."""
    hashes = max(8, math.ceil(math.log(max(1.0, vectors / OCCUPANCY)) / -math.log(same_cell(math.sqrt(2)))))
    success = table_success(hashes, math.sqrt(max(1e-6, 2 - 2 * min_cosine)))
    return hashes, max(LEAST_TABLES, math.ceil(math.log(1 - SUCCESS) / math.log(1 - min(max(success, 1e-6), 0.999))))


def bucket_keys(v: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket keys of unit vectors; the first of each is the vector's own bucket."""
    sets = perturbation_sets(hashes, probes) if probes else []
    out = np.empty((len(v), tables, 1 + probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([SEED, hashes, t])
        a, b, weights = rng.normal(size=(v.shape[1], hashes)), rng.uniform(0, WIDTH, hashes), rng.integers(1, 1 << 62, hashes)
        x = (v @ a + b) / WIDTH
        cell = np.floor(x)
        own = (cell.astype(np.int64) * weights).sum(axis=1)
        keys = [own]
        if probes:
            below = x - cell
            order = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1)
            change = np.concatenate([-weights, weights])[order]
            keys += [own + change[:, list(s)].sum(axis=1) for s in sets]
        salted = np.stack(keys, axis=1).view(np.uint64) + np.uint64(t)
        out[:, t, :] = mix(salted).view(np.int64)
    return out


def sketches(v: np.ndarray) -> np.ndarray:
    """64 signs of random projections of each vector, as one integer."""
    signs = v @ np.random.default_rng([SEED, 99]).normal(size=(v.shape[1], 64)) > 0
    return np.packbits(signs, axis=1).view(np.int64).ravel()


def sketch_limit(min_cosine: float) -> int:
    """Differing signs up to which a pair is kept: the expected number at `min_cosine` plus 3.5 deviations, which 2 pairs in 10,000 at that cosine exceed."""
    p = float(np.arccos(np.clip(min_cosine, -1, 1)) / np.pi)
    return min(64, int(np.ceil(64 * p + 3.5 * np.sqrt(64 * p * (1 - p)))))


def _unit(values: pa.Array, rows: int) -> np.ndarray:
    v = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten(), len(column))


def _hashed(shape: tuple[int, int], probes: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            keys = bucket_keys(v, *shape, probes)
            per = keys.shape[1] * keys.shape[2]
            ids = np.repeat(batch.column(0).to_numpy(), per)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(ids), pa.array(np.repeat(sketches(v), per))], ["bucket", "id", "sketch"]
            )

    return run


def _exact(a, b, r, c) -> np.ndarray:
    """Cosines of the rows `r` of `a` with the rows `c` of `b`, rounded to six places."""
    out = [(a[r[i : i + 65536]] * b[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(r), 65536)]
    return np.round(np.concatenate(out), 6) if out else np.empty(0)


def nearest(a, ids, b, others, firsts, k: int, least: float, known=None):
    """(row, cosine, first, other): for every row of `a` the k nearest rows of `b` of another id and of cosine `least` or
    more, ties by `firsts`; `known` is the result over earlier rows of `b` and is merged in.

    Products in single precision choose what is taken exactly: all within their error of the k-th best.
    """
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    floor = np.full(len(a), least)
    if known is not None:
        full = np.bincount(known[0], minlength=len(a)) >= k
        worst = np.full(len(a), np.inf)
        np.minimum.at(worst, known[0], known[1])
        floor = np.where(full, np.maximum(floor, worst), floor)
    rows, columns = [], []
    for s in range(0, len(a), SLICE):
        cos, low = fa[s : s + SLICE] @ fb.T, floor[s : s + SLICE]
        if known is None and len(b) > k + 1:  # one more, as the row itself may be among them
            low = np.maximum(low, np.partition(cos, len(b) - k - 1, axis=1)[:, len(b) - k - 1])
        r, c = np.nonzero(cos >= (low - 1e-5)[:, None])
        other = ids[s + r] != others[c]
        rows.append(s + r[other])
        columns.append(c[other])
    r, c = np.concatenate(rows), np.concatenate(columns)
    cos = _exact(a, b, r, c)
    keep = cos >= least
    r, c, cos = r[keep], c[keep], cos[keep]
    found = (r, cos, firsts[c], others[c])
    if known is not None:
        found = tuple(np.concatenate(x) for x in zip(known, found))
    order = np.lexsort((found[3], found[2], -found[1], found[0]))
    found = tuple(x[order] for x in found)
    start = np.searchsorted(found[0], found[0])
    return tuple(x[np.arange(len(start)) - start < k] for x in found)


def _names(column) -> np.ndarray:
    """Strings as bytes, which sort as in Spark."""
    return np.array([x.encode() for x in column.to_pylist()], "S")


def _block_pairs(k: int, least: float):
    def run(members: pa.Table, probing: pa.Table) -> pa.Table:
        out = [np.empty((0, 2), np.int64)]
        if members.num_rows and probing.num_rows:
            m, p = ((_matrix(x["vec"].combine_chunks()), x["id"].to_numpy(), _names(x["first"])) for x in (members, probing))
            for (a, ids, _), (b, others, firsts) in ((m, p), (p, m)):
                near = nearest(a, ids, b, others, firsts, k, least)
                out.append(np.stack([ids[near[0]], near[3]], axis=1))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    return run


def crowded_pairs(points: DataFrame, entries: DataFrame, probes: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b): for the members `entries` of crowded buckets and all `probes` into them (bucket, id), the k nearest of
    every vector in every block of the other side. Both sides are split by id, so no task has more than a few blocks."""
    blocks = lambda x, n: x.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    sizes = checkpoint(blocks(entries, "m").join(blocks(probes, "p"), "bucket"))
    sizes, place = broadcast_if_small(sizes), lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = entries.select("bucket", "id").join(sizes, "bucket").select("bucket", "id", place("m").alias("i"), every("p").alias("j"))
    probing = probes.select("bucket", "id").join(sizes, "bucket").select("bucket", "id", place("p").alias("j"), every("m").alias("i"))
    grouped = [x.join(points, "id").select("bucket", "i", "j", "id", "vec", "first").groupBy("bucket", "i", "j") for x in (members, probing)]
    return grouped[0].cogroup(grouped[1]).applyInArrow(_block_pairs(k, least), "a long, b long")


def _block_nearest(k: int):
    """The k nearest of each id of the first block in the second ones that follow it, which come one after the other."""

    def run(batches):
        block, state = None, None

        def result():
            row, cosine, _, other = state
            return pa.RecordBatch.from_arrays([pa.array(block[1][row]), pa.array(other), pa.array(cosine)], ["id", "other", "cosine"])

        for batch in batches:
            for n in range(batch.num_rows):
                number, ids, vecs, others, more, firsts = (batch.column(i)[n] for i in range(6))
                if block is None or block[0] != number.as_py():
                    if block is not None:
                        yield result()
                    block, state = (number.as_py(), ids.values.to_numpy(), _unit(vecs.values, len(ids))), None
                b = _unit(more.values, len(others))
                state = nearest(block[2], block[1], b, others.values.to_numpy(), _names(firsts.values), k, -2.0, state)
        if block is not None:
            yield result()

    return run


def all_nearest(points: DataFrame, k: int) -> DataFrame:
    """(id, other, cosine): the k nearest of every one of `points` (id, vec, first), without a threshold: every
    block of vectors against every other as a matrix product. The work grows with the square of the rows; what is
    stored and moved are the blocks, which are read again for each other block, and k rows an id and group of blocks."""
    blocks = max(1, -(-points.count() // BLOCK))
    number = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block")
    packed = points.select(number, "*").repartition(blocks, "block").groupBy("block").agg(F.collect_list(F.struct("id", "vec", "first")).alias("x"))
    packed = checkpoint(packed.select("block", F.col("x.id").alias("ids"), F.flatten("x.vec").alias("vecs"), F.col("x.first").alias("firsts")))
    # 16 blocks at a time are all that a task holds; the left side is the outer loop of the product
    right = packed.select(F.col("ids").alias("others"), F.col("vecs").alias("more"), "firsts").coalesce(-(-blocks // 16))
    each = packed.select("block", "ids", "vecs").crossJoin(right.hint("shuffle_replicate_nl"))
    return each.mapInArrow(_block_nearest(k), "id long, other long, cosine double")


def candidate_pairs(points: DataFrame, k: int, min_cosine: float) -> DataFrame:
    """(a, b) with a < b: pairs of ids of `points` (id, vec, first) that the tables and the sketches propose, once each;
    of crowded buckets those among the k nearest of one of the two."""
    limit, vectors = sketch_limit(min_cosine), points.select("id", "vec")
    shape = index_shape(points.count(), min_cosine)
    entries = vectors.mapInArrow(_hashed(shape, 0), "bucket long, id long, sketch long")
    probes = vectors.mapInArrow(_hashed(shape, PROBES), "bucket long, id long, sketch long")
    hot = checkpoint(entries.groupBy("bucket").count().filter(F.col("count") > FULL).select("bucket"))
    crowded = None
    if not hot.isEmpty():
        marked = broadcast_if_small(hot)
        crowded = crowded_pairs(points, *(x.join(marked, "bucket", "left_semi") for x in (entries, probes)), k, min_cosine)
        entries, probes = (x.join(marked, "bucket", "left_anti") for x in (entries, probes))
    met = entries.alias("e").join(probes.alias("p"), "bucket").filter(
        (F.col("e.id") != F.col("p.id")) & (F.bit_count(F.col("e.sketch").bitwiseXOR(F.col("p.sketch"))) <= limit)
    )
    pairs = met.select(F.least("e.id", "p.id").alias("a"), F.greatest("e.id", "p.id").alias("b"))
    return (pairs if crowded is None else pairs.unionByName(crowded)).distinct()


def _cosines(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        cos = (_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(cos, 6))], ["a", "b", "cosine"])


def usable(df: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(record, vec, key): rows with `dimension` finite numbers, not all zero, and a 128-bit key of the vector."""
    e = F.col("vec")
    return (
        df.filter(F.col("record").isNotNull() & (F.size(e) == dimension))
        .filter(
            ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
        )
        .select("record", "vec", F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec")).alias("key"))
    )


def _index_nearest(points: DataFrame, k: int, min_cosine: float) -> DataFrame:
    """(id, other, cosine): for every id of `points` (id, vec, first) those of `min_cosine` or more that the index finds."""
    pairs = checkpoint(candidate_pairs(points, k, min_cosine))
    involved = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    close = points.select("id", "vec").join(broadcast_if_small(involved), "id", "left_semi")
    left = close.withColumnsRenamed({"id": "a", "vec": "va"})
    right = close.withColumnsRenamed({"id": "b", "vec": "vb"})
    near = (
        pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
        .mapInArrow(_cosines, "a long, b long, cosine double")
        .filter(F.col("cosine") >= min_cosine)
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
    return near.select(both.alias("x"), "cosine").select("x.*", "cosine")


def most_similar(df: DataFrame, k: int = NEIGHBOURS, min_cosine: float | None = MIN_COSINE, dimension: int = DIMENSION) -> DataFrame:
    """(record, neighbour, cosine, rank): for every usable vector of `df` (record, vec), its up to k most similar ones
    of cosine `min_cosine` or more; ties by record. Cosines are exact, rounded to six places. Without `min_cosine` the k
    most similar ones of all, from comparing everything: among vectors that are far apart no index finds them surely.

    Unusable vectors (null, another length, NaN, infinite, all zero) take no part. Repeated rows count once; of vectors
    that differ under one record one counts, always the same (the least key).
    """
    every = usable(df, dimension)
    rows = every.groupBy("record").agg(F.min("key").alias("key"))
    # the first k + 1 members of a class are all that any list can hold; rank limits apply before the shuffle
    w = Window.partitionBy("key").orderBy("record")
    first = rows.select("key", "record").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    heads = first.groupBy("key").agg(F.array_sort(F.collect_list("record")).alias("head"))
    classes = checkpoint(
        every.groupBy("key").agg(F.first("vec").alias("vec"))
        .join(heads, "key")
        .select(F.xxhash64("key").alias("id"), "key", "vec", "head")
    )
    points = classes.select("id", "vec", F.col("head")[0].alias("first"))
    if min_cosine is None:
        near = all_nearest(points, k + 1)
    else:
        near = _index_nearest(points, k + 1, min_cosine)
    # k + 1 nearest classes hold the k + 1 nearest members
    wc = Window.partitionBy("id").orderBy(F.desc("cosine"), "first", "other")
    heads_of = classes.select(F.col("id").alias("other"), F.col("head"), F.col("head")[0].alias("first"))
    lists = (
        near.join(heads_of, "other")
        .withColumn("n", F.row_number().over(wc)).filter(F.col("n") <= k + 1)
        .groupBy("id").agg(F.collect_list(F.struct("cosine", "head")).alias("others"))
    )
    own = F.transform("head", lambda r: F.struct((-F.lit(1.0)).alias("c"), r.alias("r")))
    other = F.flatten(F.transform("others", lambda o: F.transform(o["head"], lambda r: F.struct((-o["cosine"]).alias("c"), r.alias("r")))))
    merged = classes.join(lists, "id", "left").select(
        "key", F.slice(F.array_sort(F.concat(own, F.coalesce(other, F.expr("array()").cast("array<struct<c:double,r:string>>")))), 1, k + 1).alias("near")
    ).filter(F.size("near") > 1)
    return (
        rows.select("key", "record").join(merged, "key")
        .select("record", F.posexplode(F.slice(F.filter("near", lambda x: x["r"] != F.col("record")), 1, k)).alias("i", "x"))
        .select("record", F.col("x.r").alias("neighbour"), (-F.col("x.c")).alias("cosine"), (F.col("i") + 1).alias("rank"))
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "semantic_records").select(F.col("record_id").alias("record"), F.col("embedding").alias("vec"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(_records(spark, sf_dir))
    return near.select(F.least("record", "neighbour").alias("record_a"), F.greatest("record", "neighbour").alias("record_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_similar(_records(spark, sf_dir), min_cosine=None)


def brute_force(df: DataFrame, k: int, min_cosine: float, every: int = 100, dimension: int = DIMENSION) -> DataFrame:
    """(record, neighbour, cosine): exact neighbours for one record in `every` (by hash), against all rows in blocks.

    The query set travels to every block of rows, `BLOCK` queries at a time; each block returns its k best per query.
    """
    rows = usable(df, dimension).groupBy("record").agg(F.min_by("vec", "key").alias("vec"))
    queries = rows.filter(F.pmod(F.xxhash64("record"), F.lit(every)) == 0)
    blocks = queries.groupBy(F.pmod(F.xxhash64("record", F.lit(7)), F.lit(64)).alias("block")).agg(
        F.collect_list("record").alias("q"), F.flatten(F.collect_list("vec")).alias("qv")
    )
    parts = rows.withColumn("part", F.spark_partition_id()).groupBy("part", F.pmod(F.xxhash64("record"), F.lit(32)).alias("sub")).agg(
        F.collect_list("record").alias("r"), F.flatten(F.collect_list("vec")).alias("rv")
    )

    def run(batches):
        for batch in batches:
            for q, qv, r, rv in zip(*(batch.column(i) for i in range(4))):
                names, others = q.as_py(), r.as_py()
                a, b = (np.array(x.values, np.float64).reshape(-1, dimension) for x in (qv, rv))
                a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
                cos = np.round(a @ b.T, 6)
                out = []
                for i, name in enumerate(names):
                    hits = np.flatnonzero(cos[i] >= min_cosine)
                    best = sorted((-cos[i, j], others[j]) for j in hits if others[j] != name)[:k]
                    out += [(name, o, -c) for c, o in best]
                cols = list(zip(*out)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["record", "neighbour", "cosine"])

    best = blocks.select("q", "qv").crossJoin(parts.select("r", "rv")).mapInArrow(run, "record string, neighbour string, cosine double")
    w = Window.partitionBy("record").orderBy(F.desc("cosine"), "neighbour")
    return best.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wanted, found, recall): the true five nearest of one record in a hundred that `p1_neighbours` lists too.

    A neighbour counts as found if it or one at least as similar is listed in its place.
    """
    df = _records(spark, sf_dir)
    exact = brute_force(df, NEIGHBOURS, -2.0).groupBy("record").agg(F.collect_list("cosine").alias("want"))
    listed = most_similar(df, min_cosine=None).groupBy("record").agg(F.collect_list("cosine").alias("got"))
    hit = F.least(F.size("want"), F.size(F.filter("got", lambda c: c >= F.array_min("want") - 2e-6)))
    return (
        exact.join(listed, "record", "left")
        .agg(F.sum(F.size("want")).alias("wanted"), F.sum(F.coalesce(hit, F.lit(0))).alias("found"))
        .withColumn("recall", F.col("found") / F.col("wanted"))
    )


#: Brute force over all pairs.
SQL = {
    "p1_found": f"""WITH u AS (SELECT DISTINCT ON (record_id) record_id AS r, embedding::DOUBLE[] AS v FROM semantic_records WHERE record_id IS NOT NULL AND len(embedding) = {DIMENSION}
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  n AS (SELECT a.r AS a, b.r AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.r <> b.r
    QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY c DESC, b.r) <= {NEIGHBOURS})
SELECT DISTINCT least(a, b) AS record_a, greatest(a, b) AS record_b FROM n WHERE c >= {MIN_COSINE}"""
}
QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_recall": p1_recall}
