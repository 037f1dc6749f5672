"""Filling fixed-capacity containers: a configuration LP over the length histogram, by multiplicative weights."""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.ranking import group_ranks
from cairn.session import checkpoint, table

CAPACITY, CLASSES = 2048, 512
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): tokens of each whole text; null counts as empty, repeated ids count once (the longest).

    `tokenizer` is a rank file that every executor can read.
    """

    def count(batches):
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    rows = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Pricing: how many of each size (ascending) give the greatest value within `capacity`, and that value.

    The knapsack is solved by dynamic programming over the capacity, with unbounded counts.
    """
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fits[c]
        best[c], take[c] = best[c - 1], -1
        if k:
            v = best[c - sizes[:k]] + values[:k]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], take[c] = v[j], j
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return counts, float(best[capacity])


def covering_lp(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int, eta: float = 0.5) -> tuple[dict, float]:
    """An approximate fractional solution {pattern: how often} of min sum x with every size covered `need` times, and a
    lower bound of that sum.

    Multiplicative weights: a size starts with its length as price, which falls exponentially with how far it is covered;
    each round prices the best pattern, cuts it to what is there, and uses it as often as its scarcest size allows. The
    sum is scaled so that the items are covered once on average. Prices whose best pattern is worth 1 are a solution of
    the dual, so what all items are worth by them is a bound; the first round's is the volume.
    """
    covered, x, bound = np.zeros(len(sizes)), {}, 0.0
    for _ in range(rounds):
        price = np.exp(-eta * (covered - covered.min())) * sizes
        pattern, value = best_pattern(sizes, price, capacity)
        bound = max(bound, float((price * need).sum()) / value) if value else bound
        pattern = np.minimum(pattern, need)
        if not pattern.any():
            break
        step = float((need[pattern > 0] / pattern[pattern > 0]).min())
        key = pattern.tobytes()
        x[key] = x.get(key, 0.0) + step
        covered += step * pattern / need
    scale = float((covered * sizes * need).sum() / (sizes * need).sum()) or 1.0
    return {k: v / scale for k, v in x.items()}, bound


def _fill(sizes: np.ndarray, left: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The pattern `counts` (or an empty one) filled up greedily from the greatest size left that fits."""
    counts = np.zeros(len(sizes), np.int64) if counts is None else counts.copy()
    left, room = left - counts, capacity - int((counts * sizes).sum())
    for j in np.flatnonzero(left)[::-1]:
        k = min(int(left[j]), room // int(sizes[j]))
        counts[j] += k
        room -= k * int(sizes[j])
        if room < sizes[0]:
            break
    return counts


def pack_histogram(sizes: np.ndarray, need: np.ndarray, capacity: int, phases=(400, 200)) -> list[tuple[np.ndarray, int]]:
    """[(how many of each size, how many containers)] that uses every item exactly once.

    Each phase solves the LP for what is left and takes the whole part of its solution; the rest is filled greedily,
    the same pattern as often as it fits. The work depends on the number of sizes and the capacity, not on the items.
    """
    left, out = need.astype(np.int64).copy(), []
    for rounds in phases:
        live = np.flatnonzero(left)
        if not len(live):
            break
        x, _ = covering_lp(sizes[live], left[live], capacity, rounds)
        for key, times in sorted(x.items(), key=lambda kv: (-kv[1], kv[0])):
            pattern = np.zeros(len(sizes), np.int64)
            pattern[live] = np.frombuffer(key, np.int64)
            if (pattern > left).any():
                continue
            pattern = _fill(sizes, left, capacity, pattern)  # a cut pattern has room, which the greatest sizes take
            used = pattern > 0
            k = min(int(times + 0.5), int((left[used] // pattern[used]).min()))
            if k > 0:
                out.append((pattern, k))
                left -= pattern * k
    while left.any():
        pattern = _fill(sizes, left, capacity)
        used = pattern > 0
        k = int((left[used] // pattern[used]).min())
        out.append((pattern, k))
        left -= pattern * k
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """(doc_id, piece, tokens, container) for items (doc_id, tokens): every item in one container of `capacity`.

    Items above the capacity, and only they, are split into full pieces and a rest; null sizes count as 0. Lengths are
    rounded up to at most `classes` steps of the capacity (what is longer than the last whole step fills a container
    alone), so the driver sees a histogram of at most that many rows. Items
    of one class take the places of the class in the patterns by their rank in it; ranks are distributed, so no class is
    gathered anywhere. Empty items join container 0.
    """
    step = -(-capacity // classes)
    pieces = checkpoint(
        items.withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)).cast("int"))))
        .select("doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).alias("tokens"))
        .withColumn("class", F.least(F.ceil(F.col("tokens") / step), F.lit(capacity // step)).cast("int"))
    )
    histogram = sorted((r["class"], r["count"]) for r in pieces.filter("class > 0").groupBy("class").count().collect())
    keys, offsets, bases, per = [], [], [], []
    if histogram:
        sizes, need = (np.array(x, np.int64) for x in zip(*histogram))
        taken, container = np.zeros(len(sizes), np.int64), 0
        for pattern, times in pack_histogram(sizes, need, capacity // step):
            for j in np.flatnonzero(pattern):
                keys.append((int(sizes[j]) << 40) + int(taken[j]))
                offsets.append(int(taken[j])), bases.append(container), per.append(int(pattern[j]))
                taken[j] += pattern[j] * times
            container += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    tables = [np.array(x, np.int64)[order] for x in (keys, offsets, bases, per)]

    def assign(batches):
        starts, offs, base, many = tables
        for batch in batches:
            cls, rank = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64)
            if len(starts):
                at = np.maximum(np.searchsorted(starts, (cls << 40) + rank, side="right") - 1, 0)
                where = np.where(cls > 0, base[at] + (rank - offs[at]) // many[at], 0)
            else:
                where = np.zeros(len(cls), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(where)], ["doc_id", "piece", "tokens", "container"])

    ranked = group_ranks(pieces, ["class"], ["doc_id", "piece", "tokens"])
    return ranked.select("doc_id", "piece", "tokens", "class", "less").mapInArrow(
        assign, "doc_id long, piece int, tokens long, container long"
    )


def lower_bounds(items: DataFrame, capacity: int = CAPACITY, rounds: int = 150) -> tuple[int, int, float]:
    """(pieces, containers by volume, containers by the dual of the LP): what no packing can be below.

    The histogram is exact: one row for each length up to the capacity.
    """
    size = F.coalesce("tokens", F.lit(0))
    whole, rest = F.floor(size / capacity), size % capacity
    lengths = items.select(whole.alias("whole"), rest.alias("rest")).groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole"))
    rows = lengths.collect()
    full = sum(r["whole"] for r in rows)
    sizes, need = (np.array(x, np.int64) for x in list(zip(*sorted((r["rest"], r["n"]) for r in rows if r["rest"]))) or ((), ()))
    pieces, volume = full + int(need.sum()), full + math.ceil(int((sizes * need).sum()) / capacity)
    bound = full + covering_lp(sizes, need, capacity, rounds)[1] if len(sizes) else float(full)
    return pieces, volume, bound


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, items, used, unused): how full every container is."""
    packed = p8_packing(spark, sf_dir)
    return packed.groupBy("container").agg(
        F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("used"), (F.lit(CAPACITY) - F.sum("tokens")).alias("unused")
    )


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(containers, volume_bound, lp_bound): how many containers there are, and how many there must be at least."""
    tokens = checkpoint(token_counts(table(spark, sf_dir, "documents")))
    _, volume, bound = lower_bounds(tokens)
    return pack(tokens).agg((F.max("container") + 1).alias("containers")).select(
        "containers", F.lit(volume).cast("long").alias("volume_bound"), F.lit(math.ceil(bound - 1e-6)).cast("long").alias("lp_bound")
    )


SQL = {}
QUERIES = {"p8_packing": p8_packing, "p8_containers": p8_containers, "p8_bounds": p8_bounds}
