"""Evaluation texts leaking into documents: MinHash containment search over word shingles.

`contained_items` finds the items of which a document contains most (by default four fifths of their five-word shingles).
The Jaccard similarity of a short item and a long document is small even if all of the item is in it, so documents are
partitioned by size, in powers of two. In each partition the containment is turned into the Jaccard similarity that an
item must have at least with a document of the partition's greatest size, and from that follows how many MinHash rows
both get there: so many that one of them agrees with a probability of `FOUND`. Candidates are verified by the exact
containment of the shingles.

`leaked_items` asks for less: 12 consecutive words, which are far below any containment of a whole item. There the sets
are the passages - the 12-word windows, each the set of its 8 five-word shingles - so that both sides have the same size
and containment 1 is Jaccard 1: a single MinHash row finds every contained passage. The signature of a document is the
set of the MinHashes of its windows, about two for nine words. Candidates that share one are verified on the words.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.hashing import all_windows, mix, prefix_hash, window_minima
from cairn.session import broadcast_if_small, checkpoint, table

PASSAGE_WORDS, SHINGLE_WORDS = 12, 5
CONTAINMENT, FOUND, SEED = 0.8, 0.99, 20240301
_WORD = re.compile(r"[^\W_]+")


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hash_of = _WordHash()


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, without case."""
    return _WORD.findall(text.casefold())


def word_prefix(ws: list[str]) -> np.ndarray:
    return prefix_hash(np.fromiter(map(_hash_of.__getitem__, ws), np.uint64, len(ws)))


def passage_minhashes(text: str) -> np.ndarray:
    """The distinct MinHashes of all 12-word windows (one hash function over their five-word shingles)."""
    ws = words(text)
    if len(ws) < PASSAGE_WORDS:
        return np.zeros(0, np.int64)
    shingles = all_windows(word_prefix(ws), SHINGLE_WORDS)
    at = window_minima(shingles, PASSAGE_WORDS - SHINGLE_WORDS + 1)
    return np.unique(shingles[at]).view(np.int64)


def shares_passage(a: str, b: str) -> bool:
    """Whether two texts share 12 consecutive words, compared as words."""
    n, wa, wb = PASSAGE_WORDS, words(a), words(b)
    grams = {tuple(wa[i : i + n]) for i in range(len(wa) - n + 1)}
    return any(tuple(wb[i : i + n]) in grams for i in range(len(wb) - n + 1))


def _signatures(batches):
    for batch in batches:
        ids, lists = batch.column(0), [passage_minhashes(t) for t in batch.column(1).to_pylist()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        rows = np.repeat(np.arange(len(lists)), sizes)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(flat, pa.int64())], ["id", "minhash"])


def signatures(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, minhash): the signature rows of every text; null texts and keys have none."""
    rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), text)
    return rows.mapInArrow(_signatures, "id long, minhash long")


def _verified(batches):
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = pa.array([shares_passage(x, y) for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["doc_id", "item_id"])


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document and the item share at least 12 consecutive words; each pair once.

    Null or short texts match nothing. Repeated items or documents under one key count once if any of them matches. The
    items' signatures are broadcast only if they are few rows; beyond that the join is shuffled by MinHash.
    """
    texts = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    wanted = signatures(texts, "item_id").withColumnRenamed("id", "item_id").distinct()
    found = signatures(documents, "doc_id").withColumnRenamed("id", "doc_id").join(broadcast_if_small(wanted), "minhash")
    candidates = checkpoint(found.select("doc_id", "item_id").distinct())
    docs = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("doc"))
    pairs = (
        docs.join(broadcast_if_small(candidates), "doc_id")
        .join(broadcast_if_small(texts.withColumnRenamed("text", "item"), 2_000), "item_id")
        .select("doc_id", "item_id", "doc", "item")
    )
    return pairs.mapInArrow(_verified, "doc_id long, item_id long").distinct()


# ------------------------------------------------------------------------------------------ containment of whole items
def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles; a text of fewer words has none."""
    ws = words(text)
    return np.unique(all_windows(word_prefix(ws), SHINGLE_WORDS)) if len(ws) >= SHINGLE_WORDS else np.zeros(0, np.uint64)


def containment(item: str, doc: str) -> float:
    """The share of an item's distinct five-word shingles that a document has, compared as words; 0 without shingles."""
    n, wi, wd = SHINGLE_WORDS, words(item), words(doc)
    a = {tuple(wi[i : i + n]) for i in range(len(wi) - n + 1)}
    b = {tuple(wd[i : i + n]) for i in range(len(wd) - n + 1)}
    return len(a & b) / len(a) if a else 0.0


def rows_needed(item: int, partition: int, least: float) -> int:
    """MinHash rows for items of `item` shingles and documents of less than 2^(partition + 1); 0 where no document of the
    partition can hold enough of the item."""
    longest, common = 2 ** (partition + 1) - 1, math.ceil(least * item)
    if longest < common:
        return 0
    jaccard = common / (item + longest - common)
    return 1 if jaccard >= 1 else math.ceil(math.log(1 - FOUND) / math.log(1 - jaccard))


_factors = np.zeros(0, np.uint64)


def _multipliers(n: int) -> np.ndarray:
    global _factors
    if len(_factors) < n:
        size = 1 << n.bit_length()
        _factors = np.random.default_rng(SEED).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _factors[:n]


def minhash_keys(shingles: np.ndarray, rows: int, partition: int) -> np.ndarray:
    """One key for each MinHash row, different for every row and partition."""
    factors, out = _multipliers(rows), np.empty(rows, np.uint64)
    step = max(1, (1 << 20) // max(1, len(shingles)))
    for i in range(0, rows, step):
        out[i : i + step] = (shingles[None, :] * factors[i : i + step, None]).min(axis=1)
    return mix(out + mix(np.arange(rows, dtype=np.uint64) + np.uint64(partition << 32))).view(np.int64)


def _keys_of(each):
    """(id, key) rows: `each(size)` lists the (rows, partition) that a text of so many shingles gets."""

    def run(batches):
        for batch in batches:
            ids, keys = [], [np.zeros(0, np.int64)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shingles = shingle_set(text)
                for rows, partition in each(len(shingles)) if len(shingles) else ():
                    ids += [i] * rows
                    keys.append(minhash_keys(shingles, rows, partition))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(keys))], ["id", "key"])

    return run


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(shingle_set(t)) for t in batch.column(0).to_pylist()], pa.int64())], ["size"])


def _contained(least: float):
    def run(batches):
        for batch in batches:
            share = [containment(i, d) for d, i in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array([x >= least for x in share], pa.bool_())
            cols = [batch.column(0), batch.column(1), pa.array([round(x, 6) for x in share], pa.float64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], ["doc_id", "item_id", "containment"])

    return run


def _id_texts(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("id"), "text")


def contained_items(documents: DataFrame, items: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, containment): documents that have at least `least` of an item's distinct five-word shingles.

    Null texts and texts of fewer than five words match nothing. Of repeated keys with different texts the best pair
    counts. Only the distinct sizes of the items and the greatest partition come to the driver.
    """
    wanted = _id_texts(items, "item_id").distinct()
    docs = _id_texts(documents, "doc_id")
    known = sorted(r[0] for r in wanted.select("text").mapInArrow(_sizes, "size long").filter("size > 0").distinct().collect())
    # a word has a letter at least, and so has what stands between two
    longest = (docs.agg(F.max(F.length("text"))).first()[0] or 0) // 2 + 1
    partitions = range(longest.bit_length())
    most = {p: max((rows_needed(q, p, least) for q in known), default=0) for p in partitions}
    of_item = _keys_of(lambda size: [(n, p) for p in partitions if (n := rows_needed(size, p, least))])
    of_doc = _keys_of(lambda size: [(most[p], p)] if most.get(p := size.bit_length() - 1) else [])
    item_keys = wanted.mapInArrow(of_item, "id long, key long").withColumnRenamed("id", "item_id").distinct()
    doc_keys = docs.mapInArrow(of_doc, "id long, key long").withColumnRenamed("id", "doc_id")
    met = doc_keys.join(broadcast_if_small(checkpoint(item_keys), 1_000_000), "key")
    candidates = checkpoint(met.select("doc_id", "item_id").distinct())
    pairs = (
        docs.select(F.col("id").alias("doc_id"), F.col("text").alias("doc")).join(broadcast_if_small(candidates), "doc_id")
        .join(broadcast_if_small(wanted.select(F.col("id").alias("item_id"), F.col("text").alias("item")), 2_000), "item_id")
        .select("doc_id", "item_id", "doc", "item")
    )
    found = pairs.mapInArrow(_contained(least), "doc_id long, item_id long, containment double")
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def p9_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, containment): documents that hold most of an item."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, documents): every item that leaked and into how many documents."""
    found = p9_found(spark, sf_dir)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def _grams(name: str, table_name: str, key: str, n: int) -> str:
    words_of = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
    return (
        f"{name}w AS (SELECT DISTINCT {key} AS id, {words_of} AS ws FROM {table_name} WHERE {key} IS NOT NULL AND text IS NOT NULL), "
        f"{name} AS (SELECT DISTINCT id, array_to_string(ws[i : i + {n - 1}], ' ') AS gram FROM (SELECT id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM {name}w))"
    )


SQL = {
    "p9_found": f"""WITH {_grams("d", "documents", "doc_id", PASSAGE_WORDS)}, {_grams("t", "eval_items", "item_id", PASSAGE_WORDS)}
SELECT DISTINCT d.id AS doc_id, t.id AS item_id FROM d JOIN t USING (gram)""",
    "p9_items": f"""WITH {_grams("d", "documents", "doc_id", PASSAGE_WORDS)}, {_grams("t", "eval_items", "item_id", PASSAGE_WORDS)}
SELECT t.id AS item_id, count(DISTINCT d.id) AS documents FROM d JOIN t USING (gram) GROUP BY 1""",
    "p9_method": f"""WITH {_grams("d", "documents", "doc_id", SHINGLE_WORDS)}, {_grams("t", "eval_items", "item_id", SHINGLE_WORDS)},
  n AS (SELECT id, count(*) AS n FROM t GROUP BY 1)
SELECT d.id AS doc_id, t.id AS item_id, round(count(*) / any_value(n.n), 6) AS containment FROM d JOIN t USING (gram) JOIN n ON n.id = t.id GROUP BY 1, 2 HAVING count(*) / any_value(n.n) >= {CONTAINMENT}""",
}
QUERIES = {"p9_method": p9_method, "p9_found": p9_found, "p9_items": p9_items}
