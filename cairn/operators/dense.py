"""Exact dense retrieval and late interaction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.text import LATE_STOPWORDS, WORD_PATTERN, identifier_terms
from cairn.functions.vectors import dot
from cairn.session import table

#: Queries that one call may have: they travel to every executor.
MAX_QUERIES = 10_000
#: Weighted tokens kept for each record, and the weight a token can reach.
LATE_TOKENS, LATE_CAP = 48, 4.0


def dense_topk(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, pos): the k rows of (id, embedding) with the greatest dot product for each query
    (query_id, embedding); ties by id; pos from 0. Rows or queries without a vector of the common length take no part.

    The queries, at most `MAX_QUERIES`, are sent to the tasks; each Arrow batch of rows is one matrix product and returns
    its k best for each query, so no pair of all rows is ever made.
    """
    found = queries.filter(F.size("embedding") > 0).limit(MAX_QUERIES + 1).collect()
    if len(found) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries: split them into several calls")
    width = max((len(r["embedding"]) for r in found), default=0)
    found = [r for r in found if len(r["embedding"]) == width]
    id_type = rows.schema["id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double"
    if not found:
        return rows.sparkSession.createDataFrame([], f"{schema}, pos int")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(queries.schema["query_id"].dataType)
    matrix, names = np.array([r["embedding"] for r in found], np.float64).T, [r["query_id"] for r in found]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            scores, ids = np.round(v @ matrix, 9), batch.column(0)
            best = np.argpartition(-scores, min(k, len(scores)) - 1, axis=0)[: min(k, len(scores))]
            # everything that ties with the k-th best stays, so that ties are decided over all batches
            floor = np.take_along_axis(scores, best, 0).min(axis=0)
            at, q = np.nonzero(scores >= floor)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[j] for j in q], arrow_type), ids.take(pa.array(at)), pa.array(scores[at, q])], ["query_id", "id", "score"]
            )

    partial = rows.filter(F.size("embedding") == width).select("id", "embedding").mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") < k)


def max_sim(late: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(record_id, score): late interaction of (record_id, weight, embedding) with a few query vectors (q, embedding).

    For each query vector the best token by dot * sqrt(max(weight, 0.1)); the mean over those above zero, in 0..1.5.
    Tokens of another length are skipped; records without a positive match are left out.
    """
    q = F.broadcast(query_vectors.select("q", F.col("embedding").alias("qe")))  # as many as a query text has tokens
    sim = dot("embedding", "qe") * F.sqrt(F.greatest(F.col("weight").cast("double"), F.lit(0.1)))
    return (
        late.crossJoin(q)
        .filter(F.size("embedding") == F.size("qe"))
        .groupBy("record_id", "q")
        .agg(F.max(sim).alias("best"))
        .filter(F.col("best") > 0)
        .groupBy("record_id")
        .agg(F.least(F.avg("best"), F.lit(1.5)).alias("score"))
    )


def late_tokens(records: DataFrame, limit: int = LATE_TOKENS) -> DataFrame:
    """(record_id, token, weight, ordinal): the `limit` heaviest terms of each record.

    Terms are those of the identifiers in path (weight 1.25), title (1.35), content (1.0) and, for symbols and snippets,
    entity_id (1.4), summed up to 4.0; terms under three characters and stop words are dropped; heaviest first, ties by
    term; ordinals from 0.
    """
    words = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    part = lambda c, w: F.transform(F.flatten(F.transform(words(c), identifier_terms)), lambda t: F.struct(t.alias("t"), F.lit(w).alias("w")))
    entity = F.when(F.lower("entity_type").isin("symbol", "snippet"), F.col("entity_id"))
    all_terms = F.concat(part(F.col("path"), 1.25), part(F.col("title"), 1.35), part(F.col("content"), 1.0), part(entity, 1.4))
    w = Window.partitionBy("record_id").orderBy(F.desc("weight"), "token")
    return (
        records.select("record_id", F.explode(all_terms).alias("x"))
        .select("record_id", F.col("x.t").alias("token"), F.col("x.w").alias("w"))
        .filter((F.length("token") >= 3) & ~F.col("token").isin(*LATE_STOPWORDS))
        .groupBy("record_id", "token")
        .agg(F.least(F.round(F.sum("w"), 6), F.lit(LATE_CAP)).alias("weight"))
        .withColumn("ordinal", F.row_number().over(w) - 1)
        .filter(F.col("ordinal") < limit)
    )


def dense_topk_query(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = e.filter(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    top = dense_topk(e, queries, 10)
    return top.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("pos").cast("int").alias("pos"))


def maxsim_topk(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "late_vectors").distinct()
    first = late.agg(F.min("record_id").alias("record_id"))
    q = late.join(F.broadcast(first), "record_id").select(F.col("ordinal").alias("q"), "embedding")
    scores = max_sim(late, q).select("record_id", F.round("score", 6).alias("score"))
    return scores.orderBy(F.desc("score"), "record_id").limit(80)


def late_token_topk(spark: SparkSession, d: str) -> DataFrame:
    top = late_tokens(table(spark, d, "semantic_records").dropDuplicates(["record_id"]))
    return top.select("record_id", "token", F.round("weight", 6).alias("weight"), F.col("ordinal").cast("int").alias("ordinal"))


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
SQL = {
    "dense_topk": f"""SELECT q.vec_id AS query_id, e.vec_id AS vec_id, round({_DOT.format(a="q.embedding", b="e.embedding")}, 6) AS score,
  (row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT.format(a="q.embedding", b="e.embedding")}, 9) DESC, e.vec_id) - 1)::INT AS pos
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 QUALIFY pos < 10""",
    "maxsim_topk": f"""WITH late AS (SELECT DISTINCT * FROM late_vectors), q AS (SELECT ordinal, embedding FROM late WHERE record_id = (SELECT min(record_id) FROM late)),
  b AS (SELECT l.record_id, q.ordinal, max({_DOT.format(a="l.embedding", b="q.embedding")} * sqrt(greatest(l.weight::DOUBLE, 0.1))) AS best
        FROM late l, q WHERE len(l.embedding) = len(q.embedding) GROUP BY 1, 2)
SELECT record_id, round(least(avg(best), 1.5), 6) AS score FROM b WHERE best > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80""",
    "late_token_topk": rf"""WITH r AS (SELECT DISTINCT ON (record_id) * FROM semantic_records),
  s AS (SELECT record_id, path AS t, 1.25 AS w FROM r UNION ALL SELECT record_id, title, 1.35 FROM r UNION ALL SELECT record_id, content, 1.0 FROM r
        UNION ALL SELECT record_id, entity_id, 1.4 FROM r WHERE lower(entity_type) IN ('symbol', 'snippet')),
  b AS (SELECT record_id, w::DOUBLE AS w, regexp_replace(unnest(regexp_extract_all(coalesce(t, ''), '[\p{{L}}\p{{N}}_]+')), '^_+|_+$', '', 'g') AS b FROM s),
  t AS (SELECT record_id, w, unnest(list_distinct(list_filter(list_concat([lower(b)], list_transform(string_split(regexp_replace(b, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1_\2', 'g'), '_'), lambda x: lower(trim(x)))),
          lambda x: length(x) >= 2))) AS token FROM b WHERE length(b) >= 2),
  g AS (SELECT record_id, token, least(round(sum(w), 6), 4.0) AS weight FROM t WHERE length(token) >= 3 AND token NOT IN ({", ".join(f"'{x}'" for x in LATE_STOPWORDS)}) GROUP BY 1, 2)
SELECT record_id, token, round(weight, 6) AS weight, (row_number() OVER (PARTITION BY record_id ORDER BY weight DESC, token) - 1)::INT AS ordinal FROM g QUALIFY ordinal < {LATE_TOKENS}""",
}
QUERIES = {"dense_topk": dense_topk_query, "maxsim_topk": maxsim_topk, "late_token_topk": late_token_topk}
