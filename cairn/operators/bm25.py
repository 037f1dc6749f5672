"""BM25 over full-text tokens: an ad hoc scan without any shuffle, and a postings table for repeated use."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import fts_terms, fts_tokens
from cairn.session import table

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5)), 1e-6 where that is not positive."""
    v = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(v > 0, v).otherwise(1e-6)


def term_score(tf: Column, weight: Column, length: Column, mean: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def tokenised(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), fts_tokens(*cols).alias("tokens"))


def corpus_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(documents, tokens, avg_len, terms): sizes of the token corpus."""
    rows = df.select(fts_tokens(*cols).alias("tokens"))
    sizes = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("tokens").cast("long")).alias("tokens"), F.avg(F.size("tokens")).alias("avg_len"))
    terms = rows.select(F.explode("tokens").alias("t")).distinct().agg(F.count(F.lit(1)).alias("terms"))
    return sizes.crossJoin(terms)


def search(df: DataFrame, key: str, cols: list[str], query: str, limit: int | None = None) -> DataFrame:
    """(id, rank): the rows that hold a term of the query; rank = -BM25, lowest first, ties by id.

    One pass takes N, the mean length and the document frequency of the few query terms as one row; a second scores, in
    place, the rows whose text holds a term as a substring at least. No token leaves its row, so nothing is shuffled but
    one row for each partition. For many queries `build_postings` is the index to write.
    """
    terms = fts_terms(query)
    rows = tokenised(df, key, cols)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("rank")).limit(0)
    count = lambda t: (F.size("tokens") - F.size(F.array_remove("tokens", t))).cast("double")
    text = F.lower(F.concat_ws(" ", *cols))
    likely = tokenised(df.filter(reduce(or_, [text.contains(t) for t in terms])), key, cols)
    counted = lambda x: x.select("id", F.size("tokens").alias("len"), F.array(*[count(t) for t in terms]).alias("tf"))
    stats = counted(rows).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("len").alias("mean"),
        F.array(*[F.sum((F.col("tf")[i] > 0).cast("long")) for i in range(len(terms))]).alias("df"),
    )
    score = sum(term_score(F.col("tf")[i], idf(F.col("n"), F.col("df")[i]), F.col("len"), F.col("mean")) for i in range(len(terms)))
    hits = counted(likely).filter(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats)).select("id", (-score).alias("rank"))
    return hits.orderBy("rank", "id").limit(limit) if limit else hits


def build_postings(df: DataFrame, key: str, cols: list[str], terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings (term, id, tf, len), stats (n, mean)): the index to write and reuse. With `terms` only theirs, so that no
    other token leaves its row."""
    rows = tokenised(df, key, cols).withColumn("len", F.size("tokens"))
    if terms is not None:
        rows = rows.withColumn("tokens", F.filter("tokens", lambda t: t.isin(*terms)))
    postings = rows.select("id", "len", F.explode("tokens").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    return postings.select("term", "id", "tf", "len"), rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))


def index_rows(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(term, id, tf, len) to store: the postings, and for each row one with a null term, which holds its length even
    if it has no token. Rows of an id can be taken out and put in again without touching others."""
    rows = tokenised(df, key, cols).withColumn("len", F.size("tokens"))
    terms = rows.select("id", "len", F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    return terms.groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "tf", "len")


def search_postings(postings: DataFrame, stats: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, rank, pos): the `limit` best rows of each query of (query_id, query), over a postings table.

    Query terms meet postings by an equi-join; a term's frequency is counted on the postings of query terms only.
    """
    from pyspark.sql import Window

    q = queries.select("query_id", F.explode(F.array_distinct(fts_tokens("query"))).alias("term")).filter(F.octet_length("term") >= 2)
    wanted = postings.join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
    freq = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = (
        wanted.join(freq, "term").join(F.broadcast(q), "term").crossJoin(F.broadcast(stats))
        .groupBy("query_id", "id")
        .agg((-F.sum(term_score(F.col("tf"), idf(F.col("n"), F.col("df")), F.col("len"), F.col("mean")))).alias("rank"))
    )
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    return scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


QUERY = "import resolution fallback retry window"
BATCH = ["idle bracket slots", "falls back to a calm retry", "rebuilt whenever the panel", "warnings per sprocket"]


def fts_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    out = corpus_stats(table(spark, d, "documents"), ["text"])
    return out.select("documents", "tokens", F.round("avg_len", 6).alias("avg_len"), "terms")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = search(table(spark, d, "documents"), "doc_id", ["text"], QUERY).select("id", F.round("rank", 6).alias("rank"))
    return hits.orderBy("rank", "id").limit(20).withColumnRenamed("id", "doc_id")


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch over texts without a stored index: only postings of terms that a query has are built."""
    wanted = sorted({t for q in BATCH for t in fts_terms(q)})
    postings, stats = build_postings(table(spark, d, "documents"), "doc_id", ["text"], wanted)
    queries = spark.createDataFrame(list(enumerate(BATCH)), "query_id int, query string")
    hits = search_postings(postings, stats, queries, 10)
    return hits.select("query_id", F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"), F.col("pos").cast("int").alias("pos"))


_TOK = "tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_./-]+') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok)"


def _bm25_sql(queries: list[str], limit: int) -> str:
    terms = ", ".join(f"({i}, '{t}')" for i, q in enumerate(queries) for t in fts_terms(q))
    return f"""WITH {_TOK}, q(query_id, term) AS (VALUES {terms}),
  p AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT query_id, doc_id, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
        * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS rank FROM p JOIN f USING (term) JOIN q USING (term), st GROUP BY 1, 2)
SELECT query_id, doc_id, round(rank, 6) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 6), doc_id)::INT AS pos FROM s
QUALIFY pos <= {limit}"""


SQL = {
    "fts_corpus_stats": f"WITH {_TOK} SELECT count(*) AS documents, sum(len(t))::BIGINT AS tokens, round(avg(len(t)), 6) AS avg_len, "
    "(SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM tok)) AS terms FROM tok",
    "bm25_topk": f"SELECT doc_id, rank FROM ({_bm25_sql([QUERY], 20)})",
    "bm25_batch": _bm25_sql(BATCH, 10),
}
QUERIES = {"fts_corpus_stats": fts_corpus_stats, "bm25_topk": bm25_topk, "bm25_batch": bm25_batch}
