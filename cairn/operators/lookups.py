"""Reads by key, and the small projections that records and searches are made of, as queries of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_path
from cairn.functions.text import content_field, metadata_text
from cairn.functions.vectors import norm, normalise
from cairn.operators.delta import _two, delete_edges, import_targets, invalidations, snapshot_delta
from cairn.operators.records import card_records, chunk_records, embedding_input, snippet_records, symbol_records
from cairn.operators.scoring import is_behavior_owner, is_facade
from cairn.session import broadcast_if_small, table

#: Keys up to which a read filters the scan by their list; more are joined.
LISTED = 1000


def by_keys(df: DataFrame, key: str, keys: list) -> DataFrame:
    """The rows of `df` with one of `keys`, once each; none for no keys. Few keys reach the scan as a filter."""
    found = {k for k in keys if k is not None}
    if len(found) <= LISTED:
        return df.filter(F.col(key).isin(*found)) if found else df.limit(0)
    given = df.sparkSession.createDataFrame([(k,) for k in found], df.select(F.col(key).alias("__k")).schema)
    return df.join(broadcast_if_small(given), F.col(key) == F.col("__k"), "left_semi")


def save_vectors(rows: DataFrame, path: str) -> None:
    """Chunks (chunk_id, path, ...) with their `embedding`, as one Parquet table."""
    rows.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _first_ids(df: DataFrame, key: str, n: int) -> list:
    return [r[0] for r in df.select(key).distinct().orderBy(key).limit(n).collect()]


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, path, title) of the record with the greatest id."""
    records = table(spark, d, "semantic_records")
    last = records.agg(F.max("record_id")).first()[0]
    return by_keys(records, "record_id", [last]).select("record_id", "path", "title").distinct()


def multi_get(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, symbol_id) of the symbols of every twentieth file by rank of its id."""
    files = table(spark, d, "files").select("file_id").distinct().orderBy("file_id")
    ids = [r[0] for i, r in enumerate(files.toLocalIterator()) if i % 20 == 0]
    return by_keys(table(spark, d, "read_symbols"), "file_id", ids).select("file_id", "symbol_id").distinct()


def late_multi_get(spark: SparkSession, d: str) -> DataFrame:
    """The late vectors of the first 80 records that have some, in the order of their ordinals: (record_id, tokens)."""
    late = table(spark, d, "late_vectors").filter("record_id IS NOT NULL").select("record_id", "ordinal", "token").distinct()
    found = by_keys(late, "record_id", _first_ids(late, "record_id", 80))
    rows = found.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "token"))).alias("t"))
    return rows.select("record_id", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("tokens"))


def metadata_texts(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, text): the metadata of the cards' records as searchable text."""
    cards = table(spark, d, "file_cards").dropDuplicates(["card_id"]).withColumn("file_id", canonical_path("file_id"))
    return card_records(cards, "file_card").select("record_id", metadata_text("metadata").alias("text"))


def content_fields(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, symbol, kind, signature) read back from the contents of symbol records."""
    s = symbol_records(table(spark, d, "read_symbols").dropDuplicates(["symbol_id"]), table(spark, d, "files").dropDuplicates(["file_id"]))
    return s.select("record_id", *[content_field("content", k).alias(k) for k in ("symbol", "kind", "signature")])


def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, hash) of the text that is embedded for each snippet record."""
    s = snippet_records(table(spark, d, "files").dropDuplicates(["file_id"]))
    return s.select("record_id", F.sha2(embedding_input(F.col("title"), F.col("path"), F.col("content")), 256).alias("hash"))


def chunk_record_template(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, title, hash, source) of the chunks' records."""
    r = chunk_records(table(spark, d, "code_chunks").dropDuplicates(["chunk_id"]))
    return r.select("record_id", "title", F.sha2("content", 256).alias("hash"), F.try_element_at("metadata", F.lit("summary_source")).alias("source"))


def unit_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, first, length): the first number of each normalised vector, and the length before."""
    e = table(spark, d, "embeddings").withColumn("scaled", F.transform("embedding", lambda x: x * (F.col("vec_id") % 7)))
    return e.select("vec_id", (F.round(normalise("scaled")[0], 5) + F.lit(0.0)).alias("first"), F.round(norm("scaled"), 4).alias("length"))


def owner_predicates(spark: SparkSession, d: str) -> DataFrame:
    """(ownership, facade, owner, cards): how many cards' records count as facades and as owners of behaviour."""
    cards = table(spark, d, "file_cards").dropDuplicates(["card_id"]).withColumn("file_id", canonical_path("file_id"))
    r = card_records(cards, "file_card").select(F.try_element_at("metadata", F.lit("ownership_kind")).alias("ownership"), is_facade().alias("facade"), is_behavior_owner().alias("owner"))
    return r.groupBy("ownership", "facade", "owner").agg(F.count(F.lit(1)).alias("cards"))


def edges_left(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, target_id): import edges without those that touch a deleted file."""
    files = table(spark, d, "files").dropDuplicates(["file_id"])
    return delete_edges(import_targets(files), files.filter("deleted_at IS NOT NULL").select("file_id"))


def invalidation_marks(spark: SparkSession, d: str) -> DataFrame:
    """(entity_id, entity_kind, reason) of the change between two snapshots."""
    return invalidations(snapshot_delta(*_two(spark, d)))


def _sql() -> dict[str, str]:
    from cairn.operators.delta import _T, _TWO

    path = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), '\', '/'), '/+', '/', 'g'), '(/\.)+/', '/', 'g'), '^(\./)+', '')"
    cards = f"c AS (SELECT DISTINCT ON (card_id) *, {path('file_id')} AS k FROM file_cards)"
    source = r"regexp_matches(k, '\.(rs|py|ts|tsx)$')"
    tagged = "len(list_filter(retrieval_tags, lambda t: lower(t) = '{0}')) > 0"
    return {
        "point_lookup": "SELECT DISTINCT record_id, path, title FROM semantic_records WHERE record_id = (SELECT max(record_id) FROM semantic_records)",
        "multi_get": "WITH f AS (SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS n FROM (SELECT DISTINCT file_id FROM files)) SELECT DISTINCT file_id, symbol_id FROM read_symbols WHERE file_id IN (SELECT file_id FROM f WHERE n % 20 = 0)",
        "late_multi_get": """WITH l AS (SELECT DISTINCT record_id, ordinal, token FROM late_vectors WHERE record_id IS NOT NULL), i AS (SELECT DISTINCT record_id FROM l ORDER BY 1 LIMIT 80)
SELECT record_id, string_agg(token, ' ' ORDER BY ordinal, token) AS tokens FROM l WHERE record_id IN (FROM i) GROUP BY 1""",
        "metadata_texts": f"""WITH {cards} SELECT 'semantic:file_card:' || k AS record_id, 'kind file_card' || coalesce(' ownership_kind ' || ownership_kind, '') || coalesce(' retrieval_tags ' || array_to_string(retrieval_tags, ' '), '') AS text FROM c""",
        "content_fields": "SELECT DISTINCT ON (symbol_id) 'semantic:symbol:' || symbol_id AS record_id, nullif(trim(qualified_name), '') AS symbol, nullif(array_to_string(list_transform(string_split(kind, '_'), lambda x: upper(x[1]) || lower(x[2:])), ''), '') AS kind, nullif(trim(string_split(signature, chr(10))[1]), '') AS signature FROM read_symbols",
        "embedding_inputs": """WITH f AS (SELECT DISTINCT ON (file_id) * FROM files), s AS (SELECT path, unnest(snippets) AS s FROM f)
SELECT 'semantic:snippet:' || s.snippet_id AS record_id, sha256('title: Snippet ' || s.title || ' in ' || path || chr(10) || 'path: ' || path || chr(10) || s.text) AS hash FROM s""",
        "chunk_record_template": """WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM code_chunks)
SELECT 'semantic:code_chunk:' || chunk_id AS record_id, 'CodeChunk ' || coalesce(qualified_name, '<unknown>') || ' in ' || path AS title, lower(replace(summary_source, '_', '')) AS source,
  sha256('path: ' || coalesce(path, '') || chr(10) || 'symbol: ' || coalesce(qualified_name, '<unknown>') || chr(10) || 'kind: ' || lower(coalesce(kind, '')) || chr(10) || 'signature: ' || coalesce(signature, '') || chr(10)
   || 'summary: ' || trim(coalesce(doc_summary, '')) || chr(10) || 'code:' || chr(10) || coalesce(code, '')) AS hash
FROM c WHERE trim(coalesce(doc_summary, '')) <> '' OR trim(coalesce(signature, '')) <> '' OR trim(coalesce(code, '')) <> ''""",
        "unit_embeddings": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x * (vec_id % 7))::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e)
SELECT vec_id, round(CASE WHEN l > 0 THEN v[1] / l ELSE v[1] END, 5) + 0.0::DOUBLE AS first, round(l, 4) AS length FROM n""",
        "owner_predicates": rf"""WITH {cards}, p AS (SELECT ownership_kind AS ownership, coalesce(lower(ownership_kind) = 'facade', false) OR coalesce(regexp_matches(k, '/(lib|mod)\.rs$'), false) OR coalesce({tagged.format("artifact:facade")}, false) AS facade,
    coalesce(lower(ownership_kind) = 'implementation', false) AS impl, coalesce({tagged.format("artifact:implementation")}, false) OR coalesce({source}, false) AS made FROM c)
SELECT ownership, facade, impl OR (NOT facade AND made) AS owner, count(*) AS cards FROM p GROUP BY ALL""",
        "edges_left": f"""WITH f AS (SELECT DISTINCT ON (file_id) * FROM files), e AS ({_T.format("f")}), g AS (SELECT file_id FROM f WHERE deleted_at IS NOT NULL)
SELECT s AS source_id, t AS target_id FROM e WHERE s NOT IN (FROM g) AND t NOT IN (FROM g)""",
        "invalidation_marks": f"""WITH {_TWO}, c AS (SELECT * FROM ch WHERE change IS NOT NULL), a AS ({_T.format("o")}), b AS ({_T.format("n")}), e AS (SELECT * FROM a UNION SELECT * FROM b),
  x AS (SELECT file_id FROM c WHERE change <> 'removed'),
  m AS ((SELECT * FROM a WHERE s IN (FROM x) EXCEPT SELECT * FROM b) UNION (SELECT * FROM b WHERE s IN (FROM x) EXCEPT SELECT * FROM a)),
  af AS (SELECT file_id FROM x UNION SELECT t FROM e WHERE s IN (SELECT file_id FROM c) UNION SELECT s FROM e WHERE t IN (SELECT file_id FROM c) UNION SELECT t FROM m),
  ev AS (SELECT file_id, parent_folder_id AS p FROM o UNION SELECT file_id, parent_folder_id FROM n), fo AS (SELECT DISTINCT p FROM ev WHERE file_id IN (FROM af) OR file_id IN (SELECT file_id FROM c)),
  op AS (SELECT DISTINCT parent_folder_id AS p FROM o), np AS (SELECT DISTINCT parent_folder_id AS p FROM n), fa AS (SELECT p FROM np EXCEPT SELECT p FROM op), fr AS (SELECT p FROM op EXCEPT SELECT p FROM np)
SELECT file_id AS entity_id, 'file' AS entity_kind, 'file ' || change AS reason FROM c
UNION ALL SELECT file_id, 'file', 'neighbour changed' FROM af WHERE file_id NOT IN (SELECT file_id FROM c)
UNION ALL SELECT p, 'folder', 'child changed' FROM (SELECT p FROM fo UNION SELECT p FROM fa)
UNION ALL SELECT 'repo', 'repo', 'structure changed' WHERE (SELECT count(*) FROM c WHERE change = 'removed') > 0 OR (SELECT count(*) FROM x) >= 4 OR (SELECT count(*) FROM fa) + (SELECT count(*) FROM fr) > 0 OR (SELECT count(*) FROM m) > 0""",
    }


SQL = _sql()
QUERIES = {
    f.__name__: f
    for f in (point_lookup, multi_get, late_multi_get, metadata_texts, content_fields, embedding_inputs, chunk_record_template, unit_embeddings, owner_predicates, edges_left, invalidation_marks)
}
