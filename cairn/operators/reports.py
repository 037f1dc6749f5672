"""Counts, quality and readiness reports, card and chunk listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_hash, canonical_path
from cairn.session import table

SAMPLES = 12


def first_samples(df: DataFrame, by: str, limit: int = SAMPLES) -> DataFrame:
    """The `limit` least values of `by`, as one array; the rank limit works before anything is gathered."""
    return df.select(by).orderBy(by).limit(limit).agg(F.array_sort(F.collect_list(by)).alias("sample"))


def retrieval_stats(records: DataFrame, late: DataFrame) -> DataFrame:
    """One row: records, distinct records, embedded records, late vectors and records with late vectors."""
    a = records.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("record_id").alias("distinct_records"),
        F.count_if(F.size("embedding") > 0).alias("embedded"),
    )
    b = late.agg(F.count(F.lit(1)).alias("late_vectors"), F.countDistinct("record_id").alias("late_records"))
    return a.crossJoin(b)


def retrieval_ready(stats: dict, dense: bool = True, late: bool = True) -> bool:
    """Records and full-text rows, embeddings where dense is on, and late vectors where both are."""
    return stats["records"] > 0 and (not dense or stats["embedded"] > 0) and (not (dense and late) or stats["late_records"] > 0)


def quality_report(cards: DataFrame) -> DataFrame:
    """One row: cards with and without a summary and the first keys of those without."""
    empty = F.trim(F.coalesce("summary", F.lit(""))) == ""
    counts = cards.agg(F.count_if(~empty).alias("with_summary"), F.count_if(empty).alias("without_summary"))
    return counts.crossJoin(first_samples(cards.filter(empty), "file_id"))


def card_states(files: DataFrame, cards: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, path, card_state, record_state): how far each file's card and its record are.

    A card is ready if it has a summary and the file's hash, else stale (another hash), empty or missing; the record of a
    ready card is ready if it has the file's hash too, else stale or missing. Of several cards for a file the latest counts.
    """
    newest = F.max_by(F.struct("summary", canonical_hash("provenance.source_hash").alias("h")), F.struct("provenance.generated_at", "card_id"))
    c = cards.groupBy(canonical_path("file_id").alias("k")).agg(newest.alias("c"))
    r = records.filter(F.col("record_id").startswith("semantic:file_card:")).groupBy(canonical_path("entity_id").alias("k2")).agg(F.max(canonical_hash("source_hash")).alias("rh"))
    h = canonical_hash("source_hash")
    state = (
        F.when(F.col("c").isNull(), "missing").when(~F.col("c.h").eqNullSafe(h), "stale").when(F.trim(F.coalesce("c.summary", F.lit(""))) == "", "empty").otherwise("ready")
    )
    record = F.when(F.col("k2").isNull(), "missing").when(~F.col("rh").eqNullSafe(h), "stale").otherwise("ready")
    j = files.join(c, canonical_path("file_id") == F.col("k"), "left").join(r, canonical_path("file_id") == F.col("k2"), "left")
    return j.select("file_id", "path", state.alias("card_state"), record.alias("record_state"))


def readiness_report(files: DataFrame, cards: DataFrame, records: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: totals, ready, pending and stale numbers, samples of pending files, and the status."""
    s = card_states(files, cards, records)
    pending = (F.col("card_state") != "ready") | (F.col("record_state") != "ready")
    counts = s.agg(
        F.count(F.lit(1)).alias("files_total"),
        F.count_if(F.col("card_state") == "ready").alias("cards_ready"),
        F.count_if(F.col("card_state") != "ready").alias("cards_pending"),
        F.count_if(F.col("card_state") == "stale").alias("cards_stale"),
        F.count_if((F.col("card_state") == "ready") & (F.col("record_state") == "ready")).alias("records_ready"),
        F.count_if((F.col("card_state") == "ready") & (F.col("record_state") != "ready")).alias("records_pending"),
        F.count_if((F.col("card_state") == "ready") & (F.col("record_state") == "stale")).alias("records_stale"),
    )
    c = chunks.agg(F.count(F.lit(1)).alias("chunks_total"), F.count_if(F.col("summary_source") == "empty").alias("chunks_pending"))
    ready = (F.col("cards_pending") == 0) & (F.col("records_pending") == 0) & (F.col("chunks_pending") == 0)
    some = (F.col("cards_ready") > 0) | (F.col("chunks_pending") < F.col("chunks_total"))
    status = F.when(ready, "ready").when(some, "partial").otherwise("pending")
    return counts.crossJoin(c).crossJoin(first_samples(s.filter(pending), "path")).withColumn("status", status)


def card_listing(file_cards: DataFrame, folder_cards: DataFrame | None = None, repo_cards: DataFrame | None = None) -> DataFrame:
    """(kind, entity_id, summary, is_empty) of all cards."""
    one = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("entity_id"), F.coalesce("summary", F.lit("")).alias("summary"))
    out = one(file_cards, "file", "file_id")
    if folder_cards is not None:
        out = out.unionByName(one(folder_cards, "folder", "folder_id"))
    if repo_cards is not None:
        out = out.unionByName(one(repo_cards, "repo", "repo_root"))
    return out.withColumn("is_empty", F.trim("summary") == "")


def card_markdown(rows: DataFrame, empty_only: bool = False, source: str = "") -> str:
    """The card listing (kind, entity_id, summary, is_empty) as a Markdown report; the listing is collected."""
    cards = rows.orderBy("kind", "entity_id").collect()
    count = lambda k: sum(r["kind"] == k for r in cards)
    out = [f"# {'Empty card' if empty_only else 'Card'} summaries", ""]
    out += [f"- Store: `{source}`"] if source else []
    out += [f"- Cards returned: {len(cards)}", *(f"- {k.capitalize()} cards: {count(k)}" for k in ("file", "folder", "repo")), f"- Empty summaries: {sum(r['is_empty'] for r in cards)}", ""]
    if not cards:
        return "\n".join([*out, "No empty card summaries found." if empty_only else "No card summaries found.", ""])
    for kind in ("file", "folder", "repo"):
        if count(kind):
            out += [f"## {kind.capitalize()} cards", ""]
        for r in (r for r in cards if r["kind"] == kind):
            said = "_No summary is stored for this card._" if r["is_empty"] else "\n".join(f"> {x}".rstrip() for x in r["summary"].splitlines())
            out += [f"### `{r['entity_id']}`", "", f"- Type: {kind}", f"- Summary status: {'empty' if r['is_empty'] else 'present'}", "", "Summary:", "", said, ""]
    return "\n".join(out)


def chunk_dump(chunks: DataFrame, source: str | None = None, with_code: bool = False) -> DataFrame:
    """Chunks, optionally of one summary source (case and `_` ignored) and with their code."""
    plain = F.replace(F.lower("summary_source"), F.lit("_"), F.lit(""))
    rows = chunks if source is None else chunks.filter(plain == source.lower().replace("_", ""))
    cols = ["chunk_id", "path", "qualified_name", "kind", F.concat_ws("-", "start_line", "end_line").alias("lines"), "summary_source", F.coalesce("doc_summary", F.lit("")).alias("summary")]
    return rows.select(*cols, *(["code"] if with_code else []))


def enrichment_targets(files: DataFrame, cards: DataFrame, records: DataFrame, max_files: int) -> DataFrame:
    """(file_id): the next files to enrich, in order of path: those whose card is missing, stale or empty."""
    s = card_states(files, cards, records)
    return s.filter("card_state <> 'ready'").orderBy("path", "file_id").limit(max_files).select("file_id")


def _t(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).dropDuplicates([key])


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_stats(table(spark, d, "semantic_records"), table(spark, d, "late_vectors"))


def quality(spark: SparkSession, d: str) -> DataFrame:
    q = quality_report(_t(spark, d, "file_cards", "card_id").withColumn("file_id", canonical_path("file_id")))
    return q.select("with_summary", "without_summary", F.array_join("sample", ",").alias("sample"))


def readiness(spark: SparkSession, d: str) -> DataFrame:
    r = readiness_report(_t(spark, d, "files", "file_id"), _t(spark, d, "file_cards", "card_id"), _t(spark, d, "semantic_records", "record_id"), _t(spark, d, "code_chunks", "chunk_id"))
    return r.withColumn("sample", F.array_join("sample", ","))


def repair_set(spark: SparkSession, d: str) -> DataFrame:
    """Expected records that are missing: one for each file and each symbol."""
    expected = _t(spark, d, "files", "file_id").select(F.concat(F.lit("semantic:file:"), "file_id").alias("record_id")).unionByName(
        _t(spark, d, "read_symbols", "symbol_id").select(F.concat(F.lit("semantic:symbol:"), "symbol_id").alias("record_id"))
    )
    return expected.join(table(spark, d, "semantic_records").select("record_id").distinct(), "record_id", "left_anti")


def card_list(spark: SparkSession, d: str) -> DataFrame:
    cards = _t(spark, d, "file_cards", "card_id").withColumn("file_id", canonical_path("file_id"))
    return card_listing(cards).groupBy("kind", "is_empty").agg(F.count(F.lit(1)).alias("cards"), F.countDistinct("entity_id").alias("entities"))


def chunk_sources(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "code_chunks", "chunk_id").groupBy("summary_source", "kind").agg(F.count(F.lit(1)).alias("chunks"))


def chunk_list(spark: SparkSession, d: str) -> DataFrame:
    return chunk_dump(_t(spark, d, "code_chunks", "chunk_id"), "DocComment")


def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "semantic_records").groupBy("entity_type").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("path").alias("paths"))


def next_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return enrichment_targets(_t(spark, d, "files", "file_id"), _t(spark, d, "file_cards", "card_id"), _t(spark, d, "semantic_records", "record_id"), 25)


def debounced_batches(spark: SparkSession, d: str, gap_seconds: int = 3600) -> DataFrame:
    """Change events of one user joined into batches: a batch ends when nothing follows within the gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    new = F.coalesce((F.col("t") - F.lag("t").over(w)) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    b = e.withColumn("new", new).withColumn("batch", F.sum("new").over(w).cast("long"))
    return b.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.countDistinct("event_type").alias("types"))


_P = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), '\', '/'), '/+', '/', 'g'), '(/\.)+/', '/', 'g'), '^(\./)+', '')"
_H = lambda c: f"trim(regexp_replace(lower(trim({c})), '^[a-z0-9_.-]+:', ''))"
_D = lambda t, k: f"(SELECT DISTINCT ON ({k}) * FROM {t})"
_STATES = f"""c AS (SELECT {_P("file_id")} AS k, arg_max({{'s': summary, 'h': {_H("provenance.source_hash")}}}, {{'g': provenance.generated_at, 'i': card_id}}) AS c FROM {_D("file_cards", "card_id")} GROUP BY 1),
  r AS (SELECT {_P("entity_id")} AS k2, max({_H("source_hash")}) AS rh FROM {_D("semantic_records", "record_id")} WHERE record_id LIKE 'semantic:file\\_card:%' ESCAPE '\\' GROUP BY 1),
  s AS (SELECT file_id, path, CASE WHEN c.k IS NULL THEN 'missing' WHEN c.c.h IS DISTINCT FROM {_H("f.source_hash")} THEN 'stale' WHEN trim(coalesce(c.c.s, '')) = '' THEN 'empty' ELSE 'ready' END AS cs,
    CASE WHEN k2 IS NULL THEN 'missing' WHEN rh IS DISTINCT FROM {_H("f.source_hash")} THEN 'stale' ELSE 'ready' END AS rs
    FROM {_D("files", "file_id")} f LEFT JOIN c ON {_P("f.file_id")} = c.k LEFT JOIN r ON {_P("f.file_id")} = r.k2)"""
SQL = {
    "index_stats": """SELECT (SELECT count(*) FROM semantic_records) AS records, (SELECT count(DISTINCT record_id) FROM semantic_records) AS distinct_records,
  (SELECT count(*) FROM semantic_records WHERE len(embedding) > 0) AS embedded, (SELECT count(*) FROM late_vectors) AS late_vectors, (SELECT count(DISTINCT record_id) FROM late_vectors) AS late_records""",
    "quality": f"""WITH c AS (SELECT {_P("file_id")} AS f, trim(coalesce(summary, '')) = '' AS e FROM {_D("file_cards", "card_id")})
SELECT count(*) FILTER (WHERE NOT e) AS with_summary, count(*) FILTER (WHERE e) AS without_summary,
  coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT f FROM c WHERE e ORDER BY f LIMIT 12)), '') AS sample FROM c""",
    "readiness": f"""WITH {_STATES}, a AS (SELECT count(*) AS files_total, count(*) FILTER (WHERE cs = 'ready') AS cards_ready, count(*) FILTER (WHERE cs <> 'ready') AS cards_pending,
    count(*) FILTER (WHERE cs = 'stale') AS cards_stale, count(*) FILTER (WHERE cs = 'ready' AND rs = 'ready') AS records_ready, count(*) FILTER (WHERE cs = 'ready' AND rs <> 'ready') AS records_pending,
    count(*) FILTER (WHERE cs = 'ready' AND rs = 'stale') AS records_stale FROM s),
  k AS (SELECT count(*) AS chunks_total, count(*) FILTER (WHERE summary_source = 'empty') AS chunks_pending FROM {_D("code_chunks", "chunk_id")})
SELECT a.*, k.*, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM s WHERE cs <> 'ready' OR rs <> 'ready' ORDER BY path LIMIT 12)), '') AS sample,
  CASE WHEN cards_pending = 0 AND records_pending = 0 AND chunks_pending = 0 THEN 'ready' WHEN cards_ready > 0 OR chunks_pending < chunks_total THEN 'partial' ELSE 'pending' END AS status FROM a, k""",
    "repair_set": """SELECT record_id FROM (SELECT DISTINCT 'semantic:file:' || file_id AS record_id FROM files UNION SELECT DISTINCT 'semantic:symbol:' || symbol_id FROM read_symbols)
WHERE record_id NOT IN (SELECT record_id FROM semantic_records)""",
    "card_list": f"""SELECT 'file' AS kind, trim(coalesce(summary, '')) = '' AS is_empty, count(*) AS cards, count(DISTINCT {_P("file_id")}) AS entities FROM {_D("file_cards", "card_id")} GROUP BY 2""",
    "chunk_sources": f"SELECT summary_source, kind, count(*) AS chunks FROM {_D('code_chunks', 'chunk_id')} GROUP BY 1, 2",
    "chunk_list": f"""SELECT chunk_id, path, qualified_name, kind, concat_ws('-', start_line, end_line) AS lines, summary_source, coalesce(doc_summary, '') AS summary FROM {_D("code_chunks", "chunk_id")}
WHERE replace(lower(summary_source), '_', '') = 'doccomment'""",
    "entity_counts": "SELECT entity_type, count(*) AS records, count(DISTINCT path) AS paths FROM semantic_records GROUP BY 1",
    "next_enrichment": f"WITH {_STATES} SELECT file_id FROM s WHERE cs <> 'ready' ORDER BY path, file_id LIMIT 25",
    "debounced_batches": """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS batch FROM e)
SELECT user_id, batch, count(*) AS events, min(event_id) AS first_event, count(DISTINCT event_type) AS types FROM b GROUP BY 1, 2""",
}
QUERIES = {f.__name__: f for f in (index_stats, quality, readiness, repair_set, card_list, chunk_sources, chunk_list, entity_counts, next_enrichment, debounced_batches)}
