"""The search pipeline as one DataFrame plan: candidates, scores, late interaction, rerank, granularity, hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import clean_behaviours, content_field, fts_terms, metadata_text
from cairn.operators import bm25
from cairn.operators.dense import dense_topk, max_sim
from cairn.operators.read import labelled
from cairn.operators.scoring import REASONS, collapse_by_path, entity, exact_score, graph_score, kind, score_records
from cairn.plans.planner import QueryPlan, candidate_limit, plan_query
from cairn.providers import Embedder, Reranker
from cairn.session import table

# How many hits get late interaction and reranking, and what these add.
LATE_CANDIDATES, LATE_WEIGHT = 80, 0.30
RERANK_CANDIDATES, RERANK_WEIGHT, RERANK_CHARS = 40, 0.24, 1400
GRANULARITIES = ("file", "record", "symbol", "chunk")


def _local(rows: DataFrame) -> DataFrame:
    """The few rows of a ranked limit, computed once."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def record_texts(records: DataFrame) -> DataFrame:
    """`records` with what full-text search reads, in `TEXT_COLUMNS`."""
    return records.withColumn("metadata_text", metadata_text("metadata"))


TEXT_COLUMNS = ["title", "path", "content", "metadata_text"]


def candidates(records: DataFrame, plan: QueryPlan, limit: int, query_vector=None, postings=None) -> DataFrame:
    """Records with any evidence: full-text rank, dense rank, exact and graph score, card hint.

    Without any evidence the first records by record_id are candidates. The ranked records of both searches, a few
    hundred, are computed once. With `postings` - the tables (term, id, tf, len) and (n, mean) of a stored index - no
    text is tokenised.
    """
    top = candidate_limit(limit)
    spark = records.sparkSession
    if postings is not None:
        query = spark.createDataFrame([(0, plan.query)], "query_id int, query string")
        index, stats = postings  # the filter on terms reaches the sorted table's row groups
        ranked = bm25.search_postings(index.filter(F.col("term").isin(fts_terms(plan.query))), stats, query, top)
    else:
        ranked = bm25.search(record_texts(records), "record_id", TEXT_COLUMNS, plan.query, top)
    fts = _local(ranked.select(F.col("id").alias("record_id"), F.col("rank").alias("fts_rank")))
    rows = records.join(F.broadcast(fts), "record_id", "left")
    if query_vector is not None:
        q = spark.createDataFrame([(0, [float(x) for x in query_vector])], "query_id int, embedding array<float>")
        dense = _local(dense_topk(records.select(F.col("record_id").alias("id"), "embedding"), q, top).select(F.col("id").alias("record_id"), F.col("pos").alias("dense_rank")))
        rows = rows.join(F.broadcast(dense), "record_id", "left")
    else:
        rows = rows.withColumn("dense_rank", F.lit(None).cast("int"))
    hint = F.lit(False)
    if plan.repo_card:
        hint = hint | (kind() == "repo_card")
    if plan.folder_cards:
        hint = hint | (kind() == "folder_card")
    rows = rows.withColumns(
        {"exact_score": exact_score(plan), "graph_score": graph_score(plan) if plan.graph_neighbours else F.lit(0.0), "card_hint": hint}
    )
    # a record found by a search makes the question whether there is any evidence one for no scan
    sure = not fts.isEmpty()
    some = F.col("fts_rank").isNotNull() | F.col("dense_rank").isNotNull() | (F.col("exact_score") > 0) | (F.col("graph_score") > 0) | F.col("card_hint")
    found = rows.filter(some)
    return rows.orderBy("record_id").limit(top) if not sure and found.isEmpty() else found


def apply_late(hits: DataFrame, late: DataFrame, query_tokens: list[str], embedder: Embedder) -> DataFrame:
    """Hits with late interaction added for the best `LATE_CANDIDATES` by score and path."""
    if not query_tokens:
        return hits
    vectors = embedder.embed([f"code search token: {t}" for t in query_tokens])
    spark = hits.sparkSession
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "q int, embedding array<float>")
    best = hits.orderBy(F.desc("score"), "path", "record_id").limit(LATE_CANDIDATES).select("record_id")
    sims = max_sim(late.join(F.broadcast(best), "record_id", "left_semi"), q).withColumnRenamed("score", "late")
    joined = hits.join(F.broadcast(sims), "record_id", "left")
    why = F.when(F.col("late").isNotNull(), F.concat("why_matched", F.array(F.lit(REASONS["late"])))).otherwise(F.col("why_matched"))
    return joined.withColumn("score", F.col("score") + F.coalesce("late", F.lit(0.0)) * LATE_WEIGHT).withColumn("why_matched", why).drop("late")


def apply_rerank(hits: DataFrame, query: str, reranker: Reranker) -> DataFrame:
    """Hits with the reranker's scores added for the best `RERANK_CANDIDATES`, which are sent from the driver."""
    rows = hits.orderBy(F.desc("score"), "path", "record_id").limit(RERANK_CANDIDATES).select("record_id", "title", "path", F.round("score", 4).alias("score"), F.substring("content", 1, RERANK_CHARS).alias("content")).collect()
    if not rows:
        return hits
    texts = [f"title: {r['title']}\npath: {r['path']}\nscore: {r['score']}\ncontent: {r['content']}" for r in rows]
    scores = reranker.rerank(query, texts)
    found = [(r["record_id"], float(s)) for r, s in zip(rows, scores) if s > 0]
    given = hits.sparkSession.createDataFrame(found, "record_id string, rerank double")
    joined = hits.join(F.broadcast(given), "record_id", "left")
    why = F.when(F.col("rerank").isNotNull(), F.concat("why_matched", F.array(F.format_string(REASONS["rerank"] + " (%.2f)", "rerank")))).otherwise(F.col("why_matched"))
    return joined.withColumn("score", F.col("score") + F.coalesce("rerank", F.lit(0.0)) * RERANK_WEIGHT).withColumn("why_matched", why).drop("rerank")


def shape(hits: DataFrame, granularity: str, limit: int) -> DataFrame:
    """The `limit` best hits of a granularity; ties by path, then record_id."""
    if granularity == "file":
        rows = collapse_by_path(hits)
    else:
        rows = hits if granularity == "record" else hits.filter(entity() == {"symbol": "symbol", "chunk": "code_chunk"}[granularity])
        listed = F.filter(F.array("symbol"), lambda x: x.isNotNull())
        rows = rows.select(
            "entity_id", "record_id", "path", "title", entity().alias("entity_type"), "matched_terms", listed.alias("matched_symbols"),
            F.size(listed).alias("total_matched_symbols"), "score", "why_matched", F.lit(1).cast("long").alias("related_hits"),
        )
    return rows.orderBy(F.desc("score"), "path", "record_id").limit(limit)


def hydrate(hits: DataFrame, records: DataFrame, file_cards: DataFrame | None = None) -> DataFrame:
    """Hits with summary, description and behaviours: file hits from their card (by path, else by entity), others from
    their record's content."""
    ids = [h[0] for h in hits.select("record_id").collect()]
    r = records.filter(F.col("record_id").isin(ids)).select("record_id", "content", "metadata", F.col("path").alias("rpath"))
    rows = hits.join(r, "record_id", "left")
    is_file = F.col("entity_type").isin("file", "folder", "repo")
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    span = F.when(meta("start_line").isNotNull() & meta("end_line").isNotNull(), F.concat_ws("-", meta("start_line"), meta("end_line")))
    field = lambda k: content_field("content", k)
    content = F.nullif(F.trim("content"), F.lit(""))
    kinds = F.col("entity_type")
    summary = F.when(kinds == "code_chunk", F.coalesce(field("summary"), content)).when(kinds == "symbol", F.coalesce(field("signature"), content)).otherwise(content)
    description = (
        F.when(kinds == "code_chunk", labelled(Symbol=field("symbol"), Kind=field("kind"), Signature=field("signature"), Lines=span, Summary_source=meta("summary_source")))
        .when(kinds == "symbol", labelled(Symbol=field("symbol"), Kind=field("kind"), File=F.col("rpath")))
        .when(kinds == "snippet", labelled(Start_line=meta("start_line")))
    )
    if file_cards is None:
        return rows.withColumns({"summary": summary, "description": description, "behaviors": F.array().cast("array<string>")}).drop("content", "metadata", "rpath")
    has = lambda c: F.col(c) if c in file_cards.columns else F.array().cast("array<string>")
    role = F.col("role") if "role" in file_cards.columns else F.col("role_text")
    first = F.when(F.size(has("primary_behaviors")) > 0, has("primary_behaviors")).otherwise(has("behavior_intents"))
    cards = file_cards.groupBy(F.col("file_id").alias("cid")).agg(
        F.max_by(
            F.struct(
                F.nullif(F.trim("summary"), F.lit("")).alias("s"),
                labelled(Role=role, Owns=F.array_join(has("owns_behaviors"), "; "), Delegates_to=F.array_join(has("delegates_to"), "; ")).alias("d"),
                clean_behaviours(first).alias("b"),
            ),
            F.col("provenance.generated_at"),
        ).alias("card")
    )
    rows = rows.join(cards, F.col("entity_id") == F.col("cid"), "left")
    return rows.withColumns(
        {
            "summary": F.when(is_file, F.coalesce("card.s", summary)).otherwise(summary),
            "description": F.when(is_file, F.coalesce("card.d", description)).otherwise(description),
            "behaviors": F.coalesce(F.when(is_file, F.col("card.b")), F.array().cast("array<string>")),
        }
    ).drop("content", "metadata", "rpath", "cid", "card")


def search(
    records: DataFrame, query: str, limit: int = 8, granularity: str = "file", late: DataFrame | None = None, file_cards: DataFrame | None = None,
    embedder: Embedder | None = None, reranker: Reranker | None = None, dense: bool = True, postings=None,
) -> DataFrame:
    """The best `limit` hits for a query text over a record table; see the module's functions for each stage.

    Without an embedder, or with dense off, neither the dense stage nor late interaction runs.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    plan = plan_query(query)
    vector = embedder.embed([query])[0] if embedder is not None and dense else None
    hits = score_records(candidates(records, plan, limit, vector, postings), plan, vector)
    if vector is not None and late is not None:
        hits = apply_late(hits, late, plan.tokens, embedder)
    if reranker is not None:
        hits = apply_rerank(hits, query, reranker)
    return hydrate(_local(shape(hits, granularity, limit)), records, file_cards).orderBy(F.desc("score"), "path", "record_id")


def without_details(hits: DataFrame) -> DataFrame:
    """Hits for a compact answer."""
    return hits.drop("matched_terms", "total_matched_symbols", "why_matched")


def _search_table(spark: SparkSession, d: str, query: str, granularity: str, limit: int) -> DataFrame:
    records = table(spark, d, "semantic_records").dropDuplicates(["record_id"])
    return search(records, query, limit, granularity)


def search_files(spark: SparkSession, d: str) -> DataFrame:
    h = _search_table(spark, d, "where should I edit the cursor retry fallback", "file", 12)
    return h.select("path", "record_id", F.round("score", 6).alias("score"), F.col("related_hits").cast("long").alias("related_hits"), F.array_join("why_matched", " | ").alias("why"))


def search_symbols(spark: SparkSession, d: str) -> DataFrame:
    h = _search_table(spark, d, "where are fetch, pack and merge defined", "symbol", 12)
    return h.select("record_id", F.round("score", 6).alias("score"), F.array_join("matched_terms", ",").alias("terms"))


def search_dense(spark: SparkSession, d: str) -> DataFrame:
    """Search with a dense stage whose query vector is the first record's."""
    records = table(spark, d, "semantic_records").dropDuplicates(["record_id"])
    first = records.filter("size(embedding) = 64 AND NOT exists(embedding, x -> isnan(x))").orderBy("record_id").select("embedding").first()
    plan = plan_query("retry fallback of the window")
    vector = first[0] if first else None
    hits = score_records(candidates(records.withColumn("embedding", F.when(F.size("embedding") == 64, F.transform("embedding", lambda x: F.nanvl(x, F.lit(0.0).cast("float"))))), plan, 8, vector), plan, vector)
    return shape(hits, "record", 20).select("record_id", F.round("score", 5).alias("score"))


SQL = {}
QUERIES = {"search_files": search_files, "search_symbols": search_symbols, "search_dense": search_dense}
