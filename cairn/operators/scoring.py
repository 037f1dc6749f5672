"""Candidate evidence, the additive feature score with its reasons, and the collapse of hits by file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import looks_like_test_path, metadata_list, metadata_text
from cairn.functions.vectors import dot, literal
from cairn.plans.planner import EDIT_LIKE, EDIT_WORDS, ENTRYPOINT, FOLDER, REPO, QueryPlan, plan_query
from cairn.session import table

MAX_SYMBOLS = 12
# The reasons of the score, in the order in which they are given.
REASONS = {
    "test_low": "Test file de-prioritized because the query does not ask for tests",
    "test_high": "Test file preferred because the query asks for tests",
    "source": "Implementation/source file preferred for a non-test query",
    "dense": "Summary/content is semantically close to the query",
    "fts": "Full-text index matched exact query terms in path, title, content, or metadata",
    "exact": "Exact token, symbol, or path candidate matched the query",
    "graph": "Graph/dependency-oriented indexed context matched the query plan",
    "card_hint": "Query plan requested repository or folder card context",
    "terms": "Path, title, or indexed text contains: ",
    "behavior": "Behavior phrases match the query",
    "owns": "This result claims ownership of matching behavior",
    "edit": "Edit/search phrases match the query",
    "tags": "Retrieval tags match the query concepts",
    "file_card": "Matched enriched file-card text",
    "facade_low": "Entrypoint/facade result was de-prioritized for an implementation query",
    "owner": "Implementation file appears to own the requested behavior",
    "facade_high": "Entrypoint/facade result fits a public-surface query",
    "folder_card": "Matched enriched folder-card text",
    "folder_symbol": "Folder result was de-prioritized for a file-level symbol query",
    "folder_edit": "Folder result was de-prioritized for a file-level edit query",
    "folder_fit": "Folder card fits the planned search mode",
    "repo_card": "Matched the repository-level map",
    "repo_symbol": "Repository map was de-prioritized for a file-level symbol query",
    "repo_edit": "Repository map was de-prioritized for a file-level edit query",
    "repo_fit": "Repository architecture query fits the repo map",
    "file_fact": "Raw structural file record matched, but enriched cards are preferred",
    "symbol": "Matched a concrete symbol in this file",
    "symbol_plan": "Symbol query plan preferred concrete symbol records",
    "import": "Import/dependency context matches the query",
    "import_words": "Import-resolution wording matches directly",
    "downstream": "Downstream/dependency direction matches the query",
    "snippet": "Matched a source snippet in this file",
    "late": "Late-interaction MaxSim matched indexed code-token vectors",
    "rerank": "Reranker preferred this result",
}
DEPENDENCY_WORDS = set("dependency dependencies depends dependent downstream upstream".split())
DEPENDENCY_TEXTS = ["depends", "dependency", "incoming", "outgoing", "used by"]
IMPACT_WORDS = set("impact breaks blast".split())
IMPACT_TEXTS = ["blast_radius", "blast radius"]


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("content", F.lit(""))))


def kind() -> Column:
    return F.coalesce(F.try_element_at("metadata", F.lit("kind")), F.lit("unknown"))


def entity() -> Column:
    return F.lower("entity_type")


def symbol_name() -> Column:
    """The symbol of a symbol or chunk record; null for others."""
    named = F.nullif(F.trim(F.try_element_at("metadata", F.lit("qualified_name"))), F.lit(""))
    last = F.regexp_replace("entity_id", r"^.*::", "")
    own = F.nullif(F.trim(F.regexp_extract(last, r"^[^:]*", 0)), F.lit(""))
    return F.when(entity() == "code_chunk", F.coalesce(named, own)).when(entity() == "symbol", own)


def token_hits(text: Column, tokens: list[str]) -> Column:
    """How many of the tokens (repeats count) the text contains as substrings."""
    return reduce(lambda a, b: a + b, [F.coalesce(text.contains(t), F.lit(False)).cast("int") for t in tokens], F.lit(0))


def exact_score(plan: QueryPlan) -> Column:
    """0.05 for each token in title, path or content, a bonus for the symbol's name and one for a token in the path."""
    if not plan.tokens:
        return F.lit(0.0)
    symbol = F.coalesce(F.lower(symbol_name()).isin(*plan.tokens) & (entity() == "symbol"), F.lit(False))
    path = F.coalesce(_any([F.lower("path").contains(t) for t in plan.tokens]), F.lit(False))
    return (
        token_hits(haystack(), plan.tokens) * F.lit(0.05 * plan.lexical)
        + F.when(symbol, 0.35 * plan.symbol).otherwise(0.0)
        + F.when(path, 0.08 * plan.lexical).otherwise(0.0)
    )


def graph_score(plan: QueryPlan) -> Column:
    """0.25 for dependency words and 0.25 for impact words that meet such text in content or metadata."""
    text = F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce(metadata_text("metadata"), F.lit(""))))
    out = F.lit(0.0)
    if plan.any(DEPENDENCY_WORDS):
        out = out + F.when(_any([text.contains(t) for t in DEPENDENCY_TEXTS]), 0.25).otherwise(0.0)
    if plan.any(IMPACT_WORDS):
        out = out + F.when(_any([text.contains(t) for t in IMPACT_TEXTS]), 0.25).otherwise(0.0)
    return out


def has_tag(tag: str) -> Column:
    tags = F.from_json(F.try_element_at("metadata", F.lit("retrieval_tags")), "array<string>")
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == tag), F.lit(False))


def is_facade() -> Column:
    owned = F.coalesce(F.lower(F.try_element_at("metadata", F.lit("ownership_kind"))) == "facade", F.lit(False))
    return owned | F.coalesce(F.col("path").rlike(r"/(lib|mod)\.rs$"), F.lit(False)) | has_tag("artifact:facade")


def is_behavior_owner() -> Column:
    owned = F.coalesce(F.lower(F.try_element_at("metadata", F.lit("ownership_kind"))) == "implementation", F.lit(False))
    owns = F.coalesce(F.size(F.from_json(F.try_element_at("metadata", F.lit("owns_behaviors")), "array<string>")) > 0, F.lit(False))
    source = F.coalesce(F.col("path").rlike(r"\.(rs|py|ts|tsx)$"), F.lit(False))
    return owned | owns | (~is_facade() & (has_tag("artifact:implementation") | source))


def feature_terms(plan: QueryPlan, query_vector=None) -> list[tuple[Column, Column, Column]]:
    """[(when, points, reason or null)] of the score, in the order of the reasons."""
    if query_vector is None:
        similarity = F.lit(0.0)
    else:
        similarity = F.coalesce(F.when(F.size("embedding") > 0, dot("embedding", literal(query_vector))), F.lit(0.0))
    r = {k: F.lit(v) for k, v in REASONS.items()}
    none, yes = F.lit(None).cast("string"), F.lit(True)
    test, penal = looks_like_test_path("path"), plan.tests == "penalize"
    source_type = entity().isin("file", "symbol", "snippet")
    facade, owner = is_facade(), is_behavior_owner()
    hits = token_hits(F.col("hay"), plan.tokens)
    matched = F.array_join(F.filter(F.array(*[F.when(F.col("hay").contains(t), t) for t in plan.tokens]), lambda x: x.isNotNull()), ", ") if plan.tokens else F.lit("")
    meta = {k: token_hits(F.lower(metadata_list("metadata", k)), plan.tokens) for k in ("behavior_intents", "owns_behaviors", "edit_intents", "retrieval_tags")}
    edit_word = plan.any(EDIT_WORDS)
    own, entry = plan.owner_query, plan.any(ENTRYPOINT)
    folder_q, repo_q, edit_like = plan.any(FOLDER), plan.any(REPO), plan.any(EDIT_LIKE)
    k = kind()
    fc, dc, rc = k == "file_card", k == "folder_card", k == "repo_card"
    fts = F.greatest(F.lit(0.04), F.lit(0.24) / (1 + F.abs("fts_rank"))) * plan.lexical
    low = lambda when, a, b: F.when(when, a).otherwise(b)
    terms = [
        (yes, similarity * plan.semantic, none),
        (test & F.lit(penal and not plan.test_query), F.lit(-0.28), r["test_low"]),
        (test & F.lit(plan.tests == "prefer"), F.lit(0.22), r["test_high"]),
        (~test & source_type & F.lit(penal), F.lit(0.04), r["source"]),
        (similarity > 0.2, F.lit(0.0), r["dense"]),
        (F.col("fts_rank").isNotNull(), fts, r["fts"]),
        (F.col("dense_rank").isNotNull(), F.lit(0.08) / F.sqrt(F.col("dense_rank") + 1.0) * plan.semantic, none),
        (F.col("exact_score") > 0, F.col("exact_score"), r["exact"]),
        (F.col("graph_score") > 0, F.col("graph_score") * plan.graph, r["graph"]),
        (F.col("card_hint"), F.lit(0.16 * plan.card), r["card_hint"]),
        (hits > 0, hits * 0.08, F.concat(r["terms"], matched)),
        (meta["behavior_intents"] > 0, meta["behavior_intents"] * low(facade & F.lit(own), 0.03, 0.07), r["behavior"]),
        (meta["owns_behaviors"] > 0, meta["owns_behaviors"] * (0.14 if own else 0.08), r["owns"]),
        (meta["edit_intents"] > 0, meta["edit_intents"] * low(facade & F.lit(own), 0.035, 0.10 if edit_word else 0.05), r["edit"]),
        (meta["retrieval_tags"] > 0, meta["retrieval_tags"] * low(facade & F.lit(own), 0.025, 0.06), r["tags"]),
        (fc, F.lit(0.12 * plan.card), r["file_card"]),
        (fc & facade & F.lit(own), F.lit(-0.55), r["facade_low"]),
        (fc & ~facade & owner & F.lit(own), F.lit(0.28), r["owner"]),
        (fc & facade & F.lit(entry and not own), F.lit(0.18), r["facade_high"]),
        (dc, F.lit(0.08 * plan.card), r["folder_card"]),
        (dc & F.lit(plan.mode == "find_symbol" and not folder_q), F.lit(-0.38), r["folder_symbol"]),
        (dc & F.lit(edit_like and not folder_q), F.lit(-0.20), r["folder_edit"]),
        (dc & F.lit(plan.mode in ("architecture_overview", "find_behavior", "read_next")), F.lit(0.12 * plan.card), r["folder_fit"]),
        (rc, F.lit(0.16 * plan.card), r["repo_card"]),
        (rc & F.lit(plan.mode == "find_symbol" and not repo_q), F.lit(-0.48), r["repo_symbol"]),
        (rc & F.lit(plan.mode == "edit_target" and not repo_q), F.lit(-0.32), r["repo_edit"]),
        (rc & F.lit(repo_q or plan.repo_card), F.lit(0.30), r["repo_fit"]),
        (k == "file_fact", F.lit(-0.05), r["file_fact"]),
        ((k == "symbol_fact") & (hits > 0), F.lit(0.12 * plan.symbol), r["symbol"]),
        ((k == "symbol_fact") & F.lit(plan.mode == "find_symbol"), F.lit(0.12 * plan.symbol), r["symbol_plan"]),
        (F.col("hay").contains("import") & F.lit(plan.any({"dependency", "import", "resolution"})), F.lit(0.05), r["import"]),
        (
            F.lit("import" in plan.tokens and plan.any({"resolution", "resolve"}))
            & _any([F.col("hay").contains(t) for t in ("import resolution", "resolve_import", "imports onto concrete repository files")]),
            F.lit(0.14),
            r["import_words"],
        ),
        (
            F.lit(plan.any({"depends", "dependent", "downstream"}))
            & _any([F.col("hay").contains(t) for t in ("used_by", "incoming dependencies", "downstream files", "what depends on")]),
            F.lit(0.12),
            r["downstream"],
        ),
        ((F.col("hay").contains("snippet") | (entity() == "snippet")) & (hits > 0), F.lit(0.05), r["snippet"]),
    ]
    return terms


def score_records(candidates: DataFrame, plan: QueryPlan, query_vector=None) -> DataFrame:
    """The candidates with score, why_matched, matched_terms and symbol. A record without any reason needs 0.15.

    Candidates are records with the evidence columns fts_rank, dense_rank, exact_score, graph_score, card_hint. The
    lower-cased text is one column of an earlier projection, and score and reasons are two, so that no generated method
    grows too large.
    """
    rows = candidates.withColumn("hay", haystack())
    terms = feature_terms(plan, query_vector)
    flags = rows.withColumn("__on", F.array(*[F.coalesce(w, F.lit(False)) for w, _, _ in terms]))
    points = reduce(lambda a, b: a + b, [F.when(F.col("__on")[i], p).otherwise(0.0) for i, (_, p, _) in enumerate(terms)])
    said = [F.when(F.col("__on")[i], reason) for i, (_, _, reason) in enumerate(terms)]
    found = [F.when(F.col("hay").contains(t), F.lit(t)) for t in plan.tokens]
    return (
        flags.withColumn("score", points)
        .withColumn("why_matched", F.filter(F.array(*said), lambda x: x.isNotNull()))
        .withColumn("matched_terms", F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>"))
        .withColumn("symbol", symbol_name())
        .filter((F.size("why_matched") > 0) | (F.col("score") >= 0.15))
        .drop("hay", "__on")
    )


def collapse_by_path(hits: DataFrame) -> DataFrame:
    """One row for each path: the shown record, the score with its bonus, and the unions of terms, symbols and reasons.

    The shown record is the best file record of the path, else its best record; ties go to the least record_id. The
    score is the path's greatest plus 0.015 for each further hit, 0.06 at most. Symbols are listed up to `MAX_SYMBOLS`.
    """
    is_file = (kind() == "file_card") | (entity() == "file")
    row = F.struct("record_id", "entity_id", "entity_type", "title", "score")
    first = lambda when: F.min(F.when(when, F.struct((-F.col("score")).alias("neg"), F.col("record_id").alias("rid"), row.alias("row"))))
    merged = hits.groupBy("path").agg(
        first(is_file).alias("file"),
        first(F.lit(True)).alias("best"),
        F.max("score").alias("top"),
        F.count(F.lit(1)).alias("related_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("matched_terms"),
        F.array_sort(F.collect_set("symbol")).alias("symbols"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("why_matched")))).alias("why"),
    )
    shown = F.coalesce("file", "best")
    total = F.size("symbols")
    listed = F.slice("symbols", 1, MAX_SYMBOLS)
    reranked = lambda x: x.startswith(REASONS["rerank"])
    n = F.size(F.filter("why", reranked))
    why = F.when(n > 1, F.concat(F.filter("why", lambda x: ~reranked(x)), F.array(F.format_string("Reranker preferred %d matching records in this file", n)))).otherwise(F.col("why"))
    names = F.array_join(listed, ", ")
    symbols = F.when(total > MAX_SYMBOLS, F.format_string("Matched %d symbols in this file, including: %s", total, names)).when(
        total > 0, F.concat(F.lit("Matched symbols in this file: "), names)
    )
    many = F.when(
        F.col("related_hits") > 1,
        F.format_string("%d indexed file, symbol, or snippet records from this file matched and were shown as one result", F.col("related_hits")),
    )
    return merged.select(
        F.col("path").alias("entity_id"),
        shown["row"]["record_id"].alias("record_id"),
        "path",
        F.concat(F.lit("File "), "path").alias("title"),
        F.lit("file").alias("entity_type"),
        "matched_terms",
        listed.alias("matched_symbols"),
        total.alias("total_matched_symbols"),
        (F.col("top") + F.least((F.col("related_hits") - 1) * 0.015, F.lit(0.06))).alias("score"),
        F.concat(why, F.filter(F.array(symbols, many), lambda x: x.isNotNull())).alias("why_matched"),
        "related_hits",
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "semantic_records").dropDuplicates(["record_id"])


QUERY = "where should I edit the cursor retry fallback"


def exact_candidate_score(spark: SparkSession, d: str) -> DataFrame:
    plan = plan_query(QUERY)
    rows = _records(spark, d).select("record_id", F.round(exact_score(plan), 6).alias("exact_score"))
    return rows.filter("exact_score > 0")


def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    """The evidence part of the score, over recorded evidence rows."""
    plan = plan_query(QUERY)
    ev = table(spark, d, "candidate_evidence").distinct()
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    boost = F.greatest(F.lit(0.04), F.lit(0.24) / (1 + F.abs(clean("fts_rank")))) * plan.lexical
    fts = F.when(clean("fts_rank").isNotNull(), boost).otherwise(0.0)
    dense = F.coalesce(F.lit(0.08) / F.sqrt(F.col("dense_rank") + 1.0) * plan.semantic, F.lit(0.0))
    graph = F.coalesce(clean("graph_score"), F.lit(0.0)) * plan.graph
    total = fts + dense + F.coalesce(clean("exact_score"), F.lit(0.0)) + graph + F.when(F.col("card_hint"), 0.16 * plan.card).otherwise(0.0)
    return ev.select("query_id", "record_id", F.round(total, 5).alias("score"))


def collapse_by_group(spark: SparkSession, d: str) -> DataFrame:
    """File collapse of the exact candidates."""
    plan = plan_query(QUERY)
    hits = (
        _records(spark, d)
        .withColumn("score", F.round(exact_score(plan), 6))
        .filter("score > 0")
        .withColumns({"symbol": symbol_name(), "matched_terms": F.array().cast("array<string>"), "why_matched": F.array().cast("array<string>")})
    )
    out = collapse_by_path(hits)
    return out.select("path", "record_id", F.round("score", 6).alias("score"), F.col("related_hits").cast("long").alias("related_hits"), F.col("total_matched_symbols").cast("int").alias("symbols"))


def graph_candidate_score(spark: SparkSession, d: str) -> DataFrame:
    plan = plan_query("what depends on the planner and its blast impact")
    rows = _records(spark, d).select("record_id", graph_score(plan).alias("graph_score"))
    return rows.filter("graph_score > 0")


def test_path_filter(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").dropDuplicates(["file_id"])
    return files.groupBy(looks_like_test_path("path").alias("is_test"), F.col("path").rlike(r"\.(rs|py|ts|tsx)$").alias("is_source")).agg(F.count(F.lit(1)).alias("files"))


def _exact_sql(plan: QueryPlan) -> str:
    hay = "lower(concat_ws(' ', coalesce(title, ''), coalesce(path, ''), coalesce(content, '')))"
    hits = " + ".join(f"contains({hay}, '{t}')::INT" for t in plan.tokens)
    toks = ", ".join(f"'{t}'" for t in plan.tokens)
    path = " OR ".join(f"contains(lower(path), '{t}')" for t in plan.tokens)
    sym = "trim(regexp_extract(regexp_replace(entity_id, '^.*::', ''), '^[^:]*'))"
    return f"""WITH r AS (SELECT DISTINCT ON (record_id) * FROM semantic_records), x AS (SELECT *, {sym} AS sym,
  round(({hits}) * {0.05 * plan.lexical}::DOUBLE + CASE WHEN entity_type = 'symbol' AND lower({sym}) IN ({toks}) THEN {0.35 * plan.symbol}::DOUBLE ELSE 0 END
  + CASE WHEN {path} THEN {0.08 * plan.lexical}::DOUBLE ELSE 0 END, 6) AS score FROM r)"""


_P = plan_query(QUERY)
_EDGE = " OR ".join(f"contains(t, '{x}')" for x in DEPENDENCY_TEXTS)
SQL = {
    "exact_candidate_score": _exact_sql(_P) + " SELECT record_id, score AS exact_score FROM x WHERE score > 0",
    "collapse_by_group": _exact_sql(_P)
    + """, h AS (SELECT *, entity_type = 'file' AS is_file FROM x WHERE score > 0)
SELECT path, coalesce(arg_min(record_id, {'a': -score, 'b': record_id}) FILTER (WHERE is_file), arg_min(record_id, {'a': -score, 'b': record_id})) AS record_id,
  round(max(score) + least((count(*) - 1) * 0.015::DOUBLE, 0.06), 6) AS score, count(*) AS related_hits,
  count(DISTINCT CASE WHEN entity_type = 'symbol' THEN sym END)::INT AS symbols FROM h GROUP BY path""",
    "evidence_score": f"""WITH e AS (SELECT DISTINCT query_id, record_id, CASE WHEN fts_rank::VARCHAR <> 'nan' THEN fts_rank::DOUBLE END AS f, dense_rank AS d,
    CASE WHEN exact_score::VARCHAR <> 'nan' THEN exact_score::DOUBLE END AS x, CASE WHEN graph_score::VARCHAR <> 'nan' THEN graph_score::DOUBLE END AS g, card_hint AS c FROM candidate_evidence)
SELECT query_id, record_id, round(CASE WHEN f IS NOT NULL THEN greatest(0.04, 0.24 / (1 + abs(f))) * {_P.lexical} ELSE 0 END
  + coalesce(0.08 / sqrt(d + 1.0) * {_P.semantic}, 0) + coalesce(x, 0) + coalesce(g, 0) * {_P.graph} + CASE WHEN c THEN {0.16 * _P.card} ELSE 0 END, 5) AS score FROM e""",
    "graph_candidate_score": f"""WITH r AS (SELECT DISTINCT ON (record_id) record_id, lower(coalesce(content, '') || ' kind ' || coalesce(metadata['kind'], '') || ' tag ' || coalesce(metadata['tag'], '')) AS t FROM semantic_records)
SELECT record_id, CASE WHEN {_EDGE} THEN 0.25 ELSE 0.0 END::DOUBLE + CASE WHEN contains(t, 'blast_radius') OR contains(t, 'blast radius') THEN 0.25 ELSE 0.0 END::DOUBLE AS graph_score
FROM r WHERE {_EDGE} OR contains(t, 'blast_radius') OR contains(t, 'blast radius')""",
    "test_path_filter": r"""SELECT regexp_matches(path, '^tests/|/tests/|/__tests__/|_test\.rs$|_test\.py$|\.test\.|\.spec\.') AS is_test, regexp_matches(path, '\.(rs|py|ts|tsx)$') AS is_source,
  count(*) AS files FROM (SELECT DISTINCT ON (file_id) * FROM files) GROUP BY 1, 2""",
}
QUERIES = {
    "exact_candidate_score": exact_candidate_score,
    "graph_candidate_score": graph_candidate_score,
    "evidence_score": evidence_score,
    "collapse_by_group": collapse_by_group,
    "test_path_filter": test_path_filter,
}
