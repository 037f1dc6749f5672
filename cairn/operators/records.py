"""Search records from files, snippets, symbols, chunks and cards, by fixed text templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_path
from cairn.session import table

COLUMNS = ["record_id", "entity_id", "entity_type", "title", "content", "path", "source_hash", "metadata"]
_nothing = F.lit


def _text(c) -> Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit(""))


def lines(**parts) -> Column:
    """`key: value` lines; nulls are empty. Underscores of the keys are blanks."""
    return F.concat_ws("\n", *[F.concat(F.lit(k.replace("__", " ") + ": "), _text(v)) for k, v in parts.items()])


def _meta(**entries) -> Column:
    kept = F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return kept


def file_records(files: DataFrame) -> DataFrame:
    """One record for each file of (file_id, path, language, line_count, source_hash, imports, snippets)."""
    content = lines(
        path="path",
        language="language",
        imports=F.array_join(F.transform("imports", lambda i: i["module"]), ", "),
        important__snippets=F.array_join(F.transform("snippets", lambda s: s["title"]), ", "),
        lines="line_count",
    )
    return files.select(
        F.concat(F.lit("semantic:file:"), "file_id").alias("record_id"), F.col("file_id").alias("entity_id"), F.lit("file").alias("entity_type"),
        F.concat(F.lit("File "), "path").alias("title"), content.alias("content"), "path", "source_hash", _meta(kind=F.lit("file_fact")).alias("metadata"),
    )


def snippet_records(files: DataFrame) -> DataFrame:
    s = files.select("file_id", "path", "source_hash", F.explode("snippets").alias("s"))
    return s.select(
        F.concat(F.lit("semantic:snippet:"), "s.snippet_id").alias("record_id"), F.col("s.snippet_id").alias("entity_id"), F.lit("snippet").alias("entity_type"),
        F.concat(F.lit("Snippet "), "s.title", F.lit(" in "), "path").alias("title"), F.col("s.text").alias("content"), "path", "source_hash",
        _meta(file_id=F.col("file_id"), start_line=F.col("s.start_line").cast("string")).alias("metadata"),
    )


def symbol_records(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols (symbol_id, file_id, qualified_name, kind, signature) with their file's path and hash (empty if unknown)."""
    f = files.select("file_id", "path", "source_hash")
    label = F.initcap(F.replace("kind", F.lit("_"), F.lit(" ")))
    kind = F.replace(label, F.lit(" "), F.lit(""))
    joined = symbols.drop("path", "source_hash").join(f, "file_id", "left")
    path = F.coalesce("path", "file_id")
    return joined.select(
        F.concat(F.lit("semantic:symbol:"), "symbol_id").alias("record_id"), F.col("symbol_id").alias("entity_id"), F.lit("symbol").alias("entity_type"),
        F.concat(F.lit("Symbol "), "qualified_name", F.lit(" in "), path).alias("title"),
        lines(symbol="qualified_name", kind=kind, signature="signature", file=path).alias("content"), path.alias("path"),
        F.coalesce("source_hash", F.lit("")).alias("source_hash"), _meta(kind=F.lit("symbol_fact")).alias("metadata"),
    )


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunks with a summary, a signature or code; those without any of them give no record."""
    name = F.coalesce("qualified_name", F.lit("<unknown>"))
    content = F.concat(
        lines(path="path", symbol=name, kind=F.lower("kind"), signature="signature", summary=F.trim(_text("doc_summary"))), F.lit("\ncode:\n"), _text("code")
    )
    some = reduce(lambda a, b: a | b, [F.trim(_text(c)) != "" for c in ("doc_summary", "signature", "code")])
    return chunks.filter(some).select(
        F.concat(F.lit("semantic:code_chunk:"), "chunk_id").alias("record_id"), F.col("chunk_id").alias("entity_id"), F.lit("code_chunk").alias("entity_type"),
        F.concat(F.lit("CodeChunk "), name, F.lit(" in "), "path").alias("title"), content.alias("content"), "path", "source_hash",
        _meta(
            kind=F.lit("code_chunk"), summary_source=F.replace(F.lower("summary_source"), F.lit("_"), F.lit("")), symbol_id=F.col("symbol_id"),
            qualified_name=F.col("qualified_name"), start_line=F.col("start_line").cast("string"), end_line=F.col("end_line").cast("string"),
        ).alias("metadata"),
    )


def _joined(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.array_join(c, "; "), F.lit("")) if c in df.columns else F.lit("")


def _field(df: DataFrame, *names: str) -> Column:
    known = [n for n in names if n in df.columns]
    return _text(known[0]) if known else F.lit("")


def card_records(cards: DataFrame, kind: str) -> DataFrame:
    """Records of file, folder or repository cards (`kind` = file_card, folder_card, repo_card); absent columns are empty."""
    j, t = (lambda c: _joined(cards, c)), (lambda *c: _field(cards, *c))
    key = {"file_card": "file_id", "folder_card": "folder_id", "repo_card": "repo_root"}[kind]
    arrow = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(" -> ", x[a], x[b])), "; ") if c in cards.columns else F.lit("")
    if kind == "file_card":
        own = F.initcap(t("ownership_kind"))
        content = lines(
            summary="summary", role=t("role", "role_text"), ownership=own, owns__behaviors=j("owns_behaviors"), delegates__to=j("delegates_to"), behaviors=j("primary_behaviors"),
            behavior__intents=j("behavior_intents"), edit__intents=j("edit_intents"), retrieval__tags=j("retrieval_tags"), imports=arrow("imports_interpreted", "target_path", "why"),
            used_by=arrow("used_by_interpreted", "target_path", "why"), blast_radius=j("blast_radius"), read__hints=j("agent_read_hints"), search__phrases=j("search_phrases"),
        )
    elif kind == "folder_card":
        content = lines(
            summary="summary", responsibility=t("responsibility"), behaviors=j("common_behaviors"), behavior__intents=j("behavior_intents"), edit__intents=j("edit_intents"),
            retrieval__tags=j("retrieval_tags"), incoming__dependencies=j("incoming_dependencies_meaning"), outgoing__dependencies=j("outgoing_dependencies_meaning"),
            entrypoints=j("key_entrypoints"), guidance=j("agent_guidance"), search__phrases=j("search_phrases"),
        )
    else:
        content = lines(
            summary="summary", behavior__intents=j("behavior_intents"), edit__intents=j("edit_intents"), retrieval__tags=j("retrieval_tags"),
            subsystems=arrow("top_level_subsystems", "name", "responsibility"), flows=j("cross_subsystem_flows"), entrypoints=j("entrypoints"), high__risk__areas=j("high_risk_areas"),
            navigation__hints=j("agent_navigation_hints"), search__phrases=j("search_phrases"),
        )
    lists = [c for c in ("behavior_intents", "edit_intents", "retrieval_tags", *(("owns_behaviors", "delegates_to") if kind == "file_card" else ())) if c in cards.columns]
    meta = {"kind": F.lit(kind)} | {c: F.to_json(c) for c in lists}
    if kind == "file_card" and "ownership_kind" in cards.columns:
        meta["ownership_kind"] = F.col("ownership_kind")
    title = {"file_card": "FileCard ", "folder_card": "FolderCard ", "repo_card": "RepoCard "}[kind]
    return cards.select(
        F.concat(F.lit(f"semantic:{kind}:"), key).alias("record_id"), F.col(key).alias("entity_id"), F.lit({"file_card": "file", "folder_card": "folder", "repo_card": "repo"}[kind]).alias("entity_type"),
        F.concat(F.lit(title), key).alias("title"), content.alias("content"), F.col(key).alias("path"), F.col("provenance.source_hash").alias("source_hash"), _meta(**meta).alias("metadata"),
    )


def embedding_input(title: Column, path: Column, content: Column) -> Column:
    return F.concat(F.lit("title: "), title, F.lit("\npath: "), path, F.lit("\n"), content)


def record_counts(spark: SparkSession, d: str) -> DataFrame:
    """All records that the tables give, as type, number and a content digest."""
    files = table(spark, d, "files").dropDuplicates(["file_id"])
    symbols = table(spark, d, "read_symbols").dropDuplicates(["symbol_id"])
    chunks = table(spark, d, "code_chunks").dropDuplicates(["chunk_id"])
    every = file_records(files)
    for more in (snippet_records(files), symbol_records(symbols, files), chunk_records(chunks)):
        every = every.unionByName(more)
    return every.groupBy("entity_type").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("content").cast("long")).alias("chars"), F.sum(F.length("title").cast("long")).alias("title_chars"))


def file_record_template(spark: SparkSession, d: str) -> DataFrame:
    return file_records(table(spark, d, "files").dropDuplicates(["file_id"])).select("record_id", "title", "content")


def card_record_template(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "file_cards").dropDuplicates(["card_id"]).withColumn("file_id", canonical_path("file_id"))
    return card_records(cards, "file_card").select("record_id", "title", "content")


SQL = {
    "file_record_template": """WITH f AS (SELECT DISTINCT ON (file_id) * FROM files)
SELECT 'semantic:file:' || file_id AS record_id, 'File ' || path AS title, 'path: ' || path || chr(10) || 'language: ' || coalesce(language, '') || chr(10) || 'imports: '
 || coalesce(array_to_string(list_transform(imports, lambda i: i.module), ', '), '') || chr(10) || 'important snippets: ' || coalesce(array_to_string(list_transform(snippets, lambda s: s.title), ', '), '')
 || chr(10) || 'lines: ' || line_count AS content FROM f""",
    "card_record_template": rf"""WITH c AS (SELECT DISTINCT ON (card_id) *, regexp_replace(regexp_replace(regexp_replace(replace(trim(file_id), '\', '/'), '/+', '/', 'g'), '(/\.)+/', '/', 'g'), '^(\./)+', '') AS k FROM file_cards)
SELECT 'semantic:file_card:' || k AS record_id, 'FileCard ' || k AS title, 'summary: ' || coalesce(summary, '') || chr(10) || 'role: ' || coalesce(role_text, '') || chr(10)
 || 'ownership: ' || coalesce(upper(ownership_kind[1]) || lower(ownership_kind[2:]), '') || chr(10) || 'owns behaviors: ' || chr(10) || 'delegates to: ' || chr(10)
 || 'behaviors: ' || coalesce(array_to_string(primary_behaviors, '; '), '') || chr(10) || 'behavior intents: ' || chr(10) || 'edit intents: ' || chr(10) || 'retrieval tags: ' || coalesce(array_to_string(retrieval_tags, '; '), '') || chr(10)
 || 'imports: ' || chr(10) || 'used_by: ' || chr(10) || 'blast_radius: ' || chr(10) || 'read hints: ' || chr(10) || 'search phrases: ' AS content FROM c""",
    "record_counts": """WITH f AS (SELECT DISTINCT ON (file_id) * FROM files), s AS (SELECT DISTINCT ON (symbol_id) * FROM read_symbols), c AS (SELECT DISTINCT ON (chunk_id) * FROM code_chunks),
  sn AS (SELECT path, unnest(snippets) AS s FROM f), sy AS (SELECT s.*, coalesce(f.path, s.file_id) AS p FROM s LEFT JOIN f USING (file_id)),
  r AS (SELECT 'file' AS entity_type, 'File ' || path AS t, 'path: ' || path || 'language: ' || coalesce(language, '') || 'imports: ' || coalesce(array_to_string(list_transform(imports, lambda i: i.module), ', '), '')
    || 'important snippets: ' || coalesce(array_to_string(list_transform(snippets, lambda s: s.title), ', '), '') || 'lines: ' || line_count || '1234' AS x FROM f
  UNION ALL SELECT 'snippet', 'Snippet ' || s.title || ' in ' || path, s.text FROM sn
  UNION ALL SELECT 'symbol', 'Symbol ' || qualified_name || ' in ' || p, 'symbol: ' || qualified_name || 'kind: ' || replace(kind, '_', '') || 'signature: ' || coalesce(signature, '') || 'file: ' || p || '123' FROM sy
  UNION ALL SELECT 'code_chunk', 'CodeChunk ' || coalesce(qualified_name, '<unknown>') || ' in ' || path, 'path: ' || coalesce(path, '') || 'symbol: ' || coalesce(qualified_name, '<unknown>') || 'kind: ' || coalesce(kind, '')
    || 'signature: ' || coalesce(signature, '') || 'summary: ' || trim(coalesce(doc_summary, '')) || 'code:' || coalesce(code, '') || '123456' FROM c
    WHERE trim(coalesce(doc_summary, '')) <> '' OR trim(coalesce(signature, '')) <> '' OR trim(coalesce(code, '')) <> '')
SELECT entity_type, count(*) AS records, sum(length(x))::BIGINT AS chars, sum(length(t))::BIGINT AS title_chars FROM r GROUP BY 1""",
}
QUERIES = {"record_counts": record_counts, "file_record_template": file_record_template, "card_record_template": card_record_template}
