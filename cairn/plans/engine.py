"""A code-search index over a source tree: index, update, search, read, enrich and prepare on a versioned store."""

from __future__ import annotations

import contextlib
import json
import os
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.text import clean_strings, clean_summary, metadata_text, sanitize_tags
from cairn.operators import delta as D
from cairn.operators import bm25, graph, read, records, reports
from cairn.operators.dense import late_tokens
from cairn.plans.planner import PREWARM_QUERIES, task_query, wants_tests
from cairn.plans.progress import Progress
from cairn.plans.search import TEXT_COLUMNS, record_texts, search, without_details
from cairn.providers import Embedder, Enricher, HashEmbedder, Reranker, TemplateEnricher, embed_column, late_vectors, summarise_column
from cairn.session import broadcast_if_small, checkpoint
from cairn.sources.parse import code_chunks, symbol_facts, with_imports, with_snippets, with_symbols

from cairn.sources.scan import file_facts, read_repository
from cairn.store import VersionedStore

TABLES = ["files", "folders", "symbols", "edges", "code_chunks", "semantic_records", "late_vectors", "file_cards", "folder_cards", "repo_cards", "postings", "fts_stats"]
CARD = (
    "file_id string, summary string, role string, primary_behaviors array<string>, behavior_intents array<string>, edit_intents array<string>, retrieval_tags array<string>, "
    "ownership_kind string, owns_behaviors array<string>, delegates_to array<string>, search_phrases array<string>, "
    "key_entities array<string>, external_systems array<string>, important_symbols array<struct<symbol_id:string,name:string,role:string,behavior:string>>, "
    "imports_interpreted array<struct<target_id:string,target_path:string,why:string,dependency_kind:string>>, "
    "used_by_interpreted array<struct<target_id:string,target_path:string,why:string,dependency_kind:string>>, "
    "provenance struct<source_hash:string,input_hash:string,model:string,schema_version:int,generated_at:timestamp>"
)
FOLDER_CARD = (
    "folder_id string, summary string, responsibility string, retrieval_tags array<string>, key_entrypoints array<string>, "
    "provenance struct<source_hash:string,input_hash:string,model:string,schema_version:int,generated_at:timestamp>"
)
#: Importers that a file's card lists.
USED_BY = 64
REPO_CARD = FOLDER_CARD.replace("folder_id", "repo_root").replace("responsibility", "overview").replace("key_entrypoints", "entrypoints")


@dataclass
class Config:
    """Retrieval settings. With `primary` fts the dense stage is off unless it is asked for."""

    primary: str = "hybrid"
    dense: bool | None = None
    late: bool = True
    enrich: bool = False
    ignores: list[str] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    crate_prefixes: list[str] = field(default_factory=list)
    embed_batch: int = 64
    summary_threads: int = 6

    @property
    def dense_on(self) -> bool:
        return self.dense if self.dense is not None else self.primary != "fts"


class NotReady(RuntimeError):
    """Reads and searches before the index is ready."""


class EventLog:
    """JSON lines of what happens, and the latest state, beside the store (local path of the driver)."""

    def __init__(self, folder: str | None):
        self.folder, self.progress = folder, Progress()
        if folder:
            os.makedirs(folder, exist_ok=True)

    def event(self, name: str, **fields) -> None:
        if name == "started":
            self.progress = Progress()
        state = self.progress.at(fields.get("stage") or name if name != "failed" else name, fields.get("done", 0), fields.get("total", 0))
        if not self.folder:
            return
        row = {"ts_unix_ms": int(time.time() * 1000), "event": name, "fields": fields} | ({"progress": state} if state else {})
        with open(os.path.join(self.folder, "events.jsonl"), "a") as f:
            f.write(json.dumps(row, default=str) + "\n")
        with open(os.path.join(self.folder, "progress.json"), "w") as f:
            json.dump(row, f, default=str)

    def mark_ready(self, summary: dict | None) -> None:
        """The file READY with the summary while the index is ready; no such file otherwise."""
        path = self.folder and os.path.join(self.folder, "READY")
        if path and summary is not None:
            with open(path, "w") as f:
                json.dump(summary, f, default=str, indent=2)
        elif path and os.path.exists(path):
            os.remove(path)

    def last(self) -> dict | None:
        path = self.folder and os.path.join(self.folder, "progress.json")
        if not path or not os.path.exists(path):
            return None
        with open(path) as f:
            return json.load(f)


@contextlib.contextmanager
def prepare_lock(path: str, timeout: float = 120.0, poll: float = 0.2):
    """One preparation at a time for a store: an advisory lock on a local file, waited for up to `timeout` seconds."""
    import fcntl

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        end = time.time() + timeout
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if time.time() > end:
                    raise TimeoutError(f"another preparation holds {path}") from None
                time.sleep(poll)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class Engine:
    """The index of one repository. All tables of a change are committed as one version."""

    def __init__(
        self, spark: SparkSession, store: str, root: str, config: Config | None = None, embedder: Embedder | None = None,
        enricher: Enricher | None = None, reranker: Reranker | None = None, log: str | None = None, lock: str | None = None,
        summariser: Enricher | None = None,
    ):
        self.spark, self.root, self.config = spark, root, config or Config()
        self.store = VersionedStore(spark, store)
        self.embedder, self.enricher, self.reranker = embedder or HashEmbedder(), enricher or TemplateEnricher(), reranker
        self.log, self.lock, self.summariser = EventLog(log), lock, summariser
        self.cancelled = False

    # ---------------------------------------------------------------- building
    def parsed(self, old: DataFrame | None = None) -> DataFrame:
        """The facts of all files; those with a path and hash that `old` has are taken from there instead of parsed."""
        sources = read_repository(self.spark, self.root, ignores=self.config.ignores)
        facts = file_facts(sources).join(sources.select("path", "text"), "path")
        if old is None:
            return with_snippets(with_imports(with_symbols(facts)))
        facts = checkpoint(facts)  # one read of the tree
        known = ["path", "source_hash"]
        new = with_snippets(with_imports(with_symbols(facts.join(old.select(*known), known, "left_anti"))))
        return new.unionByName(old.join(facts.select(*known), known, "left_semi").select(*new.columns))

    def _resolved(self, files: DataFrame) -> DataFrame:
        """`files` with their imports resolved against their own paths."""
        i = files.select(F.lit("").alias("repo"), F.col("path").alias("importer"), F.explode("imports").alias("i")).select("repo", "importer", F.col("i.module").alias("module"))
        names = files.filter("name IN ('__init__.py', 'mod.rs')").select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("alias")).filter("alias <> ''").distinct()
        aliases = sorted({*self.config.aliases, os.path.basename(self.root.rstrip("/"))})
        target = graph.resolve_imports(i, files.select(F.lit("").alias("repo"), "path"), aliases, self.config.crate_prefixes, names)
        by_file = target.groupBy(F.col("importer").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("module", "target"))).alias("targets"))
        hit = lambda x: F.try_element_at("targets", x["module"])
        done = F.transform(
            "imports",
            lambda x: F.struct(x["module"].alias("module"), x["names"].alias("names"), x["line"].alias("line"), hit(x).alias("resolved_file_id"), (hit(x).isNotNull() | x["is_internal"]).alias("is_internal")),
        )
        return files.join(by_file, "path", "left").withColumn("imports", F.when(F.col("targets").isNull(), F.col("imports")).otherwise(done)).drop("targets")

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """Records with embeddings; file facts have none, and with dense off nothing has."""
        if not self.config.dense_on:
            return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        text = F.when(~F.col("record_id").startswith("semantic:file:"), records.embedding_input(F.col("title"), F.col("path"), F.col("content")))
        return embed_column(rows.withColumn("__text", text), "__text", self.embedder, self.config.embed_batch).drop("__text")

    def _late(self, rows: DataFrame) -> DataFrame:
        if not (self.config.dense_on and self.config.late):
            return self.spark.createDataFrame([], "record_id string, ordinal int, token string, weight double, embedding array<float>")
        return late_vectors(late_tokens(rows), self.embedder).withColumn("ordinal", F.col("ordinal").cast("int"))

    def file_cards(self, files: DataFrame, symbols: DataFrame, every: DataFrame | None = None) -> DataFrame:
        """A card for each of `files`: everything but the summary follows from the facts. Importers are looked up in `every`
        file (default: the same)."""
        item = "symbol_id:string,name:string,qualified_name:string,kind:string,signature:string"
        names = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", *(x.split(":")[0] for x in item.split(","))))).alias("s"))
        edges = (files if every is None else every).select("file_id", "path", F.explode("imports").alias("i")).filter("i.resolved_file_id IS NOT NULL")
        w = Window.partitionBy("to").orderBy("file_id")
        used = edges.select(F.col("i.resolved_file_id").alias("to"), "file_id", "path", F.col("i.module").alias("module")).dropDuplicates(["to", "file_id"])
        # a file that a third of all import lists its first importers only; the rank limit works before anything is gathered
        used = used.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= USED_BY)
        shown = F.struct(F.col("file_id").alias("target_id"), F.col("path").alias("target_path"), F.format_string("%s imports %s via %s.", "path", "to", "module").alias("why"), F.lit("imported_by").alias("dependency_kind"))
        used = used.groupBy(F.col("to").alias("file_id")).agg(F.array_sort(F.collect_list(shown)).alias("used"))
        empty_used = F.array().cast("array<struct<target_id:string,target_path:string,why:string,dependency_kind:string>>")
        rows = files.join(names, "file_id", "left").join(used, "file_id", "left").withColumn("s", F.coalesce("s", F.array().cast(f"array<struct<start_line:int,{item}>>"))).withColumn("used", F.coalesce("used", empty_used))
        short, full = F.transform("s", lambda x: x["name"]), F.transform("s", lambda x: x["qualified_name"])
        prompt = F.to_json(F.struct("path", "language", F.slice(full, 1, 24).alias("names"), F.transform("snippets", lambda x: x["text"]).alias("snippets")))
        rows = summarise_column(rows.select("file_id", "path", "name", "language", "source_hash", "imports", "s", "used", prompt.alias("prompt"), short.alias("short"), full.alias("full")), "prompt", self.enricher)
        tags = F.concat(F.array(F.lit("entity:file"), F.concat(F.lit("language:"), "language"), F.concat(F.lit("path:"), F.replace("path", F.lit("/"), F.lit("-")))), F.transform("short", lambda x: F.concat(F.lit("symbol:"), x)))
        targets = F.filter(F.transform("imports", lambda x: x["resolved_file_id"]), lambda x: x.isNotNull())
        none = F.array().cast("array<string>")
        why = lambda x: F.struct(
            x["resolved_file_id"].alias("target_id"), x["resolved_file_id"].alias("target_path"), F.concat(F.lit("resolved internal import "), x["module"]).alias("why"), F.lit("imports").alias("dependency_kind")
        )
        important = lambda x: F.struct(x["symbol_id"].alias("symbol_id"), x["name"].alias("name"), x["kind"].alias("role"), x["signature"].alias("behavior"))
        structure = [
            clean_strings(F.flatten(F.transform("s", lambda x: F.array(x["name"], x["qualified_name"]))), 32).alias("key_entities"),
            clean_strings(F.transform(F.filter("imports", lambda x: ~x["is_internal"]), lambda x: x["module"]), 24).alias("external_systems"),
            F.transform(F.slice("s", 1, 24), important).alias("important_symbols"),
            F.array_distinct(F.transform(F.filter("imports", lambda x: x["resolved_file_id"].isNotNull()), why)).alias("imports_interpreted"),
            F.col("used").alias("used_by_interpreted"),
        ]
        return rows.select(
            "file_id", "summary", F.concat("language", F.lit(" source file")).alias("role"), none.alias("primary_behaviors"), none.alias("behavior_intents"), none.alias("edit_intents"),
            sanitize_tags(tags, 32).alias("retrieval_tags"), F.lit("unknown").alias("ownership_kind"), none.alias("owns_behaviors"), F.array_distinct(targets).alias("delegates_to"),
            F.slice(F.array_distinct(F.concat(F.array("path", "name"), "full")), 1, 32).alias("search_phrases"), *structure,
            F.struct(F.col("source_hash"), F.sha2("prompt", 256).alias("input_hash"), F.lit(self.enricher.name).alias("model"), F.lit(1).alias("schema_version"), F.current_timestamp().alias("generated_at")).alias("provenance"),
        )

    def folder_cards(self, folder_rows: DataFrame, cards: DataFrame, existing: DataFrame | None = None, affected: DataFrame | None = None) -> DataFrame:
        """Folder cards bottom up: the deepest folders first, so that a parent is made from its files' cards and the cards
        that its child folders have just got. With `affected` (folder_id) only these are made again, and `existing` cards
        stand for their other children and are returned with the new ones.

        A level of depth is one stage; there are as many as the tree is deep.
        """
        depth = F.when(F.col("folder_id") == "repo", 0).otherwise(F.size(F.split("folder_id", "/")))
        todo = folder_rows if affected is None else folder_rows.join(affected.toDF("folder_id").distinct(), "folder_id", "left_semi")
        todo = checkpoint(todo.withColumn("__depth", depth))
        files = cards.select(F.col("file_id").alias("kid"), F.col("provenance.source_hash").alias("h"), F.col("retrieval_tags").alias("t"), F.lit(True).alias("file"))
        made = None
        rest = None if existing is None else existing.join(todo.select("folder_id"), "folder_id", "left_anti")
        for level in sorted((r[0] for r in todo.select("__depth").distinct().collect()), reverse=True):
            folders = [x for x in (made, rest) if x is not None]
            kids = files
            for x in folders:
                kids = kids.unionByName(x.select(F.col("folder_id").alias("kid"), F.col("provenance.source_hash").alias("h"), F.col("retrieval_tags").alias("t"), F.lit(False).alias("file")))
            rows = todo.filter(F.col("__depth") == level)
            pairs = rows.select("folder_id", F.explode("child_file_ids").alias("kid"), F.lit(True).alias("file")).unionByName(rows.select("folder_id", F.explode("child_folder_ids").alias("kid"), F.lit(False).alias("file")))
            new = checkpoint(self._folder_level(pairs.join(kids, ["kid", "file"])))
            made = new if made is None else made.unionByName(new)
        parts = [x for x in (made, rest) if x is not None]
        return reduce(DataFrame.unionByName, parts) if parts else self._empty(FOLDER_CARD)

    def _folder_level(self, kids: DataFrame) -> DataFrame:
        """Cards of (folder_id, kid, file, h, t): joined hashes, merged tags (24) and entry points, which are files."""
        rows = kids.groupBy("folder_id").agg(F.array_sort(F.collect_list(F.struct(F.col("kid").alias("id"), "h", "t", "file"))).alias("k"))
        own = F.filter("k", lambda x: x["file"])
        rows = rows.withColumn("prompt", F.to_json(F.struct(F.col("folder_id").alias("path"), F.transform("k", lambda x: x["id"]).alias("names"))))
        rows = summarise_column(rows, "prompt", self.enricher)
        tags = F.concat(F.array(F.lit("entity:folder")), F.flatten(F.transform("k", lambda x: F.filter(x["t"], lambda t: ~t.isin("entity:file", "entity:folder")))))
        count = F.concat(F.size(own).cast("string"), F.lit(" files, "), (F.size("k") - F.size(own)).cast("string"), F.lit(" folders"))
        return rows.select(
            "folder_id", "summary", count.alias("responsibility"), sanitize_tags(tags, 24).alias("retrieval_tags"),
            F.slice(F.transform(own, lambda x: x["id"]), 1, 16).alias("key_entrypoints"),
            F.struct(F.array_join(F.transform("k", lambda x: x["h"]), ":").alias("source_hash"), F.sha2("prompt", 256).alias("input_hash"), F.lit(self.enricher.name).alias("model"), F.lit(1).alias("schema_version"), F.current_timestamp().alias("generated_at")).alias("provenance"),
        )

    def repo_card(self, folder_cards: DataFrame) -> DataFrame:
        # the folders of the first level stand for those below them, from which their cards were made
        top = folder_cards.filter(~F.col("folder_id").contains("/")).agg(F.array_sort(F.collect_list("folder_id")).alias("k"), F.first("provenance.source_hash").alias("h"))
        rows = summarise_column(top.withColumn("prompt", F.to_json(F.struct(F.lit(self.root).alias("path"), F.col("k").alias("names")))), "prompt", self.enricher)
        return rows.filter(F.size("k") > 0).select(
            F.lit(self.root).alias("repo_root"), "summary", F.array_join("k", ", ").alias("overview"), F.array(F.lit("entity:repo")).alias("retrieval_tags"), F.slice("k", 1, 16).alias("entrypoints"),
            F.struct(F.col("h").alias("source_hash"), F.sha2("prompt", 256).alias("input_hash"), F.lit(self.enricher.name).alias("model"), F.lit(1).alias("schema_version"), F.current_timestamp().alias("generated_at")).alias("provenance"),
        )

    def _records(self, files, symbols, chunks, cards, folder_cards, repo_cards) -> DataFrame:
        out = records.file_records(files)
        for more in (records.snippet_records(files), records.symbol_records(symbols, files), records.chunk_records(chunks), records.card_records(cards, "file_card"), records.card_records(folder_cards, "folder_card"), records.card_records(repo_cards, "repo_card")):
            out = out.unionByName(more)
        return out

    def _same(self, rows: DataFrame, old: dict | None) -> DataFrame | None:
        """(record_id, embedding) of the old records whose text is that of `rows`."""
        if old is None:
            return None
        text = F.xxhash64(F.coalesce("title", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce(metadata_text("metadata"), F.lit(""))).alias("__text")
        return rows.select("record_id", text).join(old["semantic_records"].select("record_id", text, "embedding"), ["record_id", "__text"]).select("record_id", "embedding")

    def _write_records(self, v, rows: DataFrame, old: dict | None = None) -> None:
        """Records, late vectors and full-text postings of `rows`; those of records that did not change are taken over from
        `old`, so only new and changed texts are embedded and tokenised."""
        if old is None:
            v.write("semantic_records", self._embedded(rows))
            fresh = v.reread("semantic_records")
            v.write("late_vectors", self._late(fresh))
            self._write_postings(v, bm25.index_rows(record_texts(fresh), "record_id", TEXT_COLUMNS))
            return
        rows = checkpoint(rows)
        same = checkpoint(self._same(rows, old))
        ids = broadcast_if_small(same.select("record_id"))
        fresh = checkpoint(self._embedded(rows.join(ids, "record_id", "left_anti")))
        v.write("semantic_records", fresh.unionByName(rows.join(same, "record_id")))
        v.write("late_vectors", old["late_vectors"].join(ids, "record_id", "left_semi").unionByName(self._late(fresh)))
        kept = old["postings"].join(same.select(F.col("record_id").alias("id")), "id", "left_semi")
        self._write_postings(v, kept.unionByName(bm25.index_rows(record_texts(fresh), "record_id", TEXT_COLUMNS)))
        self.log.event("embedded", fresh=fresh.count(), kept=same.count())

    def _write_postings(self, v, rows: DataFrame) -> None:
        """The stored index, sorted by term so that a search reads the row groups of its terms; `term` is null in the row
        that each record has for its length."""
        v.write("postings", rows.repartitionByRange("term").sortWithinPartitions("term", "id"))
        v.write("fts_stats", v.reread("postings").filter("term IS NULL").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")))

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _check(self) -> None:
        if self.cancelled:
            raise InterruptedError("cancelled")

    def _write(self, parsed: DataFrame, cards: DataFrame | None, folder_cards: DataFrame | None, repo_cards: DataFrame | None, enrich: bool, old: dict | None = None) -> None:
        with self.store.commit() as v:
            v.write("files", self._resolved(parsed))
            files = v.reread("files")
            self.log.event("read", stage="parsing")
            self._check()
            v.write("symbols", symbol_facts(files))
            v.write("folders", graph.folders(files))
            v.write("code_chunks", self._chunks(code_chunks(files), old))
            symbols, folder_rows, chunks = (v.reread(n) for n in ("symbols", "folders", "code_chunks"))
            i = files.select(F.col("file_id").alias("source_id"), F.explode("imports").alias("i")).select("source_id", F.col("i.resolved_file_id").alias("target_id"), F.col("i.module").alias("module")).distinct()
            v.write("edges", graph.edges(folder_rows, i))
            self._check()
            v.write("file_cards", self.file_cards(files, symbols) if enrich else (cards if cards is not None else self._empty(CARD)))
            made = v.reread("file_cards")
            v.write("folder_cards", self.folder_cards(folder_rows, made) if enrich else (folder_cards if folder_cards is not None else self._empty(FOLDER_CARD)))
            v.write("repo_cards", self.repo_card(v.reread("folder_cards")) if enrich else (repo_cards if repo_cards is not None else self._empty(REPO_CARD)))
            self._check()
            self._write_records(v, self._records(files, symbols, chunks, made, v.reread("folder_cards"), v.reread("repo_cards")), old)
            v.write("invalidation_queue", old["marks"] if old else self._empty("entity_id string, entity_kind string, reason string"))

    def _summarised(self, chunks: DataFrame) -> DataFrame:
        """Chunks without documentation or summary with one from the summariser, many requests at once in a task."""
        if self.summariser is None:
            return chunks
        todo = F.col("summary_source") == "empty"
        prompt = F.to_json(F.struct("path", "kind", "qualified_name", "signature", "code"))
        made = summarise_column(chunks.filter(todo).withColumn("__prompt", prompt), "__prompt", self.summariser, "__said", self.config.summary_threads).drop("__prompt")
        said = F.nullif(clean_summary("__said"), F.lit(""))
        made = made.withColumn("generated_summary", said).withColumn("summary_source", F.when(said.isNotNull(), "llm").otherwise("empty"))
        return made.select(*chunks.columns).unionByName(chunks.filter(~todo))

    def _chunks(self, chunks: DataFrame, old: dict | None) -> DataFrame:
        """Chunks with the generated summaries of equal (chunk_id, source_hash) kept, and others made."""
        return self._summarised(self._kept_summaries(chunks, old))

    def _kept_summaries(self, chunks: DataFrame, old: dict | None) -> DataFrame:
        if old is None:
            return chunks
        kept = old["code_chunks"].filter("generated_summary IS NOT NULL").select("chunk_id", "source_hash", F.col("generated_summary").alias("g"))
        merged = chunks.join(kept, ["chunk_id", "source_hash"], "left")
        fresh = (F.col("summary_source") == "empty") & F.col("g").isNotNull()
        return merged.withColumn("generated_summary", F.when(fresh, F.col("g"))).withColumn("summary_source", F.when(fresh, "llm").otherwise(F.col("summary_source"))).select(*chunks.columns)

    # ---------------------------------------------------------------- commands
    def index(self, enrich: bool | None = None) -> dict:
        """Build everything from the source tree."""
        self.log.event("started", command="index")
        try:
            self._write(self.parsed(), None, None, None, self.config.enrich if enrich is None else enrich)
        except Exception as e:
            self.log.event("failed", stage="parsing" if self.store.current() == 0 else "indexing", error=str(e)[:500])
            raise
        self.log.event("finished", command="index")
        return self.summary()

    def update(self) -> dict:
        """Bring the index up to date; an unchanged tree writes nothing. Cards of changed files and their folders go."""
        if not self.store.current():
            return self.index() | {"changed": None}
        old = {n: self.store.read(n) for n in TABLES}
        found = checkpoint(self.parsed(old["files"]))  # only changed texts are parsed, once
        parsed = checkpoint(self._resolved(found))
        change = D.snapshot_delta(old["files"], parsed)
        if change.is_noop():
            return self.summary() | {"changed": 0}
        changed = change.changes.count()
        old["marks"] = D.invalidations(change)
        cards = D.delete_by_key(old["file_cards"], change.affected_files.select("id").unionByName(change.changes.select(F.col("file_id").alias("id"))), "file_id")
        folder_cards = D.delete_by_key(old["folder_cards"], change.affected_folders, "folder_id")
        repo_cards = old["repo_cards"] if not change.repo_card_stale.first()[0] else old["repo_cards"].limit(0)
        self._write(found, cards, folder_cards, repo_cards, self.config.enrich, old)
        self.log.event("finished", command="update", changed=changed)
        return self.summary() | {"changed": changed}

    def enrich_once(self, max_files: int = 1) -> dict:
        """Make cards for the next files by path whose card is missing, stale or empty; commits what it made."""
        t = {n: self.store.read(n) for n in TABLES}
        states = reports.enrichment_targets(t["files"], t["file_cards"].withColumn("card_id", F.lit(0)), t["semantic_records"], max_files)
        ids = [r[0] for r in states.collect()]
        if not ids:
            return {"enriched": 0}
        some = t["files"].filter(F.col("file_id").isin(ids))
        fresh = self.file_cards(some, t["symbols"].join(some.select("file_id"), "file_id", "left_semi"), t["files"])
        with self.store.commit() as v:
            v.write("file_cards", D.delete_by_key(t["file_cards"], some.select("file_id"), "file_id").unionByName(fresh))
            made = v.reread("file_cards")
            fresh_records = records.card_records(made.filter(F.col("file_id").isin(ids)), "file_card")
            keys = fresh_records.select("record_id")
            rows = D.delete_by_key(t["semantic_records"].drop("embedding"), keys, "record_id").unionByName(fresh_records)
            self._write_records(v, rows, t)
        return {"enriched": len(ids), "files": ids}

    def prune(self) -> dict:
        """Drop what has lost its owner: cards, records, full-text rows, late vectors and chunks; commits only if there is any."""
        names = {"files": "files", "folders": "folders", "symbols": "symbols", "file_cards": "file_cards", "folder_cards": "folder_cards", "repo_cards": "repo_cards", "code_chunks": "code_chunks", "semantic_records": "semantic_records", "late_vectors": "late_vectors", "fts_records": "postings"}
        kept, counts = D.prune({k: self.store.read(n) for k, n in names.items()})
        gone = counts.first().asDict()
        if any(gone.values()):
            with self.store.commit() as v:
                for k in D.PRUNED:
                    if gone[k]:
                        v.write(names[k], kept[k])
                if gone["fts_records"]:
                    rows = v.reread("postings").filter("term IS NULL")
                    v.write("fts_stats", rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")))
        return gone

    def missing_records(self) -> DataFrame:
        """(record_id): records that the facts and cards call for and that are not there."""
        t = {n: self.store.read(n) for n in TABLES}
        want = self._records(t["files"], t["symbols"], t["code_chunks"], t["file_cards"], t["folder_cards"], t["repo_cards"]).select("record_id").distinct()
        return want.join(t["semantic_records"].select("record_id"), "record_id", "left_anti")

    def repair(self) -> dict:
        """Make the records that are missing, with their vectors and postings; others stay as they are."""
        missing = self.missing_records().count()
        if missing:
            t = {n: self.store.read(n) for n in TABLES}
            with self.store.commit() as v:
                self._write_records(v, self._records(t["files"], t["symbols"], t["code_chunks"], t["file_cards"], t["folder_cards"], t["repo_cards"]), t)
        return {"repaired": missing}

    def rebuild_semantic(self) -> dict:
        """Derive all records, embeddings and late vectors again from facts and cards."""
        t = {n: self.store.read(n) for n in TABLES}
        with self.store.commit() as v:
            self._write_records(v, self._records(t["files"], t["symbols"], t["code_chunks"], t["file_cards"], t["folder_cards"], t["repo_cards"]))
        return self.summary()

    def prepare(self, queries: list[str] | None = None, limit: int = 6) -> dict:
        """Index or update under a lock, rebuild the retrieval tables if they are not ready, warm up, and mark as ready."""
        with prepare_lock(self.lock) if self.lock else contextlib.nullcontext():
            action = "update" if self.store.current() else "index"
            self.log.event("prepare", action=action)
            self.update()
            if self.retrieval_ready() and self.repair()["repaired"]:
                action = "repair"
            if not self.retrieval_ready():
                self.rebuild_semantic()
                action = "rebuild_search"
            self.log.event("prewarm")
            hits = self.prewarm(queries, limit)
            pruned = self.prune()
            ready = self.retrieval_ready()
            out = {"action": action, "status": "ready" if ready else "needs_attention", "prewarm": hits, "pruned": pruned, **self.summary()}
            self.log.mark_ready(out if ready else None)
            self.log.event("ready" if ready else "needs_attention", **out)
            return out

    def prewarm(self, queries: list[str] | None = None, limit: int = 6) -> dict[str, int]:
        return {q: self.search(q, limit).count() for q in (PREWARM_QUERIES if queries is None else queries)}

    # ---------------------------------------------------------------- answers
    def stats(self) -> dict:
        return reports.retrieval_stats(self.store.read("semantic_records"), self.store.read("late_vectors")).first().asDict()

    def retrieval_ready(self) -> bool:
        return bool(self.store.current()) and reports.retrieval_ready(self.stats(), self.config.dense_on, self.config.late)

    def _gate(self) -> None:
        if not self.retrieval_ready():
            last = self.log.last()
            raise NotReady("the index is not ready" + (f"; last event: {last['event']} {last['fields']}" if last else ""))

    def summary(self) -> dict:
        counts = {n: self.store.read(n).count() for n in ("files", "folders", "symbols", "code_chunks", "file_cards")}
        return counts | self.stats() | {"primary": self.config.primary, "dense": self.config.dense_on}

    def search(self, query: str, limit: int = 8, granularity: str = "file", compact: bool = False) -> DataFrame:
        self._gate()
        t = {n: self.store.read(n) for n in ("semantic_records", "late_vectors", "file_cards")}
        hits = search(t["semantic_records"], query, limit, granularity, t["late_vectors"] if self.config.late else None, t["file_cards"], self.embedder, self.reranker, self.config.dense_on, (self.store.read("postings"), self.store.read("fts_stats")))
        return without_details(hits) if compact else hits

    def op(self, task: str, query: str, limit: int = 8) -> DataFrame:
        """A search by task: find-symbol, find-behavior, edit-target, trace-dependency, architecture, tests-for, read-next."""
        return self.search(task_query(task, query), limit)

    def _views(self) -> DataFrame:
        cards = self.store.read("file_cards").withColumnRenamed("role", "role_text").withColumn("card_id", F.lit(0))
        return read.read_cards(self.store.read("files"), self.store.read("symbols"), cards)

    def read(self, file_id: str, chunks: bool = False) -> DataFrame:
        """The read view of one file; with `chunks` its chunks instead of the symbol outline."""
        self._gate()
        view = self._views().filter(F.col("file_id") == file_id)
        if view.isEmpty():
            raise KeyError(f"unknown file id {file_id}")
        if not chunks:
            return view
        c = reports.chunk_dump(self.store.read("code_chunks").filter(F.col("file_id") == file_id))
        c = c.agg(F.array_sort(F.collect_list(F.struct("lines", "qualified_name", "kind", "summary_source", "summary"))).alias("chunks"))
        return view.withColumn("symbols", F.array().cast("array<string>")).crossJoin(c)

    def read_bundle(self, query: str, task: str = "read-next", limit: int = 4, related: int = 3, mode: str = "brief") -> DataFrame:
        """Packed views of the best file for a task and of its most related files, in that order."""
        hits = self.op(task, query, max(limit + related, 8)).select("path").collect()
        known = {r[0] for r in self.store.read("files").filter(F.col("file_id").isin([h[0] for h in hits])).select("file_id").collect()}
        paths = [h[0] for h in hits if h[0] in known]
        if not paths:
            return read.pack(self._views().limit(0), mode).withColumn("pos", F.lit(0))
        others = self.spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "file_id string, pos int")
        near = [r[0] for r in read.related_rank(others, paths[0], related, wants_tests(query)).collect()]
        order = [paths[0], *near][:limit]
        ranks = F.create_map(*[F.lit(x) for i, p in enumerate(order) for x in (p, i)])
        return read.pack(self._views().filter(F.col("file_id").isin(order)), mode).withColumn("pos", ranks[F.col("file_id")]).orderBy("pos")

    def cards(self, empty_only: bool = False) -> DataFrame:
        rows = reports.card_listing(self.store.read("file_cards"), self.store.read("folder_cards"), self.store.read("repo_cards"))
        return rows.filter("is_empty") if empty_only else rows

    def chunks(self, source: str | None = None, with_code: bool = False) -> DataFrame:
        return reports.chunk_dump(self.store.read("code_chunks"), source, with_code)

    def status(self) -> DataFrame:
        cards = self.store.read("file_cards").withColumn("card_id", F.lit(0))
        return reports.readiness_report(self.store.read("files"), cards, self.store.read("semantic_records"), self.store.read("code_chunks"))


