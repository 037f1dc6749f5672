import os
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from cairn.operators.graph import candidates, resolve_imports
from cairn.plans.engine import Config, Engine, NotReady, prepare_lock
from cairn.operators.reports import card_markdown
from cairn.plans.progress import Progress, ratio
from cairn.plans.search import search
from cairn.providers import ChatEnricher, ChatReranker, Endpoint, EndpointEmbedder, EndpointReranker, HashEmbedder, LexicalReranker, json_from_text
from cairn.sources.parse import parse_symbols
from cairn.sources.scan import is_ignored, list_paths, read_repository
from cairn.store import VersionedStore, upsert

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "mini_repo")


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(FIXTURE, root)
    return root


def read(path):
    with open(os.path.join(FIXTURE, path)) as f:
        return f.read()


def test_symbols_of_each_language():
    short = lambda lang, path: [(s["qualified_name"], s["kind"], s["start_line"], s["end_line"], s["doc"]) for s in parse_symbols(lang, read(path))]
    assert short("python", "src/auth/middleware.py") == [("verify_token", "function", 4, 6, "Checks a token against the provider key of the environment.")]
    assert short("rust", "src/watcher.rs") == [
        ("Watcher", "struct", 3, 5, None), ("Watcher::poll_once", "method", 10, 13, "Polls the tree once and returns the batch."), ("Alias", "type_alias", 16, 16, None),
    ]
    assert short("typescript", "web/client.ts") == [
        ("Client", "class", 3, 8, None), ("Client::send", "method", 5, 7, "Sends one request and waits."), ("build", "function", 11, 13, "Builds what the caller asked for."),
        ("PROMPT", "constant", 14, 14, None), ("Shape", "interface", 15, 15, None),
    ]
    assert [s["qualified_name"] for s in parse_symbols("python", "class A:\n    def f(self):\n        pass\n  bad(\n")] == ["A", "A::f"]
    assert parse_symbols("python", "") == [] and parse_symbols("go", "func f() {}") == []


def test_scan_rules(spark, repo):
    assert is_ignored("a/node_modules/b.ts") and is_ignored("packages/web/a.ts", ["packages/web"]) and is_ignored("x/tests/a.py", ["tests"]) and not is_ignored("packages/webx/a.ts", ["packages/web"])
    (repo / "target").mkdir()
    (repo / "target" / "gen.rs").write_text("fn f() {}")
    (repo / "bad.py").write_bytes(b"\xff\xfe x")
    (repo / "notes.md").write_text("no")
    assert list_paths(str(repo), ignores=["web"]) == ["bad.py", "src/auth/middleware.py", "src/config/env.py", "src/watcher.rs"]
    rows = {r["path"]: r["corrupt"] for r in read_repository(spark, str(repo), ignores=["web"]).collect()}
    assert rows == {"bad.py": True, "src/auth/middleware.py": False, "src/config/env.py": False, "src/watcher.rs": False}
    with pytest.raises(FileNotFoundError):
        list_paths(str(repo / "none"))


def test_import_resolution(spark):
    files = spark.createDataFrame([("", p) for p in ["pkg/a.py", "pkg/sub/__init__.py", "src/b.ts", "util/mod.rs", "store-x/src/lib.rs", "__init__.py"]], "repo string, path string")
    asked = [("pkg/m.py", ".a"), ("pkg/m.py", "pkg.sub"), ("src/m.ts", "./b"), ("x.rs", "crate.util"), ("x.rs", "my_store_x.thing"), ("pkg/sub/m.py", "..a"), ("pkg/m.py", "os"), ("x.py", "sub"), ("x.py", "sub.pkg.a")]
    imports = spark.createDataFrame([("", a, m) for a, m in asked], "repo string, importer string, module string")
    got = {(r["importer"], r["module"]): r["target"] for r in resolve_imports(imports, files, ["sub"], ["my_"]).collect()}
    assert got[("pkg/m.py", ".a")] == "pkg/a.py" and got[("pkg/m.py", "pkg.sub")] == "pkg/sub/__init__.py" and got[("x.rs", "crate.util")] == "util/mod.rs"
    assert got[("x.rs", "my_store_x.thing")] == "store-x/src/lib.rs" and got[("pkg/sub/m.py", "..a")] == "pkg/a.py" and got[("pkg/m.py", "os")] is None
    assert got[("x.py", "sub")] == "__init__.py" and got[("x.py", "sub.pkg.a")] == "pkg/a.py"
    assert spark.range(1).select(candidates(F.lit("a"))).first()[0][0] == "a.py"


def test_index_search_enrich_and_update(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), str(repo), Config(primary="fts"), HashEmbedder(), log=str(tmp_path / "log"))
    with pytest.raises(NotReady):
        engine.search("token")
    engine.index()
    assert engine.search("where is verify_token defined", 4).first()["path"] == "src/auth/middleware.py"
    assert engine.enrich_once(1)["files"] == ["src/auth/middleware.py"]
    view = engine.read("src/auth/middleware.py").first()
    assert view["summary"] == "src/auth/middleware.py handles verify_token" and view["depends_on"] == ["src/config/env.py"]
    (repo / "src/watcher.rs").unlink()
    assert engine.update()["files"] == 3
    assert engine.search("verify_token", 1).first()["path"] == "src/auth/middleware.py"
    assert engine.store.read("postings").filter("term = 'debounce' OR id LIKE '%watcher%'").count() == 0
    assert engine.store.read("semantic_records").filter("path = 'src/watcher.rs'").count() == 0


class CountingEmbedder(HashEmbedder):
    """Writes a line for every text that it embeds."""

    def __init__(self, path):
        super().__init__(8)
        self.path = path

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(f"{t!r}\n" for t in texts))
        return super().embed(texts)


def test_an_update_embeds_only_what_changed(spark, repo, tmp_path):
    counted = str(tmp_path / "texts")
    engine = Engine(spark, str(tmp_path / "store"), str(repo), Config(late=False), CountingEmbedder(counted), log=str(tmp_path / "log"))
    engine.index()
    before = {r["record_id"]: r["embedding"] for r in engine.store.read("semantic_records").collect()}
    open(counted, "w").close()
    assert engine.update()["changed"] == 0 and open(counted).read() == ""
    (repo / "src/config/env.py").write_text("def obsolete_marker():\n    return 1\n")
    assert engine.update()["changed"] == 1
    texts = open(counted).read().splitlines()
    assert 0 < len(texts) <= 4 and all("src/config/env.py" in t for t in texts)
    after = {r["record_id"]: r["embedding"] for r in engine.store.read("semantic_records").collect()}
    assert all(before[k] == after[k] for k in before if "env.py" not in k) and len(after) == len(before)
    stats = engine.store.read("fts_stats").first()
    assert stats["n"] == len(after) and engine.store.read("postings").select("id").distinct().count() == len(after)


def test_life_of_an_index(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), str(repo), Config(), HashEmbedder(), log=str(tmp_path / "log"), lock=str(tmp_path / "lock"))
    with pytest.raises(NotReady):
        engine.search("token")
    out = engine.prepare(["token"])
    assert (out["status"], out["files"], out["file_cards"], out["code_chunks"]) == ("ready", 4, 0, 8) and out["records"] > 10 and out["late_vectors"] > 0
    hits = engine.search("where is verify_token defined", 4).collect()
    assert hits[0]["path"] == "src/auth/middleware.py" and any("Full-text" in w for w in hits[0]["why_matched"]) and any("Late-interaction" in w for w in hits[0]["why_matched"])
    assert [r["score"] for r in hits] == sorted((r["score"] for r in hits), reverse=True)
    symbol = engine.search("where is verify_token defined", 3, "symbol", compact=True)
    assert "why_matched" not in symbol.columns and symbol.first()["entity_id"].endswith("verify_token:4")
    # enrichment goes file by file in order of path, and ends
    assert engine.enrich_once(1)["files"] == ["src/auth/middleware.py"] and engine.enrich_once(9)["enriched"] == 3 and engine.enrich_once(1)["enriched"] == 0
    view = engine.read("src/auth/middleware.py").first()
    assert view["summary"] == "src/auth/middleware.py handles verify_token" and view["depends_on"] == ["src/config/env.py"]
    assert engine.read("src/config/env.py").first()["dependents"] == ["src/auth/middleware.py"]
    assert len(engine.read("web/client.ts", chunks=True).first()["chunks"]) == 4
    with pytest.raises(KeyError):
        engine.read("none.py")
    assert engine.read_bundle("token provider", mode="edit").count() >= 1
    # an unchanged tree is a no-op; an edit drops the card of the file, a removal everything of it
    version = engine.store.current()
    assert engine.update()["changed"] == 0 and engine.store.current() == version
    (repo / "src/config/env.py").write_text("def obsolete_marker():\n    return 1\n")
    (repo / "src/watcher.rs").unlink()
    out = engine.update()
    assert out["changed"] == 2 and out["files"] == 3
    assert {r["entity_id"] for r in engine.cards().filter("kind = 'file'").collect()} == {"web/client.ts"}
    assert engine.store.read("semantic_records").filter("path = 'src/watcher.rs'").count() == 0
    assert engine.store.read("invalidation_queue").filter("entity_id = 'src/watcher.rs'").count() == 1
    assert engine.search("obsolete_marker", 1).first()["path"] == "src/config/env.py"
    assert engine.chunks("empty").count() > 0 and engine.status().first()["status"] == "partial"


def test_a_cancelled_build_commits_nothing(spark, repo, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), str(repo), Config(primary="fts"), log=str(tmp_path / "log"))
    engine.cancelled = True
    with pytest.raises(InterruptedError):
        engine.index()
    assert engine.store.current() == 0 and engine.log.last()["event"] == "failed"


def test_search_without_dense_or_matches(spark):
    rows = [
        ("semantic:file_card:src/lib.rs", "src/lib.rs", "file", "FileCard src/lib.rs", "summary: import resolution entry", "src/lib.rs", None, {"kind": "file_card", "ownership_kind": "facade", "edit_intents": '["fix import resolution"]'}),
        ("semantic:file_card:src/resolver.rs", "src/resolver.rs", "file", "FileCard src/resolver.rs", "summary: import resolution", "src/resolver.rs", None, {"kind": "file_card", "ownership_kind": "implementation", "owns_behaviors": '["resolve imports"]'}),
    ]
    df = spark.createDataFrame(rows, "record_id string, entity_id string, entity_type string, title string, content string, path string, embedding array<float>, metadata map<string,string>")
    hits = search(df, "where should I edit import resolution", 5, "record", reranker=LexicalReranker()).collect()
    assert [h["path"] for h in hits] == ["src/resolver.rs", "src/lib.rs"]
    assert any("de-prioritized" in w for w in hits[1]["why_matched"]) and any("Reranker" in w for w in hits[0]["why_matched"])
    entry = search(df, "public api exports of import", 5, "record").collect()
    assert entry[0]["path"] == "src/lib.rs"
    assert search(df.limit(0), "anything", 5).collect() == []
    with pytest.raises(ValueError):
        search(df, "x", 5, "folder")


def test_store_versions_and_upsert(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    with store.commit() as v:
        v.write("t", base)
    with store.commit() as v:
        store.upsert("t", spark.createDataFrame([(2, "c"), (None, "m")], "k long, v string"), ["k"], v)
    assert store.current() == 2 and sorted(r["v"] for r in store.read("t").collect()) == ["a", "c", "m"] and store.read("t", 1).count() == 3
    assert upsert(base.limit(0), base, ["k"]).count() == 3


def test_lock_waits_and_times_out(tmp_path):
    path, order = str(tmp_path / "lock"), []
    with prepare_lock(path):
        with pytest.raises(TimeoutError):
            with prepare_lock(path, timeout=0.1, poll=0.02):
                pass
        other = threading.Thread(target=lambda: [order.append("x") for _ in range(1)])
        other.start()
        other.join()
    with prepare_lock(path, timeout=1):
        order.append("y")
    assert order == ["x", "y"]


def test_clients_with_a_fake_server():
    calls = []

    def send(url, body, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("down")
        if url.endswith("embeddings"):
            return {"data": [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": [3.0, 4.0]}]}
        if url.endswith("rerank"):
            return {"results": [{"index": 1, "relevance_score": 1.7}]}
        return {"choices": [{"message": {"content": 'text {"summary": " ok "} more'}}]}

    e = Endpoint("http://x/", send=send, pause=0)
    assert EndpointEmbedder(e, "m").embed(["a", "b"]) == [[0.6, 0.8], [0.0, 1.0]]
    assert EndpointReranker(e, "m").rerank("q", ["a", "b"]) == [0.0, 1.0]
    asked = []
    scored = Endpoint("http://x", send=lambda url, body, timeout: asked.append(body) or {"choices": [{"message": {"content": '{"scores": [{"index": 1, "score": 7}, {"index": 9, "score": 1}]}'}}]})
    assert ChatReranker(scored, "m").rerank("q", ["a", "b"]) == [0.0, 1.0] and asked[0]["response_format"]["json_schema"]["strict"]
    assert ChatReranker(scored, "m").rerank("q", []) == []
    assert ChatEnricher(e, "m").summarise({}) == "ok" and json_from_text("none") == {} and json_from_text("[1]") == {"items": [1]}


def test_more_packages_than_a_thousand_resolve(spark, tmp_path):
    packages = [f"p{i:04}" for i in range(1100)]
    schema = "path string, name string, imports array<struct<module:string,names:array<string>,line:int,resolved_file_id:string,is_internal:boolean>>"
    rows = [(f"lib/{p}/__init__.py", "__init__.py", []) for p in packages] + [("x.py", "x.py", [(f"{p}.x", [], 1, None, False) for p in packages] + [("q.x", [], 1, None, False)])]
    engine = Engine(spark, str(tmp_path / "store"), str(tmp_path), Config(primary="fts"), HashEmbedder())
    done = engine._resolved(spark.createDataFrame(rows, schema)).filter("path = 'x.py'").first()["imports"]
    assert [i["module"] for i in done if i["resolved_file_id"] != "x.py"] == ["q.x"]


class Summariser:
    name = "told"

    def summarise(self, prompt):
        return f"- Says what {prompt['qualified_name']} does\n\n- in {prompt['path']}"


def test_summaries_rollups_prune_and_repair(spark, repo, tmp_path):
    log = tmp_path / "log"
    engine = Engine(spark, str(tmp_path / "store"), str(repo), Config(primary="fts", enrich=True), HashEmbedder(), log=str(log), summariser=Summariser())
    engine.index()
    chunks = {r["qualified_name"]: r for r in engine.store.read("code_chunks").collect()}
    told = {k: r["generated_summary"] for k, r in chunks.items() if r["summary_source"] == "llm"}
    assert told and all(v == f"Says what {k} does in {chunks[k]['path']}" for k, v in told.items())
    assert all(r["generated_summary"] is None for r in chunks.values() if r["summary_source"] in ("docstring", "doc_comment"))
    card = engine.store.read("file_cards").filter("file_id = 'src/config/env.py'").first()
    assert [u["target_id"] for u in card["used_by_interpreted"]] == ["src/auth/middleware.py"] and "get_env_api_key" in card["key_entities"]
    card = engine.store.read("file_cards").filter("file_id = 'src/auth/middleware.py'").first()
    assert [i["target_path"] for i in card["imports_interpreted"]] == card["delegates_to"] == ["src/config/env.py"] and card["important_symbols"][0]["name"] == "verify_token"
    record = engine.store.read("semantic_records").filter("record_id = 'semantic:file_card:src/auth/middleware.py'").first()
    assert "imports: src/config/env.py -> resolved internal import" in record["content"]
    # a parent folder's card is made from the cards of its child folders
    cards = {r["folder_id"]: r for r in engine.store.read("folder_cards").collect()}
    assert set(cards) == {r[0] for r in engine.store.read("folders").select("folder_id").collect()}
    assert cards["src/auth"]["provenance"]["source_hash"] in cards["src"]["provenance"]["source_hash"]
    assert cards["src"]["provenance"]["source_hash"] in cards["repo"]["provenance"]["source_hash"]
    assert "symbol:verify-token" in cards["src"]["retrieval_tags"] or any("verify" in t for t in cards["src"]["retrieval_tags"])
    text = card_markdown(engine.cards(), source="x")
    assert "## Folder cards" in text and "### `src/auth/middleware.py`" in text
    # records that lost their owner go, and records that are missing come back
    version = engine.store.current()
    assert not any(engine.prune().values()) and engine.repair() == {"repaired": 0} and engine.store.current() == version
    with engine.store.commit() as v:
        v.write("file_cards", engine.store.read("file_cards").filter("file_id <> 'src/watcher.rs'"))
        v.write("semantic_records", engine.store.read("semantic_records").filter("record_id <> 'semantic:file:web/client.ts'"))
    gone = engine.prune()
    assert (gone["semantic_records"], gone["fts_records"] > 0, gone["file_cards"]) == (1, True, 0)
    assert engine.repair() == {"repaired": 1} and engine.missing_records().count() == 0
    assert engine.store.read("fts_stats").first()["n"] == engine.store.read("semantic_records").count()
    out = engine.prepare([])
    assert out["status"] == "ready" and (log / "READY").exists() and engine.log.last()["progress"]["percent"] == 1.0


def test_progress_never_falls_but_for_a_failure():
    p = Progress()
    seen = [p.at(*x)["percent"] for x in (("started",), ("read", 1, 2), ("embed", 1, 2), ("read", 1, 4), ("ready",))]
    assert seen == sorted(seen) and seen[1] == 0.19 and seen[-1] == 1.0
    assert p.at("other") is None and ratio(3, 0) == 0 and ratio(9, 3) == 1
