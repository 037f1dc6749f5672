import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.vectors import dot, literal, normalise
from cairn.operators import bm25
from cairn.operators.dense import dense_topk, late_tokens, max_sim
from cairn.operators.ranking import group_ranks
from cairn.plans.planner import candidate_limit, plan_query, task_query


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr).first()[0]


def test_identifier_terms(spark):
    assert one(spark, "_parseHTTPRequest_v2", T.identifier_terms("v")) == ["httprequest", "parse", "parsehttprequest_v2", "v2"]
    assert one(spark, "_", T.identifier_terms("v")) == []
    assert one(spark, None, T.identifier_terms("v")) is None


def test_list_cleaning(spark):
    items = [" A ", "a", "", None, "b"]
    assert one(spark, items, T.clean_strings("v", 2), "array<string>") == ["A", "b"]
    assert one(spark, ["Kind: X//y", "kind:-x-y", "--"], T.sanitize_tags("v", 9), "array<string>") == ["kind:-x-y"]
    assert one(spark, ["Provide behavior used by downstream dependents", " b "], T.clean_behaviours("v"), "array<string>") == ["b"]


def test_small_text_helpers(spark):
    assert one(spark, "x: 1\nsummary: hi there \nsummary: no", T.content_field("v", "summary")) == "hi there"
    assert one(spark, "- a\n\n* b", T.clean_summary("v")) == "a b"
    assert one(spark, "abcdef", T.truncate("v", 3)) == "abc..."
    assert [one(spark, d, T.doc_is_useful("v")) for d in ("Handles event", "short", "A sentence of text.", None)] == [False, False, True, False]
    assert one(spark, {"b": '["x","y"]', "a": "1"}, T.metadata_text("v"), "map<string,string>") == "a 1 b x y"
    assert one(spark, "src/a.tsx", F.concat_ws("|", T.language_of("v"), T.parent_folder("v"))) == "typescript|src"
    assert one(spark, "a.py", T.parent_folder("v")) == "repo"


def test_tokens():
    assert T.search_tokens("Where is the API of a parse_file?") == ["api", "parse_file"]
    assert T.fts_terms("self.db-open, x Env") == ["env", "self.db-open"]


@pytest.mark.parametrize(
    "query, mode",
    [
        ("repository architecture", "architecture_overview"), ("tests for parser", "test_lookup"), ("where should I edit it", "edit_target"), ("what breaks downstream", "trace_dependency"),
        ("read next file", "read_next"), ("resolve_peer", "find_symbol"), ("how does it go", "find_behavior"), ("plain words here", "general"), ("Tests", "find_symbol"),
    ],
)
def test_planner(query, mode):
    assert plan_query(query).mode == mode


def test_plan_details():
    assert plan_query("usage of resolve_peer").graph_neighbours and not plan_query("resolve_peer").graph_neighbours
    assert candidate_limit(8) == 192 and candidate_limit(20) == 480
    assert task_query("tests-for", "x") == "tests fixtures spec coverage for x"


def test_bm25_equals_sqlite(spark):
    texts = ["alpha beta beta", "beta gamma", "alpha alpha delta gamma omega", "omega", "", "nothing of it here at all"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize=\"unicode61 tokenchars '_./-'\")")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts, 1)))
    expected = dict(con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'alpha OR beta OR omega'").fetchall())
    df = spark.createDataFrame(list(enumerate(texts, 1)), "k long, x string")
    got = {r["id"]: r["rank"] for r in bm25.search(df, "k", ["x"], "beta alpha omega").collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], v, rel_tol=1e-6) for k, v in expected.items())
    postings, stats = bm25.build_postings(df, "k", ["x"])
    queries = spark.createDataFrame([(0, "omega alpha beta")], "query_id int, query string")
    again = {r["id"]: r["rank"] for r in bm25.search_postings(postings, stats, queries, 10).collect()}
    assert again.keys() == expected.keys() and all(math.isclose(again[k], v, rel_tol=1e-6) for k, v in expected.items())
    assert bm25.search(df, "k", ["x"], "").collect() == []


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], normalise("v"), "array<float>") == [0.6, 0.8]
    assert one(spark, [1.0, 2.0, 9.0], dot("v", literal([1, 1])), "array<float>") == 3.0
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id int, embedding array<float>")
    assert [(r["id"], r["pos"]) for r in dense_topk(rows, q, 2).orderBy("pos").collect()] == [("a", 0), ("b", 1)]
    assert dense_topk(rows, q.limit(0), 2).collect() == []


def test_late_interaction(spark):
    late = spark.createDataFrame([("r", 0, 1.0, [1.0, 0.0]), ("r", 1, 1.0, [0.0, 1.0]), ("s", 0, 1.0, [-1.0, 0.0]), ("s", 1, 1.0, [1.0])], "record_id string, ordinal int, weight float, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "q int, embedding array<float>")
    assert [(r[0], r[1]) for r in max_sim(late, q).collect()] == [("r", 1.0)]
    rec = spark.createDataFrame([("r", "symbol", "src/auth.py", "verify_token", "the token token", "e::verify_token")], "record_id string, entity_type string, path string, title string, content string, entity_id string")
    got = {r["token"]: r["weight"] for r in late_tokens(rec).collect()}
    assert got["token"] == 4.0 and math.isclose(got["verify_token"], 2.75) and "the" not in got


def test_group_ranks(spark):
    rows = [("g", v) for v in (5, 5, 1, None, 9)] + [("h", 2)] + [(None, 1)]
    got = {(r["g"], r["v"]): (r["less"], r["equal"], r["total"]) for r in group_ranks(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], 3).collect()}
    assert got == {("g", None): (0, 1, 5), ("g", 1): (1, 1, 5), ("g", 5): (2, 2, 5), ("g", 9): (4, 1, 5), ("h", 2): (0, 1, 1), (None, 1): (0, 1, 1)}
