"""Model providers: small protocols, deterministic defaults that need no network, and HTTP clients."""

from __future__ import annotations

import json
import math
import re
import time
import urllib.request
from typing import Callable, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Enricher(Protocol):
    name: str

    def summarise(self, prompt: dict) -> str: ...


class Reranker(Protocol):
    name: str

    def rerank(self, query: str, documents: list[str]) -> list[float]: ...


def normalised(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 0 else list(v)


class HashEmbedder:
    """Counts of token hashes (h = h * 33 + byte) in `dimension` places, of unit length; a text without tokens is e0."""

    def __init__(self, dimension: int = 32):
        self.dimension, self.name = dimension, f"hash-{dimension}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for token in re.findall(r"\w+", text.lower()):
                h = 0
                for b in token.encode():
                    h = (h * 33 + b) & 0xFFFFFFFFFFFFFFFF
                v[h % self.dimension] += 1.0
            out.append(normalised(v) if any(v) else [1.0] + [0.0] * (self.dimension - 1))
        return out


class TemplateEnricher:
    """Summaries by template from what a prompt names."""

    name = "template"

    def summarise(self, prompt: dict) -> str:
        names = ", ".join(prompt.get("names", [])[:3])
        return f"{prompt.get('path', '')} handles {names}".strip() if names else f"{prompt.get('path', '')} has no symbols"


class NoReranker:
    name = "none"

    def rerank(self, query: str, documents: list[str]) -> list[float]:
        return [0.0] * len(documents)


class LexicalReranker:
    """The share of the query's words that a document holds."""

    name = "lexical"

    def rerank(self, query: str, documents: list[str]) -> list[float]:
        words = set(re.findall(r"\w+", query.lower()))
        return [len(words & set(re.findall(r"\w+", d.lower()))) / max(len(words), 1) for d in documents]


class Endpoint:
    """POSTs JSON with retries (0.5 s, 1 s, ...); `send` can be replaced, e.g. in tests."""

    def __init__(self, url: str, timeout: float = 60.0, attempts: int = 3, send: Callable[[str, dict, float], dict] | None = None, pause: float = 0.5):
        self.url, self.timeout, self.attempts, self.pause = url.rstrip("/"), timeout, attempts, pause
        self.send = send or self._send

    @staticmethod
    def _send(url: str, body: dict, timeout: float) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            raw = answer.read().decode()
        if raw.lstrip().startswith("data:"):
            parts = [json.loads(x[5:]) for x in raw.splitlines() if x.startswith("data:") and x[5:].strip() not in ("", "[DONE]")]
            text = "".join((p.get("choices") or [{}])[0].get("delta", {}).get("content") or "" for p in parts)
            return {"choices": [{"message": {"content": text}}]}
        return json.loads(raw)

    def post(self, path: str, body: dict) -> dict:
        for attempt in range(1, self.attempts + 1):
            try:
                return self.send(self.url + path, body, self.timeout)
            except Exception:
                if attempt == self.attempts:
                    raise
                time.sleep(self.pause * attempt)
        raise AssertionError


class EndpointEmbedder:
    """An embeddings endpoint; answers are put in order of their index and normalised."""

    def __init__(self, endpoint: Endpoint, model: str):
        self.endpoint, self.name = endpoint, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = sorted(self.endpoint.post("/v1/embeddings", {"model": self.name, "input": texts})["data"], key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} embeddings for {len(texts)} texts")
        return [normalised(r["embedding"]) for r in rows]


def chat(endpoint: Endpoint, model: str, task: str, content: dict, schema: dict, name: str, tokens: int = 400) -> dict:
    """The JSON object of a chat endpoint's answer, which is asked to keep to `schema`."""
    body = {
        "model": model, "messages": [{"role": "system", "content": task}, {"role": "user", "content": json.dumps(content, ensure_ascii=False)}], "temperature": 0, "max_tokens": tokens,
        "stream": False, "response_format": {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": schema}},
    }
    return json_from_text(endpoint.post("/v1/chat/completions", body)["choices"][0]["message"]["content"] or "")


class ChatEnricher:
    """A chat endpoint that answers {"summary": ...}."""

    TASK = "Say in two or three plain lines what this part of a code base does. Answer with JSON only."
    SCHEMA = {"type": "object", "properties": {"summary": {"type": "string"}}, "required": ["summary"], "additionalProperties": False}

    def __init__(self, endpoint: Endpoint, model: str, task: str = TASK):
        self.endpoint, self.name, self.task = endpoint, model, task

    def summarise(self, prompt: dict) -> str:
        return str(chat(self.endpoint, self.name, self.task, prompt, self.SCHEMA, "summary").get("summary", "")).strip()


class ChatReranker:
    """A chat endpoint that scores the first `limit` documents for a query; missing scores are 0, others go to 0..1."""

    TASK = "Score how well each document answers the query, from 0 to 1. Answer with JSON only."
    SCHEMA = {
        "type": "object", "properties": {"scores": {"type": "array", "items": {"type": "object", "properties": {"index": {"type": "integer"}, "score": {"type": "number"}}, "required": ["index", "score"]}}},
        "required": ["scores"],
    }

    def __init__(self, endpoint: Endpoint, model: str, limit: int = 20):
        self.endpoint, self.name, self.limit = endpoint, model, limit

    def rerank(self, query: str, documents: list[str]) -> list[float]:
        out = [0.0] * len(documents)
        if documents:
            content = {"query": query, "documents": [{"index": i, "text": d} for i, d in enumerate(documents[: self.limit])]}
            answer = chat(self.endpoint, self.name, self.TASK, content, self.SCHEMA, "scores", 1200)
            for r in answer.get("scores", answer.get("items", [])):
                if isinstance(r, dict) and 0 <= int(r.get("index", -1)) < len(out):
                    out[int(r["index"])] = min(max(float(r.get("score", 0.0)), 0.0), 1.0)
        return out


class EndpointReranker:
    """A rerank endpoint: scores by index, clamped to 0..1; missing ones are 0. The first `limit` documents are sent."""

    def __init__(self, endpoint: Endpoint, model: str, limit: int = 20):
        self.endpoint, self.name, self.limit = endpoint, model, limit

    def rerank(self, query: str, documents: list[str]) -> list[float]:
        answer = self.endpoint.post("/v1/rerank", {"model": self.name, "query": query, "documents": documents[: self.limit]})
        out = [0.0] * len(documents)
        for r in answer if isinstance(answer, list) else answer.get("results", answer.get("data", [])):
            score = r.get("relevance_score", r.get("score", 0.0))
            if 0 <= r.get("index", -1) < len(out):
                out[r["index"]] = min(max(float(score), 0.0), 1.0)
        return out


def json_from_text(text: str) -> dict:
    """The JSON object between the first opening and the last closing bracket of an answer; {} if there is none."""
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    end = max(text.rfind("}"), text.rfind("]"))
    if not starts or end < min(starts):
        return {}
    try:
        value = json.loads(text[min(starts) : end + 1])
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {"items": value}


def embed_column(df: DataFrame, text: str, embedder: Embedder, batch: int = 64, out: str = "embedding") -> DataFrame:
    """`df` with the embeddings of a text column; null texts have none. Requests hold `batch` texts, one stream per task."""
    names = df.columns
    at = names.index(text)

    def run(batches):
        for rows in batches:
            texts = rows.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for s in range(0, len(known), batch):
                part = known[s : s + batch]
                for i, v in zip(part, embedder.embed([texts[i] for i in part])):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, out])

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)


def summarise_column(df: DataFrame, prompt: str, enricher: Enricher, out: str = "summary", threads: int = 1) -> DataFrame:
    """`df` with the enricher's summary of a JSON prompt column, `threads` requests at once in a task; a failed request
    fails the task, which Spark retries."""
    names = df.columns
    at = names.index(prompt)

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        ask = lambda p: None if p is None else enricher.summarise(json.loads(p))
        for rows in batches:
            prompts = rows.column(at).to_pylist()
            if threads > 1:
                with ThreadPoolExecutor(threads) as pool:
                    said = list(pool.map(ask, prompts))
            else:
                said = [ask(p) for p in prompts]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.string())], [*names, out])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def late_vectors(tokens: DataFrame, embedder: Embedder) -> DataFrame:
    """(record_id, ordinal, token, weight, embedding) of (record_id, token, weight, ordinal); each distinct token is embedded once."""
    one = tokens.select("token").distinct().withColumn("text", F.concat(F.lit("code search token: "), "token"))
    return tokens.join(embed_column(one, "text", embedder).drop("text"), "token").select("record_id", "ordinal", "token", "weight", "embedding")
