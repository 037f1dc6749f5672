"""Command line: python -m cairn.cli COMMAND ROOT --store DIR ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from cairn.operators.reports import card_markdown
from cairn.plans.engine import Config, Engine
from cairn.plans.planner import TASKS
from cairn.providers import ChatEnricher, ChatReranker, Endpoint, EndpointReranker
from cairn.session import ship_package


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("root")
        for x in positional:
            c.add_argument(x)
        c.add_argument("--store", required=True)
        c.add_argument("--ignore", action="append", default=[])
        c.add_argument("--primary", choices=["fts", "dense", "hybrid", "splade"], default="hybrid", help="splade has no model of its own and searches as hybrid does")
        dense = c.add_mutually_exclusive_group()
        dense.add_argument("--enable-dense", dest="dense", action="store_true", default=None)
        dense.add_argument("--disable-dense", dest="dense", action="store_false")
        c.add_argument("--no-late-interaction", dest="late", action="store_false")
        c.add_argument("--enrich-now", action="store_true")
        c.add_argument("--chunk-summary-url", help="a chat endpoint that describes code without documentation")
        c.add_argument("--chunk-summary-model", default="default")
        c.add_argument("--rerank-url")
        c.add_argument("--rerank-model", default="default")
        c.add_argument("--rerank-provider", choices=["rerank", "chat"], default="rerank")
        c.add_argument("--ensure-fresh", action="store_true", help="bring the index up to date first")
        return c

    for name in ("prepare", "index", "update", "rebuild-semantic", "repair", "prune", "status", "prewarm"):
        command(name).add_argument("--query", action="append")
    for name, extra in (("search", ("query",)), ("op", ("task", "query"))):
        c = command(name, *extra)
        c.add_argument("--limit", type=int, default=8)
        c.add_argument("--granularity", choices=["file", "record", "symbol", "chunk"], default="file")
        c.add_argument("--compact", action="store_true")
    c = command("read", "file_id")
    c.add_argument("--chunks", action="store_true")
    c = command("read-bundle", "query")
    c.add_argument("--limit", type=int, default=4)
    c.add_argument("--related", type=int, default=3)
    c.add_argument("--task", choices=sorted(TASKS), default="read-next")
    c.add_argument("--mode", choices=["brief", "edit", "flow"], default="brief")
    c = command("enrich")
    c.add_argument("--max-files", type=int, default=1)
    c = command("cards")
    c.add_argument("--empty", action="store_true")
    c.add_argument("--markdown", action="store_true", help="a report instead of JSON lines")
    c = command("chunks")
    c.add_argument("--source")
    c.add_argument("--with-code", action="store_true")
    c = command("watch")
    c.add_argument("--interval-ms", type=int, default=2000)
    c.add_argument("--debounce-ms", type=int, default=3000)
    c.add_argument("--polls", type=int, help="stop after so many polls")
    return p


def run(args: argparse.Namespace, spark: SparkSession, out=sys.stdout) -> None:
    config = Config(primary=args.primary, dense=args.dense, late=args.late, enrich=args.enrich_now, ignores=args.ignore)
    summariser = ChatEnricher(Endpoint(args.chunk_summary_url), args.chunk_summary_model) if args.chunk_summary_url else None
    ranker = {"rerank": EndpointReranker, "chat": ChatReranker}[args.rerank_provider]
    reranker = ranker(Endpoint(args.rerank_url), args.rerank_model) if args.rerank_url else None
    engine = Engine(spark, args.store, args.root, config, log=f"{args.store}-logs", lock=f"{args.store}.prepare.lock", reranker=reranker, summariser=summariser)
    if args.ensure_fresh and args.command in ("search", "op", "read", "read-bundle", "cards", "chunks", "status"):
        engine.update()
    show = lambda df: [print(x, file=out) for x in df.toJSON().toLocalIterator()]
    match args.command:
        case "prepare" | "index" | "update" | "rebuild-semantic" | "repair" | "prune" | "prewarm":
            call = {"prepare": lambda: engine.prepare(args.query), "prewarm": lambda: engine.prewarm(args.query)}
            done = call.get(args.command, getattr(engine, args.command.replace("-", "_"), None))()
            print(json.dumps(done, default=str, indent=2), file=out)
        case "status":
            show(engine.status())
        case "search":
            show(engine.search(args.query, args.limit, args.granularity, args.compact))
        case "op":
            show(engine.op(args.task, args.query, args.limit))
        case "read":
            show(engine.read(args.file_id, args.chunks))
        case "read-bundle":
            show(engine.read_bundle(args.query, args.task, args.limit, args.related, args.mode))
        case "enrich":
            print(json.dumps(engine.enrich_once(args.max_files)), file=out)
        case "cards":
            rows = engine.cards(args.empty)
            print(card_markdown(rows, args.empty, args.store), file=out) if args.markdown else show(rows)
        case "chunks":
            show(engine.chunks(args.source, args.with_code))
        case "watch":
            from cairn.streaming.watch import Watcher

            watcher = Watcher(spark, args.root, f"{args.store}-watch", args.debounce_ms / 1000, args.ignore)
            polls = 0
            while args.polls is None or polls < args.polls:
                time.sleep(args.interval_ms / 1000)
                polls += 1
                if watcher.poll(time.time()):
                    print(json.dumps(engine.update(), default=str), file=out)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cairn").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    run(args, spark)


if __name__ == "__main__":
    main()
