"""Command line: python -m ravelin.cli STORE index [--clear] FOLDER | stats | files | clear | compact | search QUESTION... | ask [--model NAME] QUESTION..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ravelin.config import load
from ravelin.operators.rerank import HttpEmbedder, HttpGenerator
from ravelin.plans.engine import HybridEngine


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ravelin", description="Hybrid document search on Spark.")
    parser.add_argument("store", help="folder of the chunk store")
    parser.add_argument("--embed", action="store_true", help="embed with the configured model host; without it search is full text alone")
    what = parser.add_subparsers(dest="what", required=True)
    index = what.add_parser("index")
    index.add_argument("folder")
    index.add_argument("--clear", action="store_true")
    for name in ("stats", "files", "clear", "compact"):
        what.add_parser(name)
    what.add_parser("search").add_argument("question", nargs="+")
    ask = what.add_parser("ask")
    ask.add_argument("--model", help="model that answers; without it prompts are shown")
    ask.add_argument("question", nargs="+")
    args = parser.parse_args(argv)
    config = load()
    embedder = HttpEmbedder(f"http://{config.model.host}:{config.model.port}/api/embed", config.retrieval.embed_model) if args.embed else None
    engine = HybridEngine(spark or SparkSession.builder.appName("ravelin").getOrCreate(), args.store, config, embedder)
    if args.what == "index":
        engine.index(args.folder, args.clear)
    elif args.what == "clear":
        engine.clear()
    elif args.what == "compact":
        engine.store.compact()
    elif args.what in ("search", "ask"):
        asked = engine.store.spark.createDataFrame(list(enumerate(args.question, 1)), "query_id int, q string")
        if args.what == "ask":
            if args.model:
                told = engine.answer(asked, HttpGenerator(f"http://{config.model.host}:{config.model.port}/api/generate", args.model))
                told.select("query_id", "decision", "answer", "error", "files").orderBy("query_id").show(100, False)
            else:
                engine.ask(asked).select("query_id", "decision", "prompt").orderBy("query_id").show(100, False)
            return
        engine.search(asked).select("query_id", "rank", "score", "filename", "text").orderBy("query_id", "rank").show(100, 100)
    else:
        getattr(engine, args.what)().show(1000, False)


if __name__ == "__main__":
    main()
