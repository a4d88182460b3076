"""python -m weftline forward | reverse | ask | usage: thin calls of ``plans.rag`` and ``operators.usage``."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.functions import vectors as vx
from weftline.operators import context, search, usage
from weftline.plans import rag
from weftline.sources import sinks, strategies
from weftline.sources import tables as ta
from weftline.sources.collection import Collection
from weftline.sources.text_index import TextIndex


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftline")
    parser.add_argument("--collection", help="folder of the vector collection")
    parser.add_argument("--strategy", help="folder with the history of column strategies")
    parser.add_argument("--index", help="folder of the keyword index of the documents")
    commands = parser.add_subparsers(dest="command", required=True)
    forward = commands.add_parser("forward", help="a table into the collection")
    forward.add_argument("table")
    forward.add_argument("--format", default="parquet")
    forward.add_argument("--reset", action="store_true")
    reverse = commands.add_parser("reverse", help="the collection's documents back to a table")
    reverse.add_argument("out")
    reverse.add_argument("--kind", choices=["parquet", "csv", "txt"], default="parquet")
    ask = commands.add_parser("ask", help="answer questions")
    ask.add_argument("questions", nargs="+")
    ask.add_argument("--mode", choices=["semantic", "hybrid"], default="semantic")
    summary = commands.add_parser("usage", help="summary of recorded query events")
    summary.add_argument("events")
    summary.add_argument("--hours", type=int, default=24)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if args.command == "usage":
        events = spark.read.json(args.events)
        print(json.dumps(usage.summary(usage.since(events.withColumn("ts", F.col("ts").cast("timestamp")), F.current_timestamp(), args.hours), args.hours).first().asDict()))
        return
    box = Collection(spark, args.collection)
    index = TextIndex(spark, args.index) if args.index else None
    if args.command == "forward":
        rows = ta.read(spark, args.format, args.table)
        known = None if args.reset else strategies.newest(spark, args.strategy, args.table)
        stored = box.read().limit(0) if args.reset else box.read()
        entries, strategy = rag.new_entries(rows, stored.select(F.col("id").alias("row_id")), strategy=known)
        entries = search.written(entries)  # embedded once, for collection and index
        print(box.replace(entries) if args.reset else box.change(entries))
        box.tidy()
        if index:
            index.upsert(entries, "id", "document")
        if known is None:
            strategies.save(spark, args.strategy, strategy, args.table, time.time())
        return
    strategy = strategies.load(spark, args.strategy)
    if args.command == "reverse":
        out = rag.reverse(box.read(), strategy)
        {"parquet": lambda: sinks.write_table(out, args.out, "overwrite"), "csv": lambda: sinks.write_csv(out, args.out), "txt": lambda: sinks.write_text(out, args.out)}[args.kind]()
        return
    engine = rag.Engine(spark, box, strategy, encode=vx.hashing_encoder(), mode=args.mode, index=index)
    session = engine.new_session()
    for question in args.questions:
        answer = engine.ask(question, session)
        answer.citations = context.shown_citations(answer.citations)
        print(json.dumps(answer.__dict__, ensure_ascii=False))


if __name__ == "__main__":
    main()
