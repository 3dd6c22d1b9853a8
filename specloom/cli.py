"""Command line: ingest files, ask questions, run a list of them, show the demo."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from specloom.plans.engine import Config, Engine, demo
from specloom.sources import readers, sinks


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="specloom")
    p.add_argument("--path", default="specloom-data", help="folder of the indexes and the history")
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--generic", action="store_true")
    p.add_argument("--layout-first", action="store_true", help="PDFs through the layout-keeping command first")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("files")
    ingest.add_argument("--session")
    for name in ("ask", "batch", "demo", "interactive"):
        c = sub.add_parser(name)
        c.add_argument("session")
        c.add_argument("--variant")
        c.add_argument("--all", action="store_true", help="procedures too")
        if name == "ask":
            c.add_argument("question", nargs="+")
        if name == "batch":
            c.add_argument("queries", help="a file with a question on each line")
            c.add_argument("--csv", help="write the records here")
        if name == "demo":
            c.add_argument("--set", default="api", choices=["api", "extraction", "retrieval", "suggestions"])
    sub.add_parser("history")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("specloom").getOrCreate()
    engine = Engine(spark, a.path, config=Config(k=a.k, generic=a.generic, layout_first=a.layout_first))
    if a.command == "ingest":
        print(engine.ingest(a.files, a.session))
    elif a.command == "history":
        for r in engine.history.newest().collect():
            print(r.ts, r.query, r.n_results)
    elif a.command == "demo":
        for question, variant, spec_only in demo(a.set):
            _show(engine.ask([question], a.session, variant or a.variant, spec_only=spec_only and not a.all, remember=True))
    elif a.command == "interactive":
        while (question := _next_question()) is not None:
            _show(engine.ask([question], a.session, a.variant, spec_only=not a.all, remember=True))
    else:
        if a.command == "batch":
            queries = readers.read_queries(spark, a.queries)
            if a.csv:
                full = engine.answer(queries, a.session).join(queries, "query_id")
                sinks.write_csv(full, a.csv, full=True)
            questions = [r.query for r in queries.collect()]
        else:
            questions = [" ".join(a.question)]
        _show(engine.ask(questions, a.session, a.variant, spec_only=not a.all, remember=True))
    return 0


def _show(responses: list[dict]) -> None:
    for r in responses:
        print(json.dumps({"query": r["query"], "results": r["results"]}, ensure_ascii=False))


def _next_question() -> str | None:
    """A line of input; an empty one, the end of input, or a word to leave ends the session."""
    try:
        line = input("> ").strip()
    except EOFError:
        return None
    return None if line.lower() in ("", "exit", "quit", "q") else line


if __name__ == "__main__":
    raise SystemExit(main())
