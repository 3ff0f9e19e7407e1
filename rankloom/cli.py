"""Commands: ingest, search, ask, status. `python -m rankloom.cli <command> --path <tables> ...`"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .pipeline import STRATEGIES, Options, Pipeline
from .session import Settings, check_request, session
from .sources.store import load_documents


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rankloom")
    out.add_argument("--path", required=True, help="where the tables are")
    out.add_argument("--strategy", choices=STRATEGIES, default="hybrid")
    out.add_argument("--transform", default="identity")
    out.add_argument("--floor", type=float)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("source")
    for name in ("search", "ask"):
        c = commands.add_parser(name)
        c.add_argument("question")
        c.add_argument("-k", type=int, default=5)
    commands.add_parser("status")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict | list:
    a = parser().parse_args(args)
    spark = spark or session()
    pipe = Pipeline(spark, a.path, Settings(strategy=a.strategy, score_floor=a.floor), Options(transform=a.transform))
    if a.command == "ingest":
        out: dict | list = pipe.ingest(load_documents(spark, a.source))
    elif a.command == "status":
        out = pipe.health()
    else:
        check_request(a.question, a.k)
        asked = spark.createDataFrame([(1, a.question)], "query_id long, query string")
        rows = pipe.retrieve_response(asked, a.k) if a.command == "search" else pipe.ask(asked, a.k)
        found = rows.collect()  # one question
        out = (json.loads(found[0]["results"]) if found else []) if a.command == "search" else found[0].asDict()
    print(json.dumps(out, ensure_ascii=False, indent=1))
    return out


if __name__ == "__main__":
    main()
