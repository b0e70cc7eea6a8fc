"""Command line: list the queries, run one over a folder of tables, or parse a page of an act.

python -m docweave list | run NAME FOLDER [--show N] [--out PATH] | parse FILE CELEX
"""

from __future__ import annotations

import argparse
import json
import sys


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--out")
    parse = commands.add_parser("parse")
    parse.add_argument("file")
    parse.add_argument("celex")
    asked = parser.parse_args(arguments)
    if asked.command == "parse":
        from docweave.sources.legal_html import parse_act

        with open(asked.file, encoding="utf-8", errors="replace") as page:
            for row in parse_act(page.read(), asked.celex):
                print(json.dumps(row, ensure_ascii=False))
        return 0
    from docweave.plans import catalog

    known = catalog.queries()
    if asked.command == "list":
        print("\n".join(sorted(known)))
        return 0
    if asked.name not in known:
        print(f"there is no query {asked.name}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = known[asked.name](spark, asked.folder)
    if asked.out:
        found.write.mode("errorifexists").parquet(asked.out)
    else:
        found.show(asked.show, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
