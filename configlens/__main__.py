"""Commands: python -m configlens scan|hunt|secrets|diff|export-sql ..."""

from __future__ import annotations

import argparse

from . import engine
from .operators import sinks
from .operators.diffs import DiffPlan
from .session import local_session


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="configlens")
    commands = main.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="classify the files below a folder")
    scan.add_argument("path")
    scan.add_argument("--glob", default="**")
    scan.add_argument("--sample-size", type=int, default=engine.budgets.DEFAULT_SAMPLE)
    scan.add_argument("--json", action="store_true", help="a JSON object for each file instead of a table")
    for name, text in (("hunt", "lines that the default rules find"), ("secrets", "lines with secrets")):
        commands.add_parser(name, help=text).add_argument("path")
    diff = commands.add_parser("diff", help="compare two files")
    diff.add_argument("before")
    diff.add_argument("after")
    diff.add_argument("--content-type", default="text", choices=("text", "xml", "json"))
    diff.add_argument("--mask-token", action="append", default=[])
    diff.add_argument("--context-lines", type=int, default=3)
    export = commands.add_parser("export-sql", help="write the tables of a SQLite file")
    export.add_argument("database")
    export.add_argument("folder")
    for option in ("--mask-column", "--hash-column", "--table", "--exclude-table"):
        export.add_argument(option, action="append", default=[])
    export.add_argument("--hash-salt", default="")
    export.add_argument("--limit", type=int)
    return main


def main(arguments: list[str] | None = None) -> str:
    """What a command prints."""
    given = parser().parse_args(arguments)
    spark = local_session()
    if given.command == "scan":
        found = engine.scan(spark, given.path, sample_size=given.sample_size, glob=given.glob)
        if given.json:
            return "\n".join(r.value for r in sinks.scan_json(found.orderBy("path_parts")).toLocalIterator())
        return sinks.print_table(found)
    if given.command == "diff":
        plan = DiffPlan(given.content_type, mask_tokens=tuple(given.mask_token), context_lines=given.context_lines)
        return engine.diff(spark, given.before, given.after, plan).first()["diff"]
    if given.command == "export-sql":
        rows = engine.export_snapshot(spark, given.database, given.folder, given.mask_column, given.hash_column, given.hash_salt, given.table, given.exclude_table, given.limit)
    elif given.command == "hunt":
        rows = engine.hunt_tree(spark, given.path)
    else:
        rows = engine.find_secrets(spark, given.path)
    return "\n".join(r.value for r in sinks.json_records(**{given.command.replace("-", "_"): rows}).toLocalIterator())


if __name__ == "__main__":
    print(main())
