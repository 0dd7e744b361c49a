"""Command line: python -m fieldloom [--list] [query folder [--out path] [--format parquet|csv|json]]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.queries import REGISTRY
from .sources import files

WRITERS = {"parquet": files.publish, "csv": files.write_csv, "json": files.write_jsonl}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fieldloom", description="Run a registered query over a folder of tables.")
    parser.add_argument("query", nargs="?", choices=sorted(REGISTRY))
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--list", action="store_true", help="name the queries")
    parser.add_argument("--out", help="write the rows here instead of showing twenty")
    parser.add_argument("--format", choices=sorted(WRITERS), default="parquet")
    given = parser.parse_args(args)
    if given.list:
        for name, f in sorted(REGISTRY.items()):
            print(f"{name}: {f.__doc__}")
        return 0
    if not given.query or not given.folder:
        parser.error("name a query and a folder")
    rows = REGISTRY[given.query](SparkSession.builder.appName("fieldloom").getOrCreate(), given.folder)
    if given.out:
        WRITERS[given.format](rows, given.out)
    else:
        rows.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
