"""``python -m millrace ROOT [SCRIPT]``: statements from a file, or from standard input as they come."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="millrace")
    options.add_argument("root", help="the database's folder, in any store that Spark writes")
    options.add_argument("script", nargs="?", help="a file of statements")
    options.add_argument("--rows", type=int, default=20, help="rows to print of a result")
    options.add_argument("--cache", action="store_true", help="keep tables in memory in analytical mode")
    given = options.parse_args(argv)

    from pyspark.sql import SparkSession

    from . import Engine
    from .sources.console import run_console

    spark = SparkSession.builder.appName("millrace").getOrCreate()
    engine = Engine(spark, given.root, cache=given.cache)
    if given.script is None:
        run_console(engine, sys.stdin, sys.stdout, rows=given.rows)
    else:
        with open(given.script, encoding="utf-8") as lines:
            run_console(engine, lines, sys.stdout, rows=given.rows)


if __name__ == "__main__":
    main()
