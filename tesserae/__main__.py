"""Runs registered field queries from the command line: python -m tesserae --tables DIR --out DIR NAME..."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import zipfile
from collections.abc import Sequence

from pyspark.sql import SparkSession


def packed() -> str:
    """A zip file of this package, for executors that don't have it installed."""
    home = os.path.dirname(os.path.abspath(__file__))
    path = f"{tempfile.mkdtemp(prefix='spark-')}/tesserae.zip"
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(home)))
    return path


def parsed(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tesserae", description="Field queries over a folder of Parquet tables.")
    p.add_argument("names", nargs="*", help="queries to run, or beginnings of their names")
    p.add_argument("--tables", help="folder with the tables, NAME.parquet each; any address that Spark reads")
    p.add_argument("--out", help="folder for results, one folder a query; without it rows are shown")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    p.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "ignore"], help="what to do where a result is there already")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a setting of the session; give spark.checkpoint.dir on a cluster")
    p.add_argument("--rows", type=int, default=20, help="rows shown without --out")
    p.add_argument("--list", action="store_true", help="list the queries")
    p.add_argument("--sql", action="store_true", help="print the queries' SQL instead of running them")
    return p.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> int:
    from tesserae.queries import ORACLES, QUERIES

    asked = parsed(argv)
    if asked.list:
        print("\n".join(sorted(QUERIES)))
        return 0
    names = [n for n in sorted(QUERIES) if any(n == a or n.startswith(a) for a in asked.names)]
    if missing := [a for a in asked.names if not any(n.startswith(a) for n in QUERIES)]:
        print(f"no query named {', '.join(missing)}; --list shows them", file=sys.stderr)
        return 2
    if asked.sql:
        print("\n\n".join(f"-- {n}\n{ORACLES.get(n, '-- none')}" for n in names))
        return 0
    if not names or not asked.tables:
        print("name a query and --tables; --list shows the queries", file=sys.stderr)
        return 2
    builder = SparkSession.builder.appName("tesserae").config("spark.sql.session.timeZone", "UTC")
    for pair in asked.conf:
        key, _, value = pair.partition("=")
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.addPyFile(packed())
    for name in names:
        df = QUERIES[name](spark, asked.tables.rstrip("/"))
        if asked.out:
            df.write.mode(asked.mode).format(asked.format).save(f"{asked.out.rstrip('/')}/{name}")
        else:
            print(name)
            df.show(asked.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
