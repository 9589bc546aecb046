"""Registered queries over the provided tables and their DuckDB texts.

Every query gives whole numbers as long, doubles rounded to six places, and texts, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The field views of tesserae.sources.fields in SQL: nation by month (f), segment by month (s), month of shipping (p), customers' grid (g), events by hour (e).
VIEWS = {
    "f": """o AS (SELECT c_nationkey AS cell, year(o_orderdate) AS year, month(o_orderdate) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
f AS (SELECT cell, cell // 5 AS lat_idx, cell % 5 AS lon_idx, CAST(10 + 4 * (cell // 5) AS DOUBLE) AS lat, CAST(-60 + 4 * (cell % 5) AS DOUBLE) AS lon, year, month, (year - 1995) * 12 + month - 1 AS t, v FROM o)""",
    "s": """s AS (SELECT c_mktsegment AS model, year(o_orderdate) AS year, month(o_orderdate) AS month, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)""",
    "p": """p AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 1e3 AS x,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS y, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS z FROM lineitem GROUP BY ALL)""",
    "g": """g AS (SELECT c_custkey AS cell, c_custkey // 50 AS lat_idx, c_custkey % 50 AS lon_idx, CAST(0.25 + 0.5 * ((c_custkey // 50) % 120) AS DOUBLE) AS lat, CAST(-40.25 + 0.5 * (c_custkey % 50) AS DOUBLE) AS lon, c_acctbal AS v FROM customer)""",
    "e": """e AS (SELECT event_type AS model, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS t, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM events GROUP BY ALL)""",
}


def query(name: str, longs: str = "", doubles: str = "", texts: str = "", views: str = "", ctes: str = "", sql: str | None = None, places: int = 6, rounded: bool = False):
    """Registers a function of (spark, sf_dir) under name, its columns in fixed types, and the SQL that gives the same rows. rounded: the function rounds its doubles itself, where they are fewer."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            shown = lambda c: c.cast("double") if rounded else F.round(c.cast("double"), places) + 0.0
            return df.select(*[F.col(c).cast("long").alias(c) for c in longs.split()], *[shown(F.col(c)).alias(c) for c in doubles.split()], *[F.col(c).cast("string").alias(c) for c in texts.split()])

        QUERIES[name] = run
        if sql:
            parts = [VIEWS[v] for v in views.split()] + ([ctes] if ctes else []) + [f"result AS ({sql})"]
            columns = [*(f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()), *(f"round(CAST({c} AS DOUBLE), {places}) + 0.0 AS {c}" for c in doubles.split()), *(f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split())]
            ORACLES[name] = "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT {', '.join(columns)} FROM result"
        return f

    return register


from tesserae.plans import archive_queries, grid_queries, more_queries, regression_queries, series_queries, source_queries, spectral_queries, stats_queries  # noqa: E402, F401  (they register)
