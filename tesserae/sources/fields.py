"""The provided tables as fields and series: long tables keyed by place and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: str):
    """A sum of hundredths that doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value (millions) by nation and month: 25 cells four degrees apart, from 10 N, 60 W."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    month = o.select("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "o_totalprice")
    rows = month.join(c.select("c_custkey", "c_nationkey"), month.o_custkey == c.c_custkey).join(n.select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy(F.col("n_nationkey").alias("cell"), "year", "month").agg((exact_sum("o_totalprice") / 1e6).alias("v"))
    i, j = F.floor(F.col("cell") / 5).cast("int"), (F.col("cell") % 5).cast("int")
    return sums.select("cell", i.alias("lat_idx"), j.alias("lon_idx"), (10 + 4.0 * i).alias("lat"), (-60 + 4.0 * j).alias("lon"), "year", "month", ((F.col("year") - FIRST_YEAR) * 12 + F.col("month") - 1).alias("t"), "v")


def whole_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_month without a last month that the orders don't reach the end of, and only the cells that have every month: what filters need."""
    end = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").cast("date").alias("end"))
    end = end.select((F.year("end") * 12 + F.month("end") - 1 - FIRST_YEAR * 12 + (F.col("end") == F.last_day("end")).cast("int")).alias("end"))
    f = nation_month(spark, sf_dir).join(F.broadcast(end), F.col("t") < F.col("end")).drop("end")  # one row
    span = f.agg(F.min("t").alias("first"), F.max("t").alias("last"))
    cells = f.groupBy("cell").agg(F.count("v").alias("n")).join(F.broadcast(span), F.col("n") == F.col("last") - F.col("first") + 1).select("cell", "first", "last")
    return f.join(cells, "cell")


def customer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances on a half-degree grid of 50 columns."""
    c = table(spark, sf_dir, "customer")
    i, j = F.floor(F.col("c_custkey") / 50).cast("int"), (F.col("c_custkey") % 50).cast("int")
    return c.select(F.col("c_custkey").alias("cell"), i.alias("lat_idx"), j.alias("lon_idx"), (0.25 + 0.5 * (i % 120)).alias("lat"), (-40.25 + 0.5 * j).alias("lon"), F.col("c_acctbal").alias("v"))


def segment_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value (millions) by market segment and month: a few parallel series, as of models."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c.select("c_custkey", "c_mktsegment"), o.o_custkey == c.c_custkey)
    sums = rows.groupBy(F.col("c_mktsegment").alias("model"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg((exact_sum("o_totalprice") / 1e6).alias("v"))
    return sums.withColumn("t", (F.col("year") - FIRST_YEAR) * 12 + F.col("month") - 1)


def ship_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, price and mean discount by month of shipping."""
    rows = table(spark, sf_dir, "lineitem")
    sums = rows.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg((exact_sum("l_quantity") / 1e3).alias("x"), (exact_sum("l_extendedprice") / 1e6).alias("y"), (exact_sum("l_discount") / F.count("*")).alias("z"))
    return sums.withColumn("t", (F.col("year") - FIRST_YEAR) * 12 + F.col("month") - 1)


def events_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of values by event type and hour since 2024-01-01."""
    rows = table(spark, sf_dir, "events")
    hour = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).alias("t")
    return rows.groupBy(F.col("event_type").alias("model"), hour).agg(exact_sum("value").alias("v"))
