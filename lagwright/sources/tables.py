"""Tables of the driver as series: which columns play key, time and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as k, i, kind, t (hours since 2024-01-01), v. t is unique within k; no session time zone enters."""
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 3.6e9D")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("i"), F.col("event_type").alias("kind"), hours.alias("t"), F.col("value").alias("v"))


#: The same in DuckDB.
SERIES = "ev AS (SELECT user_id AS k, event_id AS i, event_type AS kind, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS t, value AS v FROM events)"


def day_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines' spans in days since 1992-01-01: k (customer), o, l, a (order date), b (ship date)."""
    day = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1992-01-01 00:00:00', cast({c} as timestamp_ntz)) / 8.64e10D")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), day("o_orderdate").alias("a"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), day("l_shipdate").alias("b"))
    return orders.join(lines, "o").select("k", "o", "l", "a", "b")


SPANS = """sp AS (SELECT o_custkey AS k, o_orderkey AS o, l_linenumber AS l, date_diff('microsecond', TIMESTAMP '1992-01-01', o_orderdate) / 8.64e10 AS a,
  date_diff('microsecond', TIMESTAMP '1992-01-01', l_shipdate) / 8.64e10 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
