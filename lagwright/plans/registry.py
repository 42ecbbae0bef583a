"""The queries over the driver's tables and their SQL, as the modules of this package register them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import SERIES, SPANS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(name: str, digits: int) -> Column:
    """A double as the SQL rounds it: the nearest whole number of 10^-digits after multiplication, half away from zero."""
    scaled = F.col(name) * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(F.col(name))


def query(sql: str | None = None, digits: int = 6):
    """Registers a function as the query of its name; doubles of its result are rounded."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*((rounded(c, digits) + 0.0).alias(c) if kind == "double" else c for c, kind in df.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql.replace("{ev}", SERIES).replace("{sp}", SPANS)
        return f

    return put
