"""Joins by keys of which null is one as others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left's columns and right's besides ``on``, where all of ``on`` are equal or both null (left, inner, semi and anti
    joins). Spark hashes and sorts by such conditions as by plain equality."""
    named = right.select(*(F.col(f"`{c}`").alias(f"_on_{c}" if c in on else c) for c in right.columns))
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(named, condition, how).drop(*(f"_on_{c}" for c in on))
