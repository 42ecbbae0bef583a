"""Span algebra: clipping, gaps, tails, samples along spans, and the folds whose state resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed


def trim_to(df: DataFrame, duration: str, least: float) -> DataFrame:
    """Spans (src_a, src_b, dst_a, dst_b) cut to [0, duration] of the source, dst moved at the same rate; spans shorter
    than ``least`` afterwards are dropped."""
    rate = (F.col("dst_b") - F.col("dst_a")) / F.greatest(F.col("src_b") - F.col("src_a"), F.lit(1e-9))
    a, b = F.greatest(F.col("src_a"), F.lit(0.0)), F.least(F.col("src_b"), F.col(duration))
    out = df.withColumns({"dst_a": F.col("dst_a") + (a - F.col("src_a")) * rate, "dst_b": F.col("dst_b") - (F.col("src_b") - b) * rate, "src_a": a, "src_b": b})
    return out.where(F.col("src_b") - F.col("src_a") >= least)


def clip_overlaps(df: DataFrame, k: str, start: str, stop: str, order: list[str]) -> DataFrame:
    """df with stop cut where the next span begins, so that spans of a key don't overlap; none gets shorter than 0."""
    w = Window.partitionBy(k).orderBy(*order)
    return df.withColumn("clipped", F.greatest(F.col(start), F.least(F.col(stop), F.coalesce(F.lead(start).over(w), F.col(stop)))))


def gaps(df: DataFrame, k: str, start: str, stop: str, least: float) -> DataFrame:
    """k, gap_start, gap_stop between spans, longer than ``least``; spans may overlap and contain each other."""
    w = Window.partitionBy(k).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_r", reach).where(F.col(start) - F.col("_r") > least).select(k, F.col("_r").alias("gap_start"), F.col(start).alias("gap_stop"))


def with_tails(df: DataFrame, k: str, start: str, stop: str, bridge: float, order: list[str]) -> DataFrame:
    """df with tail: stop moved by ``bridge``, or less where the next span begins earlier; never moved back."""
    w = Window.partitionBy(k).orderBy(*order)
    room = F.greatest(F.lit(0.0), F.coalesce(F.lead(start).over(w) - F.col(stop), F.lit(bridge)))
    return df.withColumn("tail", F.col(stop) + F.least(F.lit(bridge), room))


def samples(df: DataFrame, start: str, stop: str, step: float) -> DataFrame:
    """df with at: n = max(2, round(length / step) + 1) even points from start to stop."""
    n = F.greatest(F.lit(2), F.bround((F.col(stop) - F.col(start)) / step).cast("int") + 1)
    d = df.withColumn("_n", n).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.withColumn("at", F.col(start) + (F.col(stop) - F.col(start)) * F.col("_j") / (F.col("_n") - 1)).drop("_n", "_j")


def covering(queries: DataFrame, spans: DataFrame, k: str, t: str, start: str, stop: str, width: float) -> DataFrame:
    """queries joined with the spans that hold t, both ends in. Spans meet queries in cells of ``width``, so that the join
    is by equality on (k, cell) and the range is a filter."""
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))
    q = queries.withColumn("_cell", F.floor(F.col(t) / width))
    return q.join(cells, [k, "_cell"]).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(stop))).drop("_cell")


def snap_inserts(df: DataFrame, k: str, order: str, gap: str, most: float) -> DataFrame:
    """df with shift: the sum of all gaps of size ``most`` or less up to the row, by which it moves to close them."""
    w = Window.partitionBy(k).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("shift", F.coalesce(F.sum(F.when(F.abs(gap) <= most, F.col(gap))).over(w), F.lit(0.0)))


def stepped_marks(df: DataFrame, k: str, t: str, v: str, step: float) -> DataFrame:
    """k, t, v: the rows at which v is ``step`` or more away from the last mark's; the first row is one. Streamed.
    Rows with a null time or value have no part."""

    def keep(state, row):
        return (row[1], [tuple(row)]) if state is None or abs(row[1] - state) >= step else (state, [])

    return streamed(df.select(k, F.col(t).alias("t"), F.col(v).alias("v")).where("t is not null and v is not null"), k, ["t", "v"], keep, "t double, v double")
