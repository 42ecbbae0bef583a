"""Active segments of a signal, how they are placed, and the time maps and repairs read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import series


def active(df: DataFrame, k: str, t: str, v: str, decibels: float, silence: float, least: float, floor: float = 1e-4) -> DataFrame:
    """k, start, stop: runs of loud points, joined over gaps of up to ``silence``, ``least`` long or more.

    Loud is ``decibels`` of the key's peak, or 1.5 times the 20 % quantile where that is quiet itself (below 0.35 of the
    peak), ``floor`` at least.
    """
    level = df.groupBy(k).agg(F.max(F.abs(v)).alias("_peak"), F.percentile(F.abs(v), 0.2).alias("_low"))
    quiet = F.when(F.col("_low") < 0.35 * F.col("_peak"), 1.5 * F.col("_low")).otherwise(0.0)
    loud = df.join(level, k).where(F.abs(v) >= F.greatest(F.col("_peak") * 10 ** (decibels / 20), quiet, F.lit(floor)))
    w = Window.partitionBy(k).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > silence).cast("int"), F.lit(0))
    runs = loud.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(k, "_run").agg(F.min(t).alias("start"), F.max(t).alias("stop")).where(F.col("stop") - F.col("start") >= least).drop("_run")


def longest_quiet(df: DataFrame, k: str, t: str, v: str, below: float) -> DataFrame:
    """k, longest: the longest run of |v| < ``below``; 0 for keys that are never quiet."""
    runs = series.islands(df, k, t, F.abs(v) < below).groupBy(k).agg(F.max(F.col("stop") - F.col("start")).alias("_l"))
    return df.select(k).distinct().join(runs, k, "left").select(k, F.coalesce("_l", F.lit(0.0)).alias("longest"))


def gap_plan(df: DataFrame, k: str, order: list[str]) -> DataFrame:
    """df (src_a, src_b, dst_a, dst_b) with file_gap (silence before the segment in its file), desired (where it is placed)
    and insert (what has to be added); the first segment's gaps count from 0."""
    w = Window.partitionBy(k).orderBy(*order)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    d = df.withColumn("file_gap", F.col("src_a") - before("src_b")).withColumn("desired", F.col("dst_a") - before("dst_b"))
    return d.withColumn("insert", F.col("desired") - F.col("file_gap"))


def stretch_rate(df: DataFrame, k: str, t: str, lag: str) -> DataFrame:
    """k, rate: one rate for the whole series, 1 less the slope of lag over time, within [0.5, 1.5]; 1 for one point."""
    slope = F.coalesce(F.regr_slope(lag, t), F.lit(0.0))
    return df.groupBy(k).agg(F.least(F.greatest(1 - slope, F.lit(0.5)), F.lit(1.5)).alias("rate"))


def playback_end(markers: DataFrame, k: str, src: str, dst: str, length: float, target: float) -> DataFrame:
    """k, end: when the source of ``length`` is used up at the rate of the last two markers, ``target`` at most; ``target``
    for keys of one marker, with a source that stands still or with both markers at one time."""
    w = Window.partitionBy(k).orderBy(dst)
    rate = F.try_divide(F.col(src) - F.lag(src).over(w), F.col(dst) - F.lag(dst).over(w))
    last = markers.withColumn("_r", rate).groupBy(k).agg(F.max_by(F.struct(F.col(src).alias("s"), F.col(dst).alias("d"), F.col("_r").alias("r")), dst).alias("_l"))
    end = F.col("_l.d") + (length - F.col("_l.s")) / F.when(F.col("_l.r") > 1e-9, F.col("_l.r"))
    return last.select(k, F.least(F.lit(target), F.coalesce(end, F.lit(target))).alias("end"))


def frame_map(df: DataFrame, k: str, src: str, dst: str, rate: float) -> DataFrame:
    """k, src_frame, dst_frame: seconds as frames, without the points whose target frame is not beyond all before it."""
    frames = df.select(k, F.bround(F.col(src) * rate).cast("long").alias("src_frame"), F.bround(F.col(dst) * rate).cast("long").alias("dst_frame"))
    w = Window.partitionBy(k).orderBy("dst_frame", "src_frame").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("_m", F.max("dst_frame").over(w)).where("_m is null or dst_frame > _m").drop("_m")


def rms_gate(blocks: DataFrame, k: str, v: str, share: float = 0.35, floor: float = 1e-5) -> DataFrame:
    """The blocks with v of ``share`` of the key's 60 % quantile or more, and ``floor`` or more."""
    level = blocks.groupBy(k).agg(F.greatest(share * F.percentile(v, 0.6), F.lit(floor)).alias("_t"))
    return blocks.join(level, k).where(F.col(v) >= F.col("_t")).drop("_t")


def activity_start(blocks: DataFrame, k: str, t: str, peak: str, share: float = 0.02, floor: float = 1e-4) -> DataFrame:
    """k, start: the first block with a peak of ``share`` of the peaks' 95 % quantile, ``floor`` at least; 0 if that
    quantile is below ``floor``."""
    level = blocks.groupBy(k).agg(F.percentile(peak, 0.95).alias("_b"))
    d = blocks.join(level, k).where((F.col("_b") < floor) | (F.col(peak) >= F.greatest(share * F.col("_b"), F.lit(floor))))
    return d.groupBy(k).agg(F.when(F.first("_b") < floor, 0.0).otherwise(F.min(t)).alias("start"))


def repair_verdict(points: DataFrame, k: str, t: str, lag: str, railed: str, limit: float) -> DataFrame:
    """k, status, worst, jump, n_railed. Of the points that are not railed: ok within ``limit``, else repair; without any
    such point unresolved. jump is the largest step between them, 0 for one."""
    w = Window.partitionBy(k, railed).orderBy(t)
    d = points.withColumn("_step", F.abs(F.col(lag) - F.lag(lag).over(w)))
    trusted = lambda c: F.when(~F.col(railed), c)
    out = d.groupBy(k).agg(F.max(trusted(F.abs(lag))).alias("worst"), F.coalesce(F.max(trusted(F.col("_step"))), F.lit(0.0)).alias("jump"), F.count_if(railed).alias("n_railed"))
    return out.withColumn("status", F.when(F.col("worst").isNull(), "unresolved").when(F.col("worst") <= limit, "ok").otherwise("repair"))


def phase_at(queries: DataFrame, beats: DataFrame, k: str, t: str) -> DataFrame:
    """queries with phase: the beat number at t, linear between beats and continued at the first or last gap beyond them;
    null for keys with fewer than two beats and beyond an edge where the last two beats are at one time."""
    w = Window.partitionBy(k).orderBy(t)
    numbered = beats.select(k, t, (F.row_number().over(w) - 1).cast("double").alias("n"), (F.col(t) - F.lag(t).over(w)).alias("g"), (F.lead(t).over(w) - F.col(t)).alias("h"))
    both = series.both_neighbours(queries, numbered, k, t, ["n", "g", "h"])
    p, n = F.col(f"p_{t}"), F.col(f"n_{t}")
    inside = F.col("p_n") + F.when(n > p, (F.col(t) - p) / F.when(n > p, n - p)).otherwise(0.0)
    phase = F.when(p.isNull(), F.col("n_n") + F.try_divide(F.col(t) - n, F.col("n_h"))).when(n.isNull(), F.col("p_n") + F.try_divide(F.col(t) - p, F.col("p_g"))).otherwise(inside)
    alone = (p.isNull() & F.col("n_h").isNull()) | (n.isNull() & F.col("p_g").isNull()) | (F.col("p_g").isNull() & F.col("p_h").isNull() & p.isNotNull())
    return both.withColumn("phase", F.when(~alone, phase)).select(*queries.columns, "phase")
