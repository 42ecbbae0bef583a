"""Beat grids: periods, cleaning, bar marks, onset peaks and how well onsets meet beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import segments, series, timemap
from .joins import matched


def period(beats: DataFrame, k: str, t: str, low: float, high: float, least: int = 1, default: float = 0.0) -> DataFrame:
    """k, period: the median gap in (low, high), ``default`` if there are fewer than ``least`` such gaps."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(k).orderBy(t))
    good = F.when((F.col("_g") > low) & (F.col("_g") < high), F.col("_g"))
    return beats.withColumn("_g", gap).groupBy(k).agg(F.when(F.count(good) >= least, F.percentile(good, 0.5)).otherwise(default).alias("period"))


def cleaned(beats: DataFrame, k: str, t: str, least: float = 0.001) -> DataFrame:
    """Finite beats that come more than ``least`` after the one before."""
    d = beats.where(F.col(t).isNotNull() & ~F.isnan(t))
    return d.withColumn("_p", F.lag(t).over(Window.partitionBy(k).orderBy(t))).where(F.col("_p").isNull() | (F.col(t) - F.col("_p") > least)).drop("_p")


def bar_marks(downbeats: DataFrame, k: str, t: str, bars: int = 8) -> DataFrame:
    """k, mark: each ``bars``-th downbeat after the first, of keys with more than ``bars`` of them."""
    w = Window.partitionBy(k)
    d = downbeats.withColumn("_i", F.row_number().over(w.orderBy(t)) - 1).withColumn("_n", F.count("*").over(w))
    return d.where((F.col("_n") > bars) & (F.col("_i") > 0) & (F.col("_i") % bars == 0)).select(k, F.col(t).alias("mark"))


def onset_peaks(frames: DataFrame, k: str, i: str, v: str, times: float = 1.8, floor: float = 1e-4) -> DataFrame:
    """Frames above max(times * median, floor), above the one before and not below the next."""
    w = Window.partitionBy(k).orderBy(i)
    level = frames.groupBy(k).agg(F.greatest(times * F.percentile(v, 0.5), F.lit(floor)).alias("_t"))
    d = frames.withColumn("_a", F.lag(v).over(w)).withColumn("_b", F.lead(v).over(w)).join(level, k)
    return d.where((F.col(v) > F.col("_t")) & (F.col(v) > F.col("_a")) & (F.col(v) >= F.col("_b"))).select(k, i, v)


def alignment_score(onsets: DataFrame, beats: DataFrame, k: str, t: str, low: float, high: float) -> DataFrame:
    """k, score: the mean over onsets of max(0, 1 - distance to the nearest beat / (0.35 * period))."""
    near = series.nearest(onsets, beats, k, t).join(period(beats, k, t, low, high), k)
    one = F.greatest(F.lit(0.0), 1 - F.abs(F.col("near") - F.col(t)) / F.greatest(0.35 * F.col("period"), F.lit(1e-9)))
    return near.groupBy(k).agg(F.avg(F.coalesce(one, F.lit(0.0))).alias("score"), F.count("*").alias("n"))


def beat_scores(points: DataFrame, onsets: DataFrame, beats: DataFrame, downbeats: DataFrame, k: str, ids: list[str], at: str, lag: str, half: float, reach: float = 8.0, low: float = 0.18, high: float = 2.0) -> DataFrame:
    """points with beat, 0 to 1: how well their onsets, moved by the point's lag, meet the reference's beats.

    An onset counts by max(0, 1 - distance / (0.35 * period)) to the nearest beat, the period being the local one (see
    timemap.local_period). Where a downbeat lies within half a period, 0.6 of it is the same of the nearest downbeat with a
    bar of four periods, and the onset counts twice. A point's onsets are those within ``half`` of ``at``, met in cells, or
    all of the key if there are none; onsets whose period is 0.05 or less are left out; without any, beat is 0. onsets,
    beats, downbeats: k, t. ``ids`` tell the points of a key apart; points with a null key, time or lag get 0.
    """
    p = points.select(k, *ids, F.col(at).cast("double").alias("_at"), F.col(lag).cast("double").alias("_lag")).where(F.col(k).isNotNull() & F.col("_at").isNotNull() & F.col("_lag").isNotNull())
    o = onsets.select(k, F.col("t").cast("double").alias("_o")).where("_o is not null")
    cell = lambda c: F.floor(F.col(c) / half)
    wide = p.withColumn("_cell", F.explode(F.sequence(cell("_at") - 1, cell("_at") + 1)))
    near = wide.join(o.withColumn("_cell", cell("_o")), [k, "_cell"]).where(F.abs(F.col("_o") - F.col("_at")) <= half).drop("_cell")
    alone = p.join(near.select(k, *ids).distinct(), [k, *ids], "left_anti")
    moved = near.unionByName(alone.join(o, k)).select(k, *ids, (F.col("_o") + F.col("_lag")).alias("t"))
    grid = beats.select(k, F.col("t").cast("double").alias("t")).where("t is not null")
    # Each distinct place is looked up once.
    places = timemap.local_period(moved.select(k, "t").distinct(), grid, k, "t", reach, low, high).where("period > 0.05")
    places = series.nearest(places, grid, k, "t").where("near is not null").withColumnRenamed("near", "_beat")
    places = series.nearest(places, downbeats.select(k, F.col("t").cast("double").alias("t")).where("t is not null"), k, "t")
    fit = lambda to, span: F.greatest(F.lit(0.0), 1 - F.abs(F.col("t") - F.col(to)) / (0.35 * span))
    down = F.coalesce(F.abs(F.col("t") - F.col("near")) <= 0.5 * F.col("period"), F.lit(False))
    one = F.when(down, 0.4 * fit("_beat", F.col("period")) + 0.6 * fit("near", 4 * F.col("period"))).otherwise(fit("_beat", F.col("period")))
    valued = places.select(k, "t", one.alias("_v"), F.when(down, 2.0).otherwise(1.0).alias("_w"))
    scores = moved.join(valued, [k, "t"]).groupBy(k, *ids).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("beat"))
    return matched(points, scores, [k, *ids], "left").withColumn("beat", F.coalesce("beat", F.lit(0.0)))


def with_beat_bonus(candidates: DataFrame, weight: str, beat: str = "beat", bonus: float = 0.35) -> DataFrame:
    """Candidates whose weight grows by ``bonus`` times their beat score, for correlate.fuse()."""
    return candidates.withColumn(weight, F.col(weight) * (1 + bonus * F.col(beat)))


def phase_smoothed(points: DataFrame, beats: DataFrame, k: str, reach: float = 12.0, grid: float = 2.0, low: float = 0.2, high: float = 2.0, trust: float = 0.35, floor: float = 0.08, share: float = 0.35, least: int = 4) -> DataFrame:
    """k, t, lag, score of a lag curve (points: k, t, lag, score) smoothed along the beats (k, t) instead of time.

    A point that is not trusted (score below ``trust``), or further than max(floor, share * local beat) from the median of
    the trusted points within ``reach`` beats, takes that median and score 1; without trusted points that near, the nearest
    one's lag. All points are trusted where fewer than ``least`` would be. Each ``grid`` from the first point on gets the
    lag between its neighbours in beats and score 0.8; where a point lies within 1 ms the point stays instead. Curves of
    fewer than ``least`` points or beats stay as they are. Points with a null time or lag have no row; a null score is 0.

    The median is a range frame over each key's points sorted by beat; holes are filled by one union sorted the same way.
    """
    w = Window.partitionBy(k)
    p = points.where(F.col("t").isNotNull() & F.col("lag").isNotNull()).select(k, F.col("t").cast("double").alias("t"), F.col("lag").cast("double").alias("lag"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    counts = matched(p.groupBy(k).agg(F.count("*").alias("_n")), beats.groupBy(k).agg(F.count("t").alias("_b")), [k], "left")
    p = matched(p, counts.select(k, (F.coalesce(F.least("_n", "_b"), F.lit(0)) >= least).alias("_fit")), [k])
    asis, own = p.where("not _fit"), p.where("_fit").drop("_fit")
    grid_of = own.groupBy(k).agg(F.min("t").alias("_a"), F.max("t").alias("_z"))
    own = segments.phase_at(own, beats, k, "t")
    mids = timemap.smooth_period(beats, k, "t", low, high).select(k, F.col("mid").alias("t"), "period")
    own = series.interpolate(own, mids, k, "t", "period").withColumnRenamed("interp", "_period")
    own = own.withColumn("_sure", F.col("score") >= trust).withColumn("_sure", F.col("_sure") | (F.sum(F.col("_sure").cast("int")).over(w) < least))
    sure = own.where("_sure").select(k, "phase", F.col("lag").alias("v"))
    around = f"over (partition by `{k}` order by phase range between {float(reach)!r}D preceding and {float(reach)!r}D following)"
    own = own.withColumn("_v", F.when(F.col("_sure"), F.col("lag"))).withColumn("_near", F.expr(f"percentile(_v, 0.5D) {around}")).drop("_v")
    own = series.both_neighbours(own, sure, k, "phase", ["v"])
    first = F.col("n_phase").isNull() | (F.col("phase") - F.col("p_phase") <= F.col("n_phase") - F.col("phase"))
    told = F.coalesce("_near", F.when(first, F.col("p_v")).otherwise(F.col("n_v")))
    off = ~F.col("_sure") | (F.abs(F.col("lag") - told) > F.greatest(F.lit(floor), share * F.col("_period")))
    own = own.select(k, "t", "phase", F.when(off, told).otherwise(F.col("lag")).alias("lag"), F.when(off, 1.0).otherwise(F.col("score")).alias("score"))
    ticks = grid_of.select(k, "_a", F.explode(F.sequence(F.lit(0), F.floor((F.col("_z") - F.col("_a") + 1e-6) / grid).cast("int"))).alias("_i")).select(k, (F.col("_a") + F.col("_i") * grid).alias("t"))
    ticks = series.nearest(ticks, own.select(k, "t"), k, "t", 1e-3).where("near is null").drop("near")
    ticks = segments.phase_at(ticks, beats, k, "t")
    filled = series.interpolate(ticks, own.select(k, "phase", "lag"), k, "phase", "lag").select(k, "t", F.col("interp").alias("lag"), F.lit(0.8).alias("score"))
    return asis.select(k, "t", "lag", "score").unionByName(own.select(k, "t", "lag", "score")).unionByName(filled)
