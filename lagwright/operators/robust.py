"""Robust statistics of series (key, t, v): deviations, lines, jumps and the report made of them.

Percentiles are exact with linear interpolation. A line needs a series as a whole: its points come together as one row of
arrays, as many as one recording has, and the median slope is found by counting, without the pairs. A key of null is one
as others; rows with a null time or value take no part in a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed
from .joins import matched
from .waves import mapped

#: Scale of the median absolute deviation to a normal standard deviation (fixed value).
MAD_SCALE = 1.4826
#: Points of a series up to which all its pair slopes are looked at; more are counted. Points below which a line is the best
#: of those through two points (fixed value).
FEW_POINTS, SHORT = 400, 6


def mad(df: DataFrame, k: str, v: str, name: str = "mad") -> DataFrame:
    """k, median, 1.4826 * median |v - median|."""
    mid = df.groupBy(k).agg(F.percentile(v, 0.5).alias("_m"))
    return matched(df, mid, [k]).groupBy(k).agg(F.first("_m").alias("median"), (MAD_SCALE * F.percentile(F.abs(F.col(v) - F.col("_m")), 0.5)).alias(name))


def inversions(values: np.ndarray) -> int:
    """Pairs of which the first is greater, counted a bit of the ranks at a time."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    found = 0
    for bit in range(int(len(values)).bit_length() - 1, -1, -1):
        group, one = rank >> (bit + 1), (rank >> bit) & 1
        ones = np.cumsum(one)
        firsts = np.append(True, group[1:] != group[:-1])
        before = np.maximum.accumulate(np.where(firsts, ones - one, 0))
        found += int((ones - before)[one == 0].sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return found


def kth_slope(t: np.ndarray, v: np.ndarray, k: int) -> float:
    """The k-th smallest slope (from 0) between points of different times: the greatest m of which at most k slopes are
    smaller. A slope is smaller than m if its points lie the other way round in v - m t. t ascends."""

    def smaller(m: float) -> int:
        y = v - m * t
        return inversions(y[np.lexsort((y, t))])

    steps = np.diff(t)
    bound = (v.max() - v.min()) / steps[steps > 0].min() + 1.0
    low, high = -bound, bound
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if smaller(mid) <= k else (low, mid)
    return low


def median_slope(t: np.ndarray, v: np.ndarray) -> float:
    """The median slope between all points of different times; 0 if there are none."""
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    if len(t) <= FEW_POINTS:
        i, j = np.triu_indices(len(t), 1)
        apart = t[j] > t[i]
        slopes = (v[j] - v[i])[apart] / (t[j] - t[i])[apart]
        return float(np.median(slopes)) if len(slopes) else 0.0
    _, same = np.unique(t, return_counts=True)
    pairs = len(t) * (len(t) - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return 0.0
    middle = kth_slope(t, v, (pairs - 1) // 2)
    return middle if pairs % 2 else (middle + kth_slope(t, v, pairs // 2)) / 2


def line_of_pairs(t: np.ndarray, v: np.ndarray, within: float) -> tuple[float, float, np.ndarray]:
    """Slope, intercept and inliers: of all lines through two points of different times the one with most points within
    ``within`` (the first by its points' times on a tie), then least squares through those. Without such a pair all points
    are inliers of a level line at their mean."""
    best = np.ones(len(t), bool)
    most = 0
    for i in np.lexsort((v, t)):
        for j in np.lexsort((v, t)):
            if t[j] > t[i]:
                slope = (v[j] - v[i]) / (t[j] - t[i])
                inside = np.abs(v - v[i] - slope * (t - t[i])) <= within
                if inside.sum() > most:
                    best, most = inside, inside.sum()
    x, y = t[best], v[best]
    spread = ((x - x.mean()) ** 2).sum() if len(x) else 0.0
    slope = float(((x - x.mean()) * (y - y.mean())).sum() / spread) if spread > 0 else 0.0
    return slope, float(y.mean() - slope * x.mean()) if len(x) else 0.0, best


def lines(df: DataFrame, k: str, t: str, v: str, within: float | None = None) -> DataFrame:
    """k, n, slope, intercept, and inside of each series: by the median slope (0 without two times), and the median v less
    slope times the median t; n counts all rows. With ``within``, series of fewer than SHORT points have line_of_pairs()
    instead, and inside holds (t, v) of its inliers; else it is null."""
    point = F.when(F.col(t).isNotNull() & F.col(v).isNotNull(), F.struct(F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v")))
    whole = df.groupBy(k).agg(F.count("*").alias("n"), F.collect_list(point).alias("points"))

    def work(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = []
        for points in c["points"]:
            x, y = (points.values.field(f).to_numpy(zero_copy_only=False) for f in "tv")
            if not len(x):
                out.append((0.0, None, None))
            elif within is not None and len(x) < SHORT:
                slope, level, best = line_of_pairs(x, y, within)
                out.append((slope, level, [{"t": a, "v": b} for a, b in zip(x[best].tolist(), y[best].tolist(), strict=True)]))
            else:
                slope = median_slope(x, y)
                out.append((slope, float(np.median(y) - slope * np.median(x)), None))
        kinds = (pa.float64(), pa.float64(), pa.list_(pa.struct({"t": pa.float64(), "v": pa.float64()})))
        return {name: pa.array([o[i] for o in out], kind) for i, (name, kind) in enumerate(zip(("slope", "intercept", "inside"), kinds, strict=True))}

    return mapped(whole, [k, "n"], work, "slope double, intercept double, inside array<struct<t:double,v:double>>")


def theil_sen(df: DataFrame, k: str, t: str, v: str) -> DataFrame:
    """k, n, slope (median of pair slopes, 0 for one point), intercept (median v less slope times median t)."""
    return lines(df, k, t, v).drop("inside")


def floored(keep: Column, n: Column, k: str, otherwise: Column) -> Column:
    """keep, or ``otherwise`` for keys in which fewer than max(3, n // 5) rows would be kept."""
    left = F.sum(keep.cast("int")).over(Window.partitionBy(k))
    return F.when(left < F.greatest(F.lit(3), F.floor(n / 5)), otherwise).otherwise(keep)


def residuals(df: DataFrame, k: str, t: str, v: str, tolerance: float, score: str | None = None, weak: float = 0.35) -> DataFrame:
    """df with slope, intercept, resid and inlier: |resid| within max(3 MAD of resid, tolerance); all points if fewer
    than max(3, n // 5) are. With ``score``, weak points beyond half the tolerance drop out as well, unless too few would
    be left again. Series of fewer than SHORT points have the best line of pairs and its inliers, whatever their scores.
    Null times and values have no residual and are no inliers."""
    out = matched(df, lines(df, k, t, v, tolerance), [k]).withColumn("resid", F.col(v) - F.col("intercept") - F.col("slope") * F.col(t))
    spread = mad(out, k, "resid", "_mad").select(k, "_mad")
    out = matched(out, spread, [k]).withColumn("_in", F.abs("resid") <= F.greatest(3 * F.col("_mad"), F.lit(tolerance)))
    chosen = F.array_contains("inside", F.struct(F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v")))
    out = out.withColumn("inlier", F.when(F.col("inside").isNotNull(), chosen).otherwise(floored(F.col("_in"), F.col("n"), k, F.lit(True))))
    if score is not None:
        strict = F.col("inlier") & ~F.coalesce((F.col(score) < weak) & (F.abs("resid") > tolerance / 2), F.lit(False))
        held = floored(F.col("_strict"), F.col("n"), k, F.col("inlier"))
        out = out.withColumn("_strict", strict).withColumn("inlier", F.when(F.col("inside").isNotNull(), F.col("inlier")).otherwise(held)).drop("_strict")
    return out.drop("_in", "_mad", "inside")


def with_jumps(df: DataFrame, k: str, t: str, resid: str, floor: float, order: list[str] | None = None) -> DataFrame:
    """df with jump_size and jump_kind, null where there is none: at interior points of which the residual's step from the
    left exceeds max(3 MAD of steps, floor); spike if the step to the right exceeds it too, else step. Points at one time
    are taken in the order of ``order`` (the time alone if not given)."""
    w = Window.partitionBy(k).orderBy(*(order or [t, resid]))
    steps = df.withColumn("_l", F.col(resid) - F.lag(resid).over(w)).withColumn("_r", F.lead(resid).over(w) - F.col(resid))
    spread = mad(steps.where("_l is not null"), k, "_l", "_mad").select(k, "_mad")
    d = matched(steps, spread, [k], "left").withColumn("_thr", F.greatest(3 * F.col("_mad"), F.lit(floor)))
    hit = F.col("_r").isNotNull() & (F.abs("_l") > F.col("_thr"))
    kind = F.when(F.abs("_r") > F.col("_thr"), "spike").otherwise("step")
    return d.withColumns({"jump_size": F.when(hit, F.col("_l")), "jump_kind": F.when(hit, kind)}).drop("_l", "_r", "_mad", "_thr")


def find_jumps(df: DataFrame, k: str, t: str, resid: str, floor: float, order: list[str] | None = None) -> DataFrame:
    """k, t, size, kind of the jumps of with_jumps()."""
    return with_jumps(df, k, t, resid, floor, order).where("jump_size is not null").select(k, t, F.col("jump_size").alias("size"), F.col("jump_kind").alias("kind"))


def decompose(df: DataFrame, k: str, t: str, v: str, score: str, tolerance: float, jump_floor: float, weak: float = 0.35) -> DataFrame:
    """A report of each series: offset, slope, rms, max, median and p95 of the inliers' residuals, jumps, weak share and
    confidence (0 where scores add up to 0). Jump points are no inliers unless fewer than two points would be left."""
    res = with_jumps(residuals(df, k, t, v, tolerance, score, weak), k, t, "resid", jump_floor)
    res = res.withColumn("_ok", F.col("inlier") & F.col("jump_size").isNull())
    res = res.withColumn("_use", F.col("_ok") | (F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(k)) < 2))
    r, used = F.abs("resid"), F.col("_use")
    return res.groupBy(k).agg(
        F.count("*").alias("n"),
        F.first("intercept").alias("offset"),
        F.first("slope").alias("slope"),
        F.sqrt(F.avg(F.when(used, r * r))).alias("rms"),
        F.max(F.when(used, r)).alias("max_abs"),
        F.percentile(F.when(used, r), 0.5).alias("median_abs"),
        F.percentile(F.when(used, r), 0.95).alias("p95_abs"),
        F.count("jump_size").alias("n_jumps"),
        F.avg((F.col(score) < weak).cast("double")).alias("weak_share"),
        F.coalesce(F.try_divide(F.sum(F.when(used, F.col(score)).otherwise(0.0)), F.sum(score)), F.lit(0.0)).alias("confidence"),
    )


def ols_rms(df: DataFrame, k: str, t: str, v: str, least: int = 6) -> DataFrame:
    """k, rms around the least-squares line; 0 below ``least`` points."""
    fit = df.groupBy(k).agg(F.count("*").alias("n"), F.regr_slope(v, t).alias("s"), F.regr_intercept(v, t).alias("c"))
    d = F.col(v) - F.col("c") - F.col("s") * F.col(t)
    return matched(df, fit, [k]).groupBy(k).agg(F.when(F.first("n") < least, 0.0).otherwise(F.sqrt(F.avg(d * d))).alias("rms"))


def weighted_line(df: DataFrame, k: str, t: str, v: str, w: str) -> DataFrame:
    """k, slope, intercept of least squares whose residuals are weighted by w, so that squares are by w * w. Where all
    weights are 0 the slope is 0 and the intercept null."""
    q = F.col(w) * F.col(w)
    s = df.groupBy(k).agg(F.sum(q).alias("a"), F.sum(q * F.col(t)).alias("b"), F.sum(q * F.col(t) * F.col(t)).alias("c"), F.sum(q * F.col(v)).alias("d"), F.sum(q * F.col(t) * F.col(v)).alias("e"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    slope = F.when(F.abs(det) > 1e-12, (F.col("a") * F.col("e") - F.col("b") * F.col("d")) / F.when(det == 0, 1.0).otherwise(det)).otherwise(0.0)
    return s.select(k, slope.alias("slope"), F.try_divide(F.col("d") - slope * F.col("b"), F.col("a")).alias("intercept"))


def weighted_smooth(df: DataFrame, k: str, t: str, v: str, w: str, half: int = 2, floor: float = 0.01) -> DataFrame:
    """df with smooth: the mean over ``half`` rows to either side, weighted by max(w, floor)."""
    win = Window.partitionBy(k).orderBy(t).rowsBetween(-half, half)
    weight = F.greatest(F.col(w), F.lit(floor))
    return df.withColumn("smooth", F.sum(F.col(v) * weight).over(win) / F.sum(weight).over(win))


def pair_line(df: DataFrame, k: str, t: str, v: str, within: float = 0.02) -> DataFrame:
    """k, slope, intercept, n_inliers of series of fewer than SHORT points by line_of_pairs(): all pairs stand in for random
    draws, so the result is one. Longer series have no row."""
    short = lines(df, k, t, v, within).where("inside is not null")
    return short.select(k, "slope", "intercept", F.size("inside").cast("long").alias("n_inliers"))


def strong_line(df: DataFrame, k: str, t: str, v: str, score: str, least: float = 0.1, quantile: float = 0.4) -> DataFrame:
    """weighted_line() over the rows whose score is the larger of ``least`` and the key's ``quantile`` of scores, or more."""
    level = df.groupBy(k).agg(F.greatest(F.lit(least), F.percentile(score, quantile)).alias("_q"))
    return weighted_line(matched(df, level, [k]).where(F.col(score) >= F.col("_q")), k, t, v, score)


def absorb_offset(df: DataFrame, k: str, t: str, v: str, score: str, floor: float = 0.05, small: float = 1e-4) -> DataFrame:
    """df with v less the intercept of the line weighted by max(score, floor), and absorbed (that intercept, 0 where it is
    below ``small``)."""
    line = weighted_line(df.withColumn("_w", F.greatest(F.col(score), F.lit(floor))), k, t, v, "_w").select(k, "intercept")
    taken = F.when(F.abs("intercept") >= small, F.col("intercept")).otherwise(0.0)
    return matched(df, line, [k]).withColumn("absorbed", taken).withColumn(v, F.col(v) - F.col("absorbed")).drop("intercept")


def despiked(df: DataFrame, k: str, t: str, v: str, score: str, limit: float, weak: float = 0.35, half: int = 3) -> DataFrame:
    """k, t, despiked: v, or the median of it and ``half`` values to either side where it is further than ``limit`` from
    that or its score is below ``weak``. Earlier replacements enter later medians, so the rows are streamed, each with the
    values ahead of it."""
    ahead = Window.partitionBy(k).orderBy(t, v).rowsBetween(1, half)
    d = df.select(k, F.col(t).alias("t"), F.col(v).alias("v"), F.col(score).alias("q"), F.collect_list(v).over(ahead).alias("ahead"))

    def step(state, row):
        at, value, quality, coming = row
        before = state or ()
        window = sorted([*before, value, *coming])
        n = len(window)
        middle = (window[(n - 1) // 2] + window[n // 2]) / 2
        if abs(value - middle) > limit or quality < weak:
            value = middle
        return (*before, value)[-half:], [(at, value)]

    return streamed(d, k, ["t", "v", "q", "ahead"], step, "t double, despiked double")
