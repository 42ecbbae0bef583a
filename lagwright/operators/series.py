"""Series in time order: joins by nearness and interpolation, islands, monotone sources, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import product_error
from .folds import streamed


def both_neighbours(queries: DataFrame, events: DataFrame, k: str, t: str, carry: list[str]) -> DataFrame:
    """queries with the last event at or before t and the first at or after it (t and ``carry``, prefixed p_ and n_).

    One union sorted by key and time instead of a range join: two window passes over one shuffle, no pairs.
    """
    width = [c for c in queries.columns]
    q = queries.select(*width, F.lit(1).alias("_q"), *(F.lit(None).cast(events.schema[c].dataType).alias(f"_{c}") for c in [t, *carry]))
    e = events.select(*(F.col(c) if c in (k, t) else F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in width), F.lit(0).alias("_q"), *(F.col(c).alias(f"_{c}") for c in [t, *carry]))
    both = q.unionByName(e)
    pack = F.when(F.col("_q") == 0, F.struct(*(F.col(f"_{c}").alias(c) for c in [t, *carry])))
    back = Window.partitionBy(k).orderBy(t, "_q").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(k).orderBy(F.col(t).desc(), "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_p", F.last(pack, ignorenulls=True).over(back)).withColumn("_n", F.last(pack, ignorenulls=True).over(ahead)).where("_q = 1")
    return both.select(*width, *(F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in "pn" for c in [t, *carry]))


def nearest(queries: DataFrame, events: DataFrame, k: str, t: str, within: float | None = None) -> DataFrame:
    """queries with near: the time of the nearest event, the earlier one on a tie, null if none is ``within``."""
    n = both_neighbours(queries, events, k, t, [])
    near = F.when(F.col(f"n_{t}").isNull() | (F.col(t) - F.col(f"p_{t}") <= F.col(f"n_{t}") - F.col(t)), F.col(f"p_{t}")).otherwise(F.col(f"n_{t}"))
    n = n.withColumn("near", near).drop(f"p_{t}", f"n_{t}")
    return n if within is None else n.withColumn("near", F.when(F.abs(F.col("near") - F.col(t)) <= within, F.col("near")))


def interpolate(queries: DataFrame, knots: DataFrame, k: str, t: str, v: str) -> DataFrame:
    """queries with interp: v of the knots linearly between them, held beyond the edges; null without knots."""
    n = both_neighbours(queries, knots, k, t, [v])
    gap = F.col(f"n_{t}") - F.col(f"p_{t}")
    line = F.col(f"p_{v}") + (F.col(f"n_{v}") - F.col(f"p_{v}")) * (F.col(t) - F.col(f"p_{t}")) / F.when(gap == 0, 1.0).otherwise(gap)
    out = F.when(F.col(f"p_{t}").isNull(), F.col(f"n_{v}")).when(F.col(f"n_{t}").isNull(), F.col(f"p_{v}")).otherwise(line)
    return n.withColumn("interp", out).drop(*(f"{s}_{c}" for s in "pn" for c in (t, v)))


def summed(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], *others: Column) -> DataFrame:
    """keys and, by name, the sums of ``values``, added up row by row along ``order``, which tells a key's rows apart; beside
    them ``others``, aggregates of a key's rows. Null is a key as others.

    A sum of doubles hangs on its order; this one is the same however rows lie in partitions, and what adding them up in one
    thread gives. Running sums of one window, so that no key is held.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    d = d.withColumns({"_nr": F.row_number().over(w), **{f"_s{i}": F.sum(f"_v{i}").over(so_far) for i in range(len(values))}})
    return d.groupBy(*keys).agg(*(F.max_by(f"_s{i}", "_nr").alias(name) for i, name in enumerate(values)), *others)


def quantile(v: Column, share: float) -> Column:
    """The aggregate of v's quantile between its neighbours, low * (1 - rest) + high * rest, the first product unrounded:
    F.percentile() rounds both, which may end beside a halfway that this meets."""
    values = F.sort_array(F.collect_list(v))
    at = (F.size(values) - 1) * F.lit(float(share))
    rest = at - F.floor(at)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    one, other = low * (1 - rest), high * rest
    both = one + other
    back = both - one
    lost = (one - (both - back)) + (other - back)
    return F.when(rest == 0, low).otherwise(both + (lost + product_error(low, 1 - rest)))


def islands(df: DataFrame, k: str, t: str, member: Column) -> DataFrame:
    """Runs of rows in which ``member`` holds: k, start, stop (the first time after the run, at the end its last), n."""
    w = Window.partitionBy(k).orderBy(t)
    d = df.withColumn("_m", F.coalesce(member, F.lit(False))).withColumn("_next", F.lead(t).over(w))
    d = d.withColumn("_new", (F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return d.where("_m").groupBy(k, "_run").agg(F.min(t).alias("start"), F.max(F.coalesce("_next", t)).alias("stop"), F.count("*").alias("n")).drop("_run")


def certainty_band(confidence: Column, margin: Column, high: tuple[float, float], medium: tuple[float, float]) -> Column:
    """high, medium or low; both thresholds have to be met."""
    return F.when((confidence >= high[0]) & (margin >= high[1]), "high").when((confidence >= medium[0]) & (margin >= medium[1]), "medium").otherwise("low")


def certain_lags(df: DataFrame, k: str, t: str, v: str, band: str, line: str) -> DataFrame:
    """df with target: high keeps v, low takes the line, medium lies between its neighbouring high points, at one of
    them if there is only one, on the line if there is none."""
    back = Window.partitionBy(k).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(k).orderBy(t).rowsBetween(1, Window.unboundedFollowing)
    point = F.when(F.col(band) == "high", F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    d = df.withColumn("_p", F.last(point, ignorenulls=True).over(back)).withColumn("_n", F.first(point, ignorenulls=True).over(ahead))
    between = F.col("_p.v") + F.try_divide((F.col("_n.v") - F.col("_p.v")) * (F.col(t) - F.col("_p.t")), F.col("_n.t") - F.col("_p.t"))
    medium = F.coalesce(between, F.col("_p.v"), F.col("_n.v"), F.col(line))
    return d.withColumn("target", F.when(F.col(band) == "high", F.col(v)).when(F.col(band) == "medium", medium).otherwise(F.col(line))).drop("_p", "_n")


def monotone(df: DataFrame, k: str, t: str, src: str, step: float = 1e-4) -> DataFrame:
    """df with mono: the least series from below that rises by ``step`` at least, src[i] = max(src[i], src[i-1] + step)."""
    w = Window.partitionBy(k).orderBy(t)
    d = df.withColumn("_i", F.row_number().over(w))
    rest = F.col(src) - F.col("_i") * step
    return d.withColumn("mono", F.max(rest).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * step).drop("_i")


def envelope(df: DataFrame, k: str, t: str, v: str, hop: float) -> DataFrame:
    """k, block, rms, low, high of v in blocks of ``hop``."""
    return df.groupBy(k, F.floor(F.col(t) / hop).alias("block")).agg(F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms"), F.min(v).alias("low"), F.max(v).alias("high"))


def smoothness(df: DataFrame, k: str, t: str, v: str) -> DataFrame:
    """k, the mean size of v's second differences over uneven steps; 0 below three points. Points at one time have no slope
    between them and are left out of the mean."""
    w = Window.partitionBy(k).orderBy(t)
    d = df.withColumn("_a", F.col(t) - F.lag(t).over(w)).withColumn("_b", F.lead(t).over(w) - F.col(t))
    d = d.withColumn("_x", F.col(v) - F.lag(v).over(w)).withColumn("_y", F.lead(v).over(w) - F.col(v))
    second = F.try_divide(2 * (F.try_divide("_y", "_b") - F.try_divide("_x", "_a")), F.col("_a") + F.col("_b"))
    return d.groupBy(k).agg(F.coalesce(F.avg(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.abs(second))), F.lit(0.0)).alias("smoothness"))


def gradient(df: DataFrame, k: str, t: str, v: str, name: str) -> DataFrame:
    """df with the second-order derivative estimate of v over uneven t; one-sided at the edges and
    beside points at one time, null where there is no slope on either side."""
    w = Window.partitionBy(k).orderBy(t)
    d = df.withColumns({"_a": F.col(t) - F.lag(t).over(w), "_b": F.lead(t).over(w) - F.col(t), "_x": F.col(v) - F.lag(v).over(w), "_y": F.lead(v).over(w) - F.col(v)})
    left, right = F.try_divide("_x", "_a"), F.try_divide("_y", "_b")
    both = F.try_divide(left * F.col("_b") + right * F.col("_a"), F.col("_a") + F.col("_b"))
    return d.withColumn(name, F.coalesce(both, right, left)).drop("_a", "_b", "_x", "_y")


def adaptive_markers(df: DataFrame, k: str, t: str, v: str, confidence: str, near_jump: str, least: float = 2.0, most: float = 30.0, gain: float = 1.0) -> DataFrame:
    """k, mark: times at which the series is to be pinned, dense where it bends with confidence.

    Curvature, times gain and confidence, adds up from mark to mark. A point becomes a mark ``most`` after the last, or
    ``least`` after it once 0.0015 / max(gain, 0.15) has come together, or 0.2 after it near a jump; the first and last
    point are marks. The state is the last mark and the sum, so the rows are streamed in order.
    """
    need = 0.0015 / max(gain, 0.15)
    least = max(0.25, least)
    most = max(least, most)
    d = gradient(gradient(df, k, t, v, "_d1"), k, t, "_d1", "_d2")
    dt = F.col(t) - F.lag(t).over(Window.partitionBy(k).orderBy(t))
    d = d.select(k, F.col(t).cast("double").alias("t"), F.coalesce(F.abs("_d2") * gain * dt * F.least(F.greatest(F.col(confidence), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("bend"), F.coalesce(F.col(near_jump), F.lit(False)).alias("jump"))

    def step(state, row):
        at, bend, jump = row
        if state is None:
            return (at, 0.0, at), [(at,)]
        last, bent = state[0], state[1] + bend
        if (jump and at - last >= 0.2) or at - last >= most or (at - last >= least and bent >= need):
            return (at, 0.0, at), [(at,)]
        return (last, bent, at), []

    return streamed(d, k, ["t", "bend", "jump"], step, "mark double", lambda state: [(state[2],)] if state[2] - state[0] > 1e-3 else [])
