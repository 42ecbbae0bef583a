"""Signals as rows or arrays: lengths, shifts, frames, gains, fades, and the gates that read levels off them."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_length(y: Column, n: Column) -> Column:
    """The array cut, or filled with zeros, to ``n`` entries; null and empty arrays are all zeros."""
    full = F.coalesce(y, F.array().cast("array<double>"))
    return F.slice(F.concat(full, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(full), F.lit(0)).cast("int"))), F.lit(1), n)


def match_lengths(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with the arrays a and b filled with zeros to the longer one's length."""
    n = F.greatest(F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0)))
    return df.withColumns({a: fit_length(F.col(a), n), b: fit_length(F.col(b), n)})


def shifted(df: DataFrame, t: str, pad: Column) -> DataFrame:
    """Rows moved later by pad (earlier if it is negative); what would begin before 0 is cut."""
    return df.withColumn(t, F.col(t) + pad).where(F.col(t) >= 0)


def decimated(df: DataFrame, k: str, order: list[str], every: int) -> DataFrame:
    """Each ``every``-th row of a key, from the first on."""
    d = df.withColumn("_i", F.row_number().over(Window.partitionBy(k).orderBy(*order)) - 1)
    return d.where(F.col("_i") % every == 0).drop("_i")


def frame_rms(df: DataFrame, k: str, order: list[str], v: str, frame: int, hop: int) -> DataFrame:
    """k, frame, rms over overlapping frames of ``frame`` rows every ``hop``, as many as fit whole; one frame of 0 for keys
    with fewer rows."""
    w = Window.partitionBy(k)
    d = df.select(k, v, (F.row_number().over(w.orderBy(*order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    last = F.floor((F.col("_n") - frame) / hop)
    first = F.greatest(F.ceil((F.col("_i") - frame + 1) / hop), F.lit(0))
    own = F.filter(F.sequence(first, F.greatest(first, F.floor(F.col("_i") / hop))), lambda f: (f <= last) & (f * hop <= F.col("_i")) & (F.col("_i") < f * hop + frame))
    rows = d.where(F.col("_n") >= frame).select(k, v, F.explode(own).alias("frame")).groupBy(k, "frame").agg(F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms"))
    short = d.where(F.col("_n") < frame).select(k).distinct().select(k, F.lit(0).cast("bigint").alias("frame"), F.lit(0.0).alias("rms"))
    return rows.unionByName(short)


def with_gain(df: DataFrame, k: str, v: str, gain: Column, peak: float = 0.99, idle: float = 1e-3) -> DataFrame:
    """df with v times gain, scaled down to ``peak`` where a key would exceed it, and gain_db. Gains within ``idle`` of 1
    change nothing."""
    used = F.when(F.abs(gain - 1) < idle, 1.0).otherwise(gain)
    top = F.max(F.abs(F.col(v) * used)).over(Window.partitionBy(k))
    capped = F.when((used != 1.0) & (top > peak), F.col(v) * used * F.try_divide(F.lit(peak), top)).otherwise(F.col(v) * used)
    return df.withColumns({v: capped, "gain_db": 20 * F.log10(F.greatest(gain, F.lit(1e-9)))})


def positions(df: DataFrame, k: str, order: list[str]) -> DataFrame:
    """df with _i (place in its key, from 0) and _n (rows of the key)."""
    w = Window.partitionBy(k)
    return df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})


def faded(df: DataFrame, k: str, order: list[str], v: str, rows: int) -> DataFrame:
    """df with v ramped linearly over the first and last ``rows`` of a key, a quarter of it at most; no ramp below two."""
    d = positions(df, k, order).withColumn("_f", F.least(F.lit(rows), F.floor(F.col("_n") / 4)))
    ramp = lambda at: F.least(F.lit(1.0), F.try_divide(at, F.col("_f") - 1))
    factor = F.when(F.col("_f") < 2, 1.0).otherwise(ramp(F.col("_i")) * ramp(F.col("_n") - 1 - F.col("_i")))
    return d.withColumn(v, F.col(v) * factor).drop("_i", "_n", "_f")


def edge_faded(df: DataFrame, k: str, order: list[str], v: str, rows_in: int, rows_out: int) -> DataFrame:
    """df with v faded by raised cosines, over ``rows_in`` rows (a quarter at most) in and ``rows_out`` (a third at most)
    out; keys of fewer than 8 rows are left alone."""
    d = positions(df, k, order)

    def edge(at: Column, rows: int, share: int) -> Column:
        n = F.least(F.lit(rows), F.floor(F.col("_n") / share))
        return F.when((n >= 2) & (at < n), 0.5 - 0.5 * F.cos(F.try_divide(at * pi, n - 1))).otherwise(1.0)

    factor = F.when(F.col("_n") < 8, 1.0).otherwise(edge(F.col("_i"), rows_in, 4) * edge(F.col("_n") - 1 - F.col("_i"), rows_out, 3))
    return d.withColumn(v, F.col(v) * factor).drop("_i", "_n")


def audible_windows(df: DataFrame, k: str, window: str, v: str, share: float = 0.25, floor: float = 1e-3) -> DataFrame:
    """k, window, p90 of the windows whose 90 % quantile reaches max(floor, share of the key's 95 % quantile)."""
    level = df.groupBy(k).agg(F.greatest(F.lit(floor), share * F.percentile(v, 0.95)).alias("_floor"))
    p = df.groupBy(k, window).agg(F.percentile(v, 0.9).alias("p90"))
    return p.join(level, k).where(F.col("p90") >= F.col("_floor")).drop("_floor")


def track_class(df: DataFrame, k: str, density: str, duty: str, flatness: str) -> DataFrame:
    """df with kind: what onset density a second, share of loud frames and spectral flatness make of a track."""
    # Thresholds by kind (fixed values); the first that fits decides.
    kind = F.when((F.col(density) >= 2.8) & (F.col(flatness) >= 0.04), "edm").when(F.col(duty) < 0.38, "sparse_vocal").when((F.col(density) < 1.4) & (F.col(flatness) < 0.25), "acoustic")
    return df.withColumn("kind", kind.otherwise("default"))


def duty_cycle(df: DataFrame, k: str, v: str, share: float = 0.85, floor: float = 1e-5) -> DataFrame:
    """k, duty: the share of rows above ``share`` of the key's median, ``floor`` at least."""
    level = df.groupBy(k).agg(F.greatest(share * F.percentile(v, 0.5), F.lit(floor)).alias("_l"))
    return df.join(level, k).groupBy(k).agg(F.avg((F.col(v) > F.col("_l")).cast("double")).alias("duty"))


def profiled(tracks: DataFrame, profiles: DataFrame, name: str, overrides: list[str]) -> DataFrame:
    """tracks with the preset of their profile (the default one for unknown names); where a track has a value of its own in
    a column of ``overrides``, that counts. profiles: name and those columns, a handful of rows."""
    known = profiles.select(F.col("name").alias("_name"), *(F.col(c).alias(f"_{c}") for c in overrides))
    stock = known.where("_name = 'default'").select(*(F.col(f"_{c}").alias(f"_d_{c}") for c in overrides))
    d = tracks.join(F.broadcast(known), F.col(name) == F.col("_name"), "left").join(F.broadcast(stock.limit(1)))
    chosen = {c: F.coalesce(c, F.when(F.col("_name").isNotNull(), F.col(f"_{c}")).otherwise(F.col(f"_d_{c}"))) for c in overrides}
    return d.withColumns({"profile": F.coalesce("_name", F.lit("default")), **chosen}).drop("_name", *(f"_{c}" for c in overrides), *(f"_d_{c}" for c in overrides))


def mixed(parts: DataFrame, k: str, at: str, v: str, limit: float = 1.0) -> DataFrame:
    """k, at, mix: overlapping parts added up, clipped to ``limit``."""
    total = F.sum(v)
    return parts.groupBy(k, at).agg(F.greatest(F.lit(-limit), F.least(F.lit(limit), total)).alias("mix"))
