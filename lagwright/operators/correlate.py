"""Cross-correlation by a bounded lag join: each query frame meets the 2 L + 1 reference frames around it, no others."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import matched


def lag_scan(ref: DataFrame, qry: DataFrame, keys: list[str], frame: str, v: str, most: int) -> DataFrame:
    """keys, lag, score, n: for each lag within ``most``, the sum of products of frames i of qry and i + lag of ref, over
    the square root of the products' energies; mean-removed by key first. Frames that are missing count 0."""

    def centred(df: DataFrame, name: str) -> DataFrame:
        mean = df.groupBy(*keys).agg(F.avg(v).alias("_m"), F.sum(F.col(v) * F.col(v)).alias("_q"), F.count("*").alias("_c"))
        energy = F.col("_q") - F.col("_c") * F.col("_m") * F.col("_m")
        return df.join(mean, keys).select(*keys, F.col(frame).alias("_f"), (F.col(v) - F.col("_m")).alias(name), energy.alias(f"_e{name}"))

    shifted = centred(qry, "q").withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_f", F.col("_f") + F.col("lag"))
    both = shifted.join(centred(ref, "r"), [*keys, "_f"])
    scale = F.sqrt(F.greatest(F.first("_eq") * F.first("_er"), F.lit(1e-12)))
    return both.groupBy(*keys, "lag").agg((F.sum(F.col("q") * F.col("r")) / scale).alias("score"), F.count("*").alias("n"))


def best_and_second(scores: DataFrame, keys: list[str], lag: str, score: str, apart: float) -> DataFrame:
    """keys, best_lag, best, second_lag, second: the first maximum, and the first among lags ``apart`` or more from it
    (second 0 if there is none)."""
    first = lambda cond=None: F.max(F.struct(F.col(score).alias("s"), (-F.col(lag)).alias("l")) if cond is None else F.when(cond, F.struct(F.col(score).alias("s"), (-F.col(lag)).alias("l"))))
    best = scores.groupBy(*keys).agg(first().alias("_b")).select(*keys, (-F.col("_b.l")).alias("best_lag"), F.col("_b.s").alias("best"))
    out = scores.join(best, keys).groupBy(*keys, "best_lag", "best").agg(first(F.abs(F.col(lag) - F.col("best_lag")) >= apart).alias("_s"))
    return out.select(*keys, "best_lag", "best", (-F.col("_s.l")).alias("second_lag"), F.coalesce("_s.s", F.lit(0.0)).alias("second"))


def parabolic(scores: DataFrame, keys: list[str], lag: str, score: str) -> DataFrame:
    """keys, lag, peak: the first maximum's lag moved to the vertex through it and its neighbours, by 1 at most; unmoved
    at an edge or where the three are level."""
    w = Window.partitionBy(*keys).orderBy(lag)
    d = scores.withColumn("_a", F.lag(score).over(w)).withColumn("_c", F.lead(score).over(w))
    bend = F.col("_a") - 2 * F.col(score) + F.col("_c")
    move = F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (F.col("_a") - F.col("_c")) / F.when(bend == 0, 1.0).otherwise(bend)))).otherwise(0.0)
    top = d.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(lag)).alias("l"), F.coalesce(move, F.lit(0.0)).alias("m"))).alias("_t"))
    return top.select(*keys, (-F.col("_t.l")).alias("lag"), (-F.col("_t.l") + F.col("_t.m")).alias("peak"))


def context_weight(feature: Column, base: Column, transient: Column) -> Column:
    """A feature's weight in context: onset and wave gain in transient material, chroma and others elsewhere. A decimal
    if ``base`` is one."""
    # Factors by context (fixed values).
    x = lambda factor: F.lit(Decimal(factor))
    hard = F.when(feature == "onset", x("1.5")).when(feature == "wave", x("1.15")).when(feature == "chroma", x("0.55")).otherwise(x("1.0"))
    soft = F.when(feature == "chroma", x("1.45")).when(feature == "wave", x("1.2")).when(feature == "onset", x("0.45")).when(feature == "spectral", x("1.05")).otherwise(x("1.0"))
    return base * F.when(transient, hard).otherwise(soft)


def fuse(candidates: DataFrame, k: str, cluster: float = 0.04, floor: float = 0.02) -> DataFrame:
    """candidates: k, lag, best, second, w. k, fused_lag, fused_score, second_score, margin.

    Candidates of score ``floor`` or less, or no weight, drop out; weights are made to add up to 1; lags within
    ``cluster`` of the one before form a cluster, and the heaviest (the first on a tie) gives weighted means. Weights that are
    decimals are added up exactly; a sum of doubles hangs on their order.
    """
    c = candidates.where((F.col("best") > floor) & (F.col("w") > 0))
    c = c.withColumn("w", F.col("w").cast("double") / F.sum("w").over(Window.partitionBy(k)).cast("double"))
    w = Window.partitionBy(k).orderBy("lag", "best", "second", "w")
    c = c.withColumn("_c", F.sum((F.col("lag") - F.lag("lag").over(w) > cluster).cast("int")).over(w))
    x = F.greatest(F.col("w") * F.col("best"), F.lit(1e-6))
    g = c.groupBy(k, F.coalesce("_c", F.lit(0)).alias("_c")).agg(F.sum(x).alias("x"), (F.sum(x * F.col("lag")) / F.sum(x)).alias("lag"), (F.sum(x * F.col("best")) / F.sum(x)).alias("score"), (F.sum(x * F.col("second")) / F.sum(x)).alias("second"))
    r = g.withColumn("_r", F.row_number().over(Window.partitionBy(k).orderBy(F.col("x").desc(), "_c")))
    pick = lambda n, c: F.max(F.when(F.col("_r") == n, F.col(c)))
    out = r.groupBy(k).agg(pick(1, "lag").alias("fused_lag"), pick(1, "score").alias("fused_score"), F.greatest(F.coalesce(pick(2, "score"), F.lit(0.0)), pick(1, "second")).alias("second_score"))
    return out.withColumn("margin", F.greatest(F.lit(0.0), F.col("fused_score") - F.col("second_score")))


def windowed(df: DataFrame, keys: list[str], frame: str, window: int, step: int) -> DataFrame:
    """df with win: each row in every window of ``window`` frames, begun each ``step``, that holds its frame."""
    last = F.floor(F.col(frame) / step)
    first = F.floor((F.col(frame) - window) / step) + 1
    return df.withColumn("win", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0)))))


def window_scores(ref: DataFrame, qry: DataFrame, keys: list[str], frame: str, v: str, most: int, window: int, step: int, least: int, quiet: float) -> DataFrame:
    """keys, win, lag, score: for each window of the query with ``least`` frames and a mean square of ``quiet`` or more,
    its correlation with the reference at each lag within ``most``, 0 where fewer than 3 frames meet. The reference
    reaches ``most`` beyond the window. Frames meet by equality on (keys, frame + lag), so a window costs
    window * (2 most + 1) products."""
    q = windowed(qry, keys, frame, window, step)
    stats = q.groupBy(*keys, "win").agg(F.avg(v).alias("_m"), F.count("*").alias("_n"), F.avg(F.col(v) * F.col(v)).alias("_p")).where((F.col("_n") >= least) & (F.col("_p") >= quiet))
    q = q.join(stats, [*keys, "win"]).select(*keys, "win", F.col(frame).alias("_f"), (F.col(v) - F.col("_m")).alias("_q"))
    q = q.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_f", F.col("_f") + F.col("lag"))
    both = q.join(ref.select(*keys, F.col(frame).alias("_f"), F.col(v).alias("_r")), [*keys, "_f"])
    s = both.groupBy(*keys, "win", "lag").agg(F.sum(F.col("_q") * F.col("_r")).alias("_qr"), F.sum("_q").alias("_sq"), F.sum("_r").alias("_sr"), F.sum(F.col("_q") * F.col("_q")).alias("_qq"), F.sum(F.col("_r") * F.col("_r")).alias("_rr"), F.count("*").alias("_c"))
    energy = F.sqrt(F.greatest((F.col("_qq") - F.col("_sq") * F.col("_sq") / F.col("_c")) * (F.col("_rr") - F.col("_sr") * F.col("_sr") / F.col("_c")), F.lit(1e-12)))
    return s.select(*keys, "win", "lag", F.when(F.col("_c") >= 3, (F.col("_qr") - F.col("_sq") * F.col("_sr") / F.col("_c")) / energy).otherwise(0.0).alias("score"))


def window_lags(ref: DataFrame, qry: DataFrame, keys: list[str], frame: str, v: str, most: int, window: int, step: int, least: int, quiet: float) -> DataFrame:
    """keys, win, at (the window's middle), lag, score, railed: of each window in window_scores, the lag at which it meets
    the reference best (the first maximum), moved to the vertex of its neighbours; railed where the maximum is at the edge."""
    s = window_scores(ref, qry, keys, frame, v, most, window, step, least, quiet)
    top = s.groupBy(*keys, "win").agg(F.max(F.struct("score", (-F.col("lag")).alias("l"))).alias("_b"))
    peak = parabolic(s, [*keys, "win"], "lag", "score")
    out = top.join(peak, [*keys, "win"])
    return out.select(*keys, "win", (F.col("win") * step + window / 2).alias("at"), F.col("peak").alias("lag"), F.col("_b.score").alias("score"), (F.abs(F.col("lag")) >= most).alias("railed"))


def evidence(scores: DataFrame, k: str, feature: str, weight: Column, apart: int, unit: float) -> DataFrame:
    """k, win, and fuse()'s columns: for each window, what its features say together of the lag, each by its best lag and
    the best ``apart`` or more from it. scores: k, feature, win, lag (in frames of ``unit`` seconds), score; weight: of a
    feature. Windows in which no feature has a weight and a score have no row."""
    best = best_and_second(scores, [k, feature, "win"], "lag", "score", apart)
    c = best.select(F.struct(k, "win").alias("_at"), (F.col("best_lag") * unit).alias("lag"), "best", F.col("second"), weight.alias("w"))
    return fuse(c, "_at").select(f"_at.{k}", "_at.win", "fused_lag", "fused_score", "second_score", "margin")


def pair_score(lags: DataFrame, coarse: DataFrame, k: str, limit: float, least: float = 0.35, weak: float = 0.25, weak_share: float = 0.35) -> DataFrame:
    """k, corr, drift, weak, verdict of an alignment: coarse (k, corr), and windows' lags (k, lag, score). fail if corr is
    below ``least``, if lags differ by more than ``limit``, or if more than ``weak_share`` of the windows score below
    ``weak``. Keys without windows have drift 0 and weak 1."""
    w = lags.groupBy(k).agg((F.max("lag") - F.min("lag")).alias("drift"), F.avg((F.col("score") < weak).cast("double")).alias("weak"))
    d = coarse.join(w, k, "left").select(k, "corr", F.coalesce("drift", F.lit(0.0)).alias("drift"), F.coalesce("weak", F.lit(1.0)).alias("weak"))
    bad = (F.col("corr") < least) | (F.col("drift") > limit) | (F.col("weak") > weak_share)
    return d.withColumn("verdict", F.when(bad, "fail").otherwise("pass"))


def rises(df: DataFrame, k: str, frame: str, v: str) -> DataFrame:
    """df with v as its rise since the row before, 0 where it falls and at a key's first row."""
    before = F.lag(v).over(Window.partitionBy(k).orderBy(frame))
    return df.withColumn(v, F.coalesce(F.greatest(F.col(v) - before, F.lit(0.0)), F.lit(0.0)))


def peak_normed(df: DataFrame, k: str, v: str) -> DataFrame:
    """df with v over the key's largest |v|; 0 where that is 1e-9 or less."""
    top = F.max(F.abs(v)).over(Window.partitionBy(k))
    return df.withColumn(v, F.when(top > 1e-9, F.col(v) / top).otherwise(0.0))


def mix(a: DataFrame, b: DataFrame, k: str, frame: str, v: str) -> DataFrame:
    """k, frame, v: the sum of two signals, each peak-normed, peak-normed again; a frame that one lacks counts 0 there."""
    both = peak_normed(a.select(k, frame, v), k, v).unionByName(peak_normed(b.select(k, frame, v), k, v))
    return peak_normed(both.groupBy(k, frame).agg(F.sum(v).alias(v)), k, v)


def global_lag(ref: DataFrame, qry: DataFrame, k: str, frame: str, v: str, most: int, better: float = 0.05, digits: int = 9) -> DataFrame:
    """k, feature, lag, corr: the lag within ``most`` frames at which two signals correlate best as a whole, by their values
    (chroma), or by their rises (onset) if these correlate more than ``better`` higher."""

    def best(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        scores = lag_scan(a, b, [k], frame, v, most).withColumn("score", F.round("score", digits))
        return best_and_second(scores, [k], "lag", "score", 1).select(k, F.struct(F.col("best_lag").alias("lag"), F.col("best").alias("corr")).alias(name))

    d = matched(best(ref, qry, "_c"), best(rises(ref, k, frame, v), rises(qry, k, frame, v), "_o"), [k], "left")
    onset = F.coalesce(F.col("_o.corr") > F.col("_c.corr") + better, F.lit(False))
    pick = lambda f: F.when(onset, F.col(f"_o.{f}")).otherwise(F.col(f"_c.{f}")).alias(f)
    return d.select(k, F.when(onset, "onset").otherwise("chroma").alias("feature"), pick("lag"), pick("corr"))


def alignment_score(ref: DataFrame, qry: DataFrame, k: str, frame: str, v: str, most: int, near: int, window: int, step: int, least: int, quiet: float, limit: float) -> DataFrame:
    """k, feature, lag, corr, drift, weak, verdict: how well a query follows its reference (k, frame, v). Both are peak-normed;
    the query is moved by its global_lag() within ``most``, frames before 0 drop out, and windows of it are searched within
    ``near`` (see window_lags); pair_score() judges. Keys that only one of them has, or without a common frame, have no row."""
    r, q = peak_normed(ref.select(k, frame, v), k, v), peak_normed(qry.select(k, frame, v), k, v)
    whole = global_lag(r, q, k, frame, v, most)
    moved = matched(q, whole.select(k, "lag"), [k]).withColumn(frame, F.col(frame) + F.col("lag")).where(F.col(frame) >= 0).select(k, frame, v)
    lags = window_lags(r, moved, [k], frame, v, near, window, step, least, quiet)
    return matched(whole.select(k, "feature", "lag"), pair_score(lags, whole.select(k, "corr"), k, limit), [k])
