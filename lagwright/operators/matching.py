"""Where a short excerpt lies in its reference: correlation against each place's own energy, and fine moves of lags on
envelopes. Frames meet by equality on key and frame + lag; no key is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_scores(ref: DataFrame, qry: DataFrame, k: str, frame: str, v: str, most: int) -> DataFrame:
    """k, lag, score: for each lag from 0 to ``most``, the excerpt's mean-removed frames times the reference's frames as
    many later, over both norms, within -1 and 1. The excerpt's frames count from 0.

    Places where the reference lacks a frame, or is next to silent beside the excerpt, have no row: an energy below 1e-6
    and below 1e-4 of the excerpt's. A key without such a place, or with a flat excerpt, has none at all or scores 0.
    A frame that occurs twice counts twice, so its places are not complete and drop out.
    """
    mean = qry.groupBy(k).agg(F.avg(v).alias("_m"), F.count("*").alias("_n"), F.var_pop(v).alias("_p"))
    q = qry.join(mean, k).select(k, F.col(frame).alias("_f"), (F.col(v) - F.col("_m")).alias("_q"), "_n", (F.col("_p") * F.col("_n")).alias("_e"))
    q = q.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("_f", F.col("_f") + F.col("lag"))
    both = q.join(ref.select(k, F.col(frame).alias("_f"), F.col(v).alias("_r")), [k, "_f"])
    s = both.groupBy(k, "lag").agg(F.sum(F.col("_q") * F.col("_r")).alias("_x"), F.sum(F.col("_r") * F.col("_r")).alias("_w"), F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first("_e").alias("_e"))
    s = s.where((F.col("_c") == F.col("_n")) & (F.col("_w") >= F.greatest(F.lit(1e-6), F.col("_e") * 1e-4)))
    score = F.coalesce(F.try_divide("_x", F.sqrt(F.col("_w") * F.col("_e"))), F.lit(0.0))
    return s.select(k, "lag", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("score"))


def best_place(scores: DataFrame, k: str, apart: int) -> DataFrame:
    """k, lag, score, ratio: the first best place, and its score over the best of those ``apart`` or more lags away (99
    where there is none)."""
    best = scores.groupBy(k).agg(F.max(F.struct("score", (-F.col("lag")).alias("l"))).alias("_b"))
    far = F.max(F.when(F.abs(F.col("lag") + F.col("_b.l")) >= apart, F.col("score")))
    out = scores.join(best, k).groupBy(k, "_b").agg(far.alias("_s"))
    ratio = F.when(F.col("_s").isNull(), 99.0).otherwise(F.try_divide("_b.score", F.col("_s") + 1e-9))
    return out.select(k, (-F.col("_b.l")).alias("lag"), F.col("_b.score").alias("score"), ratio.alias("ratio"))


def preferred(wave: DataFrame, chroma: DataFrame, k: str, least: float = 0.15) -> DataFrame:
    """k, lag, score, ratio, kind: the wave's place where it scores ``least`` or more, else the chroma's. Keys of either;
    without any place, lag, score and ratio are 0."""
    side = lambda df, p: df.select(k, F.struct("lag", "score", "ratio").alias(p))
    d = side(wave, "_w").join(side(chroma, "_c"), k, "full")
    sure = F.coalesce(F.col("_w.score") >= least, F.lit(False))
    pick = lambda c, zero: F.coalesce(F.when(sure, F.col(f"_w.{c}")).otherwise(F.col(f"_c.{c}")), zero).alias(c)
    return d.select(k, pick("lag", F.lit(0)), pick("score", F.lit(0.0)), pick("ratio", F.lit(0.0)), F.when(sure, "wave").otherwise("chroma").alias("kind"))


def front_pad(ref_start: Column, qry_start: Column, body: Column, near: float, far: float) -> Column:
    """What a local search cannot see of the offset: the body's offset where it is known, else the difference of the first
    activity; 0 where a search within ``near`` finds it anyway, or beyond ``far``."""
    coarse = F.coalesce(body, ref_start - qry_start)
    return F.when((F.abs(coarse) > near + 0.25) & (F.abs(coarse) <= far), coarse).otherwise(0.0)


def refined_lags(points: DataFrame, ref: DataFrame, qry: DataFrame, k: str, i: str, t: str, lag: str, block: str, v: str, hop: float, window: int, search: int, least: float = 0.7, gain: float = 0.2) -> DataFrame:
    """points, all columns, with refined: the lag moved by at most ``search`` blocks of ``hop`` onto the envelopes, where
    the ``window`` blocks of ref at the point and those of qry at point less lag then correlate with ``least`` or more, and
    by ``gain`` more than unmoved; the earliest block on a tie. ref, qry: k, block, v, a row for each block.

    Unmoved stay points with a null time or lag, whose window lacks a block of ref or, in place, of qry, that is flat in
    either, or whose correlation in place is below 0. ``i`` identifies a point of a key; where it repeats, both stay.
    """
    at = lambda x: F.floor(x / hop + 0.5)
    p = points.select(k, F.col(i).alias("_i"), at(F.col(t)).alias("_a"), at(F.col(t) - F.col(lag)).alias("_b"))
    p = p.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("_a", F.col("_a") + F.col("_j"))
    p = p.join(ref.select(k, F.col(block).alias("_a"), F.col(v).alias("_r")), [k, "_a"])
    p = p.withColumn("_s", F.explode(F.sequence(F.lit(-search), F.lit(search)))).withColumn("_b", F.col("_b") + F.col("_j") + F.col("_s"))
    p = p.join(qry.select(k, F.col(block).alias("_b"), F.col(v).alias("_q")), [k, "_b"])
    s = p.groupBy(k, "_i", "_s").agg(F.count("*").alias("_n"), F.covar_pop("_r", "_q").alias("_c"), F.stddev_pop("_r").alias("_x"), F.stddev_pop("_q").alias("_y"))
    s = s.where((F.col("_n") == window) & (F.col("_x") > 1e-9) & (F.col("_y") > 1e-9)).select(k, "_i", "_s", F.round(F.col("_c") / (F.col("_x") * F.col("_y")), 9).alias("_v"))
    top = s.groupBy(k, "_i").agg(F.max(F.struct("_v", (-F.col("_s")).alias("l"))).alias("_t"), F.max(F.when(F.col("_s") == 0, F.col("_v"))).alias("_o"))
    moves = (F.col("_o") >= 0) & (F.col("_t._v") >= least) & (F.col("_t._v") >= F.col("_o") + gain)
    d = points.join(top.where(moves).select(k, F.col("_i").alias(i), F.col("_t.l").alias("_l")), [k, i], "left")
    return d.select(*points.columns, (F.col(lag) + F.coalesce(F.col("_l"), F.lit(0)) * hop).alias("refined"))
