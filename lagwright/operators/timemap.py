"""Time maps: rulers, markers of source against target, how they are looked up and measured."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series
from .folds import streamed
from .joins import matched
from .waves import assembled, mapped, stretches


def bar_ruler(downbeats: DataFrame, k: str, t: str, target: float, bars: int = 8) -> DataFrame:
    """k, mark, span: each ``bars``-th downbeat after the first, within the target. Only for keys with more than ``bars``
    downbeats and four gaps above 0.2; span is ``bars`` median gaps, and marks end half of it before the target does."""
    w = Window.partitionBy(k).orderBy(t)
    d = downbeats.where((F.col(t) >= -1e-3) & (F.col(t) < target - 1)).select(k, F.col(t).alias("mark"), (F.row_number().over(w) - 1).alias("_i"), (F.col(t) - F.lag(t).over(w)).alias("_g"))
    wide = F.when(F.col("_g") > 0.2, F.col("_g"))
    fit = d.groupBy(k).agg(F.count("*").alias("_n"), F.count(wide).alias("_c"), (bars * F.percentile(wide, 0.5)).alias("span")).where((F.col("_n") > bars) & (F.col("_c") >= 4))
    return d.join(fit, k).where((F.col("_i") > 0) & (F.col("_i") % bars == 0) & (F.col("mark") > 1) & (F.col("mark") < target - F.col("span") / 2)).select(k, "mark", "span")


def ruler(keys: DataFrame, downbeats: DataFrame, k: str, t: str, target: float, bars: int = 8, spacing: float = 30.0) -> DataFrame:
    """k, mark, note: bar_ruler() where a key has one, else a clock of ``spacing`` inside (0, target)."""
    own = bar_ruler(downbeats, k, t, target, bars)
    marked = own.select(k, "mark", F.concat(F.lit(f"lag_follow={bars}bars; bar_span="), F.format_string("%.1f", "span"), F.lit("s")).alias("note"))
    bare = keys.select(k).distinct().join(own.select(k).distinct(), k, "left_anti")
    steps = max(0, int((target - 1e-9) // spacing))
    clock = bare.select(k, F.explode(F.array(*(F.lit(spacing * (i + 1)) for i in range(steps))).cast("array<double>")).alias("mark"), F.lit(f"lag_follow={spacing:g}s").alias("note"))
    return marked.unionByName(clock)


def markers(knots: DataFrame, marks: DataFrame, k: str, t: str, lag: str, target: float, length: float, jump: float = 0.04, step: float = 1e-4) -> DataFrame:
    """k, dst, src: at each distinct mark within [0, target] and at 0 the source position dst - lag, lag interpolated and
    held beyond the knots. The source advances by ``step`` at least, except at jumps of the lag; markers beyond the
    source's ``length`` drop out. marks: k and mark; keys without knots have no markers."""
    every = marks.select(k, F.col("mark").alias(t)).where((F.col(t) >= 0) & (F.col(t) <= target)).union(knots.select(k, F.lit(0.0))).distinct()
    d = series.interpolate(every, knots.select(k, t, lag), k, t, lag).where("interp is not null")
    w = Window.partitionBy(k).orderBy(t)
    d = d.withColumn("_new", F.coalesce((F.abs(F.col("interp") - F.lag("interp").over(w)) >= jump).cast("int"), F.lit(0))).withColumns({"_run": F.sum("_new").over(w), "src": F.col(t) - F.col("interp")})
    run = Window.partitionBy(k, "_run").orderBy(t)
    d = d.withColumn("_i", F.row_number().over(run))
    src = F.max(F.col("src") - F.col("_i") * step).over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * step
    return d.withColumn("src", src).where(F.col("src") <= length).select(k, F.col(t).alias("dst"), "src")


def target_of_source(knots: DataFrame, k: str, t: str, lag: str, source: Column, grid: float) -> DataFrame:
    """k, dst: the point of an even grid over the knots' times whose source t - lag comes nearest to ``source`` (the first
    on a tie)."""
    ends = knots.groupBy(k).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    points = ends.select(k, "_a", F.explode(F.sequence(F.lit(0), F.floor((F.col("_b") - F.col("_a")) / grid))).alias("_j")).select(k, (F.col("_a") + F.col("_j") * grid).alias(t))
    d = series.interpolate(points, knots.select(k, t, lag), k, t, lag)
    return d.groupBy(k).agg(F.min(F.struct(F.abs(F.col(t) - F.col("interp") - source).alias("d"), F.col(t).alias("t"))).alias("_m")).select(k, F.col("_m.t").alias("dst"))


def with_knot(knots: DataFrame, new: DataFrame, k: str, t: str, lag: str, within: float = 0.03) -> DataFrame:
    """k, t, lag: the knots, with each new one (one a key) in place of the nearest knot within ``within``, or beside them."""
    n = new.select(k, F.col(t).alias("_t"), F.col(lag).alias("_lag"))
    near = knots.join(n, k).where(F.abs(F.col(t) - F.col("_t")) <= within).groupBy(k).agg(F.min_by(t, F.struct(F.abs(F.col(t) - F.col("_t")), t)).alias("_hit"))
    kept = knots.join(near, k, "left").where(F.col("_hit").isNull() | (F.col(t) != F.col("_hit"))).select(k, t, lag)
    placed = n.join(near, k, "left").select(k, F.coalesce("_hit", "_t").alias(t), F.col("_lag").alias(lag))
    return kept.unionByName(placed)


def silence_runs(df: DataFrame, k: str, t: str, v: str, below: float, least: float) -> DataFrame:
    """k, start, stop: runs of v < ``below`` that last ``least``, begin after the key's first row and end before its last;
    an open run at the end is none."""
    w = Window.partitionBy(k).orderBy(t)
    d = df.withColumns({"_q": F.col(v) < below, "_next": F.lead(t).over(w), "_first": F.min(t).over(Window.partitionBy(k))})
    d = d.withColumn("_new", (F.col("_q") & ~F.coalesce(F.lag("_q").over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w)).where("_q")
    runs = d.groupBy(k, "_run", "_first").agg(F.min(t).alias("start"), F.max("_next").alias("stop"), F.count_if(F.col("_next").isNull()).alias("_open"))
    return runs.where((F.col("_open") == 0) & (F.col("start") > F.col("_first")) & (F.col("stop") - F.col("start") >= least)).select(k, "start", "stop")


def rebased(markers: DataFrame, pads: DataFrame, k: str, src: str, coarse: str) -> DataFrame:
    """markers with src less the key's coarse pad, which moves into the file's front instead, and pad."""
    return markers.join(pads.select(k, F.col(coarse).alias("pad")), k).withColumn(src, F.col(src) - F.col("pad"))


def envelope_scores(ref: DataFrame, qry: DataFrame, k: str, block: str, v: str, most: int, least: int = 32) -> DataFrame:
    """k, shift, score, n: Pearson's correlation of two envelopes at each shift within ``most`` blocks; -1 where fewer than
    ``least`` blocks overlap or one of them is flat."""
    moved = qry.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select(k, "shift", (F.col(block) + F.col("shift")).alias(block), F.col(v).alias("_q"))
    both = moved.join(ref.select(k, block, F.col(v).alias("_r")), [k, block]).groupBy(k, "shift").agg(F.count("*").alias("n"), F.covar_pop("_q", "_r").alias("_c"), F.stddev_pop("_q").alias("_a"), F.stddev_pop("_r").alias("_b"))
    flat = (F.col("_a") < 1e-9) | (F.col("_b") < 1e-9)
    return both.select(k, "shift", F.when((F.col("n") < least) | flat, -1.0).otherwise(F.try_divide("_c", F.col("_a") * F.col("_b"))).alias("score"), "n")


def body_offset(scores: DataFrame, k: str, activity: DataFrame, least: float = 0.45, better: float = 0.15, apart: float = 2.0) -> DataFrame:
    """k, shift, score: the best shift (the first on a tie) if it scores ``least``, beats the score at the activity's shift
    by ``better`` and lies further than ``apart`` from it; other keys have no row. activity: k, at (a shift)."""
    best = scores.groupBy(k).agg(F.max(F.struct("score", (-F.col("shift")).alias("s"))).alias("_b"))
    own = scores.join(activity, k).where(F.col("shift") == F.col("at")).select(k, F.col("score").alias("_own"))
    d = best.join(activity, k).join(own, k, "left")
    fits = (F.col("_b.score") >= least) & (F.col("_b.score") >= F.coalesce("_own", F.lit(-1.0)) + better) & (F.abs(-F.col("_b.s") - F.col("at")) > apart)
    return d.where(fits).select(k, (-F.col("_b.s")).alias("shift"), F.col("_b.score").alias("score"))


def lag_errors(curve: DataFrame, k: str, lag: str, truth: str) -> DataFrame:
    """k, mae, rmse, p95, worst of a lag curve against the truth."""
    e = F.abs(F.col(lag) - F.col(truth))
    return curve.groupBy(k).agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(e, 0.95).alias("p95"), F.max(e).alias("worst"))


def discontinuity_counts(found: DataFrame, truth: DataFrame, k: str, t: str, within: float = 0.75) -> DataFrame:
    """k, n_false, n_missed: detections without a true event ``within``, and true events without a detection."""
    lone = lambda a, b, name: series.nearest(a.select(k, t), b.select(k, t), k, t, within).groupBy(k).agg(F.count_if(F.col("near").isNull()).alias(name))
    both = lone(found, truth, "n_false").join(lone(truth, found, "n_missed"), k, "full_outer")
    return both.select(k, F.coalesce("n_false", F.lit(0)).alias("n_false"), F.coalesce("n_missed", F.lit(0)).alias("n_missed"))


def spans_monotonic(spans: DataFrame, k: str, order: list[str]) -> DataFrame:
    """k, ordered: no span (src_a, src_b, dst_a, dst_b) runs backwards and none begins before the one before it ends; nulls
    of ``order`` come last."""
    w = Window.partitionBy(k).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    good = (F.col("dst_b") + 1e-4 >= F.col("dst_a")) & (F.col("src_b") + 1e-4 >= F.col("src_a")) & F.coalesce(F.col("dst_a") + 1e-3 >= F.lag("dst_b").over(w), F.lit(True))
    return spans.withColumn("_g", good).groupBy(k).agg(F.every("_g").alias("ordered"))


def local_period(queries: DataFrame, beats: DataFrame, k: str, t: str, reach: float, low: float, high: float) -> DataFrame:
    """queries with period: the median of the gaps in (low, high) between the beats within ``reach``, of three beats at
    least; else the whole key's; 0 where there is none. queries: k, t distinct.

    Queries meet these gaps, not the beats, in cells of ``reach``: of gaps above ``low`` at most 2 reach / low are within
    reach, however dense the beats.
    """
    w = Window.partitionBy(k).orderBy(t)
    # A gap with its two beats and the ones around them; of two gaps, or with one of these, there are three beats.
    every = beats.select(k, F.lag(t, 2).over(w).alias("_y"), F.lag(t).over(w).alias("_a"), F.col(t).alias("_b"), F.lead(t).over(w).alias("_z"))
    every = every.withColumn("_g", F.col("_b") - F.col("_a")).where((F.col("_g") > low) & (F.col("_g") < high))
    usual = every.groupBy(k).agg(F.percentile("_g", 0.5).alias("_usual"))
    cell = F.floor(F.col(t) / reach)
    cells = queries.select(k, F.col(t).alias("_q"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"))
    within = lambda c: F.coalesce(F.abs(F.col(c) - F.col("_q")) <= reach, F.lit(False))
    near = cells.join(every.withColumn("_cell", F.floor(F.col("_b") / reach)), [k, "_cell"]).where(within("_a") & within("_b"))
    own = near.groupBy(k, "_q").agg(F.when((F.count("*") > 1) | F.bool_or(within("_y") | within("_z")), F.percentile("_g", 0.5)).alias("_own"))
    d = queries.join(own.withColumnRenamed("_q", t), [k, t], "left").join(usual, k, "left")
    return d.withColumn("period", F.coalesce("_own", "_usual", F.lit(0.0))).drop("_own", "_usual")


def smooth_period(beats: DataFrame, k: str, t: str, low: float, high: float, default: float = 0.5, half: int = 4) -> DataFrame:
    """k, mid, period between each two beats: the median of the gap and ``half`` to either side, gaps outside (low, high)
    replaced by the key's median good gap (``default`` if there is none)."""
    w = Window.partitionBy(k).orderBy(t)
    d = beats.withColumn("_n", F.lead(t).over(w)).where("_n is not null").withColumn("_g", F.col("_n") - F.col(t))
    good = F.when((F.col("_g") > low) & (F.col("_g") < high), F.col("_g"))
    usual = d.groupBy(k).agg(F.coalesce(F.percentile(good, 0.5), F.lit(default)).alias("_u"))
    near = F.sort_array(F.collect_list(F.coalesce(good, F.col("_u"))).over(w.rowsBetween(-half, half)))
    d = d.join(usual, k).withColumn("_s", near)
    n = F.size("_s")
    return d.select(k, ((F.col(t) + F.col("_n")) / 2).alias("mid"), ((F.get("_s", F.floor((n - 1) / 2).cast("int")) + F.get("_s", F.floor(n / 2).cast("int"))) / 2).alias("period"))


def safe_lags(points: DataFrame, onsets: DataFrame, beats: DataFrame, k: str, t: str, lag: str, period: str, reach: float = 0.5) -> DataFrame:
    """points (k, t, lag, period) with safe: the lag that puts the nearest onset on the nearest beat, if that is within half
    a period of the given lag; else that lag. No onset within max(reach, period) leaves it too."""
    p = points.withColumn("_t0", F.col(t))
    q = series.nearest(p.withColumn(t, F.col(t) - F.col(lag)), onsets.select(k, t), k, t)
    held = (F.abs(F.col("near") - F.col(t)) <= F.greatest(F.lit(reach), F.col(period))) & (F.col(period) > 0.05)
    q = q.withColumn("_on", F.when(held, F.col("near"))).drop("near").withColumn(t, F.col("_on") + F.col(lag))
    b = series.nearest(q, beats.select(k, t), k, t)
    snapped = F.col("near") - F.col("_on")
    return b.withColumn("safe", F.when(F.abs(snapped - F.col(lag)) <= 0.5 * F.col(period), snapped).otherwise(F.col(lag))).withColumn(t, F.col("_t0")).drop("_t0", "_on", "near")


def refined_checkpoints(points: DataFrame, wide: DataFrame, k: str, t: str, within: float = 2.0) -> DataFrame:
    """points (k, t, lag, railed) with the railed ones replaced by the nearest of the wider search (k, t, lag, railed)
    within ``within``; where there is none they stay railed."""
    found = series.both_neighbours(points, wide, k, t, ["lag", "railed"])
    before, after = F.col(t) - F.col(f"p_{t}"), F.col(f"n_{t}") - F.col(t)
    first = after.isNull() | (before <= after)
    distance = F.when(before.isNotNull() & first, before).otherwise(after)
    take = F.col("railed") & (distance <= within)
    pick = lambda c: F.when(F.coalesce(take, F.lit(False)), F.when(before.isNotNull() & first, F.col(f"p_{c}")).otherwise(F.col(f"n_{c}"))).otherwise(F.col(c))
    return found.select(k, t, pick("lag").alias("lag"), pick("railed").alias("railed"))


def repair_curve(points: DataFrame, k: str, t: str, lag: str, railed: str, limit: float, hold: float = 30.0) -> DataFrame:
    """k, t, lag: the trusted points of keys that need a repair (one of them beyond ``limit``); a single one is held for
    ``hold``. Railed points are left out."""
    good = points.where(~F.col(railed))
    need = good.groupBy(k).agg(F.max(F.abs(lag)).alias("_worst"), F.count("*").alias("_n")).where(F.col("_worst") > limit)
    d = good.join(need, k)
    once = d.where("_n = 1").select(k, (F.col(t) + hold).alias(t), lag)
    return d.select(k, t, lag).unionByName(once)


def envelope_moves(knots: DataFrame, ref: DataFrame, qry: DataFrame, k: str, t: str, lag: str, rate: float, size: int, window: int, search: int, step: int, digits: int = 9) -> DataFrame:
    """k, t, lag, current, delta, best of knots: how the ``window`` envelope samples of ref from the knot on correlate with
    those of qry at the lag (current), and at the best shift of up to ``search`` samples in steps of ``step`` (best, and
    delta, what it adds to the lag). ref, qry: envelopes in blocks (k, b, y) of ``size`` at ``rate`` samples a second.

    -1 stands for what cannot be told: a window beyond its envelope or flat. The first best shift counts; at the edge of the
    search delta is 0. Knots with a null time or lag have no row. A knot brings its two stretches together, no others.
    """
    ends = lambda df, name: df.groupBy(k).agg(F.max(F.col("b") * size + F.size("y")).alias(name))
    d = knots.where(F.col(t).isNotNull() & F.col(lag).isNotNull()).select(k, F.col(t).cast("double").alias("t"), F.col(lag).cast("double").alias("lag"))
    d = matched(matched(d, ends(ref, "_m"), [k], "left"), ends(qry, "_n"), [k], "left")
    d = d.withColumns({"_a": F.rint(F.col("t") * rate).cast("long"), "_b": F.rint((F.col("t") - F.col("lag")) * rate).cast("long")})
    d = d.withColumns({"_f": F.floor(F.col("_a") / size), "_l": F.floor((F.col("_a") + window - 1) / size)})
    d = stretches(ref, [k], d, "_f", "_l").withColumnRenamed("parts", "_r").withColumns({"_f": F.floor((F.col("_b") - search) / size), "_l": F.floor((F.col("_b") + search + window - 1) / size)})
    d = stretches(qry, [k], d, "_f", "_l")
    # The work is by knot: dealt out in a fixed number of parts, since the joins before may leave all in one.
    spark = d.sparkSession
    d = d.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), k, "t", "lag")
    shifts = np.arange(-search, search + 1, step)

    def centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x - x.mean(-1, keepdims=True)
        return x, np.sqrt((x * x).sum(-1))

    def work(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = []
        for r, q, a, b, m, n in zip(c["_r"], c["parts"], *(c[x].to_pylist() for x in ("_a", "_b", "_m", "_n")), strict=True):
            current, delta, best, at = -1.0, 0.0, -1.0, 0
            if m is not None and n is not None and a >= 0 and a + window <= m:
                x, norm = centred(assembled(r, size, a, a + window))
                # All shifts at once: a row for each.
                s = shifts[(b + shifts >= 0) & (b + shifts + window <= n)]
                if norm >= 1e-6 and len(s):
                    y = assembled(q, size, b - search, b + search + window)
                    z, other = centred(np.lib.stride_tricks.sliding_window_view(y, window)[s + search])
                    some = other >= 1e-6
                    for s, score in zip(s[some].tolist(), ((z[some] @ x) / (norm * other[some])).tolist(), strict=True):
                        score = round(score, digits)
                        current = score if s == 0 else current
                        if score > best:
                            best, at = score, s
                delta = 0.0 if abs(at) >= search - step else -at / rate
            out.append((current, delta, best))
        return {name: pa.array([o[i] for o in out]) for i, name in enumerate(("current", "delta", "best"))}

    return mapped(d, [k, "t", "lag"], work, "current double, delta double, best double")


def pulled_phrases(moves: DataFrame, k: str, hold: float = 1.5, within: float = 6.0, low: float = 0.10, least: float = 0.30, gain: float = 0.22, near: float = 0.12, far: float = 0.38, alike: float = 0.08, sure: float = 0.50) -> DataFrame:
    """k, t, lag of envelope_moves(): phrases that are plainly off are pulled onto their envelope, then rejoin the path.

    A knot asks for a move if current is below ``low``, best is ``least`` or more and by ``gain`` better, and delta's size
    lies from ``near`` to ``far``. Two or more such knots in a row, with deltas ``alike`` the first one's, are a run; it
    counts if a knot with a current of ``sure`` comes after it, not later than ``within`` after its last. Then its median
    delta is added up to ``hold`` after its last knot, and fades out linearly up to that sure knot; the search goes on
    there. A run that does not count stays, and the knot after it may begin the next. At the end the source advances
    again as monotone() has it. Streamed in order of (t, lag), holding back what is undecided: a run and ``within`` of
    knots after it.
    """
    rows = moves.select(k, *(F.col(c).cast("double").alias(c) for c in ("t", "lag", "current", "delta", "best"))).where("t is not null and lag is not null")
    asks = (F.col("current") < low) & (F.col("best") >= least) & (F.col("best") >= F.col("current") + gain) & (F.abs("delta") >= near) & (F.abs("delta") <= far)
    rows = rows.withColumn("asks", F.coalesce(asks, F.lit(False)))

    def settled(held: list[tuple], over: bool) -> tuple[list[tuple], list[tuple]]:
        """What is decided of the rows held back, and the rest."""
        out: list[tuple] = []
        while held:
            stop = 0
            while stop < len(held) and held[stop][5] and abs(held[stop][3] - held[0][3]) <= alike:
                stop += 1
            if stop == len(held) and not over:
                break  # the run goes on
            if stop >= 2:
                limit = held[stop - 1][0] + within
                ahead = [i for i in range(stop, len(held)) if held[i][0] <= limit]
                end = next((i for i in ahead if held[i][2] >= sure), None)
                if end is None and len(ahead) == len(held) - stop and not over:
                    break  # a sure knot may still come
                if end is not None:
                    delta = float(np.median([r[3] for r in held[:stop]]))
                    full = max(i for i in range(end) if held[i][0] <= held[stop - 1][0] + hold)
                    since, span = held[full][0], max(held[end][0] - held[full][0], 1e-3)
                    out += [(r[0], r[1] + (delta if i <= full else delta * max(0.0, 1.0 - (r[0] - since) / span))) for i, r in enumerate(held[:end])]
                    held = held[end:]
                    continue
            out += [r[:2] for r in held[: max(1, stop)]]
            held = held[max(1, stop) :]
        return held, out

    made = streamed(rows, k, ["t", "lag", "current", "delta", "best", "asks"], lambda state, row: settled([*(state or []), row], False), "t double, lag double", lambda state: settled(state, True)[1])
    up = series.monotone(made.withColumn("_src", F.col("t") - F.col("lag")), k, "t", "_src")
    return up.select(k, "t", (F.col("t") - F.col("mono")).alias("lag"))


# Fixed values of reference gaps, in seconds: how long they and the query's silences last, from when on, how much too late the
# query's silence begins, how long the phrase before has to ease into it; the median level of a gap; the least correlation
# of the hits after both, and over how long.
GAP, GAP_FROM, OWN_GAP, LATE, EASE, SILENT, SAME_HIT, HIT = (0.30, 2.0), 1.0, (0.12, 1.5), (0.10, 0.60), 3.5, 0.004, 0.35, 0.30
NEAR_KNOT = 0.03


def quiet_runs(env: np.ndarray, below: float) -> list[tuple[int, int]]:
    """First and next-to-last sample of the runs below a level, without those at either end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], env < below, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if 0 < a and b < len(env)]


def knot_put(t: np.ndarray, lag: np.ndarray, at: float, value: float) -> tuple[np.ndarray, np.ndarray]:
    """The knots with ``value`` at the nearest one within NEAR_KNOT, or at a new one."""
    near = int(np.abs(t - at).argmin())
    if abs(t[near] - at) <= NEAR_KNOT:
        return t, np.where(np.arange(len(t)) == near, value, lag)
    place = int(np.searchsorted(t, at))
    return np.insert(t, place, at), np.insert(lag, place, value)


def own_gap(t: np.ndarray, lag: np.ndarray, ref: np.ndarray, qry: np.ndarray, hop: float, first: int, stop: int, level: float) -> float | None:
    """Where the query's silence begins that ends with the same hit as the reference's gap, if it begins too late."""
    end = stop * hop - float(np.interp(stop * hop, t, lag))
    at = int(round(end / hop))
    if not 1 < at < len(qry):
        return None
    loud = np.flatnonzero(qry[:at] >= level)
    begin = ((int(loud[-1]) if len(loud) else 0) + 1) * hop
    n = max(4, int(round(HIT / hop)))
    if not OWN_GAP[0] <= end - begin <= OWN_GAP[1] or stop + n >= len(ref) or at + n >= len(qry):
        return None
    x, y = ref[stop : stop + n] - ref[stop : stop + n].mean(), qry[at : at + n] - qry[at : at + n].mean()
    norm = float(np.linalg.norm(x) * np.linalg.norm(y))
    if norm < 1e-8 or x @ y / norm < SAME_HIT:
        return None
    grid = np.arange(t[0], t[-1] + 0.01, 0.01)
    placed = float(grid[np.abs(grid - np.interp(grid, t, lag) - begin).argmin()]) if len(grid) > 1 else float(t[0])
    return begin if LATE[0] <= placed - first * hop <= LATE[1] else None


def gaps_fitted(t: np.ndarray, lag: np.ndarray, ref: np.ndarray, qry: np.ndarray, hop: float) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """One recording's knots with its gaps fitted, and the edges of those; see fit_gaps()."""
    levels = [max(0.012, 0.08 * float(np.percentile(x, 90))) for x in (ref, qry)]
    pins: list[float] = []
    for first, stop in quiet_runs(ref, levels[0]):
        g0, g1 = first * hop, stop * hop
        if not GAP[0] <= g1 - g0 <= GAP[1] or g0 < GAP_FROM or np.median(ref[first:stop]) > SILENT:
            continue
        begin = own_gap(t, lag, ref, qry, hop, first, stop, levels[1])
        if begin is None:
            continue
        since = max(float(t[0]), g0 - EASE)
        before, after, wanted = float(np.interp(since, t, lag)), float(np.interp(g1, t, lag)), g0 - begin
        t2, lag2 = knot_put(*knot_put(t, lag, g0, wanted), g1, after)
        inside = (t2 > since) & (t2 < g1 - 1e-3) & (np.abs(t2 - g0) > NEAR_KNOT) & (np.abs(t2 - g1) > NEAR_KNOT)
        ease = np.where(t2 < g0, before + (t2 - since) / max(g0 - since, 1e-3) * (wanted - before), wanted + (t2 - g0) / max(g1 - g0, 1e-3) * (after - wanted))
        lag2 = np.where(inside, ease, lag2)
        for x, value in zip(t, lag, strict=True):  # what lies outside keeps its lag
            near = int(np.abs(t2 - x).argmin())
            if (x <= since or x >= g1) and abs(t2[near] - x) <= NEAR_KNOT:
                lag2[near] = value
        t, lag = t2, lag2
        pins += [g0, g1]
    return t, lag, pins


def fit_gaps(knots: DataFrame, ref: DataFrame, qry: DataFrame, k: str, hop: float) -> DataFrame:
    """k, t, lag, pinned: knots whose phrases fall silent when the reference does, where its next hit is met already.

    A silence of the reference's envelope that lasts 0.3 to 2 and is followed by the same hit as a shorter one of the
    query, which begins 0.1 to 0.6 too late: the query's silence is pinned to the gap's begin, the hit stays at its end,
    and the phrase before eases earlier over 3.5. Gaps are taken in order, each on the knots that the one before left. At
    the end the source advances again as monotone() has it. ref, qry: envelopes in blocks (k, b, y), ``hop`` seconds a
    sample, without missing blocks. A gap changes what the next one sees, so a key's knots and envelopes, one recording's,
    come together as one row. Fewer than four knots or eight samples stay as they are; knots with a null have no row.
    """
    whole = lambda df, name: df.groupBy(k).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("b", "y"))), lambda x: x["y"])).alias(name))
    d = knots.where(F.col("t").isNotNull() & F.col("lag").isNotNull()).groupBy(k).agg(F.sort_array(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("lag").cast("double").alias("lag")))).alias("_k"))
    d = matched(matched(d, whole(ref, "_r"), [k], "left"), whole(qry, "_q"), [k], "left")

    def work(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = []
        for points, r, q in zip(c["_k"], c["_r"], c["_q"], strict=True):
            t, lag = (points.values.field(f).to_numpy(zero_copy_only=False) for f in ("t", "lag"))
            pins: list[float] = []
            if len(t) >= 4 and r.is_valid and q.is_valid and min(len(r), len(q)) >= 8:
                t, lag, pins = gaps_fitted(t, lag, *(x.values.to_numpy(zero_copy_only=False) for x in (r, q)), hop)
            out.append([{"t": a, "lag": b, "pinned": any(abs(a - p) <= NEAR_KNOT for p in pins)} for a, b in zip(t.tolist(), lag.tolist(), strict=True)])
        return {"made": pa.array(out, pa.list_(pa.struct({"t": pa.float64(), "lag": pa.float64(), "pinned": pa.bool_()})))}

    made = mapped(d, [k], work, "made array<struct<t:double,lag:double,pinned:boolean>>").select(k, F.explode("made").alias("_m")).select(k, "_m.*")
    up = series.monotone(made.withColumn("_src", F.col("t") - F.col("lag")), k, "t", "_src")
    return up.select(k, "t", (F.col("t") - F.col("mono")).alias("lag"), "pinned")
