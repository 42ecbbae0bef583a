"""Solvers along a series, streamed: the rate limiter, the lag path and its way back. Beat regions look at one recording's
beats at a time, in a grouped map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import streamed
from .joins import matched

# Seconds of a step that counts as a jump, unit of the costs, half widths of the bands by certainty.
JUMP, UNIT = 0.04, 0.02
BANDS = {"high": 0.50, "medium": 0.15, "low": 0.05}
# Fixed values of beat regions: error of a beat, sum of errors, beats that a region needs.
PHASE, PHASE_SUM, REGION = 0.025, 0.1, 16

#: Stands for a step or a place that is not allowed.
NEVER = 1e9


def steps_priced(moves: np.ndarray, dt: float, stretch: float, free_jump: bool) -> np.ndarray:
    """The price of each move of the lag over ``dt``: nothing within ``stretch``; a jump by its size, where it is free to
    occur; the source has to advance in any case."""
    size = np.abs(moves)
    jump = np.where(size >= JUMP, 0.5 * size / UNIT, NEVER) if free_jump else NEVER
    return np.where(moves > dt - 1e-3, NEVER, np.where(size <= stretch * dt + 1e-9, 0.0, jump))


def cheapest(total: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the cheapest place before it and the cost through that. price: of moves by -(m - 1) to m - 1 places;
    a move's price hangs on its size alone, so all pairs are windows of one vector."""
    m = len(total)
    windows = np.lib.stride_tricks.sliding_window_view(price[::-1], m)[::-1]  # row j: the moves from 0..m-1 to j
    reached = windows + total
    return reached.argmin(1), reached.min(1)


def constrained_path(df: DataFrame, k: str, stretch: float = 0.08, beat_weight: float = 0.0) -> DataFrame:
    """df (k, t, lag, conf, margin, line, beat): k, t, solved, the cheapest path over an even grid of lags.

    A point is drawn to its lag, a weak one to the line, by the squared distance and the more the more certain it is, and
    has to lie in a band around the line, as wide as it is certain. Steps within ``stretch`` are free as long as the source
    advances; a jump costs by its size and needs a certain point on one side. Places that nothing reaches may be reached by
    any advance, at a lower price. Points are taken by (t, lag); the second of two at one time may move by as much as fits
    a millisecond. Points with a null have no row; a single point keeps its lag; a key of null is one as others.

    Streamed twice: forward with the costs of the grid as state, each point leaving where each place came from, then back
    from the last point along these.
    """
    sure = (F.col("margin") >= 0.12) & (F.col("conf") >= 0.45)
    on_beat = ~sure & (F.col("beat") >= 0.70)
    pull = F.when(~sure & ~on_beat & (F.col("conf") < 0.25), F.col("line")).otherwise(F.col("lag"))
    half = F.when(sure, BANDS["high"]).when((F.col("margin") >= 0.04) & (F.col("conf") >= 0.25), BANDS["medium"]).otherwise(BANDS["low"])
    whole = F.col("t").isNotNull()
    for c in ("lag", "conf", "margin", "line", "beat"):
        whole = whole & F.col(c).isNotNull()
    d = df.where(whole).select(k, *(F.col(c).cast("double").alias(c) for c in ("t", "lag", "conf", "margin", "line", "beat")))
    d = d.withColumns({"pull": pull, "weight": 0.25 + F.col("conf") + F.when(on_beat, 0.25 * beat_weight).otherwise(0.0), "sure": sure, "sudden": F.col("margin") >= 0.12})
    below, above = F.col("line") - half, F.col("line") + half
    d = d.withColumns({"bottom": F.when(sure, F.least(below, F.col("lag") - 0.03)).otherwise(below), "top": F.when(sure, F.greatest(above, F.col("lag") + 0.03)).otherwise(above)})
    ends = d.groupBy(k).agg((F.min(F.least("pull", "line", "lag")) - 0.05).alias("low"), (F.max(F.greatest("pull", "line", "lag")) + 0.05).alias("high"), F.count("*").alias("n"))
    ends = ends.withColumn("step", F.greatest(F.lit(0.005), F.greatest(F.col("high") - F.col("low"), F.lit(0.05)) / 80))

    def forward(state, row):
        t, lag, pull, weight, bottom, top, sure, sudden, low, high, step, n = row
        places = low + step * np.arange(int(np.ceil((high + step / 2 - low) / step)))
        m = len(places)
        own = weight * ((places - pull) / UNIT) ** 2
        outside = (places < bottom) | (places > top)
        own = own if outside.all() else np.where(outside, NEVER, own)
        came, at = np.zeros(m, int), 0
        if state is not None:
            at, before, total, was_sure = state
            moves, dt = step * np.arange(1 - m, m), max(t - before, 1e-3)
            came, cost = cheapest(total, steps_priced(moves, dt, stretch, sudden or was_sure))
            if (cut := cost >= NEVER / 2).any():
                other, instead = cheapest(total, np.where(moves <= dt - 1e-3, 0.15 * np.abs(moves) / UNIT, NEVER))
                came, cost = np.where(cut, other, came), np.where(cut, instead, cost)
            own = own + cost
        return (at + 1, t, own, sure), [(-at, t, lag, low, step, n, int(own.argmin()), came.tolist())]

    columns = ["t", "lag", "pull", "weight", "bottom", "top", "sure", "sudden", "low", "high", "step", "n"]
    left = ["t double", "lag double", "low double", "step double", "n long", "best long", "came array<long>"]
    marked = streamed(matched(d, ends, [k]), k, columns, forward, "back long, " + ", ".join(left))

    def backward(state, row):
        _, t, lag, low, step, n, best, came = row
        place = best if state is None else state
        return came[place], [(t, lag if n < 2 else low + step * place)]

    return streamed(marked, k, ["back", *(c.split()[0] for c in left)], backward, "t double, solved double")


def limited(df: DataFrame, k: str, most: float = 0.02, restore: float = 1.5) -> DataFrame:
    """df (k, t, lag): k, t, limited: lags whose source rate turns by ``most`` at most from step to step.

    The source is added up anew from the limited rates and drawn back to the given one over ``restore``, so that a corner
    is rounded and the offset returns; at jumps the rate is free and the source starts from the given one. It always
    advances by 0.0001 at least. Streamed in order of (t, lag). Points with a null time or lag have no row and no part.
    """

    def step(state, row):
        at, lag = row
        src = at - lag
        if state is None:
            return (at, lag, src, None, 0.0, src, src), [(at, lag)]
        before, lag0, src0, rate0, moved0, free0, out0 = state
        dt, moved = at - before, lag - lag0
        rate = (src - src0) / max(dt, 1e-6)
        if rate0 is not None and abs(moved) < JUMP and abs(moved0) < JUMP:
            rate = min(max(rate, rate0 - most), rate0 + most)
        made = free0 + rate * dt
        free = made + min(1.0, max(dt, 0.0) / restore) * (src - made)
        out = max(src if abs(moved) >= JUMP else free, out0 + 1e-4)
        return (at, lag, src, rate, moved, free, out), [(at, at - out)]

    return streamed(df.where(F.col("t").isNotNull() & F.col("lag").isNotNull()), k, ["t", "lag"], step, "t double, limited double")


def likely_ends(t: np.ndarray, left: int) -> np.ndarray:
    """The beats at which a region from ``left`` on may end, a few too many.

    A region's period puts each of its beats but one within PHASE of its place, so lies within PHASE / i of the mean gap up
    to the i-th; and it keeps the errors' running sum, which is the period times 1 + ... + i less the beats' distances so
    far, within PHASE_SUM for all i. So it lies above the largest of the one kind of lower bounds and the second largest of
    the other, below the upper ones alike; the bounds only close in with more beats, and once they cross, no region
    reaches further. Looked at in growing stretches.
    """
    low, low2, high, high2, far = -np.inf, -np.inf, np.inf, np.inf, 0.0
    least, most = -np.inf, np.inf
    start, width, out = left + 1, 32, []
    while start < len(t):
        end = np.arange(start, min(len(t), start + width))
        i = end - left
        mean, slack = (t[end] - t[left]) / i, PHASE / i + 1e-9
        first = np.maximum.accumulate(np.append(low, mean - slack))
        second = np.maximum.accumulate(np.append(low2, np.minimum(mean - slack, first[:-1])))
        last = np.minimum.accumulate(np.append(high, mean + slack))
        next_ = np.minimum.accumulate(np.append(high2, np.maximum(mean + slack, last[:-1])))
        gone, turns = far + np.cumsum(t[end] - t[left]), i * (i + 1) / 2
        lows = np.maximum.accumulate(np.append(least, (gone - PHASE_SUM) / turns - 1e-9))
        highs = np.minimum.accumulate(np.append(most, (gone + PHASE_SUM) / turns + 1e-9))
        bottom, top = np.maximum(second, lows)[1:], np.minimum(next_, highs)[1:]
        none = bottom > top
        out.append(end[(mean >= bottom) & (mean <= top) & (np.cumsum(none) == 0)])
        if none.any():
            break
        low, low2, high, high2, far, least, most = first[-1], second[-1], last[-1], next_[-1], gone[-1], lows[-1], highs[-1]
        start, width = start + width, width * 2
    return np.concatenate(out)


def fits_one_period(own: np.ndarray) -> bool:
    """Whether one period serves all these beats, by the rule of regions()."""
    n = len(own) - 1
    error = own[0] + (own[-1] - own[0]) / n * np.arange(1, n + 1) - own[1:]
    off = np.abs(error) > PHASE
    return bool(off.sum() <= 1 and not off[0] and np.abs(np.cumsum(error)).max() <= PHASE_SUM)


def regions(t: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, period): from each beat on the longest run that one period fits; single gaps where that is fewer than
    REGION beats.

    A run fits if at most one beat, not the first, is off its even place by more than PHASE, the errors' running sum stays
    within PHASE_SUM, and its first and last gap differ from the period by less than PHASE / 2 together. Ends are
    first bounded by likely_ends(), then sifted by their mean gap and last gap; only what is left is tested beat by beat.
    """
    out: list[tuple[int, int, float]] = []
    left = 0
    while left < len(t) - 1:
        ends = likely_ends(t, left)
        mean, first = (t[ends] - t[left]) / (ends - left), t[left + 1] - t[left]
        sharp = (ends <= left + 2) | (np.abs(first + t[ends] - t[ends - 1] - 2 * mean) < PHASE / 2)
        likely = ends[sharp & (np.abs(mean - first) <= PHASE + 1e-9)]
        right = next((int(r) for r in likely[::-1] if fits_one_period(t[left : r + 1])), left + 1)
        if right - left >= REGION:
            out.append((left, right, float((t[right] - t[left]) / (right - left))))
        else:
            out += [(i, i + 1, float(t[i + 1] - t[i])) for i in range(left, right)]
        left = right
    return out


def constant_regions(df: DataFrame, k: str) -> DataFrame:
    """df (k, t): k, start, stop, period, n (gaps) of the regions of constant tempo and the single gaps between them. Beats
    that are null or not finite, or within a millisecond of the one before, are left out; keys of one beat have no region."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        t = rows["t"].to_numpy(float)
        t = np.sort(t[np.isfinite(t)])
        t = t[np.diff(t, prepend=-np.inf) > 0.001]
        found = regions(t)
        return pd.DataFrame({k: pd.Series([rows[k].iloc[0]] * len(found), dtype=rows[k].dtype), "start": [t[a] for a, _, _ in found], "stop": [t[b] for _, b, _ in found], "period": [p for *_, p in found], "n": [b - a for a, b, _ in found]})

    return df.select(k, "t").groupBy(k).applyInPandas(solve, f"{k} {dict(df.dtypes)[k]}, start double, stop double, period double, n long")


def ironed(regions: DataFrame, k: str) -> DataFrame:
    """k, beat: the beats that the regions' periods give, and each key's last one."""
    n = regions.where("period > 0").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    beats = n.select(k, (F.col("start") + F.col("_j") * F.col("period")).alias("beat"))
    return beats.union(regions.groupBy(k).agg(F.max("stop")))
