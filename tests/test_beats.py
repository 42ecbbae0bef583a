"""Beat scores and phase smoothing against the rules in plain Python; nulls and short inputs."""

import numpy as np

from lagwright.operators import beats


def direct_score(events, lag, grid, downs, reach, low, high):
    grid, total, weight = sorted(grid), 0.0, 0.0
    usual = [b - a for a, b in zip(grid, grid[1:]) if low < b - a < high]  # noqa: B905
    for e in events:
        m = e + lag
        near = [b for b in grid if abs(b - m) <= reach]
        gaps = [b - a for a, b in zip(near, near[1:]) if low < b - a < high] if len(near) >= 3 else []  # noqa: B905
        period = float(np.median(gaps)) if gaps else float(np.median(usual)) if usual else 0.0
        if period <= 0.05:
            continue
        fit = lambda x, p: max(0.0, 1 - abs(m - x) / (0.35 * p))  # noqa: E731, B023
        score, w = fit(min(grid, key=lambda b: abs(b - m)), period), 1.0  # noqa: B023
        if downs and abs(min(downs, key=lambda b: abs(b - m)) - m) <= 0.5 * period:  # noqa: B023
            score, w = 0.4 * score + 0.6 * fit(min(downs, key=lambda b: abs(b - m)), 4 * period), 2.0  # noqa: B023
        total, weight = total + score * w, weight + w
    return total / weight if weight else 0.0


def test_beat_scores_equal_the_rule(spark):
    rng = np.random.default_rng(1)
    on, bt, dn, pts = {}, {}, {}, []
    for k in (1, 2, 3, 4):
        bt[k] = np.cumsum(rng.uniform(0.4, 0.6, 60)).round(4).tolist() if k != 4 else []
        dn[k] = bt[k][::4] if k != 2 else []
        on[k] = np.sort(rng.uniform(0, 30, 40)).round(4).tolist() if k != 3 else [29.5]
        pts += [(k, i, float(rng.uniform(0, 30)), float(rng.normal(0, 0.3))) for i in range(6)]
    frame = lambda d: spark.createDataFrame([(k, t) for k, x in d.items() for t in x] + [(1, None)], "k long, t double")
    points = spark.createDataFrame([*pts, (9, 0, 1.0, 0.0), (1, 99, None, 0.0), (None, 1, 1.0, 0.0)], "k long, id long, at double, lag double")
    got = {(r.k, r.id): r.beat for r in beats.beat_scores(points, frame(on), frame(bt), frame(dn), "k", ["id"], "at", "lag", 2.0).collect()}
    assert len(got) == len(pts) + 3 and got[9, 0] == got[1, 99] == got[None, 1] == 0.0
    for k, i, at, lag in pts:
        near = [e for e in on[k] if abs(e - at) <= 2.0] or on[k]
        assert abs(got[k, i] - direct_score(near, lag, bt[k], dn[k], 8.0, 0.18, 2.0)) < 1e-9


def test_phase_smoothing_mends_spikes_and_fills_holes(spark):
    grid = [(1, 0.5 * i) for i in range(200)] + [(2, 1.0)]
    rows = [(1, float(t), 0.05, 0.9) for t in range(0, 60, 3) if not 20 < t < 40] + [(1, 10.5, 2.0, 0.9), (1, 50.5, 0.06, 0.1), (2, 1.0, 0.3, 0.1), (1, None, 0.0, 0.9)]
    got = beats.phase_smoothed(spark.createDataFrame(rows, "k long, t double, lag double, score double"), spark.createDataFrame(grid, "k long, t double"), "k")
    by = {(r.k, round(r.t, 6)): (round(r.lag, 9), r.score) for r in got.collect()}
    assert by[1, 10.5] == (0.05, 1.0) and by[1, 50.5] == (0.05, 1.0) and by[1, 9.0] == (0.05, 0.9)
    assert by[1, 28.0] == (0.05, 0.8) and by[2, 1.0] == (0.3, 0.1)
    assert {t for k, t in by if k == 1} >= {2.0 * i for i in range(28)} and (1, None) not in by
