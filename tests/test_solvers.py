"""The lag path and the beat regions against every path and every region tried; nulls in folds."""

import math

import numpy as np
import pytest

from lagwright.operators import placement, solvers, spans

COLUMNS = "k long, t double, lag double, conf double, margin double, line double, beat double"


def direct_path(points, stretch, beat_weight):
    """The cheapest path by the rules, place after place in plain Python."""
    points = sorted(points)
    if len(points) == 1:
        return [points[0][1]]
    sure = [m >= 0.12 and c >= 0.45 for _, _, c, m, _, _ in points]
    pull = [lag if s or b >= 0.7 or c >= 0.25 else line for (_, lag, c, _, line, b), s in zip(points, sure, strict=True)]
    low = min(min(p, x[4], x[1]) for p, x in zip(pull, points, strict=True)) - 0.05
    high = max(max(p, x[4], x[1]) for p, x in zip(pull, points, strict=True)) + 0.05
    step = max(0.005, max(high - low, 0.05) / 80)
    grid = [low + step * i for i in range(math.ceil((high + step / 2 - low) / step))]
    table = []
    for i, (t, lag, conf, margin, line, beat) in enumerate(points):
        half = 0.5 if sure[i] else 0.15 if margin >= 0.04 and conf >= 0.25 else 0.05
        bottom, top = line - half, line + half
        if sure[i]:
            bottom, top = min(bottom, lag - 0.03), max(top, lag + 0.03)
        weight = 0.25 + conf + (0.25 * beat_weight if not sure[i] and beat >= 0.7 else 0.0)
        inside = [bottom <= g <= top for g in grid]
        own = [weight * ((g - pull[i]) / 0.02) ** 2 if x or not any(inside) else 1e9 for g, x in zip(grid, inside, strict=True)]
        if i == 0:
            table.append([(c, None) for c in own])
            continue
        dt = max(t - points[i - 1][0], 1e-3)
        row = []
        for j, g in enumerate(grid):
            best = (math.inf, None)
            for last in (False, True):
                for p, h in enumerate(grid):
                    d = g - h
                    if d > dt - 1e-3:
                        price = 1e9
                    elif last:
                        price = 0.15 * abs(d) / 0.02
                    elif abs(d) <= stretch * dt + 1e-9:
                        price = 0.0
                    else:
                        price = 0.5 * abs(d) / 0.02 if abs(d) >= 0.04 and (margin >= 0.12 or sure[i - 1]) else 1e9
                    best = min(best, (table[-1][p][0] + price, p))
                if best[0] < 5e8:
                    break
                best = (math.inf, None) if not last else best
            row.append((best[0] + own[j], best[1]))
        table.append(row)
    at = min(range(len(grid)), key=lambda j: table[-1][j][0])
    out = []
    for row in reversed(table):
        out.append(row[at])
        solved = grid[at]
        at, out[-1] = row[at][1], solved
    return out[::-1]


def test_path_equals_all_steps_tried(spark):
    rng = np.random.default_rng(2)
    keys = {}
    for k in [*range(5), None]:
        n = int(rng.integers(2, 14))
        t = np.cumsum(rng.choice([0.0, 0.3, 1.0, 4.0], n))
        lag = np.round(rng.normal(0, 0.1, n) + rng.choice([0.0, 0.3], n), 3)
        keys[k] = [(float(a), float(b), float(c), float(m), 0.01, float(x)) for a, b, c, m, x in zip(t, lag, rng.choice([0.1, 0.3, 0.6, 0.9], n), rng.choice([0.0, 0.05, 0.2], n), rng.choice([0.0, 0.8], n), strict=True)]
    keys[9] = [(1.0, 0.123, 0.5, 0.2, 0.0, 0.0)]
    rows = [(k, *p) for k, own in keys.items() for p in own] + [(0, 1.5, None, 0.5, 0.2, 0.0, 0.0), (8, None, 0.1, 0.5, 0.2, 0.0, 0.0)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    for weight in (0.0, 1.0):
        got = {}
        for r in solvers.constrained_path(df, "k", 0.08, weight).collect():
            got.setdefault(r.k, []).append((r.t, r.solved))
        assert got.keys() == keys.keys()
        for k, own in keys.items():
            want = direct_path(own, 0.08, weight)
            assert sorted((t, round(s, 9)) for t, s in got[k]) == sorted((p[0], round(s, 9)) for p, s in zip(sorted(own), want, strict=True))
    assert solvers.constrained_path(df.limit(0), "k").count() == 0


def test_path_keeps_certain_spikes_and_drops_doubtful_ones(spark):
    rows = [(k, float(i), 0.18 if i == 4 else 0.0, c if i == 4 else 0.75, m if i == 4 else 0.35, 0.0, 0.0) for k, (c, m) in enumerate([(0.85, 0.45), (0.2, 0.01)]) for i in range(8)]
    rows += [(2, t, 0.05 * math.sin(t / 9), 0.9, 0.35, 0.0, 0.0) for t in np.cumsum(np.random.default_rng(1).uniform(0.5, 1.5, 60)).tolist()]
    got = {(r.k, r.t): r.solved for r in solvers.constrained_path(spark.createDataFrame(rows, COLUMNS), "k").collect()}
    assert abs(got[0, 4.0]) > 0.08 > abs(got[1, 4.0])
    assert max(abs(s - 0.05 * math.sin(t / 9)) for (k, t), s in got.items() if k == 2) < 0.02


def direct_regions(t):
    """From each beat on, all ends tried from the last one back, beat by beat."""
    out, left = [], 0
    while left < len(t) - 1:
        for right in range(len(t) - 1, left, -1):
            period = (t[right] - t[left]) / (right - left)
            off = total = 0
            good = True
            for i in range(left + 1, right + 1):
                error = t[left] + period * (i - left) - t[i]
                total += error
                if abs(error) > 0.025:
                    off += 1
                    good &= i > left + 1
                good &= off <= 1 and abs(total) <= 0.1
            border = abs(t[left + 1] - t[left] + t[right] - t[right - 1] - 2 * period) if right > left + 2 else 0
            if good and border < 0.0125:
                break
        else:
            right = left + 1
        out += [(left, right)] if right - left >= 16 else [(i, i + 1) for i in range(left, right)]
        left = right
    return out


@pytest.mark.parametrize("seed", range(12))
def test_regions_equal_all_ends_tried(seed):
    rng = np.random.default_rng(seed)
    gaps = np.repeat(rng.choice([0.4, 0.5, 0.52, 0.6], 5), rng.integers(1, 45, 5))
    t = np.cumsum(gaps) + rng.uniform(-1, 1, len(gaps)) * rng.choice([0.0, 0.003, 0.01, 0.03])
    t[rng.integers(0, len(t), 3)] += 0.04
    t = np.sort(t)
    t = t[np.diff(t, prepend=-np.inf) > 0.001]
    assert [(a, b) for a, b, _ in solvers.regions(t)] == direct_regions(t)


def test_regions_of_many_beats_are_fast():
    rng = np.random.default_rng(0)
    for t in (np.cumsum(rng.uniform(0.3, 0.7, 20_000)), np.arange(20_000) * 0.5 + rng.uniform(-0.005, 0.005, 20_000), np.cumsum(0.5 + 1e-6 * np.arange(20_000))):
        assert sum(b - a for a, b, _ in solvers.regions(t)) == len(t) - 1


def test_beats_that_are_not_finite_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.5 * i) for i in range(20)] + [(1, float("inf")), (1, float("nan")), (1, None), (2, None), (None, 1.0), (None, 2.0)], "k long, t double")
    got = {r.k: r for r in solvers.constant_regions(df, "k").collect()}
    assert got[1].period == 0.5 and got[1].n == 19 and got[None].n == 1 and 2 not in got


def test_nulls_in_folds(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, 1.0, 0.0), (1, 2.0, 0.02), (1, None, 0.5), (1, 3.0, 0.0)], "k long, t double, lag double")
    assert [r.t for r in sorted(solvers.limited(df, "k").collect())] == [1.0, 2.0, 3.0]
    marks = spans.stepped_marks(df, "k", "t", "lag", 0.01).collect()
    assert sorted((r.t, r.v) for r in marks) == [(1.0, 0.0), (2.0, 0.02), (3.0, 0.0)]
    units = spark.createDataFrame([(1, 0.0, 1.0, None, 2.0), (1, 1.0, 2.0, 3.0, 4.0)], "k long, src_a double, src_b double, dst_a double, dst_b double")
    for made in (placement.with_silence(units, "k", 4.0), placement.spans_from_units(units, "k", 4.0, [])):
        assert sorted((r.kind, r.dst_a, r.dst_b) for r in made.collect()) == [("silence", 0.0, 3.0), ("speech", 3.0, 4.0)]


def test_median_slopes_are_counted_right():
    from lagwright.operators import robust

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 401, 700):
        for t in (np.sort(rng.uniform(0, 9, n)), np.sort(rng.integers(0, max(1, n // 3), n)).astype(float)):
            v = np.round(rng.normal(0, 1, n) + 0.3 * t, 2)
            i, j = np.triu_indices(n, 1)
            apart = t[j] > t[i]
            want = float(np.median((v[j] - v[i])[apart] / (t[j] - t[i])[apart])) if apart.any() else 0.0
            assert abs(robust.median_slope(rng.permutation(np.stack([t, v], 1))[:, 0] * 0 + t, v) - want) < 1e-9
    x = rng.integers(0, 40, 300).astype(float)
    assert robust.inversions(x) == sum(a > b for i, a in enumerate(x) for b in x[i + 1 :])


def test_short_series_and_null_keys_keep_their_lines(spark):
    from lagwright.operators import robust

    rows = [(None, float(i), 0.5 * i) for i in range(8)] + [(1, float(i), 0.1 if i < 4 else 3.0) for i in range(5)] + [(2, 1.0, 4.0), (2, 1.0, 6.0), (3, None, 1.0), (None, 9.0, None)]
    df = spark.createDataFrame(rows, "k long, t double, v double").selectExpr("*", "0.9D as score")
    line = {r.k: r for r in robust.theil_sen(df, "k", "t", "v").collect()}
    assert line[None].slope == 0.5 and line[None].n == 9 and line[3].intercept is None and line[2].intercept == 5.0
    got = robust.residuals(df, "k", "t", "v", 0.02, "score").collect()
    assert len(got) == len(rows)
    assert [r.inlier for r in sorted((r for r in got if r.k == 1), key=lambda r: r.t)] == [True] * 4 + [False]
    report = {r.k: r for r in robust.decompose(df, "k", "t", "v", "score", 0.02, 0.04).collect()}
    assert report.keys() == {None, 1, 2, 3} and abs(report[1].offset - 0.1) < 1e-12 and report[1].slope == 0
    assert {r.k for r in robust.mad(df, "k", "v").collect()} == {None, 1, 2, 3}
    assert {r.k for r in robust.pair_line(df, "k", "t", "v").collect()} == {1, 2}
