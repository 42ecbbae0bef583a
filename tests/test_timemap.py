"""Phrases pulled onto their envelope against the rule applied to whole arrays."""

import numpy as np

from lagwright.operators import timemap, waves


def direct_moves(er, eq, t, lag, rate, win, search, step):
    a, base = round(t * rate), round((t - lag) * rate)
    if a < 0 or a + win > len(er):
        return -1.0, 0.0, -1.0
    x = er[a : a + win] - er[a : a + win].mean()
    current = best = -1.0
    at = 0
    for s in range(-search, search + 1, step):
        if base + s < 0 or base + s + win > len(eq):
            continue
        y = eq[base + s : base + s + win]
        y = y - y.mean()
        if min(np.linalg.norm(x), np.linalg.norm(y)) < 1e-6:
            continue
        score = float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
        current = score if s == 0 else current
        if score > best + 1e-12:
            best, at = score, s
    return current, 0.0 if abs(at) >= search - step else -at / rate, best


def test_moves_equal_direct_correlation(spark):
    rng = np.random.default_rng(1)
    env = {k: (np.abs(rng.normal(size=400)), np.abs(rng.normal(size=380))) for k in (1, 2)}
    env[2][0][100:160] = 0.5
    knots = [(k, float(t), float(lag)) for k in (1, 2, 3) for t, lag in zip(rng.uniform(-5, 45, 40), rng.normal(0, 2, 40), strict=True)] + [(1, None, 0.0), (1, 3.0, None)]
    signal = lambda j: waves.blocks(spark.createDataFrame([(k, i, float(v)) for k, e in env.items() for i, v in enumerate(e[j])], "k long, i long, v double"), ["k"], "i", "v", 32)
    got = timemap.envelope_moves(spark.createDataFrame(knots, "k long, t double, lag double"), signal(0), signal(1), "k", "t", "lag", 10.0, 32, 30, 8, 2).collect()
    assert len(got) == 120
    for r in got:
        want = direct_moves(*env[r.k], r.t, r.lag, 10.0, 30, 8, 2) if r.k != 3 else (-1.0, 0.0, -1.0)
        assert np.allclose((r.current, r.delta, r.best), want, atol=1e-8)


def direct_pull(rows):
    """rows: t, lag, current, delta, best in order."""
    ok = [c < 0.10 and b >= 0.30 and b >= c + 0.22 and 0.12 <= abs(d) <= 0.38 for _, _, c, d, b in rows]
    t, lag = [r[0] for r in rows], [r[1] for r in rows]
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and ok[j] and abs(rows[j][3] - rows[i][3]) <= 0.08:
            j += 1
        if j - i >= 2:
            end = next((e for e in range(j, len(rows)) if t[e] <= t[j - 1] + 6 and rows[e][2] >= 0.5), None)
            if end is not None:
                delta = float(np.median([rows[x][3] for x in range(i, j)]))
                full = max(x for x in range(i, end) if t[x] <= t[j - 1] + 1.5)
                for x in range(i, end):
                    lag[x] += delta if x <= full else delta * max(0, 1 - (t[x] - t[full]) / max(t[end] - t[full], 1e-3))
                i = end
                continue
        i = max(j, i + 1)
    src, out = None, []
    for a, b in zip(t, lag, strict=True):
        src = a - b if src is None else max(a - b, src + 1e-4)
        out.append(round(a - src, 9))
    return out


def test_pulled_phrases_equal_the_rule_on_arrays(spark):
    rng = np.random.default_rng(2)
    keys = {}
    for k in [*range(25), None]:
        n = int(rng.integers(1, 40))
        t = np.cumsum(rng.choice([0.4, 1.0, 3.0], n)).round(3)
        move = np.repeat(rng.choice([0.2, -0.2, 0.3, 0.0], n), 3)[:n] + rng.choice([0.0, 0.03], n)
        current = np.where(rng.random(n) < 0.25, 0.7, 0.0)
        keys[k] = list(zip(t.tolist(), rng.normal(0, 0.05, n).round(4).tolist(), current.tolist(), move.round(3).tolist(), rng.choice([0.5, 0.6, 0.2], n, p=[0.6, 0.3, 0.1]).tolist(), strict=True))
    df = spark.createDataFrame([(k, *r) for k, own in keys.items() for r in own] + [(0, None, 0.0, 0.0, 0.0, 0.0)], "k long, t double, lag double, current double, delta double, best double").repartition(4)
    got = {}
    for r in timemap.pulled_phrases(df, "k").collect():
        got.setdefault(r.k, []).append((r.t, round(r.lag, 9)))
    moved = 0
    for k, own in keys.items():
        want = direct_pull(own)
        moved += sum(abs(w - r[1]) > 0.1 for w, r in zip(want, own, strict=True))
        assert [x for _, x in sorted(got[k])] == want
    assert moved > 20


def gap_case(spark, own=0.5, quiet=0.0, other_hit=False, begin=5.0, knots=None):
    """A reference silent from ``begin`` on for 1 s, a query silent for ``own`` before the same hit; lags of 0."""
    rng = np.random.default_rng(4)
    ref, qry = 0.5 + 0.1 * rng.random(1000), 0.5 + 0.1 * rng.random(1000)
    a, b = int(begin * 100), int(begin * 100) + 100
    ref[a:b], qry[b - int(own * 100) : b] = quiet, 0.0
    hit = 0.6 + 0.3 * rng.random(40)
    ref[b : b + 40], qry[b : b + 40] = hit, hit if not other_hit else hit[::-1].mean() - (hit - hit.mean())
    frame = lambda y: waves.blocks(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "k long, i long, v double"), ["k"], "i", "v", 128)
    knots = spark.createDataFrame(knots or [(1, float(t), 0.0) for t in range(10)], "k long, t double, lag double")
    return sorted((r.t, round(r.lag, 6), r.pinned) for r in timemap.fit_gaps(knots, frame(ref), frame(qry), "k", 0.01).collect())


def test_gap_is_pinned_and_eased_into(spark):
    got = {t: (lag, pinned) for t, lag, pinned in gap_case(spark)}
    assert got[5.0] == (-0.5, True) and got[6.0][0] == 0.0 and got[1.0] == (0.0, False) and got[7.0] == (0.0, False)
    assert abs(got[2.0][0] - -0.5 * 0.5 / 3.5) < 1e-6 and abs(got[4.0][0] - -0.5 * 2.5 / 3.5) < 1e-6
    moved = {t: (lag, pinned) for t, lag, pinned in gap_case(spark, begin=4.4)}
    assert moved[4.4] == (-0.5, True) and moved[5.4] == (0.0, True) and abs(moved[5.0][0] - (-0.5 + 0.6 * 0.5)) < 1e-6


def test_gaps_that_do_not_fit_stay(spark):
    flat = [(float(t), 0.0, False) for t in range(10)]
    for case in ({"own": 0.95}, {"own": 0.2}, {"quiet": 0.011}, {"other_hit": True}, {"begin": 0.5}):
        assert gap_case(spark, **case) == flat
    few = [(1, 0.0, 0.0), (1, 9.0, 0.0), (1, None, 1.0)]
    assert gap_case(spark, knots=few) == [(0.0, 0.0, False), (9.0, 0.0, False)]
    assert gap_case(spark, knots=[(2, float(t), 0.0) for t in range(10)]) == flat


def test_spans_without_a_number_come_last(spark):
    rows = [(1, 1, 5.0), (1, 2, 5.0), (1, None, 9.0), (2, 1, 9.0), (2, None, 5.0)]
    d = spark.createDataFrame(rows, "k int, l int, b double").selectExpr("k", "l", "0D src_a", "b src_b", "5D dst_a", "b dst_b")
    assert {r.k: r.ordered for r in timemap.spans_monotonic(d, "k", ["l"]).collect()} == {1: True, 2: False}
