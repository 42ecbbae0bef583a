"""Block correlation and filters against direct sums and sample-by-sample recursion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwright.operators import waves


@pytest.fixture(scope="module")
def signals(spark):
    rng = np.random.default_rng(3)
    ref, qry = {}, {}
    for k, n in ((1, 500), (2, 131), (None, 333)):
        ref[k] = rng.normal(size=n)
        qry[k] = np.concatenate([ref[k][7:], rng.normal(size=20)]) + 0.3 * rng.normal(size=n + 13)
    ref[2][40:90] = 0.0
    ref[3], qry[3] = np.zeros(200), np.zeros(200)
    frame = lambda d: spark.createDataFrame([(k, i, float(v), "clash") for k, y in d.items() for i, v in enumerate(y)], "k long, i long, v double, parts string").repartition(5)
    return ref, qry, frame(ref), frame(qry)


def test_blocks_keep_samples(spark, signals):
    ref, _, df, _ = signals
    got = {}
    for r in waves.blocks(df, ["k"], "i", "v", 64).collect():
        got.setdefault(r.k, {})[r.b] = r.y
    for k, y in ref.items():
        assert np.allclose(np.concatenate([got[k][b] for b in sorted(got[k])]), y)
    odd = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0), (1, 5, None), (1, 9, 4.0), (1, -3, 7.0), (1, None, 7.0)], "k long, i long, v double")
    assert {r.b: r.y for r in waves.blocks(odd, ["k"], "i", "v", 4).collect()} == {0: [3.0, 0, 0, 0], 1: [0.0] * 4, 2: [0.0, 4.0]}
    assert waves.blocks(odd.limit(0), ["k"], "i", "v", 4).count() == 0


def direct_scores(ref, q, first, last):
    q = q - q.mean()
    out = {}
    for lag in range(max(0, first), min(last, len(ref) - len(q)) + 1):
        r = ref[lag : lag + len(q)]
        e, own = r @ r, q @ q
        if e >= max(1e-6, own * 1e-4):
            out[lag] = float(np.clip((r @ q) / np.sqrt(e * own), -1, 1)) if own > 0 else 0.0
    return out


def test_template_scores_equal_direct_sums(spark, signals):
    ref, qry, r, _ = signals
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k in ref:
        for i in range(6):
            a, n, first = int(rng.integers(0, 80)), int(rng.integers(2, 60)), int(rng.integers(-5, 150))
            rows.append((k, i, qry[k][a : a + n].tolist(), first, first + 170))
            want[k, i] = direct_scores(ref[k], qry[k][a : a + min(n, 50)], first, first + 170)
    rows += [(1, 90, [], 0, 9), (1, 91, [1.0, 2.0], None, 9), (9, 92, [1.0, 2.0], 0, 9), (1, 93, [2.0] * 9, 0, 40)]
    want[1, 93] = {lag: 0.0 for lag in direct_scores(ref[1], np.full(9, 2.0) + 0 * ref[1][:9], 0, 40)} or {}
    t = spark.createDataFrame(rows, "k long, id long, q array<double>, first long, last long")
    signal = waves.blocks(r, ["k"], "i", "v", 64)
    scores = waves.template_scores(signal, t, ["k"], 64, 50)
    got = {}
    for x in scores.collect():
        own = got.setdefault((x.k, x.id), {})
        own.update({x.lag + j: s for j, s in enumerate(x.scores) if s is not None})
    assert {k: v for k, v in got.items() if v}.keys() == {k for k, v in want.items() if v}
    for key, expected in want.items():
        own = got.get(key, {})
        assert own.keys() == expected.keys()
        assert all(abs(own[lag] - s) < 1e-9 for lag, s in expected.items())
    places = {(x.k, x.id): x for x in waves.best_places(scores, ["k"], 10).collect()}
    for key, expected in want.items():
        if expected:
            best = max(expected, key=lambda lag: (round(expected[lag], 12), -lag))
            far = [s for lag, s in expected.items() if abs(lag - best) >= 10]
            assert places[key].lag == best
            assert abs(places[key].ratio - (expected[best] / (max(far) + 1e-9) if far else 99)) < 1e-6
        else:
            assert key not in places


def test_score_near_knows_another_place(spark, signals):
    ref, _, r, _ = signals
    signal = waves.blocks(r, ["k"], "i", "v", 64)
    t = spark.createDataFrame([(1, 1, ref[1][100:140].tolist(), 100), (1, 2, ref[1][100:140].tolist(), 90), (1, 3, ref[1][:30].tolist(), -2), (4, 4, [1.0, 2.0], 3)], "k long, id long, q array<double>, at long")
    got = {x.id: x.near for x in waves.score_near(signal, t, ["k"], 64, 50, 15, 4).collect()}
    assert got[1] > 0.9 and got[2] == 0.0 and got[3] > 0.9 and got[4] == 0.0


def test_window_peaks_equal_direct_sums(signals):
    ref, qry, r, q = signals
    size, window, most, apart = 32, 96, 10, 4
    got = {(x.k, x.win): x for x in waves.window_peaks(waves.blocks(r, ["k"], "i", "v", size), waves.blocks(q, ["k"], "i", "v", size), ["k"], size, window, most, apart).collect()}
    for k in ref:
        n = len(qry[k])
        starts = range(0, max(1, n - window), size)
        assert {w for key, w in got if key == k} == {s // size for s in starts}
        for s in starts:
            x, y = qry[k][s : min(n, s + window)], ref[k][s : s + window + most]
            g = got[k, s // size]
            if min(len(x), len(y)) < 8:
                assert (g.lag, g.best) == (0, 0.0)
                continue
            x, y = x - x.mean(), y - y.mean()
            norm = np.linalg.norm(x) * np.linalg.norm(y) or 1e-12
            score = {lag: sum(x[i] * y[i + lag] for i in range(len(x)) if 0 <= i + lag < len(y)) / norm for lag in range(-most, most + 1)}
            best = max(score, key=lambda lag: (round(score[lag], 10), -lag))
            second = max((lag for lag in score if abs(lag - best) >= apart), key=lambda lag: (round(score[lag], 10), -lag))
            assert (g.lag, g.second_lag) == (best, second)
            assert abs(g.best - score[best]) < 1e-9 and abs(g.second - score[second]) < 1e-9
    assert got[1, 0].lag == 7


def test_filter_equals_recursion_and_passes_its_band(spark, signals):
    ref, _, r, _ = signals
    sections = waves.band_pass(150.0, 1000.0, 4000.0)
    sos = np.array(sections)
    assert np.allclose(np.array(waves.band_pass(150.0, 5000.0, 4000.0)), np.array(waves.band_pass(150.0, 1900.0, 4000.0)))
    w = np.exp(-2j * np.pi * np.array([150.0, 1000.0, 390.0, 20.0]) / 4000)
    h = np.prod([(s[0] + s[1] * w + s[2] * w**2) / (1 + s[4] * w + s[5] * w**2) for s in sos], axis=0)
    assert np.allclose(np.abs(h[:2]), np.sqrt(0.5), atol=1e-9) and abs(abs(h[2]) - 1) < 1e-2 and abs(h[3]) < 1e-2
    signal = waves.blocks(r, ["k"], "i", "v", 16).where("not (k <=> 1 and b in (3, 4, 11))")
    got = {}
    for x in waves.filtered(signal, "k", 16, sections, fan=4).collect():
        got.setdefault(x.k, {})[x.b] = x.y
    for k, y in ref.items():
        x = y.copy()
        if k == 1:
            for b in (3, 4, 11):
                x[16 * b : 16 * b + 16] = 0
        for s in sos:
            out, z1, z2 = np.zeros(len(x)), 0.0, 0.0
            for i, v in enumerate(x):
                out[i] = s[0] * v + z1
                z1, z2 = s[1] * v - s[4] * out[i] + z2, s[2] * v - s[5] * out[i]
            x = out
        for b, made in got[k].items():
            assert np.allclose(made, x[16 * b : 16 * b + len(made)], atol=1e-9)


def test_spectral_peak(spark):
    rows = [(k, i, float(np.sin(2 * np.pi * hz * i / 1000.0))) for k, hz in ((1, 62.5), (2, 250.0)) for i in range(600)] + [(3, 0, 1.0)]
    signal = waves.blocks(spark.createDataFrame(rows, "k long, i long, v double"), ["k"], "i", "v", 128)
    assert {r.k: r.hz for r in waves.spectral_peak(signal, "k", 128, 1000.0).collect()} == {1: 62.5, 2: 250.0}
    assert waves.spectral_peak(signal.where(F.col("k") == 3), "k", 128, 1000.0).count() == 0


def test_checkpoints_equal_direct_sums(spark):
    rng = np.random.default_rng(6)
    env = {k: (np.abs(rng.normal(size=n)), np.abs(rng.normal(size=n + 9))) for k, n in ((1, 300), (2, 130), (None, 260))}
    env[1][1][:] = np.concatenate([env[1][0][3:], env[1][0][:12]])  # early by 3
    env[2][1][40:90] = np.concatenate([np.zeros(9), env[2][0][40:81]])  # late by 9, beyond the near search
    frame = lambda j: waves.blocks(spark.createDataFrame([(k, i, float(v)) for k, e in env.items() for i, v in enumerate(e[j])], "k long, i long, v double"), ["k"], "i", "v", 32)
    rows = [(k, s, None, 0.1 if s < 200 else 99.0) for k in env for s in (0, 45, 100, 110, 245, 400, -1)] + [(1, None, None, None), (7, 0, None, None)]
    starts = spark.createDataFrame(rows, "k long, start long, ref_floor double, qry_floor double")
    got = {(r.k, r.start): r for r in waves.checkpoints(frame(0), frame(1), starts, ["k"], 32, 50, 5, 14).collect()}
    want = {}
    for k, (x, y) in env.items():
        n = min(len(x), len(y))
        for s in (0, 45, 100, 110, 245, 400):
            stop = min(n, s + 50)
            if stop - s < 25 or s >= 200:
                continue
            a, b = x[s:stop] - x[s:stop].mean(), y[s:stop] - y[s:stop].mean()
            score = {lag: sum(b[i] * a[i + lag] for i in range(len(b)) if 0 <= i + lag < len(a)) for lag in range(1 - len(b), len(a))}
            best = lambda reach: max((lag for lag in score if abs(lag) <= reach), key=lambda lag: (round(score[lag], 9), -lag))  # noqa: E731, B023
            near, far = best(5), best(14)
            chosen = far if abs(far) > 5 and score[far] > 0 and (score[near] <= 0 or score[far] >= 1.12 * score[near]) else near
            bend = score[chosen - 1] - 2 * score[chosen] + score[chosen + 1]
            want[k, s] = (chosen + float(np.clip(0.5 * (score[chosen - 1] - score[chosen + 1]) / bend, -1, 1)), abs(chosen) >= (14 if abs(chosen) > 5 else 5) - 1, abs(chosen) > 5)
    assert got.keys() == want.keys() and any(w[2] for w in want.values())
    for key, (lag, railed, confirmed) in want.items():
        assert abs(got[key].lag - lag) < 1e-6 and (got[key].railed, got[key].confirmed) == (railed, confirmed)
    assert abs(got[1, 0].lag - 3) < 0.5


def test_clock_and_floors(spark):
    df = waves.blocks(spark.createDataFrame([(1, i, float(i % 10)) for i in range(200)] + [(2, 0, 1.0)], "k long, i long, v double"), ["k"], "i", "v", 64)
    got = sorted((r.k, r.start) for r in waves.clock_starts(df, ["k"], 64, 60, 40).collect())
    assert got == [(1, 30), (1, 90), (1, 150), (2, 30)]
    floors = {r.k: r.floor for r in waves.activity_floors(df, ["k"], 64).collect()}
    assert floors[1] == 0.25 * np.percentile([i % 10 for i in range(200)], 95) and floors[2] == 0.25
