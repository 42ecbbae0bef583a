"""Sections cut and joined by heaps against the same steps with all sections looked at each time."""

import numpy as np

from lagwright.operators import sections, waves


def slow_more(own, env, hop):
    cur, goal = sorted(own), (3 * len(own) + 1) // 2
    while len(cur) < goal:
        for i in sorted(range(len(cur)), key=lambda i: -(cur[i][1] - cur[i][0])):
            at = sections.quiet_cut(env, hop, *cur[i][:2])
            if at is not None:
                a, b, x, y = cur[i]
                to = x + (at - a) / max(1e-6, b - a) * (y - x)
                cur[i : i + 1] = [(a, at, x, to), (at, b, to, y)]
                break
        else:
            break
    return cur


def slow_fewer(own):
    cur = sorted(own)
    goal = min(max(1, int(len(cur) / 1.5)), len(cur) - 1) if len(cur) > 1 else len(cur)
    while len(cur) > goal:
        i = min(range(len(cur) - 1), key=lambda i: (max(0.0, cur[i + 1][0] - cur[i][1]), cur[i][1] - cur[i][0] + cur[i + 1][1] - cur[i + 1][0]))
        (a, b, x, y), (c, d, z, u) = cur[i : i + 2]
        start = x if a <= c else z
        cur[i : i + 2] = [(min(a, c), max(b, d), start, start + (y - x) + (u - z))]
    return cur


def test_heaps_equal_slow_steps(spark):
    rng = np.random.default_rng(1)
    keys, env = {}, {}
    for k in [*range(12), None]:
        n = int(rng.integers(1, 25))
        gaps = rng.choice([0.0, 0.1, 0.5, 2.0], n)
        size = rng.choice([0.3, 0.5, 1.0, 3.0, 3.0], n)
        start = np.cumsum(gaps + np.concatenate([[0], size[:-1]]))
        keys[k] = [(float(a), float(a + s), float(2 * a), float(2 * a + s * f)) for a, s, f in zip(start, size, rng.choice([1.0, 1.5], n), strict=True)]
        env[k] = rng.integers(0, 4, 2000 if k != 3 else 40).astype(float)
    spans = spark.createDataFrame([(k, *s) for k, own in keys.items() for s in own] + [(0, None, 1.0, 1.0, 1.0)], "k long, src_a double, src_b double, dst_a double, dst_b double").repartition(4)
    signal = waves.blocks(spark.createDataFrame([(k, i, float(v)) for k, y in env.items() if k != 5 for i, v in enumerate(y)], "k long, i long, v double"), ["k"], "i", "v", 128)
    for made, want in ((sections.more_sections(spans, signal, "k", 0.02), {k: slow_more(own, env[k] if k != 5 else np.zeros(0), 0.02) for k, own in keys.items()}), (sections.fewer_sections(spans, "k"), {k: slow_fewer(own) for k, own in keys.items()})):
        got = {}
        for r in made.collect():
            got.setdefault(r.k, []).append((r.src_a, r.src_b, r.dst_a, r.dst_b))
        assert got.keys() == want.keys()
        for k, own in want.items():
            assert np.allclose(sorted(got[k]), sorted(own))
    assert sections.fewer_sections(spans.limit(0), "k").count() == 0


def test_cuts_are_quiet_and_leave_two_sections():
    env = np.ones(1000)
    env[240] = 0.1
    assert sections.quiet_cut(env, 0.02, 2.0, 8.0) == 4.8
    assert sections.quiet_cut(env, 0.02, 0.0, 0.7) is None and sections.quiet_cut(env, 0.02, 30.0, 40.0) == 35.0
    assert sections.quiet_cut(env, 0.02, 0.0, 0.8) == 0.4
