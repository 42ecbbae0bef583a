"""Ties, zero weights, short and empty series, and the solvers' closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwright.operators import correlate, folds, matching, placement, robust, segments, series, signals, solvers, timemap


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame([(1, 0.0, 1.0, 0.0), (1, 1.0, 2.0, 0.0), (1, 1.0, 5.0, 0.0), (1, 2.0, 3.0, 0.0), (2, 1.0, 1.0, 0.0)], "k long, t double, v double, w double")


def test_ties_and_zero_weights_are_defined(tied):
    assert {r.k for r in series.smoothness(tied, "k", "t", "v").collect()} == {1, 2}
    assert series.gradient(tied, "k", "t", "v", "d").count() == 5
    ends = {r.k: r.end for r in segments.playback_end(tied, "k", "v", "t", 10.0, 12.0).collect()}
    assert ends[2] == 12.0
    assert segments.phase_at(tied.select("k", F.lit(9.0).alias("t")), tied.select("k", "t"), "k", "t").count() == 5
    line = {r.k: r for r in robust.weighted_line(tied, "k", "t", "v", "w").collect()}
    assert line[1].slope == 0 and line[1].intercept is None
    report = {r.k: r for r in robust.decompose(tied, "k", "t", "v", "w", 0.02, 0.04).collect()}
    assert report[1].n == 4 and report[1].confidence == 0.0 and report[2].n == 1
    d = tied.withColumn("band", F.lit("medium")).withColumn("line", F.lit(0.0))
    assert series.certain_lags(d, "k", "t", "v", "band", "line").count() == 5


def test_streamed_folds_see_keys_once_and_in_order(spark):
    rows = [(k, float(t), float(t % 3)) for k in (1, 2, None) for t in range(50)]
    df = spark.createDataFrame(rows, "k long, t double, v double").repartition(7)
    got = folds.streamed(df, "k", ["t", "v"], lambda s, r: ((s or 0.0) + r[1], [(r[0], (s or 0.0) + r[1])]), "t double, total double").collect()
    assert len(got) == 150
    for k in (1, 2, None):
        own = sorted((r.t, r.total) for r in got if r.k == k)
        assert [x for _, x in own] == list(np.cumsum([t % 3 for t in range(50)]))
    assert folds.streamed(df.limit(0), "k", ["t", "v"], lambda s, r: (s, []), "t double", lambda s: [(0.0,)]).count() == 0


def test_limiter_rounds_a_corner(spark):
    df = spark.createDataFrame([(1, float(i), 0.0 if i < 8 else 0.03) for i in range(16)], "k long, t double, lag double")
    rows = sorted(solvers.limited(df, "k").collect())
    moved = [abs(r.limited - (0.0 if r.t < 8 else 0.03)) for r in rows]
    assert max(moved) > 0.001 and moved[-1] < 0.005 and moved[0] == 0


def test_steady_beats_are_one_region(spark):
    rng = np.random.default_rng(1)
    t = np.arange(64) * 0.5 + rng.uniform(-0.004, 0.004, 64)
    found = solvers.regions(t)
    assert sum(b - a for a, b, _ in found) == 63 and max(b - a for a, b, _ in found) >= 40
    assert all(b - a == 1 for a, b, _ in solvers.regions(np.cumsum(np.linspace(0.3, 1.5, 40))))
    df = spark.createDataFrame([(1, float(x)) for x in t] + [(2, 1.0)], "k long, t double")
    assert solvers.ironed(solvers.constant_regions(df, "k"), "k").where("k = 1").count() == 64


def test_short_and_empty_inputs(spark, tied):
    assert {(r.k, r.frame, r.rms) for r in signals.frame_rms(tied, "k", ["t", "v"], "v", 9, 2).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
    assert {r.k: r.slope for r in robust.pair_line(tied.where("k = 2"), "k", "t", "v").collect()} == {2: 0.0}
    none = tied.limit(0)
    assert timemap.bar_ruler(none, "k", "t", 100.0).count() == timemap.silence_runs(none, "k", "t", "v", 1.0, 1.0).count() == 0
    spans = spark.createDataFrame([(1, 0.0, 1.0, 11.0, 12.0), (1, 1.0, 2.0, 11.9, 12.9)], "k long, src_a double, src_b double, dst_a double, dst_b double")
    got = [r for r in placement.with_silence(spans, "k", 12.9).collect() if r.kind == "speech"]
    assert np.isclose(got[0].dst_b, 11.9) and np.isclose(got[0].src_b, 0.9) and len(got) == 2
    assert placement.with_silence(spans.limit(0), "k", 5.0).count() == 0


def test_excerpts_are_found_and_silent_places_are_not(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=60)
    y[30:45] = 0
    ref = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(y)], "k long, f long, v double")
    qry = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(y[12:20])] + [(2, 0, 1.0)], "k long, f long, v double")
    scores = matching.local_scores(ref, qry, "k", "f", "v", 52)
    got = {r.lag: r.score for r in scores.collect()}
    q = y[12:20] - y[12:20].mean()
    want = {n: (y[n : n + 8] @ q) / np.sqrt((y[n : n + 8] ** 2).sum() * (q @ q)) for n in range(53) if (y[n : n + 8] ** 2).sum() >= max(1e-6, 1e-4 * (q @ q))}
    assert got.keys() == want.keys() and not {31, 35} & got.keys()
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)
    best = matching.best_place(scores, "k", 3)
    (row,) = best.collect()
    assert row.lag == 12 and row.ratio == pytest.approx(want[12] / (max(v for n, v in want.items() if abs(n - 12) >= 3) + 1e-9))
    assert matching.best_place(scores.where("lag = 12"), "k", 3).first().ratio == 99
    kinds = matching.preferred(best.limit(0), best, "k").collect()
    assert [(r.lag, r.kind) for r in kinds] == [(12, "chroma")]
    assert matching.local_scores(ref.limit(0), qry, "k", "f", "v", 5).count() == 0


def test_lags_move_onto_the_envelope_only_if_it_fits(spark):
    rng = np.random.default_rng(5)
    y = rng.random(80)
    frame = lambda z, k: [(k, i, float(x)) for i, x in enumerate(z)]
    ref = spark.createDataFrame(frame(y, 1) + frame(np.ones(80), 2), "k long, b long, v double")
    qry = spark.createDataFrame(frame(np.roll(y, 2), 1) + frame(np.ones(80), 2), "k long, b long, v double")
    points = spark.createDataFrame([(1, 1, 30.0, 0.0), (1, 2, 30.0, -2.0), (1, 3, 79.0, 0.0), (1, 4, None, 0.0), (2, 5, 30.0, 0.0)], "k long, i long, t double, lag double")
    got = {r.i: r.refined for r in matching.refined_lags(points, ref, qry, "k", "i", "t", "lag", "b", "v", 1.0, 12, 3).collect()}
    own = np.corrcoef(y[30:42], np.roll(y, 2)[30:42])[0, 1]
    assert got == {1: -2.0 if 0 <= own <= 0.8 else 0.0, 2: -2.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_evidence_follows_what_most_features_say(spark):
    rng = np.random.default_rng(7)
    rows = []
    for feature, lag in (("onset", 3), ("chroma", 3), ("wave", -4)):
        y = rng.random(60)
        rows += [(1, feature, "r", i, float(x)) for i, x in enumerate(y)] + [(1, feature, "q", i, float(y[i + lag])) for i in range(8, 48)]
    d = spark.createDataFrame(rows, "k long, feature string, side string, f long, v double")
    scores = correlate.window_scores(d.where("side = 'r'"), d.where("side = 'q'"), ["k", "feature"], "f", "v", 6, 20, 20, 6, 1e-6)
    weight = F.when(F.col("feature") == "wave", 0.4).otherwise(0.3)
    got = {r.win: r for r in correlate.evidence(scores, "k", "feature", weight, 2, 0.03).collect()}
    assert set(got) == {0, 1, 2}
    assert all(abs(r.fused_lag - 0.09) < 1e-9 and r.fused_score > 0.99 for r in got.values())
    assert correlate.evidence(scores, "k", "feature", weight * 0, 2, 0.03).count() == 0
    assert correlate.evidence(scores.limit(0), "k", "feature", weight, 2, 0.03).count() == 0
