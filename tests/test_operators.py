"""Closed-form cases, invariants of the solvers and empty input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwright.functions import naming
from lagwright.operators import beats, correlate, quality, robust, segments, series, solvers, spans


def test_line_is_recovered(spark):
    rows = [(k, 0.5 + 0.5 * i, 0.25 + 0.002 * (0.5 + 0.5 * i)) for k in (1, 2) for i in range(23)]
    out = robust.theil_sen(spark.createDataFrame(rows, "k int, t double, v double"), "k", "t", "v").toPandas()
    assert np.allclose(out.slope, 0.002) and np.allclose(out.intercept, 0.25)


def test_step_is_a_jump(spark):
    rows = [(1, 0.5 * i, 0.22 if i >= 10 else 0.0, 0.8) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, t double, v double, score double")
    found = robust.find_jumps(df, "k", "t", "v", 0.04).collect()
    assert [(r.t, round(r["size"], 6), r.kind) for r in found] == [(5.0, 0.22, "step")]


def test_keys_do_not_disturb_each_other(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(i), float(rng.normal())) for k in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, t double, v double").withColumn("score", F.lit(0.8))
    together = robust.decompose(df, "k", "t", "v", "score", 0.02, 0.04).toPandas().set_index("k")
    alone = robust.decompose(df.where("k = 3"), "k", "t", "v", "score", 0.02, 0.04).toPandas().set_index("k")
    assert np.allclose(together.loc[3].astype(float), alone.loc[3].astype(float))


def test_fusion_leaves_the_outlier(spark):
    rows = [("a", 0.10, 0.8, 0.1, 0.4), ("a", 0.11, 0.8, 0.1, 0.4), ("a", 0.90, 0.7, 0.1, 0.2)]
    out = correlate.fuse(spark.createDataFrame(rows, "k string, lag double, best double, second double, w double"), "k").first()
    assert abs(out.fused_lag - 0.105) < 0.03 and out.margin > 0


def test_lag_scan_finds_the_shift(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=60)
    ref = spark.createDataFrame([(1, i, float(y[i])) for i in range(60)], "k int, f long, v double")
    qry = spark.createDataFrame([(1, i, float(y[i + 4])) for i in range(56)], "k int, f long, v double")
    best = correlate.best_and_second(correlate.lag_scan(ref, qry, ["k"], "f", "v", 10), ["k"], "lag", "score", 3).first()
    assert best.best_lag == 4 and best.best > 0.9


def test_nearest_takes_the_earlier_on_a_tie(spark):
    q = spark.createDataFrame([(1, 5.0), (1, 0.0), (2, 1.0)], "k int, t double")
    e = spark.createDataFrame([(1, 4.0), (1, 6.0)], "k int, t double")
    assert {(r.k, r.t): r.near for r in series.nearest(q, e, "k", "t").collect()} == {(1, 5.0): 4.0, (1, 0.0): 4.0, (2, 1.0): None}


def test_overlap_clips_the_earlier(spark):
    df = spark.createDataFrame([(1, 11.0, 12.0), (1, 11.9, 12.9)], "k int, a double, b double")
    assert sorted(r.clipped for r in spans.clip_overlaps(df, "k", "a", "b", ["a"]).collect()) == [11.9, 12.9]


def test_monotone_equals_the_loop(spark):
    rng = np.random.default_rng(2)
    src = rng.normal(size=50).cumsum()
    out = series.monotone(spark.createDataFrame([(1, float(i), float(x)) for i, x in enumerate(src)], "k int, t double, s double"), "k", "t", "s").orderBy("t").toPandas().mono
    want = [src[0]]
    for x in src[1:]:
        want.append(max(x, want[-1] + 1e-4))
    assert np.allclose(out, want)


def test_gate_and_combination(spark):
    points = spark.createDataFrame([(1, 0.004, False), (2, 0.03, False), (3, 0.001, True)], "k int, lag double, railed boolean")
    coarse = spark.createDataFrame([(1, 0.2), (2, 0.0), (3, 0.0), (4, 0.2), (5, 0.01)], "k int, coarse_lag double")
    got = {r.k: r.verdict for r in quality.offset_gate(points, coarse, "k", 0.02, 0.05).collect()}
    assert got == {1: "pass", 2: "fail", 3: "fail", 4: "fail", 5: "pass"}
    df = spark.createDataFrame([("pass", "pass", "fail", 0.03, -0.04), ("pass", None, "fail", 0.03, 0.02), ("fail", "pass", "pass", 0.03, 0.02)], "a string, b string, x string, l double, m double")
    rows = df.select(quality.combined(F.col("a"), F.col("b")).alias("v"), quality.compensating(F.col("a"), F.col("b"), F.col("x"), F.col("l"), F.col("m")).alias("c")).collect()
    assert [(r.v, r.c) for r in rows] == [("pass", True), ("error", False), ("fail", False)]


def test_roles_and_tags(spark):
    df = spark.createDataFrame([("a/Song (Original Song).wav",), ("b (Karaoke Vocals).flac",), ("x vocals.mp3",), ("x vocals.txt",), (None,)], "n string")
    assert [r[0] for r in df.select(naming.role(F.col("n"))).collect()] == ["original", "instrumental", "acapella", None, None]
    assert spark.range(1).select(naming.tag_of(F.lit("a_[PASS]")), naming.without_tag(F.lit("a_[fail]"))).first()[:] == ("pass", "a")


def test_bar_marks_and_period(spark):
    df = spark.createDataFrame([(1, 0.5 * i) for i in range(18)], "k int, t double")
    assert [r.mark for r in beats.bar_marks(df, "k", "t").orderBy("mark").collect()] == [4.0, 8.0]
    assert beats.period(df, "k", "t", 0.2, 2.0).first().period == 0.5


def test_even_beats_are_one_region():
    t = np.concatenate([np.arange(20) * 0.5, 9.5 + np.arange(1, 20) * 0.4])
    found = solvers.regions(t)
    assert found[0][:2] == (0, 19) and abs(found[0][2] - 0.5) < 1e-9 and found[-1][1] == len(t) - 1


def test_empty_series(spark):
    df = spark.createDataFrame([], "k int, t double, v double, score double")
    assert robust.decompose(df, "k", "t", "v", "score", 0.02, 0.04).count() == 0
    assert series.islands(df, "k", "t", F.col("v") > 0).count() == 0
    assert solvers.limited(df.withColumnRenamed("v", "lag"), "k", 0.02).count() == 0


def test_a_bend_takes_more_markers_than_a_line(spark):
    t = np.arange(0, 30.01, 0.25)
    bent = [("bent", float(x), float(0.08 * np.sin(2 * np.pi * x / 4)), 0.9, False) for x in t]
    line = [("line", float(x), float(0.001 * x), 0.9, False) for x in t]
    one = [("one", 1.0, 0.0, 0.9, False)]
    out = series.adaptive_markers(spark.createDataFrame(bent + line + one, "k string, t double, v double, w double, jump boolean"), "k", "t", "v", "w", "jump").collect()
    marks = {k: sorted(r.mark for r in out if r.k == k) for k in ("bent", "line", "one")}
    assert len(marks["bent"]) > len(marks["line"]) == 2 and marks["one"] == [1.0]
    assert marks["bent"][0] == 0.0 and marks["bent"][-1] == 30.0


def test_gradient_equals_numpy(spark):
    rng = np.random.default_rng(3)
    t, v = np.cumsum(rng.uniform(0.1, 2, 40)), rng.normal(size=40)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "k int, t double, v double")
    assert np.allclose(series.gradient(df, "k", "t", "v", "g").orderBy("t").toPandas().g, np.gradient(v, t))


def test_segments_join_over_short_gaps(spark):
    rows = [(1, float(i), 1.0 if i in (0, 1, 2, 4, 5, 20, 21, 40) else 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, t double, v double")
    out = segments.active(df, "k", "t", "v", -6.0, 3.0, 1.0).orderBy("start").collect()
    assert [(r.start, r.stop) for r in out] == [(0.0, 5.0), (20.0, 21.0)]
    assert segments.longest_quiet(df, "k", "t", "v", 0.5).first().longest == 40.0 - 22.0  # first quiet point to the next loud one


def test_phase_goes_on_beyond_the_beats(spark):
    q = spark.createDataFrame([(1, 0.0), (1, 1.25), (1, 4.0), (2, 1.0)], "k int, t double")
    b = spark.createDataFrame([(1, 1.0), (1, 1.5), (1, 2.5), (2, 5.0)], "k int, t double")
    assert [r.phase for r in segments.phase_at(q, b, "k", "t").orderBy("k", "t").collect()] == [-2.0, 0.5, 3.5, None]


def test_repair_needs_trusted_points(spark):
    rows = [(1, 1.0, 0.01, False), (2, 1.0, 0.05, False), (2, 2.0, 0.5, True), (3, 1.0, 0.3, True)]
    out = segments.repair_verdict(spark.createDataFrame(rows, "k int, t double, lag double, r boolean"), "k", "t", "lag", "r", 0.02)
    assert {r.k: (r.status, r.n_railed) for r in out.collect()} == {1: ("ok", 0), 2: ("repair", 1), 3: ("unresolved", 1)}


def test_folders_match_by_the_only_candidate(spark):
    index = spark.createDataFrame([("a", "a_[pass]", "pass"), ("a", "a", None), ("b", "b", None), ("c", "c1", None), ("c", "c2", None)], "stem string, folder string, tag string")
    out = quality.match_folders(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "stem string"), index, "stem", "tag")
    assert {r.stem: (r.n, r.found) for r in out.collect()} == {"a": (2, "a_[pass]"), "b": (1, "b"), "c": (2, None), "d": (0, None)}
