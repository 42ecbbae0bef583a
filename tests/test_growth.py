"""Steps that grow no faster than their input, against brute force and by the rows that they shuffle."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwright.operators import correlate, placement, timemap


def shuffled_rows(spark, df) -> int:
    """Runs df; the rows that its stages wrote for shuffles."""
    tracker, name = spark.sparkContext.statusTracker(), f"rows-{os.urandom(4).hex()}"
    spark.sparkContext.setJobGroup(name, name)
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("", "")
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s))


def test_local_period_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    beats = {1: np.round(rng.uniform(0, 60, 80), 1), 2: np.round(rng.uniform(0, 60, 12), 1), 3: np.array([5.0, 6.0])}
    queries = {k: np.unique(np.round(rng.uniform(-15, 75, 60), 1)) for k in (1, 2, 3, 4)}

    def period(k, q):
        good = lambda b: [x for x in np.diff(np.sort(b)) if 0.2 < x < 4]
        b = beats.get(k, np.array([]))
        near = b[np.abs(b - q) <= 5]
        own = good(near) if len(near) >= 3 else []
        return float(np.median(own or good(b) or [0.0]))

    frame = lambda x: spark.createDataFrame([(k, float(t)) for k, ts in x.items() for t in ts], "k int, t double")
    got = {(r.k, r.t): r.period for r in timemap.local_period(frame(queries), frame(beats), "k", "t", 5.0, 0.2, 4.0).collect()}
    assert got == pytest.approx({(k, float(q)): period(k, q) for k, qs in queries.items() for q in qs}, abs=1e-12)


def test_local_period_makes_no_pairs_of_dense_beats(spark):
    beats = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") / 400).alias("t"))
    queries = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") / 10 + 0.01).alias("t"))
    assert shuffled_rows(spark, timemap.local_period(queries, beats, "k", "t", 10.0, 0.2, 10.0)) < 100_000


def test_envelope_moves_deals_knots_of_one_key_and_file(spark):
    knots = spark.range(400).coalesce(1).select(F.lit(1).alias("k"), (F.col("id") / 10).alias("t"), F.lit(0.5).alias("lag"))
    signal = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("b"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.sin(F.col("id") * 32 + i)).alias("y"))
    moves = timemap.envelope_moves(knots, signal, signal, "k", "t", "lag", 10.0, 32, 30, 8, 2)
    parts = moves.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 200


def test_mapped_phrases_deals_units_and_markers_once(spark):
    units = spark.range(2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("n"), *(F.lit(x).alias(c) for c, x in zip(placement.SPAN, (10.0, 14.0, 20.0, 24.0), strict=True)), F.lit(0.9).alias("confidence"))
    maps = units.select("k", "n", F.explode(F.array(*(F.lit(x) for x in (0.0, 2.0, 3.0, 4.0)))).alias("dst")).select("*", F.col("dst").alias("src"), F.lit(20.0).alias("origin"), F.lit(0.0).alias("pad"), F.lit(0.9).alias("sure"))
    mapped = placement.mapped_phrases(units, maps, "k", "n", 100.0)
    assert mapped.where("how = 'mapped'").count() == 6000
    assert shuffled_rows(spark, mapped) <= 10_000
