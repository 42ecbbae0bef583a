"""Sums and quantiles that decide thresholds and texts, over rows that lie in many partitions, against SQL in one thread."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lagwright.functions import text
from lagwright.operators import series
from lagwright.plans import alignment, catalogue, registry, waveforms  # noqa: F401

from .oracle import connect, rows_of


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """38,400 events of 640 users over 39 row groups, in pairs as far above as below a mean at which something is decided."""
    rng, kinds = np.random.default_rng(11), np.array(["view", "click", "purchase", "signup", "error"])
    user, kind, up = (x.ravel() for x in np.meshgrid(np.arange(640), np.arange(5), np.arange(6), indexing="ij"))
    mean = np.choose(user % 6, [45.0, 44.0, 65.0, 40.5, 30.0 + 4 * kind, 40.0])
    off = np.round(rng.uniform(0, 29, len(user)), 2)
    d = pd.DataFrame({"user_id": np.tile(user, 2), "event_type": kinds[np.tile(kind, 2)], "value": np.round(np.concatenate([mean + off, mean - off]), 2)})
    d = d.iloc[rng.permutation(len(d))].reset_index(drop=True)
    d["event_id"] = np.arange(len(d))
    d["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(d["event_id"] * 60, "s")
    d["props"] = "{}"
    path = tmp_path_factory.mktemp("spread")
    pq.write_table(pa.Table.from_pandas(d.astype({"ts": "datetime64[us]"}), preserve_index=False), path / "events.parquet", row_group_size=1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield str(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", ["combine_verdicts", "fuse_candidates", "quality_codes", "report_cells", "report_line"])
def test_thresholds_do_not_hang_on_partitions(spark, spread, name):
    duck = connect(spread)
    duck.sql("SET threads = 1")
    assert spark.read.parquet(f"{spread}/events.parquet").rdd.getNumPartitions() > 4
    assert rows_of(registry.QUERIES[name](spark, spread).toPandas()) == rows_of(duck.sql(registry.SQL[name]).df())


@pytest.fixture(scope="module")
def with_nulls(tmp_path_factory):
    """Events of 40 users of whom one is null, one has no value at all and one no click; some kinds and values are null."""
    rng = np.random.default_rng(6)
    n = 2400
    d = pd.DataFrame({"event_id": np.arange(n), "user_id": rng.integers(0, 40, n), "event_type": rng.choice(["view", "click", "purchase", "signup", "error", None], n), "value": np.round(rng.exponential(50, n), 2)})
    d["user_id"] = d["user_id"].astype("Int64").mask(d["user_id"] == 3)
    d["value"] = d["value"].mask((rng.random(n) < 0.03) | (d["user_id"] == 7) | ((d["user_id"] == 9) & (d["event_type"] == "click")))
    d["ts"], d["props"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(d["event_id"] * 900, "s"), "{}"
    path = tmp_path_factory.mktemp("nulls")
    pq.write_table(pa.Table.from_pandas(d.astype({"ts": "datetime64[us]"}), preserve_index=False), path / "events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["combine_verdicts", "quality_codes", "failure_times", "fuse_candidates", "report_cells", "report_line"])
def test_nulls_are_a_key_and_no_value(spark, with_nulls, name):
    duck = connect(with_nulls)
    duck.sql("SET threads = 1")
    assert rows_of(registry.QUERIES[name](spark, with_nulls).toPandas()) == rows_of(duck.sql(registry.SQL[name]).df())


@pytest.mark.parametrize("name", ["failure_times", "iron_beats"])
def test_null_times_come_last(spark, with_nulls, tmp_path, name):
    d = pq.read_table(f"{with_nulls}/events.parquet").to_pandas()
    d["ts"], d["value"], d["user_id"] = d["ts"].mask(~d.duplicated("user_id")), 3 * d["value"], d["user_id"].astype("Int64")
    pq.write_table(pa.Table.from_pandas(d.astype({"ts": "datetime64[us]"}), preserve_index=False), tmp_path / "events.parquet")
    assert rows_of(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(connect(str(tmp_path)).sql(registry.SQL[name]).df())


def test_beats_on_a_threshold(spark, tmp_path):
    """Beats made by running sums of hundredths; of one user, a beat is as far off as it may be."""
    d = pd.DataFrame({"user_id": np.tile(np.arange(60), 40), "value": np.random.default_rng(1).choice([0.02, 0.04, 0.08, 0.12, 0.14], 2400)})
    d["event_id"], d["event_type"], d["props"] = np.arange(len(d)), "view", "{}"
    d["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(d["event_id"] * 60, "s")
    pq.write_table(pa.Table.from_pandas(d.astype({"ts": "datetime64[us]"}), preserve_index=False), tmp_path / "events.parquet")
    for name in ("iron_beats", "ironed_beats"):
        got = rows_of(registry.QUERIES[name](spark, str(tmp_path)).toPandas())
        assert got == rows_of(connect(str(tmp_path)).sql(registry.SQL[name]).df())


def test_weights_of_one_candidate_cancel(spark, tmp_path):
    """Heaviest clusters of one candidate whose lag lies halfway between two of six digits: any weight's last bit tells."""
    rng = np.random.default_rng(5)
    cents = rng.integers(100, 9000, (300, 16))
    cents[:, 0] += (2 - cents.sum(axis=1)) % 4
    users = np.arange(300)
    d = pd.DataFrame({"user_id": np.repeat(users, 16), "event_type": "click", "value": cents.ravel() / 100})
    d = pd.concat([d, *(pd.DataFrame({"user_id": users, "event_type": kind, "value": far}) for kind, far in (("view", 100.0), ("purchase", 110.0), ("signup", 120.0), ("error", 130.0)))], ignore_index=True)
    d["event_id"], d["props"] = np.arange(len(d)), "{}"
    d["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(d["event_id"] * 60, "s")
    pq.write_table(pa.Table.from_pandas(d.astype({"ts": "datetime64[us]"}), preserve_index=False), tmp_path / "events.parquet")
    duck = connect(str(tmp_path))
    duck.sql("SET threads = 1")
    assert rows_of(registry.QUERIES["fuse_candidates"](spark, str(tmp_path)).toPandas()) == rows_of(duck.sql(registry.SQL["fuse_candidates"]).df())


def test_summed_keeps_rows_of_one_place(spark):
    d = spark.createDataFrame([(1, 0, 0.5), (1, 0, 2.0), (1, None, 4.0)], "k int, i int, v double").repartition(3)
    assert series.summed(d, ["k"], "i", {"s": F.col("v")}, F.count("v").alias("n")).first().asDict() == {"k": 1, "s": 6.5, "n": 3}


def test_summed_adds_in_order(spark):
    rows = [(None, 0, 1e16), (None, 1, 1.0), (None, 2, -1e16), (1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.3), (2, 0, None)]
    d = spark.createDataFrame(rows[::-1], "k int, i int, v double").repartition(5)
    got = {r.k: r.s for r in series.summed(d, ["k"], "i", {"s": F.col("v")}).collect()}
    assert got == {None: 0.0, 1: 0.1 + 0.2 + 0.3, 2: None}


def test_decimals_round_as_printf(spark):
    rng = np.random.default_rng(3)
    xs = [0.0415, 0.0385, 0.5, 1.005, -1.005, 2.5, -0.0001, 0.0, 123456.0005, *(rng.integers(-9999, 9999, 300) / 2000).tolist()]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (1, 2, 3):
        got = [r.y for r in d.select(text.decimals(F.col("x"), digits, "+").alias("y")).collect()]
        assert got == [f"%+.{digits}f" % x for x in xs]


def test_quantile_equals_sql(spark):
    rng = np.random.default_rng(4)
    d = pd.DataFrame({"k": np.arange(20_000) % 300, "v": np.round(rng.exponential(50, 20_000), 2)})
    want = dict(duckdb.sql("SELECT k, quantile_cont(v, 0.95) FROM d GROUP BY k").fetchall())
    got = spark.createDataFrame(d).groupBy("k").agg(series.quantile(F.col("v"), 0.95).alias("q")).collect()
    assert {r.k: r.q for r in got} == want
