"""Results written as CSV and JSON and read back."""

import math

from pyspark.sql import functions as F

from lagwright.sources import files

SCHEMA = "k long, name string, v double, list array<long>, one struct<a: double, b: string>"
ROWS = [(1, 'a "quoted", name', 1.5, [1, 2], (0.5, "x")), (None, "", math.inf, [], None), (3, None, math.nan, None, (None, "é\n2")), (3, "b", None, [7], (1.0, None))]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    files.write_csv(df, str(tmp_path / "csv"))
    got = sorted(files.read_csv(spark, str(tmp_path / "csv"), "k long, name string, v double, list string, one string").collect(), key=repr)
    assert len(got) == 4
    by = {r.v: r for r in got if r.v is not None}
    assert by[1.5].k == 1 and by[1.5].name == 'a "quoted", name' and by[1.5].list == "[1,2]" and by[1.5].one == '{"a":0.5,"b":"x"}'
    assert sum(r.v is None for r in got) == 3  # what is not finite is null
    files.write_csv(df.limit(1), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), "k long, name string, v double, list string, one string").count() == 1


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    files.write_json(df, str(tmp_path / "json"))
    got = files.read_json(spark, str(tmp_path / "json"), "k long, name string, v double, list string, one string")
    back = got.select("k", "name", "v", F.from_json("list", "array<long>").alias("list"), F.from_json("one", "a double, b string").alias("one"))
    want = [(k, n, v if v is not None and math.isfinite(v) else None, x, one) for k, n, v, x, one in ROWS]
    assert sorted((tuple(r[:4]) + (tuple(r.one) if r.one else None,) for r in back.collect()), key=repr) == sorted(want, key=repr)
    files.write_json(df.limit(0), str(tmp_path / "none"))
    assert files.read_json(spark, str(tmp_path / "none"), "k long").count() == 0
