"""URL filter: a blocked Bloom filter of listed canonical URLs, and an exact hash join behind it.

A listing is a host and the start of a path. It fits a URL if the URL's host is the listed host or one of its
subdomains and the URL's path starts with the listed path. A URL's keys are the pairs (host suffix of as many labels as
some listed host has, path prefix as long as some listed path). Keys that the Bloom filter lets through meet the list in
an exact join, which drops the filter's false positives; the longest listing that fits decides. URLs without such a key
are done at once, without a shuffle.

Null and empty URLs, and URLs without ``://``, have an empty host and path and fit no listing: they are allowed.
Repeated rows are judged each for itself. An empty list allows all; of two equal listings ``block`` wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read

#: Odd multipliers of the split-block Bloom filter in the Parquet specification (fixed values).
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """``df`` with _host and _path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    bare = F.coalesce(F.regexp_extract(rest, r"^([^?#]*)", 1), F.lit(""))
    host = F.regexp_extract(bare, r"^([^/]*)", 1)
    return df.withColumn("_bare", bare).withColumn("_host", ascii_lower(host)).withColumn("_path", F.substring(F.col("_bare"), F.length("_host") + 1, F.length("_bare"))).drop("_bare")


def blocks_of(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each 64-bit hash its block, and in each of the block's eight 32-bit words one bit."""
    h = hashes.astype(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    with np.errstate(over="ignore"):
        bits = np.uint32(1) << ((low[:, None] * SALTS) >> np.uint32(27))
    return block.astype(np.int64), bits


def build_filter(listed: DataFrame, n: int, bits_per_key: int, max_bytes: int) -> np.ndarray:
    """The blocked Bloom filter of ``listed`` (column _key): partial filters on the executors, OR-ed by block.

    Its size follows ``n`` and ends at ``max_bytes``; beyond that only more keys pass it, the join stays exact.
    """
    n_blocks = max(1, min(max_bytes // 32, -(-n * bits_per_key // 256)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(*blocks_of(batch.column(0).to_numpy(), n_blocks), strict=True):
                words[int(block)] = words.get(int(block), np.zeros(8, np.uint32)) | bits
        table = np.array(list(words.values()), np.uint32).reshape(-1, 8).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), *(pa.array(table[:, i]) for i in range(8))], names=["block", *(f"w{i}" for i in range(8))])

    parts = listed.select("_key").mapInArrow(partial, "block long, " + ", ".join(f"w{i} long" for i in range(8)))
    found = parts.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))).toArrow()
    table = np.zeros((n_blocks, 8), np.uint32)
    if found.num_rows:
        table[found.column("block").to_numpy()] = np.stack([found.column(f"w{i}").to_numpy() for i in range(8)], 1).astype(np.uint32)
    return table


def filter_urls(
    df: DataFrame,
    listed: DataFrame,
    url: str = "url",
    bits_per_key: int = 16,
    max_filter_bytes: int = 64 << 20,
    max_broadcast_rows: int = 100_000,
) -> DataFrame:
    """``df`` with host, path, rule and verdict, in place of columns of these names; all others stay. listed: columns
    action (allow, block), host, path.

    The list is joined by broadcast only if it has ``max_broadcast_rows`` rows at most; else by a shuffle of the possible
    hits.
    """
    spark = df.sparkSession
    rules = listed.select(
        F.coalesce("host", F.lit("")).alias("_rule_host"), F.coalesce("path", F.lit("")).alias("_rule_path"), F.col("action").alias("_action")
    )
    rules = rules.groupBy("_rule_host", "_rule_path").agg(F.max("_action").alias("_action"))
    rules = rules.withColumn("_key", F.xxhash64("_rule_host", "_rule_path")).withColumn("_rule", F.concat("_rule_host", "_rule_path"))
    n = rules.count()
    # Distinct lengths of listed paths and label counts of listed hosts: a URL is tried at these only.
    lengths = sorted(r[0] for r in rules.select(F.length("_rule_path")).distinct().collect())
    depths = sorted(r[0] for r in rules.select(F.size(F.split("_rule_host", r"\."))).distinct().collect())
    table = spark.sparkContext.broadcast(build_filter(rules, n, bits_per_key, max_filter_bytes))

    clash = [c for c in df.columns if c in ("host", "path", "rule", "verdict")]
    rows = with_parts(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in clash)).alias("_row"), F.col(url).alias("_url")), "_url").drop("_url")
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    labels = F.length("_host") - F.length(F.replace(F.col("_host"), F.lit("."))) + 1
    kind = "array<struct<h:string,p:string,x:bigint>>"
    suffixes = [F.when(labels >= d, F.substring_index("_host", ".", -d)) for d in depths]
    prefixes = [F.when(F.length("_path") >= k, F.substring("_path", 1, k)) for k in lengths]
    pairs = [F.when(s.isNotNull() & p.isNotNull(), F.struct(s.alias("h"), p.alias("p"), F.xxhash64(s, p).alias("x"))) for s in suffixes for p in prefixes]
    keys = F.array_compact(F.array(*pairs)).cast(kind) if pairs else F.array().cast(kind)
    rows = rows.withColumn("_keys", F.when(F.col("_host") == "", F.array().cast(kind)).otherwise(keys))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_keys"))
            flat = column.flatten()
            block, bits = blocks_of(flat.field("x").to_numpy(zero_copy_only=False), len(words))
            hit = ((words[block] & bits) == bits).all(1)
            ends = np.concatenate([[0], np.cumsum(hit)])
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            offsets = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            kept = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), kept], names=batch.schema.names)

    probed = rows.mapInArrow(probe, rows.schema)
    nothing = probed.where(F.size("_keys") == 0).select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    hits = probed.where(F.size("_keys") > 0).withColumn("_k", F.explode("_keys")).drop("_keys")
    side = rules.drop("_key")
    side = F.broadcast(side) if n <= max_broadcast_rows else side
    joined = hits.join(side, (F.col("_k.h") == F.col("_rule_host")) & (F.col("_k.p") == F.col("_rule_path")), "left")
    best = F.max(F.struct(F.coalesce(F.length("_rule"), F.lit(-1)).alias("n"), F.length("_rule_host").alias("h"), F.col("_rule"), F.col("_action")))
    out = joined.groupBy("_id").agg(F.first("_row").alias("_row"), F.first("_host").alias("host"), F.first("_path").alias("path"), best.alias("_best"))
    return nothing.unionByName(out.select("_row.*", "host", "path", F.col("_best._rule").alias("rule"), F.coalesce("_best._action", F.lit("allow")).alias("verdict")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "action string, host string, path string")
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), bare AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^([^?#]*)', 1) AS b FROM cut
), parts AS (
  SELECT page_id,
    translate(regexp_extract(b, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(b, length(regexp_extract(b, '^([^/]*)', 1)) + 1) AS path
  FROM bare
), rules(action, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), judged AS (
  SELECT page_id, host, path,
    (SELECT max_by({'rule': h || p, 'action': action}, length(h || p)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r
  FROM parts
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.action, 'allow') AS verdict FROM judged
"""
