"""Quality rules: base rules, and an isolation forest on the rules' statistics.

Each text gives a few counts. Random splits of a bounded sample of their ratios make trees; rows that few splits set
apart are anomalous. The threshold comes from all labelled rows: as low as it may be while the share of good rows that
it rejects stays within ``false_rejections``; a row's labels that contradict each other are not used.

Null and empty texts have no words and fail the base rules. Without labels the threshold is the given quantile of all
rows' scores. Repeated rows are judged each for itself; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, cut_lineage, give_back, map_chunks, pieces, read, row_sums, split_words, text_buffer

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
SYMBOL, UPPER, MARK = (np.zeros(256, bool) for _ in range(3))
SYMBOL[list(b"#*$%&|<>")] = True
UPPER[65:91] = True
MARK[list(b".,;:!?")] = True

TREES, SAMPLE, BINS = 100, 256, 4096


def repeated_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row the words that lie in a 3-word window found twice or more in the row. codes: equal for equal words."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    marked = np.zeros(len(codes), bool)
    at = np.flatnonzero(rows[2:] == rows[:-2]) if len(codes) > 2 else np.zeros(0, np.int64)
    if len(at):
        n = int(codes.max()) + 1
        pair = pd.factorize(codes[at].astype(np.int64) * n + codes[at + 1])[0].astype(np.int64)
        triple = pd.factorize(pair * n + codes[at + 2])[0].astype(np.int64)
        window = pd.factorize(triple * len(bounds) + rows[at])[0]
        again = at[np.bincount(window)[window] > 1]
        for k in range(3):
            marked[again + k] = True
    return row_sums(marked.astype(np.int64), bounds)


def repeated_lines(texts: list[str | None]) -> np.ndarray:
    """For each row the lines with a word that equal an earlier one."""
    out = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        out[i] = len(lines) - len(set(lines))
    return out


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = text_buffer(texts)
    words, bounds = split_words(data, offsets)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    points = (data & 0xC0) != 0x80
    white = (data == 32) | ((data >= 9) & (data <= 13))
    over_bytes = lambda mask: row_sums(mask.astype(np.int64), offsets)
    return {
        "n_words": np.diff(bounds),
        "word_chars": over_bytes(points & ~white),
        "n_symbols": over_bytes(SYMBOL[data]),
        "n_dup_lines": repeated_lines(texts.to_pylist()),
        "n_repeat_words": repeated_words(codes, bounds),
        "n_upper": over_bytes(UPPER[data]),
        "n_marks": over_bytes(MARK[data]),
    }


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and COUNTS of each row's whole text. Narrow: no shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = counts_of(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["id", *COUNTS])

    return map_chunks(rows, work, f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", key)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(counts: np.ndarray) -> np.ndarray:
    """(n, 6) ratios of (n, COUNTS), on a log scale: word length, symbols, capitals, marks, repeated lines and words."""
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    ratios = [chars / words, c["n_symbols"] / words, c["n_upper"] / chars, c["n_marks"] / words, c["n_dup_lines"] / words, c["n_repeat_words"] / words]
    return np.log1p(20 * np.stack(ratios, 1))


@dataclass
class Forest:
    """Trees as arrays: feature (-1: a leaf), cut, left child (right is the next), path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    usual: float

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        size = min(sample, len(x))
        deepest = max(1, int(np.ceil(np.log2(max(size, 2)))) + 2)
        nodes = 1 << (deepest + 1)
        feature = np.full((trees, nodes), -1)
        cut, left, length = np.zeros((trees, nodes)), np.zeros((trees, nodes), int), np.zeros((trees, nodes))
        for t in range(trees):
            stack, used = [(0, rng.choice(len(x), size, replace=False), 0)], 1
            while stack:
                node, rows, depth = stack.pop()
                low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
                splits = np.flatnonzero(high > low)
                if depth == deepest or len(rows) < 2 or not len(splits):
                    length[t, node] = depth + usual_length(len(rows))
                    continue
                f = rng.choice(splits)
                c = rng.uniform(low[f], high[f])
                feature[t, node], cut[t, node], left[t, node] = f, c, used
                stack += [(used, rows[x[rows, f] <= c], depth + 1), (used + 1, rows[x[rows, f] > c], depth + 1)]
                used += 2
        return cls(feature, cut, left, length, usual_length(size))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / usual length): near 1 for anomalous rows."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, left, length in zip(self.feature, self.cut, self.left, self.length, strict=True):
            node = np.zeros(len(x), int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, left[node] + (x[every, np.maximum(f, 0)] > cut[node]), node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual, 1e-9))


def usual_length(n: int) -> float:
    """Mean path length of unsuccessful searches in a binary tree of n keys."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def with_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(features(np.stack([c.to_numpy() for c in columns], 1))))

    return stats.withColumn("anomaly", score(*COUNTS))


def calibrated(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 4096, other_share: float = 0.02, false_rejections: float = 0.005) -> tuple[DataFrame, Forest, float]:
    """statistics() of all rows with anomaly, held in the checkpoint folder, the forest and the threshold.

    The forest is fitted on about ``sample_rows`` rows (the documented bound) labelled good and ``other_share`` of that
    labelled bad, so that anomalies are in its trees and rare there; where no row is labelled good, on a sample of all
    rows. The threshold comes from a histogram over all rows labelled good that pass the base rules.
    """
    stats = cut_lineage(statistics(docs, key, text))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(key).agg(F.min("quality").alias("_y"), F.max("quality").alias("_z")).where("_y = _z").select(key, "_y")
    labelled = stats.where(~base_failed()).join(known, key)
    fitted = bounded_sample(labelled.where("_y = 1"), F.col(key), sample_rows).select(*COUNTS).toPandas()
    others = bounded_sample(labelled.where("_y = 0"), F.col(key), max(1, int(other_share * sample_rows))).select(*COUNTS, F.xxhash64(key).alias("_h")).toPandas()
    others = others.sort_values(["_h", *COUNTS])[COUNTS].head(max(1, int(other_share * len(fitted))))  # by hash, so at random
    fitted = pd.concat([fitted, others]) if len(fitted) else fitted
    if fitted.empty:
        fitted = bounded_sample(stats, F.col(key), sample_rows).select(*COUNTS).toPandas()
    if fitted.empty:
        fitted = pd.DataFrame(np.ones((1, len(COUNTS))), columns=COUNTS)
    forest = Forest.fit(features(fitted.sort_values(COUNTS).to_numpy()))
    found = with_scores(stats, forest)

    def histogram(rows: DataFrame) -> np.ndarray:
        bins = rows.groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")).count()
        out = np.zeros(BINS)
        for r in bins.collect():
            out[r["bin"]] = r["count"]
        return out

    good = histogram(with_scores(labelled.where("_y = 1"), forest))
    counted = good if good.sum() else histogram(found)
    beyond = np.cumsum(counted[::-1])[::-1]  # rows at or above each bin
    allowed = false_rejections * counted.sum()
    threshold = float(np.argmax(np.append(beyond, 0) <= allowed)) / BINS
    return found, forest, threshold


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, COUNTS, anomaly, base_failed, kept."""
    found, _, threshold = calibrated(docs, labels, key, text)
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def keep_regular(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that judge() keeps; texts are read again rather than shuffled."""
    _, forest, threshold = calibrated(docs.select(key, text), labels, key, text)
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            counts = counts_of(batch.column(batch.schema.get_field_index(text)))
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            anomaly = held.value.scores(features(np.stack([counts[c] for c in COUNTS], 1)))
            yield batch.filter(pa.array(~failed & (anomaly < threshold)))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
