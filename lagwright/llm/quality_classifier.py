"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Each class's labelled texts train a dictionary. A text is cut into blocks, each block is compressed with either
dictionary, and the difference of the compressed sizes per byte tells which class it is more like; a logistic curve,
fitted on labelled rows that trained no dictionary, makes a probability of it.

Null and empty texts have difference 0 and the probability that the curve has there. Where labels of a document
contradict each other, none is used. Without labels all score 0.5, with labels of one class that class's number.
Repeated rows are scored each for itself; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_chunks, pieces, read, text_buffer

BLOCK, DICTIONARY, LEVEL = 2048, 112_640, 3

#: Differences beyond this many compressed bytes a byte count by their logarithm: repetitive text compresses to little
#: with either dictionary, so that small differences tell as well.
NEAR = 0.005


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@dataclass
class Model:
    """dictionaries: bad, good; slope and shift of the logistic curve. Without dictionaries, constant is the score."""

    dictionaries: tuple[bytes, bytes] | None = None
    slope: float = 0.0
    shift: float = 0.0
    constant: float = 0.5

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for raw in self.dictionaries:
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def differences(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        bad, good = self.compressors()
        out = np.zeros(len(offsets) - 1)
        for i in range(len(out)):
            if text := data[offsets[i] : offsets[i + 1]]:
                out[i] = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks(text)) / len(text)
        return np.arcsinh(out / NEAR)

    def scores(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        if self.dictionaries is None:
            return np.full(len(offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(data, offsets) + self.shift, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 1e-5, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method, on x scaled to unit deviation."""
    scale = x.std() or 1.0
    design, beta = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    weights = weights / weights.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weights * (y - p)) - penalty * len(x) * beta * [1, 0]
        hessian = (design.T * (weights * p * (1 - p))) @ design + np.diag([penalty * len(x), 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows_per_class: int = 2000) -> Model:
    """Fits on about ``rows_per_class`` labelled rows of each class (the documented bound), chosen by a hash of the id:
    three quarters for the dictionaries, the rest for the curve, weighted as often as the class is labelled."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select(key, "_y")
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if set(totals) != {0, 1}:
        return Model(constant=float(next(iter(totals))) if totals else 0.5)
    # At most a few thousand rows, by the bound above.
    picked = F.broadcast(bounded_sample(known, F.col(key), rows_per_class, F.col("_y")))
    found = docs.select(key, F.col(text).alias("_t")).where("_t is not null").join(picked, key).select("_t", "_y", F.xxhash64(key).alias("_k")).toPandas().sort_values(["_k", "_t"])
    texts, y = [t.encode() for t in found["_t"]], found["_y"].to_numpy()
    first = np.arange(len(y)) % 4 != 0
    made = []
    for c in (0, 1):
        samples = [b for t, own in zip(texts, first & (y == c), strict=True) if own for b in blocks(t) if len(b) > 8]
        try:
            made.append(zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text for the trainer: its raw end is a dictionary too
            made.append(b"\n".join(samples)[-DICTIONARY:].rjust(8))
    model = Model((made[0], made[1]))
    data, offsets = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    x, rest = model.differences(data, offsets), ~first
    if len(set(y[rest])) < 2:
        rest = np.ones(len(y), bool)
    share = {c: totals[c] / max(1, (y[rest] == c).sum()) for c in (0, 1)}
    model.slope, model.shift = logistic(x[rest], y[rest], np.where(y[rest] == 1, share[1], share[0]))
    return model


def classify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of each row's whole text. Narrow: no shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(data.tobytes(), offsets))], names=["id", "score"])

    return map_chunks(rows, work, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array(held.value.scores(data.tobytes(), offsets) >= least))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold("doc_id", 3) != 1), read(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    held_out, predicted = fold("doc_id", 3) == 1, (F.col("score") >= 0.5).cast("int")
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))
