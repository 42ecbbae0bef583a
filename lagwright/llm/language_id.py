"""Language identification: a convolutional network over bytes.

Filters of several widths slide over windows of ``WINDOW`` bytes, each filter's largest response in a window goes through
a rectifier into a softmax over the languages, and a text's probabilities are the means over its windows, weighted by
their bytes. The network is trained in numpy on a bounded sample of labelled rows and applied to whole texts: for that,
each filter becomes tables of the responses to byte pairs, so that a width of four takes two look-ups.

A text that is null or has no letter gets ``und`` and score 0, as every text does if no row has a label. Ties between
languages go to the first in code-point order. Repeated rows and ids are separate rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bounded_sample, fold, map_chunks, pieces, read, text_buffer

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Upper and lower case look alike, and so do all digits.
CANON = LOWER.copy()
CANON[48:58] = 48
PAD = max(WIDTHS) - 1


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows as one byte array with PAD zeros after it, each window's row, and its bytes of text.

    A text begins after PAD zeros in its first window and ends PAD zeros before its last window's end, so that no filter
    sees bytes of two texts.
    """
    sizes = np.diff(offsets)
    n = -(-(sizes + 2 * PAD) // WINDOW)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(first[-1] * WINDOW + PAD, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW + PAD - offsets[:-1], sizes)] = CANON[data]
    rows = np.repeat(np.arange(len(sizes)), n)
    place = (np.arange(first[-1]) - first[rows]) * WINDOW - PAD
    return out, rows, (np.clip(place + WINDOW, 0, sizes[rows]) - np.clip(place, 0, sizes[rows])).astype(np.float32)


class Network:
    """tables[w]: (w, 256, FILTERS), the response of each filter to each byte at each place."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
        """windows: (n, WINDOW) bytes. Adam on the mean cross-entropy; only a filter's largest response carries gradient."""
        rng = np.random.default_rng(seed)
        values = [*self.tables.values(), self.out, self.bias]
        means, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                x, y = windows[order[at : at + batch]], labels[order[at : at + batch]]
                pooled, where = [], []
                for w, table in self.tables.items():
                    length = WINDOW - w + 1
                    response = sum(table[j][x[:, j : j + length]] for j in range(w))
                    best = response.argmax(1)
                    pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0])
                    where.append(best)
                hidden = np.concatenate(pooled, 1)
                active = np.maximum(hidden, 0)
                p = softmax(active @ self.out + self.bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for k, (w, best) in enumerate(zip(self.tables, where, strict=True)):
                    g = np.zeros_like(self.tables[w])
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(x, best + j, 1), np.arange(FILTERS)[None]), back[:, k * FILTERS : (k + 1) * FILTERS])
                    grads.append(g)
                grads += [active.T @ p, p.sum(0)]
                step += 1
                for v, g, m, s in zip(values, grads, means, squares, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def compiled(self) -> Scorer:
        pairs = [(self.tables[2][0][:, None] + self.tables[2][1][None]).reshape(65536, FILTERS)]
        pairs += [(self.tables[4][a][:, None] + self.tables[4][a + 1][None]).reshape(65536, FILTERS) for a in (0, 2)]
        pairs.append((self.tables[3][0][:, None] + self.tables[3][1][None]).reshape(65536, FILTERS))
        return Scorer(self.languages, pairs, self.tables[3][2], self.out, self.bias)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Scorer:
    def __init__(self, languages, pairs, third, out, bias):
        self.languages, self.pairs, self.third, self.out, self.bias = languages, pairs, third, out, bias

    def windows(self, flat: np.ndarray, at_once: int = 256) -> np.ndarray:
        """Probabilities of each window; few windows at once, so that responses stay in cache."""
        n = (len(flat) - PAD) // WINDOW
        result = np.empty((n, len(self.languages)), np.float32)
        two, four_a, four_b, three = self.pairs
        for a in range(0, n, at_once):
            b = min(n, a + at_once)
            x = flat[a * WINDOW : b * WINDOW + PAD].astype(np.int64)
            pair = (x[:-1] << 8) | x[1:]
            m = (b - a) * WINDOW
            shape = (b - a, WINDOW, FILTERS)
            head = pair[:m]
            pooled = [two[head].reshape(shape).max(1)]
            response = three[head]
            response += self.third[x[2 : m + 2]]
            pooled.append(response.reshape(shape).max(1))
            response = four_a[head]
            response += four_b[pair[2 : m + 2]]
            pooled.append(response.reshape(shape).max(1))
            result[a:b] = softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.bias)
        return result

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, rows, size = windows_of(data, offsets)
        size = np.maximum(size, 1e-3)
        mean = np.zeros((len(offsets) - 1, len(self.languages)))
        np.add.at(mean, rows, self.windows(flat) * size[:, None])
        mean /= mean.sum(1, keepdims=True)
        return mean.argmax(1), mean.max(1)


def sampled_windows(texts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` windows of each text, spread over the whole of it, and each one's row."""
    data, offsets = text_buffer(texts)
    flat, rows, size = windows_of(data, offsets)
    cut = flat[: len(size) * WINDOW].reshape(-1, WINDOW)
    # The last window of a text counts if it holds enough of it.
    full = np.flatnonzero(size >= np.minimum(32, np.diff(offsets))[rows])
    bounds = np.searchsorted(rows[full], np.arange(len(texts) + 1))
    picked = [full[a + np.unique(np.linspace(0, b - a - 1, most).astype(int))] for a, b in zip(bounds, bounds[1:]) if b > a]
    picked = np.concatenate(picked) if picked else np.zeros(0, np.int64)
    return cut[picked], rows[picked]


def train(labelled: DataFrame, text: str, lang: str, key: str, rows_per_language: int = 400, windows_per_row: int = 6, most_rows: int = 80_000) -> Scorer | None:
    """Fits on about ``rows_per_language`` texts of each language (the documented bound; less where there are so many
    languages that it would be over ``most_rows`` in all, ten at least), chosen by a hash of the id, and on
    ``windows_per_row`` windows of each. Only these windows come to the driver. None without a labelled row."""
    n = labelled.agg(F.count_distinct(lang)).first()[0]
    if not n:
        return None
    sample = bounded_sample(labelled, F.col(key), max(10, min(rows_per_language, most_rows // n)), F.col(lang))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            windows, rows = sampled_windows(batch.column(0), windows_per_row)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in windows], pa.binary()), batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows))], names=["w", "l", "k"])

    found = sample.select(F.col(text).alias("text"), F.col(lang).alias("l"), F.xxhash64(key).alias("k")).mapInArrow(cut, "w binary, l string, k long").toPandas().sort_values(["k", "w"])
    if found.empty:
        return None
    languages, labels = np.unique(found["l"].to_numpy(str), return_inverse=True)
    windows = np.frombuffer(b"".join(found["w"]), np.uint8).reshape(-1, WINDOW)
    return Network([str(x) for x in languages]).fit(windows, labels).compiled()


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(df: DataFrame, model: Scorer | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of each row's whole text. Narrow: no shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), has_letter(F.col(text)).alias("known"))
    if model is None:
        return rows.select(F.col("id").alias(key), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = held.value
        best, score = model.rows(*text_buffer(batch.column(1)))
        known = batch.column(2).to_numpy(zero_copy_only=False)
        names = np.array(model.languages, object)[best]
        names[~known] = "und"
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], names=["id", "lang_pred", "score"])

    kind = dict(rows.dtypes)["id"]
    return map_chunks(rows, work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where(fold("doc_id", 5) != 0).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    found = identify(docs, train(learned, "text", "lang", "doc_id"))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
