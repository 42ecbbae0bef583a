"""A hashed maximum-entropy language model with class-factored softmax, beside a smoothed unigram base.

p(word | history) = p(class | history) * p(word | class). A word's class follows from its last two bytes and its length;
the end of a text is a class of its own. p(class | history) is a softmax over the classes of the summed weights of a
bias, a bigram feature (the last word, hashed), a skip feature (the class of the word before it) and a hashed trigram
feature (both). p(word | class) is the word's smoothed relative frequency among its class, with room for one unknown.
So the probabilities of all known words and one unknown of each class add up to 1.

All training tokens count. One pass over the texts writes them in blocks of bounded size, with each block's distinct
words and their counts, and counts how often each class follows each of a fixed number of histories. Word counts are
summed by a shuffle on the word, and come back to each block by a join on the word, once for each block and distinct
word, so that no task and no broadcast holds the vocabulary. The classes' counts are the sufficient statistics of the
softmax: each round of training is a Spark job in which tasks add up the gradient over their histories.

Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end. Null and empty texts have the end alone. With
no training row, counts and train_tokens are 0 and the base gives log10(1) for each token. Repeated rows count as often
as they occur; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, cut_lineage, fold, pieces, read, split_words, text_buffer, written

CLASSES, BUCKETS, TRIGRAMS = 32, 512, 4096
HISTORIES = BUCKETS * CLASSES
FEATURES = 1 + BUCKETS + CLASSES + TRIGRAMS
#: The end of a text, in the table of words; no word has white space.
END = "\n"
BLOCK_BYTES = 32 << 20


def word_codes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The class (1 to CLASSES - 1) and the bucket (1 to BUCKETS - 1) of each word."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    size = np.diff(ends)
    back = lambda k: np.where(size >= k, data[np.maximum(ends[1:] - k, 0)], 0)
    front = lambda k: np.where(size > k, data[np.minimum(ends[:-1] + k, max(0, len(data) - 1))], 0)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mix = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
    with np.errstate(over="ignore"):
        tail = back(1) | back(2) << np.uint64(8) | (np.minimum(size, 8) // 3).astype(np.uint64) << np.uint64(16)
        whole = tail | front(0) << np.uint64(24) | front(1) << np.uint64(32) | front(2) << np.uint64(40) | back(3) << np.uint64(48) | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        return 1 + mix(tail) % (CLASSES - 1), 1 + mix(whole ^ whole >> np.uint64(29)) % (BUCKETS - 1)


@dataclass
class Tokens:
    """The tokens of a batch, an end after each row's words: codes into words (the last is the end), and rows' bounds."""

    words: pa.StringArray
    codes: np.ndarray
    bounds: np.ndarray
    classes: np.ndarray  # of words
    histories: np.ndarray  # of tokens

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        data, offsets = text_buffer(texts)
        flat, bounds = split_words(LOWER[data], offsets)
        coded = flat.dictionary_encode()
        words = pa.concat_arrays([coded.dictionary, pa.array([END])])
        classes, buckets = word_codes(coded.dictionary)
        classes, buckets = np.append(classes, 0), np.append(buckets, 0)
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), bounds[1:], len(words) - 1)
        # Before a row's first word stands the end of the row before it: bucket and class 0.
        last = np.concatenate([[0], buckets[codes[:-1]]]) if len(codes) else codes
        before = np.concatenate([[0, 0], classes[codes[:-2]]])[: len(codes)]
        bounds = bounds + np.arange(len(bounds))
        before[bounds[:-1]] = 0
        return cls(words, codes, bounds, classes, last * CLASSES + before)


def features_of(histories: np.ndarray) -> np.ndarray:
    """(n, 4) feature numbers: bias, bigram, skip, trigram."""
    bucket, before = histories // CLASSES, histories % CLASSES
    return np.stack([np.zeros_like(histories), 1 + bucket, 1 + BUCKETS + before, 1 + BUCKETS + CLASSES + (histories * 40503 >> 2) % TRIGRAMS], 1)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def in_blocks(docs: DataFrame, key: str, text: str, train: str) -> DataFrame:
    """Rows of three kinds. doc: block, id, text, held. word: block, word, class, n (in training rows). class: class, history, n."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.expr(train).alias("train"))
    kind = dict(rows.dtypes)["id"]
    columns = f"kind string, block long, id {kind}, text string, train boolean, word string, class int, history int, n long"
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 24, 0
        words: list[pa.Table] = []
        following = np.zeros(HISTORIES * CLASSES, np.int64)
        types: dict[str, pa.DataType] = {}

        def made(size: int, /, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, types[c])) for c in names], names=names)

        def constant(value: object, n: int, type_: pa.DataType) -> pa.Array:
            return pa.repeat(pa.scalar(value, type_), n)

        def word_rows() -> pa.RecordBatch:
            total = pa.concat_tables(words).group_by(["word", "class"]).aggregate([("n", "sum")]).combine_chunks()
            n = total.num_rows
            one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0)
            return made(n, kind=constant("word", n, pa.string()), block=constant(block, n, pa.int64()), word=one(total["word"]), n=one(total["n_sum"]), **{"class": one(total["class"])})

        for piece in pieces(batches):
            types = types or {"kind": pa.string(), "block": pa.int64(), "id": piece.column(0).type, "text": pa.string(), "train": pa.bool_(), "word": pa.string(), "class": pa.int32(), "history": pa.int32(), "n": pa.int64()}
            n = piece.num_rows
            tokens = Tokens.of(piece.column(1))
            learned = np.repeat(pc.fill_null(piece.column(2), False).to_numpy(zero_copy_only=False), np.diff(tokens.bounds))
            counts = np.bincount(tokens.codes[learned], minlength=len(tokens.words))
            words.append(pa.table({"word": tokens.words, "class": pa.array(tokens.classes, pa.int32()), "n": pa.array(counts)}))
            following += np.bincount((tokens.histories * CLASSES + tokens.classes[tokens.codes])[learned], minlength=len(following))
            yield made(n, kind=constant("doc", n, pa.string()), block=constant(block, n, pa.int64()), id=piece.column(0), text=piece.column(1), train=piece.column(2))
            filled += piece.nbytes
            if filled > BLOCK_BYTES:
                yield word_rows()
                block, filled, words = block + 1, 0, []
        if words:
            yield word_rows()
        if len(seen := np.flatnonzero(following)):
            n = len(seen)
            yield made(n, kind=constant("class", n, pa.string()), history=pa.array(seen // CLASSES, pa.int32()), n=pa.array(following[seen]), **{"class": pa.array(seen % CLASSES, pa.int32())})

    return rows.mapInArrow(run, columns)


#: Four features share each history's error, so that each mends less than half of it.
RATE = 0.45


def fit(following: DataFrame, class_counts: np.ndarray, rounds: int = 8, partitions: int = 2, penalty: float = 4.0) -> np.ndarray:
    """Weights (FEATURES, CLASSES) from rows (history, class, n), at most HISTORIES * CLASSES of them.

    Each round is one job: tasks compute, for their histories, what the softmax expects of each feature and class. The
    gradient is what was observed less that; a step follows it on the scale of logarithms, less where both are small.
    """
    spark = following.sparkSession
    total = following.groupBy("history", "class").agg(F.sum("n").alias("n"))
    rows = cut_lineage(total.groupBy("history").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("m")).select("history", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0)).cast("float")).alias("n")).coalesce(partitions))
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    weights[0] = np.log(class_counts + 0.5)

    def gradient(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            observed, expected = np.zeros((2, FEATURES, CLASSES), np.float32)
            for batch in batches:
                counts = batch.column(1).flatten().to_numpy().reshape(-1, CLASSES)
                features = features_of(batch.column(0).to_numpy().astype(np.int64))
                p = softmax(held.value[features].sum(1)) * counts.sum(1, keepdims=True)
                for k in range(features.shape[1]):
                    np.add.at(observed, features[:, k], counts)
                    np.add.at(expected, features[:, k], p)
            yield pa.RecordBatch.from_arrays([pa.array([observed.tobytes()]), pa.array([expected.tobytes()])], names=["o", "e"])

        sums = np.zeros((2, FEATURES, CLASSES))
        for o, e in rows.mapInArrow(run, "o binary, e binary").collect():  # one row from each of ``partitions`` tasks
            sums += [np.frombuffer(x, np.float32).reshape(FEATURES, CLASSES) for x in (o, e)]
        held.unpersist()
        return sums[0], sums[1]

    for _ in range(rounds):
        observed, expected = gradient(weights)
        size = observed + expected
        weights = (weights + RATE * np.log((observed + 1) / (expected + 1)) * size / (size + penalty)).astype(np.float32)
    return weights


def score(docs: DataFrame, train: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score of each row. train: SQL that marks training rows."""
    kind = dict(docs.dtypes)[key]
    table = written(in_blocks(docs, key, text, train))
    words = table.where("kind = 'word'").select("block", "word", "class", "n")
    counts = written(words.groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("c")).where("c > 0"))
    by_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas().set_index("class")  # CLASSES rows at most
    n_class, v_class = (np.array([int(by_class[c].get(k, 0)) for k in range(CLASSES)]) for c in ("n", "v"))
    n_all, v_all = int(n_class.sum()), int(v_class.sum())
    weights = fit(table.where("kind = 'class'").select("history", "class", "n"), n_class)
    model = docs.sparkSession.sparkContext.broadcast(np.log10(softmax(weights[features_of(np.arange(HISTORIES))].sum(1).astype(np.float64))))

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        place = pa.concat_arrays(known["word"].chunks) if known.num_rows else pa.array([], pa.string())
        count = known["c"].to_numpy() if known.num_rows else np.zeros(0, np.int64)
        out = []
        for piece in pieces(iter(texts.combine_chunks().to_batches())):
            tokens = Tokens.of(piece.column(2))
            at = pc.fill_null(pc.index_in(tokens.words, place), -1).to_numpy()
            c = np.where(at >= 0, count[at], 0) if len(count) else np.zeros(len(at), np.int64)
            own = tokens.classes
            base = np.log10((c + 1) / (n_all + v_all + 1))
            inside = np.log10((c + 1) / (n_class[own] + v_class[own] + 1))
            total = inside[tokens.codes] + model.value[tokens.histories, own[tokens.codes]]
            starts = tokens.bounds[:-1]
            out.append(
                pa.record_batch(
                    {
                        "id": piece.column(1),
                        "train": piece.column(3),
                        "n_tokens": pa.array(np.diff(tokens.bounds)),
                        "n_known": pa.array(np.add.reduceat((c > 0)[tokens.codes].astype(np.int64), starts)),
                        "train_tokens": pa.array(np.full(piece.num_rows, n_all)),
                        "base_score": pa.array(np.add.reduceat(base[tokens.codes], starts)),
                        "score": pa.array(np.add.reduceat(total, starts)),
                    }
                )
            )
        return pa.Table.from_batches(out, schema)

    schema = pa.schema([("id", to_arrow_type(table.schema["id"].dataType)), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    texts = table.where("kind = 'doc'").select("block", "id", "text", "train")
    known = words.select(F.col("block").alias("of_block"), "word").join(counts.select("word", "c"), "word").select("of_block", "word", "c")
    result = texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(run, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return result.withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_train", fold("doc_id", 7) != 2)
    found = score(docs, "_train")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
