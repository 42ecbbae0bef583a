"""Harmonic packing of token sequences into training sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces of capacity / k tokens, and each of its bins takes
exactly k of them. With a capacity that is a power of two and k = 1, 2, 4, ..., a document is cut into pieces of those
lengths, the largest first (its length in binary), so that full bins have no padding at all. Each worker fills bins of
its own partition, without a shuffle; what its open bins hold at the end goes, largest pieces first, into as few
sequences as its total has binary digits, each a power of two long, which need no padding either.

A sequence_id is the partition's number in the high bits and a count in the low ones: the same on each retry, as a
partition's rows are. Null and empty texts are the end id alone, one piece of one token. Repeated rows are packed as
often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, give_back, pieces, ragged, read, split_words, text_buffer

CAPACITY = 4096

#: 1: ASCII letter, 2: digit, 3: other printable ASCII without the apostrophe, 0: the rest. Unlike kinds 1 to 3, and two
#: digits, never share a token.
KIND = np.zeros(256, np.uint8)
KIND[33:127], KIND[39] = 3, 0
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts by way of their distinct words.

    The tokenizer lower-cases, drops white space and parts letters, digits and signs before any merge, so a text's ids
    are the ids of such parts, end to end. Each part is encoded by the library once and then kept, up to ``most``.
    Where ``<|`` occurs, which begins a special token, only white space parts words.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.ones(1 << 16, np.int64)
        self.n_ids = 1

    def learn(self, words: list[str]) -> None:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        lists = [x.ids for x in found]
        n = len(self.place)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.ones_like(self.starts)])
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.starts[n + 1 : n + 1 + len(words)] = self.n_ids + np.cumsum(sizes)
        self.n_ids += len(flat)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def rows(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids with ``end`` after each row, and the rows' offsets in them."""
        data, offsets = text_buffer(texts)
        cuts = None
        if not ((data[:-1] == ord("<")) & (data[1:] == ord("|"))).any():
            data = LOWER[data]
            kind = KIND[data]
            cuts = np.zeros(len(data), bool)
            cuts[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        words, bounds = split_words(data, offsets, cuts)
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        if len(self.place) > self.most:
            self.clear()
        new = [w for w in known if w not in self.place]
        for i in range(0, len(new), 4096):  # the library's results are many times as large as the ids
            self.learn(new[i : i + 4096])
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        codes = coded.indices.to_numpy()
        # One more run for each row, of the end id, which lies before all others.
        begin = np.insert(self.starts[at].astype(np.int32)[codes], bounds[1:], 0)
        size = np.insert((self.starts[at + 1] - self.starts[at]).astype(np.int32)[codes], bounds[1:], 1)
        self.ids[0] = end
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[bounds + np.arange(len(bounds))]
        out = self.ids[ragged(begin, size)]
        return out, offsets


@lru_cache(maxsize=1)
def tokenizer_at(path: str, most: int) -> WordTokenizer:
    """One for each Python worker, so that words encoded for one task are known to the next."""
    return WordTokenizer(path, most)


class Bins:
    """One worker's open bins; pieces are (row, start, length, ...) tuples of which only the length counts."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def add(self, length: int, piece: tuple) -> list[tuple[tuple, int, int]]:
        """(piece, sequence, offset) of the bin that this piece fills, if it does."""
        bin_ = self.open.setdefault(length, [])
        bin_.append(piece)
        if len(bin_) * length < self.capacity:
            return []
        del self.open[length]
        return self.sequence(bin_, [length] * len(bin_))

    def sequence(self, held: list[tuple], lengths: list[int]) -> list[tuple[tuple, int, int]]:
        at, out = 0, []
        for piece, length in zip(held, lengths, strict=True):
            out.append((piece, self.next_id, at))
            at += length
        self.next_id += 1
        return out

    def close(self) -> list[tuple[tuple, int, int]]:
        """All open pieces, largest first, in sequences of the largest powers of two that they make up."""
        held = [(length, piece) for length in sorted(self.open, reverse=True) for piece in self.open[length]]
        self.open = {}
        total, at, out = sum(length for length, _ in held), 0, []
        while total:
            target = min(self.capacity, 1 << (total.bit_length() - 1))
            size, k = 0, at
            while size < target:
                size += held[k][0]
                k += 1
            out += self.sequence([p for _, p in held[at:k]], [n for n, _ in held[at:k]])
            total, at = total - target, k
        return out


def pack(
    df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 2, with_ids: bool = False, chunk_bytes: int = 8 << 20, kept_words: int = 700_000
) -> DataFrame:
    """A row for each piece: key and PIECES, and the piece's ids if ``with_ids``. Narrow: no shuffle.

    A worker holds the open bins only: fewer than capacity / length pieces of each of the lengths 1, 2, 4, ... It works on
    ``chunk_bytes`` of text at a time and keeps ``kept_words`` encoded words; both change its memory and speed only.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        tokenizer = tokenizer_at(tokenizer_path, kept_words)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)

        def out(placed: list, schema: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*((*p[:5], s, o, *p[5:]) for p, s, o in placed), strict=True))
            arrays = [pa.array(columns[0], schema), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[7:])]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        schema = pa.null()
        for batch in pieces(batches, limit=chunk_bytes):
            schema = batch.schema.field("id").type
            ids, offsets = tokenizer.rows(batch.column("text"), end_id)
            keys, placed = batch.column("id").to_pylist(), []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                at = a
                while at < b:
                    n = min(capacity, 1 << ((b - at).bit_length() - 1))
                    part = ids[at : at + n]
                    placed += bins.add(n, (keys[row], at - a, n, zlib.crc32(part.tobytes()), b - a, *([part.tolist()] if with_ids else [])))
                    at += n
            if placed:
                yield out(placed, schema)
        if placed := bins.close():
            yield out(placed, schema)
        give_back()

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {PIECES}" + ", ids array<long>" * with_ids).withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
