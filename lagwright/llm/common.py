"""What the text operators share: session settings, held-out folds and Arrow word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; batches are cut to this, whole rows at least.
CHUNK_BYTES = 2 << 20

#: ASCII white space: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where none is set, in local mode only, a
    temporary one: on a cluster the executors would not share it, so there this raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read back from it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition of what packed() returns.
PACKED_ROWS = 50_000


def packed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of cut_lineage() of few columns, a partition for each PACKED_ROWS rows: a small one that lies in as many
    files as there are shuffle partitions would write two files for each of them in every shuffle that follows."""
    rows = df.count() if rows is None else rows
    return df.coalesce(1 + rows // PACKED_ROWS)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER_LETTERS, UPPER_LETTERS.lower())


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about ``limit`` bytes at most, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8) if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[pa.StringArray, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the rows in order, and where each row's words begin and end among them.

    cuts: marks bytes at which a new word begins in any case.
    """
    solid = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    before[heads] = False
    if cuts is not None:
        before &= ~cuts
    starts = np.flatnonzero(solid & ~before)
    bounds = np.searchsorted(starts, offsets)
    kept = data[solid]
    # The place of each start among the kept bytes: words lie there end to end.
    places = np.append(np.cumsum(solid, dtype=np.int64)[starts] - 1, len(kept)).astype(np.int32) if len(data) else np.zeros(1, np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(kept))])
    return words, bounds


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of ``values`` for each row; bounds as of split_words."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all the runs, end to end."""
    ends = np.cumsum(lengths, dtype=lengths.dtype)
    return np.arange(ends[-1] if len(ends) else 0, dtype=lengths.dtype) + np.repeat(starts - (ends - lengths), lengths)


def give_back() -> None:
    """Memory that a Python worker holds and does not use goes back to the system: workers live on between tasks, and what
    they and Arrow's pool keep is better used by the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_chunks(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """``work`` over pieces of bounded size; narrow, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column, limit):
            yield work(piece)
        give_back()

    return df.mapInArrow(run, schema)


#: Strata whose shares are broadcast; beyond that they are joined by a shuffle.
MOST_STRATA = 10_000


def bounded_sample(df: DataFrame, key: Column, rows: int, strata: Column | None = None) -> DataFrame:
    """About ``rows`` rows of each stratum, chosen by a hash of ``key``, all if there are fewer.

    One counting pass fixes the share of each stratum that has more; no window or sort gathers a stratum.
    """
    strata = F.lit(0) if strata is None else strata
    share = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    large = df.groupBy(strata.alias("__stratum")).count().where(F.col("count") > rows).select("__stratum", (F.lit(float(rows)) / F.col("count")).alias("__share"))
    found = large.limit(MOST_STRATA + 1).collect()
    if len(found) <= MOST_STRATA:
        large = F.broadcast(df.sparkSession.createDataFrame(found, large.schema))
    marked = df.withColumns({"__own": strata, "__at": share}).join(large, F.col("__own").eqNullSafe(F.col("__stratum")), "left")
    return marked.where(F.col("__at") < F.coalesce("__share", F.lit(1.0))).select(*(F.col(f"`{c}`") for c in df.columns))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder: for texts, smaller than a checkpoint's raw rows."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that written() made, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
