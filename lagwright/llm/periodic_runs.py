"""Runs (maximal periodicities) of words in texts, by the runs theorem.

A run is a stretch of words with smallest period q, at least 2 q long, that no neighbour extends with that period. Every
run has a Lyndon root, which is the longest Lyndon word at its place under one of two opposite orders of the words. The
longest Lyndon word at i ends before the next suffix that is smaller than suffix i; under the opposite order, before the
next that is greater. Both are next-smaller-value scans over the inverse suffix array. Each such root is extended to both
sides as far as its period holds: by the longest common prefix of two suffixes, and by that of two suffixes of the
reversed words; each is a range minimum over an LCP array, answered by a sparse table.

All rows of a batch form one string, with a separate sign after each row, smaller than all words; nothing goes over it.
Suffixes are sorted by prefix doubling among those not yet told apart. Only roots that can reach the wanted length ask
the second array, which is made for their rows alone. Work is O(n log n) in a batch's words, memory O(n): of the sparse
table two levels are there at a time, each with the queries of its own.

Null and empty texts have no words and no runs. Repeated rows are searched each for itself; other columns are not looked
at. A row is one task's work, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_chunks, ragged, read, split_words, text_buffer

SHORTEST = 12


def suffix_order(signs: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes. Each row of signs must end in a sign that occurs once."""
    order = np.argsort(signs, kind="stable")
    firsts = np.append(True, signs[order][1:] != signs[order][:-1])
    rank = np.empty(len(signs), np.int64)
    rank[order] = np.maximum.accumulate(np.where(firsts, np.arange(len(signs)), 0))
    # Places in ``order`` whose suffixes agree with a neighbour's so far: the only ones to go on with.
    open_ = np.flatnonzero(~(firsts & np.append(firsts[1:], True)))
    width = 1
    while len(open_):
        held = order[open_]
        keys = rank[held] * len(signs) + rank[held + width]  # a suffix that is not told apart goes on beyond width
        sort = np.argsort(keys, kind="stable")
        held, keys = held[sort], keys[sort]
        order[open_] = held
        firsts = np.append(True, keys[1:] != keys[:-1])
        rank[held] = open_[np.maximum.accumulate(np.where(firsts, np.arange(len(held)), 0))]
        open_ = open_[~(firsts & np.append(firsts[1:], True))]
        width *= 2
    return order


def common_prefixes(signs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[r]: the common prefix of the suffixes at r - 1 and r of the order; 0 at 0.

    In the order of places it falls by one at most from a place to the next, and by just one wherever the signs before
    both suffixes agree; only the other places are compared, whose sum is O(n log n), in blocks of growing width.
    """
    n = len(signs)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    bound = (before >= 0) & ~((at > 0) & (before > 0) & (signs[at - 1] == signs[before - 1]) & (np.roll(before, 1) == before - 1))
    todo = np.flatnonzero(bound)
    length = np.zeros(n, np.int64)
    width = 1
    while len(todo):
        i, j = todo + length[todo], before[todo] + length[todo]
        if width == 1:
            same = signs[i] == signs[j]
            length[todo[same]] += 1
            todo = todo[same]
        else:
            # Beyond a row's end no two signs agree, so what a block reads there is never counted.
            steps = np.arange(width)
            parts = []
            for k in range(0, len(todo), max(1, (1 << 21) // width)):
                s = slice(k, k + max(1, (1 << 21) // width))
                differ = signs[np.minimum(i[s, None] + steps, n - 1)] != signs[np.minimum(j[s, None] + steps, n - 1)]
                differ |= (i[s, None] + steps >= n) | (j[s, None] + steps >= n)
                parts.append(np.where(differ.any(1), differ.argmax(1), width))
            more = np.concatenate(parts)
            length[todo] += more
            todo = todo[more == width]
        width = min(width * 2, 1 << 14)
    starts = np.maximum.accumulate(np.where(bound | (before < 0), at, 0))
    length = length[starts] - (at - starts)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = length[order[1:]]
    return lcp


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of values[low:high] for each pair, low < high, by a sparse table of which one level is held at a time."""
    out = np.zeros(len(low), values.dtype)
    level = np.frexp((high - low).astype(float))[1] - 1
    table, k = values, 0
    for k in range(int(level.max(initial=-1)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class Extents:
    """Common prefixes of suffixes of ``signs``."""

    def __init__(self, signs: np.ndarray):
        self.order = suffix_order(signs)
        self.rank = np.empty(len(signs), np.int64)
        self.rank[self.order] = np.arange(len(signs))
        self.lcp = common_prefixes(signs, self.order)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return range_minima(self.lcp, np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, the length if there is none."""
    held = values.tolist()
    out = [len(held)] * len(held)
    stack: list[int] = []
    for i, v in enumerate(held):
        while stack and held[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(codes: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(row, start, length, period) of all runs of at least ``shortest`` words, by row, start, period.

    codes: equal for equal words; bounds: where each row's words begin and end among them.
    """
    rows = len(bounds) - 1
    size = np.diff(bounds)
    # Each row's words, then a sign of its own; row r's words begin at heads[r].
    heads = bounds[:-1] + np.arange(rows)
    row = np.repeat(np.arange(rows), size + 1)
    signs = np.empty(len(codes) + rows, np.int64)
    own = np.zeros(len(signs), bool)
    own[heads + size] = True
    signs[own], signs[~own] = np.arange(rows), rows + codes
    if not len(codes):
        return np.zeros((0, 4), np.int64)
    right = Extents(signs)
    ends = (heads + size)[row]  # the place of each row's own sign
    at = np.flatnonzero(~own)
    found = []
    for values in (right.rank, -right.rank):
        period = next_smaller(values)[at] - at
        other = at + period
        # A root repeats its first word and is long enough with the most that it may gain to the left.
        some = np.flatnonzero((other < ends[at]))
        some = some[signs[at[some]] == signs[other[some]]]
        found.append(np.stack([at[some], period[some]], 1))
    found = np.unique(np.concatenate(found), axis=0)
    start, period = found.T
    gain = right(start, start + period) if len(start) else start
    room = np.minimum(period - 1, start - heads[row[start]])
    able = (room + period + gain >= np.maximum(shortest, 2 * period))
    start, period, gain = start[able], period[able], gain[able]
    if not len(start):
        return np.zeros((0, 4), np.int64)
    # To the left: the reversed words of the rows in question; place p of row r is at last[r] - p there.
    wanted = np.unique(row[start])
    picked = ragged(heads[wanted], size[wanted] + 1)
    firsts = np.cumsum(size[wanted] + 1) - (size[wanted] + 1)
    place = np.zeros(rows, np.int64)
    place[wanted] = firsts
    mirrored = np.repeat(firsts + size[wanted] - 1, size[wanted] + 1) - (np.arange(len(picked)) - np.repeat(firsts, size[wanted] + 1))
    turned = signs[picked]
    words = ~own[picked]
    flipped = turned.copy()
    flipped[mirrored[words]] = turned[words]
    left = Extents(flipped)
    r = row[start]
    mirror = lambda p: place[r] + size[r] - 1 - (p - heads[r])
    back = np.zeros(len(start), np.int64)
    inner = np.flatnonzero(start > heads[r])
    if len(inner):
        back[inner] = left(mirror(start - 1)[inner], mirror(start + period - 1)[inner])
    length = back + period + gain
    keep = (length >= 2 * period) & (length >= shortest)
    out = np.stack([r, start - back - heads[r], length, period], 1)[keep]
    out = np.unique(out, axis=0)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def dropped_words(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words a run contains after its first period."""
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    starts = bounds[runs[:, 0]] + runs[:, 1]
    np.add.at(change, starts + runs[:, 3], 1)
    np.add.at(change, starts + runs[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


#: (seeds, word counts) to (a, p): from word a on, a row's words are its words a to a + p - 1 again and again.
Tails = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, seed: Column | None = None, tails: Tails | None = None) -> DataFrame:
    """key, n_words, runs (array of start, length, period, by start, then period), collapsed of each row.

    collapsed: the words joined by blanks, without those that a run contains after its first period. With ``tails``,
    words are repeated first, as it says for each row's ``seed``. Narrow: no shuffle.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.lit(0) if seed is None else seed).cast("long").alias("seed"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = split_words(*text_buffer(batch.column(1)))
        size = np.diff(bounds)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        if tails is not None and len(codes):
            a, p = tails(batch.column(2).to_numpy(), size)
            at = np.arange(len(codes)) - np.repeat(bounds[:-1], size)
            a, p = np.repeat(a, size), np.repeat(p, size)
            codes = codes[np.arange(len(codes)) - at + np.where(at >= a, a + (at - a) % p, at)]
        runs = runs_of(codes, bounds, shortest)
        kept = ~dropped_words(runs, bounds)
        text, ends = joined(coded.dictionary, codes[kept], np.concatenate([[0], np.cumsum(kept)])[bounds])
        counts = np.bincount(runs[:, 0], minlength=len(size))
        spans = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
        collapsed = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), listed, collapsed], names=["id", "n_words", "runs", "collapsed"])

    schema = f"id {dict(rows.dtypes)['id']}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_chunks(rows, work, schema).withColumnRenamed("id", key)


def joined(words: pa.StringArray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words joined by one blank: bytes, and the rows' offsets in them."""
    if not len(codes):
        return np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
    starts = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    size = np.diff(starts)[codes]
    last = np.zeros(len(codes), bool)  # the last of its row has no blank after it
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    wide = size + ~last
    ends = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(ends[-1], 32, np.uint8)
    out[ragged(ends[:-1], size)] = data[ragged(starts[:-1][codes], size)]
    return out, ends[bounds]


def planted(seeds: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows whose seed is divisible by ten the words repeat from word a = g % n on with period 1 + (n - a) // (3 + g % 8),
    where g = seed // 10 and n counts the words; of others not."""
    g, n = seeds // 10, np.maximum(size, 1)
    a = np.where(seeds % 10 == 0, g % n, size)
    return a, 1 + np.maximum(n - a, 0) // (3 + g % 8)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = periodic_runs(docs, seed=seed, tails=planted)
    # The longest run; of equals the first, then the one of the smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("b.shorter")
    return found.select(
        "doc_id",
        "n_runs",
        F.col("b.start").alias("start"),
        length.alias("length"),
        F.col("b.period").alias("period"),
        F.expr("(1000 * (-b.shorter)) div b.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
