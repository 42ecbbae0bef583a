"""Phrase collocations by pivot partitioning.

Frequent phrases consist of frequent words. Words get one order: rarer ones first, by how often the bucket of a table of
fixed size holds them, then by their hash. The pivot of an occurrence of a phrase is the first place of its rarest word.
From each place of a text on there is a longest phrase, of ``longest`` words at most and within a piece of text, that is
not certainly rare. It goes, as a fragment, to the partition of its pivot, and what it begins with before its pivot
changes, to the partitions of those pivots. Equal fragments are added up before they are sent and again where they meet.
A partition mines its fragments by itself: a phrase is counted by the fragments that begin with it and hold its pivot, so
each occurrence in one partition of one pivot, whose counts need no further exchange. Pivots with very many places are
salted by their fragments, and only their counts are summed once more.

Certainly rare is what buckets say: neighbouring pairs of words are counted in buckets first, then, in other buckets, the
pairs that are left and phrases of more words of which each pair is left. A fragment is thus a phrase that is frequent or
shares its buckets, and a task passes on no more fragments than there are such phrases, however often they occur. It adds
up all that it reads, so texts are read by a task for each core, not by one for each split of the input. All tables have
one size whatever the corpus; a bucket shared by several words or phrases costs work, no result: phrases are counted as
texts, words exactly, by shuffles on them.

Null texts are empty; a null language counts as ``und``. Texts without two words in a piece have no phrases. Repeated
rows count as often as they occur; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER_LETTERS, give_back, pieces, ragged, read, text_buffer, written

LEAST, LONGEST, TOP = 100, 5, 2000
BUCKETS = 1 << 20
#: Buckets of pairs and of longer phrases, and how many of them form a row when tasks' counts are added up.
PAIRS, ROW = 1 << 23, 1 << 13
#: Places of a pivot for each of its salts.
PLACES = 20_000
#: Rows that a task adds up before it passes them on: of words, many of which occur once, and of fragments.
HELD_ROWS, HELD_FRAGMENTS = 200_000, 1_000_000
#: Tasks that read the texts at least; with more cores one for each, with fewer partitions of the input one for each of them.
TASKS = 6

SEPARATOR, BLANK = np.zeros(256, bool), np.zeros(256, bool)
SEPARATOR[list(b".,;:!?\n\v\f\r")] = True
BLANK[[32, 9]] = True


def words_in_pieces(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """All words in order, each word's row, and a number that is equal for words of the same piece of text."""
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    solid = ~(SEPARATOR | BLANK)[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(SEPARATOR[data])[starts] + row
    kept = data[solid]
    places = np.append(np.cumsum(solid)[starts] - 1, len(kept)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)]), row, piece


class Pairs:
    """The distinct (language, word) pairs of a batch, with a 64-bit hash of each; codes: of each word's pair."""

    def __init__(self, words: pa.StringArray, langs: pa.Array, row: np.ndarray):
        coded, spoken = words.dictionary_encode(), langs.dictionary_encode()
        n = max(1, len(coded.dictionary))
        both = spoken.indices.to_numpy().astype(np.int64)[row] * n + coded.indices.to_numpy()
        self.codes, found = pd.factorize(both)
        self.words, self.langs = coded.dictionary.take(pa.array(found % n)), spoken.dictionary.take(pa.array(found // n))
        with np.errstate(over="ignore"):
            self.hashes = (hashed(coded.dictionary)[found % n] + hashed(spoken.dictionary)[found // n]) * np.uint64(0x9E3779B97F4A7C15)


def hashed(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.int64) % buckets


def summed(tables: list[pa.Table]) -> pa.Table:
    """Rows added up in column n, by all other columns."""
    keys = [c for c in tables[0].column_names if c != "n"]
    total = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
    return total.select(tables[0].column_names)


def adding_up(tables: Iterator[pa.Table], most: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for table in tables:
        held.append(table)
        rows += table.num_rows
        if rows > most:
            held = [summed(held)]
            rows = held[0].num_rows
            if rows > most // 2:
                yield from held[0].to_batches(max_chunksize=100_000)
                held, rows = [], 0
    if rows:
        yield from summed(held).to_batches(max_chunksize=100_000)


def spoken(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, phrase, n of all words of rows (lang, text), and each language's total as a null phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for piece in pieces(batches, limit=1 << 20):
                words, row, _ = words_in_pieces(piece.column(1))
                pairs = Pairs(words, piece.column(0), row)
                n = np.bincount(pairs.codes, minlength=len(pairs.words))
                yield pa.table({"lang": pairs.langs, "phrase": pairs.words, "n": pa.array(n, pa.int64())})
                n = np.diff(np.searchsorted(row, np.arange(piece.num_rows + 1)))
                yield pa.table({"lang": piece.column(0), "phrase": pa.nulls(piece.num_rows, pa.string()), "n": pa.array(n, pa.int64())})

        yield from adding_up(tables())
        give_back()

    return rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bucket_table(frequent: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket, how often its most frequent word occurs; 0: it has none. At most ``buckets`` rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs = Pairs(batch.column(1), batch.column(0), np.arange(batch.num_rows))
                at = buckets_of(pairs.hashes, buckets)[pairs.codes]
                yield pa.record_batch({"bucket": pa.array(at), "n": batch.column(2)})

    found = frequent.select("lang", "phrase", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.max("n").alias("n")).toPandas()
    table = np.zeros(buckets, np.int64)
    table[found["bucket"].to_numpy(np.int64)] = found["n"]
    return table


class Ranked:
    """The words of a batch in the order of pivots: rank (-1: certainly not frequent), and starts: where pairs begin."""

    def __init__(self, piece: pa.RecordBatch, table: np.ndarray):
        self.words, row, part = words_in_pieces(piece.column(1))
        self.pairs = Pairs(self.words, piece.column(0), row)
        self.counts = table[buckets_of(self.pairs.hashes, len(table))]
        order = np.empty(len(self.counts), np.int64)
        order[np.lexsort((self.pairs.hashes, self.counts))] = np.arange(len(self.counts))
        self.rank = np.where(self.counts > 0, order, -1)[self.pairs.codes]
        self.starts = np.flatnonzero((part[1:] == part[:-1]) & (self.rank[1:] >= 0) & (self.rank[:-1] >= 0))

    def candidates(self, often: list[np.ndarray], buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each size the places where phrases begin that are not certainly rare, and their buckets in the next table.
        often: the table of pairs and the one of phrases; one that is not there yet rules nothing out."""
        own = self.pairs.hashes[self.pairs.codes]
        at, mixed = self.starts, own[self.starts]
        for k in range(2, longest + 1):
            with np.errstate(over="ignore"):
                mixed = (mixed * np.uint64(0x9E3779B97F4A7C15) ^ own[at + k - 1]) * np.uint64(0xD6E8FEB86659FD93)
            high, low = (x.astype(np.int64) % buckets for x in (mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF)))
            left = np.ones(len(at), bool)
            if k == 2 and often:
                left &= often[0][high]
            if len(often) > 1:
                left &= often[1][low]
            at, mixed = at[left], mixed[left]
            yield k, at, (low if often else high)[left]
            here = np.zeros(len(own), bool)
            here[at] = True
            left = here[at + 1]  # a longer one begins and ends with two of these
            at, mixed = at[left], mixed[left]


def unpacked(tables: list[np.ndarray], buckets: int) -> list[np.ndarray]:
    return [np.unpackbits(t)[:buckets].astype(bool) for t in tables]


def often_table(rows: DataFrame, table: np.ndarray, least: int, longest: int, buckets: int, often: list[np.ndarray]) -> np.ndarray:
    """For each bucket whether ``least`` phrases or more of 2 to ``longest`` words fall into it, of those that ``often``, the
    table before, leaves. Tasks pass on what they counted, a row for each ROW buckets; these are added
    up by row, and a bit for each bucket comes back."""
    held, before = (rows.sparkSession.sparkContext.broadcast(x) for x in (table, [np.packbits(t) for t in often]))
    size = min(ROW, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = np.zeros(buckets, np.uint32), unpacked(before.value, buckets)
        for piece in pieces(batches, limit=1 << 20):
            for _, _, bucket in Ranked(piece, held.value).candidates(known, buckets, longest):
                np.add.at(found, bucket, 1)
        for row in range(-(-buckets // size)):
            own = found[row * size : (row + 1) * size]
            some = np.flatnonzero(own)
            if len(some):
                packed = np.stack([some.astype(np.uint16), np.minimum(own[some], 65535).astype(np.uint16)])
                yield pa.record_batch({"row": pa.array([row], pa.int64()), "found": pa.array([packed.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = None, np.zeros(size, np.int64)

        def bits() -> pa.RecordBatch:
            return pa.record_batch({"row": pa.array([row], pa.int64()), "often": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

        for batch in batches:
            for r, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != row and row is not None:
                    yield bits()
                    total[:] = 0
                row = r
                some, n = np.frombuffer(packed, np.uint16).reshape(2, -1)
                total[some] += n
        if row is not None:
            yield bits()

    counted = rows.mapInArrow(count, "row long, found binary").repartition("row").sortWithinPartitions("row")
    out = np.zeros(-(-buckets // size) * size, bool)
    for row, bits in counted.mapInArrow(add, "row long, often binary").collect():  # buckets / 8 bytes at most
        out[row * size : (row + 1) * size] = np.unpackbits(np.frombuffer(bits, np.uint8))[:size]
    return out[:buckets]


def often_tables(rows: DataFrame, table: np.ndarray, least: int, longest: int = LONGEST, buckets: int = PAIRS) -> list[np.ndarray]:
    """The table of pairs and, in other buckets, the one of phrases of all sizes."""
    pairs = often_table(rows, table, least, 2, buckets, [])
    return [pairs, often_table(rows, table, least, longest, buckets, [pairs])]


def fragments(rows: DataFrame, table: np.ndarray, often: list[np.ndarray], longest: int = LONGEST, places: int = PLACES) -> DataFrame:
    """lang, pivot, salt, salted, place, fragment, n: how often a fragment is the longest one from its first word on whose
    pivot is its word number ``place``."""
    held, often_held = (rows.sparkSession.sparkContext.broadcast(x) for x in (table, [np.packbits(t) for t in often]))
    buckets = len(often[0])
    known: list[np.ndarray] = []  # unpacked once in a task

    def cut(piece: pa.RecordBatch) -> pa.Table:
        if not known:
            known.extend(unpacked(often_held.value, buckets))
        r = Ranked(piece, held.value)
        words, pairs, rank = r.words, r.pairs, r.rank
        n = len(rank)
        place, last, found = np.zeros(n, np.int64), np.zeros(0, np.int64), []
        for k, at, _ in r.candidates(known, buckets, longest):
            moved = rank[at + k - 1] < rank[at + place[at]]
            same = np.zeros(n, bool)
            same[at[~moved]] = True
            over = last[~same[last]]
            found.append((over, np.full(len(over), k - 1), place[over]))
            place[at[moved]] = k - 1
            last = at
        found.append((last, np.full(len(last), longest), place[last]))
        first, size, before = (np.concatenate(x) for x in zip(*found, strict=True))
        stop = first + size
        # The words again, with one blank after each.
        ends = np.frombuffer(words.buffers()[1], np.int32, n + 1).astype(np.int64)
        spaced = np.full(ends[-1] + n, 32, np.uint8)
        spaced[np.arange(ends[-1]) + np.repeat(np.arange(n), np.diff(ends))] = np.frombuffer(words.buffers()[2], np.uint8)[: ends[-1]]
        ends += np.arange(n + 1)
        size = ends[stop] - 1 - ends[first]
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        texts = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(spaced[ragged(ends[first], size)])])
        own = pairs.codes[first + before]
        salts = 1 + r.counts[own] // places
        with np.errstate(over="ignore"):
            mixed = (pairs.hashes[pairs.codes[first]] * np.uint64(31) + pairs.hashes[pairs.codes[stop - 1]]) >> np.uint64(20)
        return pa.table(
            {
                "lang": pairs.langs.take(pa.array(own)),
                "pivot": pa.array(pairs.hashes[own].view(np.int64)),
                "salt": pa.array((mixed % salts.astype(np.uint64)).astype(np.int32)),
                "salted": pa.array(salts > 1),
                "place": pa.array(before.astype(np.int32)),
                "fragment": texts,
                "n": pa.array(np.ones(len(first), np.int64)),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from adding_up((cut(piece) for piece in pieces(batches, limit=1 << 20)), HELD_FRAGMENTS)
        give_back()

    return rows.mapInArrow(run, "lang string, pivot long, salt int, salted boolean, place int, fragment string, n long")


def owned_phrases() -> Column:
    """The phrases of 2 words or more that column w begins with and that hold word number ``place``."""
    sizes = F.sequence(F.greatest(F.lit(2), F.col("place") + 1), F.size("w"))
    return F.transform(sizes, lambda k: F.array_join(F.slice("w", 1, k), " "))


def frequent_phrases(rows: DataFrame, table: np.ndarray, often: list[np.ndarray], least: int = LEAST, longest: int = LONGEST, places: int = PLACES) -> DataFrame:
    """lang, phrase, n of all phrases of 2 to ``longest`` words that occur ``least`` times or more in rows (lang, text)."""
    found = fragments(rows, table, often, longest, places).repartition("lang", "pivot", "salt")
    key = ["lang", "pivot", "salt", "salted"]
    found = found.groupBy(*key, "place", "fragment").agg(F.sum("n").alias("n"))
    # n is at hand for each fragment; phrases are summed where their pivot's fragments lie.
    phrases = found.select(*key, F.split("fragment", " ").alias("w"), "place", "n").select(*key, F.explode(owned_phrases()).alias("phrase"), "n")
    mined = phrases.groupBy(*key, "phrase").agg(F.sum("n").alias("n")).where(F.col("salted") | (F.col("n") >= least))
    return mined.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 100, buckets: int = BUCKETS, pair_buckets: int = PAIRS, places: int = PLACES) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    score: the least, over all cuts in two, of floor(1000 * a * n / (l * r)); a, l, r: how often the phrase and its
    parts occur, n: words of the language. Phrases inside a longer one with ``share`` percent of their count are left out.
    """
    rows = spoken(docs, lang, text).coalesce(max(TASKS, docs.sparkSession.sparkContext.defaultParallelism))
    words = written(word_counts(rows).where(F.col("phrase").isNull() | (F.col("n") >= least)))
    singles, totals = words.where("phrase is not null"), words.where("phrase is null").select("lang", F.col("n").alias("total"))
    table = bucket_table(singles, buckets)
    found = written(frequent_phrases(rows, table, often_tables(rows, table, least, longest, pair_buckets), least, longest, places))
    return ranked(found, singles, totals, top, share)


def ranked(found: DataFrame, singles: DataFrame, totals: DataFrame, top: int = TOP, share: int = 100) -> DataFrame:
    """collocations() from the frequent phrases and words (lang, phrase, n) and the languages' totals (lang, total)."""
    split = found.withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    # A longer phrase's inner phrases, with its count: those that it accounts for are dropped.
    size = F.size("w")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda a: F.struct(a.alias("a"), k.alias("k")))))
    inner = split.where(size > 2).select("lang", "n", "w", F.explode(spans).alias("s")).select("lang", part(F.col("s.a"), F.col("s.k")).alias("phrase"), "n")
    covered = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = split.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("n"), F.lit(True)))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"))
    known = found.select("lang", "phrase", "n").union(singles.select("lang", "phrase", "n"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(totals, "lang")
    # Whole numbers of up to 38 digits: products may pass 64 bits.
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('total')} * cast(1000 as decimal(4, 0))) div ({wide('l')} * {wide('r')})")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"), F.first("a").alias("a"), F.first("total").alias("n"))
    scored = scored.select("lang", "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


SQL = f"""
with texts as (
  select coalesce(lang, 'und') lang, translate(coalesce(text, ''), '{UPPER_LETTERS}', '{UPPER_LETTERS.lower()}') text from documents),
parts as (select lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) part from texts),
words as (select lang, [x for x in string_split_regex(part, '[\\x20\\x09]+') if x <> ''] w from parts),
totals as (select lang, sum(len(w)) n from words group by lang),
spans as (select lang, w, unnest(range(1, 6)) size from words),
grams as (
  select lang, size, unnest([array_to_string(w[i : i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) phrase
  from spans where len(w) >= size),
counts as (select lang, size, phrase, count(*) f from grams group by all having count(*) >= {LEAST}),
split as (select *, string_split(phrase, ' ') w from counts where size > 1),
starts as (select *, unnest(range(1, size + 1)) i from split where size > 2),
subs as (select *, unnest(range(2, size)) k from starts),
covered as (select lang, array_to_string(w[i : i + k - 1], ' ') phrase, max(f) longer from subs where i + k - 1 <= size group by all),
kept as (select s.* from split s left join covered c using (lang, phrase) where longer is null or 100 * longer < 100 * f),
cut_at as (select *, unnest(range(1, size)) k from kept),
cuts as (select lang, phrase, f, k, array_to_string(w[1:k], ' ') head, array_to_string(w[k + 1 : size], ' ') tail from cut_at),
scores as (
  select c.lang, c.phrase, c.f a, k, x.f l, y.f r, t.n, (1000::hugeint * c.f * t.n) // (x.f::hugeint * y.f) score
  from cuts c join counts x on x.lang = c.lang and x.phrase = c.head join counts y on y.lang = c.lang and y.phrase = c.tail
  join totals t on t.lang = c.lang),
lowest as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from lowest)
select lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from ranked where rank <= {TOP}
"""
