"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is set if it is set in more than half of the shingles' 64-bit hashes. Each of the 64 bit positions
gets one of the 2 ** (r + 1) - 1 non-zero vectors of r + 1 bits; for each such vector v, a mask keeps the positions
whose vector has an odd product with v. Whichever r positions differ, some v is orthogonal to all their vectors, so its
mask keeps none of them: every pair within radius r has equal masked fingerprints in some table.

Distinct fingerprints meet in the buckets of these tables. Within a bucket only a spanning forest of its links is
emitted, at most one edge for each member, never all pairs; components of the forests' union are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, ascii_lower, bounded_sample, cut_lineage, discard, map_chunks, packed, ragged, read, split_words, text_buffer, written
from .components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42


def masks(radius: int) -> list[int]:
    """The covering masks; position i has vector 1 + i mod (2 ** (radius + 1) - 1)."""
    n = (1 << (radius + 1)) - 1
    vectors = [1 + i % n for i in range(BITS)]
    return [sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() & 1) for v in range(1, n + 1)]


#: The eight bits of a byte, each in a byte of its own, so that 255 of them can be added at once.
SPREAD = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each row's hashes; 0 for a row without any."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    parts = -(-sizes[rows] // 255)  # runs of 255 hashes at most, so that no byte overflows
    first = np.concatenate([[0], np.cumsum(parts)])
    starts = np.arange(first[-1]) - np.repeat(first[:-1], parts)
    starts = np.repeat(bounds[:-1][rows], parts) + 255 * starts
    counts = np.zeros((len(rows), BITS), np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(SPREAD[octets[:, k]], starts)
        counts[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first[:-1], axis=0)
    bits = counts * 2 > sizes[rows][:, None]
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_fingerprints(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """Of each text's shingles of ``width`` words, A-Z lower-cased, one blank between words; with fewer words, of all."""
    data, offsets = text_buffer(texts)
    words, bounds = split_words(LOWER[data], offsets)
    places = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
    kept = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
    # All words with one blank after each.
    spaced = np.full(len(kept) + len(words), 32, np.uint8)
    spaced[np.arange(len(kept)) + np.repeat(np.arange(len(words)), np.diff(places))] = kept
    begin = places[:-1] + np.arange(len(words))
    end = places[1:] + np.arange(len(words))
    n = np.diff(bounds)
    shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - bounds[:-1], shingles)
    stop = np.minimum(at + width, np.repeat(bounds[1:], shingles)) - 1
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[at].tolist(), end[stop].tolist(), strict=True)), np.uint64, len(at))
    return majority(hashes, ends)


def word_set_fingerprints(texts: pa.Array, width: int, prints: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's set of words, A-Z lower-cased: few changed words change few bits, and frequent words weigh once.
    An array (n, prints), one fingerprint for each of ``prints`` seeds.

    And a sketch (n, 2) of each text's shingles of ``width`` words: 128 bits, one of the least hash in each of 128 cells,
    of which two texts with Jaccard similarity J differ in about 64 (1 - J).
    """
    data, offsets = text_buffer(texts)
    words, bounds = split_words(LOWER[data], offsets)
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    seeded = [np.fromiter((xxhash.xxh64_intdigest(w, SEED + j) for w in vocabulary), np.uint64, len(vocabulary)) for j in range(prints)]
    hashes = seeded[0]
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    codes = coded.indices.to_numpy()
    pairs = np.unique(rows * max(1, len(hashes)) + codes)
    limits = np.searchsorted(pairs, np.arange(len(bounds)) * max(1, len(hashes)))
    found = np.stack([majority(h[pairs % max(1, len(h))], limits) for h in seeded], 1)
    sketch = np.zeros((len(bounds) - 1, 128), np.uint8)
    starts = np.arange(len(codes))[: max(0, len(codes) - width + 1)]
    starts = starts[rows[starts] == rows[starts + width - 1]] if len(starts) else starts
    if len(starts):
        mixed = np.zeros(len(starts), np.uint64)
        for j in range(width):
            mixed = (mixed ^ hashes[codes[starts + j]]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        cell = rows[starts] * 128 + (mixed >> np.uint64(57)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        least = np.minimum.reduceat((mixed & np.uint64((1 << 57) - 1))[order], first)
        sketch.ravel()[cell[order][first]] = (least & np.uint64(1)).astype(np.uint8)
    return found, np.packbits(sketch, axis=1).view(np.uint64)


def fingerprints(df: DataFrame, of: Callable[[pa.Array], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the fingerprint as a signed long). Narrow: no shuffle."""
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1)).view(np.int64))], names=["id", "fp"])

    return map_chunks(rows, work, f"id {dict(rows.dtypes)['id']}, fp long").withColumnRenamed("id", key)


def forest(values: np.ndarray, radius: int, sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of the links between ``values`` (uint64, equal ones are linked).

    Any forest in time proportional to members times those not yet reached, which for a dense group is about its size;
    with ``sketches`` (n, 2), the links' minimal one by the bits in which these differ (Prim's), in time quadratic in
    the bucket. Whatever similarity is asked for later, such a tree holds together what it links as far as sketches tell.
    """
    left = np.arange(len(values))
    a, b = [], []
    if sketches is not None:
        far = np.full(len(values), 255, np.uint8)
        parent = np.zeros(len(values), np.int64)
        node = 0
        left = left[1:]
        while len(left):
            d = np.bitwise_count(sketches[left] ^ sketches[node]).sum(1, dtype=np.uint8)
            d[np.bitwise_count(values[left] ^ values[node]) > radius] = 255
            closer = d < far[left]
            far[left[closer]], parent[left[closer]] = d[closer], node
            k = int(far[left].argmin())
            node = left[k]
            if far[node] < 255:
                a.append(parent[node])
                b.append(node)
            left = np.delete(left, k)
        return np.array(a, np.int64), np.array(b, np.int64)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(values[left] ^ values[node]) <= radius
            found = left[near]
            a += [node] * len(found)
            b += found.tolist()
            queue += found.tolist()
            left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def covering_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of spanning forests, in each bucket of each table, of the links within ``radius``.

    points: node, fp (or several independent ones, fp0, fp1, ..., a link in any of which counts), and s1, s2 (the sketch)
    if the forests shall be minimal. Buckets are streamed in key order; a bucket of one point is skipped before it costs
    anything.
    """
    sketched = "s1" in points.columns
    rest = ["node", *(["s1", "s2"] if sketched else [])]
    tables = masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    prints = [c for c in points.columns if c.startswith("fp")]
    each = points.select(*rest, F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(c).alias("fp")) for j, c in enumerate(prints)))).alias("p")).select(*rest, "p.*")
    keyed = each.select(*rest, "fp", "j", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(signed)))).alias("x"))
    keyed = keyed.withColumn("key", F.xxhash64(F.col("j") * len(tables) + F.col("x.t"), F.col("fp").bitwiseAND(F.col("x.m"))))
    dealt = keyed.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "fp", *(["s1", "s2"] if sketched else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # nodes, and rows of fingerprint and sketch, of the bucket that the last batch ended in
        open_key = None

        def edges(groups: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for nodes, values in groups:
                if len(nodes) > 1:
                    i, j = forest(values[:, 0], radius, values[:, 1:] if sketched else None)
                    a.append(nodes[i])
                    b.append(nodes[j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([n for n, _ in held]), np.concatenate([v for _, v in held])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes, *rest = (batch.column(i).to_numpy() for i in range(batch.num_columns))
            values = np.stack(rest, 1).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            groups = []
            if held and keys[0] != open_key:
                groups.append(joined())
                held = []
            several = np.flatnonzero(np.diff(cuts) > 1).tolist()
            last = len(cuts) - 2
            if held and last > 0:
                held.append((nodes[: cuts[1]], values[: cuts[1]]))
                groups.append(joined())
                held = []
                several = [k for k in several if k > 0]
            groups += [(nodes[cuts[k] : cuts[k + 1]], values[cuts[k] : cuts[k + 1]]) for k in several if k < last]
            held.append((nodes[cuts[last] :], values[cuts[last] :]))
            open_key = keys[-1]
            yield edges(groups)
        if held:
            yield edges([joined()])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fp, component_id of each row: components of the links between fingerprints within ``radius``.

    Null and empty texts and texts of white space have fingerprint 0, which links like any other; equal rows have equal
    fingerprints and share a component. component_id is the smallest non-null id of the component. Other columns are
    not looked at. An empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, lambda t: shingle_fingerprints(t, width), key, text))
    firsts = prints.groupBy("fp").agg(F.min(key).alias("first"))
    linked = connected_components(covering_links(firsts.select(F.col("fp").alias("node"), "fp"), radius))
    # Fingerprints without a link are components of their own.
    whole = firsts.join(linked, firsts["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = whole.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(text: str, width: int) -> set[int]:
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))}


def hashed_shingles(words: pa.StringArray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """56-bit hashes of all shingles of ``width`` words, the row of each, and the words' codes; equal for equal shingles as
    shingle_sets() has them: a row of fewer words has one shingle of all its words, and so has a row without any."""
    coded = words.dictionary_encode()
    vocabulary = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = np.append(vocabulary[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64), np.zeros(width, np.uint64))
    n = np.diff(bounds)
    shingles = np.maximum(1, n - width + 1)
    at = ragged(bounds[:-1].astype(np.int64), shingles.astype(np.int64))
    rows = np.repeat(np.arange(len(n)), shingles)
    mixed = np.zeros(len(at), np.uint64)
    for j in range(width):
        there = at + j < bounds[1:][rows]
        mixed = (mixed ^ np.where(there, hashes[at + j], np.uint64(j + 1))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed >> np.uint64(8), rows, coded


#: Bits of a sketch of a set of shingles, 64 a word: of each of that many cells of the hashes, one bit of the least.
SKETCH = 256


def sketches(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, SKETCH / 64) sketches of 56-bit hashes, sorted within their rows; a cell without a hash has bit 0. Two sets of
    Jaccard similarity J differ in (1 - J) / 2 of the bits on average."""
    cell = rows * SKETCH + (hashes >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    bits = np.zeros(n * SKETCH, np.uint8)
    bits[cell[first]] = (hashes[first] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.reshape(n, SKETCH), axis=1).view(np.uint64)


def most_differing(similarity: float) -> int:
    """Bits in which sketches of sets of ``similarity`` or more differ at most, but for a chance of about 1e-9: the mean
    and six deviations."""
    p = (1 - similarity) / 2
    return int(SKETCH * p + 6 * (SKETCH * p * (1 - p)) ** 0.5)


def prefixes(texts: pa.Array, width: int, similarity: float, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text a fingerprint of its set of words, a sketch of its shingles, their number, and of these the first in
    an order that all texts share, so many that any two texts of ``similarity`` (Jaccard) or more have one of them in
    common; as the bounds of each text's and the shingles, in that order. ``common``: sorted hashes that come late in the
    order, the more ``times`` the later (in steps of 9 %); whichever they are, no pair is lost.
    """
    data, offsets = text_buffer(texts)
    words, bounds = split_words(LOWER[data], offsets)
    hashes, rows, coded = hashed_shingles(words, bounds, width)

    def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        first = np.ones(len(rows), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        return hashes[first], rows[first]

    hashes, rows = distinct(hashes, rows)
    sketch = sketches(hashes, rows, len(texts))
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        found = common[at] == hashes
        if found.any():
            hashes, rows = distinct(hashes | np.where(found, np.minimum(8 * np.log2(1 + times[at]), 127), 0).astype(np.uint64) << np.uint64(56), rows)
    starts = np.searchsorted(rows, np.arange(len(texts) + 1))
    n = np.diff(starts)
    # Two sets share similarity * (the larger's size) at least, so neither's first n - that + 1 can all be missed.
    length = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    kept = hashes[ragged(starts[:-1].astype(np.int64), length.astype(np.int64))]
    many = max(1, len(coded.dictionary))
    owners = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pairs = np.unique(owners * many + coded.indices.to_numpy())
    seeded = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    prints = majority(seeded[pairs % many], np.searchsorted(pairs, np.arange(len(texts) + 1) * many))
    return prints, sketch, n, np.concatenate([[0], np.cumsum(length)]), kept


def common_shingles(texts: DataFrame, width: int, sample_rows: int = 16_384, most: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that three or more of a bounded sample of texts have, and how many do. For the
    order of prefixes() only: what the sample leaves out costs time, never a pair."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_buffer(batch.column(1))
        hashes, rows, _ = hashed_shingles(*split_words(LOWER[data], offsets), width)
        found = pd.DataFrame({"r": rows, "h": hashes}).drop_duplicates()["h"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    sample = bounded_sample(texts, F.col("node"), sample_rows).dropDuplicates(["node"])
    counts = map_chunks(sample, work, "h long").groupBy("h").count().where("count >= 3").orderBy(F.desc("count"), "h").limit(most).toPandas().sort_values("h")
    return counts["h"].to_numpy().astype(np.uint64), counts["count"].to_numpy().astype(np.int64)


#: Rows of one or two ids that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """``ids`` with a hint to broadcast it, if it has at most MOST_BROADCAST rows."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def shingles_of(text: Column, width: int) -> Column:
    """The distinct hashes of a text's shingles of ``width`` words, A-Z lower-cased; with fewer words one of them all. As
    hashed_shingles() has them, in other numbers."""
    words = F.filter(F.split(ascii_lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " "))))

    # A lambda's argument is worked out once; a column would be put in place of each of its uses.
    return F.get(F.transform(F.array(words), cut), F.lit(0))


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts share ``similarity`` of their shingles. texts: node, text; nodes can repeat."""
    ends = packed(cut_lineage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    held = texts.join(few(ends), "node", "left_semi").dropDuplicates(["node"]).select("node", shingles_of(F.col("text"), width).alias("s"))
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(held.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return shared.where(F.col("shared") >= similarity * (F.col("n") - F.col("shared"))).select("a", "b")


def similar_components(texts: DataFrame, width: int, similarity: float, radius: int = RADIUS, most_rounds: int = 4, pairs_an_entry: float = 2.0) -> DataFrame:
    """(node, component) of the texts that have a link: components of all pairs of ``similarity`` or more. texts: node, text;
    nodes can repeat.

    A text's keys are its prefix shingles and its keys in the SimHash tables of ``radius``. Keys of two texts give a pair
    each. Of more frequent keys, each bucket has a leader, and each text is verified with the leader of its buckets whose
    sketch is nearest: as many pairs as texts at most. At first the leader is the text with the fewest shingles before the
    bucket's in the common order. Those are the rarest, so of a group of near copies it is the one that was changed least,
    which the others resemble more than each other. Later leaders are drawn by the round. Then each shingle's bucket is
    seen by components, and all pairs of different ones are verified, as soon as that takes at most ``pairs_an_entry`` for
    each entry, a round has brought it down by less than a tenth, or ``most_rounds`` are over. So each pair of the
    similarity is within a component or was verified, whatever the rounds found.

    Buckets of one component have nothing left to link, and components only grow: each round reads what the one before left.

    Pairs are left out before texts are read if their sizes, their places or their sketches (see most_differing) rule the
    similarity out; the last pairs before they are formed, and where their shingles before the bucket's are one, since they
    met in its bucket then. Places: what comes before the first shingle in common is not shared, so it bounds what is; a
    pair that is similar passes in the bucket of that shingle. Buckets are reduced and joined by keys, never gathered.
    """
    order = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    words = [f"s{i}" for i in range(SKETCH // 64)]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, sketch, n, bounds, kept = prefixes(batch.column(1), width, similarity, *order.value)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(kept.view(np.int64)))
        columns = [batch.column(0), pa.array(prints.view(np.int64)), pa.array(n, pa.int64()), *(pa.array(c.copy().view(np.int64)) for c in sketch.T), lists]
        return pa.RecordBatch.from_arrays(columns, names=["node", "fp", "n", *words, "keys"])

    schema = "node long, fp long, n long, " + ", ".join(f"{w} long" for w in words) + ", keys array<long>"
    # The large tables are written compressed, and deleted once the components are there.
    marks = written(map_chunks(texts, work, schema, limit=1 << 20))
    tables_written = [marks]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    tables = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))).bitwiseOR(F.lit(1)) for t, m in enumerate(signed)))

    # The last bit tells them apart: keys of tables are odd, those of shingles even.
    # after: how many shingles a text has from this one on, itself included; all of them for keys of tables.
    # last: the key before this one. Texts that share it as well have met in its bucket.
    entry = lambda x, after, last: F.struct(x.alias("key"), after.cast("int").alias("after"), last.alias("last"))
    own = F.transform("keys", lambda x, i: entry(x.bitwiseAND(F.lit(-2)), F.col("n") - i, F.get("keys", i - 1).bitwiseAND(F.lit(-2))))
    each = marks.select(F.explode(F.concat(own, F.transform(tables, lambda x: entry(x, F.col("n"), F.lit(None).cast("long"))))).alias("e"), "node", F.col("n").cast("int").alias("n")).select("e.*", "node", "n")
    shared = packed(cut_lineage(each.groupBy("key").agg(F.count("*").alias("times"), F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")))
    twice = shared.where("times = 2").select("a", "b").distinct()
    # Two shingles of a text can have one key, once in a great while: the first counts.
    entries = written(each.join(few(shared.where("times > 2").select("key")), "key").groupBy("key", "node", "n").agg(F.max("after").alias("after"), F.max_by("last", "after").alias("last")))
    tables_written.append(entries)
    n_entries = entries.count()
    # Texts without a key in common with another have no part in what follows.
    involved = packed(cut_lineage(entries.select("node").union(twice.select("a")).union(twice.select("b")).distinct()))
    alike = packed(cut_lineage(marks.drop("keys", "fp").join(few(involved), "node", "left_semi").dropDuplicates(["node"])))
    most = most_differing(similarity)

    def near(end: str, other: str) -> Column:
        """In how many bits the sketches of two sides differ."""
        return sum((F.bit_count(F.col(f"{end}_{w}").bitwiseXOR(F.col(f"{other}_{w}"))) for w in words), F.lit(0))

    def plausible(pairs: DataFrame) -> DataFrame:
        side = lambda end: alike.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", *words)))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
        differing = near("a", "b")
        return both.where((F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9) & (differing <= most)).select("a", "b", differing.alias("differing"))

    needed = lambda a, b: similarity / (1 + similarity) * (a + b) - 1e-6

    def placed(a_n: Column, a_after: Column, b_n: Column, b_after: Column) -> Column:
        """Whether sizes and places in a bucket allow the similarity, if its shingle is the first in common."""
        return (F.least(a_n, b_n) >= similarity * F.greatest(a_n, b_n) - 1e-6) & (F.least(a_after, b_after) >= needed(a_n, b_n))

    seen, component, before = None, None, None

    def verify(pairs: DataFrame) -> None:
        nonlocal seen, component
        pairs = plausible(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).select("a", "b")
        pairs = packed(cut_lineage(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")))
        sure = packed(cut_lineage(verified(pairs, texts, width, similarity)))
        seen = pairs if seen is None else seen.union(pairs)
        # A component's edges to its smallest node stand for those that were verified before.
        if component is None:
            component = packed(cut_lineage(connected_components(sure)))
        elif not sure.isEmpty():
            component = packed(cut_lineage(connected_components(sure.union(component.select(F.col("node").alias("a"), F.col("component").alias("b"))))))

    for number in range(most_rounds + 1):
        members = entries.withColumn("component", F.col("node"))
        if component is not None:
            if number > 1:
                entries = entries.where("key % 2 = 0")
            members = entries.join(few(component), "node", "left").select("key", "node", "n", "after", "last", F.coalesce("component", "node").alias("component"))
            # Shingles lose no pair, so what is left is looked for in their buckets; the tables' serve to find leaders in two rounds.
            # One exchange by key for sizes and members; the join above is worked out once.
            bucket = Window.partitionBy("key")
            members = members.repartition("key").withColumn("own", F.count("*").over(Window.partitionBy("key", "component")))
            members = members.withColumns({"all": F.count("*").over(bucket), "top": F.max(F.struct("own", "component")).over(bucket)})
            members = written(members.where("own < all").select("key", "node", "n", "after", "last", "component", F.col("top.component").alias("big"), F.col("top.own").alias("most"), "all"))
            discard(tables_written.pop())
            tables_written.append(members)
            entries = members.select("key", "node", "n", "after", "last")
            left = members.where("key % 2 = 0").groupBy("key").agg(F.first("all").alias("all"), F.first("most").alias("most")).agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0
            if left <= pairs_an_entry * n_entries or number == most_rounds or (before is not None and left > 0.9 * before):
                break
            before = left
        ahead = F.lit(0) if number else F.col("n") - F.col("after")
        turn = F.struct(ahead.alias("ahead"), F.xxhash64(F.lit(number), "node").alias("h"), F.col("node").alias("b"), F.col("component").alias("c"), F.col("n").alias("b_n"), F.col("after").alias("b_after"))
        heads = members.groupBy("key").agg(F.min(turn).alias("head")).select("key", "head.b", "head.c", "head.b_n", "head.b_after")
        led = members.select("key", F.col("node").alias("a"), "component", "n", "after").join(heads, "key")
        led = led.where((F.col("component") != F.col("c")) & placed(F.col("n"), F.col("after"), F.col("b_n"), F.col("b_after")))
        chosen = plausible(led.select("a", "b")).groupBy("a").agg(F.min(F.struct("differing", F.xxhash64(F.lit(number), "b").alias("h"), "b")).alias("m")).select("a", "m.b")
        verify(chosen if number else chosen.union(twice))
    members = members.where("key % 2 = 0").join(alike.select("node", *words), "node")
    side = lambda end: (F.col("node").alias(end), F.col("component").alias(f"c{end}"), F.col("n").alias(f"{end}_n"), F.col("after").alias(f"{end}_after"), F.col("last").alias(f"{end}_last"), *(F.col(w).alias(f"{end}_{w}") for w in words))
    small = members.where("component <> big").select("key", *side("a"))
    others = members.select("key", *side("b"), "big")
    once = (F.col("cb") == F.col("big")) | (F.col("a") < F.col("b"))
    first = F.coalesce(F.col("a_last") != F.col("b_last"), F.lit(True))
    fits = placed(F.col("a_n"), F.col("a_after"), F.col("b_n"), F.col("b_after")) & first & (near("a", "b") <= most)
    verify(small.join(others, "key").where((F.col("ca") != F.col("cb")) & once & fits).select("a", "b"))
    for table in tables_written:
        discard(table)
    return component


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, of which no earlier one is an exact or near copy; the smallest id stays.

    Near copies share ``similarity`` or more of their shingles of ``width`` words (Jaccard); groups are the components of
    all such pairs, each of them proven on the texts, and none is lost (see similar_components). Rows of null text are
    one group, as empty text is; equal rows leave one. Rows with a null id come after all others.
    """
    # The user's columns ride in one struct, so that none of them can clash with a name in here.
    row = F.struct(F.col("_in")[key].isNull().alias("n"), F.col("_in")[key].alias("id"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"))
    body = F.coalesce(F.col("_in")[text], F.lit(""))
    names = whole.withColumn("_content", F.xxhash64(F.sha2(body, 256)))
    linked = similar_components(names.select(F.col("_content").alias("node"), body.alias("text")), width, similarity, radius).withColumnRenamed("node", "_content")
    # The first row of each group: by component where a text has one, else by the text itself.
    ids = names.select("_content", row.alias("_row")).groupBy("_content", "_row").count().groupBy("_content").agg(F.min(F.struct("_row", "count")).alias("_m"), F.sum("count").alias("_n"))
    grouped = ids.join(linked, "_content", "left").withColumn("_group", F.coalesce("component", "_content"))
    first = grouped.groupBy("_group").agg(F.min(F.struct("_m._row", "_content")).alias("_first"))
    marked = grouped.join(first, "_group").select("_content", F.when(F.col("_first._content") == F.col("_content"), F.col("_m._row")).alias("_stays"), (F.col("_m.count") > 1).alias("_again"), "_n")
    # Texts that occur once and lead their group are not listed: their rows stay, where they are.
    listed = cut_lineage(marked.where("_n > 1 or _stays is null"))
    left = names.join(few(listed), "_content", "left").where(F.col("_n").isNull() | (row == F.col("_stays")))
    if listed.where("_again and _stays is not null").isEmpty():
        return left.select("_in.*")
    again = F.coalesce("_again", F.lit(False))
    return left.where(~again).union(left.where(again).dropDuplicates(["_content"])).select("_in.*")
