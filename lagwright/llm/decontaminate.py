"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits. A mask names the positions of a seed and ignores those
between, so that a substituted word there does no harm. The seeds of all benchmark positions join those of all document
positions; each hit fixes an alignment, on which the overlap is verified word by word. Each
alignment is verified once, so that repetitive texts and whole copies cost no more than others: where both repeat themselves, a pair of places is left
out if each has its seed the same few words before it as well, which is on the same alignment. A document
is contaminated if somewhere ``WINDOW`` aligned words in a row differ in ``SUBSTITUTIONS`` at most, words beyond the
text's ends included. The two masks find every such window: whichever two of 13 words are substituted, one of the masks
lies clear of them at some shift (tests try all pairs).

Items of fewer than ``WINDOW`` words have to occur whole: unchanged below ``TOLERANT`` words, with one substitution at
most from there on. Their seeds are their first and last half, of which one is clear. Items of fewer than ``SHORTEST``
words are too common to tell a leak and match nothing. Null and empty texts match nothing. Repeated rows and equal ids
are reported once for each item. An empty benchmark gives an empty result. Scripts without blanks: a run of letters is
one word, so such items match where whole clauses do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read

WINDOW, SUBSTITUTIONS, SHORTEST, TOLERANT = 13, 2, 5, 7
MASKS = [(0, 1, 3, 5, 6, 7), (0, 2, 3, 6, 9, 10)]


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


#: Words after which a stretch that comes again counts as a repetition, at most.
PERIOD = 32


def repetitions(hashes: Column) -> Column:
    """For each word, how many words before it the words that a seed may take stand last as well; null where not within
    PERIOD, and for texts of which more than an eighth of the words differ.

    Two texts that repeat themselves with one period meet at every pair of places with one seed; but a pair of places that
    both repeat what stood the same number of words before lies on the alignment of the pair before it.
    """
    span = max(m[-1] for m in MASKS) + 1
    own = lambda i: F.slice(hashes, i + 1, span)
    last = lambda _, i: F.array_max(F.filter(F.sequence(F.greatest(i - PERIOD, F.lit(0)), i), lambda j: (j < i) & (own(j) == own(i))))
    back = F.transform(hashes, lambda w, i: i - last(w, i))
    return F.when(8 * F.size(F.array_distinct(hashes)) <= F.size(hashes), back)


def seed(hashes: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    """The hash of a mask's words at a position; null where the text ends before."""
    fits = at + mask[-1] < F.size(hashes)
    return F.when(fits, F.xxhash64(F.lit(number), *(F.get(hashes, at + k) for k in mask)))


def half(n: int) -> int:
    """The words in a seed of an item of n, fewer than WINDOW: all of them where it has to occur unchanged."""
    return n if n < TOLERANT else n // 2


def seeds(df: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row for each position and mask of column h at which a seed fits: what df has, pos, mask (its number), seed and back
    (see repetitions()).

    posexplode_outer, since for posexplode the optimizer infers a filter on the size of h, which cuts all texts twice.
    """
    at = df.withColumn("_b", repetitions(F.col("h"))).select("*", F.posexplode_outer("h").alias("pos", "_w")).drop("_w")
    found = at.select("*", F.posexplode(F.array(*(seed(F.col("h"), F.col("pos"), i, m) for i, m in enumerate(masks)))).alias("mask", "seed"))
    return found.where(F.col("seed").isNotNull()).withColumn("back", F.get("_b", F.col("pos"))).drop("_b")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    max_broadcast_words: int = 1_000_000,
    max_broadcast_hits: int = 1_000_000,
) -> DataFrame:
    """doc_key, item_key, n_matched and n_compared (of the best window), item_matched and item_words (of the whole item).

    The seeds of documents, without their texts, meet the benchmark's and are reduced to distinct alignments, however
    often a text repeats itself. Only documents with one are read again and verified. The benchmark's seeds are broadcast
    only if it has ``max_broadcast_words`` words at most, the alignments if there are ``max_broadcast_hits`` at most; else
    a shuffle joins them.
    """
    items = benchmark.select(F.col(item_key).alias("_item"), word_hashes(F.col(item_text)).alias("h")).where(F.size("h") >= SHORTEST)
    items = items.withColumn("_item_row", F.xxhash64("_item", "h")).dropDuplicates(["_item_row"])
    words = items.agg(F.sum(F.size("h"))).first()[0] or 0
    short = {r[0] for r in items.where(F.size("h") < WINDOW).select(F.size("h")).distinct().collect()}
    masks = [*MASKS, *(tuple(range(n)) for n in sorted({half(n) for n in short}))]

    listed = seeds(items.select("_item_row", F.size("h").alias("n"), "h"), masks)
    # A short item counts by its ends only, a long one by the spaced seeds.
    own = F.coalesce(*(F.when(F.col("n") == n, F.lit(masks.index(tuple(range(half(n)))))) for n in sorted(short)), F.lit(-1))
    ends = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - F.coalesce(*(F.when(F.col("n") == n, F.lit(half(n))) for n in sorted(short)), F.lit(0)))
    whole = F.col("n") >= WINDOW
    listed = listed.where(F.when(whole, F.col("mask") < len(MASKS)).otherwise((F.col("mask") == own) & ends))
    listed = listed.select("seed", "_item_row", F.col("pos").alias("_item_pos"), F.when(whole, F.col("back")).alias("_item_back"))
    sides = items.select("_item_row", "_item", F.col("h").alias("_item_h"))

    if words <= max_broadcast_words:
        listed, sides = F.broadcast(listed), F.broadcast(sides)
    rows = docs.select(F.col(doc_key).alias("_doc"), F.col(doc_text).alias("_text")).withColumn("_doc_row", F.xxhash64("_doc", "_text"))
    found = seeds(rows.select("_doc_row", word_hashes(F.col("_text")).alias("h")), masks).select("_doc_row", "pos", "seed", "back").join(listed, "seed").where(F.coalesce(F.col("back") != F.col("_item_back"), F.lit(True)))
    aligned = cut_lineage(found.select("_doc_row", "_item_row", (F.col("pos") - F.col("_item_pos")).alias("start")).distinct())
    held, starts = aligned.select("_doc_row").distinct(), aligned.groupBy("_doc_row", "_item_row").agg(F.collect_list("start").alias("starts"))
    if aligned.count() <= max_broadcast_hits:
        starts, held = F.broadcast(starts), F.broadcast(held)
    # A row for a document and an item, with all their alignments: a text's words are not copied for each of them.
    hits = rows.join(held, "_doc_row", "left_semi").select("_doc", "_doc_row", word_hashes(F.col("_text")).alias("h")).join(starts, "_doc_row").join(sides, "_item_row")
    hits = hits.select("_doc", "_item", "h", "_item_h", "starts", F.size("_item_h").alias("item_words"), F.least(F.size("_item_h"), F.lit(WINDOW)).alias("n_compared"))

    def equal(start: Column) -> Column:
        """1 for each of the item's words that is aligned with an equal one."""
        return F.transform("_item_h", lambda w, j: F.when(start + j >= 0, F.coalesce((F.get(F.col("h"), start + j) == w).cast("int"), F.lit(0))).otherwise(0))

    def counts(e: Column) -> Column:
        """Matches in the best window, and in all. Each window's sum comes from the one before it; state: (sum, best)."""
        step = lambda s, j: s["now"] + F.get(e, j) - F.when(j >= F.col("n_compared"), F.get(e, j - F.col("n_compared"))).otherwise(0)
        best = F.aggregate(
            F.sequence(F.lit(0), F.col("item_words") - 1),
            F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
            lambda s, j: F.struct(step(s, j).alias("now"), F.greatest(s["best"], step(s, j)).alias("best")),
            lambda s: s["best"],
        )
        return F.struct(best.alias("n_matched"), F.aggregate(e, F.lit(0), lambda a, x: a + x).alias("item_matched"))

    allowed = F.when(F.col("item_words") >= WINDOW, SUBSTITUTIONS).when(F.col("item_words") >= TOLERANT, 1).otherwise(0)
    # A lambda's argument is worked out once; a column would be put in place of each of its uses.
    counted = F.transform("starts", lambda at: F.get(F.transform(F.array(equal(at)), counts), F.lit(0)))
    best = F.array_max(F.filter(counted, lambda c: F.col("n_compared") - c["n_matched"] <= allowed))
    scored = hits.select("_doc", "_item", "item_words", "n_compared", best.alias("_c")).where(F.col("_c").isNotNull()).select("*", "_c.*")
    best = F.max(F.struct("n_matched", "item_matched", "n_compared", "item_words")).alias("b")
    return scored.groupBy(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key)).agg(best).select(doc_key, item_key, "b.n_matched", "b.n_compared", "b.item_matched", "b.item_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept; a null id is matched as such. Their ids are broadcast
    if there are ``max_broadcast_rows`` at most, so that texts stay where they are; else the join is by a shuffle."""
    bad = cut_lineage(overlaps(docs, benchmark, key).select(F.col(key).alias("_bad")).distinct())
    few = bad.count() <= max_broadcast_rows
    # The columns ride in one struct, so that none of them can clash.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"))
    return whole.join(F.broadcast(bad) if few else bad, F.col("_in")[key].eqNullSafe(F.col("_bad")), "left_anti").select("_in.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


# Aligned equal words are counted by a join on the word; the best window ends at one of them.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM d),
bw AS (SELECT item_id, len(w) AS n, unnest(range(len(w))) AS j, unnest(w) AS x FROM b WHERE len(w) >= 5),
hit AS (SELECT doc_id, item_id, i - j AS a, j, n FROM dw JOIN bw USING (x)),
win AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, a ORDER BY j RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS c FROM hit),
best AS (SELECT doc_id, item_id, n, max(c) AS c, count(*) AS m FROM win GROUP BY doc_id, item_id, a, n),
ok AS (SELECT doc_id, item_id, max({'c': c, 'm': m, 'k': least(n, 13), 'n': n}) AS b FROM best
  WHERE least(n, 13) - c <= CASE WHEN n >= 13 THEN 2 WHEN n >= 7 THEN 1 ELSE 0 END GROUP BY doc_id, item_id)
SELECT doc_id, item_id, b.c::INT AS n_matched, b.k::INT AS n_compared, b.m::INT AS item_matched, b.n::INT AS item_words FROM ok
"""
