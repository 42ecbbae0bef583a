"""Large groups of near copies: whole against brute force, and by the rows that are shuffled for them."""

import os

import numpy as np
from pyspark.sql import functions as F

from lagwright.llm import simhash

WIDTH, SIMILARITY = 5, 0.8


def copies(n: int, changes: list[int], seed: int) -> list[str]:
    """An original and n copies of it, each with its own changed words: alike to it, but often not to each other."""
    rng = np.random.default_rng(seed)
    own = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    texts = [" ".join(own)]
    for i in range(n):
        words = list(own)
        for j, at in enumerate(rng.choice(22, changes[i % len(changes)], replace=False)):
            words[5 * at + 6] = f"x{seed}y{i}z{j}"
        texts.append(" ".join(words))
    return texts


def components_of(texts: list[str]) -> set[frozenset[int]]:
    sets = [simhash.shingle_sets(t, WIDTH) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= SIMILARITY * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def similar(spark, texts: list[str]) -> tuple[set[frozenset[int]], int]:
    """The components, and the rows that were written for shuffles on the way."""
    tracker, name = spark.sparkContext.statusTracker(), f"rows-{os.urandom(4).hex()}"
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    spark.sparkContext.setJobGroup(name, name)
    found = simhash.similar_components(df, WIDTH, SIMILARITY).groupBy("component").agg(F.collect_set("node").alias("g")).collect()
    spark.sparkContext.setJobGroup("", "")
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return {frozenset(r.g) for r in found}, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s))


def test_copies_that_are_alike_to_one_only(spark):
    texts = copies(60, [1, 2, 3], 1) + copies(40, [2], 2)[1:] + copies(30, [3], 3)
    assert similar(spark, texts)[0] == components_of(texts)


def test_a_large_group_makes_few_pairs(spark):
    texts = copies(500, [2], 4) + copies(500, [3], 5)
    found, rows = similar(spark, texts)
    assert found == {frozenset(range(501))}
    assert rows < 400_000


def test_copies_that_are_alike_to_none_meet_once(spark):
    texts = copies(400, [3], 6)[1:]
    found, rows = similar(spark, texts)
    assert found == components_of(texts) and rows < 70_000  # 59,010; 87,035 when they met in each bucket they share
