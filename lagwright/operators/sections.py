"""A recording's sections made more by cutting the longest, or fewer by joining the closest, until a count is reached.

Each step hangs on the one before, so a key's sections come together as one row; a heap finds the next one to cut or join.
Sections have src_a, src_b (in the source), dst_a, dst_b (in the target); ones with a null have no part. They are taken in
the order of (src_a, src_b), which is that of the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import matched
from .placement import SPAN, bounded
from .waves import mapped

#: Seconds that a section has to last (fixed value), and the share of it at either end that is not cut.
SHORTEST, MARGIN = 0.4, 0.3

Section = tuple[float, float, float, float]


def quiet_cut(env: np.ndarray, hop: float, start: float, stop: float) -> float | None:
    """Where to cut a section: at the quietest sample of its middle, SHORTEST off its ends; in the middle where the
    envelope says nothing; None if it is too short."""
    length = stop - start
    if length < 2 * SHORTEST:
        return None
    margin = max(SHORTEST, length * MARGIN)
    low, high = start + margin, stop - margin
    first = max(0, int(low / hop))
    last = min(len(env), max(first + 1, int(high / hop)))
    if high <= low + 0.02 or first >= len(env):
        return (start + stop) / 2
    return min(max((first + int(env[first:last].argmin())) * hop, start + SHORTEST), stop - SHORTEST)


def cut_longest(sections: list[Section], env: np.ndarray, hop: float) -> list[Section]:
    """Half as many sections again, rounded up, by cutting the longest that can be cut (the first on a tie)."""
    goal = (3 * len(sections) + 1) // 2
    heap = [(a - b, a, i, (a, b, x, y)) for i, (a, b, x, y) in enumerate(sections)]
    heapq.heapify(heap)
    done: list[Section] = []
    number = len(heap)
    while heap and len(heap) + len(done) < goal:
        *_, (a, b, x, y) = heapq.heappop(heap)
        at = quiet_cut(env, hop, a, b)
        if at is None:
            done.append((a, b, x, y))
            continue
        to = x + (at - a) / max(1e-6, b - a) * (y - x)
        for part in ((a, at, x, to), (at, b, to, y)):
            heapq.heappush(heap, (part[0] - part[1], part[0], number, part))
            number += 1
    return sorted([*done, *(h[-1] for h in heap)])


def join_closest(sections: list[Section]) -> list[Section]:
    """Two thirds as many sections, one less at least and one left, by joining neighbours of the smallest gap (of the least
    length together, then the first on a tie). A joined one begins where its first does and gets both targets' lengths."""
    n = len(sections)
    if n < 2:
        return sections
    left = min(max(1, int(n / 1.5)), n - 1)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(sections)
    heap: list[tuple] = []
    version = [0] * n

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n:
            (a, b, *_), (c, d, *_) = live[i], live[j]
            heapq.heappush(heap, (max(0.0, c - b), (b - a) + (d - c), i, version[i], j, version[j]))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    joined = 0
    while n - joined > left:
        _, _, i, v, j, w = heapq.heappop(heap)
        if gone[i] or gone[j] or version[i] != v or version[j] != w or after[i] != j:
            continue
        (a, b, x, y), (c, d, z, u) = live[i], live[j]
        start = x if a <= c else z
        live[i] = (min(a, c), max(b, d), start, start + (y - x) + (u - z))
        gone[j], version[i], after[i] = True, version[i] + 1, after[j]
        if after[j] < n:
            before[after[j]] = i
        joined += 1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s, g in zip(live, gone, strict=True) if not g]


def solved(rows: DataFrame, k: str, work: Callable[[list[Section], pa.Scalar], list[Section]]) -> DataFrame:
    """k, SPAN of what ``work`` makes of a row's sections (_s) and envelope (_e)."""

    def run(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
        out = [[dict(zip(SPAN, s, strict=True)) for s in work([tuple(x[n] for n in SPAN) for x in own], env)] for own, env in zip(c["_s"].to_pylist(), c["_e"], strict=True)]
        return {"made": pa.array(out, pa.list_(pa.struct([(n, pa.float64()) for n in SPAN])))}

    made = mapped(rows, [k], run, "made array<struct<" + ",".join(f"{n}:double" for n in SPAN) + ">>")
    return made.select(k, F.explode("made").alias("_m")).select(k, "_m.*")


def gathered(sections: DataFrame, k: str) -> DataFrame:
    return bounded(sections).groupBy(k).agg(F.sort_array(F.collect_list(F.struct(*(F.col(n).cast("double").alias(n) for n in SPAN)))).alias("_s"))


def more_sections(sections: DataFrame, env: DataFrame, k: str, hop: float) -> DataFrame:
    """k, SPAN: half as many sections again, rounded up, by cut_longest(); fewer where no section can be cut any more. env:
    the source's envelope in blocks (k, b, y), ``hop`` seconds a sample; without one, sections are cut in the middle."""
    whole = env.groupBy(k).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("b", "y"))), lambda x: x["y"])).alias("_e"))
    rows = matched(gathered(sections, k), whole, [k], "left")
    return solved(rows, k, lambda own, e: cut_longest(own, e.values.to_numpy(zero_copy_only=False) if e.is_valid else np.zeros(0), hop))


def fewer_sections(sections: DataFrame, k: str) -> DataFrame:
    """k, SPAN: two thirds as many sections by join_closest(); a single one stays."""
    return solved(gathered(sections, k).withColumn("_e", F.lit(None).cast("array<double>")), k, lambda own, _: join_closest(own))
