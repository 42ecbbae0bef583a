"""Verdicts: grades, failure codes, gates, their combination and their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grade(ms: Column) -> Column:
    """The band of an offset in ms; bounds belong to the better one."""
    size = F.abs(ms)
    return F.when(size <= 3, "excellent").when(size <= 5, "good").when(size <= 10, "acceptable").when(size <= 20, "suspect").otherwise("bad")


def failure_codes(reports: DataFrame, k: str, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """k, code, value: a row for each limit (code: column, bound) that |column| reaches. One scan, no union."""
    cases = [F.when(F.abs(c) >= bound, F.struct(F.lit(code).alias("code"), F.abs(F.col(c)).cast("double").alias("value"))) for code, (c, bound) in limits.items()]
    return reports.select(k, F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("_c")).select(k, "_c.code", "_c.value")


def offset_gate(points: DataFrame, coarse: DataFrame, k: str, limit: float, coarse_limit: float) -> DataFrame:
    """k, n, worst, verdict. points: k, lag, railed; coarse: k, coarse_lag. With checkpoints, any railed one or one beyond
    ``limit`` fails and clean ones pass, whatever the coarse lag; without, the coarse lag decides."""
    worst = points.groupBy(k).agg(F.count("*").alias("n"), F.max(F.abs("lag")).alias("worst"), F.max(F.col("railed").cast("int")).alias("_railed"))
    both = coarse.join(worst, k, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_points = F.when((F.col("worst") > limit) | (F.col("_railed") == 1), "fail").otherwise("pass")
    verdict = F.when(F.col("n") > 0, by_points).when(F.abs("coarse_lag") > coarse_limit, "fail").otherwise("pass")
    return both.select(k, "n", "worst", verdict.alias("verdict"))


def combined(*verdicts: Column) -> Column:
    """fail if one fails, pass if all pass, else error."""
    fails = reduce(lambda a, b: a | b, (F.coalesce(v == "fail", F.lit(False)) for v in verdicts))
    passes = reduce(lambda a, b: a & b, (F.coalesce(v == "pass", F.lit(False)) for v in verdicts))
    return F.when(fails, "fail").when(passes, "pass").otherwise("error")


def compensating(vocal: Column, instrumental: Column, mix: Column, lag_v: Column, lag_i: Column, least: float = 0.005) -> Column:
    """Both stems pass and the mix fails, with opposite lags of ``least`` or more each."""
    return F.coalesce((vocal == "pass") & (instrumental == "pass") & (mix == "fail") & (lag_v * lag_i < 0) & (F.least(F.abs(lag_v), F.abs(lag_i)) >= least), F.lit(False))


def clock(seconds: Column) -> Column:
    """m:ss, rounded half to even."""
    s = F.bround(F.greatest(seconds, F.lit(0.0))).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def drift_ranges(points: DataFrame, k: str, t: str, lag: str, limit: float, margin: float = 4.0) -> DataFrame:
    """k, text: runs of checkpoints beyond ``limit`` in a row and on one side, as clock ranges with least and most lag."""
    w = Window.partitionBy(k).orderBy(t)
    side = F.when(F.abs(lag) > limit, F.signum(lag)).otherwise(0.0)
    d = points.withColumn("_s", side).withColumn("_new", (F.lag("_s").over(w).isNull() | (F.lag("_s").over(w) != F.col("_s"))).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(w)).where("_s <> 0")
    runs = d.groupBy(k, "_run").agg(F.min(t).alias("a"), F.max(t).alias("b"), F.min(lag).alias("lo"), F.max(lag).alias("hi"))
    one = F.concat(clock(F.col("a") - margin), F.lit("-"), clock(F.col("b") + margin), F.lit(" "), F.bround("lo").cast("bigint").cast("string"), F.lit(".."), F.bround("hi").cast("bigint").cast("string"))
    rows = F.sort_array(F.collect_list(F.struct("_run", one.alias("x"))))
    return runs.groupBy(k).agg(F.array_join(F.transform(rows, lambda r: r["x"]), ", ").alias("text"))


def combine_reports(a: DataFrame, b: DataFrame, k: str, least: list[str], greatest: list[str], summed: list[str]) -> DataFrame:
    """Two stems' reports in one row for each key: the lower of some columns, the higher or the sum of others; a side that
    is missing doesn't count."""
    x, y = (d.select(k, *(F.col(c).alias(f"{s}_{c}") for c in [*least, *greatest, *summed])) for s, d in (("a", a), ("b", b)))
    both = x.join(y, k, "full_outer")
    ends = [F.least(f"a_{c}", f"b_{c}").alias(c) for c in least] + [F.greatest(f"a_{c}", f"b_{c}").alias(c) for c in greatest]
    return both.select(k, *ends, *((F.coalesce(f"a_{c}", F.lit(0)) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in summed))


def upsert(old: DataFrame, new: DataFrame, k: str, columns: list[str]) -> DataFrame:
    """old with new's rows put in; a null in new keeps the old value."""
    x, y = (d.select(k, *(F.col(c).alias(f"{s}_{c}") for c in columns)) for s, d in (("o", old), ("n", new)))
    return x.join(y, k, "full_outer").select(k, *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in columns))


def accuracy(rows: DataFrame, tag: str, verdict: str) -> DataFrame:
    """total, failed, accuracy over rows that have a result; a folder's tag overrides the verdict."""
    result = F.coalesce(tag, verdict)
    out = rows.agg(F.count_if(result.isin("pass", "fail")).alias("total"), F.count_if(result == "fail").alias("failed"))
    return out.withColumn("accuracy", (F.col("total") - F.col("failed")) / F.when(F.col("total") > 0, F.col("total")))


def drift_span(points: DataFrame, k: str, t: str, lag: str, railed: str, limit: float, margin: float = 4.0) -> DataFrame:
    """k, start, stop around all checkpoints beyond ``limit`` or railed; not before 0."""
    bad = points.where((F.abs(lag) > limit) | F.col(railed))
    return bad.groupBy(k).agg(F.greatest(F.min(t) - margin, F.lit(0.0)).alias("start"), (F.max(t) + margin).alias("stop"))


def match_folders(stored: DataFrame, index: DataFrame, stem: str, tag: str) -> DataFrame:
    """stored with n (candidates of the same stem) and found: the only tagged one, else the only one, else null.

    index: stem, folder, tag. It is reduced to a row a stem before the join, so that common stems don't multiply.
    """
    tagged = F.col(tag).isNotNull()
    one = index.groupBy(stem).agg(
        F.count("*").alias("n"),
        F.when(F.count_if(tagged) == 1, F.max(F.when(tagged, F.col("folder")))).when(F.count("*") == 1, F.max("folder")).alias("found"),
    )
    return stored.join(one, stem, "left").withColumn("n", F.coalesce("n", F.lit(0)))


# Fixed values of the codes: offset in seconds, drift in ms a minute, step in seconds, margin of the best match, share of weak
# points, confidence and margin of a placed unit, and how many units are named.
OFFSET, DRIFT, STEP, MARGIN, WEAK, UNIT_CONFIDENCE, UNIT_MARGIN, UNITS = 0.05, 30.0, 0.04, 0.08, 0.35, 0.20, 0.05, 8


def failures(report: DataFrame, jumps: DataFrame, points: DataFrame, units: DataFrame, k: str, limits: dict[str, float] | None = None) -> DataFrame:
    """k, code, time, value, detail: what is doubtful about an alignment, even if it passes.

    report (k, offset, drift, weak): OFFSET_TOO_LARGE, TEMPO_DRIFT and LOW_SIGNAL at time 0. jumps (k, t, size):
    LOCAL_DISCONTINUITY at each. points (k, t, margin): AMBIGUOUS_MATCH at the smallest margin of a key, the first on a tie,
    if that is too small. units (k, dst_a, confidence, margin): GAP_RESTORATION_UNCERTAIN at the first eight of a key, by
    dst_a, of which either is too small. Nulls fail no test but a unit's, where they count as 0; null times come last. limits: other bounds by the
    names offset, drift, step, margin, weak, unit_confidence, unit_margin.
    """
    bound = {"offset": OFFSET, "drift": DRIFT, "step": STEP, "margin": MARGIN, "weak": WEAK, "unit_confidence": UNIT_CONFIDENCE, "unit_margin": UNIT_MARGIN} | (limits or {})
    one = lambda code, hit, time, value, form, shown: F.when(hit, F.struct(F.lit(code).alias("code"), time.cast("double").alias("time"), value.cast("double").alias("value"), F.format_string(form, shown.cast("double")).alias("detail")))
    zero = F.lit(0.0)
    whole = [
        one("OFFSET_TOO_LARGE", F.abs("offset") >= bound["offset"], zero, F.col("offset"), "offset %+.3fs", F.col("offset")),
        one("TEMPO_DRIFT", F.abs("drift") >= bound["drift"], zero, F.col("drift"), "drift %+.1f ms/min", F.col("drift")),
        one("LOW_SIGNAL", F.col("weak") >= bound["weak"], zero, F.col("weak"), "weak %.0f%%", 100 * F.col("weak")),
    ]
    told = lambda df, cases: df.select(k, F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("_f")).select(k, "_f.*")
    steps = told(jumps, [one("LOCAL_DISCONTINUITY", F.abs("size") >= bound["step"], F.col("t"), F.col("size"), "%.0f ms", 1000 * F.col("size"))])
    least = points.where("margin is not null").groupBy(k).agg(F.min(F.struct("margin", F.col("t").isNull(), "t")).alias("m")).select(k, "m.*")
    doubt = told(least, [one("AMBIGUOUS_MATCH", F.col("margin") < bound["margin"], F.col("t"), F.col("margin"), "margin %.3f", F.col("margin"))])
    sure = (F.coalesce("confidence", zero) >= bound["unit_confidence"]) & (F.coalesce("margin", zero) >= bound["unit_margin"])
    first = units.where(~sure).withColumn("_n", F.row_number().over(Window.partitionBy(k).orderBy(F.col("dst_a").asc_nulls_last(), "confidence"))).where(F.col("_n") <= UNITS)
    gaps = told(first, [one("GAP_RESTORATION_UNCERTAIN", F.lit(True), F.col("dst_a"), F.coalesce("confidence", zero), "conf %.2f", F.coalesce("confidence", zero))])
    return told(report, whole).unionByName(steps).unionByName(doubt).unionByName(gaps)
