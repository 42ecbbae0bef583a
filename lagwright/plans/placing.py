"""Queries of excerpts in their reference, of refined lags and of several features' evidence, each with its SQL. Groups of users make dense envelopes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..operators import beats, correlate, matching
from ..sources.tables import series as events
from .alignment import WINDOWS
from .registry import query

# Envelopes of 24 hours a block by group and kind, and the excerpt: blocks 8 to 13 of the clicks, from 0 on.
BLOCKS = "en AS (SELECT k % 5 AS g, kind, floor(t / 24)::BIGINT AS b, sqrt(avg(v * v)) AS v FROM ev WHERE kind IN ('view', 'click', 'purchase') GROUP BY 1, 2, 3), ex AS (SELECT g, b - 8 AS b, v FROM en WHERE kind = 'click' AND b BETWEEN 8 AND 13)"


def places_sql(kind: str, name: str) -> str:
    """SQL of best_place over local_scores against the envelopes of one kind."""
    return f"""m{name} AS (SELECT g, avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS e FROM ex GROUP BY g),
j{name} AS (SELECT ex.g, lag, sum((ex.v - m) * r.v) AS x, sum(r.v * r.v) AS w, count(*) AS c, any_value(n) AS n, any_value(e) AS e FROM ex JOIN m{name} USING (g), range(0, 21) l(lag), en r WHERE r.kind = '{kind}' AND r.g = ex.g AND r.b = ex.b + lag GROUP BY 1, 2),
l{name} AS (SELECT g, lag, round(greatest(-1, least(1, coalesce(x / nullif(sqrt(w * e), 0), 0))), 9) AS score FROM j{name} WHERE c = n AND w >= greatest(1e-6, e * 1e-4)),
t{name} AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, lag) AS r FROM l{name}),
{name} AS (SELECT t.g, t.lag, t.score, CASE WHEN max(o.score) IS NULL THEN 99 ELSE t.score / (max(o.score) + 1e-9) END AS ratio FROM t{name} t LEFT JOIN l{name} o ON o.g = t.g AND abs(o.lag - t.lag) >= 3 WHERE t.r = 1 GROUP BY 1, 2, 3)"""


def blocks(spark, sf_dir, kind):
    ev = events(spark, sf_dir).where(F.col("kind") == kind)
    return ev.groupBy((F.col("k") % 5).alias("g"), F.floor(F.col("t") / 24).alias("b")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("v"))


def places(spark, sf_dir, kind):
    excerpt = blocks(spark, sf_dir, "click").where("b between 8 and 13").withColumn("b", F.col("b") - 8)
    scores = matching.local_scores(blocks(spark, sf_dir, kind), excerpt, "g", "b", "v", 20).withColumn("score", F.round("score", 9))
    return matching.best_place(scores, "g", 3)


@query("WITH {ev}, " + BLOCKS + ", " + places_sql("view", "wv") + " SELECT g, lag::INT AS lag, round(score, 5) AS score, round(ratio, 5) AS ratio FROM wv", digits=5)
def excerpt_place(spark, sf_dir):
    return places(spark, sf_dir, "view")


@query("WITH {ev}, " + BLOCKS + ", " + places_sql("view", "wv") + ", " + places_sql("purchase", "ch") + """, w AS (SELECT *, score >= 0.15 AS sure FROM wv)
SELECT coalesce(w.g, ch.g) AS g, coalesce(CASE WHEN sure THEN w.lag ELSE ch.lag END, 0)::INT AS lag, round(coalesce(CASE WHEN sure THEN w.score ELSE ch.score END, 0), 5) AS score, round(coalesce(CASE WHEN sure THEN w.ratio ELSE ch.ratio END, 0), 5) AS ratio, CASE WHEN sure THEN 'wave' ELSE 'chroma' END AS kind FROM w FULL JOIN ch ON w.g = ch.g""", digits=5)
def preferred_place(spark, sf_dir):
    return matching.preferred(places(spark, sf_dir, "view"), places(spark, sf_dir, "purchase"), "g")


@query("""WITH {ev}, s AS (SELECT k, min(t) FILTER (kind = 'view') AS a, min(t) FILTER (kind = 'click') AS b, CASE WHEN k % 3 = 0 THEN avg(v) - 50 END AS body FROM ev GROUP BY k), c AS (SELECT k, coalesce(body, a - b) AS c FROM s)
SELECT k, round(CASE WHEN abs(c) > 6.25 AND abs(c) <= 60 THEN c ELSE 0 END, 6) AS pad FROM c""")
def front_pads(spark, sf_dir):
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("t")))
    s = events(spark, sf_dir).groupBy("k").agg(first("view").alias("a"), first("click").alias("b"), F.avg("v").alias("m"))
    body = F.when(F.col("k") % 3 == 0, F.col("m") - 50)
    return s.select("k", matching.front_pad(F.col("a"), F.col("b"), body, 6.0, 60.0).alias("pad"))


@query("WITH {ev}, " + BLOCKS + """, p AS (SELECT i, k % 5 AS g, t, v / 5 AS lag FROM ev WHERE kind = 'refund' OR kind = 'purchase'),
x AS (SELECT p.i, s, count(*) AS n, covar_pop(r.v, q.v) AS c, stddev_pop(r.v) AS a, stddev_pop(q.v) AS b FROM p, range(0, 6) j(j), range(-3, 4) s(s), en r, en q WHERE r.kind = 'view' AND r.g = p.g AND r.b = floor(t / 24 + 0.5) + j AND q.kind = 'click' AND q.g = p.g AND q.b = floor((t - lag) / 24 + 0.5) + j + s GROUP BY 1, 2),
y AS (SELECT i, s, round(c / (a * b), 9) AS score FROM x WHERE n = 6 AND a > 1e-9 AND b > 1e-9), z AS (SELECT i, (max({'v': score, 'l': -s})) AS top, max(score) FILTER (s = 0) AS own FROM y GROUP BY i)
SELECT p.i, round(lag + CASE WHEN own >= 0 AND top.v >= 0.7 AND top.v >= own + 0.2 THEN top.l * 24 ELSE 0 END, 6) AS refined FROM p LEFT JOIN z USING (i)""")
def refined_lags(spark, sf_dir):
    ev = events(spark, sf_dir).where(F.col("kind").isin("refund", "purchase"))
    points = ev.select("i", (F.col("k") % 5).alias("g"), "t", (F.col("v") / 5).alias("lag"))
    return matching.refined_lags(points, blocks(spark, sf_dir, "view"), blocks(spark, sf_dir, "click"), "g", "i", "t", "lag", "b", "v", 24.0, 6, 3).select("i", "refined")


# Windowed scores of three features, each with its key: the frames' sums, greatest values and counts.
FEATURES = WINDOWS.replace(
    "hh AS (SELECT k, kind, floor(t / 6)::BIGINT AS f, sum(v) AS v FROM ev WHERE kind IN ('click', 'view') GROUP BY 1, 2, 3)",
    "h0 AS (SELECT k % 20 AS k, kind, floor(t / 6)::BIGINT AS f, sum(v) AS onset, max(v) AS wave, count(*)::DOUBLE AS chroma FROM ev WHERE kind IN ('click', 'view') GROUP BY 1, 2, 3), hh AS (SELECT {'k': k, 'feature': feature} AS k, kind, f, v FROM (UNPIVOT h0 ON onset, wave, chroma INTO NAME feature VALUE v))",
)


@query("WITH {ev}, " + FEATURES + """, b0 AS (SELECT k, win, lag, score FROM wn WHERE r = 1),
c0 AS (SELECT {'k': b.k.k, 'win': b.win} AS k, b.k.feature AS feature, b.lag * 0.03 AS lag, b.score AS best, coalesce(max(s.score), 0) AS second FROM b0 b LEFT JOIN sc s ON s.k = b.k AND s.win = b.win AND abs(s.lag - b.lag) >= 2 GROUP BY ALL),
c1 AS (SELECT *, 0.25 * CASE feature WHEN 'onset' THEN 0.45 WHEN 'wave' THEN 1.2 ELSE 1.45 END AS w0 FROM c0 WHERE best > 0.02),
c AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY k) AS w, greatest(w0 / sum(w0) OVER (PARTITION BY k) * best, 1e-6) AS x FROM c1),
g AS (SELECT *, sum(CASE WHEN step > 0.04 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lag, best, second, w) AS cl FROM (SELECT *, lag - lag(lag) OVER (PARTITION BY k ORDER BY lag, best, second, w) AS step FROM c)),
a AS (SELECT k, cl, sum(x) AS x, sum(x * lag) / sum(x) AS lag, sum(x * best) / sum(x) AS score, sum(x * second) / sum(x) AS second FROM g GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x DESC, cl) AS rn FROM a),
o AS (SELECT k, max(lag) FILTER (rn = 1) AS fl, max(score) FILTER (rn = 1) AS fs, greatest(coalesce(max(score) FILTER (rn = 2), 0), max(second) FILTER (rn = 1)) AS ss FROM q GROUP BY k)
SELECT k.k AS k, k.win AS win, round(fl, 5) AS fused_lag, round(fs, 5) AS fused_score, round(ss, 5) AS second_score, round(greatest(0, fs - ss), 5) AS margin FROM o""", digits=5)
def windowed_evidence(spark, sf_dir):
    frames = events(spark, sf_dir).where(F.col("kind").isin("click", "view")).groupBy((F.col("k") % 20).alias("k"), "kind", F.floor(F.col("t") / 6).alias("f"))
    wide = frames.agg(F.sum("v").alias("onset"), F.max("v").alias("wave"), F.count("*").cast("double").alias("chroma"))
    long = wide.unpivot(["k", "kind", "f"], ["onset", "wave", "chroma"], "feature", "v")
    of = lambda kind: long.where(F.col("kind") == kind)
    scores = correlate.window_scores(of("view"), of("click"), ["k", "feature"], "f", "v", 6, 40, 20, 6, 1.0).withColumn("score", F.round("score", 9))
    return correlate.evidence(scores, "k", "feature", correlate.context_weight(F.col("feature"), F.lit(Decimal("0.25")), F.lit(False)), 2, 0.03)


# Candidates of FEATURES, lags in hours, their windows' middles, and what their onsets say of them on the beats.
BEATEN = FEATURES + """, b0 AS (SELECT k, win, lag, score FROM wn WHERE r = 1),
c0 AS (SELECT b.k.k AS k, b.win AS win, b.k.feature AS feature, b.lag * 6.0 AS lag, (b.win * 20 + 20) * 6.0 AS mid, b.score AS best, coalesce(max(s.score), 0) AS second, 0.25 * CASE b.k.feature WHEN 'onset' THEN 0.45 WHEN 'wave' THEN 1.2 ELSE 1.45 END AS w0 FROM b0 b LEFT JOIN sc s ON s.k = b.k AND s.win = b.win AND abs(s.lag - b.lag) >= 2 GROUP BY ALL),
onset AS (SELECT k % 20 AS k, t FROM ev WHERE kind = 'purchase' AND k % 7 < 5), beat AS (SELECT k % 20 AS k, t FROM ev WHERE kind = 'click' AND k % 20 < 18), down AS (SELECT k % 20 AS k, t FROM ev WHERE kind = 'signup' AND k % 2 = 0),
hit AS (SELECT c0.k, win, feature, onset.t + lag AS t FROM c0 JOIN onset ON onset.k = c0.k AND abs(onset.t - mid) <= 9),
lone AS (SELECT c0.k, win, feature, onset.t + lag AS t FROM c0 ANTI JOIN hit USING (k, win, feature) JOIN onset ON onset.k = c0.k),
mv AS (SELECT * FROM hit UNION ALL SELECT * FROM lone), pc AS (SELECT DISTINCT k, t FROM mv),
gp AS (SELECT pc.k, pc.t, b.t - lag(b.t) OVER (PARTITION BY pc.k, pc.t ORDER BY b.t) AS g FROM pc JOIN beat b ON b.k = pc.k AND abs(b.t - pc.t) <= 40),
own AS (SELECT k, t, CASE WHEN count(*) >= 3 THEN quantile_cont(g, 0.5) FILTER (g > 0.2 AND g < 40) END AS p FROM gp GROUP BY 1, 2),
usual AS (SELECT k, quantile_cont(g, 0.5) FILTER (g > 0.2 AND g < 40) AS p FROM (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS g FROM beat) GROUP BY k),
pd AS (SELECT pc.k, pc.t, coalesce(own.p, usual.p, 0) AS p FROM pc LEFT JOIN own ON own.k = pc.k AND own.t = pc.t LEFT JOIN usual ON usual.k = pc.k),
nb AS (SELECT q.*, CASE WHEN n.t IS NULL OR q.t - p.t <= n.t - q.t THEN p.t ELSE n.t END AS b FROM (SELECT k, t, p AS period FROM pd WHERE p > 0.05) q ASOF LEFT JOIN beat p ON q.k = p.k AND q.t >= p.t ASOF LEFT JOIN beat n ON q.k = n.k AND q.t <= n.t),
nd AS (SELECT q.*, CASE WHEN n.t IS NULL OR q.t - p.t <= n.t - q.t THEN p.t ELSE n.t END AS d FROM nb q ASOF LEFT JOIN down p ON q.k = p.k AND q.t >= p.t ASOF LEFT JOIN down n ON q.k = n.k AND q.t <= n.t WHERE q.b IS NOT NULL),
vl AS (SELECT k, t, CASE WHEN abs(t - d) <= 0.5 * period THEN 2.0 ELSE 1.0 END AS w, CASE WHEN abs(t - d) <= 0.5 * period THEN 0.4 * greatest(0, 1 - abs(t - b) / (0.35 * period)) + 0.6 * greatest(0, 1 - abs(t - d) / (1.4 * period)) ELSE greatest(0, 1 - abs(t - b) / (0.35 * period)) END AS v FROM nd),
bs AS (SELECT k, win, feature, sum(v * w) / sum(w) AS beat FROM mv JOIN vl USING (k, t) GROUP BY 1, 2, 3),
cb AS (SELECT c0.*, coalesce(bs.beat, 0) AS beat FROM c0 LEFT JOIN bs USING (k, win, feature))"""


def beaten(spark, sf_dir):
    """Candidates k, win, feature, lag, at, best, second, w, beat, as BEATEN has them."""
    ev = events(spark, sf_dir)
    frames = ev.where(F.col("kind").isin("click", "view")).groupBy((F.col("k") % 20).alias("k"), "kind", F.floor(F.col("t") / 6).alias("f"))
    wide = frames.agg(F.sum("v").alias("onset"), F.max("v").alias("wave"), F.count("*").cast("double").alias("chroma"))
    long = wide.unpivot(["k", "kind", "f"], ["onset", "wave", "chroma"], "feature", "v")
    scores = correlate.window_scores(long.where("kind = 'view'"), long.where("kind = 'click'"), ["k", "feature"], "f", "v", 6, 40, 20, 6, 1.0).withColumn("score", F.round("score", 9))
    best = correlate.best_and_second(scores, ["k", "feature", "win"], "lag", "score", 2)
    weight = correlate.context_weight(F.col("feature"), F.lit(0.25), F.lit(False))
    points = best.select("k", "win", "feature", (F.col("best_lag") * 6.0).alias("lag"), ((F.col("win") * 20 + 20) * 6.0).alias("at"), "best", "second", weight.alias("w"))
    times = lambda kind, some: ev.where((F.col("kind") == kind) & some).select((F.col("k") % 20).alias("k"), "t")
    onsets, grid, downs = times("purchase", F.col("k") % 7 < 5), times("click", F.col("k") % 20 < 18), times("signup", F.col("k") % 2 == 0)
    return beats.beat_scores(points, onsets, grid, downs, "k", ["win", "feature"], "at", "lag", 9.0, 40.0, 0.2, 40.0)


@query("WITH {ev}, " + BEATEN + " SELECT k, win, feature, round(lag, 6) AS lag, round(beat, 5) AS beat FROM cb", digits=5)
def beat_evidence(spark, sf_dir):
    return beaten(spark, sf_dir).select("k", "win", "feature", "lag", "beat")


@query("WITH {ev}, " + BEATEN + """, c1 AS (SELECT {'k': k, 'win': win} AS k, lag, best, second, w0 * (1 + 0.35 * beat) AS w0 FROM cb WHERE best > 0.02),
c AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY k) AS w, greatest(w0 / sum(w0) OVER (PARTITION BY k) * best, 1e-6) AS x FROM c1),
g AS (SELECT *, sum(CASE WHEN step > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lag, best, second, w) AS cl FROM (SELECT *, lag - lag(lag) OVER (PARTITION BY k ORDER BY lag, best, second, w) AS step FROM c)),
a AS (SELECT k, cl, sum(x) AS x, sum(x * lag) / sum(x) AS lag, sum(x * best) / sum(x) AS score, sum(x * second) / sum(x) AS second FROM g GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x DESC, cl) AS rn FROM a),
o AS (SELECT k, max(lag) FILTER (rn = 1) AS fl, max(score) FILTER (rn = 1) AS fs, greatest(coalesce(max(score) FILTER (rn = 2), 0), max(second) FILTER (rn = 1)) AS ss FROM q GROUP BY k)
SELECT k.k AS k, k.win AS win, round(fl, 5) AS fused_lag, round(fs, 5) AS fused_score, round(greatest(0, fs - ss), 5) AS margin FROM o""", digits=5)
def beaten_lags(spark, sf_dir):
    c = beats.with_beat_bonus(beaten(spark, sf_dir), "w").select(F.struct("k", "win").alias("_at"), "lag", "best", "second", "w")
    return correlate.fuse(c, "_at", 8.0).select("_at.k", "_at.win", "fused_lag", "fused_score", "margin")
