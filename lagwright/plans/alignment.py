"""More queries: signals, time maps, placement, windowed correlation, texts and listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import naming, text
from ..operators import beats, correlate, placement, quality, robust, series, signals, timemap
from ..sources import files
from ..sources.tables import day_spans, series as events, table
from .catalogue import checkpoints, conf, of_kind
from .registry import query

# Joins in SQL of q (k, t, ...) with kn (k, t, v): linear between the neighbours, and the nearer of them.
INTERP = "ip AS (SELECT q.*, CASE WHEN p.t IS NULL THEN n.v WHEN n.t IS NULL OR n.t = p.t THEN p.v ELSE p.v + (n.v - p.v) * (q.t - p.t) / (n.t - p.t) END AS interp FROM q ASOF LEFT JOIN kn p ON q.k = p.k AND q.t >= p.t ASOF LEFT JOIN kn n ON q.k = n.k AND q.t <= n.t)"
NEAREST = "nr AS (SELECT q.*, CASE WHEN n.t IS NULL OR q.t - p.t <= n.t - q.t THEN p.t ELSE n.t END AS near FROM q ASOF LEFT JOIN kn p ON q.k = p.k AND q.t >= p.t ASOF LEFT JOIN kn n ON q.k = n.k AND q.t <= n.t)"
VIEWS = "kn AS (SELECT k, t, v / 100 AS v FROM ev WHERE kind = 'view')"


def views(spark, sf_dir):
    return of_kind(spark, sf_dir, "view").select("k", "t", (F.col("v") / 100).alias("v"))


@query("SELECT vec_id, len(y) AS n, round(list_sum(y), 3) AS total FROM (SELECT vec_id, list_resize(embedding::DOUBLE[], vec_id % 80, 0.0) AS y FROM embeddings)", digits=3)
def fit_lengths(spark, sf_dir):
    y = signals.fit_length(F.col("embedding").cast("array<double>"), (F.col("vec_id") % 80).cast("int"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", y.alias("y"))
    return d.select("vec_id", F.size("y").cast("bigint").alias("n"), F.when(F.size("y") > 0, F.aggregate("y", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("SELECT vec_id, unnest(range(len(embedding))) AS j, round(unnest(list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda z: (z::DOUBLE) * z))), 1e-9))), 6) AS unit FROM embeddings")
def l2_coordinates(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"), F.greatest(norm, F.lit(1e-9)).alias("n"))
    return d.select("vec_id", "n", F.posexplode("e").alias("j", "x")).select("vec_id", F.col("j").cast("bigint").alias("j"), (F.col("x").cast("double") / F.col("n")).alias("unit"))


@query("WITH {ev} SELECT i, round(t - 100, 6) AS t FROM ev WHERE t - 100 >= 0")
def shifted_front(spark, sf_dir):
    return signals.shifted(events(spark, sf_dir).select("i", "t"), "t", F.lit(-100.0))


@query("WITH {ev} SELECT i FROM (SELECT i, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS j FROM ev) WHERE j % 4 = 0")
def decimated(spark, sf_dir):
    return signals.decimated(events(spark, sf_dir), "k", ["t"], 4).select("i")


@query("WITH {ev}, n AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS j, count(*) OVER (PARTITION BY k) AS n FROM ev) SELECT k, f AS frame, round(sqrt(avg(v * v)), 6) AS rms FROM (SELECT *, unnest(range(0, (n - 8) // 4 + 1)) AS f FROM n) WHERE j >= f * 4 AND j < f * 4 + 8 GROUP BY k, f")
def frame_rms(spark, sf_dir):
    return signals.frame_rms(events(spark, sf_dir), "k", ["t"], "v", 8, 4)


GAIN = "g AS (SELECT k, 0.2 + (k % 5) / 4.0 AS gain FROM ev GROUP BY k)"


@query("WITH {ev}, " + GAIN + ", x AS (SELECT i, k, gain, v / 100 * CASE WHEN abs(gain - 1) < 1e-3 THEN 1 ELSE gain END AS y FROM ev JOIN g USING (k)), m AS (SELECT *, max(abs(y)) OVER (PARTITION BY k) AS top FROM x) SELECT i, round(CASE WHEN abs(gain - 1) >= 1e-3 AND top > 0.99 THEN y * 0.99 / top ELSE y END, 6) AS v, round(20 * log10(greatest(gain, 1e-9)), 6) AS gain_db FROM m")
def gain_with_peak(spark, sf_dir):
    d = events(spark, sf_dir).select("i", "k", (F.col("v") / 100).alias("v"))
    return signals.with_gain(d, "k", "v", 0.2 + (F.col("k") % 5) / 4.0).select("i", "v", "gain_db")


@query("""WITH {ev}, n AS (SELECT i, v, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS j, count(*) OVER (PARTITION BY k) AS n FROM ev), f AS (SELECT *, least(10, n // 4) AS f, least(6, n // 4) AS a, least(15, n // 3) AS b FROM n)
SELECT i, round(v * CASE WHEN f < 2 THEN 1 ELSE least(1.0, j / (f - 1)) * least(1.0, (n - 1 - j) / (f - 1)) END, 6) AS linear,
round(v * CASE WHEN j < a THEN 0.5 - 0.5 * cos(j * pi() / (a - 1)) ELSE 1 END * CASE WHEN n - 1 - j < b THEN 0.5 - 0.5 * cos((n - 1 - j) * pi() / (b - 1)) ELSE 1 END, 6) AS cosine FROM f""")
def fades(spark, sf_dir):
    d = events(spark, sf_dir).select("i", "k", "t", F.col("v").alias("linear"), F.col("v").alias("cosine"))
    return signals.edge_faded(signals.faded(d, "k", ["t"], "linear", 10), "k", ["t"], "cosine", 6, 15).select("i", "linear", "cosine")


@query("WITH {ev}, p AS (SELECT k, floor(t / 48)::BIGINT AS win, quantile_cont(v, 0.9) AS p90 FROM ev GROUP BY 1, 2), l AS (SELECT k, greatest(1e-3, 0.9 * quantile_cont(v, 0.95)) AS f FROM ev GROUP BY k) SELECT k, win, round(p90, 6) AS p90 FROM p JOIN l USING (k) WHERE p90 >= f")
def audible_windows(spark, sf_dir):
    return signals.audible_windows(events(spark, sf_dir).withColumn("win", F.floor(F.col("t") / 48)), "k", "win", "v", 0.9)


@query("""WITH {ev}, l AS (SELECT k, greatest(0.85 * quantile_cont(v, 0.5), 1e-5) AS l FROM ev GROUP BY k), d AS (SELECT k, avg((v > l)::INT) AS duty, count(*) FILTER (kind = 'click') / 5.0 AS density, (k % 10) / 20.0 AS flatness FROM ev JOIN l USING (k) GROUP BY k)
SELECT k, round(duty, 6) AS duty, CASE WHEN density >= 2.8 AND flatness >= 0.04 THEN 'edm' WHEN duty < 0.38 THEN 'sparse_vocal' WHEN density < 1.4 AND flatness < 0.25 THEN 'acoustic' ELSE 'default' END AS kind FROM d""")
def track_class(spark, sf_dir):
    ev = events(spark, sf_dir)
    d = signals.duty_cycle(ev, "k", "v").join(ev.groupBy("k").agg((F.count_if(F.col("kind") == "click") / 5.0).alias("density")), "k").withColumn("flatness", (F.col("k") % 10) / 20.0)
    return signals.track_class(d, "k", "density", "duty", "flatness").select("k", "duty", "kind")


#: Presets by name: window, step and largest lag in seconds.
PROFILES = [("default", 8.0, 2.0, 0.5), ("edm", 6.0, 1.5, 0.35), ("acoustic", 10.0, 2.5, 0.75)]


@query("""WITH p(name, win, step, reach) AS (VALUES ('default', 8.0, 2.0, 0.5), ('edm', 6.0, 1.5, 0.35), ('acoustic', 10.0, 2.5, 0.75)), t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'edm' WHEN 1 THEN 'acoustic' WHEN 2 THEN 'unheard' END AS want, CASE WHEN c_custkey % 3 = 0 THEN 7.0 END AS own FROM customer)
SELECT id, coalesce(p.name, 'default') AS profile, coalesce(own, p.win, d.win)::DOUBLE AS win, coalesce(p.step, d.step)::DOUBLE AS step, coalesce(p.reach, d.reach)::DOUBLE AS reach FROM t LEFT JOIN p ON p.name = want CROSS JOIN (SELECT * FROM p WHERE name = 'default') d""")
def track_profiles(spark, sf_dir):
    key = F.col("c_custkey")
    none = F.lit(None).cast("double")
    tracks = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 4 == 0, "edm").when(key % 4 == 1, "acoustic").when(key % 4 == 2, "unheard").alias("want"), F.when(key % 3 == 0, 7.0).alias("win"), none.alias("step"), none.alias("reach"))
    presets = spark.createDataFrame(PROFILES, "name string, win double, step double, reach double")
    return signals.profiled(tracks, presets, "want", ["win", "step", "reach"]).select("id", "profile", "win", "step", "reach")


@query("WITH {ev} SELECT floor(t)::BIGINT AS at, k % 10 AS k, round(greatest(-100, least(100, sum(v))), 6) AS mix FROM ev GROUP BY 1, 2")
def additive_mix(spark, sf_dir):
    d = events(spark, sf_dir).select((F.col("k") % 10).alias("k"), F.floor("t").alias("at"), "v")
    return signals.mixed(d, "k", "at", "v", 100.0)


BARS = """db AS (SELECT k, t, row_number() OVER w - 1 AS j, t - lag(t) OVER w AS g FROM ev WHERE t < 700 - 1 WINDOW w AS (PARTITION BY k ORDER BY t)), fit AS (SELECT k, 8 * quantile_cont(g, 0.5) FILTER (g > 0.2) AS span FROM db GROUP BY k HAVING count(*) > 8 AND count(*) FILTER (g > 0.2) >= 4),
bar AS (SELECT k, t, span FROM db JOIN fit USING (k) WHERE j > 0 AND j % 8 = 0 AND t > 1 AND t < 700 - span / 2)"""


def some_downbeats(spark, sf_dir, share):
    return events(spark, sf_dir).where(F.col("k") % share != 0)


@query("WITH {ev}, " + BARS + " SELECT k, round(t, 6) AS mark, round(span, 6) AS span FROM bar")
def bar_ruler(spark, sf_dir):
    return timemap.bar_ruler(events(spark, sf_dir), "k", "t", 700.0)


@query("WITH {ev}, " + BARS.replace("WHERE t < 700 - 1", "WHERE t < 700 - 1 AND k % 3 <> 0") + " SELECT k, round(t, 6) AS mark, 'lag_follow=8bars; bar_span=' || printf('%.1f', span) || 's' AS note FROM bar UNION ALL SELECT k, m * 30.0, 'lag_follow=30s' FROM (SELECT DISTINCT k FROM ev WHERE k NOT IN (SELECT k FROM bar)), range(1, 24) g(m)")
def marker_ruler(spark, sf_dir):
    return timemap.ruler(events(spark, sf_dir).select("k"), some_downbeats(spark, sf_dir, 3), "k", "t", 700.0)


@query("WITH {ev}, q AS (SELECT k, t FROM ev WHERE kind = 'click' AND t <= 700 UNION SELECT k, 0.0 FROM ev WHERE kind = 'view'), " + VIEWS + ", " + INTERP + """,
j AS (SELECT *, CASE WHEN abs(interp - lag(interp) OVER (PARTITION BY k ORDER BY t)) >= 0.04 THEN 1 ELSE 0 END AS new FROM ip WHERE interp IS NOT NULL), r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t) AS run FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY t) AS j FROM r),
s AS (SELECT k, t, max(t - interp - j * 1e-4) OVER (PARTITION BY k, run ORDER BY t ROWS UNBOUNDED PRECEDING) + j * 1e-4 AS src FROM n) SELECT k, round(t, 6) AS dst, round(src, 6) AS src FROM s WHERE src <= 690""")
def src_dst_markers(spark, sf_dir):
    return timemap.markers(views(spark, sf_dir), of_kind(spark, sf_dir, "click").select("k", F.col("t").alias("mark")), "k", "t", "v", 700.0, 690.0)


@query("WITH {ev}, " + VIEWS + ", e AS (SELECT k, min(t) AS a, max(t) AS b FROM kn GROUP BY k), q AS (SELECT k, a + 6.0 * unnest(range(0, floor((b - a) / 6)::BIGINT + 1)) AS t FROM e), " + INTERP + " SELECT k, round((min({'d': abs(t - interp - 360), 't': t})).t, 6) AS dst FROM ip GROUP BY k")
def target_of_source(spark, sf_dir):
    return timemap.target_of_source(views(spark, sf_dir), "k", "t", "v", F.lit(360.0), 6.0)


@query("WITH {ev}, " + VIEWS + ", n AS (SELECT k, 300.0 AS nt, 9.0 AS nv FROM ev GROUP BY k), h AS (SELECT k, (min({'d': abs(t - nt), 't': t})).t AS hit FROM kn JOIN n USING (k) WHERE abs(t - nt) <= 20 GROUP BY k) SELECT k, round(t, 6) AS t, round(v, 6) AS v FROM kn LEFT JOIN h USING (k) WHERE hit IS NULL OR t <> hit UNION ALL SELECT k, round(coalesce(hit, nt), 6), nv FROM n LEFT JOIN h USING (k)")
def placed_knot(spark, sf_dir):
    new = events(spark, sf_dir).select("k").distinct().select("k", F.lit(300.0).alias("t"), F.lit(9.0).alias("v"))
    return timemap.with_knot(views(spark, sf_dir), new, "k", "t", "v", 20.0)


@query("""WITH {ev}, g AS (SELECT *, sum(CASE WHEN q AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t) AS run FROM (SELECT *, v < 30 AS q, lag(v < 30) OVER w AS p, lead(t) OVER w AS nxt, min(t) OVER (PARTITION BY k) AS f FROM ev WINDOW w AS (PARTITION BY k ORDER BY t)))
SELECT k, round(min(t), 6) AS start, round(max(nxt), 6) AS stop FROM g WHERE q GROUP BY k, run, f HAVING count(*) FILTER (nxt IS NULL) = 0 AND min(t) > f AND max(nxt) - min(t) >= 5""")
def silence_runs(spark, sf_dir):
    return timemap.silence_runs(events(spark, sf_dir), "k", "t", "v", 30.0, 5.0)


@query("WITH {ev}, c AS (SELECT k, avg(v) / 10 AS pad FROM ev GROUP BY k) SELECT i, round(t - pad, 6) AS src, round(pad, 6) AS pad FROM ev JOIN c USING (k)")
def rebased_pads(spark, sf_dir):
    ev = events(spark, sf_dir)
    return timemap.rebased(ev.select("i", "k", F.col("t").alias("src")), ev.groupBy("k").agg((F.avg("v") / 10).alias("c")), "k", "src", "c").select("i", "src", "pad")


ENVELOPES = """en AS (SELECT k, kind, floor(t / 12)::BIGINT AS b, sqrt(avg(v * v)) AS v FROM ev WHERE kind IN ('view', 'click') GROUP BY 1, 2, 3),
sc AS (SELECT q.k, s AS shift, CASE WHEN count(*) < 3 OR stddev_pop(q.v) < 1e-9 OR stddev_pop(r.v) < 1e-9 THEN -1 ELSE covar_pop(q.v, r.v) / (stddev_pop(q.v) * stddev_pop(r.v)) END AS score, count(*) AS n FROM en q, range(-8, 9) g(s), en r WHERE q.kind = 'click' AND r.kind = 'view' AND r.k = q.k AND r.b = q.b + s GROUP BY 1, 2)"""


def shift_scores(spark, sf_dir):
    env = lambda kind: of_kind(spark, sf_dir, kind).groupBy("k", F.floor(F.col("t") / 12).alias("b")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("v"))
    return timemap.envelope_scores(env("view"), env("click"), "k", "b", "v", 8, 3)


@query("WITH {ev}, " + ENVELOPES + " SELECT k, shift::INT AS shift, round(score, 5) AS score, n FROM sc", digits=5)
def envelope_ncc(spark, sf_dir):
    return shift_scores(spark, sf_dir)


@query("WITH {ev}, " + ENVELOPES + """, b AS (SELECT k, shift, score, row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, shift) AS r FROM sc), o AS (SELECT k, score AS own FROM sc WHERE shift = 0)
SELECT k, shift::INT AS shift, round(score, 5) AS score FROM b LEFT JOIN o USING (k) WHERE r = 1 AND score >= 0.45 AND score >= coalesce(own, -1) + 0.15 AND abs(shift) > 2""", digits=5)
def body_offset(spark, sf_dir):
    scores = shift_scores(spark, sf_dir).withColumn("score", F.round("score", 9))
    return timemap.body_offset(scores, "k", scores.select("k").distinct().withColumn("at", F.lit(0)))


@query("WITH {ev}, e AS (SELECT k, abs(v / 100 - t / 1000) AS e FROM ev) SELECT k, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS worst FROM e GROUP BY k")
def lag_errors(spark, sf_dir):
    return timemap.lag_errors(events(spark, sf_dir).select("k", (F.col("v") / 100).alias("lag"), (F.col("t") / 1000).alias("truth")), "k", "lag", "truth")


@query("""WITH {ev}, a AS (SELECT k, t FROM ev WHERE kind = 'click'), b AS (SELECT k, t FROM ev WHERE kind = 'purchase'), x AS (SELECT k, count(*) FILTER (NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND abs(b.t - a.t) <= 4)) AS n FROM a GROUP BY k), y AS (SELECT k, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE b.k = a.k AND abs(b.t - a.t) <= 4)) AS n FROM b GROUP BY k)
SELECT coalesce(x.k, y.k) AS k, coalesce(x.n, 0) AS n_false, coalesce(y.n, 0) AS n_missed FROM x FULL JOIN y ON x.k = y.k""")
def discontinuity_counts(spark, sf_dir):
    return timemap.discontinuity_counts(of_kind(spark, sf_dir, "click"), of_kind(spark, sf_dir, "purchase"), "k", "t", 4.0)


UNITS = "un AS (SELECT k, o, l, a - 1000 AS src_a, b - 1000 AS src_b, a AS dst_a, a + (b - a) * 2 AS dst_b, l / 7.0 AS score, b - a AS len FROM sp)"


def units(spark, sf_dir):
    d = day_spans(spark, sf_dir)
    return d.select("k", "o", "l", (F.col("a") - 1000).alias("src_a"), (F.col("b") - 1000).alias("src_b"), F.col("a").alias("dst_a"), (F.col("a") + (F.col("b") - F.col("a")) * 2).alias("dst_b"), (F.col("l") / 7.0).alias("score"), (F.col("b") - F.col("a")).alias("len"))


@query("WITH {sp}, " + UNITS + ", w AS (SELECT o, dst_b + 1e-4 >= dst_a AND src_b + 1e-4 >= src_a AND coalesce(dst_a + 1e-3 >= lag(dst_b) OVER (PARTITION BY o ORDER BY l), true) AS g FROM un) SELECT o, bool_and(g) AS ordered FROM w GROUP BY o")
def spans_monotonic(spark, sf_dir):
    return timemap.spans_monotonic(units(spark, sf_dir), "o", ["l", "src_a", "src_b"])


@query("""WITH {ev}, c AS (SELECT k, t, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS g FROM ev WHERE kind = 'click'), u AS (SELECT k, quantile_cont(g, 0.5) FILTER (g > 0.2 AND g < 400) AS usual FROM c GROUP BY k), q AS (SELECT i, k, t FROM ev WHERE kind = 'purchase'),
n AS (SELECT q.k, i, b.t - lag(b.t) OVER (PARTITION BY q.i ORDER BY b.t) AS g FROM q JOIN c b ON b.k = q.k AND abs(b.t - q.t) <= 120), o AS (SELECT i, CASE WHEN count(*) >= 3 THEN quantile_cont(g, 0.5) FILTER (g > 0.2 AND g < 400) END AS own FROM n GROUP BY i)
SELECT i, round(coalesce(own, usual, 0), 6) AS period FROM q LEFT JOIN o USING (i) LEFT JOIN u USING (k)""")
def local_period(spark, sf_dir):
    return timemap.local_period(of_kind(spark, sf_dir, "purchase").select("i", "k", "t"), of_kind(spark, sf_dir, "click").select("k", "t"), "k", "t", 120.0, 0.2, 400.0).select("i", "period")


@query("""WITH {ev}, g AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) - t AS g FROM ev), u AS (SELECT k, coalesce(quantile_cont(g, 0.5) FILTER (g > 2 AND g < 20), 0.5) AS u FROM g GROUP BY k), s AS (SELECT k, t, g, CASE WHEN g > 2 AND g < 20 THEN g ELSE u END AS s FROM g JOIN u USING (k) WHERE g IS NOT NULL)
SELECT k, round(t + g / 2, 6) AS mid, round(quantile_cont(s, 0.5) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS period FROM s""")
def smooth_period(spark, sf_dir):
    d = timemap.smooth_period(events(spark, sf_dir), "k", "t", 2.0, 20.0)
    return d.select("k", "mid", "period")


@query("""WITH {ev}, bt AS (SELECT k, t FROM ev WHERE kind = 'click'), kn AS (SELECT k, t FROM ev WHERE kind = 'purchase'), q AS (SELECT i, k, v / 10 AS lag, 12.0 AS period, t - v / 10 AS t FROM ev WHERE kind = 'view'), """ + NEAREST + """,
z AS (SELECT i, k, lag, period, CASE WHEN abs(near - t) <= greatest(0.5, period) THEN near END AS ons FROM nr), q2 AS (SELECT *, ons + lag AS t FROM z WHERE ons IS NOT NULL),
r AS (SELECT q2.i, CASE WHEN n.t IS NULL OR q2.t - p.t <= n.t - q2.t THEN p.t ELSE n.t END - ons AS snap FROM q2 ASOF LEFT JOIN bt p ON q2.k = p.k AND q2.t >= p.t ASOF LEFT JOIN bt n ON q2.k = n.k AND q2.t <= n.t)
SELECT i, round(CASE WHEN abs(snap - lag) <= 0.5 * period THEN snap ELSE lag END, 6) AS safe FROM z LEFT JOIN r USING (i)""")
def safe_lags(spark, sf_dir):
    points = of_kind(spark, sf_dir, "view").select("i", "k", "t", (F.col("v") / 10).alias("lag"), F.lit(12.0).alias("period"))
    return timemap.safe_lags(points, of_kind(spark, sf_dir, "purchase"), of_kind(spark, sf_dir, "click"), "k", "t", "lag", "period").select("i", "safe")


REFINE = "pts AS (SELECT k, t, v AS lag, v > 60 AS railed FROM ev WHERE kind = 'click'), wide AS (SELECT k, t, v AS lag, v > 200 AS railed FROM ev WHERE kind = 'view')"


@query("WITH {ev}, " + REFINE + """, j AS (SELECT q.*, p.t AS pt, p.lag AS pl, p.railed AS pr, n.t AS nt, n.lag AS nl, n.railed AS nr FROM pts q ASOF LEFT JOIN wide p ON q.k = p.k AND q.t >= p.t ASOF LEFT JOIN wide n ON q.k = n.k AND q.t <= n.t),
d AS (SELECT *, pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) AS f FROM j), e AS (SELECT *, railed AND coalesce(CASE WHEN f THEN t - pt ELSE nt - t END <= 6, false) AS take FROM d)
SELECT k, round(t, 6) AS t, round(CASE WHEN take THEN CASE WHEN f THEN pl ELSE nl END ELSE lag END, 6) AS lag, CASE WHEN take THEN CASE WHEN f THEN pr ELSE nr END ELSE railed END AS railed FROM e""")
def residual_checkpoints(spark, sf_dir):
    of = lambda kind, limit: of_kind(spark, sf_dir, kind).select("k", "t", F.col("v").alias("lag"), (F.col("v") > limit).alias("railed"))
    return timemap.refined_checkpoints(of("click", 60), of("view", 200), "k", "t", 6.0)


@query("WITH {ev}, g AS (SELECT k, t * 10 AS t, v - 35 AS lag FROM ev WHERE kind = 'click' AND NOT v > 100), w AS (SELECT k, max(abs(lag)) AS worst, count(*) AS n FROM g GROUP BY k HAVING max(abs(lag)) > 30) SELECT k, round(t, 6) AS t, round(lag, 6) AS lag FROM g JOIN w USING (k) UNION ALL SELECT k, round(t + 30, 6), round(lag, 6) FROM g JOIN w USING (k) WHERE n = 1")
def repair_curve(spark, sf_dir):
    points = of_kind(spark, sf_dir, "click").select("k", (F.col("t") * 10).alias("t"), (F.col("v") - 35).alias("lag"), (F.col("v") > 100).alias("railed"))
    return timemap.repair_curve(points, "k", "t", "lag", "railed", 30.0)


@query("WITH {sp}, " + UNITS + """, m AS (SELECT o, l, CASE WHEN l % 2 = 0 THEN 'wave' ELSE 'chroma' END AS kind, score, 1 + (o % 7) / 4.0 AS ratio, len, (o % 3) AS c, (l % 2) AS e, (o % 10) / 20.0 AS chain FROM un)
SELECT o, l, c >= e AND (score >= CASE kind WHEN 'wave' THEN 0.5 ELSE 0.6 END OR (score >= CASE kind WHEN 'wave' THEN 0.3 ELSE 0.4 END AND ratio >= CASE kind WHEN 'wave' THEN 1.3 ELSE 1.5 END AND len >= 2.5) OR (len >= 8 AND score >= CASE kind WHEN 'wave' THEN 0.12 ELSE 0.08 END AND ratio >= 1.15)) AS accepted,
kind = 'wave' AND chain <= 0.25 AND score >= chain + 0.40 AND (score >= 0.55 OR (score >= 0.45 AND ratio >= 2.0)) AS later FROM m""")
def match_acceptance(spark, sf_dir):
    d = units(spark, sf_dir).withColumns({"kind": F.when(F.col("l") % 2 == 0, "wave").otherwise("chroma"), "ratio": 1 + (F.col("o") % 7) / 4.0, "chain": (F.col("o") % 10) / 20.0})
    ok = placement.accepted(F.col("kind"), F.col("score"), F.col("ratio"), F.col("len"), F.col("o") % 3, F.col("l") % 2, {"wave": 0.5, "chroma": 0.6}, {"wave": 0.3, "chroma": 0.4}, {"wave": 1.3, "chroma": 1.5}, {"wave": 0.12, "chroma": 0.08})
    return d.select("o", "l", ok.alias("accepted"), placement.keeps_later(F.col("kind"), F.col("score"), F.col("ratio"), F.col("chain")).alias("later"))


OUT = "round(src_a, 6) AS src_a, round(src_b, 6) AS src_b, round(dst_a, 6) AS dst_a, round(dst_b, 6) AS dst_b"


@query("WITH {sp}, " + UNITS.replace("a + (b - a) * 2 AS dst_b", "a + 40 - (b - a) AS dst_b") + " SELECT o, l, round(CASE WHEN dst_b < dst_a + 0.05 THEN dst_a + 0.05 ELSE dst_b END, 6) AS dst_b FROM un")
def phrase_units(spark, sf_dir):
    return placement.units_in_order(units(spark, sf_dir).withColumn("dst_b", F.col("dst_a") + 40 - F.col("len"))).select("o", "l", "dst_b")


@query("WITH RECURSIVE {sp}, " + UNITS + """, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dst_a, dst_b, src_a, src_b) AS j FROM un),
f AS (SELECT k, j, src_a AS sa, greatest(src_b, src_a + 0.05) AS sb, greatest(dst_a, 0.0) AS a, greatest(dst_b, greatest(dst_a, 0.0) + 0.05) AS b, 0.0::DOUBLE AS p, src_b AS tail FROM n WHERE j = 1
UNION ALL SELECT n.k, n.j, n.src_a, greatest(n.src_b, n.src_a + 0.05), greatest(n.dst_a, f.b), greatest(n.dst_b, greatest(n.dst_a, f.b) + 0.05), f.b, n.src_b FROM f JOIN n ON n.k = f.k AND n.j = f.j + 1), x AS (SELECT k, (max({'j': j, 'b': b, 't': tail})).b AS b, (max({'j': j, 'b': b, 't': tail})).t AS t FROM f GROUP BY k)
SELECT k, 'speech' AS kind, round(sa, 6) AS src_a, round(sb, 6) AS src_b, round(a, 6) AS dst_a, round(b, 6) AS dst_b FROM f UNION ALL SELECT k, 'silence', round(sa, 6), round(sa, 6), round(p, 6), round(a, 6) FROM f WHERE a > p + 0.02 UNION ALL SELECT k, 'silence', round(t, 6), round(t, 6), round(b, 6), 3000.0 FROM x WHERE 3000 > b + 0.05""")
def spans_from_units(spark, sf_dir):
    return placement.spans_from_units(units(spark, sf_dir), "k", 3000.0, [])


@query("WITH RECURSIVE {sp}, " + UNITS + """, n AS (SELECT k, src_a AS sa, src_b AS sb, dst_a AS a, CASE WHEN dst_b - dst_a <= 1e-4 THEN dst_a + 1e-3 ELSE dst_b END AS b, row_number() OVER w AS j, lead(dst_a) OVER w AS nxt FROM un WINDOW w AS (PARTITION BY k ORDER BY dst_a, src_a, dst_b, src_b)),
c AS (SELECT k, j, sa, a, CASE WHEN nxt < b THEN nxt ELSE b END AS b, CASE WHEN nxt < b THEN sa + (nxt - a) / (b - a) * (sb - sa) ELSE sb END AS sb FROM n WHERE nxt IS NULL OR nxt >= b OR (nxt > a + 1e-3 AND b - a > 1e-6)), d AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY k ORDER BY j), 0) AS p FROM c), x AS (SELECT k, (max({'j': j, 'b': b, 't': sb})).b AS b, (max({'j': j, 'b': b, 't': sb})).t AS t FROM n GROUP BY k)
SELECT k, 'speech' AS kind, round(sa, 6) AS src_a, round(sb, 6) AS src_b, round(a, 6) AS dst_a, round(b, 6) AS dst_b FROM c UNION ALL SELECT k, 'silence', round(sa, 6), round(sa, 6), round(p, 6), round(a, 6) FROM d WHERE a > p + 0.02 UNION ALL SELECT k, 'silence', round(t, 6), round(t, 6), round(b, 6), 3000.0 FROM x WHERE 3000 > b + 0.05""")
def spans_with_silence(spark, sf_dir):
    return placement.with_silence(units(spark, sf_dir), "k", 3000.0)


@query("WITH {sp}, " + UNITS + " SELECT k, round(sum(score * greatest(dst_b - dst_a, 1e-3)) / sum(greatest(dst_b - dst_a, 1e-3)), 6) AS confidence FROM un GROUP BY k")
def gap_confidence(spark, sf_dir):
    return placement.confidence(units(spark, sf_dir), "k", "score")


EDGES = "wh AS (SELECT o, min(src_a) - 2 AS src_a, max(src_b) + 1 AS src_b, min(dst_a) - (o % 3) AS dst_a, max(dst_b) + (o % 2) AS dst_b FROM un GROUP BY o), en AS (SELECT o, min({'d': dst_a, 's': src_a}) AS f, max({'d': dst_b, 's': src_b}) AS l FROM un GROUP BY o), ed AS (SELECT wh.*, f, l FROM wh JOIN en USING (o))"


@query("WITH {sp}, " + UNITS + ", " + EDGES + """ SELECT o, 'lead' AS edge, round(src_a, 6) AS src_a, round(f.s, 6) AS src_b, round(dst_a, 6) AS dst_a, round(f.d, 6) AS dst_b FROM ed WHERE (f.s - src_a > 0.03 OR f.d - dst_a > 0.03) AND f.s - src_a > -1e-3 AND f.d - dst_a > -1e-3
UNION ALL SELECT o, 'tail', round(l.s, 6), round(src_b, 6), round(l.d, 6), round(dst_b, 6) FROM ed WHERE (src_b - l.s > 0.03 OR dst_b - l.d > 0.03) AND src_b - l.s > -1e-3 AND dst_b - l.d > -1e-3""")
def placed_edges(spark, sf_dir):
    u = units(spark, sf_dir)
    whole = u.groupBy("o").agg((F.min("src_a") - 2).alias("src_a"), (F.max("src_b") + 1).alias("src_b"), (F.min("dst_a") - F.col("o") % 3).alias("dst_a"), (F.max("dst_b") + F.col("o") % 2).alias("dst_b"))
    return placement.edge_spans(u, whole, "o").select("o", "edge", *placement.SPAN)


@query("WITH {sp}, " + UNITS + """, q AS (SELECT o, max(src_a) - 1 + (o % 60) AS src FROM un GROUP BY o), f AS (SELECT o, (min({'d': dst_a, 's': src_a})) AS f FROM un GROUP BY o), h AS (SELECT o, min({'a': dst_a, 'b': src_a, 'c': dst_b, 'd': src_b}) AS h FROM un JOIN q USING (o) WHERE src >= src_a - 1e-3 AND src <= src_b + 1e-3 AND src_b - src_a > 1e-6 GROUP BY o)
SELECT o, round(CASE WHEN src < f.s - 1e-3 THEN f.d ELSE h.a + (src - h.b) / (h.d - h.b) * (h.c - h.a) END, 6) AS dst FROM q JOIN f USING (o) LEFT JOIN h USING (o)""")
def target_lookup(spark, sf_dir):
    u = units(spark, sf_dir)
    asked = u.withColumn("src", F.max("src_a").over(Window.partitionBy("o")) - 1 + F.col("o") % 60)
    return placement.target_at(asked, ["o"], "src").select("o", "dst")


@query("WITH {sp}, " + UNITS + " SELECT o, l, (o % 10) / 10.0 <= 0.12 OR ((o % 10) / 10.0 <= 0.40 AND score < 0.45 AND coalesce(CASE WHEN l > 2 THEN l / 6.0 END, 1.0) >= 0.55) AS holds FROM un")
def held_entrance(spark, sf_dir):
    d = units(spark, sf_dir)
    early = (F.col("o") % 10) / 10.0
    return d.select("o", "l", placement.holds_entrance(F.lit(0.0), early, F.col("score"), F.when(F.col("l") > 2, F.col("l") / 6.0)).alias("holds"))


@query("WITH {sp}, " + UNITS + ", c AS (SELECT *, dst_a + 10 + (l - 3) * 5 AS e FROM un) SELECT o, l, round(CASE WHEN e < dst_b THEN src_a + (e - dst_a) / (dst_b - dst_a) * (src_b - src_a) ELSE src_b END, 6) AS src_b, round(least(e, dst_b), 6) AS dst_b FROM c WHERE NOT (e < dst_b AND (e <= dst_a + 1e-3 OR dst_b - dst_a <= 1e-6))")
def clip_target_end(spark, sf_dir):
    return placement.cut_before(units(spark, sf_dir), F.col("dst_a") + 10 + (F.col("l") - 3) * 5).select("o", "l", "src_b", "dst_b")


@query("WITH {sp}, " + UNITS.replace("a - 1000 AS src_a, b - 1000 AS src_b", "a AS src_a, b AS src_b") + """, e AS (SELECT *, greatest(0, least(2, src_a, coalesce(greatest(0, src_a - lag(src_b) OVER w) / 2, 2))) AS p, least(4, greatest(0, 2500 - src_b), coalesce(greatest(0, lead(src_a) OVER w - src_b) / 2, 4)) AS q FROM un WINDOW w AS (PARTITION BY k ORDER BY src_a, src_b, o, l))
SELECT o, l, round(src_a - p, 6) AS src_a, round(src_b + q, 6) AS src_b, round(dst_a - p, 6) AS dst_a, round(dst_b + q, 6) AS dst_b FROM e""")
def widened_units(spark, sf_dir):
    u = units(spark, sf_dir).withColumns({"src_a": F.col("src_a") + 1000, "src_b": F.col("src_b") + 1000})
    return placement.with_edges(u, "k", 2500.0, 2.0, 4.0, ["src_a", "src_b", "o", "l"]).select("o", "l", *placement.SPAN)


@query("WITH {sp}, " + UNITS + ", c AS (SELECT *, dst_a + 30 AS cut FROM un), i AS (SELECT *, cut > dst_a + 0.02 AND cut < dst_b - 0.02 AS i, src_a + (cut - dst_a) / nullif(dst_b - dst_a, 0) * (src_b - src_a) AS s FROM c) SELECT o, l, round(src_a, 6) AS src_a, round(CASE WHEN i THEN s ELSE src_b END, 6) AS src_b, round(dst_a, 6) AS dst_a, round(CASE WHEN i THEN cut ELSE dst_b END, 6) AS dst_b FROM i UNION ALL SELECT o, l, round(s, 6), round(src_b, 6), round(cut, 6), round(dst_b, 6) FROM i WHERE i")
def split_spans(spark, sf_dir):
    return placement.split_at(units(spark, sf_dir), F.col("dst_a") + 30).select("o", "l", *placement.SPAN)


@query("WITH {sp}, " + UNITS + " SELECT o, l, round(dst_a + greatest(0.5 * (src_b - src_a), least(2 * (src_b - src_a), 60.0)), 6) AS dst_b FROM un")
def stretched_spans(spark, sf_dir):
    return placement.stretched(units(spark, sf_dir), F.lit(60.0)).select("o", "l", "dst_b")


@query("""WITH RECURSIVE {ev}, s AS (SELECT k, floor(t / 24) * 24.0 AS start, floor(t / 24) * 24.0 + 20 AS stop, max(v) AS level, min(v) AS bridge FROM ev GROUP BY k, floor(t / 24)), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY start) AS j FROM s),
f AS (SELECT k, j, start, stop, level, true AS new FROM n WHERE j = 1 UNION ALL SELECT k, j, CASE WHEN m THEN s0 ELSE start END, stop, CASE WHEN m THEN least(l0, level) ELSE level END, NOT m FROM (SELECT n.*, f.start AS s0, f.level AS l0, n.bridge >= 0.35 * least(f.level, n.level) AS m FROM f JOIN n ON n.k = f.k AND n.j = f.j + 1))
SELECT k, round(start, 6) AS start, round(max(stop), 6) AS stop FROM f GROUP BY k, start""")
def merged_segments(spark, sf_dir):
    day = F.floor(F.col("t") / 24) * 24.0
    s = events(spark, sf_dir).groupBy("k", day.alias("start")).agg(F.max("v").alias("level"), F.min("v").alias("bridge")).withColumn("stop", F.col("start") + 20)
    return placement.merged_segments(s, "k", "level", "bridge")


@query("""WITH {ev}, ld AS (SELECT k, t FROM ev WHERE v >= 20), r AS (SELECT k, min(t) AS a, max(t) AS b FROM (SELECT *, sum(CASE WHEN g > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t) AS run FROM (SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS g FROM ld)) GROUP BY k, run), q AS (SELECT i, k, t AS e FROM ev WHERE kind = 'purchase'),
j AS (SELECT q.*, p.a AS pa, p.b AS pb, n.a AS na, n.b AS nb FROM q ASOF LEFT JOIN r p ON q.k = p.k AND q.e >= p.a ASOF LEFT JOIN r n ON q.k = n.k AND q.e <= n.a), x AS (SELECT i, greatest(CASE WHEN pa IS NOT NULL AND pb + 12 >= e THEN greatest(0, pb - e) END, CASE WHEN na - e <= 12 THEN nb - e END) AS reach FROM j)
SELECT i, round(CASE WHEN reach > 0 THEN reach + 1 ELSE 0 END, 6) AS tail FROM x""")
def audible_tails(spark, sf_dir):
    q = of_kind(spark, sf_dir, "purchase").select("i", "k", F.col("t").alias("dst_b"))
    return placement.audible_tails(events(spark, sf_dir), q, "k", "t", "v", 20.0, 12.0, 1.0).select("i", "tail")


WINDOWS = """hh AS (SELECT k, kind, floor(t / 6)::BIGINT AS f, sum(v) AS v FROM ev WHERE kind IN ('click', 'view') GROUP BY 1, 2, 3), qw AS (SELECT k, f, v, unnest(range(greatest(floor((f - 40) / 20)::BIGINT + 1, 0), f // 20 + 1)) AS win FROM hh WHERE kind = 'click'),
st AS (SELECT k, win, avg(v) AS m FROM qw GROUP BY 1, 2 HAVING count(*) >= 6 AND avg(v * v) >= 1), qq AS (SELECT qw.k, win, lag, f + lag AS f, v - m AS q FROM qw JOIN st USING (k, win), range(-6, 7) g(lag)),
sm AS (SELECT k, win, lag, sum(q * r.v) AS qr, sum(q) AS sq, sum(r.v) AS sr, sum(q * q) AS q2, sum(r.v * r.v) AS r2, count(*) AS c FROM qq JOIN hh r USING (k, f) WHERE r.kind = 'view' GROUP BY 1, 2, 3),
sc AS (SELECT k, win, lag, round(CASE WHEN c >= 3 THEN (qr - sq * sr / c) / sqrt(greatest((q2 - sq * sq / c) * (r2 - sr * sr / c), 1e-12)) ELSE 0 END, 9) AS score FROM sm),
wn AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS b, row_number() OVER (PARTITION BY k, win ORDER BY score DESC, lag) AS r FROM sc WINDOW w AS (PARTITION BY k, win ORDER BY lag)),
wl AS (SELECT k, win, win * 20 + 20.0 AS "at", lag + coalesce(CASE WHEN abs(a - 2 * score + b) > 1e-12 THEN greatest(-1, least(1, 0.5 * (a - b) / (a - 2 * score + b))) ELSE 0 END, 0) AS lg, score, abs(lag) >= 6 AS railed FROM wn WHERE r = 1)"""


def lag_windows(spark, sf_dir):
    of = lambda kind: of_kind(spark, sf_dir, kind).groupBy("k", F.floor(F.col("t") / 6).alias("f")).agg(F.sum("v").alias("v"))
    return correlate.window_lags(of("view"), of("click"), ["k"], "f", "v", 6, 40, 20, 6, 1.0)


@query("WITH {ev}, " + WINDOWS + " SELECT k, win, \"at\", round(lg, 4) AS lag, round(score, 4) AS score, railed FROM wl", digits=4)
def checkpoint_offsets(spark, sf_dir):
    return lag_windows(spark, sf_dir)


@query("WITH {ev}, " + WINDOWS + ", c AS (SELECT k, 0.3 + (k % 10) / 20.0 AS corr FROM ev GROUP BY k), g AS (SELECT k, max(lg) - min(lg) AS drift, avg((score < 0.25)::INT) AS weak FROM wl GROUP BY k), s AS (SELECT k, corr, coalesce(drift, 0) AS drift, coalesce(weak, 1) AS weak FROM c LEFT JOIN g USING (k)) SELECT k, round(corr, 4) AS corr, round(drift, 4) AS drift, round(weak, 4) AS weak, CASE WHEN corr < 0.35 OR drift > 8 OR weak > 0.35 THEN 'fail' ELSE 'pass' END AS verdict FROM s", digits=4)
def pair_score(spark, sf_dir):
    coarse = events(spark, sf_dir).select("k").distinct().withColumn("corr", 0.3 + (F.col("k") % 10) / 20.0)
    return correlate.pair_score(lag_windows(spark, sf_dir), coarse, "k", 8.0)


@query("WITH {ev}, " + WINDOWS + ", x AS (SELECT k, count(*) AS n, max(abs(lg)) AS worst, max(railed::INT) AS rail FROM wl GROUP BY k), c AS (SELECT k, avg(v) / 10 AS coarse FROM ev GROUP BY k) SELECT k, coalesce(n, 0) AS n, round(worst, 4) AS worst, CASE WHEN coalesce(n, 0) > 0 THEN CASE WHEN worst > 5.5 OR rail = 1 THEN 'fail' ELSE 'pass' END WHEN abs(coarse) > 5 THEN 'fail' ELSE 'pass' END AS verdict FROM c LEFT JOIN x USING (k)", digits=4)
def measured_gate(spark, sf_dir):
    coarse = events(spark, sf_dir).groupBy("k").agg((F.avg("v") / 10).alias("coarse_lag"))
    return quality.offset_gate(lag_windows(spark, sf_dir), coarse, "k", 5.5, 5.0)


FIVE = "e5 AS (SELECT k, t / 100 AS t, v / 100 AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS j FROM ev) WHERE j <= 5)"


@query("WITH {ev}, " + FIVE + """, l AS (SELECT a.k, a.t AS ta, b.t AS tb, (b.v - a.v) / (b.t - a.t) AS s, a.v - (b.v - a.v) / (b.t - a.t) * a.t AS c FROM e5 a JOIN e5 b ON a.k = b.k AND b.t > a.t), n AS (SELECT l.k, ta, tb, s, c, count(*) FILTER (abs(v - c - s * t) <= 0.05) AS n FROM l JOIN e5 USING (k) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, ta, tb) AS r FROM n)
SELECT k, round(regr_slope(v, t), 6) AS slope, round(avg(v) - regr_slope(v, t) * avg(t), 6) AS intercept, count(*) AS n_inliers FROM e5 JOIN b USING (k) WHERE r = 1 AND abs(v - c - s * t) <= 0.05 GROUP BY k""")
def pair_line(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("j", F.row_number().over(Window.partitionBy("k").orderBy("t"))).where("j <= 5").select("k", (F.col("t") / 100).alias("t"), (F.col("v") / 100).alias("v"))
    return robust.pair_line(d, "k", "t", "v", 0.05)


SUMS = "sum(q) AS a, sum(q * t) AS b, sum(q * t * t) AS c, sum(q * v) AS d, sum(q * t * v) AS e"


@query("WITH {ev}, s AS (SELECT *, v / (v + 35.0) AS w FROM ev), l AS (SELECT k, greatest(0.1, quantile_cont(w, 0.4)) AS l FROM s GROUP BY k), m AS (SELECT k, " + SUMS + " FROM (SELECT *, w * w AS q FROM s JOIN l USING (k) WHERE w >= l) GROUP BY k) SELECT k, round((a * e - b * d) / (a * c - b * b), 6) AS slope, round((d - (a * e - b * d) / (a * c - b * b) * b) / a, 6) AS intercept FROM m")
def strong_line(spark, sf_dir):
    return robust.strong_line(events(spark, sf_dir).withColumn("w", conf()), "k", "t", "v", "w")


@query("WITH {ev}, m AS (SELECT k, " + SUMS + " FROM (SELECT *, pow(greatest(v / (v + 35.0), 0.05), 2) AS q FROM ev) GROUP BY k), c AS (SELECT k, (d - (a * e - b * d) / (a * c - b * b) * b) / a AS c FROM m) SELECT i, round(v - c, 6) AS v, round(c, 6) AS absorbed FROM ev JOIN c USING (k)")
def absorb_offset(spark, sf_dir):
    return robust.absorb_offset(events(spark, sf_dir).withColumn("w", conf()), "k", "t", "v", "w").select("i", "v", "absorbed")


@query("""WITH RECURSIVE {ev}, n AS (SELECT k, t, v, v / (v + 35.0) AS q, row_number() OVER w AS j, list(v) OVER (PARTITION BY k ORDER BY t, v ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM ev WINDOW w AS (PARTITION BY k ORDER BY t, v)),
f AS (SELECT k, j, t, r, [r] AS held FROM (SELECT k, j, t, CASE WHEN abs(v - m) > 40 OR q < 0.35 THEN m ELSE v END AS r FROM (SELECT *, list_median(list_concat([v], coalesce(ahead, []))) AS m FROM n WHERE j = 1))
UNION ALL SELECT k, j, t, r, list_slice(list_concat(held, [r]), -3, -1) FROM (SELECT k, j, t, held, CASE WHEN abs(v - m) > 40 OR q < 0.35 THEN m ELSE v END AS r FROM (SELECT n.*, f.held, list_median(list_concat(f.held, list_concat([n.v], coalesce(n.ahead, [])))) AS m FROM f JOIN n ON n.k = f.k AND n.j = f.j + 1)))
SELECT k, round(t, 6) AS t, round(r, 6) AS despiked FROM f""")
def despiked_lags(spark, sf_dir):
    return robust.despiked(events(spark, sf_dir).withColumn("w", conf()), "k", "t", "v", "w", 40.0)


CLOCKED = "sc AS (SELECT i, t * 10 AS s, v FROM ev)"
TWO_DIGITS = "lpad(({x})::VARCHAR, 2, '0')"


def digits2(x):
    return TWO_DIGITS.replace("{x}", x)


@query("WITH {ev}, " + CLOCKED + ", w AS (SELECT *, round_even(greatest(s, 0), 0)::BIGINT AS n, round_even(greatest(s, 0) * 1000, 0)::BIGINT AS ms FROM sc) SELECT i, CASE WHEN n >= 3600 THEN (n // 3600) || ':' || " + digits2("n // 60 % 60") + " || ':' || " + digits2("n % 60") + " ELSE (n // 60) || ':' || " + digits2("n % 60") + " END AS long_clock, (floor(s)::BIGINT // 60) || ':' || " + digits2("floor(s)::BIGINT % 60") + " AS cut_clock, CASE WHEN ms >= 3600000 THEN (ms // 3600000) || ':' || " + digits2("ms // 60000 % 60") + " || ':' ELSE (ms // 60000) || ':' END || " + digits2("ms // 1000 % 60") + " || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS ms_clock, CASE WHEN n < 60 THEN 'ETA ' || n || 's' WHEN n < 3600 THEN 'ETA ' || (n // 60) || 'm ' || " + digits2("n % 60") + " || 's' ELSE 'ETA ' || (n // 3600) || 'h ' || " + digits2("n // 60 % 60") + " || 'm' END AS eta, CASE WHEN v > 100 THEN 'past +40ms' ELSE printf('%+d', round_even(v - 35, 0)::BIGINT) || 'ms' END AS amount, CASE WHEN v < 10 THEN 'n/a' ELSE printf('%+.3f', v) END AS pad FROM w")
def clock_texts(spark, sf_dir):
    s, v = F.col("t") * 10, F.col("v")
    return events(spark, sf_dir).select("i", text.long_clock(s).alias("long_clock"), text.cut_clock(s).alias("cut_clock"), text.ms_clock(s).alias("ms_clock"), text.eta(s).alias("eta"), text.signed_ms(v - 35, v > 100).alias("amount"), text.pad_text(F.when(v >= 10, v)).alias("pad"))


NOTED = "nt AS (SELECT p_partkey AS id, 'limit=' || p_size || '; points=' || p_size * 3 || ':+' || p_size || ' ' || p_size * 5 || ':-' || (p_size + 7) || '; repair=' || p_brand AS note FROM part)"


@query("WITH " + NOTED + r""" SELECT id, regexp_extract(note, '(?:^|;\s*)limit=([^;]*)', 1)::BIGINT AS lim, regexp_extract(note, '(?:^|;\s*)repair=([^;]*)', 1) AS repair, regexp_extract(x, '^(\d+)', 1)::BIGINT AS at, regexp_extract(x, '([+-]\d+)$', 1)::BIGINT AS lag FROM (SELECT id, note, unnest(regexp_extract_all(regexp_extract(note, '(?:^|;\s*)points=([^;]*)', 1), '\d+:[+-]\d+')) AS x FROM nt)""")
def notes_read(spark, sf_dir):
    n = lambda c: c.cast("string")
    size = F.col("p_size")
    note = F.concat(F.lit("limit="), n(size), F.lit("; points="), n(size * 3), F.lit(":+"), n(size), F.lit(" "), n(size * 5), F.lit(":-"), n(size + 7), F.lit("; repair="), "p_brand")
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), note.alias("note"))
    d = d.select("id", text.block(F.col("note"), "limit").cast("bigint").alias("lim"), text.block(F.col("note"), "repair").alias("repair"), F.explode(text.checkpoints(F.col("note"))).alias("x"))
    return d.select("id", "lim", "repair", F.element_at(F.split("x", ":"), 1).cast("bigint").alias("at"), F.element_at(F.split("x", ":"), 2).cast("bigint").alias("lag"))


@query("""WITH {ev}, g AS (SELECT k, avg(v) / 1000 AS o, regr_slope(v, t) * 100 AS s, quantile_cont(v, 0.95) AS p, count(*) FILTER (v > 100) AS j, avg(v / (v + 35.0)) AS c, max(v) AS m FROM ev GROUP BY k), z AS (SELECT *, concat_ws(',', CASE WHEN o >= 0.045 THEN 'OFFSET_TOO_LARGE' END, CASE WHEN abs(s) >= 2 THEN 'TEMPO_DRIFT' END, CASE WHEN m >= 200 THEN 'LOCAL_DISCONTINUITY' END) AS codes FROM g)
SELECT k, 'profile=default; offset=' || printf('%+.3f', o) || 's; drift=' || printf('%+.1f', s) || 'ms/min; p95=' || round_even(p, 0)::BIGINT || 'ms; jumps=' || j || '; conf=' || printf('%.2f', c) || '; codes=' || CASE WHEN codes = '' THEN 'none' ELSE codes END AS line FROM z""")
def report_line(spark, sf_dir):
    ev = events(spark, sf_dir)
    g = series.summed(ev, ["k"], "i", {"o": F.col("v")}, F.count("v").alias("n"), (F.regr_slope("v", "t") * 100).alias("s"), series.quantile(F.col("v"), 0.95).alias("p"), F.count_if(F.col("v") > 100).alias("j"), F.avg(conf()).alias("c"), F.max("v").alias("m"))
    g = g.withColumn("o", F.try_divide("o", "n") / 1000)
    codes = F.concat_ws(",", F.when(F.col("o") >= 0.045, "OFFSET_TOO_LARGE"), F.when(F.abs("s") >= 2, "TEMPO_DRIFT"), F.when(F.col("m") >= 200, "LOCAL_DISCONTINUITY"))
    return g.select("k", text.summary(F.lit("default"), F.col("o"), F.col("s"), F.col("p"), F.col("j").cast("string"), F.col("c"), codes).alias("line"))


FILES = "fl AS (SELECT p_partkey % 40 AS song, p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'backup' ELSE '' END AS folder, p_name || CASE p_partkey % 6 WHEN 0 THEN ' (Original Song)' WHEN 1 THEN ' (Acapella)' WHEN 2 THEN ' instrumental' WHEN 3 THEN ' vocals' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.flac' ELSE '.wav' END AS name FROM part)"
ROLE = r"""fr AS (SELECT *, regexp_matches(lower(name), '\.(wav|flac|mp3|m4a|ogg|aiff|aif)$') AS audio, CASE WHEN NOT regexp_matches(lower(name), '\.(wav|flac|mp3|m4a|ogg|aiff|aif)$') THEN NULL WHEN contains(lower(name), '(original') THEN 'original' WHEN contains(lower(name), 'instrumental') THEN 'instrumental' WHEN regexp_matches(lower(name), 'acapella|vocals') THEN 'acapella' END AS role FROM fl)"""
ROLES = "SELECT song, min(name) FILTER (role = 'acapella') AS acapella, min(name) FILTER (role = 'instrumental') AS instrumental, CASE WHEN count(*) FILTER (role = 'original') = 0 AND count(*) FILTER (audio AND role IS NULL) = 1 THEN min(name) FILTER (audio AND role IS NULL) ELSE min(name) FILTER (role = 'original') END AS original, concat_ws('; ', CASE WHEN count(*) FILTER (role = 'acapella') > 1 THEN 'multi_acapella=' || count(*) FILTER (role = 'acapella') END, CASE WHEN count(*) FILTER (role = 'instrumental') > 1 THEN 'multi_instrumental=' || count(*) FILTER (role = 'instrumental') END, CASE WHEN count(*) FILTER (role = 'original') > 1 THEN 'multi_original=' || count(*) FILTER (role = 'original') END, CASE WHEN count(*) FILTER (role = 'original') = 0 AND count(*) FILTER (audio AND role IS NULL) = 1 THEN 'original_assumed' END) AS note FROM fr"


def listed(spark, sf_dir):
    key = F.col("p_partkey")
    pick = lambda n, values: F.coalesce(F.get(F.array(*map(F.lit, values)), (key % n).cast("int")), F.lit(""))
    name = F.concat("p_name", pick(6, [" (Original Song)", " (Acapella)", " instrumental", " vocals", "", ""]), pick(5, [".txt", ".flac", ".wav", ".wav", ".wav"]))
    return table(spark, sf_dir, "part").select((key % 40).alias("song"), key.alias("id"), F.when(key % 11 == 0, "backup").otherwise("").alias("folder"), name.alias("name"))


@query("WITH " + FILES + ", " + ROLE + " " + ROLES + " GROUP BY song")
def scan_folders(spark, sf_dir):
    return files.roles(listed(spark, sf_dir), "song", "name")


@query("WITH " + FILES + ", " + ROLE + " SELECT id, name FROM fr WHERE audio AND role IS NULL")
def unclassified_audio(spark, sf_dir):
    return files.unclassified(listed(spark, sf_dir), "name").select("id", "name")


@query("WITH " + FILES + ", " + ROLE + ", s AS (" + ROLES + " WHERE folder = 'backup' GROUP BY song), r AS (" + ROLES + " WHERE folder <> 'backup' GROUP BY song) SELECT coalesce(s.song, r.song) AS song, s.acapella, s.instrumental, r.original FROM s FULL JOIN r ON s.song = r.song")
def backup_stems(spark, sf_dir):
    return files.backup_stems(listed(spark, sf_dir), "song", "folder", "name")


@query("WITH f AS (SELECT p_name || CASE p_partkey % 3 WHEN 0 THEN '_[PASS]' WHEN 1 THEN '_[fail]' ELSE '' END AS folder FROM part) SELECT folder FROM f WHERE NOT regexp_matches(folder, '_\\[(pass|fail)\\]$', 'i') AND contains(lower(folder), 'e') ORDER BY lower(folder), folder LIMIT 100".replace("\\\\", "\\"))
def work_folders(spark, sf_dir):
    ends = F.when(F.col("p_partkey") % 3 == 0, "_[PASS]").when(F.col("p_partkey") % 3 == 1, "_[fail]").otherwise("")
    return files.work_folders(table(spark, sf_dir, "part").select(F.concat("p_name", ends).alias("folder")), "folder", "E", 100)


@query("WITH f AS (SELECT p_partkey AS id, p_name AS bare, CASE WHEN p_size > 25 THEN 'fail' WHEN p_size > 5 THEN 'pass' ELSE 'error' END AS v FROM part) SELECT id, CASE WHEN v IN ('pass', 'fail') THEN bare || '_[' || v || ']' END AS renamed FROM f")
def tagged_names(spark, sf_dir):
    verdict = F.when(F.col("p_size") > 25, "fail").when(F.col("p_size") > 5, "pass").otherwise("error")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.tagged(naming.without_tag(F.col("p_name")), verdict).alias("renamed"))


@query("""WITH {ev}, b AS (SELECT k, list(t ORDER BY t) FILTER (kind = 'click') AS x, list(t ORDER BY t) FILTER (kind = 'purchase') AS y FROM ev GROUP BY k) SELECT k, CASE WHEN len(x) >= 12 AND len(y) >= 12 THEN len(x) ELSE 0 END AS n_beats, CASE WHEN len(x) >= 12 AND len(y) >= 12 THEN len(y) ELSE 0 END AS n_downbeats FROM b""")
def beats_or_none(spark, sf_dir):
    ev = events(spark, sf_dir)
    kinds = ev.select("k", "t", F.when(F.col("kind") == "click", "beat").when(F.col("kind") == "purchase", "downbeat").alias("what"))
    d = files.trusted_beats(ev.select("k").distinct(), kinds, "k", "what", "t", 12)
    return d.select("k", F.size("beats").cast("bigint").alias("n_beats"), F.size("downbeats").cast("bigint").alias("n_downbeats"))


@query("SELECT o_custkey AS k, count(*) FILTER (o_totalprice > 150000) >= 2 AS ready FROM orders GROUP BY 1")
def cache_ready(spark, sf_dir):
    return files.cache_ready(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice"), "k", "o_totalprice", 150_000)


@query("WITH {ev}, a AS (SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY t) AS nr FROM ev WHERE kind = 'click'), b AS (SELECT k, j, row_number() OVER (PARTITION BY k ORDER BY j) AS nr FROM (SELECT k, i AS j FROM ev WHERE kind = 'view')) SELECT k, nr::INT AS nr, i, j FROM a JOIN b USING (k, nr)")
def zipped_lists(spark, sf_dir):
    return files.zipped(of_kind(spark, sf_dir, "click").select("k", "i", "t"), of_kind(spark, sf_dir, "view").select("k", F.col("i").alias("j")), "k", ["t"]).select("k", "nr", "i", "j")


@query("WITH {ev} SELECT i, round(sum(sin(2 * pi() * (1 + k % 5) * h * t / 24) / h), 6) AS y FROM ev, range(1, 4) x(h) GROUP BY i")
def harmonic_tone(spark, sf_dir):
    from math import pi

    wave = lambda h: F.sin(2 * pi * (1 + F.col("k") % 5) * h * F.col("t") / 24) / h
    return events(spark, sf_dir).select("i", (wave(1) + wave(2) + wave(3)).alias("y"))
