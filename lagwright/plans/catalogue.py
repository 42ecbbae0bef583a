"""All queries over the driver's tables, and their SQL in DuckDB's dialect.

Series are users' events in time (hours, value); values of one type stand for lags, of another for scores. Doubles are
rounded to six digits on both sides.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gates, naming
from ..operators import beats, correlate, quality, robust, segments, series, solvers, spans
from ..sources.tables import day_spans, series as events, table
from .registry import query

def hourly(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """All users' values of a type by hour, one key."""
    return events(spark, sf_dir).where(F.col("kind") == kind).groupBy(F.lit(0).alias("k"), F.floor("t").cast("bigint").alias("f")).agg(F.sum("v").alias("v"))


def conf(v: str = "v"):
    return F.col(v) / (F.col(v) + 35.0)


MAD = "SELECT k, quantile_cont(v, 0.5) AS median, 1.4826 * quantile_cont(abs(v - m), 0.5) AS mad FROM ev JOIN (SELECT k, quantile_cont(v, 0.5) AS m FROM ev GROUP BY k) USING (k) GROUP BY k"


@query("WITH {ev} SELECT k, round(median, 6) AS median, round(mad, 6) AS mad FROM (" + MAD + ")")
def mad_by_key(spark, sf_dir):
    return robust.mad(events(spark, sf_dir), "k", "v")


@query("WITH {ev} SELECT k, round(quantile_cont(v, 0.95), 6) AS p95 FROM ev GROUP BY k")
def p95_by_key(spark, sf_dir):
    return events(spark, sf_dir).groupBy("k").agg(F.percentile("v", 0.95).alias("p95"))


@query("WITH {ev} SELECT i, round(CASE WHEN m >= 1e-9 THEN v / m ELSE v END, 6) AS y, round(CASE WHEN s > 1e-9 THEN (v - a) / s ELSE v - a END, 6) AS z FROM (SELECT *, max(abs(v)) OVER w AS m, avg(v) OVER w AS a, stddev_pop(v) OVER w AS s FROM ev WINDOW w AS (PARTITION BY k))")
def peak_norm(spark, sf_dir):
    ev = events(spark, sf_dir)
    level = ev.groupBy("k").agg(F.max(F.abs("v")).alias("m"), F.avg("v").alias("a"), F.stddev_pop("v").alias("s"))
    d = ev.join(level, "k")
    return d.select("i", F.when(F.col("m") >= 1e-9, F.col("v") / F.greatest("m", F.lit(1e-12))).otherwise(F.col("v")).alias("y"), ((F.col("v") - F.col("a")) / F.when(F.col("s") > 1e-9, F.col("s")).otherwise(1.0)).alias("z"))


LINE = """slopes AS (SELECT a.k, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS slope FROM ev a JOIN ev b ON a.k = b.k AND b.t > a.t GROUP BY a.k),
mid AS (SELECT k, count(*) AS n, quantile_cont(v, 0.5) AS mv, quantile_cont(t, 0.5) AS mt FROM ev GROUP BY k),
line AS (SELECT k, n, coalesce(slope, 0.0) AS slope, mv - coalesce(slope, 0.0) * mt AS intercept FROM mid LEFT JOIN slopes USING (k))"""


@query("WITH {ev}, " + LINE + " SELECT k, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM line")
def theil_sen(spark, sf_dir):
    return robust.theil_sen(events(spark, sf_dir), "k", "t", "v")


RESID = LINE + """, r0 AS (SELECT ev.*, n, slope, intercept, v - intercept - slope * t AS resid FROM ev JOIN line USING (k)),
rm AS (SELECT k, quantile_cont(resid, 0.5) AS m FROM r0 GROUP BY k), rs AS (SELECT k, 1.4826 * quantile_cont(abs(resid - m), 0.5) AS mad FROM r0 JOIN rm USING (k) GROUP BY k),
r1 AS (SELECT r0.*, abs(resid) <= greatest(3 * mad, 20.0) AS good FROM r0 JOIN rs USING (k)),
r2 AS (SELECT *, good OR sum(good::INT) OVER (PARTITION BY k) < greatest(3, n // 5) AS inlier FROM r1),
s0 AS (SELECT *, resid - lag(resid) OVER w AS l, lead(resid) OVER w - resid AS r FROM r2 WINDOW w AS (PARTITION BY k ORDER BY t)),
sm AS (SELECT k, quantile_cont(l, 0.5) AS m FROM s0 GROUP BY k), ss AS (SELECT k, greatest(3 * 1.4826 * quantile_cont(abs(l - m), 0.5), 40.0) AS thr FROM s0 JOIN sm USING (k) GROUP BY k),
jumps AS (SELECT k, t, l AS size, CASE WHEN abs(r) > thr THEN 'spike' ELSE 'step' END AS kind FROM s0 JOIN ss USING (k) WHERE r IS NOT NULL AND abs(l) > thr)"""


@query("WITH {ev}, " + RESID + " SELECT k, round(t, 6) AS t, round(size, 6) AS size, kind FROM jumps")
def find_jumps(spark, sf_dir):
    return robust.find_jumps(robust.residuals(events(spark, sf_dir), "k", "t", "v", 20.0), "k", "t", "resid", 40.0)


@query("WITH {ev}, " + RESID + """, r3 AS (SELECT *, v / (v + 35.0) AS score, inlier AND NOT (v / (v + 35.0) < 0.35 AND abs(resid) > 10.0) AS strict FROM r2),
r4 AS (SELECT * EXCLUDE (inlier), CASE WHEN sum(strict::INT) OVER (PARTITION BY k) < greatest(3, n // 5) THEN inlier ELSE strict END AS inlier FROM r3),
u0 AS (SELECT r4.*, inlier AND size IS NULL AS ok, size FROM r4 LEFT JOIN jumps USING (k, t)),
u AS (SELECT *, ok OR sum(ok::INT) OVER (PARTITION BY k) < 2 AS used FROM u0)
SELECT k, count(*) AS n, round(first(intercept), 6) AS "offset", round(first(slope), 6) AS slope, round(sqrt(avg(resid * resid) FILTER (used)), 6) AS rms, round(max(abs(resid)) FILTER (used), 6) AS max_abs,
round(quantile_cont(abs(resid), 0.5) FILTER (used), 6) AS median_abs, round(quantile_cont(abs(resid), 0.95) FILTER (used), 6) AS p95_abs, count(size) AS n_jumps,
round(avg((score < 0.35)::INT), 6) AS weak_share, round(sum(CASE WHEN used THEN score ELSE 0 END) / sum(score), 6) AS confidence FROM u GROUP BY k""")
def decompose_report(spark, sf_dir):
    return robust.decompose(events(spark, sf_dir).withColumn("score", conf()), "k", "t", "v", "score", 20.0, 40.0)


@query("WITH {ev} SELECT k, round(CASE WHEN count(*) < 6 THEN 0 ELSE sqrt(avg((v - c - s * t) * (v - c - s * t))) END, 6) AS rms FROM ev JOIN (SELECT k, regr_slope(v, t) AS s, regr_intercept(v, t) AS c FROM ev GROUP BY k) USING (k) GROUP BY k")
def ols_line_rms(spark, sf_dir):
    return robust.ols_rms(events(spark, sf_dir), "k", "t", "v")


@query("""WITH {ev}, s AS (SELECT k, sum(q) AS a, sum(q * t) AS b, sum(q * t * t) AS c, sum(q * v) AS d, sum(q * t * v) AS e FROM (SELECT *, greatest(v / (v + 35.0), 0.05) * greatest(v / (v + 35.0), 0.05) AS q FROM ev) GROUP BY k)
SELECT k, round((a * e - b * d) / (a * c - b * b), 6) AS slope, round((d - (a * e - b * d) / (a * c - b * b) * b) / a, 6) AS intercept FROM s""")
def weighted_line(spark, sf_dir):
    return robust.weighted_line(events(spark, sf_dir).withColumn("w", F.greatest(conf(), F.lit(0.05))), "k", "t", "v", "w")


@query("WITH {ev}, w AS (SELECT *, greatest(v / (v + 35.0), 0.01) AS w FROM ev) SELECT i, round(sum(v * w) OVER q / sum(w) OVER q, 6) AS smooth FROM w WINDOW q AS (PARTITION BY k ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def weighted_smooth5(spark, sf_dir):
    return robust.weighted_smooth(events(spark, sf_dir).withColumn("w", conf()), "k", "t", "v", "w").select("i", "smooth")


BAND = "band AS (SELECT *, CASE WHEN v / (v + 35.0) >= 0.6 AND abs(v) >= 40 THEN 'high' WHEN v / (v + 35.0) >= 0.4 AND abs(v) >= 20 THEN 'medium' ELSE 'low' END AS band FROM ev)"


def banded(spark, sf_dir):
    return events(spark, sf_dir).withColumn("band", series.certainty_band(conf(), F.abs("v"), (0.6, 40.0), (0.4, 20.0)))


@query("WITH {ev}, " + BAND + """, g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY t) AS run FROM (SELECT *, lead(t) OVER w AS nxt, CASE WHEN band = 'low' AND coalesce(lag(band) OVER w, '') <> 'low' THEN 1 ELSE 0 END AS new FROM band WINDOW w AS (PARTITION BY k ORDER BY t)))
SELECT k, round(min(t), 6) AS start, round(max(coalesce(nxt, t)), 6) AS stop, count(*) AS n FROM g WHERE band = 'low' GROUP BY k, run""")
def certainty_islands(spark, sf_dir):
    return series.islands(banded(spark, sf_dir), "k", "t", F.col("band") == "low")


@query("WITH {ev}, " + BAND + """, p AS (SELECT *, avg(v) OVER (PARTITION BY k) AS line,
  last_value(CASE WHEN band = 'high' THEN t END IGNORE NULLS) OVER b AS pt, last_value(CASE WHEN band = 'high' THEN v END IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN band = 'high' THEN t END IGNORE NULLS) OVER a AS nt, first_value(CASE WHEN band = 'high' THEN v END IGNORE NULLS) OVER a AS nv FROM band
  WINDOW b AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY k ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT i, band, round(CASE band WHEN 'high' THEN v WHEN 'medium' THEN coalesce(pv + (nv - pv) * (t - pt) / (nt - pt), pv, nv, line) ELSE line END, 6) AS target FROM p""")
def certainty_lags(spark, sf_dir):
    d = banded(spark, sf_dir)
    d = d.join(d.groupBy("k").agg(F.avg("v").alias("line")), "k")
    return series.certain_lags(d, "k", "t", "v", "band", "line").select("i", "band", "target")


@query("""WITH {ev}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS j FROM ev)
SELECT i, round(max(t - v / 10 - j * 1e-4) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) + j * 1e-4, 6) AS mono FROM n""")
def monotone_src(spark, sf_dir):
    return series.monotone(events(spark, sf_dir).withColumn("src", F.col("t") - F.col("v") / 10), "k", "t", "src").select("i", "mono")


@query("WITH {ev} SELECT k, floor(t / 24)::BIGINT AS block, round(sqrt(avg(v * v)), 6) AS rms, round(min(v), 6) AS low, round(max(v), 6) AS high FROM ev GROUP BY 1, 2")
def rms_envelope(spark, sf_dir):
    return series.envelope(events(spark, sf_dir), "k", "t", "v", 24.0)


@query("""WITH {ev}, p AS (SELECT k, floor(t / 24) AS b, kind = 'view' AS q, max(abs(v)) AS p FROM ev WHERE kind IN ('view', 'click') GROUP BY 1, 2, 3),
l AS (SELECT k, greatest(quantile_cont(p, 0.95) FILTER (q), 1e-8) AS stem, greatest(quantile_cont(p, 0.95) FILTER (NOT q), 1e-8) AS ref FROM p GROUP BY k)
SELECT k, round(stem, 6) AS stem, round(ref, 6) AS ref, round(least(greatest(ref / stem, 0.125), 8.0), 6) AS gain FROM l WHERE stem IS NOT NULL AND ref IS NOT NULL""")
def loudness_gain(spark, sf_dir):
    p = events(spark, sf_dir).where("kind in ('view', 'click')").groupBy("k", F.floor(F.col("t") / 24).alias("b"), (F.col("kind") == "view").alias("q")).agg(F.max(F.abs("v")).alias("p"))
    level = lambda on: F.percentile(F.when(F.col("q") if on else ~F.col("q"), F.col("p")), 0.95)
    floor = lambda c: F.greatest(c, F.lit(1e-8))
    d = p.groupBy("k").agg(floor(level(True)).alias("stem"), floor(level(False)).alias("ref"))
    return d.withColumn("gain", F.least(F.greatest(F.col("ref") / F.col("stem"), F.lit(0.125)), F.lit(8.0)))


@query("""WITH {ev}, d AS (SELECT k, t, v, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, v - lag(v) OVER w AS x, lead(v) OVER w - v AS y FROM ev WINDOW w AS (PARTITION BY k ORDER BY t))
SELECT k, round(coalesce(avg(abs(2 * (y / b - x / a) / (a + b))) FILTER (a IS NOT NULL AND b IS NOT NULL), 0), 6) AS smoothness FROM d GROUP BY k""", digits=6)
def warp_smoothness(spark, sf_dir):
    return series.smoothness(events(spark, sf_dir), "k", "t", "v")


HOURLY = """h AS (SELECT kind, floor(t)::BIGINT AS f, sum(v) AS v FROM ev GROUP BY 1, 2), c AS (SELECT kind, f, v - avg(v) OVER w AS v, sum(v * v) OVER w - count(*) OVER w * avg(v) OVER w * avg(v) OVER w AS e FROM h WINDOW w AS (PARTITION BY kind)),
x AS (SELECT 0 AS k, lag, sum(q.v * r.v) / sqrt(greatest(any_value(q.e * r.e), 1e-12)) AS score, count(*) AS n FROM c q, range(-24, 25) g(lag), c r WHERE q.kind = 'click' AND r.kind = 'view' AND r.f = q.f + lag GROUP BY lag)"""


def scanned(spark, sf_dir):
    return correlate.lag_scan(hourly(spark, sf_dir, "view"), hourly(spark, sf_dir, "click"), ["k"], "f", "v", 24)


@query("WITH {ev}, " + HOURLY + " SELECT k, lag::INT AS lag, round(score, 6) AS score, n FROM x")
def xcorr_lag_scan(spark, sf_dir):
    return scanned(spark, sf_dir)


@query("WITH {ev}, " + HOURLY + """, b AS (SELECT lag AS best_lag, score AS best FROM x ORDER BY score DESC, lag LIMIT 1), s AS (SELECT lag, score FROM x, b WHERE abs(lag - best_lag) >= 3 ORDER BY score DESC, lag LIMIT 1)
SELECT 0 AS k, best_lag::INT AS best_lag, round(best, 6) AS best, lag::INT AS second_lag, round(score, 6) AS second FROM b, s""")
def best_and_second(spark, sf_dir):
    return correlate.best_and_second(scanned(spark, sf_dir), ["k"], "lag", "score", 3)


@query("WITH {ev}, " + HOURLY + """, w AS (SELECT *, lag(score) OVER (ORDER BY lag) AS a, lead(score) OVER (ORDER BY lag) AS c FROM x), b AS (SELECT * FROM w ORDER BY score DESC, lag LIMIT 1)
SELECT 0 AS k, lag::INT AS lag, round(lag + coalesce(CASE WHEN abs(a - 2 * score + c) > 1e-12 THEN greatest(-1, least(1, 0.5 * (a - c) / (a - 2 * score + c))) ELSE 0 END, 0), 6) AS peak FROM b""")
def parabolic_peak(spark, sf_dir):
    return correlate.parabolic(scanned(spark, sf_dir), ["k"], "lag", "score")


@query("""WITH {ev}, c0 AS (SELECT k, kind AS feature, avg(v) / 100 AS lag, max(v) / (max(v) + 35.0) AS best, quantile_cont(v, 0.5) / (quantile_cont(v, 0.5) + 35.0) AS second FROM ev GROUP BY 1, 2),
c1 AS (SELECT *, 0.25 * CASE feature WHEN 'click' THEN 1.5 WHEN 'view' THEN 1.15 WHEN 'purchase' THEN 0.55 ELSE 1.0 END AS w0 FROM c0 WHERE best > 0.02),
c AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY k) AS w, greatest(w0 / sum(w0) OVER (PARTITION BY k) * best, 1e-6) AS x FROM c1),
g AS (SELECT *, sum(CASE WHEN step > 0.04 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lag, best, second, w) AS cl FROM (SELECT *, lag - lag(lag) OVER (PARTITION BY k ORDER BY lag, best, second, w) AS step FROM c)),
a AS (SELECT k, cl, sum(x) AS x, sum(x * lag) / sum(x) AS lag, sum(x * best) / sum(x) AS score, sum(x * second) / sum(x) AS second FROM g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x DESC, cl) AS rn FROM a),
o AS (SELECT k, max(lag) FILTER (rn = 1) AS fl, max(score) FILTER (rn = 1) AS fs, greatest(coalesce(max(score) FILTER (rn = 2), 0), max(second) FILTER (rn = 1)) AS ss FROM r GROUP BY k)
SELECT k, round(fl, 6) AS fused_lag, round(fs, 6) AS fused_score, round(ss, 6) AS second_score, round(greatest(0, fs - ss), 6) AS margin FROM o""")
def fuse_candidates(spark, sf_dir):
    share = lambda c: c / (c + 35.0)
    ev = events(spark, sf_dir)
    c = series.summed(ev, ["k", "kind"], "i", {"s": F.col("v")}, F.count("v").alias("n"), share(F.max("v")).alias("best"), share(series.quantile(F.col("v"), 0.5)).alias("second"))
    c = c.withColumn("lag", F.try_divide("s", "n") / 100)
    feature = F.when(F.col("kind") == "click", "onset").when(F.col("kind") == "view", "wave").when(F.col("kind") == "purchase", "chroma").otherwise("other")
    return correlate.fuse(c.withColumn("w", correlate.context_weight(feature, F.lit(Decimal("0.25")), F.lit(True))), "k")


NEAR = "pc AS (SELECT p.k, p.i, p.t, (SELECT max(t) FROM ev c WHERE c.k = p.k AND kind = 'click' AND c.t <= p.t) AS a, (SELECT min(t) FROM ev c WHERE c.k = p.k AND kind = 'click' AND c.t >= p.t) AS b FROM ev p WHERE kind = 'purchase'), near AS (SELECT *, CASE WHEN b IS NULL OR t - a <= b - t THEN a ELSE b END AS near FROM pc)"


def of_kind(spark, sf_dir, kind):
    return events(spark, sf_dir).where(F.col("kind") == kind).drop("kind")


@query("WITH {ev}, " + NEAR + " SELECT i, round(near, 6) AS near, round(CASE WHEN abs(near - t) <= 6 THEN near END, 6) AS near_within FROM near")
def nearest_event(spark, sf_dir):
    q, e = of_kind(spark, sf_dir, "purchase"), of_kind(spark, sf_dir, "click").select("k", "t")
    return series.nearest(q, e, "k", "t").select("i", "near", F.when(F.abs(F.col("near") - F.col("t")) <= 6, F.col("near")).alias("near_within"))


@query("""WITH {ev}, e AS (SELECT k, i, t, v, kind FROM ev WHERE kind IN ('purchase', 'click')), w AS (SELECT *, last_value(CASE WHEN kind = 'click' THEN t END IGNORE NULLS) OVER b AS pt, last_value(CASE WHEN kind = 'click' THEN v END IGNORE NULLS) OVER b AS pv,
first_value(CASE WHEN kind = 'click' THEN t END IGNORE NULLS) OVER a AS nt, first_value(CASE WHEN kind = 'click' THEN v END IGNORE NULLS) OVER a AS nv FROM e WINDOW b AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT i, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt = pt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END, 6) AS interp FROM w WHERE kind = 'purchase'""")
def interp_at(spark, sf_dir):
    return series.interpolate(of_kind(spark, sf_dir, "purchase").drop("v"), of_kind(spark, sf_dir, "click").select("k", "t", "v"), "k", "t", "v").select("i", "interp")


GAPS = "gp AS (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS g FROM ev WHERE kind = 'click'), per AS (SELECT k, coalesce(quantile_cont(g, 0.5) FILTER (g > 0.2 AND g < 400), 0) AS period FROM gp GROUP BY k)"


@query("WITH {ev}, " + NEAR + ", " + GAPS + " SELECT k, round(avg(coalesce(greatest(0, 1 - abs(near - t) / greatest(0.35 * period, 1e-9)), 0)), 6) AS score, count(*) AS n FROM near JOIN per USING (k) GROUP BY k")
def beat_alignment(spark, sf_dir):
    return beats.alignment_score(of_kind(spark, sf_dir, "purchase").select("k", "t"), of_kind(spark, sf_dir, "click").select("k", "t"), "k", "t", 0.2, 400.0)


@query("""WITH {ev}, g AS (SELECT k, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS g FROM ev WHERE kind = 'click') SELECT k, round(coalesce(quantile_cont(g, 0.5) FILTER (g > 0.2 AND g < 400), 0), 6) AS first_period,
round(CASE WHEN count(*) FILTER (g > 1 AND g < 200) >= 3 THEN quantile_cont(g, 0.5) FILTER (g > 1 AND g < 200) ELSE 0.5 END, 6) AS strict_period FROM g GROUP BY k""")
def beat_period(spark, sf_dir):
    clicks = of_kind(spark, sf_dir, "click")
    loose = beats.period(clicks, "k", "t", 0.2, 400.0).withColumnRenamed("period", "first_period")
    return loose.join(beats.period(clicks, "k", "t", 1.0, 200.0, 3, 0.5).withColumnRenamed("period", "strict_period"), "k")


@query("WITH {ev}, d AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ev) SELECT k, round(t, 6) AS mark FROM d WHERE n > 8 AND i > 0 AND i % 8 = 0")
def bar_marks(spark, sf_dir):
    return beats.bar_marks(events(spark, sf_dir), "k", "t")


@query("WITH {ev}, w AS (SELECT i, k, t, v, lag(v) OVER q AS a, lead(v) OVER q AS b FROM ev WINDOW q AS (PARTITION BY k ORDER BY t)), m AS (SELECT k, greatest(1.8 * quantile_cont(v, 0.5), 1e-4) AS thr FROM ev GROUP BY k) SELECT k, round(t, 6) AS t, round(v, 6) AS v FROM w JOIN m USING (k) WHERE v > thr AND v > a AND v >= b")
def onset_peaks(spark, sf_dir):
    return beats.onset_peaks(events(spark, sf_dir), "k", "t", "v")


@query("WITH {ev}, w AS (SELECT i, k, t, lag(t) OVER (PARTITION BY k ORDER BY t) AS p FROM ev) SELECT i, k FROM w WHERE p IS NULL OR t - p > 2")
def clean_beats(spark, sf_dir):
    return beats.cleaned(events(spark, sf_dir), "k", "t", 2.0).select("i", "k")


CHECK = "pts AS (SELECT k, t * 10 AS t, v - 35 AS lag, v > 300 AS railed FROM ev WHERE kind = 'click'), coarse AS (SELECT k, avg(v) - 35 AS coarse_lag FROM ev GROUP BY k)"


def checkpoints(spark, sf_dir):
    ev = events(spark, sf_dir)
    points = ev.where("kind = 'click'").select("k", (F.col("t") * 10).alias("t"), (F.col("v") - 35).alias("lag"), (F.col("v") > 300).alias("railed"))
    return points, ev.groupBy("k").agg((F.avg("v") - 35).alias("coarse_lag"))


GATE = "gate AS (SELECT k, coalesce(n, 0) AS n, worst, CASE WHEN coalesce(n, 0) > 0 THEN CASE WHEN worst > 150 OR rail = 1 THEN 'fail' ELSE 'pass' END WHEN abs(coarse_lag) > 50 THEN 'fail' ELSE 'pass' END AS verdict FROM coarse LEFT JOIN (SELECT k, count(*) AS n, max(abs(lag)) AS worst, max(railed::INT) AS rail FROM pts GROUP BY k) USING (k))"


@query("WITH {ev}, " + CHECK + ", " + GATE + " SELECT k, n, round(worst, 6) AS worst, verdict FROM gate")
def offset_gate(spark, sf_dir):
    return quality.offset_gate(*checkpoints(spark, sf_dir), "k", 150.0, 50.0)


@query("WITH {ev}, " + CHECK + ", " + GATE + " SELECT verdict, count(*) AS n FROM gate GROUP BY verdict")
def verdict_histogram(spark, sf_dir):
    return quality.offset_gate(*checkpoints(spark, sf_dir), "k", 150.0, 50.0).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""WITH {ev}, v AS (SELECT k, avg(v) FILTER (kind = 'click') - 40 AS lv, avg(v) FILTER (kind = 'view') - 40 AS li, avg(v) - 40 AS m FROM ev GROUP BY k), j AS (SELECT *, CASE WHEN abs(lv) <= 25 THEN 'pass' WHEN lv IS NOT NULL THEN 'fail' END AS a, CASE WHEN abs(li) <= 25 THEN 'pass' WHEN li IS NOT NULL THEN 'fail' END AS b, CASE WHEN abs(m) <= 4 THEN 'pass' ELSE 'fail' END AS x FROM v)
SELECT k, CASE WHEN coalesce(a = 'fail', false) OR coalesce(b = 'fail', false) THEN 'fail' WHEN coalesce(a = 'pass' AND b = 'pass', false) THEN 'pass' ELSE 'error' END AS verdict, coalesce(a = 'pass' AND b = 'pass' AND x = 'fail' AND lv * li < 0 AND least(abs(lv), abs(li)) >= 0.005, false) AS compensating FROM j""")
def combine_verdicts(spark, sf_dir):
    ev = events(spark, sf_dir)
    some = {"lv": F.when(F.col("kind") == "click", F.col("v")), "li": F.when(F.col("kind") == "view", F.col("v")), "m": F.col("v")}
    d = series.summed(ev, ["k"], "i", some, *(F.count(v).alias(f"n_{name}") for name, v in some.items()))
    d = d.select("k", *((F.try_divide(name, f"n_{name}") - 40).alias(name) for name in some))
    verdict = lambda c, limit: F.when(F.abs(c) <= limit, "pass").when(F.col(c).isNotNull(), "fail")
    a, b, x = verdict("lv", 25), verdict("li", 25), verdict("m", 4)
    return d.select("k", quality.combined(a, b).alias("verdict"), quality.compensating(a, b, x, F.col("lv"), F.col("li")).alias("compensating"))


@query("WITH {ev}, g AS (SELECT k, avg(v) - 40 AS o, regr_slope(v, t) AS s, max(v) AS m FROM ev GROUP BY k) SELECT k, 'OFFSET_TOO_LARGE' AS code, round(abs(o), 6) AS value FROM g WHERE abs(o) >= 5 UNION ALL SELECT k, 'DRIFT_TOO_LARGE', round(abs(s), 6) FROM g WHERE abs(s) >= 0.02 UNION ALL SELECT k, 'DISCONTINUITY', round(abs(m), 6) FROM g WHERE abs(m) >= 200")
def quality_codes(spark, sf_dir):
    ev = events(spark, sf_dir)
    d = series.summed(ev, ["k"], "i", {"o": F.col("v")}, F.count("v").alias("n"), F.regr_slope("v", "t").alias("s"), F.max("v").alias("m"))
    d = d.withColumn("o", F.try_divide("o", "n") - 40)
    return quality.failure_codes(d, "k", {"OFFSET_TOO_LARGE": ("o", 5.0), "DRIFT_TOO_LARGE": ("s", 0.02), "DISCONTINUITY": ("m", 200.0)})


@query("WITH {ev} SELECT i, CASE WHEN abs(v / 4) <= 3 THEN 'excellent' WHEN abs(v / 4) <= 5 THEN 'good' WHEN abs(v / 4) <= 10 THEN 'acceptable' WHEN abs(v / 4) <= 20 THEN 'suspect' ELSE 'bad' END AS grade FROM ev")
def offset_grade(spark, sf_dir):
    return events(spark, sf_dir).select("i", quality.grade(F.col("v") / 4).alias("grade"))


CLOCK = "floor({x} / 60)::BIGINT || ':' || lpad(({x} % 60)::VARCHAR, 2, '0')"
SECS = "round_even(greatest({y}, 0), 0)::BIGINT"


@query("WITH {ev} SELECT i, " + CLOCK.replace("{x}", SECS.replace("{y}", "t * 10")) + " AS clock FROM ev")
def clock_text(spark, sf_dir):
    return events(spark, sf_dir).select("i", quality.clock(F.col("t") * 10).alias("clock"))


@query("WITH {ev}, " + CHECK + """, s AS (SELECT *, CASE WHEN abs(lag) > 40 THEN sign(lag) ELSE 0 END AS s FROM pts), g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> s THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY t) AS p FROM s)),
r AS (SELECT k, run, min(t) AS a, max(t) AS b, min(lag) AS lo, max(lag) AS hi FROM g WHERE s <> 0 GROUP BY 1, 2)
SELECT k, string_agg(""" + CLOCK.replace("{x}", SECS.replace("{y}", "a - 4")) + " || '-' || " + CLOCK.replace("{x}", SECS.replace("{y}", "b + 4")) + " || ' ' || round_even(lo, 0)::BIGINT || '..' || round_even(hi, 0)::BIGINT, ', ' ORDER BY run) AS text FROM r GROUP BY k")
def drift_ranges_text(spark, sf_dir):
    return quality.drift_ranges(checkpoints(spark, sf_dir)[0], "k", "t", "lag", 40.0)


TWO = "a AS (SELECT k, count(*) AS n, max(v) AS worst, min(v) AS sure FROM ev WHERE kind = 'click' AND v > 20 GROUP BY k), b AS (SELECT k, count(*) AS n, max(v) AS worst, min(v) AS sure FROM ev WHERE kind = 'view' AND v > 60 GROUP BY k)"


def two_reports(spark, sf_dir):
    one = lambda kind, low: events(spark, sf_dir).where((F.col("kind") == kind) & (F.col("v") > low)).groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("worst"), F.min("v").alias("sure"))
    return one("click", 20), one("view", 60)


@query("WITH {ev}, " + TWO + " SELECT coalesce(a.k, b.k) AS k, round(least(a.sure, b.sure), 6) AS sure, round(greatest(a.worst, b.worst), 6) AS worst, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.k = b.k")
def report_full_outer(spark, sf_dir):
    return quality.combine_reports(*two_reports(spark, sf_dir), "k", ["sure"], ["worst"], ["n"])


@query("WITH {ev}, " + TWO + " SELECT coalesce(a.k, b.k) AS k, coalesce(b.n, a.n) AS n, round(coalesce(b.worst, a.worst), 6) AS worst FROM a FULL JOIN b ON a.k = b.k")
def upsert_keep_pads(spark, sf_dir):
    return quality.upsert(*two_reports(spark, sf_dir), "k", ["n", "worst"])


def placed(spark, sf_dir):
    d = day_spans(spark, sf_dir)
    return d.withColumns({"src_a": F.col("a") - 1000, "src_b": F.col("b") - 1000, "dst_a": F.col("a"), "dst_b": F.col("a") + (F.col("b") - F.col("a")) * 2, "dur": F.lit(900.0)})


@query("""WITH {sp}, c AS (SELECT *, greatest(a - 1000, 0) AS sa, least(b - 1000, 900) AS sb, (b - a) * 2 / greatest(b - a, 1e-9) AS rate FROM sp)
SELECT o, l, round(sa, 6) AS src_a, round(sb, 6) AS src_b, round(a + (sa - (a - 1000)) * rate, 6) AS dst_a, round(a + (b - a) * 2 - (b - 1000 - sb) * rate, 6) AS dst_b FROM c WHERE sb - sa >= 0.02""")
def span_trim(spark, sf_dir):
    return spans.trim_to(placed(spark, sf_dir), "dur", 0.02).select("o", "l", "src_a", "src_b", "dst_a", "dst_b")


@query("WITH {sp} SELECT o, l, round(greatest(a, least(b, coalesce(lead(a) OVER w, b))), 6) AS clipped, round(b + least(5.0, greatest(0, coalesce(lead(a) OVER w - b, 5.0))), 6) AS tail FROM sp WINDOW w AS (PARTITION BY k ORDER BY a, b, o, l)")
def span_clip_and_tails(spark, sf_dir):
    order = ["a", "b", "o", "l"]
    return spans.with_tails(spans.clip_overlaps(day_spans(spark, sf_dir), "k", "a", "b", order), "k", "a", "b", 5.0, order).select("o", "l", "clipped", "tail")


@query("WITH {sp}, w AS (SELECT k, a, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp) SELECT k, round(r, 6) AS gap_start, round(a, 6) AS gap_stop FROM w WHERE a - r > 30")
def span_gaps(spark, sf_dir):
    return spans.gaps(day_spans(spark, sf_dir), "k", "a", "b", 30.0)


@query("""WITH {sp}, n AS (SELECT o, l, a, b, greatest(2, round_even((b - a) / 20, 0)::INT + 1) AS n FROM sp) SELECT o, l, round(a + (b - a) * j / (n - 1), 6) AS at FROM (SELECT *, unnest(range(0, n)) AS j FROM n)""")
def span_samples(spark, sf_dir):
    return spans.samples(day_spans(spark, sf_dir), "a", "b", 20.0).select("o", "l", "at")


@query("WITH {sp}, q AS (SELECT DISTINCT k, o AS q, a AS t FROM sp) SELECT q, count(*) AS n, round(max(b), 6) AS reach FROM q JOIN sp USING (k) WHERE t >= a AND t <= b GROUP BY q")
def span_contains(spark, sf_dir):
    d = day_spans(spark, sf_dir)
    q = d.select("k", F.col("o").alias("q"), F.col("a").alias("t")).distinct()
    return spans.covering(q, d, "k", "t", "a", "b", 60.0).groupBy("q").agg(F.count("*").alias("n"), F.max("b").alias("reach"))


@query("WITH {ev}, g AS (SELECT i, k, t, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS g FROM ev) SELECT i, round(coalesce(sum(CASE WHEN abs(g) <= 2 THEN g END) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING), 0), 6) AS shift FROM g")
def snap_inserts(spark, sf_dir):
    from pyspark.sql import Window

    d = events(spark, sf_dir).withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("k").orderBy("t")))
    return spans.snap_inserts(d, "k", "t", "g", 2.0).select("i", "shift")


@query("""WITH RECURSIVE {ev}, n AS (SELECT k, t, v, row_number() OVER (PARTITION BY k ORDER BY t, v) AS j FROM ev),
f AS (SELECT k, t, v, j, v AS held, true AS mark FROM n WHERE j = 1 UNION ALL SELECT n.k, n.t, n.v, n.j, CASE WHEN abs(n.v - f.held) >= 60 THEN n.v ELSE f.held END, abs(n.v - f.held) >= 60 FROM f JOIN n ON n.k = f.k AND n.j = f.j + 1)
SELECT k, round(t, 6) AS t, round(v, 6) AS v FROM f WHERE mark""")
def lag_step_marks(spark, sf_dir):
    return spans.stepped_marks(events(spark, sf_dir), "k", "t", "v", 60.0)


NAMES = "names AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 7 WHEN 0 THEN ' (Original Song)' WHEN 1 THEN ' (Acapella)' WHEN 2 THEN ' (Karaoke Vocals)' WHEN 3 THEN ' instrumental' WHEN 4 THEN ' vocals' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.flac' ELSE '.WAV' END AS name, p_name || CASE p_partkey % 3 WHEN 0 THEN '_[PASS]' WHEN 1 THEN '_[fail]' ELSE '' END AS folder FROM part)"


@query("WITH " + NAMES + r""", s AS (SELECT id, folder, name, lower(name) AS n, regexp_replace(lower(name), '\.(wav|flac|mp3|m4a|ogg|aiff|aif)$', '') AS stem FROM names), p AS (SELECT *, array_to_string(regexp_extract_all(stem, '\(([^)]+)\)', 1), '|') AS q FROM s)
SELECT id, CASE WHEN NOT regexp_matches(n, '\.(wav|flac|mp3|m4a|ogg|aiff|aif)$') THEN NULL WHEN contains(q, 'original') THEN 'original' WHEN regexp_matches(q, 'instrumental|karaoke') THEN 'instrumental' WHEN regexp_matches(q, 'acapella|vocals') THEN 'acapella' WHEN regexp_matches(stem, 'instrumental|karaoke') THEN 'instrumental' WHEN regexp_matches(stem, 'acapella|vocals') THEN 'acapella' END AS role,
regexp_replace(folder, '_\[(pass|fail)\]$', '', 'i') AS bare, nullif(lower(regexp_extract(folder, '_\[(pass|fail)\]$', 1, 'i')), '') AS tag, substr(sha1(concat_ws('|', folder, id::VARCHAR)), 1, 16) AS cache_key FROM p""")
def classify_role(spark, sf_dir):
    key = F.col("p_partkey")
    ends = lambda n, values: F.coalesce(F.get(F.array(*map(F.lit, values)), (key % n).cast("int")), F.lit(""))
    name = F.concat("p_name", ends(7, [" (Original Song)", " (Acapella)", " (Karaoke Vocals)", " instrumental", " vocals", "", ""]), ends(5, [".txt", ".flac", ".WAV", ".WAV", ".WAV"]))
    folder = F.concat("p_name", ends(3, ["_[PASS]", "_[fail]", ""]))
    d = table(spark, sf_dir, "part").select(key.alias("id"), name.alias("name"), folder.alias("folder"))
    return d.select("id", naming.role(F.col("name")).alias("role"), naming.without_tag(F.col("folder")).alias("bare"), naming.tag_of(F.col("folder")).alias("tag"), naming.cache_key(F.col("folder"), F.col("id").cast("string")).alias("cache_key"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) * x))), 4) AS norm, round((embedding[1]::DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE) * x))), 1e-9), 4) AS first FROM embeddings")
def l2_normalise(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    d = d.select("vec_id", norm.alias("norm"), F.transform("embedding", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-9))).alias("unit"))
    return d.select("vec_id", F.round("norm", 4).alias("norm"), F.round(F.get("unit", F.lit(0)), 4).alias("first"))


# Points of the lag path with their pull, weight and band, a row for each place of a key's grid, and the cheapest way to each
# place from those of the point before.
PATH = """p0 AS (SELECT k, t * 3600 AS t, v / 1000 AS lag, v / (v + 35.0) AS conf, v / 500 AS margin, avg(v / 1000) OVER (PARTITION BY k) AS line FROM ev),
p1 AS (SELECT *, margin >= 0.12 AND conf >= 0.45 AS sure, margin >= 0.12 AS sudden, row_number() OVER (PARTITION BY k ORDER BY t, lag) AS i, t - lag(t) OVER (PARTITION BY k ORDER BY t, lag) AS dt FROM p0),
p2 AS (SELECT *, CASE WHEN NOT sure AND conf < 0.25 THEN line ELSE lag END AS pull, CASE WHEN sure THEN 0.5 WHEN margin >= 0.04 AND conf >= 0.25 THEN 0.15 ELSE 0.05 END AS half FROM p1),
p3 AS (SELECT *, CASE WHEN sure THEN least(line - half, lag - 0.03) ELSE line - half END AS bottom, CASE WHEN sure THEN greatest(line + half, lag + 0.03) ELSE line + half END AS top, lag(sure) OVER (PARTITION BY k ORDER BY i) AS was FROM p2),
g0 AS (SELECT k, min(least(pull, line, lag)) - 0.05 AS low, max(greatest(pull, line, lag)) + 0.05 AS high, count(*) AS n FROM p3 GROUP BY k), g1 AS (SELECT *, greatest(0.005, greatest(high - low, 0.05) / 80) AS step FROM g0),
c0 AS (SELECT k, n, low, step, unnest(range(0, ceil((high + step / 2 - low) / step)::BIGINT)) AS j FROM g1),
c1 AS (SELECT k, i, j, step, greatest(dt, 1e-3) AS dt, sudden OR was AS jump, (0.25 + conf) * ((low + step * j - pull) / 0.02) * ((low + step * j - pull) / 0.02) AS own, low + step * j >= bottom AND low + step * j <= top AS inside FROM p3 JOIN c0 USING (k)),
cells AS MATERIALIZED (SELECT * EXCLUDE (own, inside), CASE WHEN inside OR NOT bool_or(inside) OVER (PARTITION BY k, i) THEN own ELSE 1e9 END AS own FROM c1),
f AS (SELECT k, i, j, own AS total, -1::BIGINT AS came FROM cells WHERE i = 1 UNION ALL
SELECT k, i, j, own + CASE WHEN a.c >= 5e8 THEN b.c ELSE a.c END, CASE WHEN a.c >= 5e8 THEN b.p ELSE a.p END FROM (
 SELECT c.k, c.i, c.j, any_value(c.own) AS own,
  min({'c': f.total + CASE WHEN c.step * (c.j - f.j) > c.dt - 1e-3 THEN 1e9 WHEN abs(c.step * (c.j - f.j)) <= 0.08 * c.dt + 1e-9 THEN 0 WHEN c.jump AND abs(c.step * (c.j - f.j)) >= 0.04 THEN 0.5 * abs(c.step * (c.j - f.j)) / 0.02 ELSE 1e9 END, 'p': f.j}) AS a,
  min({'c': f.total + CASE WHEN c.step * (c.j - f.j) <= c.dt - 1e-3 THEN 0.15 * abs(c.step * (c.j - f.j)) / 0.02 ELSE 1e9 END, 'p': f.j}) AS b
 FROM f JOIN cells c ON c.k = f.k AND c.i = f.i + 1 GROUP BY c.k, c.i, c.j)),
fm AS MATERIALIZED (SELECT * FROM f),
w AS (SELECT k, i, (min({'c': total, 'j': j})).j AS j FROM fm JOIN g1 USING (k) WHERE i = n GROUP BY k, i UNION ALL SELECT w.k, w.i - 1, fm.came FROM w JOIN fm ON fm.k = w.k AND fm.i = w.i AND fm.j = w.j WHERE w.i > 1)"""


@query("WITH RECURSIVE {ev}, " + PATH + " SELECT w.k, round(t, 6) AS t, round(CASE WHEN n < 2 THEN lag ELSE low + step * j END, 9) AS solved FROM w JOIN g1 USING (k) JOIN p3 ON p3.k = w.k AND p3.i = w.i", digits=9)
def constrained_path(spark, sf_dir):
    d = events(spark, sf_dir).select("k", (F.col("t") * 3600).alias("t"), (F.col("v") / 1000).alias("lag"), conf().alias("conf"), (F.col("v") / 500).alias("margin"), F.lit(0.0).alias("beat"))
    line = d.groupBy("k").agg(F.avg("lag").alias("line"))
    return solvers.constrained_path(d.join(line, "k"), "k").withColumn("t", F.round("t", 6))


@query("""WITH RECURSIVE {ev}, p AS (SELECT k, t / 10 AS t, v / 1000 AS lag, row_number() OVER (PARTITION BY k ORDER BY t, v) AS j FROM ev),
f AS (SELECT k, j, t, lag, NULL::DOUBLE AS rate, 0::DOUBLE AS moved, t - lag AS free, t - lag AS made FROM p WHERE j = 1 UNION ALL
SELECT k, j, t, lag, rate, moved, free, greatest(CASE WHEN abs(moved) >= 0.04 THEN t - lag ELSE free END, made + 1e-4) FROM (
 SELECT *, f0 + rate * dt + least(1.0, dt / 1.5) * (t - lag - (f0 + rate * dt)) AS free FROM (
 SELECT p.k, p.j, p.t, p.lag, p.t - f.t AS dt, p.lag - f.lag AS moved, f.free AS f0, f.made,
  CASE WHEN f.rate IS NULL OR abs(p.lag - f.lag) >= 0.04 OR abs(f.moved) >= 0.04 THEN ((p.t - p.lag) - (f.t - f.lag)) / greatest(p.t - f.t, 1e-6)
   ELSE least(greatest(((p.t - p.lag) - (f.t - f.lag)) / greatest(p.t - f.t, 1e-6), f.rate - 0.02), f.rate + 0.02) END AS rate
 FROM f JOIN p ON p.k = f.k AND p.j = f.j + 1)))
SELECT k, round(t, 6) AS t, round(t - made, 6) AS limited FROM f""")
def accel_limit(spark, sf_dir):
    d = events(spark, sf_dir).select("k", (F.col("t") / 10).alias("t"), (F.col("v") / 1000).alias("lag"))
    return solvers.limited(d, "k", 0.02)


# Beats made of a key's events: stretches of 30 of one tempo, a jitter of 2 ms and every 23rd beat 60 ms late; and from each
# beat on the furthest that one period reaches, every end tried.
BEATS = """e0 AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t, i) AS j FROM ev), e1 AS (SELECT k, j, sum(0.5 + 0.02 * ((j // 30 + k) % 3)) OVER (PARTITION BY k ORDER BY j) + (floor(v * 100)::BIGINT % 17 - 8) / 4000.0 + CASE WHEN j % 23 = 11 THEN 0.06 ELSE 0 END AS t FROM e0),
bt AS MATERIALIZED (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, lead(t) OVER (PARTITION BY k ORDER BY t) - t AS g FROM e1),
pr AS (SELECT a.k, a.i AS l, b.i AS r, a.t AS tl, (b.t - a.t) / (b.i - a.i) AS m FROM bt a JOIN bt b ON b.k = a.k AND b.i > a.i JOIN bt c ON c.k = a.k AND c.i = b.i - 1 WHERE b.i <= a.i + 2 OR abs(a.g + c.g - 2 * ((b.t - a.t) / (b.i - a.i))) < 0.0125),
er AS (SELECT pr.k, l, r, c.i, tl + m * (c.i - l) - c.t AS e FROM pr JOIN bt c ON c.k = pr.k AND c.i > l AND c.i <= r), su AS (SELECT *, sum(e) OVER (PARTITION BY k, l, r ORDER BY i) AS s FROM er),
ok AS (SELECT k, l, r FROM su GROUP BY k, l, r HAVING count(*) FILTER (abs(e) > 0.025) <= 1 AND count(*) FILTER (abs(e) > 0.025 AND i = l + 1) = 0 AND max(abs(s)) <= 0.1),
nx AS MATERIALIZED (SELECT bt.k, bt.i AS l, coalesce(max(r), bt.i + 1) AS r FROM bt LEFT JOIN ok ON ok.k = bt.k AND ok.l = bt.i WHERE g IS NOT NULL GROUP BY bt.k, bt.i),
wk AS (SELECT k, l, r FROM nx WHERE l = 0 UNION ALL SELECT nx.k, nx.l, nx.r FROM wk JOIN nx ON nx.k = wk.k AND nx.l = wk.r),
ex AS (SELECT k, l, r FROM wk WHERE r - l >= 16 UNION ALL SELECT k, x, x + 1 FROM (SELECT k, unnest(range(l, r)) AS x FROM wk WHERE r - l < 16)),
rg AS (SELECT ex.k, a.t AS start, b.t AS stop, (b.t - a.t) / (r - l) AS period, r - l AS n FROM ex JOIN bt a ON a.k = ex.k AND a.i = l JOIN bt b ON b.k = ex.k AND b.i = r)"""


def regions(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("j", F.row_number().over(Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "i")))
    # Added up in whole hundredths, exactly as the SQL's decimals: beats may lie on a threshold.
    gap = 50 + 2 * ((F.floor(F.col("j") / 30) + F.col("k")) % 3)
    t = F.sum(gap).over(Window.partitionBy("k").orderBy("j")) / 100.0 + (F.floor(F.col("v") * 100) % 17 - 8) / 4000.0 + F.when(F.col("j") % 23 == 11, 0.06).otherwise(0.0)
    return solvers.constant_regions(d.select("k", t.alias("t")), "k")


@query("WITH RECURSIVE {ev}, " + BEATS + " SELECT k, round(start, 9) AS start, round(stop, 9) AS stop, round(period, 9) AS period, n::BIGINT AS n FROM rg", digits=9)
def iron_beats(spark, sf_dir):
    return regions(spark, sf_dir)


@query("WITH RECURSIVE {ev}, " + BEATS + " SELECT k, round(start + j * period, 9) AS beat FROM (SELECT *, unnest(range(0, n)) AS j FROM rg) UNION ALL SELECT k, round(max(stop), 9) FROM rg GROUP BY k", digits=9)
def ironed_beats(spark, sf_dir):
    return solvers.ironed(regions(spark, sf_dir), "k")


@query("""WITH {ev}, lv AS (SELECT k, max(abs(v)) AS p, quantile_cont(abs(v), 0.2) AS q FROM ev GROUP BY k),
loud AS (SELECT ev.k, t FROM ev JOIN lv USING (k) WHERE abs(v) >= greatest(p * pow(10, -12.0 / 20), CASE WHEN q < 0.35 * p THEN 1.5 * q ELSE 0 END, 1e-4)),
g AS (SELECT *, sum(CASE WHEN gap > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t) AS run FROM (SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY t) AS gap FROM loud))
SELECT k, round(min(t), 6) AS start, round(max(t), 6) AS stop FROM g GROUP BY k, run HAVING max(t) - min(t) >= 6""")
def segments_active(spark, sf_dir):
    return segments.active(events(spark, sf_dir), "k", "t", "v", -12.0, 24.0, 6.0)


@query("""WITH {ev}, g AS (SELECT *, sum(CASE WHEN q AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t) AS run FROM (SELECT *, abs(v) < 30 AS q, lag(abs(v) < 30) OVER w AS p, lead(t) OVER w AS nxt FROM ev WINDOW w AS (PARTITION BY k ORDER BY t))),
r AS (SELECT k, max(coalesce(nxt, t)) - min(t) AS l FROM g WHERE q GROUP BY k, run) SELECT k, round(coalesce(max(l), 0), 6) AS longest FROM (SELECT DISTINCT k FROM ev) LEFT JOIN r USING (k) GROUP BY k""")
def longest_silence(spark, sf_dir):
    return segments.longest_quiet(events(spark, sf_dir), "k", "t", "v", 30.0)


@query("""WITH {sp}, p AS (SELECT k, o, l, a - 1000 AS sa, b - 1000 AS sb, a AS da, a + (b - a) * 2 AS db, b FROM sp), w AS (SELECT *, sa - coalesce(lag(sb) OVER q, 0) AS f, da - coalesce(lag(db) OVER q, 0) AS d FROM p WINDOW q AS (PARTITION BY k ORDER BY da, b, o, l))
SELECT o, l, round(f, 6) AS file_gap, round(d, 6) AS desired, round(d - f, 6) AS "insert" FROM w""")
def gap_plan(spark, sf_dir):
    return segments.gap_plan(placed(spark, sf_dir), "k", ["a", "b", "o", "l"]).select("o", "l", "file_gap", "desired", "insert")


@query("WITH {ev} SELECT k, round(least(greatest(1 - coalesce(regr_slope(v, t), 0), 0.5), 1.5), 6) AS rate FROM ev GROUP BY k")
def stretch_rate(spark, sf_dir):
    return segments.stretch_rate(events(spark, sf_dir), "k", "t", "v")


def markers(spark, sf_dir):
    return events(spark, sf_dir).select("k", (F.col("t") - F.col("v") / 100).alias("src"), F.col("t").alias("dst"))


@query("""WITH {ev}, m AS (SELECT k, t - v / 100 AS s, t AS d FROM ev), r AS (SELECT *, (s - lag(s) OVER w) / (d - lag(d) OVER w) AS r, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS n FROM m WINDOW w AS (PARTITION BY k ORDER BY d))
SELECT k, round(least(720.0, coalesce(CASE WHEN r > 1e-9 THEN d + (719.0 - s) / r END, 720.0)), 6) AS "end" FROM r WHERE n = 1""")
def playback_end(spark, sf_dir):
    return segments.playback_end(markers(spark, sf_dir), "k", "src", "dst", 719.0, 720.0)


@query("""WITH {ev}, f AS (SELECT k, round_even((t - v / 100) * 0.5, 0)::BIGINT AS src_frame, round_even(t * 0.5, 0)::BIGINT AS dst_frame FROM ev),
w AS (SELECT *, max(dst_frame) OVER (PARTITION BY k ORDER BY dst_frame, src_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f) SELECT k, src_frame, dst_frame FROM w WHERE m IS NULL OR dst_frame > m""")
def frame_map(spark, sf_dir):
    return segments.frame_map(markers(spark, sf_dir), "k", "src", "dst", 0.5)


BLOCKS = "bl AS (SELECT k, floor(t / 24)::BIGINT AS block, sqrt(avg(v * v)) AS rms, max(v) AS high FROM ev GROUP BY 1, 2)"


@query("WITH {ev}, " + BLOCKS + ", g AS (SELECT k, greatest(0.35 * quantile_cont(rms, 0.6), 1e-5) AS thr FROM bl GROUP BY k) SELECT k, block, round(rms, 6) AS rms FROM bl JOIN g USING (k) WHERE rms >= thr")
def rms_gate(spark, sf_dir):
    return segments.rms_gate(series.envelope(events(spark, sf_dir), "k", "t", "v", 24.0), "k", "rms").select("k", "block", "rms")


@query("WITH {ev}, " + BLOCKS + ", g AS (SELECT k, quantile_cont(high, 0.95) AS b FROM bl GROUP BY k) SELECT k, round(CASE WHEN any_value(b) < 1e-4 THEN 0 ELSE min(block * 24.0) FILTER (high >= greatest(0.5 * b, 1e-4)) END, 6) AS start FROM bl JOIN g USING (k) GROUP BY k")
def activity_start(spark, sf_dir):
    blocks = series.envelope(events(spark, sf_dir), "k", "t", "v", 24.0).withColumn("at", F.col("block") * 24.0)
    return segments.activity_start(blocks, "k", "at", "high", 0.5)


@query("WITH {ev}, " + CHECK + """, s AS (SELECT *, abs(lag - lag(lag) OVER (PARTITION BY k, railed ORDER BY t)) AS step FROM pts), a AS (SELECT k, max(abs(lag)) FILTER (NOT railed) AS worst, coalesce(max(step) FILTER (NOT railed), 0) AS jump, count(*) FILTER (railed) AS n_railed FROM s GROUP BY k)
SELECT k, round(worst, 6) AS worst, round(jump, 6) AS jump, n_railed, CASE WHEN worst IS NULL THEN 'unresolved' WHEN worst <= 150 THEN 'ok' ELSE 'repair' END AS status FROM a""")
def repair_verdict(spark, sf_dir):
    return segments.repair_verdict(checkpoints(spark, sf_dir)[0], "k", "t", "lag", "railed", 150.0)


@query("""WITH {ev}, b AS (SELECT k, t, row_number() OVER w - 1 AS n, t - lag(t) OVER w AS g, lead(t) OVER w - t AS h, count(*) OVER (PARTITION BY k) AS c FROM ev WHERE kind = 'click' WINDOW w AS (PARTITION BY k ORDER BY t)),
q AS (SELECT i, k, t, (SELECT max(t) FROM b WHERE b.k = p.k AND b.t <= p.t) AS pt, (SELECT min(t) FROM b WHERE b.k = p.k AND b.t >= p.t) AS nt FROM ev p WHERE kind = 'purchase')
SELECT i, round(CASE WHEN coalesce(x.c, y.c, 0) < 2 THEN NULL WHEN pt IS NULL THEN y.n + (q.t - nt) / y.h WHEN nt IS NULL THEN x.n + (q.t - pt) / x.g WHEN nt > pt THEN x.n + (q.t - pt) / (nt - pt) ELSE x.n END, 6) AS phase FROM q LEFT JOIN b x ON x.k = q.k AND x.t = pt LEFT JOIN b y ON y.k = q.k AND y.t = nt""")
def phase_at(spark, sf_dir):
    return segments.phase_at(of_kind(spark, sf_dir, "purchase").select("k", "i", "t"), of_kind(spark, sf_dir, "click").select("k", "t"), "k", "t").select("i", "phase")


BENDS = """g1 AS (SELECT *, coalesce((x / a * b + y / b * a) / (a + b), y / b, x / a) AS d1 FROM (SELECT k, t, v, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, v - lag(v) OVER w AS x, lead(v) OVER w - v AS y FROM ev WINDOW w AS (PARTITION BY k ORDER BY t))),
g2 AS (SELECT *, abs(coalesce((x1 / a * b + y1 / b * a) / (a + b), y1 / b, x1 / a)) * a * (v / (v + 35.0)) AS c FROM (SELECT *, d1 - lag(d1) OVER w AS x1, lead(d1) OVER w - d1 AS y1 FROM g1 WINDOW w AS (PARTITION BY k ORDER BY t))),
n AS (SELECT k, t, v > 300 AS jump, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY k ORDER BY t) AS j, count(*) OVER (PARTITION BY k) AS n FROM g2)"""


@query("WITH RECURSIVE {ev}, " + BENDS + """, f AS (SELECT k, j, n, t, t AS last, 0::DOUBLE AS acc, true AS mark, false AS tail FROM n WHERE j = 1 UNION ALL
SELECT k, j, n, t, CASE WHEN hit THEN t ELSE last END, CASE WHEN hit THEN 0 ELSE bent END, hit, j = n AND t - last > 1e-3 FROM (SELECT n.k, n.j, n.n, n.t, f.last, f.acc + n.c AS bent, (n.jump AND n.t - f.last >= 0.2) OR n.t - f.last >= 30 OR (n.t - f.last >= 8 AND f.acc + n.c >= 0.0015) AS hit FROM f JOIN n ON n.k = f.k AND n.j = f.j + 1))
SELECT k, round(t, 6) AS mark FROM f WHERE mark OR tail""")
def adaptive_ruler(spark, sf_dir):
    d = events(spark, sf_dir).withColumns({"w": conf(), "jump": F.col("v") > 300})
    return series.adaptive_markers(d, "k", "t", "v", "w", "jump", 8.0, 30.0)


@query("WITH {ev}, s AS (SELECT i, v / (v + 35.0) AS c, v / 40 AS r, t FROM ev) SELECT i, round(CASE WHEN r > 1 THEN c * (1 - 1 / r) ELSE 0 END, 6) AS margin, (CASE WHEN r > 1 THEN c * (1 - 1 / r) ELSE 0 END) >= 0.12 AND c >= 0.45 AS high, c < 0.2 OR (CASE WHEN r > 1 THEN c * (1 - 1 / r) ELSE 0 END) < 0.05 AS uncertain, abs(t * 100 - (t * 100 + c)) > 2 AND abs(t * 100 / (t * 100 + c) - 1) > 0.02 AS stretch, round(CASE WHEN abs(r - 1) > 1e-6 THEN r END, 6) AS explicit FROM s")
def scalar_gates(spark, sf_dir):
    d = events(spark, sf_dir).select("i", conf().alias("c"), (F.col("v") / 40).alias("r"), (F.col("t") * 100).alias("n"))
    margin = gates.margin_of_ratio(F.col("c"), F.col("r"))
    return d.select("i", margin.alias("margin"), gates.high_margin(margin, F.col("c")).alias("high"), gates.uncertain(margin, F.col("c")).alias("uncertain"), gates.needs_stretch(F.col("n"), F.col("n") + F.col("c"), 100.0).alias("stretch"), gates.explicit(F.col("r"), F.lit(1.0)).alias("explicit"))


@query("WITH {ev}, " + CHECK + " SELECT k, round(greatest(min(t) - 4, 0), 6) AS start, round(max(t) + 4, 6) AS stop FROM pts WHERE abs(lag) > 40 OR railed GROUP BY k")
def drift_span(spark, sf_dir):
    return quality.drift_span(checkpoints(spark, sf_dir)[0], "k", "t", "lag", "railed", 40.0)


FOLDERS = "fo AS (SELECT p_partkey AS id, lower(p_name) AS stem, p_name || CASE p_partkey % 3 WHEN 0 THEN '_[PASS]' WHEN 1 THEN '_[fail]' ELSE '' END AS folder, CASE p_partkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS tag, CASE WHEN p_size > 25 THEN 'fail' WHEN p_size > 5 THEN 'pass' END AS verdict FROM part)"


def folders(spark, sf_dir):
    ends = F.when(F.col("p_partkey") % 3 == 0, "_[PASS]").when(F.col("p_partkey") % 3 == 1, "_[fail]").otherwise("")
    d = table(spark, sf_dir, "part").withColumn("folder", F.concat("p_name", ends))
    verdict = F.when(F.col("p_size") > 25, "fail").when(F.col("p_size") > 5, "pass")
    return d.select(F.col("p_partkey").alias("id"), F.lower(naming.without_tag(F.col("folder"))).alias("stem"), "folder", naming.tag_of(F.col("folder")).alias("tag"), verdict.alias("verdict"))


@query("WITH " + FOLDERS + ", o AS (SELECT stem, count(*) AS n, CASE WHEN count(tag) = 1 THEN max(folder) FILTER (tag IS NOT NULL) WHEN count(*) = 1 THEN max(folder) END AS found FROM fo GROUP BY stem) SELECT id, coalesce(n, 0) AS n, found FROM fo LEFT JOIN o USING (stem)")
def match_folders(spark, sf_dir):
    d = folders(spark, sf_dir)
    return quality.match_folders(d.select("id", "stem"), d.select("stem", "folder", "tag"), "stem", "tag").select("id", "n", "found")


@query("WITH " + FOLDERS + ", r AS (SELECT coalesce(tag, verdict) AS r FROM fo) SELECT count(r) AS total, count(*) FILTER (r = 'fail') AS failed, round((count(r) - count(*) FILTER (r = 'fail')) / count(r), 6) AS accuracy FROM r")
def accuracy(spark, sf_dir):
    return quality.accuracy(folders(spark, sf_dir), "tag", "verdict")
