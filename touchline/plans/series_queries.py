"""Time-series operators on the events table (series by user), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.scalar import soft_threshold
from touchline.operators import timeseries as ts
from touchline.sources.tables import EVENT_SERIES_SQL, event_series

H = 3600.0
E = "WITH " + EVENT_SERIES_SQL
K = ["user_id"]


def r(c, n=6):
    return F.round(c, n)


def q_segments(spark, d):
    s = ts.segments(event_series(spark, d), K, "t", 6 * H)
    return s.groupBy("user_id", "segment_id").agg(F.count("*").alias("n"), r(F.min("t")).alias("t0"), r(F.max("t")).alias("t1"))


SEGMENTS = E + """, s AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 21600 THEN 1 ELSE 0 END AS n FROM e
), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT user_id, CAST(sid AS INTEGER) AS segment_id, count(*) AS n, round(min(t), 6) AS t0, round(max(t), 6) AS t1 FROM g GROUP BY user_id, sid
"""


def q_observed(spark, d):
    s = ts.segments(event_series(spark, d), K, "t", 6 * H)
    return ts.observed_seconds(s, K, "t").select("user_id", r("observed_s", 3).alias("observed_s"))


OBSERVED = E + """, s AS (
  SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step FROM e
), g AS (SELECT *, sum(CASE WHEN step > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM s
), p AS (SELECT user_id, sum(x) AS x FROM (SELECT user_id, sid, max(t) - min(t) AS x FROM g GROUP BY ALL) GROUP BY user_id
), m AS (SELECT user_id, median(step) AS m FROM s GROUP BY user_id)
SELECT user_id, round(x + coalesce(m, 0), 3) AS observed_s FROM p JOIN m USING (user_id)
"""


def q_smooth(spark, d):
    return ts.moving_average(event_series(spark, d), K, "t", "v", 5, "smooth").select("event_id", r("smooth").alias("smooth"))


SMOOTH = E + """, s AS (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN avg(v) OVER (PARTITION BY user_id, run, v IS NULL ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smooth FROM s
"""


def q_derivative(spark, d):
    return ts.derivative(event_series(spark, d), K, "t", "t", "v", "slope").select("event_id", r("slope").alias("slope"))


DERIVATIVE = E + """, s AS (
  SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, lag(t) OVER w AS pt, lead(t) OVER w AS nt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)
)
SELECT event_id, round(CASE WHEN v IS NULL THEN NULL WHEN pv IS NOT NULL AND nv IS NOT NULL THEN (nv - pv) / (nt - pt)
  WHEN nv IS NOT NULL THEN (nv - v) / (nt - t) WHEN pv IS NOT NULL THEN (v - pv) / (t - pt) END, 6) AS slope FROM s
"""


def scored(spark, d):
    e = event_series(spark, d)
    return e.withColumn("score", F.when(F.col("v").isNotNull(), soft_threshold(F.col("v"), 50.0, 20.0)))


def episodes(spark, d):
    return ts.hysteresis_episodes(scored(spark, d), K, "t", "score", 0.5, 0.25, 12 * H, 6 * H)


def q_episodes(spark, d):
    return episodes(spark, d).select(
        "user_id", r("start_t").alias("start_t"), r("end_t").alias("end_t"), "n_rows", r("mean_score").alias("mean_score"), r("max_score").alias("max_score"), r("confidence").alias("confidence")
    )


EPISODES_CTE = EVENT_SERIES_SQL + """, sc AS (
  SELECT *, CASE WHEN v IS NOT NULL THEN 1 / (1 + exp(-greatest(-60.0, least(60.0, (v - 50) / 20)))) END AS score FROM e
), la AS (
  SELECT *, coalesce(last_value(CASE WHEN score >= 0.5 THEN 1 WHEN score IS NULL OR score < 0.25 THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM sc
), li AS (
  SELECT *, lag(on_, 1, 0) OVER (PARTITION BY user_id ORDER BY t) AS was,
    max(CASE WHEN on_ = 1 THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_t FROM la
), nu AS (
  SELECT *, sum(CASE WHEN on_ = 1 AND was = 0 AND (last_t IS NULL OR t - last_t >= 21600) THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS ep FROM li
), en AS (SELECT *, max(CASE WHEN on_ = 1 THEN t END) OVER (PARTITION BY user_id, ep) AS end_ FROM nu
), eps AS (
  SELECT user_id, ep, min(t) AS start_t, max(t) AS end_t, count(*) AS n_rows, avg(score) AS mean_score, max(score) AS max_score
  FROM en WHERE ep > 0 AND t <= end_ GROUP BY user_id, ep HAVING max(t) - min(t) >= 43200 - 1e-9
)"""
EPISODES = "WITH " + EPISODES_CTE + """
SELECT user_id, round(start_t, 6) AS start_t, round(end_t, 6) AS end_t, n_rows, round(mean_score, 6) AS mean_score, round(max_score, 6) AS max_score,
  round(greatest(0, least(1, mean_score)), 6) AS confidence FROM eps
"""


def possession_reads(spark, d):
    """The events with raw, what a read of the ball could say."""
    reads = F.when(F.col("event_type") == "click", "home").when(F.col("event_type") == "view", "away").when(F.col("event_type") == "signup", "contested").when(F.col("event_type") == "error", "dead")
    return event_series(spark, d).withColumn("raw", reads)


def q_possession(spark, d):
    p = ts.possession(possession_reads(spark, d), K, "t", "raw", 12 * H)
    return p.select("event_id", "state", "flip", r("since_flip", 3).alias("since_flip"))


POSSESSION = E + """, rd AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'home' WHEN 'view' THEN 'away' WHEN 'signup' THEN 'contested' WHEN 'error' THEN 'dead' END AS raw FROM e
), bl AS (SELECT *, sum(CASE WHEN raw = 'dead' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS b FROM rd
), cl AS (SELECT *, CASE WHEN raw IS DISTINCT FROM lag(raw) OVER (PARTITION BY user_id, b ORDER BY t) THEN 1 ELSE 0 END AS n FROM bl WHERE raw IN ('home', 'away')
), ru AS (SELECT *, sum(n) OVER (PARTITION BY user_id, b ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM cl
), r0 AS (SELECT *, min(t) OVER (PARTITION BY user_id, b, run) AS t0 FROM ru
), rr AS (SELECT user_id, b, run, min(raw) AS side, min(t) AS t0, min(CASE WHEN t - t0 >= 43200 - 1e-9 THEN t END) AS confirm FROM r0 GROUP BY ALL
), q AS (SELECT *, coalesce(side <> lag(side) OVER (PARTITION BY user_id, b ORDER BY t0), false) AS flip FROM rr WHERE run = 1 OR confirm IS NOT NULL
), j AS (SELECT bl.*, q.side, q.confirm, coalesce(q.flip, false) AS flip, q.t0 FROM bl LEFT JOIN q ON q.user_id = bl.user_id AND q.t0 = bl.t
), f AS (
  SELECT *, last_value(side IGNORE NULLS) OVER w AS cs, last_value(CASE WHEN side IS NOT NULL THEN coalesce(confirm, -1) END IGNORE NULLS) OVER w AS cc,
    last_value(CASE WHEN side IS NOT NULL THEN flip END IGNORE NULLS) OVER w AS cf,
    last_value(CASE WHEN flip THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS lf
  FROM j WINDOW w AS (PARTITION BY user_id, b ORDER BY t ROWS UNBOUNDED PRECEDING)
), st AS (
  SELECT *, CASE WHEN raw = 'dead' THEN 'dead' WHEN raw = 'contested' AND NOT coalesce(cf AND t <= cc, false) THEN 'contested' ELSE coalesce(cs, 'contested') END AS state FROM f
)
SELECT event_id, state, flip, round(CASE WHEN state = 'dead' OR (coalesce(raw, '') <> 'contested' AND cs IS NULL) THEN NULL ELSE t - lf END, 3) AS since_flip FROM st
"""


def six_hourly(spark, d):
    e = event_series(spark, d)
    return ts.resample(ts.grid(e, K, "t", 6 * H), e.filter("v IS NOT NULL"), K, "t", ["v"], 6 * H, 24 * H)


def q_resample(spark, d):
    return six_hourly(spark, d).select("user_id", "i", r("v").alias("v"))


RESAMPLE_CTE = EVENT_SERIES_SQL + """, sp AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM e GROUP BY user_id
), gr AS (SELECT user_id, unnest(range(0, CAST(round_even((t1 - t0) / 21600, 0) AS BIGINT) + 1)) AS i, t0 FROM sp
), g AS (SELECT user_id, i, t0 + i * 21600.0 AS t FROM gr
), ob AS (SELECT user_id, t, v FROM e WHERE v IS NOT NULL
), a AS (
  SELECT g.user_id, g.i, g.t, p.t AS pt, p.v AS pv FROM g ASOF LEFT JOIN ob p ON g.user_id = p.user_id AND g.t >= p.t
), ab AS (
  SELECT a.*, n.t AS nt, n.v AS nv FROM a ASOF LEFT JOIN ob n ON a.user_id = n.user_id AND a.t <= n.t
), rs AS (
  SELECT user_id, i, t, CASE WHEN t - pt <= 10800 + 1e-9 AND (nt IS NULL OR t - pt <= nt - t) THEN pv WHEN nt - t <= 10800 + 1e-9 THEN nv
    WHEN nt - pt > 0 AND nt - pt <= 86400 + 1e-9 THEN pv + (nv - pv) * (t - pt) / (nt - pt) END AS v FROM ab
)"""
RESAMPLE = "WITH " + RESAMPLE_CTE + " SELECT user_id, i, round(v, 6) AS v FROM rs"


def q_interpolate(spark, d):
    e = event_series(spark, d).withColumn("conf", F.when(F.col("v").isNotNull(), F.lit(0.9) - F.pmod("event_id", F.lit(5)) / 10))
    return ts.interpolate(e, K, "t", "t", ["v"], 12 * H, "conf").select("event_id", r("v").alias("v"), r("conf").alias("conf"), "interpolated")


INTERPOLATE = E + """, c AS (SELECT *, CASE WHEN v IS NOT NULL THEN 0.9 - (event_id % 5) / 10.0 END AS conf, CASE WHEN v IS NOT NULL THEN t END AS tv FROM e
), w AS (
  SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(tv IGNORE NULLS) OVER b AS pt, last_value(conf IGNORE NULLS) OVER b AS pc,
    first_value(v IGNORE NULLS) OVER a AS nv, first_value(tv IGNORE NULLS) OVER a AS nt, first_value(conf IGNORE NULLS) OVER a AS nc
  FROM c WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), f AS (SELECT *, v IS NULL AND coalesce(nt - pt > 0 AND nt - pt <= 43200, false) AS interpolated FROM w)
SELECT event_id, round(CASE WHEN interpolated THEN pv + (nv - pv) * ((t - pt) / (nt - pt)) ELSE v END, 6) AS v,
  round(CASE WHEN interpolated THEN 0.5 * least(pc, nc) ELSE conf END, 6) AS conf, interpolated FROM f
"""


def points(spark, d):
    """x and y in metres around the pitch, from value and the event's number; null for errors."""
    return event_series(spark, d).withColumn("x", F.col("v") - 50).withColumn("y", F.when(F.col("v").isNotNull(), F.pmod("event_id", F.lit(90)) - 45.0))


POINTS = EVENT_SERIES_SQL + ", p AS (SELECT *, v - 50 AS x, CASE WHEN v IS NOT NULL THEN event_id % 90 - 45.0 END AS y FROM e)"


def point_gaps(spark, d):
    return ts.gaps(points(spark, d).select("user_id", "t", "x", "y"), K, "t", "t", F.col("x").isNotNull())


def q_gaps(spark, d):
    g = ts.gap_contexts(point_gaps(spark, d), "x", "y")
    return g.select("user_id", r("first_t").alias("first_t"), "n_rows", r("duration", 3).alias("duration"), "at_edge", r("displacement").alias("displacement"), r("implied_speed").alias("implied_speed"), "near_boundary")


GAPS_CTE = POINTS + """, w AS (
  SELECT *, CASE WHEN x IS NULL AND (lag(x) OVER (PARTITION BY user_id ORDER BY t) IS NOT NULL OR lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL) THEN 1 ELSE 0 END AS st,
    last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt, last_value(x IGNORE NULLS) OVER b AS px, last_value(y IGNORE NULLS) OVER b AS py,
    first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nt, first_value(x IGNORE NULLS) OVER a AS nx, first_value(y IGNORE NULLS) OVER a AS ny
  FROM p WINDOW b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS gap FROM w
), g AS (
  SELECT user_id, gap, min(t) AS first_t, max(t) AS last_t, count(*) AS n_rows, min(pt) AS pt, min(px) AS px, min(py) AS py, min(nt) AS nt, min(nx) AS nx, min(ny) AS ny
  FROM n WHERE x IS NULL GROUP BY user_id, gap
), gg AS (SELECT *, coalesce(nt, last_t) - coalesce(pt, first_t) AS duration, pt IS NULL OR nt IS NULL AS at_edge FROM g)"""
_NEAR = "coalesce(least(abs(abs({0}x) - 52.5), abs(abs({0}y) - 34)) <= 3, false)"
GAPS = "WITH " + GAPS_CTE + f"""
SELECT user_id, round(first_t, 6) AS first_t, n_rows, round(duration, 3) AS duration, at_edge, round(sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py)), 6) AS displacement,
  round(CASE WHEN duration > 0 THEN sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py)) / duration END, 6) AS implied_speed, {_NEAR.format('p')} OR {_NEAR.format('n')} AS near_boundary FROM gg
"""


def q_coverage(spark, d):
    c = ts.coverage(points(spark, d), point_gaps(spark, d), K, F.col("x").isNotNull(), 2, 24 * H, 48 * H)
    names = ("detection_rate", "isolated_share", "interpolable_share", "blackout_share")
    return c.select("user_id", "n", "n_detected", "n_gaps", r("median_gap", 3).alias("median_gap"), r("max_gap", 3).alias("max_gap"), *(r(x).alias(x) for x in names))


COVERAGE = "WITH " + GAPS_CTE + """, tot AS (SELECT user_id, count(*) AS n, count(x) AS n_detected FROM p GROUP BY user_id
), ag AS (
  SELECT user_id, count(*) AS n_gaps, median(duration) AS median_gap, max(duration) AS max_gap, sum(CASE WHEN n_rows <= 2 THEN n_rows ELSE 0 END) AS iso,
    sum(CASE WHEN duration <= 86400 THEN n_rows ELSE 0 END) AS inter, sum(CASE WHEN duration >= 172800 THEN n_rows ELSE 0 END) AS black FROM gg GROUP BY user_id
)
SELECT user_id, n, n_detected, coalesce(n_gaps, 0) AS n_gaps, round(median_gap, 3) AS median_gap, round(max_gap, 3) AS max_gap, round(n_detected / n, 6) AS detection_rate,
  round(CASE WHEN n > n_detected THEN iso / (n - n_detected) END, 6) AS isolated_share, round(CASE WHEN n > n_detected THEN inter / (n - n_detected) END, 6) AS interpolable_share,
  round(coalesce(black, 0) / n, 6) AS blackout_share FROM tot LEFT JOIN ag USING (user_id)
"""


def flags(spark, d):
    return ts.kinematic_flags(points(spark, d), K, "t", "x", "y", 0.01, 3600.0)


def q_flags(spark, d):
    return flags(spark, d).select("event_id", r("dt", 3).alias("dt"), r("speed").alias("speed"), "overspeed", "teleport", r("out_of_bounds").alias("out_of_bounds"))


FLAGS_CTE = POINTS + """, w AS (
  SELECT *, t - lag(t) OVER k AS dt, sqrt(power(x - lag(x) OVER k, 2) + power(y - lag(y) OVER k, 2)) AS moved FROM p WHERE x IS NOT NULL WINDOW k AS (PARTITION BY user_id ORDER BY t)
), s AS (SELECT *, CASE WHEN dt > 0 THEN moved / dt END AS speed, sqrt(power(greatest(abs(x) - 52.5, 0), 2) + power(greatest(abs(y) - 34, 0), 2)) AS oob FROM w
), f AS (
  SELECT *, coalesce(speed > 0.01, false) AS overspeed, coalesce(speed > 0.01, false) AND coalesce(dt <= 3600, false) AS teleport, CASE WHEN oob > 5 THEN oob ELSE 0 END AS out_of_bounds FROM s
)"""
FLAGS = "WITH " + FLAGS_CTE + " SELECT event_id, round(dt, 3) AS dt, round(speed, 6) AS speed, overspeed, teleport, round(out_of_bounds, 6) AS out_of_bounds FROM f"


def q_plausibility(spark, d):
    p = ts.plausibility(flags(spark, d), K)
    return p.select("user_id", "n_detected", "n_speed_pairs", "n_overspeed", "n_teleport", "n_out_of_bounds", r("median_speed").alias("median_speed"), r("max_speed").alias("max_speed"))


PLAUSIBILITY = "WITH " + FLAGS_CTE + """
SELECT user_id, count(*) AS n_detected, count(speed) AS n_speed_pairs, count_if(overspeed) AS n_overspeed, count_if(teleport) AS n_teleport, count_if(out_of_bounds > 0) AS n_out_of_bounds,
  round(median(speed), 6) AS median_speed, round(max(speed), 6) AS max_speed FROM f GROUP BY user_id
"""


def q_next(spark, d):
    e = event_series(spark, d)
    left = e.filter("event_type = 'purchase'").select("user_id", "t", "event_id")
    right = e.filter("event_type = 'error'").select("user_id", "t", F.col("event_id").alias("error_id"))
    return ts.next_within(left, right, K, "t", "error_id", 48 * H).select("event_id", "next_id", r("next_t").alias("next_t"))


NEXT = E + """, l AS (SELECT * FROM e WHERE event_type = 'purchase'), x AS (SELECT * FROM e WHERE event_type = 'error'
), j AS (SELECT l.event_id, l.t, x.event_id AS id, x.t AS nt FROM l ASOF LEFT JOIN x ON l.user_id = x.user_id AND l.t < x.t)
SELECT event_id, CASE WHEN nt <= t + 172800 THEN id END AS next_id, round(CASE WHEN nt <= t + 172800 THEN nt END, 6) AS next_t FROM j
"""


def q_overlap(spark, d):
    """Episodes with the first signup within an hour of them, or null: a semi-join with a value, and its anti-join."""
    ep = episodes(spark, d).select("user_id", "start_t", "end_t")
    s = event_series(spark, d).filter("event_type = 'signup'").select("user_id", "event_id", (F.col("t") - H).alias("start_t"), (F.col("t") + H).alias("end_t"))
    hit = ts.overlapping(ep, s, K, 24 * H).groupBy("user_id", "start_t").agg(F.min_by("r_event_id", F.struct("r_start_t", "r_event_id")).alias("explained_by"))
    return ep.join(hit, ["user_id", "start_t"], "left").select("user_id", r("start_t").alias("start_t"), "explained_by", F.col("explained_by").isNull().alias("unexplained"))


OVERLAP = "WITH " + EPISODES_CTE + """, s AS (SELECT user_id, event_id, t - 3600 AS a, t + 3600 AS b FROM e WHERE event_type = 'signup')
SELECT eps.user_id, round(start_t, 6) AS start_t, arg_min(s.event_id, s.a) AS explained_by, arg_min(s.event_id, s.a) IS NULL AS unexplained
FROM eps LEFT JOIN s ON s.user_id = eps.user_id AND start_t < s.b AND end_t > s.a GROUP BY eps.user_id, start_t
"""


def q_band_anti(spark, d):
    """Clicks without a view of the same user within half an hour."""
    e = event_series(spark, d)

    def span(kind, back):
        return e.filter(F.col("event_type") == kind).select("user_id", "event_id", (F.col("t") - back).alias("start_t"), (F.col("t") + back).alias("end_t"))

    clicks, views = span("click", H / 4), span("view", H / 4)
    near = ts.overlapping(clicks, views, K, 6 * H).select("event_id").distinct()
    return clicks.join(near, "event_id", "left_anti").select("event_id", "user_id")


BAND_ANTI = E + """
SELECT event_id, user_id FROM e WHERE event_type = 'click' AND NOT EXISTS (
  SELECT 1 FROM e v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND e.t - 900 < v.t + 900 AND e.t + 900 > v.t - 900)
"""


def q_support(spark, d):
    return ts.temporal_support(event_series(spark, d), K, "t", F.col("v").isNotNull(), 24 * H).select("event_id", r("support").alias("support"))


SUPPORT = E + """, u AS (SELECT *, CAST(round(t * 1e6) AS BIGINT) AS us, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS d FROM e
), w AS (SELECT *, count(*) OVER k - 1 AS n, sum(d) OVER k - d AS s FROM u WINDOW k AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING))
SELECT event_id, round(CASE WHEN n > 0 THEN s / n ELSE 1 END, 6) AS support FROM w
"""


def q_sliding(spark, d):
    w = ts.sliding_windows(event_series(spark, d), K, "t", 72 * H, 24 * H)
    return w.groupBy("user_id", r("window_start").alias("window_start")).agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean_v"))


SLIDING = E + """, b AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM e GROUP BY user_id
), k AS (SELECT user_id, t0, unnest(range(0, CAST(floor((t1 - t0 - 259200) / 86400) AS BIGINT) + 1)) AS k FROM b WHERE t1 - t0 >= 259200
), w AS (SELECT user_id, t0 + k * 86400.0 AS ws FROM k)
SELECT w.user_id, round(ws, 6) AS window_start, count(*) AS n, round(avg(v), 6) AS mean_v FROM w JOIN e ON e.user_id = w.user_id AND e.t >= ws AND e.t < ws + 259200 GROUP BY w.user_id, ws
"""

QUERIES = {
    "events_segments": q_segments, "events_observed_time": q_observed, "events_moving_average": q_smooth, "events_derivative": q_derivative,
    "events_episodes": q_episodes, "events_possession": q_possession, "events_resample": q_resample, "events_interpolate": q_interpolate,
    "events_gap_contexts": q_gaps, "events_coverage": q_coverage, "events_kinematic_flags": q_flags, "events_plausibility": q_plausibility,
    "events_next_within": q_next, "events_interval_overlap": q_overlap, "events_band_anti_join": q_band_anti, "events_temporal_support": q_support,
    "events_sliding_windows": q_sliding,
}
ORACLE_SQL = {
    "events_segments": SEGMENTS, "events_observed_time": OBSERVED, "events_moving_average": SMOOTH, "events_derivative": DERIVATIVE,
    "events_episodes": EPISODES, "events_possession": POSSESSION, "events_resample": RESAMPLE, "events_interpolate": INTERPOLATE,
    "events_gap_contexts": GAPS, "events_coverage": COVERAGE, "events_kinematic_flags": FLAGS, "events_plausibility": PLAUSIBILITY,
    "events_next_within": NEXT, "events_interval_overlap": OVERLAP, "events_band_anti_join": BAND_ANTI, "events_temporal_support": SUPPORT,
    "events_sliding_windows": SLIDING,
}
