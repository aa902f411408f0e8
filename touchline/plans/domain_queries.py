"""Shape, evaluation, shot, scouting and rule operators on the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.scalar import hull_area
from touchline.operators import evaluation, reports, scouting, shape, shots
from touchline.sources.tables import table


def r(c, n=6):
    return F.round(c, n)


# --- players: the lines of an order are a frame; odd lines are home, even ones away -----------------------

def players(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("track_id"), F.when(F.col("l_linenumber") % 2 == 1, "home").otherwise("away").alias("team"),
        F.col("l_quantity").cast("double").alias("x"), (F.pmod(F.col("l_partkey"), F.lit(61)) - 30.0).alias("y"), (F.pmod(F.col("l_suppkey"), F.lit(9)) - 1.0).alias("vx"),
    )
    return p


def balls(spark, d):
    """The mean position of each frame's players; none in every seventh frame."""
    b = players(spark, d).groupBy("frame").agg(F.avg("x").alias("ball_x"), F.avg("y").alias("ball_y"))
    seen = F.pmod("frame", F.lit(7)) != 0
    return b.select("frame", F.when(seen, F.col("ball_x")).alias("ball_x"), F.when(seen, F.col("ball_y")).alias("ball_y"))


PLAYERS = """WITH pl AS (
  SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS track_id, CASE WHEN l_linenumber % 2 = 1 THEN 'home' ELSE 'away' END AS team,
    CAST(l_quantity AS DOUBLE) AS x, l_partkey % 61 - 30.0::DOUBLE AS y, l_suppkey % 9 - 1.0::DOUBLE AS vx FROM lineitem
), ba AS (
  SELECT frame, CASE WHEN frame % 7 <> 0 THEN avg(x) END AS ball_x, CASE WHEN frame % 7 <> 0 THEN avg(y) END AS ball_y FROM pl GROUP BY frame
), di AS (SELECT pl.*, ball_x, ball_y, sqrt((x - ball_x) * (x - ball_x) + (y - ball_y) * (y - ball_y)) AS dist FROM pl JOIN ba USING (frame) WHERE ball_x IS NOT NULL)"""


def q_shape(spark, d):
    p = players(spark, d).join(balls(spark, d), "frame").select("frame", "team", F.col("x").alias("x_rel"), F.col("y").alias("y_rel"), F.col("vx").alias("vx_rel"), F.col("ball_x").alias("ball_x_rel"))
    s = shape.team_shape(p, ["frame"], min_visible=3, runner_speed=5.5)
    return s.select("frame", "team", "n_visible", "n_forward_runners", *(f"n_{x}" for x in shape.LANES), "n_behind_ball", *(r(c, 5).alias(c) for c in ("centroid_x", "centroid_y", "width", "depth", "hull_area", "stretch", "line_height", "line_flatness")))


_HULL = """, {name} AS (
  SELECT {keys}, sum(a.x * b.y - b.x * a.y) / 2 AS area FROM {pts} a JOIN {pts} b USING ({keys})
  WHERE (a.x <> b.x OR a.y <> b.y) AND NOT EXISTS (
    SELECT 1 FROM {pts} c WHERE {same} AND (
      (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
      OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND NOT ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) BETWEEN 0 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))))
  GROUP BY {keys}
)"""

SHAPE = PLAYERS + ", dp AS (SELECT DISTINCT frame, team, x, y FROM pl)" + _HULL.format(name="hu", keys="frame, team", pts="dp", same="c.frame = a.frame AND c.team = a.team") + """
, ln AS (SELECT pl.*, ball_x AS bx, row_number() OVER (PARTITION BY frame, team ORDER BY x) AS k, avg(x) OVER (PARTITION BY frame, team) AS mx, avg(y) OVER (PARTITION BY frame, team) AS my,
  CASE WHEN y > 20.4 THEN 'wl' WHEN y > 6.8 THEN 'hl' WHEN y >= -6.8 THEN 'c' WHEN y >= -20.4 THEN 'hr' ELSE 'wr' END AS lane FROM pl JOIN ba USING (frame)
), ag AS (
  SELECT frame, team, count(*) AS n, count_if(vx >= 5.5) AS runners, count_if(lane = 'wl') AS wl, count_if(lane = 'hl') AS hl, count_if(lane = 'c') AS c, count_if(lane = 'hr') AS hr, count_if(lane = 'wr') AS wr,
    avg(x) AS cx, avg(y) AS cy, max(y) - min(y) AS w, max(x) - min(x) AS d, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS st, min(CASE WHEN k = 2 THEN x END) AS lh,
    stddev_pop(CASE WHEN k <= 4 THEN x END) AS fl, count_if(x < bx) AS behind, max(bx) AS bx FROM ln GROUP BY frame, team
)
SELECT frame, team, n AS n_visible, runners AS n_forward_runners, wl AS n_wide_left, hl AS n_halfspace_left, c AS n_centre, hr AS n_halfspace_right, wr AS n_wide_right,
  CASE WHEN n >= 3 AND bx IS NOT NULL THEN behind END AS n_behind_ball, round(CASE WHEN n >= 3 THEN cx END, 5) AS centroid_x, round(CASE WHEN n >= 3 THEN cy END, 5) AS centroid_y,
  round(CASE WHEN n >= 3 THEN w END, 5) AS width, round(CASE WHEN n >= 3 THEN d END, 5) AS depth, round(CASE WHEN n >= 3 THEN coalesce(area, 0) END, 5) AS hull_area,
  round(CASE WHEN n >= 3 THEN st END, 5) AS stretch, round(CASE WHEN n >= 3 THEN lh END, 5) AS line_height, round(CASE WHEN n >= 4 THEN fl END, 5) AS line_flatness
FROM ag LEFT JOIN hu USING (frame, team)
"""


def q_hull(spark, d):
    p = players(spark, d).groupBy("frame").agg(F.collect_list(F.struct("x", "y")).alias("ps"))
    return p.select("frame", r(hull_area(F.col("ps")), 5).alias("area"))


HULL = PLAYERS + ", dp AS (SELECT DISTINCT frame, x, y FROM pl)" + _HULL.format(name="hu", keys="frame", pts="dp", same="c.frame = a.frame") + """
SELECT f.frame, round(CASE WHEN n >= 3 THEN coalesce(area, 0) ELSE 0 END, 5) AS area FROM (SELECT frame, count(*) AS n FROM dp GROUP BY frame) f LEFT JOIN hu USING (frame)
"""


def q_nearest(spark, d):
    di = shape.ball_distances(players(spark, d), balls(spark, d), ["frame"])
    return shape.nearest_player(di, ["frame"], ["team"], 15.0).select("frame", "team", "track_id", r("dist").alias("dist"))


NEAREST = PLAYERS + """
SELECT frame, team, arg_min(track_id, (dist, track_id)) AS track_id, round(min(dist), 6) AS dist FROM di WHERE dist <= 15 GROUP BY frame, team
"""


def reads(spark, d):
    b = balls(spark, d)
    return shape.raw_possession(shape.ball_distances(players(spark, d), b, ["frame"]), b, ["frame"], 6.0, 40.0, 20.0)


def q_reads(spark, d):
    return reads(spark, d).select("frame", "read", "holder")


READS_CTE = PLAYERS + """, nr AS (SELECT frame, team, min(dist) AS m, arg_min(track_id, (dist, track_id)) AS tid FROM di WHERE dist <= 6 GROUP BY frame, team
), pv AS (SELECT frame, bool_or(team = 'home') AS home, bool_or(team = 'away') AS away, min(tid) AS holder FROM nr GROUP BY frame
), rd AS (
  SELECT ba.*, CASE WHEN abs(ball_x) > 40 OR abs(ball_y) > 20 THEN 'dead' WHEN home AND away THEN 'contested' WHEN home THEN 'home' WHEN away THEN 'away' END AS read, holder
  FROM ba LEFT JOIN pv USING (frame)
)"""
READS = READS_CTE + " SELECT frame, read, CASE WHEN read IN ('home', 'away') THEN holder END AS holder FROM rd"


def q_pressure(spark, d):
    live = reads(spark, d).select("frame", "ball_x", "ball_y", F.col("read").alias("state"))
    p = shape.pressure(shape.ball_distances(players(spark, d), live, ["frame"]), ["frame"])
    return p.select("frame", "state", r("nearest_defender").alias("nearest_defender"), "within_5m", "within_15m", r("mean3").alias("mean3"), "superiority_10m")


PRESSURE = READS_CTE + """, lv AS (
  SELECT di.frame, di.team, dist, read AS state, row_number() OVER (PARTITION BY di.frame, di.team ORDER BY dist) AS k FROM di JOIN rd USING (frame) WHERE read IN ('home', 'away')
)
SELECT frame, state, round(min(CASE WHEN team <> state THEN dist END), 6) AS nearest_defender, count_if(team <> state AND dist <= 5) AS within_5m, count_if(team <> state AND dist <= 15) AS within_15m,
  round(avg(CASE WHEN team <> state AND k <= 3 THEN dist END), 6) AS mean3, count_if(team = state AND dist <= 10) - count_if(team <> state AND dist <= 10) AS superiority_10m FROM lv GROUP BY frame, state
"""


# --- detector evaluation: every order is a labelled frame, its lines are candidates -------------------------

def labels_and_candidates(spark, d):
    labels = table(spark, d, "orders").select(
        F.pmod("o_custkey", F.lit(5)).alias("clip"), F.col("o_orderkey").alias("index"), (F.pmod("o_orderkey", F.lit(3)) != 0).alias("visible"),
        F.pmod("o_custkey", F.lit(50)).cast("double").alias("x"), F.pmod("o_orderkey", F.lit(61)).cast("double").alias("y"),
    )
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("index"), (F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")).alias("pos"), F.round(F.col("l_discount").cast("double") * 10, 3).alias("conf"), F.col("l_quantity").cast("double").alias("x"), F.pmod("l_partkey", F.lit(61)).cast("double").alias("y"))
    cands = li.join(labels.select("clip", "index"), "index")
    return labels, cands


EVAL_CTE = """WITH lb AS (
  SELECT o_custkey % 5 AS clip, o_orderkey AS index, o_orderkey % 3 <> 0 AS visible, CAST(o_custkey % 50 AS DOUBLE) AS x, CAST(o_orderkey % 61 AS DOUBLE) AS y FROM orders
), ca AS (
  SELECT clip, index, l_linenumber * 10000000::BIGINT + l_partkey AS pos, round(CAST(l_discount AS DOUBLE) * 10, 3) AS conf, CAST(l_quantity AS DOUBLE) AS dx, CAST(l_partkey % 61 AS DOUBLE) AS dy FROM lineitem JOIN lb ON l_orderkey = index
), fl(floor) AS (VALUES (0.05::DOUBLE), (0.3::DOUBLE), (0.6::DOUBLE))"""


def _evaluated(selection):
    def query(spark, d):
        labels, cands = labels_and_candidates(spark, d)
        floors = spark.createDataFrame([(0.05,), (0.3,), (0.6,)], "floor double")
        e = evaluation.evaluate(labels, cands, floors, ["clip"], ["index"], 15.0, selection)
        rounded = ("precision", "recall", "f1", "absent_fp_rate", "absent_candidates", "mean_error", "median_error", "p90_error")
        return e.select("clip", "floor", "n_labelled", "n_visible", "n_absent", "tp", "fp", "fn", "tn", *(r(c).alias(c) for c in rounded))

    return query


def _eval_sql(picked: str) -> str:
    return EVAL_CTE + f""", cl AS (SELECT ca.*, floor, row_number() OVER (PARTITION BY index, floor ORDER BY conf DESC, pos) AS k FROM ca JOIN fl ON conf >= floor
), al AS (SELECT index, floor, count(*) AS n_all FROM cl GROUP BY ALL
), jn AS (SELECT lb.*, fl.floor, dx, sqrt((dx - x) * (dx - x) + (dy - y) * (dy - y)) AS dist FROM lb CROSS JOIN fl LEFT JOIN (SELECT * FROM cl {picked}) s ON s.index = lb.index AND s.floor = fl.floor
), fr AS (SELECT clip, index, floor, visible, count(dx) AS n_det, min(CASE WHEN dist <= 15 THEN dist END) AS err FROM jn GROUP BY ALL
), f2 AS (SELECT fr.*, coalesce(n_all, 0) AS n_all, visible AND err IS NOT NULL AS hit FROM fr LEFT JOIN al USING (index, floor)
), ag AS (
  SELECT clip, floor, count(*) AS n_labelled, count_if(visible) AS n_visible, count_if(NOT visible) AS n_absent, count_if(hit) AS tp, sum(CASE WHEN hit THEN n_det - 1 ELSE n_det END) AS fp,
    count_if(visible AND err IS NULL) AS fn, count_if(NOT visible AND n_det = 0) AS tn, count_if(NOT visible AND n_det > 0) AS ah, sum(CASE WHEN NOT visible THEN n_all ELSE 0 END) AS aa,
    avg(CASE WHEN hit THEN err END) AS me, median(CASE WHEN hit THEN err END) AS md, quantile_cont(CASE WHEN hit THEN err END, 0.9) AS p9 FROM f2 GROUP BY ALL
), pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS rc FROM ag)
SELECT clip, floor, n_labelled, n_visible, n_absent, tp, fp, fn, tn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END, 6) AS f1,
  round(CASE WHEN n_absent > 0 THEN ah / n_absent END, 6) AS absent_fp_rate, round(CASE WHEN n_absent > 0 THEN aa / n_absent END, 6) AS absent_candidates,
  round(me, 6) AS mean_error, round(md, 6) AS median_error, round(p9, 6) AS p90_error FROM pr
"""


def q_raw_recall(spark, d):
    labels, cands = labels_and_candidates(spark, d)
    return evaluation.raw_recall(labels, cands, ["clip", "index"], ["clip"], 15.0).select("clip", "n", "n_hit", r("recall").alias("recall"))


RAW_RECALL = EVAL_CTE + """, b AS (SELECT lb.clip, lb.index, min(sqrt((dx - x) * (dx - x) + (dy - y) * (dy - y))) AS d FROM lb LEFT JOIN ca ON ca.index = lb.index WHERE visible GROUP BY ALL)
SELECT clip, count(*) AS n, count_if(d <= 15) AS n_hit, round(count_if(d <= 15) / count(*), 6) AS recall FROM b GROUP BY clip
"""


# --- shot boundaries: embeddings in vec_id order are frames of clips of 100 -------------------------------

def signatures(spark, d):
    e = table(spark, d, "embeddings")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return e.select(F.expr("vec_id div 100").alias("clip_id"), F.col("vec_id").alias("index"), (F.col("vec_id") / 25).alias("timestamp_s"), F.transform("embedding", lambda x: F.abs(x.cast("double")) / norm).alias("histogram"))


SIGNATURES = """WITH s0 AS (SELECT vec_id // 100 AS clip_id, vec_id AS index, vec_id / 25 AS timestamp_s, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings
), s1 AS (SELECT *, list_transform(a, lambda x: x / list_sum(a)) AS h FROM s0
), s2 AS (SELECT clip_id, index, timestamp_s, h, lag(h) OVER w AS prev, row_number() OVER w - 1 AS pos FROM s1 WINDOW w AS (PARTITION BY clip_id ORDER BY index)
), di AS (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE list_sum(list_transform(list_zip(h, prev), lambda p: abs(p[1] - p[2]))) / 2 END AS dist FROM s2
), me AS (SELECT clip_id, median(dist) AS med FROM di WHERE pos > 0 GROUP BY clip_id
), th AS (SELECT di.clip_id, greatest(med + 2 * median(abs(dist - med)), 0.15) AS threshold FROM di JOIN me USING (clip_id) WHERE pos > 0 GROUP BY di.clip_id, med
), cr AS (SELECT di.*, threshold, CASE WHEN pos - lag(pos) OVER (PARTITION BY di.clip_id ORDER BY pos) > 7 THEN 1 ELSE 0 END AS n FROM di JOIN th USING (clip_id) WHERE pos > 0 AND dist > threshold
), cu AS (SELECT *, sum(n) OVER (PARTITION BY clip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cl FROM cr
), cs AS (SELECT clip_id, cl, count(*) AS n, arg_min(prev, pos) AS b, arg_max(h, pos) AS a, min(threshold) AS threshold, arg_max(index, (dist, -pos)) AS index, arg_max(pos, (dist, -pos)) AS pos, max(dist) AS dist FROM cu GROUP BY ALL
), bo AS (SELECT * FROM cs WHERE n = 1 OR list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) / 2 > threshold)"""


def _shots(spark, d):
    di = shots.distances(signatures(spark, d))
    th = shots.thresholds(di, mad_k=2.0)
    return di, th, shots.boundaries(di, th)


def q_boundaries(spark, d):
    return _shots(spark, d)[2].select("clip_id", "index", r("dist").alias("dist"), r("margin").alias("margin"))


BOUNDARIES = SIGNATURES + " SELECT clip_id, index, round(dist, 6) AS dist, round(dist / threshold, 6) AS margin FROM bo"


def q_shot_report(spark, d):
    di, th, b = _shots(spark, d)
    rep = shots.report(shots.takes(di, b), th)
    return rep.select("clip_id", "n_frames", "n_segments", "n_boundaries", "single_shot", *(r(c, 5).alias(c) for c in ("duration_s", "longest_s", "median_s", "threshold", "cuts_per_min")))


SHOT_REPORT = SIGNATURES + """, tk AS (
  SELECT di.*, sum(CASE WHEN bo.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY di.clip_id ORDER BY di.pos ROWS UNBOUNDED PRECEDING) AS take FROM di LEFT JOIN bo ON bo.clip_id = di.clip_id AND bo.pos = di.pos
), ta AS (SELECT clip_id, take, count(*) AS n, min(timestamp_s) AS s, max(timestamp_s) AS e FROM tk GROUP BY ALL
), re AS (SELECT clip_id, sum(n) AS n_frames, count(*) AS n_segments, max(e) - min(s) AS dur, max(e - s) AS lo, median(e - s) AS md FROM ta GROUP BY clip_id)
SELECT clip_id, n_frames, n_segments, n_segments - 1 AS n_boundaries, n_segments <= 1 AS single_shot, round(dur, 5) AS duration_s, round(lo, 5) AS longest_s, round(md, 5) AS median_s, round(threshold, 5) AS threshold,
  round(CASE WHEN dur > 0 THEN (n_segments - 1) * 60 / dur END, 5) AS cuts_per_min FROM re LEFT JOIN th USING (clip_id)
"""


# --- profiles and scouting: an order is a match, its customer's nation the team ---------------------------

def pattern_events(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.pmod("o_custkey", F.lit(200)).alias("match_id"), F.col("o_orderpriority").alias("pattern_id"), F.col("c_nationkey").alias("team"), F.pmod("o_orderkey", F.lit(5400)).cast("double").alias("start_s"),
        (F.pmod("o_orderkey", F.lit(5400)) + F.pmod("o_custkey", F.lit(40)) + 1).cast("double").alias("end_s"), (F.pmod("o_orderkey", F.lit(97)) / 97).alias("confidence"), (F.pmod("o_custkey", F.lit(89)) / 89).alias("intensity"),
        F.create_map(F.lit("status"), "o_orderstatus", F.lit("late"), (F.pmod("o_orderkey", F.lit(2)) == 0).cast("string")).alias("tags"),
    )


PATTERN_EVENTS = """WITH pe AS (
  SELECT o_custkey % 200 AS match_id, o_orderpriority AS pattern_id, c_nationkey AS team, CAST(o_orderkey % 5400 AS DOUBLE) AS start_s, CAST(o_orderkey % 5400 + o_custkey % 40 + 1 AS DOUBLE) AS end_s,
    (o_orderkey % 97) / 97 AS confidence, (o_custkey % 89) / 89 AS intensity, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS late
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
PK = ["match_id", "pattern_id", "team"]


def profile(spark, d):
    e = pattern_events(spark, d)
    observed = e.groupBy("match_id").agg((F.max("end_s") - F.min("start_s")).alias("observed_s"))
    return scouting.pattern_profile(e, observed)


def q_profile(spark, d):
    return profile(spark, d).select(*PK, "n", *(r(c, 5).alias(c) for c in ("rate_per_90", "mean_confidence", "mean_intensity", "max_intensity", "total_s")))


PROFILE_CTE = PATTERN_EVENTS + """, ob AS (SELECT match_id, max(end_s) - min(start_s) AS observed_s FROM pe GROUP BY match_id
), pf AS (
  SELECT match_id, pattern_id, team, count(*) AS n, avg(confidence) AS mean_confidence, avg(intensity) AS mean_intensity, max(intensity) AS max_intensity, sum(end_s - start_s) AS total_s,
    CASE WHEN min(observed_s) > 0 THEN count(*) * 5400.0::DOUBLE / min(observed_s) ELSE 0 END AS rate_per_90 FROM pe JOIN ob USING (match_id) GROUP BY match_id, pattern_id, team
)"""
PROFILE = PROFILE_CTE + """ SELECT match_id, pattern_id, team, n, round(rate_per_90, 5) AS rate_per_90, round(mean_confidence, 5) AS mean_confidence, round(mean_intensity, 5) AS mean_intensity,
  round(max_intensity, 5) AS max_intensity, round(total_s, 5) AS total_s FROM pf"""


def q_breakdowns(spark, d):
    return scouting.breakdowns(pattern_events(spark, d), ["pattern_id", "team"])


BREAKDOWNS = PATTERN_EVENTS + """, t AS (SELECT pattern_id, team, 'status' AS tag, status AS value FROM pe UNION ALL SELECT pattern_id, team, 'late', late FROM pe)
SELECT pattern_id, team, tag, value, count(*) AS n FROM t GROUP BY ALL
"""


def q_phases(spark, d):
    return scouting.phase_counts(pattern_events(spark, d), ["pattern_id", "team"])


PHASES = PATTERN_EVENTS + """
SELECT pattern_id, team, concat(CAST(floor(start_s / 900) AS BIGINT) * 15, '-', CAST(floor(start_s / 900) AS BIGINT) * 15 + 15, 'min') AS phase, count(*) AS n FROM pe GROUP BY ALL
"""

PATTERNS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def observations(spark, d):
    p = profile(spark, d)
    m = table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(200)).alias("match_id"), F.col("o_orderdate").cast("date").alias("o_date"))
    dates = m.groupBy("match_id").agg(F.max("o_date").alias("date"))
    minutes = pattern_events(spark, d).groupBy("match_id").agg(((F.max("end_s") - F.min("start_s")) / 60).alias("observed_minutes"))
    teams = p.select("match_id", "team").distinct().join(dates, "match_id").join(minutes, "match_id")
    last = dates.agg(F.max("date").alias("as_of"))
    weighted = scouting.match_weights(teams.crossJoin(F.broadcast(last)), F.col("as_of"))
    return scouting.zero_filled(p, weighted, PATTERNS)


def tendency(spark, d):
    return scouting.tendencies(observations(spark, d))


def q_scouting(spark, d):
    names = ("n_eff", "weighted_rate", "rate_spread", "prevalence", "mean_confidence", "mean_intensity", "prevalence_low", "prevalence_high")
    return tendency(spark, d).select("team", "pattern_id", "n_matches", *(r(c, 5).alias(c) for c in names))


SCOUTING_CTE = PROFILE_CTE + """, dt AS (SELECT o_custkey % 200 AS match_id, max(CAST(o_orderdate AS DATE)) AS date FROM orders GROUP BY 1
), tm AS (SELECT DISTINCT pf.match_id, team, date, observed_s / 60 AS minutes, (SELECT max(date) FROM dt) AS as_of FROM pf JOIN dt USING (match_id) JOIN ob USING (match_id)
), wt AS (SELECT match_id, team, power(0.5, greatest(0, CAST(date_diff('day', date, as_of) AS DOUBLE)) / 60) * greatest(0, least(1, minutes / 60)) AS w FROM tm
), pt(pattern_id) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')
), obs AS (
  SELECT wt.team, pt.pattern_id, w, coalesce(n, 0) AS n, coalesce(rate_per_90, 0) AS rate, coalesce(mean_confidence, 0) AS conf, coalesce(mean_intensity, 0) AS inten
  FROM wt CROSS JOIN pt LEFT JOIN pf ON pf.match_id = wt.match_id AND pf.team = wt.team AND pf.pattern_id = pt.pattern_id
), sm AS (
  SELECT team, pattern_id, count(*) AS n_matches, sum(w) AS sw, sum(w * w) AS sww, sum(w * rate) AS swr, sum(w * rate * rate) AS swrr, sum(CASE WHEN rate >= 3 AND conf >= 0.3 THEN w ELSE 0 END) AS swp,
    sum(CASE WHEN n > 0 THEN w END) AS swm, sum(CASE WHEN n > 0 THEN w * conf END) AS swc, sum(CASE WHEN n > 0 THEN w * inten END) AS swi FROM obs GROUP BY ALL
), td AS (
  SELECT team, pattern_id, n_matches, CASE WHEN sw > 0 THEN sw * sw / sww ELSE 0 END AS n_eff, CASE WHEN sw > 0 THEN swr / sw ELSE 0 END AS weighted_rate,
    CASE WHEN sw > 0 THEN sqrt(greatest(0, swrr / sw - (swr / sw) * (swr / sw))) ELSE 0 END AS rate_spread, CASE WHEN sw > 0 THEN swp / sw ELSE 0 END AS prevalence,
    CASE WHEN swm > 0 THEN swc / swm ELSE 0 END AS mean_confidence, CASE WHEN swm > 0 THEN swi / swm ELSE 0 END AS mean_intensity FROM sm
), wi AS (
  SELECT *, 1 + 1.96 * 1.96 / n_eff AS dn, prevalence + 1.96 * 1.96 / (2 * n_eff) AS ce, 1.96 * sqrt(prevalence * (1 - prevalence) / n_eff + 1.96 * 1.96 / (4 * n_eff * n_eff)) AS hf FROM td
)"""
SCOUTING = SCOUTING_CTE + """
SELECT team, pattern_id, n_matches, round(n_eff, 5) AS n_eff, round(weighted_rate, 5) AS weighted_rate, round(rate_spread, 5) AS rate_spread, round(prevalence, 5) AS prevalence,
  round(mean_confidence, 5) AS mean_confidence, round(mean_intensity, 5) AS mean_intensity, round(CASE WHEN n_eff > 0 THEN greatest(0, (ce - hf) / dn) ELSE 0 END, 5) AS prevalence_low,
  round(CASE WHEN n_eff > 0 THEN least(1, (ce + hf) / dn) ELSE 1 END, 5) AS prevalence_high FROM wi
"""


def q_priors(spark, d):
    return scouting.priors(tendency(spark, d)).select("team", "pattern_id", *(r(c, 5).alias(c) for c in ("p_team", "trust", "shift", "wait_scale")))


PRIORS = SCOUTING_CTE + """, p1 AS (SELECT team, pattern_id, (prevalence * n_eff + 0.5) / (n_eff + 1) AS p_team, CASE WHEN n_eff < 2 THEN 0 ELSE n_eff / (n_eff + 5) END AS trust FROM td
), p2 AS (SELECT *, greatest(-0.85, least(0.85, trust * (ln(p_team / (1 - p_team)) - ln(0.35 / 0.65)))) AS shift FROM p1)
SELECT team, pattern_id, round(p_team, 5) AS p_team, round(trust, 5) AS trust, round(shift, 5) AS shift, round(1 - 0.25 * shift / 0.85, 5) AS wait_scale FROM p2
"""

RULES = [
    ("r1", "starter", 0.9, "1-URGENT", "opponent", None, 3.0, 0.3, None, None, ["pace"], "g1", "{team} does it {rate_per_90:.1f} times"),
    ("r1", "analyst", 0.8, "1-URGENT", "opponent", None, 2.0, 0.3, None, None, ["pace"], "g1", "{team} does it {count} times"),
    ("r2", "starter", 0.7, "2-HIGH", "opponent", None, 2.0, None, 0.2, {"side": "left"}, ["height", "pace"], "g1", "use your {mirrored_side}, their {side}: {pattern}"),
    ("r3", "starter", 0.6, "5-LOW", "opponent", 10, None, None, None, None, None, None, "{team}: {count}"),
    ("r4", "starter", 0.5, "3-MEDIUM", "self", 5, None, None, None, None, None, None, "our own {pattern}, {count} times"),
    ("r5", "starter", 0.4, "4-NOT SPECIFIED", None, None, None, None, None, {"side": "left"}, None, None, "{mean_confidence:.2f} on the {side}"),
]
#: The nation that is advised, and the price from which an order counts as on the left.
ADVISED, LEFT = 3, 497_000.0


def q_recommend(spark, d):
    rules = scouting.override_rules(spark.createDataFrame(RULES, scouting.RULE_SCHEMA))
    squad = spark.createDataFrame([("pace",)], "capability string")
    prof = tendency(spark, d).select("team", "pattern_id", F.col("n_matches").cast("int").alias("n"), F.col("weighted_rate").alias("rate_per_90"), "mean_confidence", "mean_intensity")
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    side = F.when(F.col("o_totalprice") >= LEFT, "left").otherwise("right")
    tags = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("team"), F.col("o_orderpriority").alias("pattern_id"), F.lit("side").alias("tag"), side.alias("value")).agg(F.count("*").alias("n"))
    out = scouting.recommend(prof, rules, squad, tags, advised=ADVISED, events=pattern_events(spark, d))
    surest = F.get("clips", F.lit(0))
    return out.select("team", "rank", "rule_id", "of_team", "headline", r("score", 5).alias("score"), F.size("unmet").alias("n_unmet"), F.size("clips").alias("n_clips"), r(surest["confidence"], 5).alias("surest"))


_SOFT = "1 / (1 + exp(-(({0}) - ({1})) / {2}))"
RECOMMEND = SCOUTING_CTE + f""", ru(rule_id, priority, pattern_id, scope, mo, mr, mc, mi, unmet, grp, asks) AS (
  VALUES ('r1', 0.8::DOUBLE, '1-URGENT', 'opponent', NULL::INT, 2.0::DOUBLE, 0.3::DOUBLE, NULL::DOUBLE, 0, 'g1', false), ('r2', 0.7, '2-HIGH', 'opponent', NULL, 2.0, NULL, 0.2, 1, 'g1', true), ('r3', 0.6, '5-LOW', 'opponent', 10, NULL, NULL, NULL, 0, 'r3', false),
    ('r4', 0.5, '3-MEDIUM', 'self', 5, NULL, NULL, NULL, 0, 'r4', false), ('r5', 0.4, '4-NOT SPECIFIED', 'opponent', NULL, NULL, NULL, NULL, 0, 'r5', true)
), le AS (SELECT DISTINCT c_nationkey AS team, o_orderpriority AS pattern_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= {LEFT}
), hi AS (
  SELECT td.*, rule_id, grp, unmet, scope, priority * power({_SOFT.format('weighted_rate', 'coalesce(mr, 0)', 2)} * ({_SOFT.format('mean_confidence', 'coalesce(mc, 0)', 0.15)}) * ({_SOFT.format('mean_intensity', 'coalesce(mi, 0)', 0.15)}), 1.0::DOUBLE / 3) * power(0.5, unmet) AS score
  FROM td JOIN ru USING (pattern_id) LEFT JOIN le USING (team, pattern_id)
  WHERE (mo IS NULL OR n_matches >= mo) AND (mr IS NULL OR weighted_rate >= mr) AND (mc IS NULL OR mean_confidence >= mc) AND (mi IS NULL OR mean_intensity >= mi)
    AND (NOT asks OR EXISTS (SELECT 1 FROM le WHERE le.team = td.team AND le.pattern_id = td.pattern_id))
), ag AS (
  SELECT hi.*, team AS against FROM hi WHERE scope = 'opponent' AND team <> {ADVISED}
  UNION ALL SELECT hi.*, o.team FROM hi CROSS JOIN (SELECT DISTINCT team FROM td WHERE team <> {ADVISED}) o WHERE scope = 'self' AND hi.team = {ADVISED}
), be AS (SELECT *, row_number() OVER (PARTITION BY against, grp ORDER BY score DESC, rule_id DESC) AS k FROM ag
), ra AS (SELECT *, row_number() OVER (PARTITION BY against ORDER BY score DESC, rule_id DESC) AS rank FROM be WHERE k = 1 AND score >= 0.15
), cl AS (SELECT team, pattern_id, least(6, count(*)) AS n_clips, max(confidence) AS surest FROM pe GROUP BY ALL)
SELECT against AS team, CAST(rank AS INTEGER) AS rank, rule_id, ra.team AS of_team, round(score, 5) AS score, unmet AS n_unmet, CAST(coalesce(n_clips, 0) AS INTEGER) AS n_clips, round(surest, 5) AS surest,
  CASE rule_id WHEN 'r1' THEN ra.team || ' does it ' || n_matches || ' times' WHEN 'r2' THEN 'use your right, their left: 2-HIGH' WHEN 'r3' THEN ra.team || ': ' || n_matches WHEN 'r4' THEN 'our own 3-MEDIUM, ' || n_matches || ' times'
    ELSE printf('%.2f', mean_confidence) || ' on the left' END AS headline
FROM ra LEFT JOIN cl ON cl.team = ra.team AND cl.pattern_id = ra.pattern_id WHERE rank <= 8
"""


# --- small aggregates --------------------------------------------------------------------------------------

def q_quantile(spark, d):
    """Per priority the order price at index int(0.25 * (n - 1)) of the sorted prices."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("v"), "o_orderkey")
    # Exact order statistics: ranks within a priority and value range, offset by the counts of lower ranges.
    band = F.floor(F.col("v") / 5000).cast("long")
    o = o.withColumn("band", band)
    counts = o.groupBy("o_orderpriority", "band").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy("o_orderpriority").orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("m").over(W.partitionBy("o_orderpriority"))
    wanted = counts.select("o_orderpriority", "band", before.alias("before"), "m", F.floor((total - 1) * 0.25).alias("at")).filter("at >= before AND at < before + m")
    rank = F.row_number().over(W.partitionBy("o_orderpriority", "band").orderBy("v", "o_orderkey")) - 1
    hit = o.join(F.broadcast(wanted), ["o_orderpriority", "band"]).withColumn("k", rank + F.col("before"))
    return hit.filter("k = at").select("o_orderpriority", r("v", 2).alias("q25"))


QUANTILE = """WITH k AS (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, round(v, 2) AS q25 FROM k WHERE i = CAST(floor((n - 1) * 0.25) AS BIGINT)
"""


def q_zones(spark, d):
    return reports.zone_grid(table(spark, d, "part"), F.col("p_size") - 26.0, F.col("p_retailprice").cast("double") - 1500.0, 51.0, 1200.0)


ZONES = """WITH z AS (
  SELECT greatest(0, least(2, CAST(floor((p_size - 26.0::DOUBLE + 25.5) / 17) AS INTEGER))) AS gx, greatest(0, least(2, CAST(floor((CAST(p_retailprice AS DOUBLE) - 1500 + 600) / 400) AS INTEGER))) AS gy FROM part
), c AS (SELECT CAST(a AS INTEGER) AS gx, CAST(b AS INTEGER) AS gy FROM range(3) x(a), range(3) y(b))
SELECT c.gx, c.gy, count(z.gx) AS n FROM c LEFT JOIN z ON z.gx = c.gx AND z.gy = c.gy GROUP BY ALL
"""


def q_bins(spark, d):
    found = reports.line_tendency(table(spark, d, "part").select("p_brand", "p_size", F.col("p_retailprice").cast("double").alias("height")), ["p_brand"], "height", F.col("p_size"))
    return found.filter("n > 0").select("p_brand", "bin", "n", r("mean_height", 4).alias("mean_height"))


BINS = """SELECT p_brand, CASE WHEN p_size < 10 THEN '0-10' WHEN p_size < 20 THEN '10-20' WHEN p_size < 35 THEN '20-35' ELSE '35+' END AS bin, count(*) AS n, round(avg(CAST(p_retailprice AS DOUBLE)), 4) AS mean_height FROM part GROUP BY ALL"""

QUERIES = {
    "lineitem_team_shape": q_shape, "lineitem_hull_area": q_hull, "lineitem_nearest_player": q_nearest, "lineitem_raw_possession": q_reads, "lineitem_pressure": q_pressure,
    **{f"orders_detection_sweep{x}": _evaluated("best") for x in ("", "_whole")}, **{f"orders_detection_any{x}": _evaluated("any") for x in ("", "_whole")}, **{f"orders_raw_recall{x}": q_raw_recall for x in ("", "_whole")},
    "embeddings_shot_boundaries": q_boundaries, "embeddings_shot_report": q_shot_report,
    "orders_pattern_profile": q_profile, "orders_breakdowns": q_breakdowns, "orders_phase_counts": q_phases, "nation_scouting": q_scouting, "nation_priors": q_priors, "nation_recommendations": q_recommend,
    "orders_quantile": q_quantile, "part_zones": q_zones, "part_distance_bins": q_bins,
}
ORACLE_SQL = {
    "lineitem_team_shape": SHAPE, "lineitem_hull_area": HULL, "lineitem_nearest_player": NEAREST, "lineitem_raw_possession": READS, "lineitem_pressure": PRESSURE,
    **{f"orders_detection_sweep{x}": _eval_sql("WHERE k = 1") for x in ("", "_whole")}, **{f"orders_detection_any{x}": _eval_sql("") for x in ("", "_whole")}, **{f"orders_raw_recall{x}": RAW_RECALL for x in ("", "_whole")},
    "embeddings_shot_boundaries": BOUNDARIES, "embeddings_shot_report": SHOT_REPORT,
    "orders_pattern_profile": PROFILE, "orders_breakdowns": BREAKDOWNS, "orders_phase_counts": PHASES, "nation_scouting": SCOUTING, "nation_priors": PRIORS, "nation_recommendations": RECOMMEND,
    "orders_quantile": QUANTILE, "part_zones": ZONES, "part_distance_bins": BINS,
}
