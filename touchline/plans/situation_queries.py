"""Situations, reports and camera functions on the star-schema tables, with their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from touchline.functions import camera
from touchline.functions.scalar import rounded
from touchline.operators import calibration, reports, scouting, situations
from touchline.plans import domain_queries as dq
from touchline.plans.series_queries import POINTS, points
from touchline.sources.tables import table

K = ["user_id"]
DAY = 86_400.0


def r(c, n=6):
    return rounded(F.col(c) if isinstance(c, str) else c, n)


# --- runs and windows over the events of a user -------------------------------------------------------------

def q_isolation(spark, d):
    """The value stands in for the nearest player's distance; a run lasts six hours at least."""
    out = situations.long_runs(points(spark, d), K, "t", F.col("v") > 25, 0.25 * DAY, min_dist=F.min("v"))
    return out.select("user_id", r("start_t", 3).alias("start_t"), r("end_t", 3).alias("end_t"), "n", r("min_dist").alias("min_dist"))


RUNS = """, f AS (SELECT *, coalesce({flag}, false) AS f FROM p), s AS (SELECT *, f AND NOT coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY t), false) AS st FROM f
), n AS (SELECT *, count_if(st) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM s
)"""
ISOLATION = "WITH " + POINTS + RUNS.format(flag="v > 25") + """
SELECT user_id, round(min(t), 3) AS start_t, round(max(t), 3) AS end_t, count(*) AS n, round(min(v), 6) AS min_dist FROM n WHERE f GROUP BY user_id, run HAVING max(t) - min(t) >= 0.25 * 86400 - 1e-9
"""


def q_dead_balls(spark, d):
    out = situations.long_runs(points(spark, d), K, "t", F.col("x").isNull() | (F.abs("x") < 30), 0.5 * DAY, at=situations.dead_ball_point(), n_valid=F.count("x"))
    return out.select("user_id", r("start_t", 3).alias("start_t"), r("end_t", 3).alias("end_t"), "n", "n_valid", r("at.x").alias("x"), r("at.y").alias("y"))


DEAD = "WITH " + POINTS + RUNS.format(flag="x IS NULL OR abs(x) < 30") + """
SELECT user_id, round(min(t), 3) AS start_t, round(max(t), 3) AS end_t, count(*) AS n, count(x) AS n_valid, round(CASE WHEN count(x) >= 3 THEN median(x) END, 6) AS x,
  round(CASE WHEN count(x) >= 3 THEN median(y) END, 6) AS y FROM n WHERE f GROUP BY user_id, run HAVING max(t) - min(t) >= 0.5 * 86400 - 1e-9
"""


def q_last_touch(spark, d):
    p = points(spark, d).withColumn("touch", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    p = situations.valid_share(situations.last_touch(p, K, "t", "touch", back=4), K, "t", F.col("x").isNotNull())
    return p.select("event_id", "last_touch", r("validity").alias("validity"))


LAST_TOUCH = "WITH " + POINTS + """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last_touch,
  round(0.5 + 0.5 * avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS validity FROM p
"""


def q_resumptions(spark, d):
    """Errors wait for three rows in a row over 40, two days at most."""
    out = situations.resumptions(points(spark, d), K, "t", F.col("event_type") == "error", F.col("v") > 40, n=3, horizon=2 * DAY)
    return out.select("event_id", r("resumed_t", 3).alias("resumed_t"))


RESUMPTIONS = "WITH " + POINTS + """, q AS (
  SELECT *, CASE WHEN count_if(v > 40) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 THEN t END AS fr FROM p
), z AS (SELECT e.event_id, min(q.fr) AS resumed FROM q e LEFT JOIN q ON q.user_id = e.user_id AND q.fr > e.t WHERE e.event_type = 'error' AND e.t IS NOT NULL GROUP BY e.event_id)
SELECT z.event_id, round(CASE WHEN resumed <= t + 172800 THEN resumed END, 3) AS resumed_t FROM z JOIN p USING (event_id)
"""


def q_crossings(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("t")
    p = points(spark, d).filter("x IS NOT NULL").withColumns({"sx": F.col("x") * 1.2, "sy": F.col("y").cast("decimal(9,1)") * F.lit(Decimal("0.9"))})
    hit = p.withColumn("c", camera.crossing(F.lag("sx").over(w), F.lag("sy").over(w), F.col("sx"), F.col("sy"))).filter("c IS NOT NULL")
    return hit.select("event_id", "c.axis", "c.sign", r("c.x").alias("x"), r("c.y").alias("y"))


CROSSINGS = "WITH " + POINTS + """, q AS (SELECT event_id, lag(x * 1.2) OVER w AS x0, lag(y * 0.9) OVER w AS y0, x * 1.2 AS x1, y * 0.9 AS y1 FROM p WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t)
), ed AS (
  SELECT *, CASE WHEN y0 <= 34 AND y1 > 34 THEN x0 + (34 - y0) / (y1 - y0) * (x1 - x0) END AS a, CASE WHEN -y0 <= 34 AND -y1 > 34 THEN x0 + (34 + y0) / (y0 - y1) * (x1 - x0) END AS b,
    CASE WHEN x0 <= 52.5 AND x1 > 52.5 THEN y0 + (52.5 - x0) / (x1 - x0) * (y1 - y0) END AS c, CASE WHEN -x0 <= 52.5 AND -x1 > 52.5 THEN y0 + (52.5 + x0) / (x0 - x1) * (y1 - y0) END AS d FROM q
), k AS (SELECT *, CASE WHEN abs(a) <= 53.5 THEN 1 WHEN abs(b) <= 53.5 THEN 2 WHEN abs(c) <= 35 THEN 3 WHEN abs(d) <= 35 THEN 4 END AS hit FROM ed)
SELECT event_id, CASE WHEN hit <= 2 THEN 'y' ELSE 'x' END AS axis, CASE WHEN hit % 2 = 1 THEN 1 ELSE -1 END AS sign, round(CASE hit WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN 52.5 ELSE -52.5 END, 6) AS x,
  round(CASE hit WHEN 1 THEN 34 WHEN 2 THEN -34 WHEN 3 THEN c ELSE d END, 6) AS y FROM k WHERE hit IS NOT NULL
"""


# --- frames: orders are frames, their lines players -----------------------------------------------------------

def frame_players(spark, d):
    """Of every order the lines as players with a role, and the order's mean place as the ball."""
    p = dq.players(spark, d).join(dq.balls(spark, d), "frame")
    return p.withColumns({"role": F.when(F.col("track_id") == 1, "goalkeeper").otherwise("outfield"), "dir": F.when(F.col("team") == "home", 1).otherwise(-1), "x_rel": F.col("x") * 2 + 2})


def q_lines(spark, d):
    p = frame_players(spark, d)
    sep = situations.half_separation(p, ["frame"], least=2, margin=1.0, share=0.75)
    lines = situations.opposing_line(p, ["frame"], least=2)
    return lines.join(sep, "frame").select("frame", "team", r("line_x").alias("line_x"), r("separation").alias("separation"))


LINES = dq.PLAYERS + """, fi AS (SELECT frame, team, x * 2 + 2 AS xr FROM pl WHERE track_id <> 1
), te AS (SELECT frame, team, count(*) AS n, count_if(xr <= 53.5) AS own, CASE WHEN count(*) >= 2 THEN 105 - list_sort(list(xr))[2] END AS line_x FROM fi GROUP BY ALL
), lo AS (SELECT frame, min(CASE WHEN n >= 2 THEN own / n END) AS low FROM te GROUP BY frame)
SELECT te.frame, team, round(line_x, 6) AS line_x, round(CASE WHEN low IS NULL THEN 0.6 ELSE 1 / (1 + exp(-(low - 0.75) / 0.08)) END, 6) AS separation FROM te JOIN lo USING (frame)
"""


def q_boxes(spark, d):
    p = frame_players(spark, d).withColumn("y", F.col("y") / 2)
    return situations.boxes_loaded(p, ["frame"], least=1)


BOXES = dq.PLAYERS + """, c AS (SELECT frame, count_if(team = 'home' AND x >= 36 AND abs(y / 2) <= 20.16) AS h1, count_if(team = 'away' AND x >= 36 AND abs(y / 2) <= 20.16) AS a1,
  count_if(team = 'home' AND -x >= 36 AND abs(y / 2) <= 20.16) AS h2, count_if(team = 'away' AND -x >= 36 AND abs(y / 2) <= 20.16) AS a2 FROM pl GROUP BY frame)
SELECT frame, (h1 >= 1 AND a1 >= 1) OR (h2 >= 1 AND a2 >= 1) AS loaded FROM c
"""


def q_runners(spark, d):
    """Consecutive lines of a supplier stand in for the rows of a track; the first line of each is a delivery."""
    li = table(spark, d, "lineitem").select(
        F.pmod("l_suppkey", F.lit(9)).alias("match"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.pmod("l_partkey", F.lit(4)).alias("track_id"),
        F.lit("home").alias("team"), (F.col("l_quantity").cast("double") * 2.2 - 55).alias("x"), (F.pmod("l_partkey", F.lit(41)) - 20.0).alias("y"),
    )
    out = situations.runners_into_box(li, ["match"], "pos", li.select("match", "pos", "team").distinct(), 1)
    return out.select("match", "pos", "runners")


RUNNERS = """WITH li AS (SELECT l_suppkey % 9 AS match, l_orderkey * 10 + l_linenumber AS pos, l_partkey % 4 AS tid, CAST(l_quantity AS DOUBLE) * 2.2 - 55 AS x, l_partkey % 41 - 20.0::DOUBLE AS y FROM lineitem
), b AS (SELECT *, x >= 36 AND abs(y) <= 20.16 AS r, -x >= 36 AND abs(y) <= 20.16 AS l FROM li
), j AS (SELECT a.match, a.pos, count_if(NOT a.r AND z.r) AS n1, count_if(NOT a.l AND z.l) AS n2 FROM b a LEFT JOIN b z ON z.match = a.match AND z.tid = a.tid AND z.pos = a.pos + 1 GROUP BY ALL)
SELECT match, pos, greatest(coalesce(n1, 0), coalesce(n2, 0)) AS runners FROM j
"""


def q_walls(spark, d):
    out = situations.walls(frame_players(spark, d).filter("ball_x IS NOT NULL"), ["frame"], annulus=(2.0, 40.0), least=2, spread=6.0, gap=25.0)
    return out.select("frame", "team", "n")


WALLS = dq.PLAYERS + """, nr AS (SELECT *, CASE WHEN team = 'home' THEN -52.5 ELSE 52.5 END AS gx FROM di WHERE dist BETWEEN 2 AND 40
), ca AS (SELECT * FROM nr WHERE sqrt((gx - x) * (gx - x) + y * y) < sqrt((gx - ball_x) * (gx - ball_x) + ball_y * ball_y)
), st AS (SELECT frame, team, count(*) AS n, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th FROM ca GROUP BY frame, team
), al AS (SELECT frame, team, st.n, (x - mx) * cos(th) + (y - my) * sin(th) AS al, (y - my) * cos(th) - (x - mx) * sin(th) AS o FROM ca JOIN st USING (frame, team)
), ga AS (SELECT *, al - lag(al) OVER (PARTITION BY frame, team ORDER BY al) AS gap FROM al
), te AS (SELECT frame, team, max(n) AS n, stddev_pop(o) AS sp, max(gap) AS gap FROM ga GROUP BY frame, team HAVING max(n) >= 2 AND stddev_pop(o) <= 6 AND max(gap) <= 25)
SELECT frame, max(team) AS team, arg_max(n, team) AS n FROM te GROUP BY frame
"""


# --- cameras: parts are poses ----------------------------------------------------------------------------------

def poses(spark, d):
    p = table(spark, d, "part")
    h = camera.compose_homography(
        F.pmod("p_partkey", F.lit(41)) - 20.0, F.col("p_size") / 5.0 + 5, F.pmod("p_partkey", F.lit(7)) - 3.0, F.col("p_retailprice").cast("double") + 500,
        F.lit(0.0), F.lit(-60.0), F.pmod("p_partkey", F.lit(11)) + 10.0, F.lit(960.0), F.lit(540.0),
    )
    return p.select("p_partkey", "p_size", h.alias("h"))


#: The marks that are looked for: the corners, the middle of the pitch and the penalty spots.
MARKS = (("corner_ll", -52.5, -34.0), ("corner_lr", -52.5, 34.0), ("corner_rl", 52.5, -34.0), ("corner_rr", 52.5, 34.0), ("centre", 0.0, 0.0), ("spot_l", -41.5, 0.0), ("spot_r", 41.5, 0.0))


def q_cameras(spark, d):
    p = poses(spark, d)
    seen = sum((camera.visible(F.col("h"), F.lit(x), F.lit(y), 1920.0, 1080.0, 5.0).cast("int") for _, x, y in MARKS[1:]), camera.visible(F.col("h"), F.lit(MARKS[0][1]), F.lit(MARKS[0][2]), 1920.0, 1080.0, 5.0).cast("int"))
    u, v = camera.through(F.col("h"), F.lit(0.0), F.lit(0.0))
    p = p.withColumns({"u": u, "v": v, "n_visible": seen})
    x, y = camera.unproject(F.col("h"), F.col("u"), F.col("v"))
    tilt = camera.band_ramp(F.col("p_size") / 5.0 + 5, (7.0, 12.0), (5.0, 15.0))
    return p.select("p_partkey", r("u", 3).alias("u"), r("v", 3).alias("v"), "n_visible", (F.hypot(x, y) < 1e-6).alias("returns"), r(tilt).alias("tilt_score"))


CAMERAS = """WITH a AS (
  SELECT p_partkey, p_size, radians(p_partkey % 41 - 20.0::DOUBLE) AS pa, radians(p_size / 5.0::DOUBLE + 5) AS ti, radians(p_partkey % 7 - 3.0::DOUBLE) AS ro, CAST(p_retailprice AS DOUBLE) + 500 AS f, p_partkey % 11 + 10.0::DOUBLE AS z FROM part
), m AS (SELECT p_partkey, p_size, name, x, y + 60 AS dy, x AS dx, -z AS dz, pa, ti, ro, f FROM a, (VALUES {marks}) t(name, x, y)
), c AS (
  SELECT p_partkey, p_size, name, f, (cos(ro) * cos(pa) + sin(ro) * sin(ti) * sin(pa)) * dx + (sin(ro) * sin(ti) * cos(pa) - cos(ro) * sin(pa)) * dy + sin(ro) * cos(ti) * dz AS r,
    (sin(ro) * cos(pa) - cos(ro) * sin(ti) * sin(pa)) * dx + (-sin(ro) * sin(pa) - cos(ro) * sin(ti) * cos(pa)) * dy - cos(ro) * cos(ti) * dz AS dn, cos(ti) * sin(pa) * dx + cos(ti) * cos(pa) * dy - sin(ti) * dz AS ah FROM m
), s AS (SELECT *, f * r / ah + 960 AS u, f * dn / ah + 540 AS v FROM c)
SELECT p_partkey, round(max(CASE WHEN name = 'centre' THEN u END), 3) AS u, round(max(CASE WHEN name = 'centre' THEN v END), 3) AS v, CAST(count_if(u BETWEEN -5 AND 1925 AND v BETWEEN -5 AND 1085) AS INTEGER) AS n_visible, true AS returns,
  round(greatest(0, least(1, (min(p_size) / 5.0::DOUBLE + 5 - 5) / 2, (15 - (min(p_size) / 5.0::DOUBLE + 5)) / 3)), 6) AS tilt_score FROM s GROUP BY p_partkey
""".replace("{marks}", ", ".join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE)" for n, x, y in MARKS))


def q_poses(spark, d):
    """The cameras that are found again in the homographies of all parts."""
    found = calibration.decompose_homographies(poses(spark, d).select("p_partkey", "h"), "h", 960.0, 540.0)
    return found.select("p_partkey", *((r(c, 4) + 0.0).alias(c) for c in ("pan", "tilt", "roll", "x", "y", "z")), r("focal", 2).alias("focal"))


POSES = """SELECT p_partkey, p_partkey % 41 - 20.0::DOUBLE AS pan, round(p_size / 5.0::DOUBLE + 5, 4) AS tilt, p_partkey % 7 - 3.0::DOUBLE AS roll, 0.0::DOUBLE AS x, -60.0::DOUBLE AS y, p_partkey % 11 + 10.0::DOUBLE AS z,
  round(CAST(p_retailprice AS DOUBLE) + 500, 2) AS focal FROM part
"""


# --- tendencies, zones, bands, events ---------------------------------------------------------------------------

def q_line_tendency(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_retailprice").cast("double").alias("height"), F.col("p_size").alias("ball"))
    out = reports.line_tendency(p, ["p_brand"], "height", F.col("ball"))
    return out.select("p_brand", "bin", "n", r("mean_height", 4).alias("mean_height"))


LINE_TENDENCY = """WITH b(bin, lo, hi) AS (VALUES ('0-10', -1e9, 10), ('10-20', 10, 20), ('20-35', 20, 35), ('35+', 35, 1e9)), br AS (SELECT DISTINCT p_brand FROM part)
SELECT br.p_brand, bin, count(p.p_partkey) AS n, round(avg(CAST(p_retailprice AS DOUBLE)), 4) AS mean_height FROM br CROSS JOIN b LEFT JOIN part p ON p.p_brand = br.p_brand AND p_size >= lo AND p_size < hi GROUP BY ALL
"""


def q_bands(spark, d):
    li = table(spark, d, "lineitem").withColumn("conf", F.col("l_discount").cast("double"))
    out = reports.image_bands(li, 0.03, [(0.0, 10.0), (10.0, 30.0), (30.0, 45.0), (60.0, 70.0)], F.col("l_quantity").cast("double"), F.col("l_tax").cast("double"))
    return out.select("lo", "hi", "n", r("share").alias("share"), r("median_width").alias("median_width"))


BANDS = """WITH b(lo, hi) AS (VALUES (0.0::DOUBLE, 10.0::DOUBLE), (10, 30), (30, 45), (60, 70)), o AS (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS w FROM lineitem WHERE CAST(l_discount AS DOUBLE) >= 0.03)
SELECT lo, hi, count(q) AS n, round(count(q) / (SELECT count(*) FROM o), 6) AS share, round(median(w), 6) AS median_width FROM b LEFT JOIN o ON q >= lo AND q < hi GROUP BY lo, hi
"""


def q_top_clips(spark, d):
    e = dq.pattern_events(spark, d)
    clips = reports.top_spans(e, ["team", "pattern_id"])
    return clips.select("team", "pattern_id", F.size("clips").alias("n"), r(F.get("clips", F.lit(0))["confidence"]).alias("best"), r(F.get("clips", F.size("clips") - 1)["start_s"]).alias("last_start"))


TOP_CLIPS = dq.PATTERN_EVENTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY team, pattern_id ORDER BY confidence DESC, start_s, end_s) AS k FROM pe), s AS (SELECT * FROM k WHERE k <= 6)
SELECT team, pattern_id, CAST(count(*) AS INTEGER) AS n, round(max(confidence), 6) AS best, round(arg_max(start_s, k), 6) AS last_start FROM s GROUP BY ALL
"""

# The statuses that stand in for types of events, and their tiers.
STATUS_TIERS = {"O": 1, "F": 2}


def q_event_filters(spark, d):
    e = dq.pattern_events(spark, d).withColumn("event_type", F.element_at("tags", "status"))
    kept, dropped = reports.declared(e, list(STATUS_TIERS))
    n = kept.filter(reports.in_window(F.col("start_s"), F.col("end_s"), 900.0, 1800.0)).groupBy(reports.tier(F.col("event_type"), STATUS_TIERS).alias("tier"), "event_type").agg(F.count("*").alias("n"))
    return n.unionByName(dropped.select(F.lit(None).cast("int").alias("tier"), "event_type", F.col("n_dropped").alias("n")))


EVENT_FILTERS = dq.PATTERN_EVENTS + """
SELECT CASE status WHEN 'O' THEN 1 ELSE 2 END AS tier, status AS event_type, count(*) AS n FROM pe WHERE status IN ('O', 'F') AND start_s < 1800 AND end_s > 900 GROUP BY ALL
UNION ALL SELECT NULL, status, count(*) FROM pe WHERE status NOT IN ('O', 'F') GROUP BY ALL
"""


# --- scouting ---------------------------------------------------------------------------------------------------

def q_match_profile(spark, d):
    obs, e = dq.observations(spark, d), dq.pattern_events(spark, d)
    matches = obs.select("team", "match_id", "weight").distinct()
    counts = e.groupBy("team", "pattern_id").agg(F.count("*").alias("n"))
    out = reports.as_match_profile(dq.tendency(spark, d), counts, reports.weighted_breakdowns(e, matches), min_n_eff=2.0)
    return out.select("team", "pattern_id", "n", r("rate_per_90", 5).alias("rate_per_90"), r("mean_confidence", 5).alias("mean_confidence"), F.size("breakdowns").alias("n_values"), F.aggregate(F.map_values("breakdowns"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_weighted"))


MATCH_PROFILE = dq.SCOUTING_CTE + """, tg AS (SELECT match_id, team, pattern_id, 'status' AS tag, status AS value FROM pe UNION ALL SELECT match_id, team, pattern_id, 'late', late FROM pe
), tw AS (SELECT tg.team, tg.pattern_id, tag, value, round_even(sum(w), 0) AS n FROM tg JOIN wt ON wt.team = tg.team AND wt.match_id = tg.match_id GROUP BY ALL
), tb AS (SELECT team, pattern_id, count(*) AS n_values, sum(n) AS n_weighted FROM tw WHERE n >= 1 GROUP BY ALL), ct AS (SELECT team, pattern_id, count(*) AS n FROM pe GROUP BY ALL)
SELECT td.team, td.pattern_id, coalesce(ct.n, 0) AS n, round(weighted_rate, 5) AS rate_per_90, round(mean_confidence, 5) AS mean_confidence, CAST(coalesce(n_values, 0) AS INTEGER) AS n_values, CAST(coalesce(n_weighted, 0) AS BIGINT) AS n_weighted
FROM td LEFT JOIN ct ON ct.team = td.team AND ct.pattern_id = td.pattern_id LEFT JOIN tb ON tb.team = td.team AND tb.pattern_id = td.pattern_id WHERE n_eff >= 2 AND weighted_rate > 0
"""


def _report(spark, d):
    obs = dq.observations(spark, d)
    matches = obs.select("team", "match_id", "date", "observed_minutes", "weight").distinct()
    teams = table(spark, d, "nation").select(F.col("n_nationkey").alias("team")).unionByName(spark.range(100, 101).select(F.col("id").alias("team").cast("int")), allowMissingColumns=True)
    return reports.scouting_report(teams, matches, dq.tendency(spark, d), min_n_eff=20.0)


def q_report(spark, d):
    rep = _report(spark, d)
    docs = reports.report_documents(rep).select("team", F.get_json_object("document", "$.schema").alias("schema"))
    out = rep.select("team", "n_matches", r("observed_minutes", 3).alias("observed_minutes"), F.size(F.coalesce("tendencies", F.array())).alias("n_tendencies"), F.array_join("caveats", "|").alias("caveats"), r(F.get("matches", F.lit(0))["weight"], 5).alias("newest_weight"))
    return out.join(docs, "team")


REPORT = dq.SCOUTING_CTE + """, tt AS (SELECT n_nationkey AS team FROM nation UNION ALL SELECT 100), mt AS (SELECT wt.team, wt.match_id, date, minutes, w FROM wt JOIN tm USING (match_id, team)
), ma AS (SELECT team, count(*) AS n, sum(minutes) AS mi, arg_max(w, (date, match_id)) AS nw FROM mt GROUP BY team
), tn AS (SELECT team, count(*) AS k, coalesce(string_agg(CASE WHEN n_eff > 0 AND n_eff < 20 THEN pattern_id END, ', ' ORDER BY pattern_id), '') AS weak FROM td GROUP BY team)
SELECT tt.team, coalesce(n, 0) AS n_matches, round(coalesce(mi, 0), 3) AS observed_minutes, CAST(coalesce(k, 0) AS INTEGER) AS n_tendencies,
  concat(CASE WHEN coalesce(n, 0) = 0 THEN 'no footage: the report is empty|' WHEN n <= 2 THEN concat('few matches: ', n, '|') WHEN weak <> '' THEN concat('too little evidence: ', weak, '|') ELSE '' END, 'rates are per 90 observed minutes') AS caveats,
  round(nw, 5) AS newest_weight, 'scouting-report/v1' AS schema FROM tt LEFT JOIN ma USING (team) LEFT JOIN tn USING (team)
"""


def q_audit(spark, d):
    out = reports.audited(dq.pattern_events(spark, d), scouting.priors(dq.tendency(spark, d)), floor=0.4)
    return out.groupBy("team", "pattern_id").agg(F.count("*").alias("n"), r(F.avg("adjusted"), 5).alias("mean_adjusted"), F.count_if("may_confirm").alias("n_confirmable"), F.max(F.col("audit.applied")).alias("applied"), F.max(F.col("audit.shift")).alias("shift"))


AUDIT = dq.PRIORS.rpartition("SELECT team")[0] + """, ad AS (
  SELECT pe.team, pe.pattern_id, confidence AS c, coalesce(shift, 0) AS s, greatest(1e-6, least(1 - 1e-6, confidence)) AS q FROM pe LEFT JOIN p2 ON p2.team = pe.team AND p2.pattern_id = pe.pattern_id)
SELECT team, pattern_id, count(*) AS n, round(avg(CASE WHEN s = 0 OR c <= 0 THEN c ELSE 1 / (1 + exp(-(ln(q / (1 - q)) + s))) END), 5) AS mean_adjusted, count_if(c >= 0.4) AS n_confirmable, max(s <> 0) AS applied, round(max(s), 3) AS shift FROM ad GROUP BY ALL
"""

_ALL = {
    "events_isolation_spans": (q_isolation, ISOLATION), "events_dead_balls": (q_dead_balls, DEAD), "events_last_touch": (q_last_touch, LAST_TOUCH), "events_resumptions": (q_resumptions, RESUMPTIONS),
    "events_pitch_crossings": (q_crossings, CROSSINGS), "lineitem_lines_and_halves": (q_lines, LINES), "lineitem_boxes_loaded": (q_boxes, BOXES), "lineitem_runners_into_box": (q_runners, RUNNERS),
    "lineitem_walls": (q_walls, WALLS), "part_cameras": (q_cameras, CAMERAS), "part_poses": (q_poses, POSES), "part_line_tendency": (q_line_tendency, LINE_TENDENCY), "lineitem_image_bands": (q_bands, BANDS),
    "orders_top_clips": (q_top_clips, TOP_CLIPS), "orders_event_filters": (q_event_filters, EVENT_FILTERS), "nation_match_profile": (q_match_profile, MATCH_PROFILE),
    "nation_scouting_report": (q_report, REPORT), "orders_prior_audit": (q_audit, AUDIT),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in _ALL.items()}
