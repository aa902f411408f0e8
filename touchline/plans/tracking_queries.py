"""Feature, possession and pattern operators over tracking tables derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import ball, calibration, events, features, match_events, patterns, scouting
from touchline.operators import timeseries as ts
from touchline.sources.derived import tracking
from touchline.plans.domain_queries import PLAYERS, players as line_players
from touchline.plans.series_queries import POINTS, points
from touchline.sources.shared import written


def r(c, n=6):
    return F.round(c, n)


def rows(spark, d):
    frames, players, ball, attack = tracking(spark, d)
    return features.features(written(frames, "frames"), written(players, "player-obs"), written(ball, "ball-obs"), attack)


def q_features(spark, d):
    names = ("centroid_x", "centroid_y", "width", "depth", "hull_area", "stretch", "line_height", "line_flatness", "line_velocity", "closing_speed", "nearest_defender", "quality", "since_flip")
    return rows(spark, d).select("match_id", "segment_id", "i", "team", "state", "n_visible", "within_15m", "superiority_10m", "n_behind_ball", *(r(c, 4).alias(c) for c in names))


def q_states(spark, d):
    frames, players, ball, _ = tracking(spark, d)
    p, b = features.resampled(frames, players, ball)
    return features.possession_states(p, b).select("match_id", "segment_id", "i", "read", "holder", "state", "flip", r("since_flip", 4).alias("since_flip"))


def _pattern(build):
    def query(spark, d):
        return build(rows(spark, d)).select("match_id", "segment_id", "team", "pattern_id", "period", *(r(c, 4).alias(c) for c in ("start_s", "end_s", "confidence", "intensity")), F.to_json("tags").alias("tags"))

    return query


def q_profile(spark, d):
    frames = tracking(spark, d)[0]
    observed = ts.observed_seconds(features.segmented(frames, features.FeatureConfig()), ["match_id"], "timestamp_s")
    p = scouting.pattern_profile(patterns.detect_all(rows(spark, d)), observed)
    return p.select("match_id", "pattern_id", "team", "n", *(r(c, 4).alias(c) for c in ("rate_per_90", "mean_confidence", "mean_intensity", "max_intensity", "total_s")))


def _resampled(spark, d, ball_window_s=0.4):
    frames, players, ball_obs, _ = tracking(spark, d)
    p, b = features.resampled(frames, players, ball_obs, ball_window_s=ball_window_s)
    return written(p, "players"), written(b, "ball")


def q_launches(spark, d):
    found = events.launches(*_resampled(spark, d))
    return found.select("match_id", "segment_id", "i", "kind", "kicker", *(r(c, 4).alias(c) for c in ("t", "x", "y", "speed", "kicker_dist")))


def q_stoppages(spark, d):
    p, b = _resampled(spark, d)
    kicks = events.launches(p, b).select("match_id", "segment_id", F.col("t").alias("start_t"), (F.col("t") + 1.0).alias("end_t"), F.lit("pass").alias("event_type"))
    return events.stoppages(p, b, kicks).select("match_id", "segment_id", "period", "explained_by", *(r(c, 4).alias(c) for c in ("start_t", "end_t", "confidence", "ball_observed")))


def q_shots(spark, d):
    """No restarts are known, so only what the ball does after a shot speaks."""
    p, b = _resampled(spark, d)
    found = match_events.shots(events.launches(p, b), p, b, tracking(spark, d)[3])
    return found.select("match_id", "segment_id", "i", "team", "shooter", "outcome", "blocker", *(r(c, 4).alias(c) for c in ("start_t", "end_t", "confidence", "distance", "y_goal", "outcome_confidence")))


def q_set_pieces(spark, d):
    p, b = _resampled(spark, d)
    found = match_events.set_pieces(events.launches(p, b), p, b, tracking(spark, d)[3])
    return found.select("match_id", "segment_id", "team", "organisation", "wall_team", "wall_size", "box_loaded", "taker", "resumed", "runners_into_box", *(r(c, 4).alias(c) for c in ("start_t", "end_t", "x", "y", "confidence")))


def _samples(spark, d):
    _, _, b, _ = tracking(spark, d)
    seen = F.col("x").isNotNull()
    b = ts.segments(b, ["match_id"], "timestamp_s", 1.0, also="period")
    return b.select("match_id", "segment_id", F.col("timestamp_s").alias("t"), "x", "y", F.when(seen, 0.2 + F.pmod("frame_index", F.lit(5)) / 10).alias("confidence"), (F.pmod("frame_index", F.lit(11)) == 0).cast("int").alias("extra")).withColumn(
        "n_candidates", F.col("extra") + seen.cast("int")
    ).withColumn("interpolated", F.lit(False)).drop("extra")


def q_ball_quality(spark, d):
    return ball.ball_quality(_samples(spark, d), features.K).select("match_id", "segment_id", r("t", 3).alias("t"), r("quality", 5).alias("quality"), r("support", 5).alias("support"), r("speed", 4).alias("speed"))


def q_ball_smoothed(spark, d):
    """Nothing bridges a cut: quality and smoothing are those of a segment."""
    scored = ball.ball_quality(_samples(spark, d), features.K)
    out = ball.smoothed(scored, features.K, bidirectional=True)
    return out.select("match_id", "segment_id", r("t", 3).alias("t"), "status", *(r(c, 4).alias(c) for c in ("sx", "sy", "svx", "svy")))


def _correspondences(spark, d):
    """The lines of an order as landmarks: pitch points, and their pixels under a camera that varies by order."""
    p = line_players(spark, d).select("frame", F.col("track_id").alias("landmark"), F.col("x").alias("wx"), F.col("y").alias("wy"))
    w = 1 + 0.002 * F.col("wx") + 0.001 * F.col("wy")
    shift = F.pmod("frame", F.lit(40))
    return p.withColumns({"u": (900 + 12 * F.col("wx") + 2 * F.col("wy") + shift) / w, "v": (500 - 3 * F.col("wx") + 9 * F.col("wy")) / w})


def q_support(spark, d):
    return calibration.support(_correspondences(spark, d), ["frame"]).select("frame", "n", *(r(c, 5).alias(c) for c in ("major", "minor", "collinearity")))


SUPPORT = PLAYERS + """, m AS (SELECT frame, count(*) AS n, var_pop(x) AS a, var_pop(y) AS d, covar_pop(x, y) AS b FROM pl GROUP BY frame
), e AS (SELECT frame, n, sqrt((a + d) / 2 + sqrt(power((a - d) / 2, 2) + b * b)) AS major, sqrt(greatest(0, (a + d) / 2 - sqrt(power((a - d) / 2, 2) + b * b))) AS minor FROM m)
SELECT frame, n, round(major, 5) AS major, round(minor, 5) AS minor, round(CASE WHEN major > 0 THEN 1 - minor / major ELSE 1 END, 5) AS collinearity FROM e
"""


def q_homography(spark, d):
    """Whether a frame's landmarks settle its homography, and whether this gives their places back. Exact points need only a
    gap above rounding."""
    fits = calibration.fit_homographies(written(_correspondences(spark, d), "correspondences"), ["frame"], min_gap=1e-13)
    return fits.select("frame", "n", F.col("h").isNotNull().alias("fitted"), (F.col("rms") < 1e-3).alias("exact"))


#: Four landmarks of which no three are on a line settle a homography.
HOMOGRAPHY = PLAYERS + """, t AS (
  SELECT DISTINCT frame, x, y FROM pl
), k AS (
  SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x, y) AS k FROM t
), q AS (
  SELECT a.frame FROM k a JOIN k b ON b.frame = a.frame AND b.k > a.k JOIN k c ON c.frame = a.frame AND c.k > b.k JOIN k d ON d.frame = a.frame AND d.k > c.k
  WHERE (b.x - a.x) * (c.y - a.y) <> (c.x - a.x) * (b.y - a.y) AND (b.x - a.x) * (d.y - a.y) <> (d.x - a.x) * (b.y - a.y) AND (c.x - a.x) * (d.y - a.y) <> (d.x - a.x) * (c.y - a.y) AND (c.x - b.x) * (d.y - b.y) <> (d.x - b.x) * (c.y - b.y)
  GROUP BY a.frame
)
SELECT pl.frame, count(*) AS n, bool_or(q.frame IS NOT NULL) AS fitted, CASE WHEN bool_or(q.frame IS NOT NULL) THEN true END AS exact FROM pl LEFT JOIN q ON q.frame = pl.frame GROUP BY pl.frame
"""


def q_teleports(spark, d):
    return calibration.teleports(points(spark, d), ["user_id"], "t", 0.01)


TELEPORTS = "WITH " + POINTS + """, w AS (SELECT user_id, sqrt(power(x - lag(x) OVER k, 2) + power(y - lag(y) OVER k, 2)) / nullif(greatest(t - lag(t) OVER k, 0), 0) AS pace FROM p WHERE x IS NOT NULL WINDOW k AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, count_if(pace > 0.01) AS n_teleports FROM w GROUP BY user_id
"""

QUERIES = {
    "tracks_team_features": q_features, "tracks_possession": q_states, **{f"tracks_{k}": _pattern(b) for k, b in patterns.DETECTORS.items()}, "tracks_pattern_profile": q_profile,
    "tracks_launches": q_launches, "tracks_stoppages": q_stoppages, "tracks_shots": q_shots, "tracks_set_pieces": q_set_pieces, "tracks_ball_quality": q_ball_quality, "tracks_ball_smoothed": q_ball_smoothed, "lineitem_landmark_support": q_support,
    "lineitem_homographies": q_homography, "events_teleports": q_teleports,
}
ORACLE_SQL = {"lineitem_landmark_support": SUPPORT, "lineitem_homographies": HOMOGRAPHY, "events_teleports": TELEPORTS}
