"""From player and ball observations to per-frame features.

player_obs: match_id, frame_index, timestamp_s, period, track_id, team, role, x, y. ball_obs: match_id,
frame_index, timestamp_s, period, x, y. frames: match_id, frame_index, timestamp_s, period. attack_dir: match_id,
period, team, dir (1 or -1), a few rows for each match. Matches and segments run in parallel: everything is
keyed by (match_id, segment_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalar import PITCH_LENGTH_M, PITCH_WIDTH_M
from touchline.operators import shape
from touchline.operators import timeseries as ts
from touchline.sources.shared import by_shuffle, written

K = ["match_id", "segment_id"]


@dataclass(frozen=True)
class FeatureConfig:
    resample_hz: float = 5.0
    max_gap_s: float = 1.0
    smoothing_window_s: float = 1.0
    min_visible_for_shape: int = 5
    possession_radius_m: float = 2.0
    turnover_persistence_s: float = 2.0
    out_of_bounds_margin_m: float = 0.5
    runner_speed_ms: float = 5.5

    @property
    def dt(self) -> float:
        return 1.0 / self.resample_hz

    def window(self, seconds: float | None = None) -> int:
        w = max(1, round((self.smoothing_window_s if seconds is None else seconds) * self.resample_hz))
        return w + (w % 2 == 0)


class UnknownPeriodError(ValueError):
    """A match has no direction of attack for one of its periods."""


def check_directions(frames: DataFrame, attack_dir: DataFrame) -> None:
    missing = frames.select("match_id", "period").distinct().join(by_shuffle(attack_dir), ["match_id", "period"], "left_anti").take(1)
    if missing:
        raise UnknownPeriodError(f"no attack direction for {missing[0].asDict()}")


def segmented(frames: DataFrame, cfg: FeatureConfig) -> DataFrame:
    return ts.segments(frames, ["match_id"], "timestamp_s", cfg.max_gap_s, also="period")


def _smoothed(df: DataFrame, keys: list[str], window: int) -> DataFrame:
    for c in ("x", "y"):
        df = ts.moving_average(df, keys, "i", c, window, f"s{c}")
        df = ts.derivative(df, keys, "i", "timestamp_s", f"s{c}", f"v{c}").withColumn(c, F.col(f"s{c}")).drop(f"s{c}")
    return df


def resampled(frames: DataFrame, player_obs: DataFrame, ball_obs: DataFrame, cfg: FeatureConfig = FeatureConfig(), ball_window_s: float | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(players, ball) on an even grid: K, i, timestamp_s, period, x, y, vx, vy (players also track_id, team and
    role, those of the track's last observation in the segment)."""
    seg = segmented(frames, cfg)
    of_frame = seg.select("match_id", "frame_index", "segment_id")
    points = ts.grid(seg, [*K, "period"], "timestamp_s", cfg.dt)
    obs = player_obs.join(by_shuffle(of_frame), ["match_id", "frame_index"])
    tracks = obs.groupBy(*K, "track_id").agg(F.max_by(F.struct("team", "role"), "timestamp_s").alias("tr")).select(*K, "track_id", "tr.*")
    keys = [*K, "track_id"]
    wanted = points.join(by_shuffle(tracks.select(*keys)), K)
    placed = ts.resample(wanted.select(*keys, "i", "timestamp_s"), obs.select(*keys, "timestamp_s", "x", "y"), keys, "timestamp_s", ["x", "y"], cfg.dt, cfg.max_gap_s)
    players = _smoothed(placed, keys, cfg.window()).join(by_shuffle(tracks), keys)
    seen = ball_obs.filter("x IS NOT NULL AND y IS NOT NULL").join(by_shuffle(of_frame), ["match_id", "frame_index"])
    at = ts.resample(points.select(*K, "i", "timestamp_s"), seen.select(*K, "timestamp_s", "x", "y"), K, "timestamp_s", ["x", "y"], cfg.dt, cfg.max_gap_s)
    ball = _smoothed(at, K, cfg.window(ball_window_s)).join(by_shuffle(points.select(*K, "period").distinct()), K)
    return players, ball


def possession_states(players: DataFrame, ball: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """The ball rows with ball_x, ball_y, read, holder, state, flip and since_flip."""
    frame = [*K, "i"]
    b = ball.withColumnRenamed("x", "ball_x").withColumnRenamed("y", "ball_y").withColumnRenamed("vx", "ball_vx").withColumnRenamed("vy", "ball_vy")
    can_hold = players.filter(F.col("team").isin("home", "away") & F.col("role").isin("outfield", "goalkeeper"))
    dists = shape.ball_distances(can_hold.select(*frame, "track_id", "team", "x", "y"), b.select(*frame, "ball_x", "ball_y"), frame)
    margin = cfg.out_of_bounds_margin_m
    read = shape.raw_possession(dists, b, frame, cfg.possession_radius_m, PITCH_LENGTH_M / 2 + margin, PITCH_WIDTH_M / 2 + margin)
    return ts.possession(read, K, "timestamp_s", "read", cfg.turnover_persistence_s)


def team_features(players: DataFrame, states: DataFrame, attack_dir: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """One row per grid point and team: shape, pressure, derivatives, possession, ball in the team's direction of
    attack, and the frame's quality."""
    frame = [*K, "i"]
    both = states.join(by_shuffle(attack_dir), ["match_id", "period"])
    half = PITCH_LENGTH_M / 2
    both = both.withColumns({
        "ball_x_rel": F.col("dir") * F.col("ball_x") + half, "ball_y_rel": F.col("dir") * F.col("ball_y"), "ball_vx_rel": F.col("dir") * F.col("ball_vx"), "ball_valid": F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull(),
    })
    field = players.filter((F.col("role") == "outfield") & F.col("team").isin("home", "away"))
    rel = field.join(by_shuffle(both.select(*frame, "team", "dir", "ball_x_rel")), [*frame, "team"]).select(
        *frame, "team", (F.col("dir") * F.col("x") + half).alias("x_rel"), (F.col("dir") * F.col("y")).alias("y_rel"), (F.col("dir") * F.col("vx")).alias("vx_rel"), "ball_x_rel"
    )
    shapes = shape.team_shape(rel, frame, cfg.min_visible_for_shape, cfg.runner_speed_ms)
    dists = shape.ball_distances(field.select(*frame, "track_id", "team", "x", "y"), states.select(*frame, "ball_x", "ball_y", "state"), frame)
    press = shape.pressure(dists, frame)
    out = both.join(by_shuffle(shapes), [*frame, "team"], "left").join(by_shuffle(press.drop("state")), frame, "left").fillna(0, ["n_visible", "n_forward_runners", *(f"n_{x}" for x in shape.LANES)])
    attacking = F.col("team") == F.col("state")
    defending = F.col("state").isin("home", "away") & ~attacking
    out = out.withColumns({c: F.when(defending, F.col(c)) for c in ("nearest_defender", "within_5m", "within_15m", "mean3")})
    out = out.withColumn("within_5m", F.when(F.col("nearest_defender").isNotNull(), F.col("within_5m"))).withColumn("within_15m", F.when(F.col("nearest_defender").isNotNull(), F.col("within_15m")))
    out = out.withColumn("superiority_10m", F.when(attacking, F.col("superiority_10m")))
    keys = [*K, "team"]
    for source, name, sign in (("line_height", "line_velocity", 1), ("mean3", "closing_speed", -1)):
        out = ts.derivative(out, keys, "i", "timestamp_s", source, "d_")
        out = ts.moving_average(out, keys, "i", "d_", cfg.window(), name).drop("d_").withColumn(name, F.col(name) * sign)
    seen = F.sum("n_visible").over(ts.W.partitionBy(*frame))
    other = seen - F.col("n_visible")
    return out.withColumn("quality", shape.quality(F.col("n_visible"), other, F.col("ball_valid"))).drop("mean3")


def features(frames: DataFrame, player_obs: DataFrame, ball_obs: DataFrame, attack_dir: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:  # noqa: B008
    """All features as a written table. Each stage is read by several later ones, so it is written once: the
    resampled tracks, the possession states, and the features that the detectors share."""
    check_directions(frames, attack_dir)
    players, ball = resampled(frames, player_obs, ball_obs, cfg)
    players = written(players, "players")
    states = written(possession_states(players, ball, cfg), "states")
    return written(team_features(players, states, attack_dir, cfg), "features")
