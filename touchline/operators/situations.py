"""What match events are made of: runs of a condition, last touches, resumptions, walls, loaded boxes, lines.

Runs, touches and resumptions are windows over a series' keys; the rest aggregates the players of a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalar import PITCH_LENGTH_M, distance, soft_threshold
from touchline.operators.timeseries import islands, ordered
from touchline.sources.shared import by_shuffle

# Fixed values of the domain.
BOX_DEPTH_M, BOX_HALF_WIDTH_M = 16.5, 20.16


def long_runs(df: DataFrame, keys: list[str], t: str, flag: Column, least_s: float, **extra: Column) -> DataFrame:
    """Runs of rows where flag holds (null doesn't) that last least_s at least: keys, start_t, end_t, n and the
    aggregates `extra`. With a flag on the nearest player's distance these are spans of isolation, with one on a
    ball at rest or missing the dead balls, with one on the centre spot the kickoffs to come."""
    runs = islands(df, keys, t, flag, "run")
    out = runs.groupBy(*keys, "run").agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("n"), *(c.alias(k) for k, c in extra.items()))
    return out.filter(F.col("end_t") - F.col("start_t") >= least_s - 1e-9).drop("run")


def dead_ball_point(x: str = "x", y: str = "y", least: int = 3) -> Column:
    """Aggregate: the median place of a run's valid balls, null with fewer than `least` of them."""
    seen = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.when(F.count_if(seen) >= least, F.struct(F.median(F.when(seen, F.col(x))).alias("x"), F.median(F.when(seen, F.col(y))).alias("y")))


def last_touch(df: DataFrame, keys: list[str], order: str, touch: str, back: int = 20, name: str = "last_touch") -> DataFrame:
    """Adds the latest non-null touch of the `back` rows before and of the row itself."""
    return df.withColumn(name, F.last(touch, ignorenulls=True).over(ordered(keys, order).rowsBetween(-back, 0)))


def valid_share(df: DataFrame, keys: list[str], order: str, valid: Column, reach: int = 5, name: str = "validity") -> DataFrame:
    """Adds 0.5 + 0.5 times the share of valid rows within `reach` rows."""
    share = F.avg(F.coalesce(valid, F.lit(False)).cast("double")).over(ordered(keys, order).rowsBetween(-reach, reach))
    return df.withColumn(name, 0.5 + 0.5 * share)


def resumptions(df: DataFrame, keys: list[str], t: str, asks: Column, plays: Column, n: int = 5, horizon: float = 90.0) -> DataFrame:
    """For each row that asks, the first later time, within the horizon, from which `plays` holds for n rows: its
    column resumed_t, null if there is none. One window over the keys, no join."""
    w = ordered(keys, t)
    held = df.withColumns({"asks_": F.coalesce(asks, F.lit(False)), "plays_": F.coalesce(plays, F.lit(False)).cast("int")})
    runs = w.rowsBetween(0, n - 1)
    held = held.withColumn("from_", F.when((F.sum("plays_").over(runs) == n), F.col(t)))
    # From the series' end backwards: a running frame, however long the key.
    first = F.last("from_", ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.col(t).desc()).rowsBetween(W.unboundedPreceding, -1))
    held = held.withColumn("resumed_t", F.when(first <= F.col(t) + horizon, first))
    return held.filter("asks_").drop("asks_", "plays_", "from_")


def half_separation(players: DataFrame, frame: list[str], least: int = 4, margin: float = 2.0, share: float = 0.75) -> DataFrame:
    """Per frame how well the teams keep to their own halves: a soft threshold on the lower of their shares, 0.6
    where no team has `least` outfielders in view. players: frame, team, role, x_rel (0 at the own goal line)."""
    own = (F.col("x_rel") <= PITCH_LENGTH_M / 2 + margin) & (F.col("role") == "outfield")
    teams = players.groupBy(*frame, "team").agg(F.count_if(F.col("role") == "outfield").alias("n"), F.count_if(own).alias("own"))
    low = teams.groupBy(*frame).agg(F.min(F.when(F.col("n") >= least, F.col("own") / F.col("n"))).alias("low"))
    return low.select(*frame, F.when(F.col("low").isNull(), 0.6).otherwise(soft_threshold(F.col("low"), share, 0.08)).alias("separation"))


def opposing_line(players: DataFrame, frame: list[str], least: int = 4) -> DataFrame:
    """Per frame and team the line that it defends, as the opponents see it: 105 less its second deepest outfielder's
    x_rel, null with fewer than `least` in view. players: frame, team, role, x_rel."""
    deep = W.partitionBy(*frame, "team").orderBy("x_rel")
    field = players.filter(F.col("role") == "outfield").withColumn("k", F.row_number().over(deep))
    rows = field.groupBy(*frame, "team").agg(F.count("*").alias("n"), F.min(F.when(F.col("k") == 2, F.col("x_rel"))).alias("second"))
    return rows.select(*frame, "team", F.when(F.col("n") >= least, PITCH_LENGTH_M - F.col("second")).alias("line_x"))


def in_box(x: Column, y: Column, sign: int) -> Column:
    return (x * sign >= PITCH_LENGTH_M / 2 - BOX_DEPTH_M) & (F.abs(y) <= BOX_HALF_WIDTH_M)


def boxes_loaded(players: DataFrame, frame: list[str], least: int = 3, within: float | None = None) -> DataFrame:
    """Per frame whether both teams have `least` players in one penalty box. players: frame, team, x, y; with
    `within` also ball_x and ball_y, and a box counts only if its goal is as near to the ball, or the ball unknown."""

    def reachable(s: int) -> Column:
        away = F.hypot(F.col("ball_x") - s * PITCH_LENGTH_M / 2, F.col("ball_y"))
        return F.lit(True) if within is None else F.coalesce(away <= within, F.lit(True))

    inside = {(team, s): F.count_if((F.col("team") == team) & in_box(F.col("x"), F.col("y"), s) & reachable(s)) for team in ("home", "away") for s in (1, -1)}
    rows = players.groupBy(*frame).agg(*(c.alias(f"{team}{s}") for (team, s), c in inside.items()))
    loaded = [(F.col(f"`home{s}`") >= least) & (F.col(f"`away{s}`") >= least) for s in (1, -1)]
    return rows.select(*frame, (loaded[0] | loaded[1]).alias("loaded"))


def runners_into_box(players: DataFrame, keys: list[str], order: str, deliveries: DataFrame, window: int) -> DataFrame:
    """Per delivery (keys, order, team) how many of the team's players are in a box `window` rows later that they
    weren't in at it; of the two boxes the fuller counts. players: keys, order, track_id, team, x, y."""
    at = deliveries.select(*keys, order, "team")
    now = players.select(*keys, order, "track_id", "team", F.col("x").alias("x0"), F.col("y").alias("y0")).join(by_shuffle(at), [*keys, order, "team"])
    later = players.select(*keys, (F.col(order) - window).alias(order), "track_id", "team", F.col("x").alias("x1"), F.col("y").alias("y1"))
    both = now.join(by_shuffle(later), [*keys, order, "track_id", "team"])
    came = [F.count_if(~in_box(F.col("x0"), F.col("y0"), s) & in_box(F.col("x1"), F.col("y1"), s)) for s in (1, -1)]
    n = both.groupBy(*keys, order, "team").agg(F.greatest(*came).alias("runners"))
    return at.join(by_shuffle(n), [*keys, order, "team"], "left").withColumn("runners", F.coalesce("runners", F.lit(0)))


def walls(players: DataFrame, frame: list[str], annulus: tuple[float, float] = (6.0, 12.0), least: int = 3, spread: float = 1.0, gap: float = 2.2) -> DataFrame:
    """Per frame the team that forms a wall, and of how many: players in a ring around the ball, nearer to their goal
    than it is, close to a straight line without wide gaps. Home goes first if both do.

    players: frame, team, x, y, ball_x, ball_y, dir (of the team's attack). The line is the principal axis of the
    team's covariance, so one aggregation and one window over a frame's few candidates settle it.
    """
    goal_x = -F.col("dir") * PITCH_LENGTH_M / 2
    away = distance(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y"))
    near = players.filter(away.between(*annulus) & (distance(goal_x - F.col("x"), F.col("y")) < distance(goal_x - F.col("ball_x"), F.col("ball_y"))))
    group = W.partitionBy(*frame, "team")
    theta = 0.5 * F.atan2(2 * F.covar_pop("x", "y").over(group), F.var_pop("x").over(group) - F.var_pop("y").over(group))
    line = near.withColumns({"theta": theta, "mx": F.avg("x").over(group), "my": F.avg("y").over(group)})
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    line = line.withColumns({"along": dx * F.cos("theta") + dy * F.sin("theta"), "off": dy * F.cos("theta") - dx * F.sin("theta")})
    line = line.withColumn("gap", F.col("along") - F.lag("along").over(group.orderBy("along")))
    teams = line.groupBy(*frame, "team").agg(F.count("*").alias("n"), F.stddev_pop("off").alias("spread"), F.max("gap").alias("gap"))
    kept = teams.filter((F.col("n") >= least) & (F.col("spread") <= spread) & (F.col("gap") <= gap))
    return kept.groupBy(*frame).agg(F.max_by(F.struct("team", "n"), "team").alias("w")).select(*frame, "w.team", "w.n")
