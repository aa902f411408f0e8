"""Team shape, pressure and nearest players: one row per (frame, team) from player positions.

Players of a frame are at most a few dozen, so everything that compares them is an equi-join on the frame and
an aggregation; arrays hold one team of one frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalar import distance, hull_area, lane
from touchline.sources.shared import by_shuffle

LANES = ("wide_left", "halfspace_left", "centre", "halfspace_right", "wide_right")


def _pstdev(values: Column) -> Column:
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(values))


def team_shape(players: DataFrame, frame: list[str], min_visible: int = 5, runner_speed: float = 5.5) -> DataFrame:
    """players: frame columns, team, x_rel, y_rel, vx_rel and ball_x_rel (team-relative; ball may be null).

    Counts exist at any visibility; the shape is null for teams with fewer than min_visible players.
    """
    seen = players.filter(F.col("x_rel").isNotNull() & F.col("y_rel").isNotNull()).withColumn("lane", lane(F.col("y_rel")))
    rows = seen.groupBy(*frame, "team").agg(
        F.count("*").alias("n_visible"), F.avg("x_rel").alias("cx"), F.avg("y_rel").alias("cy"), (F.max("y_rel") - F.min("y_rel")).alias("w"),
        (F.max("x_rel") - F.min("x_rel")).alias("d"), F.array_sort(F.collect_list("x_rel")).alias("xs"), F.collect_list(F.struct(F.col("x_rel").alias("x"), F.col("y_rel").alias("y"))).alias("ps"),
        F.count_if(F.col("vx_rel") >= runner_speed).alias("n_forward_runners"), F.count_if(F.col("x_rel") < F.col("ball_x_rel")).alias("behind"), F.max("ball_x_rel").alias("bx"),
        *(F.count_if(F.col("lane") == name).alias(f"n_{name}") for name in LANES),
    )

    def shown(c: Column) -> Column:
        return F.when(F.col("n_visible") >= min_visible, c)

    spread = F.aggregate("ps", F.lit(0.0), lambda s, p: s + F.hypot(p["x"] - F.col("cx"), p["y"] - F.col("cy"))) / F.size("ps")
    return rows.select(
        *frame, "team", "n_visible", "n_forward_runners", *(f"n_{name}" for name in LANES), shown(F.col("cx")).alias("centroid_x"), shown(F.col("cy")).alias("centroid_y"),
        shown(F.col("w")).alias("width"), shown(F.col("d")).alias("depth"), shown(hull_area(F.col("ps"))).alias("hull_area"), shown(spread).alias("stretch"),
        shown(F.get("xs", F.lit(1))).alias("line_height"), shown(F.when(F.size("xs") >= 4, _pstdev(F.slice("xs", 1, 4)))).alias("line_flatness"),
        shown(F.when(F.col("bx").isNotNull(), F.col("behind"))).alias("n_behind_ball"),
    )


def ball_distances(players: DataFrame, ball: DataFrame, frame: list[str]) -> DataFrame:
    """Players with dist, their distance to the ball of their frame; frames without a ball drop out."""
    seen = ball.filter(F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull())
    return players.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).join(by_shuffle(seen), frame).withColumn("dist", distance(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y")))


def nearest_player(dists: DataFrame, frame: list[str], by: list[str] = [], max_dist: float | None = None) -> DataFrame:  # noqa: B006
    """The nearest player of each frame (and `by`): track_id and dist; the lower track_id of two equally near."""
    near = dists if max_dist is None else dists.filter(F.col("dist") <= max_dist)
    return near.groupBy(*frame, *by).agg(F.min(F.struct("dist", "track_id")).alias("m")).select(*frame, *by, "m.track_id", "m.dist")


def raw_possession(dists: DataFrame, ball: DataFrame, frame: list[str], radius: float = 2.0, half_x: float = 53.0, half_y: float = 34.5) -> DataFrame:
    """Per ball row the read: 'dead' outside the pitch, 'contested' with both teams in the radius, the one team
    that is, or null (also without a ball)."""
    near = nearest_player(dists, frame, ["team"], radius).groupBy(*frame).agg(
        F.max(F.col("team") == "home").alias("home"), F.max(F.col("team") == "away").alias("away"), F.min_by("track_id", "dist").alias("holder")
    )
    dead = (F.abs("ball_x") > half_x) | (F.abs("ball_y") > half_y)
    read = F.when(dead, "dead").when(F.col("home") & F.col("away"), "contested").when(F.col("home"), "home").when(F.col("away"), "away")
    return ball.join(by_shuffle(near), frame, "left").select(*ball.columns, read.alias("read"), F.when(read.isin("home", "away"), F.col("holder")).alias("holder"))


def pressure(dists: DataFrame, frame: list[str], possession: str = "state") -> DataFrame:
    """Per frame in clear possession: the defenders' nearest distance, counts within 5 and 15 m, the mean of
    their three nearest distances, and the attackers' surplus within 10 m."""
    live = dists.filter(F.col(possession).isin("home", "away"))
    attack = F.col("team") == F.col(possession)
    rows = live.groupBy(*frame, possession).agg(
        F.min(F.when(~attack, F.col("dist"))).alias("nearest_defender"), F.count_if(~attack & (F.col("dist") <= 5)).alias("within_5m"), F.count_if(~attack & (F.col("dist") <= 15)).alias("within_15m"),
        F.slice(F.array_sort(F.collect_list(F.when(~attack, F.col("dist")))), 1, 3).alias("near3"),
        (F.count_if(attack & (F.col("dist") <= 10)) - F.count_if(~attack & (F.col("dist") <= 10))).alias("superiority_10m"),
    )
    return rows.withColumn("mean3", F.when(F.size("near3") > 0, F.aggregate("near3", F.lit(0.0), lambda s, x: s + x) / F.size("near3"))).drop("near3")


def quality(home: Column, away: Column, ball_valid: Column) -> Column:
    """Visibility score of a frame, halved without a ball."""
    part = F.least(F.coalesce(home, F.lit(0)), F.lit(8)) / 8 * (F.least(F.coalesce(away, F.lit(0)), F.lit(8)) / 8)
    return F.when(ball_valid, part).otherwise(part * 0.5)
