"""Places whose distances are ties: SQL and the queries settle them in the same way."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import shape, situations

PLAYERS = "frame long, track_id long, team string, x double, y double"


def frames(spark, players, ball_x, ball_y):
    return spark.createDataFrame([(1, *p) for p in players], PLAYERS), spark.createDataFrame([(1, ball_x, ball_y)], "frame long, ball_x double, ball_y double")


def test_nearest_of_two_that_differ_in_the_last_place(spark):
    p, b = frames(spark, [(4, "away", 7.0, 27.0), (6, "away", 18.0, 28.0)], 67 / 5, 88 / 5)
    got = shape.nearest_player(shape.ball_distances(p, b, ["frame"]), ["frame"], ["team"], 15.0).first()
    assert got["track_id"] == 6


@pytest.mark.parametrize(("player", "ball"), [((2, "away", 27.0, 8.0), (111 / 5, 58 / 5)), ((6, "away", 27.0, -17.0), (111 / 5, -67 / 5))])
def test_a_player_on_the_radius_is_as_sql_has_it(spark, player, ball):
    p, b = frames(spark, [player], *ball)
    within = (player[2] - ball[0]) * (player[2] - ball[0]) + (player[3] - ball[1]) * (player[3] - ball[1])
    dists = shape.ball_distances(p, b, ["frame"])
    read = shape.raw_possession(dists, b, ["frame"], 6.0, 40.0, 20.0).first()["read"]
    assert read == ("away" if within**0.5 <= 6.0 else None)
    # Pressure is that of the frames in clear possession.
    live = b.withColumn("state", F.lit(read))
    assert shape.pressure(shape.ball_distances(p, live, ["frame"]), ["frame"]).count() == (read is not None)


def test_a_player_on_the_ring_of_a_wall_counts(spark):
    p, b = frames(spark, [(2, "away", 27.0, 8.0), (4, "away", 25.0, 10.0)], 111 / 5, 58 / 5)
    got = situations.walls(p.join(b, "frame").withColumn("dir", F.lit(-1)), ["frame"], annulus=(0.0, 6.0), least=2, spread=6.0, gap=25.0).first()
    assert tuple(got) == (1, "away", 2)
