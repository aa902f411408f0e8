"""Tracking tables that Spark derives from the events table: users are matches, their events frames.

Where the ball goes is summed up from the events' values and the numbers in their properties, and purchases of a
high value turn the possession; the players keep their places in a line-up that follows the ball, each off by a
number of its own from the same columns. The work grows with events: 22 player rows for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalar import bounded
from touchline.sources.tables import table


def reflected(c: Column, half: float) -> Column:
    """c within [-half, half], turned back at both ends."""
    return F.abs(F.pmod(c + half, F.lit(4 * half)) - 2 * half) * -1 + half


def tracking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(frames, player_obs, ball_obs, attack_dir) at 5 Hz, with a pause of 3 s and a new period now and then."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    sofar, recent = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(-14, 0)
    e = e.withColumns({
        "k": F.row_number().over(w) - 1, "v": F.coalesce(F.col("value"), F.lit(50.0)) - 50, "m": F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(50.0)) - 50,
        "turns": F.sum(((F.col("event_type") == "purchase") & (F.col("value") > 80)).cast("int")).over(sofar),
    }).withColumns({"dx": F.avg("v").over(recent) / 20, "dy": F.avg("m").over(recent) / 25})
    # A pause after every 400th frame.
    base = e.select(
        F.col("user_id").cast("string").alias("match_id"), F.col("k").cast("long").alias("frame_index"), (F.col("k") * 0.2 + F.floor(F.col("k") / 400) * 3.0).alias("timestamp_s"),
        (F.floor(F.col("k") / 800) % 2 + 1).cast("int").alias("period"), "event_type", "v", "m", "turns", reflected(F.sum("dx").over(sofar), 51.0).alias("bx"), reflected(F.sum("dy").over(sofar), 33.0).alias("by"),
    )
    frames = base.select("match_id", "frame_index", "timestamp_s", "period")
    seen = F.col("event_type") != "error"
    ball_obs = base.select("match_id", "frame_index", "timestamp_s", "period", F.when(seen, F.col("bx")).alias("x"), F.when(seen, F.col("by")).alias("y"))
    n = F.col("n")
    players = base.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(21)))).withColumn("team", F.when(n < 11, "home").otherwise("away"))
    sign = F.when(F.col("team") == "home", 1.0).otherwise(-1.0)
    slot = n % 11
    holder = (slot == 5) & ((F.col("team") == "home") == (F.col("turns") % 2 == 0))
    own = (F.pmod(F.col("v") * (n + 3), F.lit(20.0)) - 10) / 10
    x = F.when(holder, F.col("bx") + 0.4).otherwise(bounded(0.6 * F.col("bx") + sign * ((slot - 5) * 5.0 - 10.0) + own, -52.0, 52.0))
    y = F.when(holder, F.col("by") + 0.3).otherwise(0.45 * F.col("by") + ((slot * 7) % 11 - 5) * 5.0 + F.pmod(F.col("m") * (n + 5), F.lit(20.0)) / 10 - 1)
    player_obs = players.select(
        "match_id", "frame_index", "timestamp_s", "period", (n + F.when(n < 11, 100).otherwise(189)).cast("long").alias("track_id"), "team", F.when(slot == 0, "goalkeeper").otherwise("outfield").alias("role"), x.alias("x"), y.alias("y")
    )
    sides = F.explode(F.array(F.struct(F.lit("home").alias("team"), F.lit(1).alias("s")), F.struct(F.lit("away").alias("team"), F.lit(-1).alias("s"))))
    attack = frames.select("match_id", "period").distinct().withColumn("d", sides).select("match_id", "period", F.col("d.team").alias("team"), (F.col("d.s") * F.when(F.col("period") == 1, 1).otherwise(-1)).alias("dir"))
    return frames, player_obs, ball_obs, attack
