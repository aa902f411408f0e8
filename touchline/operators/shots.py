"""Shot boundaries and continuous takes from frame signatures (clip_id, index, timestamp_s, histogram)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalar import histogram_distance
from touchline.operators.timeseries import segments


def distances(signatures: DataFrame) -> DataFrame:
    """Adds pos (from 0), dist to the frame before (0 for the first) and that frame's histogram (prev)."""
    w = W.partitionBy("clip_id").orderBy("index")
    held = signatures.withColumn("pos", F.row_number().over(w) - 1).withColumn("prev", F.lag("histogram").over(w))
    return held.withColumn("dist", F.coalesce(histogram_distance(F.col("histogram"), F.col("prev")), F.lit(0.0)))


def thresholds(dist: DataFrame, mad_k: float = 6.0, least: float = 0.15) -> DataFrame:
    """Per clip max(median + mad_k * MAD, least) of the distances without the first frame's."""
    body = dist.filter("pos > 0")
    med = body.groupBy("clip_id").agg(F.median("dist").alias("med"))
    mad = body.join(med, "clip_id").groupBy("clip_id", "med").agg(F.median(F.abs(F.col("dist") - F.col("med"))).alias("mad"))
    return mad.select("clip_id", F.greatest(F.col("med") + mad_k * F.col("mad"), F.lit(least)).alias("threshold"))


def boundaries(dist: DataFrame, threshold: DataFrame, min_frames: int = 8) -> DataFrame:
    """Frames that start a shot. Crossings less than min_frames apart form a cluster; a cluster of several is
    dropped if the frames before and after it look alike, else its strongest crossing (the first) stands."""
    crossing = dist.join(threshold, "clip_id").filter((F.col("pos") > 0) & (F.col("dist") > F.col("threshold")))
    gap = min_frames - 1 if min_frames > 1 else 0
    held = segments(crossing, ["clip_id"], "pos", gap, name="cluster")
    clusters = held.groupBy("clip_id", "cluster").agg(
        F.count("*").alias("n"), F.min_by("prev", "pos").alias("before"), F.max_by("histogram", "pos").alias("after"), F.first("threshold").alias("threshold"),
        F.max_by(F.struct("index", "timestamp_s", "dist", "pos"), F.struct("dist", -F.col("pos"))).alias("best"),
    )
    real = clusters.filter((F.col("n") == 1) | (histogram_distance(F.col("before"), F.col("after")) > F.col("threshold")))
    margin = F.when(F.col("threshold") > 0, F.col("best.dist") / F.col("threshold")).otherwise(F.lit(float("inf")))
    return real.select("clip_id", "best.*", "threshold", margin.alias("margin"))


def takes(dist: DataFrame, bounds: DataFrame) -> DataFrame:
    """Segments between boundaries; a take ends with its last frame."""
    marks = bounds.select("clip_id", "pos", F.lit(1).alias("cut"))
    w = W.partitionBy("clip_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    held = dist.select("clip_id", "pos", "index", "timestamp_s").join(marks, ["clip_id", "pos"], "left").withColumn("take", F.sum(F.coalesce("cut", F.lit(0))).over(w))
    return held.groupBy("clip_id", "take").agg(
        F.min("index").alias("start_index"), (F.max("index") + 1).alias("end_index"), F.min("timestamp_s").alias("start_s"), F.max("timestamp_s").alias("end_s"), F.count("*").alias("n_frames")
    )


def report(take_rows: DataFrame, threshold: DataFrame) -> DataFrame:
    rows = take_rows.groupBy("clip_id").agg(
        F.sum("n_frames").alias("n_frames"), F.count("*").alias("n_segments"), (F.max("end_s") - F.min("start_s")).alias("duration_s"),
        F.max(F.col("end_s") - F.col("start_s")).alias("longest_s"), F.median(F.col("end_s") - F.col("start_s")).alias("median_s"),
    )
    rows = rows.join(threshold, "clip_id", "left").withColumn("n_boundaries", F.col("n_segments") - 1)
    return rows.withColumn("cuts_per_min", F.when(F.col("duration_s") > 0, F.col("n_boundaries") * 60 / F.col("duration_s"))).withColumn("single_shot", F.col("n_segments") <= 1)


def take_of(frames: DataFrame, take_rows: DataFrame) -> DataFrame:
    """The take of each (clip_id, index), or null: start <= index < end, by the last start at or before it."""
    starts = take_rows.select("clip_id", F.col("start_index").alias("index"), F.struct("take", "end_index").alias("t_"))
    rows = frames.withColumn("t_", F.lit(None).cast(starts.schema["t_"].dataType)).withColumn("s_", F.lit(1))
    rows = rows.unionByName(starts.withColumn("s_", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy("clip_id").orderBy("index", "s_").rowsBetween(W.unboundedPreceding, 0)
    held = rows.withColumn("t_", F.last("t_", ignorenulls=True).over(w)).filter("s_ = 1")
    return held.withColumn("take", F.when(F.col("index") < F.col("t_.end_index"), F.col("t_.take"))).drop("t_", "s_")
