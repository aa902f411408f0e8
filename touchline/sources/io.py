"""Readers and writers of the file formats. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.scouting import RULE_SCHEMA

PROBE = "index long, frame string, imgsz int, balls array<array<double>>, n_persons int"
HOMOGRAPHY = "frame string, image_width int, image_height int, keypoints_px map<string,array<double>>, h_image_to_pitch array<array<double>>, line_no long"
SIGNATURE = "clip_id string, index long, timestamp_s double, histogram array<double>"
LABELS = (
    "schema string, clip_id string, source string, frames_folder string, n_frames_total long, stride int, resolution struct<width:int,height:int>, sampled_indices array<long>, "
    "labels array<struct<index:long,frame:string,status:string,x:double,y:double,width:int,height:int>>"
)
DETECTIONS = (
    "image_id string, bbox_ltwh array<double>, bbox_conf double, track_id double, bbox_pitch struct<x_bottom_middle:double,y_bottom_middle:double>, role string, role_confidence double, team string, "
    "jersey_number string, jersey_number_confidence double, video_id string"
)
FRAMES = "id string, name string, frame long, nframes long, video_id string, file_path string"


class BadInputError(ValueError):
    """A file breaks its format."""


def _refuse(bad: DataFrame, what: str) -> None:
    row = bad.take(1)
    if row:
        raise BadInputError(f"{what}: {row[0].asDict()}")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """Detector candidates, one row per frame; blank lines are skipped and missing lists are empty."""
    rows = spark.read.schema(PROBE).json(path).filter(F.col("index").isNotNull())
    return rows.withColumn("balls", F.coalesce("balls", F.array().cast("array<array<double>>")))


def read_probe_dumps(spark: SparkSession, pattern: str) -> DataFrame:
    """All dumps named ball_probe_<imgsz>.jsonl that match the glob, with imgsz from the name; empty files have no rows."""
    size = F.regexp_extract(F.input_file_name(), r"ball_probe_(\d+)\.jsonl", 1)
    return read_probe(spark, pattern).withColumn("imgsz", size.cast("int"))


def candidates(probe: DataFrame, floor: float = 0.0) -> DataFrame:
    """One row per box: pos, box and conf, with the image point at its bottom centre and its centre."""
    rows = probe.select("index", "frame", "imgsz", F.posexplode("balls").alias("pos", "b"))
    left, top, right, bottom, conf = (F.get("b", F.lit(k)) for k in range(5))
    return rows.select("index", "frame", "imgsz", "pos", conf.alias("conf"), ((left + right) / 2).alias("u"), bottom.alias("v"), ((left + right) / 2).alias("x"), ((top + bottom) / 2).alias("y")).filter(F.col("conf") >= floor)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration dumps with idx: the frame's number, or where no frame is a number the exported line number. A
    distributed read has no file order, so files with neither are refused."""
    named = spark.read.schema(HOMOGRAPHY).json(path).withColumn("idx", F.coalesce(F.expr("try_cast(frame AS BIGINT)"), F.col("line_no")))
    _refuse(named.filter("idx IS NULL").select("frame"), "a frame without a number or line number")
    return named


def read_homographies(spark: SparkSession, path: str) -> DataFrame:
    """(idx, h) of calibration dumps."""
    return read_calibration(spark, path).select("idx", F.col("h_image_to_pitch").alias("h"))


def correspondences(calibration: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(idx, landmark, wx, wy, u, v): the key points of each frame with their places on the pitch. landmarks:
    landmark, wx, wy; points that it doesn't name, and ones without two coordinates, are left out."""
    each = calibration.select("idx", F.explode("keypoints_px").alias("landmark", "p")).filter(F.size("p") >= 2)
    return each.join(landmarks, "landmark").select("idx", "landmark", "wx", "wy", F.get("p", F.lit(0)).alias("u"), F.get("p", F.lit(1)).alias("v"))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SIGNATURE).json(path)
    _refuse(rows.filter(F.coalesce(F.size("histogram"), F.lit(0)) <= 0).select("clip_id", "index"), "an empty histogram")
    return rows


def read_labels(spark: SparkSession, path: str, schema_name: str = "ball-gt/v1") -> tuple[DataFrame, DataFrame]:
    """(headers, labels) of ground-truth documents; each rule is a filter whose first row is reported."""
    docs = spark.read.schema(LABELS).option("multiLine", True).json(path)
    _refuse(docs.filter(F.coalesce("schema", F.lit("")) != schema_name).select("clip_id", "schema"), "an unknown schema")
    _refuse(docs.filter("resolution.width IS NULL OR resolution.height IS NULL").select("clip_id"), "no resolution")
    rows = docs.select("clip_id", "resolution", F.explode("labels").alias("l")).select("clip_id", "resolution", "l.*")
    _refuse(rows.filter("status IS NULL OR status NOT IN ('visible', 'absent')").select("clip_id", "index", "status"), "a bad status")
    _refuse(rows.filter("status = 'visible' AND (x IS NULL OR y IS NULL)").select("clip_id", "index"), "a visible label without a point")
    _refuse(rows.filter("width != resolution.width OR height != resolution.height").select("clip_id", "index"), "mixed resolutions")
    _refuse(rows.groupBy("clip_id", "index").count().filter("count > 1"), "a frame with two labels")
    return docs.drop("labels"), rows.select("clip_id", "index", "frame", (F.col("status") == "visible").alias("visible"), "x", "y")


def read_tracking(spark: SparkSession, detections: str, frames: str, sides: DataFrame, fps: float = 25.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, player_obs, ball_obs) from exported tracker states. sides: match_id, team (left or right), side
    (home or away), a few rows. Referees stay, without a side."""
    f = spark.read.schema(FRAMES).json(frames).select(
        F.col("id").alias("image_id"), F.col("video_id").alias("match_id"), F.col("frame").alias("frame_index"), (F.col("frame") / fps).alias("timestamp_s"), F.lit(1).alias("period")
    )
    d = spark.read.schema(DETECTIONS).json(detections).join(f, "image_id").join(F.broadcast(sides.withColumnRenamed("side", "team_side")), ["match_id", "team"], "left")
    at = [F.col("bbox_pitch.x_bottom_middle").alias("x"), F.col("bbox_pitch.y_bottom_middle").alias("y")]
    role = F.when(F.col("role") == "player", "outfield").otherwise(F.col("role"))
    keys = ["match_id", "frame_index", "timestamp_s", "period"]
    players = d.filter((F.col("role") != "ball") & F.col("track_id").isNotNull() & F.col("bbox_pitch").isNotNull()).select(
        *keys, F.col("track_id").cast("long").alias("track_id"), F.col("team_side").alias("team"), role.alias("role"), *at, F.expr("try_cast(jersey_number AS INT)").alias("jersey_number"), F.col("bbox_conf").alias("confidence")
    )
    ball = d.filter((F.col("role") == "ball") & F.col("bbox_pitch").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*at, F.col("bbox_conf").alias("confidence")), "bbox_conf").alias("b")).select(*keys, "b.*")
    return f.drop("image_id"), players, ball


def attack_directions(player_obs: DataFrame) -> DataFrame:
    """(match_id, period, team, dir): away from the own goalkeeper's median position."""
    keepers = player_obs.filter("role = 'goalkeeper' AND team IS NOT NULL").groupBy("match_id", "period", "team").agg(F.median("x").alias("gx"))
    return keepers.select("match_id", "period", "team", F.when(F.col("gx") < 0, 1).otherwise(-1).alias("dir"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_SCHEMA).json(path)


def _rounded(df: DataFrame) -> list:
    """Doubles to 2 places, confidences to 3."""
    return [F.round(f.name, 3 if "confidence" in f.name else 2).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema]


def _documents(rows: DataFrame, keys: list[str], schema_name: str, name: str, order: tuple[str, str]) -> DataFrame:
    body = F.struct(*(c for c, f in zip(_rounded(rows), rows.schema, strict=True) if f.name not in keys))

    def before(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for c in reversed(order):
            out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
        return out

    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(body), before).alias(name))
    return held.select(*keys, F.to_json(F.struct(F.lit(schema_name).alias("schema"), *(F.col(k) for k in keys), F.col(name))).alias("json"))


def event_documents(events: DataFrame, schema_name: str = "match-events/v1") -> DataFrame:
    """(match_id, json): one document per match, events by start and end, with their tags."""
    return _documents(events, ["match_id"], schema_name, "events", ("start_s", "end_s"))


def profile_documents(profile: DataFrame, schema_name: str = "pattern-profile/v1") -> DataFrame:
    """(match_id, json): one document per match, its aggregates by pattern and team."""
    return _documents(profile, ["match_id"], schema_name, "aggregates", ("pattern_id", "team"))


def write_documents(docs: DataFrame, path: str, key: str = "match_id") -> None:
    docs.select(key, F.col("json").alias("value")).write.partitionBy(key).mode("overwrite").text(path)
