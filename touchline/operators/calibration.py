"""Camera calibration: reprojection, support and stability scores, and homography fits as grouped jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.scalar import project
from touchline.operators.timeseries import islands
from touchline.sources.shared import written


def reprojection(correspondences: DataFrame, homographies: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame the RMS and largest distance in metres between landmarks (wx, wy) and their projected pixels (u, v)."""
    x, y = project(F.col("h"), F.col("u"), F.col("v"))
    err = F.hypot(x - F.col("wx"), y - F.col("wy"))
    rows = correspondences.join(homographies, keys).withColumn("err", err)
    return rows.groupBy(*keys).agg(F.count("err").alias("n"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms"), F.max("err").alias("worst"))


def support(correspondences: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame the spread of landmarks along both principal axes (closed-form eigenvalues of the 2 x 2
    covariance) and their collinearity: 1 on a line, 0 for equal spreads."""
    m = correspondences.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("wx").alias("a"), F.var_pop("wy").alias("d"), F.covar_pop("wx", "wy").alias("b"))
    half, root = (F.col("a") + F.col("d")) / 2, F.hypot((F.col("a") - F.col("d")) / 2, F.col("b"))
    rows = m.select(*keys, "n", F.sqrt(half + root).alias("major"), F.sqrt(F.greatest(F.lit(0.0), half - root)).alias("minor"))
    return rows.withColumn("collinearity", F.when(F.col("major") > 0, 1 - F.col("minor") / F.col("major")).otherwise(1.0))


def landmark_motion(correspondences: DataFrame, clip: list[str], frame: str = "frame") -> DataFrame:
    """Per frame the upper median of the pixel motion of landmarks shared with the frame before."""
    w = W.partitionBy(*clip, "landmark").orderBy(frame)
    moved = F.when(F.lag(frame).over(w) == F.col(frame) - 1, F.hypot(F.col("u") - F.lag("u").over(w), F.col("v") - F.lag("v").over(w)))
    rows = correspondences.withColumn("moved", moved).filter("moved IS NOT NULL").groupBy(*clip, frame).agg(F.array_sort(F.collect_list("moved")).alias("m"))
    return rows.select(*clip, frame, F.get("m", F.floor(F.size("m") / 2).cast("int")).alias("motion_px"))


def static_spans(motion: DataFrame, clip: list[str], frame: str = "frame", still_px: float = 1.5, least: int = 5) -> DataFrame:
    """Runs of at least `least` frames with little motion; a run starts with the frame before its first."""
    runs = islands(motion, clip, frame, F.col("motion_px") <= still_px, "run")
    out = runs.groupBy(*clip, "run").agg((F.min(frame) - 1).alias("start"), F.max(frame).alias("end"))
    return out.filter(F.col("end") - F.col("start") + 1 >= least).drop("run")


def world_jitter(homographies: DataFrame, clip: list[str], width: float, height: float, frame: str = "frame") -> DataFrame:
    """Per frame the upper median displacement in metres of a 3 x 3 pixel grid against the frame before."""
    w = W.partitionBy(*clip).orderBy(frame)
    pairs = homographies.withColumn("p", F.when(F.lag(frame).over(w) == F.col(frame) - 1, F.lag("h").over(w))).filter("p IS NOT NULL")
    cells = F.array(*(F.struct(F.lit(width * a).alias("u"), F.lit(height * b).alias("v")) for a in (0.25, 0.5, 0.75) for b in (0.25, 0.5, 0.75)))
    pts = pairs.withColumn("c", F.explode(cells))
    (x0, y0), (x1, y1) = project(F.col("p"), F.col("c.u"), F.col("c.v")), project(F.col("h"), F.col("c.u"), F.col("c.v"))
    rows = pts.withColumn("d", F.hypot(x1 - x0, y1 - y0)).groupBy(*clip, frame).agg(F.array_sort(F.collect_list("d")).alias("d"))
    return rows.select(*clip, frame, F.get("d", F.floor(F.size("d") / 2).cast("int")).alias("jitter_m"))


def teleports(tracks: DataFrame, keys: list[str], t: str = "timestamp_s", limit: float = 12.0) -> DataFrame:
    """Per key how often consecutive positions imply more than `limit` m/s."""
    w = W.partitionBy(*keys).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    pace = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) / F.when(dt > 0, dt)
    return tracks.filter("x IS NOT NULL AND y IS NOT NULL").withColumn("pace", pace).groupBy(*keys).agg(F.count_if(F.col("pace") > limit).alias("n_teleports"))


#: Unique products of (x, y, 1) with itself, and what they are weighted by in the normal matrix.
_PRODUCTS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
_WEIGHTS = ("one", "qx", "qy", "qq")


def fit_homographies(correspondences: DataFrame, keys: list[str], min_points: int = 4, min_gap: float = 1e-8) -> DataFrame:
    """Per frame the pixel-to-pitch homography by the normalised direct linear transform: n, h, rms in metres, gap.

    gap is the second smallest eigenvalue of the normal matrix by the largest, so it means the same at any scale; h and
    rms are null for fewer than min_points or a gap of min_gap and less (points that leave several solutions), gap also
    for points that are all one. Points with a null coordinate don't count, other columns are ignored, empty tables
    give no rows. The normal matrix is summed up in one shuffle, and a batch of matrices is solved at once.
    """
    points = correspondences.select(*keys, *(F.col(c).cast("double").alias(c) for c in ("u", "v", "wx", "wy"))).dropna(subset=["u", "v", "wx", "wy"])
    w = W.partitionBy(*keys)
    # Both point sets are moved to their means and scaled to a mean distance of the root of 2.
    rows = points.withColumns({f"m_{c}": F.avg(c).over(w) for c in ("u", "v", "wx", "wy")})
    reach = lambda a, b: F.avg(F.hypot(F.col(a) - F.col(f"m_{a}"), F.col(b) - F.col(f"m_{b}"))).over(w)
    rows = rows.withColumns({"d_p": reach("u", "v"), "d_q": reach("wx", "wy")})
    scale = lambda d: 2.0**0.5 / F.greatest(F.col(d), F.lit(1e-12))
    rows = rows.withColumns({
        "x": (F.col("u") - F.col("m_u")) * scale("d_p"), "y": (F.col("v") - F.col("m_v")) * scale("d_p"), "qx": (F.col("wx") - F.col("m_wx")) * scale("d_q"), "qy": (F.col("wy") - F.col("m_wy")) * scale("d_q"),
    }).withColumns({"one": F.lit(1.0), "qq": F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy")})
    axes = [F.col("x"), F.col("y"), F.lit(1.0)]
    sums = [F.sum(F.col(t) * axes[i] * axes[j]) for t in _WEIGHTS for i, j in _PRODUCTS]
    known = [F.first(c).alias(c) for c in ("m_u", "m_v", "d_p", "m_wx", "m_wy", "d_q")]
    frames = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"), *known)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m_u", "m_v", "d_p", "m_wx", "m_wy", "d_q")}
            sums = b.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_WEIGHTS), len(_PRODUCTS))
            parts = np.empty((len(sums), len(_WEIGHTS), 3, 3))
            for k, (i, j) in enumerate(_PRODUCTS):
                parts[:, :, i, j] = parts[:, :, j, i] = sums[:, :, k]
            normal = np.zeros((len(sums), 9, 9))
            normal[:, :3, :3] = normal[:, 3:6, 3:6] = parts[:, 0]
            normal[:, :3, 6:] = normal[:, 6:, :3] = -parts[:, 1]
            normal[:, 3:6, 6:] = normal[:, 6:, 3:6] = -parts[:, 2]
            normal[:, 6:, 6:] = parts[:, 3]
            values, vectors = np.linalg.eigh(normal)
            gap = np.maximum(0, values[:, 1]) / np.maximum(np.abs(values[:, -1]), 1e-300)
            spread = (at["d_p"] > 1e-9) & (at["d_q"] > 1e-9)
            to_p, from_q = np.zeros((2, len(sums), 3, 3))
            grow = 2**0.5 / np.maximum(at["d_p"], 1e-12)
            to_p[:, 0, 0] = to_p[:, 1, 1] = grow
            to_p[:, 0, 2], to_p[:, 1, 2], to_p[:, 2, 2] = -grow * at["m_u"], -grow * at["m_v"], 1
            back = np.maximum(at["d_q"], 1e-12) / 2**0.5
            from_q[:, 0, 0] = from_q[:, 1, 1] = back
            from_q[:, 0, 2], from_q[:, 1, 2], from_q[:, 2, 2] = at["m_wx"], at["m_wy"], 1
            h = from_q @ vectors[:, :, 0].reshape(-1, 3, 3) @ to_p
            norm = np.linalg.norm(h, axis=(1, 2))
            good = (at["n"] >= min_points) & spread & (gap > min_gap)
            last = h[:, 2, 2]
            h = h / np.where(np.abs(last) > 1e-9 * norm, last, np.where(norm > 0, norm, 1))[:, None, None]
            made = [m.tolist() if ok else None for m, ok in zip(h, good, strict=True)]
            columns = [*(b.column(k) for k in keys), b.column("n"), pa.array(made, pa.list_(pa.list_(pa.float64()))), pa.array([g if ok else None for g, ok in zip(gap.tolist(), spread, strict=True)], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "h", "gap"])

    fields = [frames.schema[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("h", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("gap", T.DoubleType())]
    fits = written(frames.mapInArrow(solve, T.StructType(fields)), "homographies")
    rms = reprojection(points, fits.filter("h IS NOT NULL").select(*keys, "h"), keys).select(*keys, "rms")
    return fits.join(rms, keys, "left").select(*keys, "n", "h", "rms", "gap")


def decompose_homographies(df: DataFrame, h: str, pu: float, pv: float, focal: tuple[float, float] = (50.0, 100_000.0)) -> DataFrame:
    """df with the camera of its ground-to-image homographies: pan, tilt and roll in degrees, focal in pixels, and the
    place x, y, z, all null where no camera above the ground, of a focal length in that range, gives the homography (null
    ones and those that aren't 3 x 3 with finite entries among them). Columns of these names are replaced; repeated rows
    and the order of columns stay. A batch of homographies is taken apart at once.

    The focal length is where both axes of the ground stay at right angles and equally long, by least squares; the
    rotation is the one nearest to what is left of the scaled columns.
    """
    pose = ("pan", "tilt", "roll", "focal", "x", "y", "z")
    kept = [c for c in df.columns if c.lower() not in pose]
    src = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{h}`").cast("array<array<double>>").alias("h"))

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array(m, float) if m is not None and len(m) == 3 and all(r is not None and len(r) == 3 and None not in r for r in m) else np.full((3, 3), np.nan) for m in b.column("h").to_pylist()]
            found = cameras(np.array(rows).reshape(-1, 3, 3), pu, pv, focal)
            columns = [pa.array(c, pa.float64(), mask=np.isnan(c)) for c in found.T]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], *pose])

    made = src.mapInArrow(take_apart, T.StructType([*src.schema.fields[:-1], *(T.StructField(p, T.DoubleType()) for p in pose)]))
    return made.toDF(*kept, *pose)


def cameras(h: np.ndarray, pu: float, pv: float, focal: tuple[float, float]) -> np.ndarray:
    """For stacked homographies the rows (pan, tilt, roll, focal, x, y, z); NaN where there is no camera."""
    out = np.full((len(h), 7), np.nan)
    ok = np.isfinite(h).all(axis=(1, 2))
    ok[ok] &= np.abs(h[ok]).max(axis=(1, 2)) > 0
    at = np.flatnonzero(ok)
    if not len(at):
        return out
    g = h[at] / np.abs(h[at]).max(axis=(1, 2), keepdims=True)
    # With the image's centre at its principal point, columns a and b of the ground's axes are rays (f * right, f * down, ahead).
    shift = np.array([[1, 0, -pu], [0, 1, -pv], [0, 0, 1]])
    m = shift @ g
    a, b = m[:, :, 0], m[:, :, 1]
    flat = np.stack([(a[:, :2] * b[:, :2]).sum(1), (a[:, :2] ** 2).sum(1) - (b[:, :2] ** 2).sum(1)])
    deep = np.stack([a[:, 2] * b[:, 2], a[:, 2] ** 2 - b[:, 2] ** 2])
    weight = (flat**2).sum(0)
    with np.errstate(all="ignore"):
        f = 1 / np.sqrt(-(flat * deep).sum(0) / weight)
        fits = (weight > 1e-30) & (f >= focal[0]) & (f <= focal[1])
    at, m, f = at[fits], m[fits], f[fits]
    if not len(at):
        return out
    rays = m / np.stack([f, f, np.ones_like(f)], axis=1)[:, :, None]
    size = (np.linalg.norm(rays[:, :, 0], axis=1) + np.linalg.norm(rays[:, :, 1], axis=1)) / 2
    solid = size > 1e-12
    at, f, rays, size = at[solid], f[solid], rays[solid], size[solid]
    for sign in (1, -1):
        r = sign * rays / size[:, None, None]
        axes = np.stack([r[:, :, 0], r[:, :, 1], np.cross(r[:, :, 0], r[:, :, 1])], axis=2)
        left, _, right = np.linalg.svd(axes)
        turn = left @ (np.array([1, 1, 1])[:, None] * right)
        place = -(turn.swapaxes(1, 2) @ r[:, :, 2:])[:, :, 0]
        up = (place[:, 2] > 0) & (np.linalg.det(turn) > 0) & np.isnan(out[at, 0])
        pan, tilt, roll = np.degrees([np.arctan2(turn[:, 2, 0], turn[:, 2, 1]), np.arcsin(np.clip(-turn[:, 2, 2], -1, 1)), np.arctan2(turn[:, 0, 2], -turn[:, 1, 2])])
        out[at[up]] = np.column_stack([pan, tilt, roll, f, place])[up]
    return out
