"""Scores, weights and plane geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
PITCH_LENGTH_M, PITCH_WIDTH_M = 105.0, 68.0
MISSING_FACTOR = 0.6
LANE_EDGES_M = (6.8, 20.4)


def bounded(v: Column, low: float, high: float) -> Column:
    """v within [low, high]; null stays null, which greatest and least alone would pass over."""
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def distance(dx: Column, dy: Column) -> Column:
    """The length of a step, in the operations that SQL has for it: hypot may differ in the last place, which settles ties."""
    return F.sqrt(dx * dx + dy * dy)


def rounded(v: Column, n: int) -> Column:
    """v to n decimals as SQL engines round a double: halves of the scaled value away from zero. Spark's own round takes the
    halves of the shortest decimal instead."""
    return F.round(v * 10.0**n) / 10.0**n


def clamp01(v: Column) -> Column:
    return bounded(v, 0.0, 1.0)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-bounded(z, -60.0, 60.0)))


def logit(p: Column) -> Column:
    p = bounded(p, 1e-6, 1 - 1e-6)
    return F.log(p / (1 - p))


def soft_threshold(v: Column, threshold: float | Column, softness: float, above: bool = True) -> Column:
    """Logistic score: 0.5 at the threshold, 0.73 one softness beyond it; missing values score 0.6."""
    if softness <= 0:
        raise ValueError("softness must be positive")
    z = (v - threshold) / softness
    return F.coalesce(sigmoid(z if above else -z), F.lit(MISSING_FACTOR))


def ramp(v: Column, good: float, bad: float) -> Column:
    """1 at good and beyond, 0 at bad and beyond, linear between them; in either direction."""
    if good == bad:
        raise ValueError("good and bad must differ")
    return clamp01((v - bad) / (good - bad))


def combine_evidence(factors: list[Column], quality: Column) -> Column:
    """Geometric mean of clamped factors, times the clamped quality."""
    product = clamp01(factors[0])
    for f in factors[1:]:
        product = product * clamp01(f)
    return F.pow(product, F.lit(1.0 / len(factors))) * clamp01(quality)


def episode_confidence(mean_score: Column, mean_quality: Column, completeness: Column, components: int) -> Column:
    """From a span's means; no score at all gives 0."""
    margin = F.pow(mean_score, F.lit(1.0 / max(1, components)))
    return F.coalesce(clamp01(margin * F.coalesce(mean_quality, F.lit(0.0)) * (0.4 + 0.6 * F.coalesce(completeness, F.lit(0.0)))), F.lit(0.0))


def lane(y_rel: Column) -> Column:
    """One of five lanes across the pitch, seen in the direction of attack."""
    inner, outer = LANE_EDGES_M
    return (
        F.when(y_rel > outer, "wide_left")
        .when(y_rel > inner, "halfspace_left")
        .when(y_rel >= -inner, "centre")
        .when(y_rel >= -outer, "halfspace_right")
        .when(y_rel.isNotNull(), "wide_right")
    )


def team_relative(x: Column, y: Column, direction: Column) -> tuple[Column, Column]:
    """x from the own goal line, y to the left, in the team's direction of attack (1 or -1)."""
    return direction * x + PITCH_LENGTH_M / 2, direction * y


def rate_per_90(n: Column, observed_s: Column) -> Column:
    return F.when(observed_s > 0, n * 5400.0 / observed_s).otherwise(0.0)


def recency_weight(age_days: Column, half_life_days: float) -> Column:
    if half_life_days <= 0:
        raise ValueError("half_life_days must be positive")
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days.cast("double")) / half_life_days)


def volume_weight(minutes: Column, reference: float) -> Column:
    if reference <= 0:
        raise ValueError("reference must be positive")
    return clamp01(minutes / reference)


def wilson_bounds(p: Column, n_eff: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval; (0, 1) without evidence."""
    p = clamp01(p)
    n = F.when(n_eff > 0, n_eff)
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    half = z / denominator * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.coalesce(clamp01(centre - half), F.lit(0.0)), F.coalesce(clamp01(centre + half), F.lit(1.0))


def out_of_bounds_m(x: Column, y: Column) -> Column:
    """How far a point is outside the pitch; 0 inside."""
    dx = F.greatest(F.abs(x) - PITCH_LENGTH_M / 2, F.lit(0.0))
    dy = F.greatest(F.abs(y) - PITCH_WIDTH_M / 2, F.lit(0.0))
    return F.when(x.isNotNull() & y.isNotNull(), F.hypot(dx, dy))


def boundary_distance_m(x: Column, y: Column) -> Column:
    """Distance to the nearest pitch line."""
    return F.when(x.isNotNull() & y.isNotNull(), F.least(F.abs(F.abs(x) - PITCH_LENGTH_M / 2), F.abs(F.abs(y) - PITCH_WIDTH_M / 2)))


def third(v: Column, extent: float) -> Column:
    """0, 1 or 2 along an axis that is centred on 0; points outside count for the outer thirds."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(2), F.floor((v + extent / 2) / (extent / 3)).cast("int"))))


def histogram_distance(a: Column, b: Column) -> Column:
    """Half the L1 distance; histograms of different lengths are an error."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, d: s + d) / 2
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), F.raise_error(F.lit("histograms differ in length"))).otherwise(gap)


def angle_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two vectors, null if one has no length."""
    scale = F.hypot(ax, ay) * F.hypot(bx, by)
    cos = (ax * bx + ay * by) / F.when(scale > 0, scale)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def hull_area(points: Column) -> Column:
    """Area of the convex hull of array<struct<x, y>>, for the few points of one team.

    A pair of points is an edge of the hull if no other point lies to its right; the shoelace terms of the
    edges add up to the area. Of collinear points only the outermost pair counts.
    """
    p = F.array_distinct(points)

    def cross(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def between(a: Column, b: Column, c: Column) -> Column:
        dot = (c["x"] - a["x"]) * (b["x"] - a["x"]) + (c["y"] - a["y"]) * (b["y"] - a["y"])
        square = (b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])
        return (dot >= 0) & (dot <= square)

    def edge(a: Column, b: Column) -> Column:
        return (a != b) & F.forall(p, lambda c: (cross(a, b, c) > 0) | ((cross(a, b, c) == 0) & between(a, b, c)))

    def terms(a: Column) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda s, b: s + F.when(edge(a, b), a["x"] * b["y"] - b["x"] * a["y"]).otherwise(0.0))

    return F.when(F.size(p) >= 3, F.aggregate(p, F.lit(0.0), lambda s, a: s + terms(a)) / 2).otherwise(0.0)


def project(h: Column, u: Column, v: Column, eps: float = 1e-9) -> tuple[Column, Column]:
    """A pixel through a 3x3 homography (array of arrays); null near the horizon and without a homography."""
    def row(i: int) -> Column:
        r = F.get(h, F.lit(i))
        return F.get(r, F.lit(0)) * u + F.get(r, F.lit(1)) * v + F.get(r, F.lit(2))

    w = row(2)
    safe = F.when(F.abs(w) >= eps, w)
    return row(0) / safe, row(1) / safe


def rescale_homography(h: Column, sx: Column, sy: Column) -> Column:
    """The image-to-pitch homography for an image that is resized by (sx, sy): columns are divided by the scales,
    and the result is normalised by its last element."""
    rows = F.transform(h, lambda r: F.array(F.get(r, F.lit(0)) / sx, F.get(r, F.lit(1)) / sy, F.get(r, F.lit(2))))
    last = F.get(F.get(rows, F.lit(2)), F.lit(2))
    return F.transform(rows, lambda r: F.transform(r, lambda x: x / F.when(F.abs(last) > 1e-12, last).otherwise(1.0)))


def degrees_to_radians(v: Column) -> Column:
    return v * (math.pi / 180)
