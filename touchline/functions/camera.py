"""Camera poses, homographies and the pitch's edges as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.scalar import PITCH_LENGTH_M, PITCH_WIDTH_M, bounded, clamp01


def band_ramp(v: Column, good: tuple[float, float], bad: tuple[float, float]) -> Column:
    """1 inside the good band, 0 outside the bad one, linear between their edges; null stays null."""
    rise, fall = clamp01((v - bad[0]) / (good[0] - bad[0])), clamp01((v - bad[1]) / (good[1] - bad[1]))
    return F.when(v.isNotNull(), F.least(rise, fall))


def entries(h: Column) -> list[list[Column]]:
    """The nine entries of a homography (array of arrays)."""
    return [[F.get(F.get(h, F.lit(i)), F.lit(j)) for j in range(3)] for i in range(3)]


def matrix(rows: list[list[Column]]) -> Column:
    return F.array(*(F.array(*r) for r in rows))


def compose_homography(pan: Column, tilt: Column, roll: Column, focal: Column, x: Column, y: Column, z: Column, pu: Column, pv: Column) -> Column:
    """Ground plane to image for a camera at (x, y, z), angles in degrees: pan about the vertical, then tilt and roll.
    Scaled so that the last entry is 1, or to unit norm where that entry vanishes."""
    sp, cp, st, ct, sg, cg = (f(F.radians(a)) for a in (pan, tilt, roll) for f in (F.sin, F.cos))
    right = [cg * cp + sg * st * sp, sg * st * cp - cg * sp, sg * ct]
    down = [sg * cp - cg * st * sp, -sg * sp - cg * st * cp, -cg * ct]
    ahead = [ct * sp, ct * cp, -st]
    rows = [[r[0], r[1], -(r[0] * x + r[1] * y + r[2] * z)] for r in (right, down, ahead)]
    h = [[focal * a + pu * c for a, c in zip(rows[0], rows[2], strict=True)], [focal * b + pv * c for b, c in zip(rows[1], rows[2], strict=True)], rows[2]]
    norm = F.sqrt(sum((e * e for r in h[1:] for e in r), sum((e * e for e in h[0][1:]), h[0][0] * h[0][0])))
    unit = F.when(F.abs(h[2][2]) > 1e-9 * norm, h[2][2]).when(norm > 0, norm).otherwise(1.0)
    return matrix([[e / unit for e in r] for r in h])


def inverse(h: Column) -> Column:
    """The inverse by cofactors; null if the determinant is 0."""
    m = entries(h)

    def minor(i: int, j: int) -> Column:
        (a, b), (c, d) = ([m[r][k] for k in range(3) if k != j] for r in range(3) if r != i)
        return a * d - b * c

    det = m[0][0] * minor(0, 0) - m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    safe = F.when(F.abs(det) > 1e-300, det)
    return F.when(safe.isNotNull(), matrix([[minor(j, i) * (-1) ** (i + j) / safe for j in range(3)] for i in range(3)]))


def through(h: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """A point through a homography; null near the horizon."""
    a, b, w = (r[0] * u + r[1] * v + r[2] for r in entries(h))
    far = F.abs(w) < 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    safe = F.when(~far & (F.abs(w) >= 1e-12), w)
    return a / safe, b / safe


def unproject(h: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """The ground point of a pixel, from the homography of ground to image."""
    return through(inverse(h), u, v)


def crossing(x0: Column, y0: Column, x1: Column, y1: Column, slack: float = 1.0) -> Column:
    """Where a step leaves the pitch: struct of axis, sign, x and y; null if it doesn't. Touchlines are tried before
    goal lines, and the place must lie on the edge itself, give or take slack metres. Steps of decimals are taken exactly."""
    half = {"y": PITCH_WIDTH_M / 2, "x": PITCH_LENGTH_M / 2}
    found = []
    for axis, (a, b), (c, d), other in (("y", (y0, y1), (x0, x1), half["x"]), ("x", (x0, x1), (y0, y1), half["y"])):
        for sign in (1, -1):
            part = (F.lit(Decimal(half[axis])) - a * sign).cast("double") / (b * sign - a * sign).cast("double")
            across = c + part * (d - c).cast("double")
            at = F.lit(float(sign * half[axis]))
            place = (across, at) if axis == "y" else (at, across)
            hit = (a * sign <= half[axis]) & (b * sign > half[axis]) & (F.abs(across) <= other + slack)
            found.append(F.when(hit, F.struct(F.lit(axis).alias("axis"), F.lit(sign).alias("sign"), place[0].alias("x"), place[1].alias("y"))))
    return F.coalesce(*found)


def visible(h: Column, x: Column, y: Column, width: float, height: float, margin: float = 0.0) -> Column:
    """Whether a ground point projects into the frame."""
    u, v = through(h, x, y)
    return F.coalesce(u.between(-margin, width + margin) & v.between(-margin, height + margin), F.lit(False))


def clipped(x: Column, y: Column) -> tuple[Column, Column]:
    """The nearest point of the pitch."""
    return bounded(x, -PITCH_LENGTH_M / 2, PITCH_LENGTH_M / 2), bounded(y, -PITCH_WIDTH_M / 2, PITCH_WIDTH_M / 2)
