"""Crossings whose places are ties of rounding."""

from decimal import Decimal

from pyspark.sql import functions as F

from touchline.functions import camera, scalar


def test_a_crossing_between_decimals_is_exact(spark):
    row = spark.createDataFrame([(17.04, 36, 1.04, 19)], "v0 double, n0 int, v1 double, n1 int")
    x0, x1 = ((F.col(v) - 50) * 1.2 for v in ("v0", "v1"))
    y0, y1 = (F.col(n).cast("decimal(9,1)") * F.lit(Decimal("0.9")) for n in ("n0", "n1"))
    c = row.select(camera.crossing(x0, y0, x1, y1).alias("c")).select("c.axis", "c.sign", "c.x", scalar.rounded(F.col("c.y"), 6).alias("y")).first()
    assert tuple(c) == ("x", -1, -52.5, 22.082062)
