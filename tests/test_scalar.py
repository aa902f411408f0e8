"""Known values of the expressions."""

import pytest
from pyspark.sql import functions as F

from touchline.functions import scalar as S


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_soft_threshold(spark):
    assert one(spark, S.soft_threshold(F.lit(5.0), 5.0, 2.0)) == pytest.approx(0.5)
    assert one(spark, S.soft_threshold(F.lit(7.0), 5.0, 2.0)) == pytest.approx(0.7310585786)
    assert one(spark, S.soft_threshold(F.lit(7.0), 5.0, 2.0, above=False)) == pytest.approx(1 - 0.7310585786)
    assert one(spark, S.soft_threshold(F.lit(None).cast("double"), 5.0, 2.0)) == pytest.approx(0.6)
    with pytest.raises(ValueError):
        S.soft_threshold(F.lit(1.0), 0.0, 0.0)


def test_weights_and_intervals(spark):
    assert one(spark, S.recency_weight(F.lit(240), 60.0)) == pytest.approx(0.0625)
    low, high = S.wilson_bounds(F.lit(0.5), F.lit(10.0))
    assert (one(spark, low), one(spark, high)) == pytest.approx((0.2366, 0.7634), abs=1e-4)
    low, high = S.wilson_bounds(F.lit(0.5), F.lit(0.0))
    assert (one(spark, low), one(spark, high)) == (0.0, 1.0)


def test_episode_confidence(spark):
    got = one(spark, S.episode_confidence(F.lit(0.9**5), F.lit(1.0), F.lit(1.0), 5))
    assert got == pytest.approx(0.9)
    assert one(spark, S.episode_confidence(F.lit(0.9**5), F.lit(1.0), F.lit(0.0), 5)) == pytest.approx(0.36)
    assert one(spark, S.episode_confidence(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), 5)) == 0.0


def test_hull_area(spark):
    def pts(*xy):
        return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy))

    assert one(spark, S.hull_area(pts((0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (2, 0)))) == pytest.approx(12.0)
    assert one(spark, S.hull_area(pts((0, 0), (1, 1), (2, 2)))) == pytest.approx(0.0)


def test_lanes(spark):
    got = [r["v"] for r in spark.createDataFrame([(30.0,), (10.0,), (6.8,), (-6.9,), (-21.0,), (None,)], "y double").select(S.lane(F.col("y")).alias("v")).collect()]
    assert got == ["wide_left", "halfspace_left", "centre", "halfspace_right", "wide_right", None]


def test_histograms_must_match(spark):
    assert one(spark, S.histogram_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == 1.0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, S.histogram_distance(F.array(F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.5))))
