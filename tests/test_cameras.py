"""Batched homography fits and cameras taken from homographies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import camera
from touchline.operators import calibration

DDL = "frame long, u double, v double, wx double, wy double, h string"
PLACES = [(-40.0, -20.0), (30.0, -25.0), (35.0, 22.0), (-20.0, 28.0), (0.0, 0.0), (11.0, 3.0)]


def image(wx, wy, scale=1.0):
    w = 1 + 0.003 * wx + 0.004 * wy
    return scale * (600 + 9 * wx + 2 * wy) / w, scale * (400 - 2 * wx + 7 * wy) / w


def rows(frame, places, scale=1.0):
    return [(frame, *image(*p, scale), *p, "x") for p in places]


def test_fits(spark):
    line = [(float(k), 2.0 * k) for k in range(6)]
    data = rows(1, PLACES) + rows(2, PLACES, 1000.0) + rows(3, PLACES[:4]) + rows(4, PLACES[:3]) + rows(5, line) + rows(6, [(1.0, 1.0)] * 5) + rows(7, [*line[:4], (9.0, -9.0)]) + [(1, None, 1.0, 1.0, 1.0, "x"), (8, None, None, None, None, "x")]
    got = {r["frame"]: r for r in calibration.fit_homographies(spark.createDataFrame(data, DDL).repartition(3), ["frame"]).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and got[1]["n"] == 6
    assert {k: r["h"] is not None for k, r in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}
    assert got[1]["rms"] < 1e-6 and got[3]["rms"] < 1e-6 and got[5]["rms"] is None and got[6]["gap"] is None
    assert got[1]["gap"] == pytest.approx(got[2]["gap"], rel=1e-6)  # the same at another scale
    assert got[5]["gap"] < 1e-8 < got[1]["gap"]
    h = np.array(got[1]["h"])
    for x, y in PLACES:
        w = h @ [*image(x, y), 1]
        assert w[:2] / w[2] == pytest.approx((x, y), abs=1e-6)
    assert calibration.fit_homographies(spark.createDataFrame([], DDL), ["frame"]).count() == 0


POSES = [(0.0, 12.0, 0.0, 1500.0, 0.0, -60.0, 15.0), (-35.0, 25.0, 4.0, 900.0, 20.0, -50.0, 22.0), (40.0, 5.0, -3.0, 4000.0, -30.0, -80.0, 8.0), (10.0, 80.0, 1.0, 700.0, 1.0, -3.0, 60.0)]
NAMES = ("pan", "tilt", "roll", "focal", "x", "y", "z")


def test_cameras_come_back(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(POSES)], "id int, pan double, tilt double, roll double, focal double, x double, y double, z double")
    h = df.select("id", F.lit("kept").alias("TILT"), camera.compose_homography(*(F.col(c) for c in NAMES), F.lit(960.0), F.lit(540.0)).alias("my.h"))
    # A homography means the same at any scale, of either sign.
    for scale in (1.0, -3.0, 1e-6):
        turned = h.withColumn("my.h", F.transform("`my.h`", lambda r: F.transform(r, lambda v: v * scale)))
        got = calibration.decompose_homographies(turned, "my.h", 960.0, 540.0)
        assert got.columns == ["id", "my.h", *NAMES]
        for r in got.collect():
            assert [r[c] for c in NAMES] == pytest.approx(list(POSES[r["id"]]), abs=1e-6, rel=1e-7)


def test_homographies_of_no_camera(spark):
    odd = [
        None, [], [[1.0, 0.0], [0.0, 1.0]], [[0.0] * 3] * 3, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[1.0, None, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]],
        [[float("nan")] * 3] * 3, [[float("inf"), 0.0, 0.0]] * 3, [[1.0, 2.0, 3.0]] * 3,
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(odd)], "id int, h array<array<double>>")
    got = calibration.decompose_homographies(df, "h", 960.0, 540.0).collect()
    assert len(got) == len(odd) and all(r[c] is None for r in got for c in NAMES)
    near = spark.createDataFrame([(i, *p) for i, p in enumerate(POSES)], "id int, pan double, tilt double, roll double, focal double, x double, y double, z double")
    h = near.select("id", camera.compose_homography(*(F.col(c) for c in NAMES), F.lit(960.0), F.lit(540.0)).alias("h"))
    narrow = calibration.decompose_homographies(h, "h", 960.0, 540.0, (1000.0, 2000.0)).collect()
    assert {r["id"]: r["focal"] is None for r in narrow} == {0: False, 1: True, 2: True, 3: True}
    assert calibration.decompose_homographies(h.limit(0), "h", 960.0, 540.0).count() == 0
