"""Time-series operators against plain Python on small series."""

import random

from pyspark.sql import functions as F

from touchline.operators import patterns, shape, shots
from touchline.operators import timeseries as ts


def series(spark, values, key="a", step=1.0):
    return spark.createDataFrame([(key, i * step, v) for i, v in enumerate(values)], "k string, t double, v double")


def spans(scores, enter, leave, least, gap):
    raw, start = [], None
    for i, s in enumerate([*scores, None]):
        if start is None and s is not None and s >= enter:
            start = i
        elif start is not None and (s is None or s < leave):
            raw.append([start, i - 1])
            start = None
    out = []
    for a, b in raw:
        if out and a - out[-1][1] < gap:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least - 1e-9]


def test_episodes_on_random_series(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(40):
        scores = [None if rng.random() < 0.1 else rng.random() for _ in range(60)]
        rows += [(k, float(i), s) for i, s in enumerate(scores)]
        want[k] = spans(scores, 0.6, 0.3, 3, 2)
    df = spark.createDataFrame(rows, "k int, t double, s double")
    got: dict = {k: [] for k in want}
    for r in ts.hysteresis_episodes(df, ["k"], "t", "s", 0.6, 0.3, 3.0, 2.0).collect():
        got[r["k"]].append((int(r["start_t"]), int(r["end_t"])))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_moving_average_stops_at_nulls(spark):
    got = ts.moving_average(series(spark, [1.0, 2.0, 3.0, None, 10.0, 20.0]), ["k"], "t", "v", 3, "m").orderBy("t").collect()
    assert [r["m"] for r in got] == [1.5, 2.0, 2.5, None, 15.0, 15.0]


def test_derivative_edges(spark):
    got = ts.derivative(series(spark, [1.0, 3.0, 9.0, None, 5.0]), ["k"], "t", "t", "v", "d").orderBy("t").collect()
    assert [r["d"] for r in got] == [2.0, 4.0, 6.0, None, None]


def test_segments_and_gaps(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 3.0), ("a", 3.2)], "k string, t double")
    assert [r["segment_id"] for r in ts.segments(df, ["k"], "t", 1.0).orderBy("t").collect()] == [0, 0, 1, 1]
    g = ts.gaps(series(spark, [None, 1.0, None, None, 2.0, None]), ["k"], "t", "t", F.col("v").isNotNull()).orderBy("first_t").collect()
    assert [(r["first_t"], r["n_rows"], r["duration"], r["at_edge"]) for r in g] == [(0.0, 1, 1.0, True), (2.0, 2, 3.0, False), (5.0, 1, 1.0, True)]


def test_resample_prefers_the_nearest_then_interpolates(spark):
    points = spark.createDataFrame([("a", i, i * 1.0) for i in range(6)], "k string, i long, t double")
    obs = spark.createDataFrame([("a", 0.1, 1.0), ("a", 2.0, 3.0), ("a", 4.6, 10.0)], "k string, t double, v double")
    got = {r["i"]: r["v"] for r in ts.resample(points, obs, ["k"], "t", ["v"], 1.0, 2.0).collect()}
    assert got[0] == 1.0 and got[2] == 3.0 and got[5] == 10.0
    assert abs(got[1] - (1.0 + 2.0 * 0.9 / 1.9)) < 1e-12
    assert got[3] is None and got[4] is None


def test_possession_flip_is_backdated(spark):
    reads = ["home"] * 3 + ["away"] * 2 + ["home"] + ["away"] * 4 + ["dead", None, "away"]
    df = spark.createDataFrame([("a", float(i), r) for i, r in enumerate(reads)], "k string, t double, raw string")
    got = ts.possession(df, ["k"], "t", "raw", 2.0).orderBy("t").collect()
    assert [r["t"] for r in got if r["flip"]] == [6.0]
    assert [r["state"] for r in got] == ["home"] * 6 + ["away"] * 4 + ["dead", "contested", "away"]
    assert got[8]["since_flip"] == 2.0 and got[10]["since_flip"] is None


def test_greedy_keeps_what_does_not_overlap(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0, 1), ("a", 3.0, 9.0, 2), ("a", 5.0, 6.0, 3), ("b", 1.0, 1.5, 4)], "k string, s double, e double, n int")
    assert sorted(r["n"] for r in patterns.greedy(df, ["k"], "s", "e").collect()) == [1, 3, 4]


def test_overlaps_appear_once(spark):
    left = spark.createDataFrame([("a", 0.0, 25.0)], "k string, start_t double, end_t double")
    right = spark.createDataFrame([("a", 5.0, 22.0, 1), ("a", 25.0, 30.0, 2)], "k string, start_t double, end_t double, id int")
    assert [r["r_id"] for r in ts.overlapping(left, right, ["k"], 5.0).collect()] == [1]


def test_shot_boundaries_drop_flashes(spark):
    still, other, flash = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    frames = [still] * 10 + [flash] + [still] * 10 + [other] * 10
    sig = spark.createDataFrame([(1, i, i / 25, h) for i, h in enumerate(frames)], "clip_id int, index long, timestamp_s double, histogram array<double>")
    d = shots.distances(sig)
    b = shots.boundaries(d, shots.thresholds(d))
    assert [r["index"] for r in b.collect()] == [21]
    assert [(r["start_index"], r["end_index"]) for r in shots.takes(d, b).orderBy("take").collect()] == [(0, 21), (21, 31)]
    assert [r["take"] for r in shots.take_of(spark.createDataFrame([(1, 20), (1, 21), (1, 99)], "clip_id int, index long"), shots.takes(d, b)).orderBy("index").collect()] == [0, 1, None]


def test_shape_needs_visibility(spark):
    rows = [(1, "home", float(i), float(i % 3), 0.0, 50.0) for i in range(4)]
    df = spark.createDataFrame(rows, "frame int, team string, x_rel double, y_rel double, vx_rel double, ball_x_rel double")
    r = shape.team_shape(df, ["frame"]).first()
    assert (r["n_visible"], r["width"], r["n_behind_ball"]) == (4, None, None)
