"""Ball, calibration, scouting and live operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import ball, calibration, evaluation, scouting
from touchline.streaming import lifecycle


def test_homography_fit_recovers_the_camera(spark):
    h = [[0.1, 0.01, -52.0], [0.005, 0.12, -34.0], [0.0002, 0.0001, 1.0]]
    rows = []
    for k in range(6):
        u, v = 100.0 + 170 * k, 80.0 + 90 * ((k * 3) % 5)
        w = h[2][0] * u + h[2][1] * v + 1
        rows.append((1, f"l{k}", (h[0][0] * u + h[0][1] * v + h[0][2]) / w, (h[1][0] * u + h[1][1] * v + h[1][2]) / w, u, v))
    rows += [(2, "a", 0.0, 0.0, 1.0, 1.0), (2, "b", 1.0, 0.0, 2.0, 1.0)]
    c = spark.createDataFrame(rows, "frame int, landmark string, wx double, wy double, u double, v double")
    fits = {r["frame"]: r for r in calibration.fit_homographies(c, ["frame"]).collect()}
    assert fits[2]["h"] is None and fits[1]["rms"] < 1e-6
    assert all(abs(a - b) < 1e-6 for x, y in zip(fits[1]["h"], h, strict=True) for a, b in zip(x, y, strict=True))


def test_smoother_coasts_and_reanchors(spark):
    rows = [("a", i * 0.2, float(i), 0.0, 1.0) for i in range(6)] + [("a", 1.2 + i * 0.2, None, None, 0.0) for i in range(2)] + [("a", 1.6 + i * 0.2, 40.0 + i, 20.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t double, x double, y double, quality double")
    got = [r["status"] for r in ball.smoothed(df, ["k"]).orderBy("t").collect()]
    assert got[:6] == ["measured"] * 6 and got[6:8] == ["coasted"] * 2
    assert "reanchored" in got[8:] and got[-1] == "measured"


def test_ball_samples_need_a_box_and_a_homography(spark):
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    frames = spark.createDataFrame([(0,), (1,), (2,)], "idx long")
    cands = spark.createDataFrame([(0, 0, 0.9, 1.0, 2.0), (0, 1, 0.9, 5.0, 5.0), (1, 0, 0.9, 3.0, 4.0), (2, 0, 0.1, 3.0, 4.0)], "idx long, pos int, conf double, u double, v double")
    hs = spark.createDataFrame([(0, eye), (2, eye)], "idx long, h array<array<double>>")
    got = {r["idx"]: r for r in ball.ball_samples(frames, cands, hs, [], 25.0, 0.3).collect()}
    assert (got[0]["x"], got[0]["y"], got[0]["n_candidates"]) == (1.0, 2.0, 2)
    assert got[1]["x"] is None and got[2]["x"] is None


def test_label_joins_are_checked(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "index int, frame string")
    with pytest.raises(evaluation.JoinIntegrityError):
        evaluation.check_join(labels, labels.filter("index = 1"), ["index"])
    with pytest.raises(evaluation.JoinIntegrityError):
        evaluation.check_join(labels, labels.withColumn("frame", F.lit("z")), ["index"])
    evaluation.check_join(labels, labels, ["index"])


def test_rules_are_validated_and_overridden(spark):
    rows = [("r1", "starter", 0.5, "p", "opponent", None, None, None, None, None, None, None, "x"), ("r1", "analyst", 0.9, "p", "opponent", None, None, None, None, None, None, None, "x"), ("r2", "starter", 1.5, "q", "opponent", None, None, None, None, None, None, None, "{nothing}")]
    rules = spark.createDataFrame(rows, scouting.RULE_SCHEMA)
    assert {(r["rule_id"], r["problem"]) for r in scouting.validate_rules(rules, ["p"]).collect()} == {("r1", "duplicate id"), ("r2", "unknown pattern"), ("r2", "priority out of range"), ("r2", "unknown placeholder")}
    assert {r["rule_id"]: r["source"] for r in scouting.override_rules(rules).collect()} == {"r1": "analyst", "r2": "starter"}


def test_live_machine_is_bounded_and_drops_late_rows():
    cfg = lifecycle.LifecycleConfig(0.6, 0.3, 3.0, 2.0, provisional_after_s=1.0)
    st = dict(zip(lifecycle.NAMES, lifecycle.EMPTY, strict=True))
    kinds = []
    for t, s in [(0, 0.7), (1, 0.8), (0.5, 0.9), (2, 0.7), (3, 0.7), (4, 0.1), (5, 0.1), (9, 0.7), (10, 0.7), (11, None)]:
        kinds += [u[0] for u in lifecycle.step(st, float(t), s, 1.0, True, cfg)]
    kinds += [u[0] for u in lifecycle.close(st, cfg)]
    assert kinds == ["provisional", "confirmed", "closed", "provisional", "retracted"]
    assert st["dropped"] == 1 and set(st) == set(lifecycle.NAMES)


def test_live_machine_does_not_depend_on_batches():
    rng = random.Random(1)
    cfg = lifecycle.LifecycleConfig(0.6, 0.3, 2.0, 1.5)
    rows = [(float(i), None if rng.random() < 0.1 else rng.random()) for i in range(300)]
    st = dict(zip(lifecycle.NAMES, lifecycle.EMPTY, strict=True))
    closed = [u[1:3] for t, s in rows for u in lifecycle.step(st, t, s, 1.0, True, cfg) if u[0] == "closed"]
    assert closed == sorted(closed) and all(b - a >= 2.0 for a, b in closed)
