"""Readers and writers on small files, with every rule that refuses one."""

import json

import pytest

from touchline.sources import io


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_probe_and_candidates(spark, tmp_path):
    rows = [{"index": 0, "frame": "a", "imgsz": 1, "balls": [[0, 0, 4, 8, 0.5], [2, 2, 4, 4, 0.01]], "n_persons": 3}, "", {"index": 1, "frame": "b", "imgsz": 1, "n_persons": 0}]
    for size in (320, 640):
        lines(tmp_path / f"ball_probe_{size}.jsonl", rows)
    (tmp_path / "ball_probe_800.jsonl").write_text("")
    probe = io.read_probe_dumps(spark, f"{tmp_path}/ball_probe_*.jsonl")
    assert sorted((r["imgsz"], r["index"], len(r["balls"])) for r in probe.collect()) == [(320, 0, 2), (320, 1, 0), (640, 0, 2), (640, 1, 0)]
    got = io.candidates(probe.filter("imgsz = 320"), 0.05).collect()
    assert [(r["pos"], r["conf"], r["u"], r["v"], r["x"], r["y"]) for r in got] == [(0, 0.5, 2.0, 8.0, 2.0, 4.0)]


def test_calibration(spark, tmp_path):
    h = [[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]
    path = lines(tmp_path / "h.jsonl", [{"frame": "7", "h_image_to_pitch": h, "keypoints_px": {"spot": [3.0, 4.0], "odd": [1.0, 2.0], "half": [1.0]}}, {"frame": "x", "line_no": 2, "h_image_to_pitch": None}])
    assert sorted((r["idx"], r["h"] is None) for r in io.read_homographies(spark, path).collect()) == [(2, True), (7, False)]
    marks = spark.createDataFrame([("spot", 41.5, 0.0), ("half", 0.0, 0.0)], "landmark string, wx double, wy double")
    assert [tuple(r) for r in io.correspondences(io.read_calibration(spark, path), marks).collect()] == [(7, "spot", 41.5, 0.0, 3.0, 4.0)]
    with pytest.raises(io.BadInputError):
        io.read_homographies(spark, lines(tmp_path / "bad.jsonl", [{"frame": "x"}]))


def test_signatures(spark, tmp_path):
    good = {"clip_id": "c", "index": 0, "timestamp_s": 0.0, "histogram": [1.0]}
    assert io.read_signatures(spark, lines(tmp_path / "s.jsonl", [good])).count() == 1
    with pytest.raises(io.BadInputError):
        io.read_signatures(spark, lines(tmp_path / "t.jsonl", [good, good | {"histogram": []}]))


def label(**other):
    return {"index": 0, "frame": "a", "status": "visible", "x": 1.0, "y": 2.0, "width": 10, "height": 5} | other


def document(labels, **other):
    return {"schema": "ball-gt/v1", "clip_id": "c", "resolution": {"width": 10, "height": 5}, "n_frames_total": 9, "stride": 3, "sampled_indices": [0, 3], "labels": labels} | other


def test_labels(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps(document([label(), label(index=3, status="absent", x=None, y=None)]), indent=1))
    heads, rows = io.read_labels(spark, f"{tmp_path}/ok.json")
    assert heads.first()["sampled_indices"] == [0, 3] and sorted((r["index"], r["visible"]) for r in rows.collect()) == [(0, True), (3, False)]


@pytest.mark.parametrize("doc", [
    document([label()], schema="other"), document([label()], resolution=None), document([label(status="maybe")]), document([label(x=None)]), document([label(width=11)]), document([label(), label()]),
])
def test_bad_labels_are_refused(spark, tmp_path, doc):
    (tmp_path / "bad.json").write_text(json.dumps(doc))
    with pytest.raises(io.BadInputError):
        io.read_labels(spark, f"{tmp_path}/bad.json")


def test_tracking(spark, tmp_path):
    frames = lines(tmp_path / "f.jsonl", [{"id": f"i{k}", "video_id": "m", "frame": k} for k in range(2)])
    at = lambda x: {"x_bottom_middle": x, "y_bottom_middle": 1.0}
    seen = lines(tmp_path / "d.jsonl", [
        {"image_id": "i0", "role": "player", "team": "left", "track_id": 5.0, "bbox_pitch": at(3.0), "bbox_conf": 0.9, "jersey_number": "10"}, {"image_id": "i0", "role": "referee", "track_id": 6.0, "bbox_pitch": at(0.0), "bbox_conf": 0.9},
        {"image_id": "i0", "role": "goalkeeper", "team": "left", "track_id": 1.0, "bbox_pitch": at(-50.0), "bbox_conf": 0.9, "jersey_number": "?"}, {"image_id": "i1", "role": "player", "team": "right", "track_id": None, "bbox_pitch": at(1.0), "bbox_conf": 0.9},
        {"image_id": "i1", "role": "ball", "bbox_pitch": at(7.0), "bbox_conf": 0.2}, {"image_id": "i1", "role": "ball", "bbox_pitch": at(8.0), "bbox_conf": 0.6}, {"image_id": "i1", "role": "ball", "bbox_conf": 0.9},
    ])
    sides = spark.createDataFrame([("m", "left", "home"), ("m", "right", "away")], "match_id string, team string, side string")
    f, players, ball = io.read_tracking(spark, seen, frames, sides)
    assert f.count() == 2
    assert sorted((r["track_id"], r["team"] or "", r["role"], r["jersey_number"]) for r in players.collect()) == [(1, "home", "goalkeeper", None), (5, "home", "outfield", 10), (6, "", "referee", None)]
    assert [(r["frame_index"], r["x"], r["confidence"]) for r in ball.collect()] == [(1, 8.0, 0.6)]
    assert [tuple(r) for r in io.attack_directions(players).collect()] == [("m", 1, "home", 1)]


def test_documents_are_rounded_sorted_and_written_by_match(spark, tmp_path):
    rows = [("m", 2.0, 3.0, "pass", 0.12345, 1.2345, {"side": "left"}), ("m", 1.0, 9.0, "shot", 0.5, None, None), ("m", 1.0, 2.0, "pass", 0.5, 0.0, {}), ("n", 0.0, 1.0, "pass", 1.0, 0.0, {})]
    events = spark.createDataFrame(rows, "match_id string, start_s double, end_s double, event_type string, confidence double, x double, tags map<string,string>")
    docs = io.event_documents(events)
    io.write_documents(docs, f"{tmp_path}/out")
    got = json.loads(spark.read.text(f"{tmp_path}/out").filter("match_id = 'm'").first()["value"])
    assert got["schema"] == "match-events/v1" and [(e["start_s"], e["end_s"]) for e in got["events"]] == [(1.0, 2.0), (1.0, 9.0), (2.0, 3.0)]
    assert got["events"][2] == {"start_s": 2.0, "end_s": 3.0, "event_type": "pass", "confidence": 0.123, "x": 1.23, "tags": {"side": "left"}}
    profile = spark.createDataFrame([("m", "press", "home", 2, 1.23456)], "match_id string, pattern_id string, team string, n int, rate_per_90 double")
    assert json.loads(io.profile_documents(profile).first()["json"])["aggregates"] == [{"pattern_id": "press", "team": "home", "n": 2, "rate_per_90": 1.23}]


def test_rules(spark, tmp_path):
    path = lines(tmp_path / "r.jsonl", [{"rule_id": "r", "source": "starter", "priority": 0.5, "pattern_id": "press", "where": {"side": "left"}, "requires": ["pace"], "headline": "x"}])
    r = io.read_rules(spark, path).first()
    assert (r["rule_id"], r["where"], r["requires"]) == ("r", {"side": "left"}, ["pace"])
