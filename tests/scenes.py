"""Scenes of a match from way points: tables of observations at five frames a second.

Players are given in their team's direction of attack (0 at the own goal line), the ball in pitch coordinates; home
attacks +x. Whoever a scene doesn't place stands in a 4-4-2 around its team's centre.
"""

import json
from pathlib import Path

SCENES = json.loads((Path(__file__).parent / "fixtures" / "event_scenes.json").read_text())
FRAMES = "match_id string, frame_index long, timestamp_s double, period int"
PLAYERS = f"{FRAMES}, track_id long, team string, role string, x double, y double"
BALL = f"{FRAMES}, x double, y double"
ROWS_OF_FOUR = ((-15.0, (-18.0, -6.0, 6.0, 18.0)), (0.0, (-20.0, -7.0, 7.0, 20.0)), (12.0, (-5.0, 5.0)))


def place(points, t):
    """Linear between way points (t, x, y), at rest before and after them."""
    if t <= points[0][0]:
        return points[0][1:]
    for (t0, x0, y0), (t1, x1, y1) in zip(points, points[1:]):
        if t <= t1:
            part = (t - t0) / (t1 - t0)
            return [x0 + part * (x1 - x0), y0 + part * (y1 - y0)]
    return points[-1][1:]


def line_up(base, centres):
    """Way points of a keeper and ten players whose block follows centres (t, x)."""
    out = {base: [[0.0, 6.0, 0.0]]}
    places = [(dx, y) for dx, ys in ROWS_OF_FOUR for y in ys]
    for k, (dx, y) in enumerate(places, 1):
        out[base + k] = [[t, x + dx, y] for t, x in centres]
    return out


def observations(name, scene, hz=5.0):
    """(frames, players, ball) of one scene; its name is the match."""
    tracks = {}
    for team, base in (("home", 100), ("away", 200)):
        own = line_up(base, scene[f"{team}_centre"]) if f"{team}_centre" in scene else {}
        own |= {int(k): v for k, v in scene.get("players", {}).items() if base <= int(k) < base + 100}
        tracks |= {k: (team, v) for k, v in own.items()}
    frames, players, ball = [], [], []
    for i in range(round(scene["seconds"] * hz) + 1):
        t = i / hz
        if any(a <= t <= b for a, b in scene.get("cut", [])):
            continue
        at = (name, i, t, 1)
        frames.append(at)
        for k, (team, points) in tracks.items():
            x, y = place(points, t)
            sign = 1 if team == "home" else -1
            players.append((*at, k, team, "goalkeeper" if k % 100 == 0 else "outfield", float(sign * (x - 52.5)), float(sign * y)))
        if not any(a <= t <= b for a, b in scene.get("hidden", [])):
            ball.append((*at, *map(float, place(scene["ball"], t))))
    return frames, players, ball


def tables(spark, names):
    """(frames, player_obs, ball_obs, attack_dir) of the scenes of these names."""
    rows = [[], [], []]
    for n in names:
        for held, new in zip(rows, observations(n, SCENES[n])):
            held += new
    attack = [(n, 1, team, d) for n in names for team, d in (("home", 1), ("away", -1))]
    frames, players, ball = (spark.createDataFrame(r, ddl) for r, ddl in zip(rows, (FRAMES, PLAYERS, BALL)))
    return frames, players, ball, spark.createDataFrame(attack, "match_id string, period int, team string, dir int")
