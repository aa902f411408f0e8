"""Rules: scope, where, headlines, evidence, and what is wrong with them."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import patterns, scouting

PROFILE = [("A", "press", 5, 4.0, 0.8, 0.5), ("B", "press", 2, 1.0, 0.6, 0.4), ("U", "block", 7, 6.0, 0.9, 0.6), ("U", "press", 9, 9.0, 0.9, 0.9)]
RULES = [
    ("r1", "starter", 0.9, "press", "opponent", None, None, None, None, {"side": "left", "lane": "wide"}, None, None, "{team} by their {side}, your {mirrored_side} ({lane}): {rate_per_90:.1f} {rate_per_90:.0f} {mean_intensity}"),
    ("r2", "starter", 0.8, "press", None, None, None, None, None, None, None, None, "{count} x {pattern}"),
    ("r3", "starter", 0.7, "block", "self", None, None, None, None, None, None, None, "we: {count}"),
]
TAGS = [("A", "press", "side", "left", 2), ("A", "press", "lane", "wide", 1), ("B", "press", "side", "left", 1), ("B", "press", "lane", "wide", 0)]


def test_recommendations(spark):
    profile = spark.createDataFrame(PROFILE, "team string, pattern_id string, n int, rate_per_90 double, mean_confidence double, mean_intensity double")
    rules, squad = spark.createDataFrame(RULES, scouting.RULE_SCHEMA), spark.createDataFrame([], "capability string")
    tags = spark.createDataFrame(TAGS, "team string, pattern_id string, tag string, value string, n int")
    events = spark.createDataFrame([("A", "press", m, float(m), m + 1.0, m / 10) for m in range(9)] + [("U", "block", 1, 0.0, 1.0, None)], "team string, pattern_id string, match_id long, start_s double, end_s double, confidence double")
    rows = scouting.recommend(profile, rules, squad, tags, advised="U", events=events).collect()
    got = {(r["team"], r["rule_id"]): r for r in rows}
    assert set(got) == {("A", "r1"), ("A", "r2"), ("A", "r3"), ("B", "r2"), ("B", "r3")}
    assert got["A", "r1"]["headline"] == "A by their left, your right (wide): 4.0 4 0.50"
    assert got["A", "r2"]["headline"] == "5 x press" and got["B", "r3"]["headline"] == "we: 7" and got["B", "r3"]["of_team"] == "U"
    assert [c["match_id"] for c in got["A", "r1"]["clips"]] == ["8", "7", "6", "5", "4", "3"] and len(got["A", "r3"]["clips"]) == 1 and got["B", "r2"]["clips"] == []
    # Nobody is advised: every team is an opponent, and rules about oneself match nothing. No tags: no rule that asks for some.
    alone = {(r["team"], r["rule_id"]) for r in scouting.recommend(profile, rules, squad).collect()}
    assert alone == {("A", "r2"), ("B", "r2"), ("U", "r2")}
    assert scouting.recommend(profile.limit(0), rules, squad, tags, advised="U", events=events).count() == 0


def test_validation(spark):
    bad = [
        ("a", "s", 0.5, "press", "both", None, None, None, None, None, None, None, "x"), ("b", "s", 0.5, "press", None, None, None, None, None, None, None, None, "{side}"),
        ("c", "s", 0.5, "press", None, None, None, None, None, {"lane": "wide"}, None, None, "{lane} {mirrored_side}"), ("d", "s", 0.5, "press", None, None, None, None, None, {"lane": "wide"}, None, None, "{lane} {team} {rate_per_90:.1f}"),
        ("e", "s", 0.5, "press", None, None, None, None, None, {"side": "left"}, None, None, "{side} {mirrored_side}"),
    ]
    got = {(r["rule_id"], r["problem"]) for r in scouting.validate_rules(spark.createDataFrame(bad, scouting.RULE_SCHEMA), ["press"]).collect()}
    assert got == {("a", "unknown scope"), ("b", "unknown placeholder"), ("c", "unknown placeholder")}


def test_no_detector_is_left_out_silently(spark):
    rows = spark.range(1)
    fine = {"good": lambda r: r.select(F.lit(1).alias("x")), "bad": lambda r: r.select("nothing")}
    with pytest.raises(Exception, match="nothing"):
        patterns.detect_all(rows, fine)
    skipped = {}
    assert patterns.detect_all(rows, fine, skipped).count() == 1 and list(skipped) == ["bad"]
    with pytest.raises(ValueError, match="bad"):
        patterns.detect_all(rows, {"bad": fine["bad"]}, {})
