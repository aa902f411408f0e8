"""Tactical episodes from team features: scores are Columns, episodes come from one shared builder.

A detector is a score and a completeness Column over team_features rows, with thresholds and summaries; batch and
streaming use the same Columns. Rows out of a pattern's scope score null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalar import MISSING_FACTOR, clamp01, episode_confidence, sigmoid, soft_threshold
from touchline.operators import timeseries as ts
from touchline.sources.shared import by_shuffle

KEYS = ["match_id", "segment_id", "team"]


def c(name: str) -> Column:
    return F.col(name)


@dataclass(frozen=True)
class Detector:
    pattern_id: str
    score: Callable[[], Column]
    complete: Callable[[], Column]
    components: int
    min_duration_s: float
    merge_gap_s: float
    enter: float = 0.30
    leave: float = 0.15
    keys: tuple[str, ...] = ()
    #: aggregates over an episode's rows, and the intensity and tags made of them
    extra: Callable[[], list[Column]] = list
    intensity: Callable[[], Column] = lambda: F.lit(0.0)
    tags: dict[str, Callable[[], Column]] = field(default_factory=dict)
    needs: tuple[str, ...] = ()


def out_of_possession() -> Column:
    return c("state").isin("home", "away") & (c("state") != c("team")) & c("ball_valid")


def in_possession() -> Column:
    return (c("state") == c("team")) & c("ball_valid")


def _product(factors: list[Column]) -> Column:
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return out


def _known(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & c(n).isNotNull()
    return out


def _mean_of(*terms: Column) -> Column:
    """Mean of the terms that aren't null; 0 without any."""
    total, n = F.lit(0.0), F.lit(0)
    for t in terms:
        total, n = total + F.coalesce(t, F.lit(0.0)), n + t.isNotNull().cast("int")
    return F.when(n > 0, total / n).otherwise(0.0)


def high_press_score() -> Column:
    return F.when(out_of_possession(), _product([
        soft_threshold(c("ball_x_rel"), 70.0, 5.0), soft_threshold(c("line_height"), 40.0, 5.0), soft_threshold(c("within_15m").cast("double"), 3, 0.75),
        soft_threshold(c("nearest_defender"), 4.6, 1.5, above=False), soft_threshold(c("closing_speed"), 0.5, 0.5),
    ]))


def high_press_intensity() -> Column:
    terms = (clamp01((c("within_15m") - 2) / 4.0), clamp01(c("closing_speed") / 2.5), clamp01((c("line_height") - 40.0) / 20.0))
    known = (c("within_15m").isNotNull(), c("closing_speed").isNotNull(), c("line_height").isNotNull())
    parts = [F.when(k, t) for k, t in zip(known, terms, strict=True)]
    return F.when(known[0] | known[1] | known[2], _mean_of(*parts))


def low_block_score() -> Column:
    """Needs adaptive_hull, the team's own lower quartile of hull areas out of possession."""
    absolute = soft_threshold(c("hull_area"), 700.0, 100.0, above=False)
    width = F.greatest(F.lit(20.0), 0.15 * c("adaptive_hull"))
    own = sigmoid(-(c("hull_area") - c("adaptive_hull")) / width)
    hull = F.when(c("hull_area").isNull(), MISSING_FACTOR).when(c("adaptive_hull") > 0, F.greatest(absolute, own)).otherwise(absolute)
    trusted = (c("n_visible") >= 9) & c("n_behind_ball").isNotNull()
    behind = F.when(trusted, soft_threshold(c("n_behind_ball").cast("double"), 8, 0.75)).otherwise(MISSING_FACTOR)
    return F.when(out_of_possession(), _product([
        soft_threshold(c("ball_x_rel"), 52.5, 5.0, above=False), soft_threshold(c("line_height"), 28.0, 4.0, above=False), soft_threshold(c("width"), 40.0, 4.0, above=False), hull, behind,
    ]))


def offside_trap_score() -> Column:
    return F.when(out_of_possession(), _product([
        soft_threshold(c("ball_x_rel") - c("line_height"), 35.0, 5.0, above=False), soft_threshold(c("line_velocity"), 1.5, 0.5), soft_threshold(c("line_flatness"), 2.5, 1.0, above=False),
    ]))


def flank_score() -> Column:
    """Needs side, sign (1 for left) and attackers (of the ball-side lanes)."""
    return F.when(in_possession(), _product([
        soft_threshold(c("sign") * c("ball_y_rel"), 13.6, 2.0), soft_threshold(c("ball_x_rel"), 35.0, 5.0), soft_threshold(c("attackers").cast("double"), 3, 0.75),
        soft_threshold(c("superiority_10m").cast("double"), 1, 0.75), soft_threshold(c("sign") * c("centroid_y"), 5.0, 2.0),
    ]))


HIGH_PRESS = Detector(
    "high_press", high_press_score, lambda: out_of_possession() & _known("ball_x_rel", "line_height", "within_15m", "nearest_defender", "closing_speed"), 5, 3.0, 2.0,
    extra=lambda: [F.avg(high_press_intensity()).alias("i0"), F.median("since_flip").alias("m0")],
    intensity=lambda: F.coalesce(clamp01(c("i0")), F.lit(0.0)), tags={"is_counter_press": lambda: F.coalesce(c("m0") < 5.0, F.lit(False)).cast("string")},
)
LOW_BLOCK = Detector(
    "low_block", low_block_score, lambda: out_of_possession() & (c("n_visible") >= 9) & _known("n_behind_ball", "ball_x_rel", "line_height", "width", "hull_area"), 5, 12.0, 4.0,
    extra=lambda: [F.avg("line_height").alias("i0"), F.avg("width").alias("m0")],
    intensity=lambda: clamp01(_mean_of(clamp01((c("end_t") - c("start_t")) / 30.0), F.when(c("i0").isNotNull(), clamp01((28.0 - c("i0")) / 15.0)), F.when(c("m0").isNotNull(), clamp01((40.0 - c("m0")) / 15.0)))),
)
OFFSIDE_TRAP = Detector("offside_trap", offside_trap_score, lambda: out_of_possession() & _known("ball_x_rel", "line_height", "line_velocity", "line_flatness"), 3, 0.5, 1.0, extra=lambda: [F.max("line_velocity").alias("i0")])
FLANK_OVERLOAD = Detector(
    "flank_overload", flank_score, lambda: in_possession() & _known("ball_x_rel", "ball_y_rel", "superiority_10m", "centroid_y"), 5, 3.0, 2.0, keys=("side",),
    extra=lambda: [F.max(F.when(in_possession(), c("attackers"))).alias("i0"), F.max("superiority_10m").alias("m0"), F.avg(c("sign") * c("centroid_y")).alias("m1")],
    intensity=lambda: clamp01(_mean_of(F.when(c("i0").isNotNull(), clamp01((c("i0") - 2) / 3.0)), F.when(c("m0").isNotNull(), clamp01(c("m0") / 3.0)), F.when(c("m1").isNotNull(), clamp01(c("m1") / 12.0)))),
    tags={"side": lambda: c("side")},
)
COUNTER = {"window_s": 14.0, "score_min": 0.30, "min_gain": 16.0, "final_third": 70.0, "min_speed": 4.0, "min_runners": 2, "margin": 1}


def episodes(rows: DataFrame, det: Detector) -> DataFrame:
    """Events of a detector: match_id, segment_id, team, pattern_id, period, start_s, end_s, confidence,
    intensity and tags."""
    keys = [*KEYS, *det.keys]
    held = rows.withColumn("score_", det.score()).withColumn("complete_", F.coalesce(det.complete(), F.lit(False)))
    out = ts.hysteresis_episodes(
        held, keys, "timestamp_s", "score_", det.enter, det.leave, det.min_duration_s, det.merge_gap_s, "quality", "complete_", det.components, extra=[F.first("period").alias("period"), *det.extra()]
    )
    tags = F.create_map(*(x for k, v in det.tags.items() for x in (F.lit(k), v()))) if det.tags else F.create_map().cast("map<string,string>")
    return out.withColumn("intensity", det.intensity()).withColumn("tags", tags).withColumn("pattern_id", F.lit(det.pattern_id)).withColumnsRenamed({"start_t": "start_s", "end_t": "end_s"})


COLUMNS = ["match_id", "segment_id", "team", "pattern_id", "period", "start_s", "end_s", "confidence", "intensity", "tags"]


def high_press(rows: DataFrame) -> DataFrame:
    """With the trigger tag: restart if the ball was dead in the six seconds before the start."""
    ev = episodes(rows, HIGH_PRESS)
    dead = rows.filter("state = 'dead'").select("match_id", "segment_id", c("timestamp_s").alias("dead_s")).distinct()
    late = ev.join(by_shuffle(dead), ["match_id", "segment_id"]).filter((c("dead_s") >= c("start_s") - 6.0) & (c("dead_s") < c("start_s"))).select(*KEYS, "start_s").distinct().withColumn("r_", F.lit("restart"))
    ev = ev.join(by_shuffle(late), [*KEYS, "start_s"], "left")
    return ev.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("trigger"), F.coalesce("r_", F.lit("open_play"))))).select(*COLUMNS)


def adaptive_hull(rows: DataFrame, q: float = 0.25) -> DataFrame:
    """Per match and team the hull area at index int(q * (n - 1)) among the frames out of possession."""
    live = rows.filter(c("hull_area").isNotNull() & c("state").isin("home", "away") & (c("state") != c("team")))
    w = W.partitionBy("match_id", "team")
    ranked = live.select("match_id", "team", "hull_area", (F.row_number().over(w.orderBy("hull_area")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    return ranked.filter(c("k") == F.floor((c("n") - 1) * q)).select("match_id", "team", c("hull_area").alias("adaptive_hull"))


def low_block(rows: DataFrame) -> DataFrame:
    return episodes(rows.join(by_shuffle(adaptive_hull(rows)), ["match_id", "team"], "left"), LOW_BLOCK).select(*COLUMNS)


def offside_trap(rows: DataFrame) -> DataFrame:
    """Episodes whose line gains 2 m within two seconds; a ball surge of 8 m/s up to 1.5 s later adds 15 %, to
    0.7 at most."""
    ev = episodes(rows, OFFSIDE_TRAP)
    near = ev.join(by_shuffle(rows.select(*KEYS, "timestamp_s", c("line_height").alias("h"), c("ball_vx_rel").alias("bv"))), KEYS)
    near = near.filter((c("timestamp_s") >= c("start_s")) & (c("timestamp_s") <= F.greatest(c("start_s") + 2.0, c("end_s") + 1.5)))
    found = near.groupBy(*KEYS, "start_s").agg(
        F.max(F.when(c("timestamp_s") == c("start_s"), c("h"))).alias("h0"), F.max(F.when(c("timestamp_s") <= c("start_s") + 2.0, c("h"))).alias("h1"),
        F.max(F.when(c("timestamp_s") <= c("end_s") + 1.5, -c("bv"))).alias("surge"),
    )
    ev = ev.join(by_shuffle(found), [*KEYS, "start_s"]).withColumn("gain", c("h1") - c("h0")).filter("gain >= 2")
    through = F.coalesce(c("surge") >= 8.0, F.lit(False))
    pace = F.when(c("i0").isNotNull(), clamp01(c("i0") / 4.0)).otherwise(0.0)
    return ev.withColumn("confidence", F.least(F.lit(0.7), c("confidence") * F.when(through, 1.15).otherwise(1.0))).withColumn("intensity", clamp01((clamp01(c("gain") / 6.0) + pace) / 2)).withColumn(
        "tags", F.create_map(F.lit("through_ball_detected"), through.cast("string"))
    ).select(*COLUMNS)


def flank_overload(rows: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.lit(1.0).alias("sign"), (c("n_wide_left") + c("n_halfspace_left")).alias("attackers")),
        F.struct(F.lit("right").alias("side"), F.lit(-1.0).alias("sign"), (c("n_wide_right") + c("n_halfspace_right")).alias("attackers")),
    )
    return episodes(rows.withColumn("s_", F.explode(sides)).select("*", "s_.*").drop("s_"), FLANK_OVERLOAD).select(*COLUMNS)


def greedy(candidates: DataFrame, keys: list[str], start: str, until: str, tie: Column | None = None) -> DataFrame:
    """The candidates that a pass in order of start keeps, where a kept one blocks later ones that start before
    its `until`. Those of equal start and `until` go by `tie`, then by their columns. A key has tens of candidates,
    which are folded as one sorted array."""
    rest = [x for x in candidates.columns if x not in keys]
    row = F.struct(c(start).alias("at_"), c(until).alias("to_"), (F.lit(0) if tie is None else tie).alias("tie_"), F.struct(*rest).alias("row"))
    folded = F.aggregate(
        F.array_sort(F.collect_list(row)),
        F.struct(F.lit(-1e18).alias("to_"), F.array().cast(f"array<{candidates.select(F.struct(*rest).alias('r')).schema['r'].dataType.simpleString()}>").alias("kept")),
        lambda a, x: F.when(x["at_"] < a["to_"], a).otherwise(F.struct(x["to_"].alias("to_"), F.array_append(a["kept"], x["row"]).alias("kept"))),
    )
    return candidates.groupBy(*keys).agg(folded["kept"].alias("kept")).select(*keys, F.explode("kept").alias("r")).select(*keys, "r.*")


def counter_attack(rows: DataFrame) -> DataFrame:
    """Progress after won balls: from each turnover to the furthest ball position within 14 s, before the
    opponent has it again; a team's events don't overlap."""
    p = COUNTER
    anchors = rows.filter(c("flip") & (c("state") == c("team")) & c("ball_x_rel").isNotNull()).select(*KEYS, c("timestamp_s").alias("t0"), c("ball_x_rel").alias("x0"), c("period").alias("period"))
    window = anchors.join(by_shuffle(rows.select(*KEYS, "timestamp_s", "i", "state", "ball_x_rel", "n_forward_runners", "quality")), KEYS).filter((c("timestamp_s") >= c("t0")) & (c("timestamp_s") <= c("t0") + p["window_s"]))
    lost = F.max((c("state").isin("home", "away") & (c("state") != c("team"))).cast("int")).over(W.partitionBy(*KEYS, "t0").orderBy("timestamp_s").rowsBetween(W.unboundedPreceding, 0))
    own = window.withColumn("lost", lost).filter("lost = 0").withColumn("mine", c("state") == c("team"))
    peak = own.groupBy(*KEYS, "t0", "x0", "period").agg(
        F.max_by(F.struct(c("ball_x_rel").alias("x"), c("timestamp_s").alias("t")), F.when(c("mine") & c("ball_x_rel").isNotNull(), F.struct(c("ball_x_rel"), -c("timestamp_s")))).alias("p"),
        F.max(F.when(c("mine"), c("n_forward_runners"))).alias("runners"), F.collect_list(F.struct(c("timestamp_s").alias("t"), c("quality").alias("q"))).alias("qs"),
    ).filter(c("p.t") > c("t0"))
    gain = c("p.x") - c("x0")
    peak = peak.withColumns({"gain": gain, "speed": gain / (c("p.t") - c("t0"))})
    score = F.greatest(soft_threshold(c("gain"), p["min_gain"], 8.0), soft_threshold(c("p.x"), p["final_third"], 5.0)) * soft_threshold(c("speed"), p["min_speed"], 1.5) * soft_threshold(c("runners").cast("double"), p["min_runners"], 0.75)
    until = F.filter("qs", lambda q: q["t"] <= c("p.t"))
    peak = peak.withColumn("score", score).filter(c("score") >= p["score_min"]).withColumn("q", F.aggregate(until, F.lit(0.0), lambda s, q: s + q["q"]) / F.size(until))
    # The opponents' usual number behind the ball, against that at the peak.
    other = rows.withColumn("team", F.when(c("team") == "home", "away").otherwise("home")).select(*KEYS, c("timestamp_s").alias("pt"), c("n_behind_ball").alias("opp"), "state")
    usual = other.filter(c("state") == c("team")).groupBy(*KEYS).agg(F.median("opp").alias("usual"))
    peak = peak.withColumn("pt", c("p.t")).join(by_shuffle(usual), KEYS, "left").join(by_shuffle(other.select(*KEYS, "pt", "opp")), [*KEYS, "pt"], "left")
    open_ = F.coalesce(c("opp") <= c("usual") - p["margin"], F.lit(False))
    where = F.when(c("x0") < 35, "deep").when(c("x0") < p["final_third"], "middle").otherwise("high")
    ready = peak.select(
        *KEYS, F.lit("counter_attack").alias("pattern_id"), "period", c("t0").alias("start_s"), c("pt").alias("end_s"), episode_confidence(c("score"), c("q"), F.lit(1.0), 3).alias("confidence"),
        clamp01((clamp01(c("gain") / 45) + clamp01(c("speed") / 8) + clamp01(c("runners") / 4)) / 3 + F.when(open_, 0.1).otherwise(0.0)).alias("intensity"),
        F.create_map(F.lit("turnover_location"), where, F.lit("reached_final_third"), (c("p.x") >= p["final_third"]).cast("string")).alias("tags"),
    )
    # Maps can't be sorted, so tags travel as entries.
    packed = greedy(ready.withColumn("tags", F.map_entries("tags")), KEYS, "start_s", "end_s")
    return packed.withColumn("tags", F.map_from_entries("tags")).select(*COLUMNS)


DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "low_block": low_block, "high_press": high_press, "counter_attack": counter_attack, "flank_overload": flank_overload, "offside_trap": offside_trap,
}


def detect_all(rows: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]] = DETECTORS, skipped: dict[str, str] | None = None) -> DataFrame:
    """The union of all detectors' events. A detector that can't be planned on these columns raises; a caller that gives
    `skipped` gets its name and reason there instead, so that a result without it doesn't look whole."""
    parts = []
    for name, build in detectors.items():
        try:
            part = build(rows)
            part.schema  # noqa: B018  analysed here, so that a failure stays this detector's
            parts.append(part)
        except Exception as e:
            if skipped is None:
                raise
            skipped[name] = str(e)[:500]
    if not parts:
        raise ValueError(f"no detector can be planned: {skipped}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
