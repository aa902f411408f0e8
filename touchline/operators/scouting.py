"""Profiles over many matches: pattern aggregates, recency-weighted tendencies, priors and recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalar import logit, rate_per_90, recency_weight, sigmoid, soft_threshold, volume_weight, wilson_bounds
from touchline.sources.shared import by_shuffle


@dataclass(frozen=True)
class ScoutingConfig:
    half_life_days: float = 60.0
    reference_minutes: float = 60.0
    presence_min_rate_per_90: float = 3.0
    presence_min_confidence: float = 0.30
    wilson_z: float = 1.96


@dataclass(frozen=True)
class PriorConfig:
    pseudo_matches: float = 5.0
    baseline_prevalence: float = 0.35
    max_logit_shift: float = 0.85
    min_n_eff: float = 2.0
    max_provisional_scale_delta: float = 0.25


def pattern_profile(events: DataFrame, observed: DataFrame, keys: list[str] = ["match_id", "pattern_id", "team"]) -> DataFrame:  # noqa: B006
    """Per match, pattern and team: count, rate per observed 90 minutes, means, maximum and total duration.
    events: keys, start_s, end_s, confidence, intensity. observed: match_id, observed_s."""
    rows = events.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("intensity").alias("mean_intensity"), F.max("intensity").alias("max_intensity"), F.sum(F.col("end_s") - F.col("start_s")).alias("total_s"),
    )
    return rows.join(by_shuffle(observed), "match_id", "left").withColumn("rate_per_90", rate_per_90(F.col("n"), F.col("observed_s")))


def breakdowns(events: DataFrame, keys: list[str], tags: str = "tags") -> DataFrame:
    """Counts by tag and value; tags: map<string, string>."""
    return events.select(*keys, F.explode(tags).alias("tag", "value")).groupBy(*keys, "tag", "value").agg(F.count("*").alias("n"))


def phase_counts(events: DataFrame, keys: list[str], start: str = "start_s", phase_s: float = 900.0) -> DataFrame:
    """Counts by 15-minute phase, labelled like 0-15min."""
    minutes = int(phase_s // 60)
    at = (F.floor(F.col(start) / phase_s) * minutes).cast("long")
    label = F.concat(at.cast("string"), F.lit("-"), (at + minutes).cast("string"), F.lit("min"))
    return events.groupBy(*keys, label.alias("phase")).agg(F.count("*").alias("n"))


def zero_filled(aggregates: DataFrame, matches: DataFrame, patterns: list[str]) -> DataFrame:
    """A row for each match and pattern, with zeros where the pattern did not occur."""
    wanted = matches.withColumn("pattern_id", F.explode(F.array(*(F.lit(p) for p in patterns))))
    values = ("n", "rate_per_90", "mean_confidence", "mean_intensity")
    got = aggregates.select("match_id", "team", "pattern_id", *values)
    return wanted.join(got, ["match_id", "team", "pattern_id"], "left").fillna(0, list(values))


def match_weights(matches: DataFrame, as_of: Column, cfg: ScoutingConfig = ScoutingConfig()) -> DataFrame:  # noqa: B008
    """Adds age_days and weight to matches (date, observed_minutes)."""
    age = F.datediff(as_of, F.col("date"))
    return matches.withColumn("age_days", age).withColumn("weight", recency_weight(age, cfg.half_life_days) * volume_weight(F.col("observed_minutes"), cfg.reference_minutes))


def tendencies(obs: DataFrame, cfg: ScoutingConfig = ScoutingConfig(), overrides: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Per team and pattern, in one aggregation: weighted rate and spread, prevalence with Wilson bounds at the
    effective sample size, and confidence and intensity over the matches in which the pattern occurred.

    obs: zero_filled rows with weight. overrides: pattern_id, min_rate (a small table of presence floors).
    """
    floor = F.lit(cfg.presence_min_rate_per_90)
    if overrides is not None:
        obs = obs.join(F.broadcast(overrides), "pattern_id", "left")
        floor = F.coalesce("min_rate", floor)
    present = (F.col("rate_per_90") >= floor) & (F.col("mean_confidence") >= cfg.presence_min_confidence)
    w, rate = F.col("weight"), F.col("rate_per_90")
    met = F.when(F.col("n") > 0, w)

    def mean(total: Column, weight: Column) -> Column:
        return F.coalesce(total / F.when(weight > 0, weight), F.lit(0.0))

    sums = obs.groupBy("team", "pattern_id").agg(
        F.count("*").alias("n_matches"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * rate).alias("wr"), F.sum(w * rate * rate).alias("wrr"), F.sum(F.when(present, w).otherwise(0.0)).alias("wp"),
        F.sum(met).alias("wm"), F.sum(met * F.col("mean_confidence")).alias("wc"), F.sum(met * F.col("mean_intensity")).alias("wi"),
    )
    rows = sums.select(
        "team", "pattern_id", "n_matches", F.when(F.col("w") > 0, F.col("w") * F.col("w") / F.col("ww")).otherwise(0.0).alias("n_eff"), mean(F.col("wr"), F.col("w")).alias("weighted_rate"),
        F.sqrt(F.greatest(F.lit(0.0), mean(F.col("wrr"), F.col("w")) - mean(F.col("wr"), F.col("w")) * mean(F.col("wr"), F.col("w")))).alias("rate_spread"),
        mean(F.col("wp"), F.col("w")).alias("prevalence"), mean(F.col("wc"), F.col("wm")).alias("mean_confidence"), mean(F.col("wi"), F.col("wm")).alias("mean_intensity"),
    )
    low, high = wilson_bounds(F.col("prevalence"), F.col("n_eff"), cfg.wilson_z)
    return rows.withColumns({"prevalence_low": low, "prevalence_high": high})


def priors(tendency: DataFrame, cfg: PriorConfig = PriorConfig()) -> DataFrame:  # noqa: B008
    """Per team and pattern the shrunken prevalence, the weight of the evidence, the capped shift on the logit
    scale and the factor for the wait before a provisional alert."""
    p = (F.col("prevalence") * F.col("n_eff") + 0.5) / (F.col("n_eff") + 1)
    trust = F.when(F.col("n_eff") < cfg.min_n_eff, 0.0).otherwise(F.col("n_eff") / (F.col("n_eff") + cfg.pseudo_matches))
    k = cfg.max_logit_shift
    shift = F.greatest(F.lit(-k), F.least(F.lit(k), F.col("trust") * (logit(F.col("p_team")) - logit(F.lit(cfg.baseline_prevalence)))))
    rows = tendency.withColumns({"p_team": p, "trust": trust}).withColumn("shift", shift)
    return rows.select("team", "pattern_id", "n_eff", "p_team", "trust", "shift", (1 - cfg.max_provisional_scale_delta * F.col("shift") / k if k > 0 else F.lit(1.0)).alias("wait_scale"))


def adjusted(raw: Column, shift: Column) -> Column:
    """Confidence with the prior's shift; raw scores of 0 and neutral priors stay."""
    return F.when((shift == 0) | (raw <= 0), raw).otherwise(sigmoid(logit(raw) + shift))


#: Shapes of the rules table: trigger thresholds may be null, where maps breakdown tags to values.
RULE_SCHEMA = (
    "rule_id string, source string, priority double, pattern_id string, scope string, min_occurrences int, min_rate_per_90 double, min_mean_confidence double, min_mean_intensity double, "
    "where map<string,string>, requires array<string>, conflicts_group string, headline string"
)


def override_rules(rules: DataFrame, order: tuple[str, ...] = ("analyst", "starter")) -> DataFrame:
    """One rule per rule_id: that of the first source in `order`."""
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("source"))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    row = F.struct(*(F.col(c) for c in rules.columns))
    return rules.groupBy("rule_id").agg(F.min_by(row, rank).alias("r")).select("r.*")


#: What a headline may name, besides the keys of its rule's `where`; sides are those of the side that has the pattern.
NAMED = ("team", "pattern", "count", "rate_per_90", "mean_confidence", "mean_intensity")
SIDED = ("side", "mirrored_side")


def validate_rules(rules: DataFrame, patterns: list[str]) -> DataFrame:
    """(rule_id, problem) rows: unknown patterns and scopes, duplicate ids, priorities outside 0..1, unknown
    placeholders (of sides, those of rules that ask for none)."""
    asked = F.coalesce(F.map_keys("where"), F.array().cast("array<string>"))
    known = F.array_union(F.array(*(F.lit(k) for k in NAMED)), F.when(F.array_contains(asked, "side"), F.array_union(asked, F.array(*(F.lit(k) for k in SIDED)))).otherwise(asked))
    single = rules.select(
        "rule_id",
        F.explode(F.array_compact(F.array(
            F.when(~F.col("pattern_id").isin(*patterns), F.lit("unknown pattern")), F.when(~F.col("priority").between(0, 1), F.lit("priority out of range")),
            F.when(~F.coalesce("scope", F.lit("opponent")).isin("opponent", "self"), F.lit("unknown scope")),
            F.when(F.size(F.array_except(F.regexp_extract_all("headline", F.lit(r"\{([a-z_0-9]+)")), known)) > 0, F.lit("unknown placeholder")),
        ))).alias("problem"),
    )
    twice = rules.groupBy("rule_id").agg(F.count("*").alias("n")).filter("n > 1").select("rule_id", F.lit("duplicate id").alias("problem"))
    return single.unionByName(twice)


def rendered(headline: Column, team: Column, where: Column) -> Column:
    """headline with its placeholders filled in: NAMED (numbers also as {x:.0f}, {x:.1f} and {x:.2f}), SIDED, keys of where."""
    side = F.element_at(where, "side")
    text = {"team": team.cast("string"), "pattern": F.col("pattern_id"), "count": F.col("n").cast("string"), "side": side, "mirrored_side": F.when(side == "left", "right").when(side == "right", "left").otherwise(side)}
    for name in ("rate_per_90", "mean_confidence", "mean_intensity"):
        text |= {f"{name}{spec}": F.format_string(f"%{how}f", F.col(name).cast("double")) for spec, how in (("", ".2"), (":.0f", ".0"), (":.1f", ".1"), (":.2f", ".2"))}
    for name, value in text.items():
        headline = F.replace(headline, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    entries = F.map_entries(F.coalesce(where, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, headline, lambda h, e: F.replace(h, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def recommend(
    profile: DataFrame, rules: DataFrame, squad: DataFrame, tags: DataFrame | None = None, per_team: int = 8, min_score: float = 0.15, demotion: float = 0.5,
    advised: str | int | None = None, events: DataFrame | None = None, clips: int = 6,
) -> DataFrame:
    """Ranked recommendations against each profiled team: team, rank, rule_id, pattern_id, score, unmet, headline, n,
    rate_per_90, of_team (whose pattern it is) and clips.

    profile: team, pattern_id, n, rate_per_90, mean_confidence, mean_intensity. rules: RULE_SCHEMA. squad: capability
    (those that the advised team has). tags: team, pattern_id, tag, value, n; without it no rule with a `where` matches.
    A rule of scope opponent (or null) is about the team's pattern, one of scope self about that of the advised team, and
    is there against every other team; without one such rules match nothing, and with one it is no opponent. A rule's
    strength is the geometric mean of soft margins over its thresholds, 0 if a hard one fails; each missing requirement
    multiplies the score by `demotion` and is listed. The best rule of a conflict group stays. clips: of events (team,
    pattern_id, match_id, start_s, end_s, confidence), the surest ones of the pattern; empty without events.
    """
    hit = profile.join(rules, "pattern_id").withColumn("scope", F.coalesce("scope", F.lit("opponent")))

    def over(value: str, least: str) -> Column:
        return F.coalesce(F.col(value) >= F.col(least), F.col(least).isNull())

    hit = hit.filter(over("n", "min_occurrences") & over("rate_per_90", "min_rate_per_90") & over("mean_confidence", "min_mean_confidence") & over("mean_intensity", "min_mean_intensity"))
    nothing = F.create_map().cast("map<string,string>")
    if tags is None:
        hit = hit.filter(F.size(F.coalesce("where", nothing)) == 0)
    else:
        held = tags.filter("n > 0").groupBy("team", "pattern_id").agg(F.collect_set(F.concat("tag", F.lit("="), "value")).alias("held"))
        hit = hit.join(held, ["team", "pattern_id"], "left")
        wanted = F.transform(F.map_entries(F.coalesce("where", nothing)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        hit = hit.filter(F.forall(wanted, lambda x: F.coalesce(F.array_contains("held", x), F.lit(False))))
    ours = F.lit(False) if advised is None else F.col("team") == F.lit(advised)
    theirs = hit.filter((F.col("scope") == "opponent") & ~ours).withColumn("against", F.col("team"))
    if advised is not None:
        # A few rules of the advised team, against each other team.
        others = profile.filter(~ours).select(F.col("team").alias("against")).distinct()
        theirs = theirs.unionByName(hit.filter((F.col("scope") == "self") & ours).crossJoin(others))
    margins = (
        soft_threshold(F.col("rate_per_90"), F.coalesce("min_rate_per_90", F.lit(0.0)), 2.0)
        * soft_threshold(F.col("mean_confidence"), F.coalesce("min_mean_confidence", F.lit(0.0)), 0.15)
        * soft_threshold(F.col("mean_intensity"), F.coalesce("min_mean_intensity", F.lit(0.0)), 0.15)
    )
    have = squad.agg(F.collect_set("capability").alias("have"))
    hit = theirs.crossJoin(F.broadcast(have)).withColumn("unmet", F.array_sort(F.array_except(F.coalesce("requires", F.array().cast("array<string>")), "have")))
    hit = hit.withColumn("score", F.col("priority") * F.pow(margins, F.lit(1 / 3)) * F.pow(F.lit(demotion), F.size("unmet")))
    hit = hit.withColumn("headline", rendered(F.col("headline"), F.col("team"), F.col("where")))
    row = F.struct("rule_id", "pattern_id", "score", "unmet", "headline", "n", "rate_per_90", F.col("team").alias("of_team"))
    best = hit.groupBy("against", F.coalesce("conflicts_group", "rule_id").alias("g")).agg(F.max_by(row, F.struct("score", "rule_id")).alias("r"))
    kept = best.filter(F.col("r.score") >= min_score)
    # Rules are few, so a team's list is short.
    ranked = kept.groupBy("against").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("r.score").alias("score"), F.col("r").alias("r"))), asc=False), 1, per_team).alias("rs"))
    out = ranked.select(F.col("against").alias("team"), F.posexplode("rs").alias("pos", "x")).select("team", (F.col("pos") + 1).alias("rank"), "x.r.*")
    if events is None:
        return out.withColumn("clips", F.array().cast("array<struct<match_id:string,start_s:double,end_s:double,confidence:double>>"))
    order = W.partitionBy("team", "pattern_id").orderBy(F.col("confidence").desc_nulls_last(), "match_id", "start_s", "end_s")
    span = F.struct(F.col("k"), F.struct(F.col("match_id").cast("string").alias("match_id"), "start_s", "end_s", "confidence").alias("clip"))
    shown = events.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= clips).groupBy(F.col("team").alias("of_team"), "pattern_id").agg(F.sort_array(F.collect_list(span)).alias("c"))
    return out.join(shown.select("of_team", "pattern_id", F.col("c.clip").alias("clips")), ["of_team", "pattern_id"], "left").withColumn("clips", F.coalesce("clips", F.array()))
