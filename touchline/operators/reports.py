"""Event filters, line tendencies, zones and bands, and the scouting report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalar import third

# The tier of each type of event.
TIERS = {"throw_in": 1, "corner": 1, "goal_kick": 1, "kickoff": 1, "pass": 2, "shot": 2, "set_piece_setup": 2, "stoppage": 3}
# The labels and upper ends of the bins of a ball's distance to the line.
LINE_BINS = (("0-10", 10.0), ("10-20", 20.0), ("20-35", 35.0), ("35+", float("inf")))


def tier(event_type: Column, tiers: dict[str, int] = TIERS) -> Column:
    table = F.create_map(*(F.lit(x) for kv in tiers.items() for x in kv))
    return F.element_at(table, event_type)


def in_window(start: Column, end: Column, t0: float, t1: float) -> Column:
    """Whether an event overlaps the open interval."""
    return (start < t1) & (end > t0)


def declared(events: DataFrame, types: list[str], type_column: str = "event_type") -> tuple[DataFrame, DataFrame]:
    """(the events of declared types, a row for each other type with the number that is dropped)."""
    known = F.coalesce(F.col(type_column).isin(*types), F.lit(False))
    return events.filter(known), events.filter(~known).groupBy(type_column).agg(F.count("*").alias("n_dropped"))


def distance_bin(d: Column, bins: tuple[tuple[str, float], ...] = LINE_BINS) -> Column:
    out = F.when(d.isNull(), F.lit(None).cast("string"))
    for label, below in bins:
        out = out.when(d < below, label)
    return out


def line_tendency(rows: DataFrame, keys: list[str], height: str, distance: Column, bins: tuple[tuple[str, float], ...] = LINE_BINS) -> DataFrame:
    """Per keys and bin of the ball's distance: n and mean_height; every bin appears, empty ones with a null mean."""
    label = F.explode(F.array(*(F.lit(b) for b, _ in bins))).alias("bin")
    known = rows.filter(F.col(height).isNotNull() & distance.isNotNull())
    means = known.groupBy(*keys, distance_bin(distance, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(height).alias("mean_height"))
    every = rows.select(*keys).distinct().select(*keys, label)
    return every.join(means, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def zone_grid(points: DataFrame, x: Column, y: Column, length: float, width: float) -> DataFrame:
    """How many points lie in each of the 3 x 3 zones; all nine appear."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("gx"), F.lit(j).alias("gy")) for i in range(3) for j in range(3)))).alias("c")
    counts = points.groupBy(third(x, length).alias("gx"), third(y, width).alias("gy")).agg(F.count("*").alias("n"))
    every = points.sparkSession.range(1).select(cells).select("c.*")
    return every.join(counts, ["gx", "gy"], "left").select("gx", "gy", F.coalesce("n", F.lit(0)).alias("n"))


def image_bands(candidates: DataFrame, conf: float, bands: list[tuple[float, float]], row: Column, width: Column) -> DataFrame:
    """Candidates over a confidence by horizontal band of the frame: lo, hi, n, share of all and median_width. Every
    band appears."""
    table = candidates.sparkSession.createDataFrame(bands, "lo double, hi double")
    over = candidates.filter(F.col("conf") >= conf).select(row.alias("row"), width.alias("width"))
    total = over.agg(F.count("*").alias("total"))
    # Bands are few: each candidate picks its own without a join.
    own = over.withColumn("lo", F.coalesce(*(F.when((F.col("row") >= lo) & (F.col("row") < hi), F.lit(float(lo))) for lo, hi in bands)))
    counts = own.filter("lo IS NOT NULL").groupBy("lo").agg(F.count("*").alias("n"), F.median("width").alias("median_width"))
    out = table.join(counts, "lo", "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(total))
    return out.select("lo", "hi", "n", (F.col("n") / F.when(F.col("total") > 0, F.col("total"))).alias("share"), "median_width")


def top_spans(events: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """The n most confident events of each group as an array of (confidence, start_s, end_s): a ranked window, so a
    large group is never gathered whole."""
    w = W.partitionBy(*keys).orderBy(F.desc("confidence"), "start_s", "end_s")
    best = events.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "confidence", "start_s", "end_s"))).alias("s")).select(
        *keys, F.transform("s", lambda x: F.struct(x["confidence"].alias("confidence"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s"))).alias("clips")
    )


def eligible(tendencies: DataFrame, min_n_eff: float = 2.0) -> DataFrame:
    """Tendencies with evidence enough for rules: an effective sample of min_n_eff and a rate above 0."""
    return tendencies.filter((F.col("n_eff") >= min_n_eff) & (F.col("weighted_rate") > 0))


def as_match_profile(tendencies: DataFrame, counts: DataFrame, breakdowns: DataFrame, min_n_eff: float = 2.0) -> DataFrame:
    """A scouting profile in the shape of a match's: team, pattern_id, n (all events), rate_per_90, mean_confidence,
    mean_intensity and breakdowns, a map of tag=value to whole weighted counts of at least 1.

    counts: team, pattern_id, n. breakdowns: team, pattern_id, tag, value, weight (weighted counts).
    """
    whole = breakdowns.withColumn("n", F.rint("weight").cast("long")).filter("n >= 1")
    held = whole.groupBy("team", "pattern_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("tag", F.lit("="), "value"), "n")))).alias("breakdowns"))
    rows = eligible(tendencies, min_n_eff).join(counts.select("team", "pattern_id", "n"), ["team", "pattern_id"], "left").join(held, ["team", "pattern_id"], "left")
    return rows.select(
        "team", "pattern_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("weighted_rate").alias("rate_per_90"), "mean_confidence", "mean_intensity",
        F.coalesce("breakdowns", F.create_map().cast("map<string,bigint>")).alias("breakdowns"),
    )


def weighted_breakdowns(events: DataFrame, matches: DataFrame, tags: str = "tags") -> DataFrame:
    """(team, pattern_id, tag, value, weight): events counted with their match's weight. matches: team, match_id, weight."""
    each = events.select("team", "pattern_id", "match_id", F.explode(tags).alias("tag", "value")).groupBy("team", "pattern_id", "match_id", "tag", "value").agg(F.count("*").alias("n"))
    return each.join(matches.select("team", "match_id", "weight"), ["team", "match_id"]).groupBy("team", "pattern_id", "tag", "value").agg(F.sum(F.col("weight") * F.col("n")).alias("weight"))


def caveats(n_matches: Column, weak: Column) -> Column:
    """What a report has to say about its evidence, from the number of matches and the patterns below the bar."""
    return F.array_compact(F.array(
        F.when(n_matches == 0, F.lit("no footage: the report is empty")),
        F.when(n_matches.between(1, 2), F.concat(F.lit("few matches: "), n_matches.cast("string"))),
        F.when((n_matches > 2) & (F.size(weak) > 0), F.concat(F.lit("too little evidence: "), F.array_join(weak, ", "))),
        F.lit("rates are per 90 observed minutes"),
    ))


def scouting_report(teams: DataFrame, matches: DataFrame, tendencies: DataFrame, min_n_eff: float = 2.0) -> DataFrame:
    """One row per team: n_matches, observed_minutes, matches (newest first), tendencies and caveats.

    teams: team, those without matches included. matches: team, match_id, date, observed_minutes, weight. A team has
    as many matches as it played and as many tendencies as there are patterns, so its arrays are short.
    """
    played = matches.groupBy("team").agg(
        F.count("*").alias("n_matches"), F.sum("observed_minutes").alias("observed_minutes"),
        F.sort_array(F.collect_list(F.struct("date", "match_id", "observed_minutes", "weight")), asc=False).alias("matches"),
    )
    row = F.struct("pattern_id", "weighted_rate", "rate_spread", "prevalence", "prevalence_low", "prevalence_high", "n_eff", (F.col("n_eff") >= min_n_eff).alias("rules_eligible"))
    found = tendencies.groupBy("team").agg(
        F.array_sort(F.collect_list(row)).alias("tendencies"), F.array_sort(F.collect_list(F.when((F.col("n_eff") > 0) & (F.col("n_eff") < min_n_eff), F.col("pattern_id")))).alias("weak")
    )
    out = teams.select("team").distinct().join(played, "team", "left").join(found, "team", "left")
    out = out.withColumns({"n_matches": F.coalesce("n_matches", F.lit(0)), "observed_minutes": F.coalesce("observed_minutes", F.lit(0.0)), "weak": F.coalesce("weak", F.array().cast("array<string>"))})
    return out.withColumn("caveats", caveats(F.col("n_matches"), F.col("weak"))).drop("weak")


def report_documents(report: DataFrame) -> DataFrame:
    """(team, document): each report as a JSON string with its schema's name."""
    body = F.struct(F.lit("scouting-report/v1").alias("schema"), *(F.col(c) for c in report.columns))
    return report.select("team", F.to_json(body).alias("document"))


def audited(events: DataFrame, priors: DataFrame, floor: float = 0.4) -> DataFrame:
    """Events (team, pattern_id, confidence) with the prior's shift applied: adjusted, whether the raw confidence alone
    may confirm (no prior buys that), and an audit struct. Priors are joined by team and pattern."""
    from touchline.operators.scouting import adjusted

    out = events.join(priors.select("team", "pattern_id", "p_team", "trust", "shift"), ["team", "pattern_id"], "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    audit = F.struct((F.col("shift") != 0).alias("applied"), F.round("p_team", 3).alias("p_team"), F.round("trust", 3).alias("trust"), F.round("shift", 3).alias("shift"))
    return out.withColumns({"adjusted": adjusted(F.col("confidence"), F.col("shift")), "may_confirm": F.col("confidence") >= floor, "audit": audit}).drop("p_team", "trust")
