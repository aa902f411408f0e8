"""Time-series operators over (keys, time) tables.

Every window is partitioned by the keys given, so series run in parallel; consecutive steps over the same keys
share one shuffle. Times are seconds as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.scalar import boundary_distance_m, episode_confidence, out_of_bounds_m
from touchline.sources.shared import by_shuffle

Keys = list[str]


def ordered(keys: Keys, by: str | list[str]) -> W:
    return W.partitionBy(*keys).orderBy(*([by] if isinstance(by, str) else by))


def _sofar(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, 0)


def _to_come(keys: Keys, by: str) -> W:
    """The row itself and all later ones, the latest first: a running frame, so that a key of any length takes one pass.
    (One that is unbounded at its following end is scanned anew for every row.)"""
    return _sofar(W.partitionBy(*keys).orderBy(F.col(by).desc()))


def segments(df: DataFrame, keys: Keys, t: str, max_gap: float, also: str | None = None, name: str = "segment_id", order: list[str] | None = None) -> DataFrame:
    """Numbers continuous stretches from 0: a new one starts after a gap over max_gap, or where `also` changes."""
    w = ordered(keys, order or [t])
    new = F.col(t) - F.lag(t).over(w) > max_gap
    if also:
        new = new | (F.col(also) != F.lag(also).over(w))
    return df.withColumn(name, F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(_sofar(w)).cast("int"))


def observed_seconds(df: DataFrame, keys: Keys, t: str, segment: str = "segment_id") -> DataFrame:
    """Per key: the segments' lengths plus one typical step, the median step between consecutive rows."""
    step = F.col(t) - F.lag(t).over(ordered(keys, t))
    spans = df.groupBy(*keys, segment).agg((F.max(t) - F.min(t)).alias("span")).groupBy(*keys).agg(F.sum("span").alias("span"))
    steps = df.withColumn("step", step).groupBy(*keys).agg(F.median("step").alias("step"))
    return spans.join(by_shuffle(steps), keys).select(*keys, (F.col("span") + F.coalesce("step", F.lit(0.0))).alias("observed_s"))


def grid(df: DataFrame, keys: Keys, t: str, dt: float) -> DataFrame:
    """Per key evenly spaced points (i, t) from the first to about the last time; halves round to even."""
    spans = df.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    n = F.bround((F.col("t1") - F.col("t0")) / dt, 0).cast("long")
    return spans.select(*keys, "t0", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i")).select(*keys, "i", (F.col("t0") + F.col("i") * dt).alias(t))


def resample(points: DataFrame, obs: DataFrame, keys: Keys, t: str, columns: list[str], dt: float, max_gap: float) -> DataFrame:
    """Values at the points' times: the nearest observation within dt / 2 (the earlier of two equally near),
    else linear between neighbours that are at most max_gap apart, else null. One shuffle, no range join."""
    rows = points.select(*keys, t, "i", F.lit(None).cast("struct<t:double," + ",".join(f"{c}:double" for c in columns) + ">").alias("o")).unionByName(
        obs.select(*keys, t, F.lit(None).cast("long").alias("i"), F.struct(F.col(t).alias("t"), *(F.col(c).cast("double").alias(c) for c in columns)).alias("o"))
    )
    # At equal times the observation comes first; it is seen from both sides.
    w = W.partitionBy(*keys).orderBy(F.col(t), F.col("i").isNotNull())
    back = W.partitionBy(*keys).orderBy(F.col(t).desc(), F.col("i").isNotNull().asc())
    seen = rows.withColumns(
        {"p": F.last("o", ignorenulls=True).over(_sofar(w)), "n": F.last("o", ignorenulls=True).over(_sofar(back))}
    ).filter("i IS NOT NULL")
    before, after = F.col(t) - F.col("p.t"), F.col("n.t") - F.col(t)
    span = F.col("n.t") - F.col("p.t")

    def value(c: str) -> Column:
        near = F.when((before <= dt / 2 + 1e-9) & (after.isNull() | (before <= after)), F.col(f"p.{c}")).when(after <= dt / 2 + 1e-9, F.col(f"n.{c}"))
        line = F.when((span > 0) & (span <= max_gap + 1e-9), F.col(f"p.{c}") + (F.col(f"n.{c}") - F.col(f"p.{c}")) * before / span)
        return F.coalesce(near, line)

    return seen.select(*keys, "i", t, *(value(c).alias(c) for c in columns))


def moving_average(df: DataFrame, keys: Keys, order: str, value: str, window: int, name: str) -> DataFrame:
    """Centred mean over `window` rows (made odd), cut at nulls and at the ends of the series; null stays null."""
    half = window // 2
    w = ordered(keys, order)
    run = F.sum(F.col(value).isNull().cast("int")).over(_sofar(w))
    held = df.withColumn("run_", run)
    own = W.partitionBy(*keys, "run_", F.col(value).isNull()).orderBy(order).rowsBetween(-half, half)
    return held.withColumn(name, F.when(F.col(value).isNotNull(), F.avg(value).over(own))).drop("run_")


def derivative(df: DataFrame, keys: Keys, order: str, t: str, value: str, name: str) -> DataFrame:
    """Central difference, one-sided next to nulls and ends; null without a neighbour."""
    w = ordered(keys, order)
    v, time = F.col(value), F.col(t)
    pv, nv, pt, nt = F.lag(value).over(w), F.lead(value).over(w), F.lag(t).over(w), F.lead(t).over(w)
    slope = F.when(pv.isNotNull() & nv.isNotNull(), (nv - pv) / (nt - pt)).when(nv.isNotNull(), (nv - v) / (nt - time)).when(pv.isNotNull(), (v - pv) / (time - pt))
    return df.withColumn(name, F.when(v.isNotNull(), slope))


def islands(df: DataFrame, keys: Keys, order: str, flag: Column, name: str = "island") -> DataFrame:
    """Rows where flag holds, numbered by their run of such rows."""
    w = ordered(keys, order)
    held = df.withColumn("flag_", F.coalesce(flag, F.lit(False)))
    starts = F.col("flag_") & ~F.coalesce(F.lag("flag_").over(w), F.lit(False))
    return held.withColumn(name, F.sum(starts.cast("int")).over(_sofar(w))).filter("flag_").drop("flag_")


def hysteresis_episodes(
    df: DataFrame, keys: Keys, t: str, score: str, enter: float, leave: float, min_duration: float, merge_gap: float,
    quality: str | None = None, complete: str | None = None, components: int = 1, order: str | None = None, extra: list[Column] | None = None,
) -> DataFrame:
    """Episodes of a score series: entered at `enter`, left under `leave` or at a null. Episodes less than
    merge_gap apart are one; those shorter than min_duration are dropped.

    Per episode: keys, start_t, end_t (of its last row), n_rows, mean_score and max_score over the non-null
    scores, and confidence, whose quality and completeness take all rows between the first and the last; and
    the aggregates in `extra` over these rows.
    """
    order = order or t
    w = ordered(keys, order)
    step = F.when(F.col(score) >= enter, 1).when(F.col(score).isNull() | (F.col(score) < leave), 0)
    latch = df.withColumn("in_", F.coalesce(F.last(step, ignorenulls=True).over(_sofar(w)), F.lit(0)) == 1)
    last_in = F.last(F.when(F.col("in_"), F.col(t)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    begins = F.col("in_") & ~F.coalesce(F.lag("in_").over(w), F.lit(False))
    fresh = begins & (last_in.isNull() | (F.col(t) - last_in >= merge_gap))
    numbered = latch.withColumn("last_in_", last_in).withColumn("fresh_", fresh).withColumn("episode", F.sum(F.col("fresh_").cast("int")).over(_sofar(w)))
    # Rows after an episode's end belong to it only if a later row is still in it.
    until = numbered.withColumn("end_", F.max(F.when(F.col("in_"), F.col(t))).over(W.partitionBy(*keys, "episode")))
    spans = until.filter((F.col("episode") > 0) & (F.col(t) <= F.col("end_")))
    out = spans.groupBy(*keys, "episode").agg(
        F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("n_rows"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
        (F.avg(quality) if quality else F.lit(1.0)).alias("q_"), (F.avg(F.col(complete).cast("double")) if complete else F.lit(1.0)).alias("c_"),
        *(extra or []),
    )
    out = out.filter(F.col("end_t") - F.col("start_t") >= min_duration - 1e-9)
    return out.withColumn("confidence", episode_confidence(F.col("mean_score"), F.col("q_"), F.col("c_"), components)).drop("q_", "c_")


def gaps(df: DataFrame, keys: Keys, order: str, t: str, detected: Column) -> DataFrame:
    """Runs of rows that are not detected: first_t, n_rows, duration between the detections around the run (or
    from the edge of the series), at_edge, and the rows around it as structs before and after."""
    w = ordered(keys, order)
    held = df.withColumn("seen_", F.coalesce(detected, F.lit(False)))
    row = F.struct(*(F.col(c) for c in df.columns))
    before = F.last(F.when(F.col("seen_"), row), ignorenulls=True).over(_sofar(w))
    after = F.last(F.when(F.col("seen_"), row), ignorenulls=True).over(_to_come(keys, order))
    runs = islands(held.withColumn("before", before).withColumn("after", after), keys, order, ~F.col("seen_"), "gap")
    out = runs.groupBy(*keys, "gap").agg(F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.count("*").alias("n_rows"), F.first("before").alias("before"), F.first("after").alias("after"))
    start = F.coalesce(F.col(f"before.{t}"), F.col("first_t"))
    end = F.coalesce(F.col(f"after.{t}"), F.col("last_t"))
    return out.withColumn("duration", end - start).withColumn("at_edge", F.col("before").isNull() | F.col("after").isNull())


def coverage(df: DataFrame, gap_rows: DataFrame, keys: Keys, detected: Column, isolated_rows: int = 2, interpolable_s: float = 1.0, blackout_s: float = 5.0) -> DataFrame:
    """Per key: detection rate, gap statistics, and the shares of missing rows in short gaps and of all rows in
    blackouts; shares without a denominator are null."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(detected).alias("n_detected"))

    def rows_if(c: Column) -> Column:
        return F.sum(F.when(c, F.col("n_rows")).otherwise(0))

    g = gap_rows.groupBy(*keys).agg(
        F.count("*").alias("n_gaps"), F.median("duration").alias("median_gap"), F.max("duration").alias("max_gap"),
        rows_if(F.col("n_rows") <= isolated_rows).alias("iso"), rows_if(F.col("duration") <= interpolable_s).alias("inter"), rows_if(F.col("duration") >= blackout_s).alias("black"),
    )
    missing = F.col("n") - F.col("n_detected")
    return totals.join(by_shuffle(g), keys, "left").select(
        *keys, "n", "n_detected", (F.col("n_detected") / F.col("n")).alias("detection_rate"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), "median_gap", "max_gap",
        F.when(missing > 0, F.col("iso") / missing).alias("isolated_share"), F.when(missing > 0, F.col("inter") / missing).alias("interpolable_share"),
        (F.coalesce("black", F.lit(0)) / F.col("n")).alias("blackout_share"),
    )


def gap_contexts(gap_rows: DataFrame, x: str, y: str, margin: float = 3.0) -> DataFrame:
    """Adds displacement, implied speed and whether a neighbour is near a pitch line."""
    bx, by, ax, ay = (F.col(f"{s}.{c}") for s in ("before", "after") for c in (x, y))
    moved = F.hypot(ax - bx, ay - by)
    near = F.coalesce(boundary_distance_m(bx, by) <= margin, F.lit(False)) | F.coalesce(boundary_distance_m(ax, ay) <= margin, F.lit(False))
    return gap_rows.withColumn("displacement", moved).withColumn("implied_speed", F.when(F.col("duration") > 0, moved / F.col("duration"))).withColumn("near_boundary", near)


def interpolate(df: DataFrame, keys: Keys, order: str, t: str, columns: list[str], max_gap: float, confidence: str | None = None) -> DataFrame:
    """Bridges null runs whose neighbours are at most max_gap apart; marks the rows, never fills the edges. The
    confidence of filled rows is half the smaller of the neighbours'."""
    w = ordered(keys, order)
    seen = F.col(columns[0]).isNotNull()
    names = [t, *columns] + ([confidence] if confidence else [])
    row = F.when(seen, F.struct(*names))
    held = df.withColumns({"p_": F.last(row, ignorenulls=True).over(_sofar(w)), "n_": F.last(row, ignorenulls=True).over(_to_come(keys, order))})
    span = F.col(f"n_.{t}") - F.col(f"p_.{t}")
    fill = ~seen & F.coalesce((span > 0) & (span <= max_gap), F.lit(False))
    held = held.withColumn("interpolated", fill)
    part = (F.col(t) - F.col(f"p_.{t}")) / span
    for c in columns:
        held = held.withColumn(c, F.when(F.col("interpolated"), F.col(f"p_.{c}") + (F.col(f"n_.{c}") - F.col(f"p_.{c}")) * part).otherwise(F.col(c)))
    if confidence:
        held = held.withColumn(confidence, F.when(F.col("interpolated"), 0.5 * F.least(f"p_.{confidence}", f"n_.{confidence}")).otherwise(F.col(confidence)))
    return held.drop("p_", "n_")


def kinematic_flags(df: DataFrame, keys: Keys, t: str, x: str, y: str, max_speed: float = 40.0, teleport_dt: float = 0.25, margin: float = 5.0) -> DataFrame:
    """Detected rows against the detected row before: dt, speed, overspeed, teleport, metres out of bounds."""
    w = ordered(keys, t)
    held = df.filter(F.col(x).isNotNull()).withColumn("dt", F.col(t) - F.lag(t).over(w))
    moved = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    held = held.withColumn("speed", F.when(F.col("dt") > 0, moved / F.col("dt"))).withColumn("overspeed", F.coalesce(F.col("speed") > max_speed, F.lit(False)))
    out = out_of_bounds_m(F.col(x), F.col(y))
    return held.withColumn("teleport", F.col("overspeed") & F.coalesce(F.col("dt") <= teleport_dt, F.lit(False))).withColumn("out_of_bounds", F.when(out > margin, out).otherwise(0.0))


def plausibility(flags: DataFrame, keys: Keys) -> DataFrame:
    return flags.groupBy(*keys).agg(
        F.count("*").alias("n_detected"), F.count("speed").alias("n_speed_pairs"), F.count_if("overspeed").alias("n_overspeed"), F.count_if("teleport").alias("n_teleport"),
        F.count_if(F.col("out_of_bounds") > 0).alias("n_out_of_bounds"), F.median("speed").alias("median_speed"), F.max("speed").alias("max_speed"),
    )


def temporal_support(df: DataFrame, keys: Keys, t: str, detected: Column, reach: float, name: str = "support") -> DataFrame:
    """Share of the other rows within `reach` seconds that are detected; 1 for a row that is alone."""
    micros = F.round(F.col(t) * 1e6).cast("long")
    w = W.partitionBy(*keys).orderBy("us_").rangeBetween(-int(reach * 1e6), int(reach * 1e6))
    held = df.withColumn("us_", micros).withColumn("d_", F.coalesce(detected, F.lit(False)).cast("int"))
    others = F.count("*").over(w) - 1
    return held.withColumn(name, F.when(others > 0, (F.sum("d_").over(w) - F.col("d_")) / others).otherwise(1.0)).drop("us_", "d_")


def sliding_windows(df: DataFrame, keys: Keys, t: str, length: float, stride: float) -> DataFrame:
    """(window_start, row) pairs: windows of `length` seconds every `stride` from each series' first time, as
    long as they fit into it; rows in [start, start + length). Each row meets at most length / stride windows."""
    edges = W.partitionBy(*keys)
    held = df.withColumns({"t0_": F.min(t).over(edges), "t1_": F.max(t).over(edges)})
    at = F.col(t) - F.col("t0_")
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - length) / stride) + 1)
    last = F.least(F.floor(at / stride), F.floor((F.col("t1_") - F.col("t0_") - length) / stride))
    held = held.withColumn("k_", F.explode(F.when(first <= last, F.sequence(first, last))))
    return held.withColumn("window_start", F.col("t0_") + F.col("k_") * stride).drop("t0_", "t1_", "k_")


def next_within(left: DataFrame, right: DataFrame, keys: Keys, t: str, right_id: str, horizon: float) -> DataFrame:
    """For each left row the first right row in (t, t + horizon]: next_id and next_t, or null.

    Both sides run through one window, so there is no range join.
    """
    mark = F.struct(F.col(t).alias("t"), F.col(right_id).alias("id"))
    l_cols = left.columns
    rows = left.withColumn("r_", F.lit(None).cast(f"struct<t:double,id:{right.schema[right_id].dataType.simpleString()}>")).withColumn("side_", F.lit(1))
    rows = rows.unionByName(right.select(*keys, t, mark.alias("r_"), F.lit(0).alias("side_")), allowMissingColumns=True)
    # Looking back from the end; at equal times the left row is met before the right one becomes visible.
    w = W.partitionBy(*keys).orderBy(F.col(t).desc(), F.col("side_").desc(), F.col("r_.id").desc_nulls_last())
    seen = rows.withColumn("n_", F.last("r_", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).filter("side_ = 1")
    hit = F.col("n_.t") <= F.col(t) + horizon
    return seen.select(*l_cols, F.when(hit, F.col("n_.id")).alias("next_id"), F.when(hit, F.col("n_.t")).alias("next_t"))


def overlapping(left: DataFrame, right: DataFrame, keys: Keys, bucket_s: float, cols: tuple[str, str] = ("start_t", "end_t")) -> DataFrame:
    """Pairs of left and right rows with start < other end and end > other start, by an equi-join on the keys
    and time buckets that both span. Right columns get the prefix r_; a pair appears once."""
    s, e = cols

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("b_", F.explode(F.sequence(F.floor(F.col(s) / bucket_s), F.floor(F.col(e) / bucket_s))))

    r = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    r = r.withColumn("b_", F.explode(F.sequence(F.floor(F.col(f"r_{s}") / bucket_s), F.floor(F.col(f"r_{e}") / bucket_s))))
    both = spread(left).join(by_shuffle(r), [*keys, "b_"]).filter((F.col(s) < F.col(f"r_{e}")) & (F.col(e) > F.col(f"r_{s}")))
    # The pair's first common bucket stands for all of them.
    return both.filter(F.col("b_") == F.greatest(F.floor(F.col(s) / bucket_s), F.floor(F.col(f"r_{s}") / bucket_s))).drop("b_")


def possession(df: DataFrame, keys: Keys, t: str, read: str, persistence: float) -> DataFrame:
    """Possession from raw reads ('home', 'away', 'contested', 'dead' or null) with backdated changes.

    Within a block between dead rows, a run of equal clear reads counts if it is the first or lasts
    `persistence`; a counted run of the other side flips possession as of its first row. Adds state, flip
    (at that row) and since_flip (seconds since the last flip of the series, null on dead rows).
    """
    w = ordered(keys, t)
    clear = F.col(read).isin("home", "away")
    # A row's place: rows of one time are told apart by it.
    df = df.withColumn("rn_", F.row_number().over(ordered(keys, [t, read])))
    held = df.withColumn("block_", F.sum((F.col(read) == "dead").cast("int")).over(_sofar(w)))
    held = held.withColumn("block_", F.coalesce("block_", F.lit(0)))
    in_block = W.partitionBy(*keys, "block_").orderBy(t)
    side = F.when(clear, F.col(read))
    reads = held.filter(clear).withColumn("new_", (side != F.lag(side).over(in_block)) | F.lag(side).over(in_block).isNull())
    reads = reads.withColumn("run_", F.sum(F.col("new_").cast("int")).over(_sofar(in_block)))
    of_run = W.partitionBy(*keys, "block_", "run_").orderBy(t)
    reads = reads.withColumn("run_t0_", F.min(t).over(W.partitionBy(*keys, "block_", "run_")))
    confirm = F.min(F.when(F.col(t) - F.col("run_t0_") >= persistence - 1e-9, F.col(t))).over(W.partitionBy(*keys, "block_", "run_"))
    runs = reads.withColumn("confirm_", confirm).withColumn("k_", F.row_number().over(of_run)).filter("k_ = 1")
    counted = runs.filter((F.col("run_") == 1) | F.col("confirm_").isNotNull())
    counted = counted.withColumn("flip_", F.coalesce(F.col(read) != F.lag(read).over(in_block), F.lit(False)))
    marks = counted.select(*keys, "rn_", F.struct(F.col(t).alias("t0"), F.col("confirm_").alias("confirm"), F.col(read).alias("side"), F.col("flip_").alias("flip"), F.col("block_").alias("block")).alias("m_"))
    out = held.join(by_shuffle(marks), [*keys, "rn_"], "left")
    now = F.last("m_", ignorenulls=True).over(_sofar(in_block))
    out = out.withColumn("now_", now).withColumn("flip", F.coalesce(F.col("m_.flip"), F.lit(False)))
    last_flip = F.last(F.when(F.col("flip"), F.col(t)), ignorenulls=True).over(_sofar(w))
    fixed = F.col("now_.flip") & (F.col(t) <= F.col("now_.confirm"))
    state = (
        F.when(F.col(read) == "dead", "dead")
        .when((F.col(read) == "contested") & ~F.coalesce(fixed, F.lit(False)), "contested")
        .otherwise(F.coalesce("now_.side", F.lit("contested")))
    )
    out = out.withColumn("state", state).withColumn("last_flip_", last_flip)
    quiet = (F.col("state") == "dead") | ((F.coalesce(F.col(read), F.lit("")) != "contested") & F.col("now_").isNull())
    return out.withColumn("since_flip", F.when(~quiet, F.col(t) - F.col("last_flip_"))).drop("block_", "m_", "now_", "last_flip_", "rn_")
