"""Mixing sources to target weights (built-in functions only).

Every source's rows are dealt by a hash into blocks, which a bijection puts in a permuted order. The mix draws
whole blocks in that order, in as many passes as the target asks for; the last block is drawn row by row. How
many of each source's draws go to which output shard is settled by a multivariate-hypergeometric splitting
tree: a node's exact quotas are split between its halves, source by source, down to the shards. A shard takes
disjoint stretches of each source's block order and is shuffled by itself. Rows with their texts meet only the
table of drawn blocks; what needs an order are blocks, sources and the rows of one block a source.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, table, unit_hash, word_count, written
from .graph import hinted

#: Sources by code point, null last, weigh these in turn.
WEIGHTS = (1, 2, 3)
#: A target is this many times its source's size at most.
MAX_PASSES = 3
#: A block holds at most about so many words and rows.
BLOCK_WORDS, BLOCK_ROWS = 4096, 64
#: Words of an output shard, and how many shards there are at least.
SHARD_WORDS, MIN_SHARDS = 1 << 24, 8
#: Quotas that are split in one step of a fold.
CHUNK = 64
#: Sources that are ranked and summed in one task.
RANKED = 1 << 18
SEED = 20_240_501
#: Source tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 50_000


@dataclass
class Mix:
    #: source, source_no, size, n_rows, target, passes, rest, bits
    sources: DataFrame
    #: the rows to mix, once for each draw, with source_no, target, source_size, mix_pass and mix_shard
    draws: DataFrame


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ln_factorial(x: Column) -> Column:
    """ln x! by Stirling's series, shifted by 8 for small x."""
    x = x.cast("double")
    y = x + 9
    shift = math.prod([x + i for i in range(2, 9)], start=x + 1)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(shift)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The u-quantile of the number of marked ones among `drawn` of `total`, by inversion.

    Values further than 9 standard deviations plus 6 from the mean, of probability under 1e-15, are left out.
    """
    n, k, m = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = m * k / F.greatest(n, F.lit(1.0))
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / F.greatest(n, F.lit(1.0))) * (n - m) / F.greatest(n - 1, F.lit(1.0))))
    box = F.struct(
        F.greatest(F.lit(0).cast("long"), drawn + marked - total, F.floor(mean - 9 * sd - 6)).alias("lo"),
        F.least(drawn, marked, F.ceil(mean + 9 * sd + 6)).alias("hi"),
        F.floor(mean).alias("mid"),
    )

    def ln_p(x: Column) -> Column:
        return -(ln_factorial(x) + ln_factorial(marked - x) + ln_factorial(drawn - x) + ln_factorial(total - marked - drawn + x))

    def invert(b: Column) -> Column:
        mid = F.greatest(b["lo"], F.least(b["hi"], b["mid"]))
        weights = let(ln_p(mid), lambda top: F.transform(F.sequence(b["lo"], b["hi"]), lambda x: F.exp(ln_p(x) - top)))

        def pick(w: Column) -> Column:
            goal = u * F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
            below = F.aggregate(
                w,
                F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")),
                lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + (a["sum"] + x <= goal).cast("long")).alias("n")),
            )["n"]
            return F.least(b["hi"], b["lo"] + below)

        return let(weights, pick)

    return let(box, invert)


def split(tree: DataFrame, seed: int) -> DataFrame:
    """One level of the tree. tree: node, quotas (array of no, q); half of a node's draws go left."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x["q"])
    kind = "array<struct<no:int,q:long>>"
    start = F.struct(F.col("total").alias("rest"), F.expr("total div 2").alias("need"), F.array().cast(f"array<{kind}>").alias("left"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("quotas") / CHUNK) - 1, F.lit(0)).cast("int")), lambda i: F.slice("quotas", i * CHUNK + 1, F.lit(CHUNK)))

    def draw(acc: Column, x: Column) -> Column:
        u = unit_hash(F.lit(seed), F.col("node"), x["no"])
        return let(
            hypergeometric(acc["rest"], x["q"], acc["need"], u),
            lambda got: F.struct(
                (acc["rest"] - x["q"]).alias("rest"),
                (acc["need"] - got).alias("need"),
                F.array_append(acc["left"], F.struct(x["no"].alias("no"), got.alias("q"))).alias("left"),
            ),
        )

    def draw_chunk(acc: Column, chunk: Column) -> Column:
        inner = F.struct(acc["rest"].alias("rest"), acc["need"].alias("need"), F.array().cast(kind).alias("left"))
        return let(
            F.aggregate(chunk, inner, draw),
            lambda got: F.struct(got["rest"].alias("rest"), got["need"].alias("need"), F.array_append(acc["left"], got["left"]).alias("left")),
        )

    left = F.flatten(F.aggregate(chunks, start, draw_chunk)["left"])
    right = F.zip_with("quotas", "left", lambda a, b: F.struct(a["no"].alias("no"), (a["q"] - b["q"]).alias("q")))
    halves = F.array(
        F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
        F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")),
    )
    return tree.withColumn("total", total).withColumn("left", left).select(F.explode(halves).alias("h")).select("h.*")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], rows: int) -> DataFrame:
    """df with columns that sum over the rows before in the given order, which ties don't leave open.

    Ranges of about RANKED rows are summed by themselves; only a row for each range meets in one task.
    """
    if rows <= RANKED:
        before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in sums.items()})
    laid = df.repartitionByRange(-(-rows // RANKED), *order).withColumn("range_", F.spark_partition_id())
    laid = written(laid.withColumns({f"{k}_own": v for k, v in sums.items()}), "mix-ranges")
    whole = laid.groupBy("range_").agg(*(F.sum(f"{k}_own").alias(f"{k}_all") for k in sums))
    earlier = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    ranges = whole.select("range_", *(F.coalesce(F.sum(f"{k}_all").over(earlier), F.lit(0)).alias(f"{k}_base") for k in sums))
    inside = W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = laid.join(F.broadcast(ranges), "range_").withColumns({k: F.coalesce(F.sum(f"{k}_own").over(inside), F.lit(0)) + F.col(f"{k}_base") for k in sums})
    return out.drop("range_", *(f"{k}_{x}" for k in sums for x in ("own", "base")))


def plan_sources(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source with its target, from items (source, size).

    Shares are proportional to weight; where that is over max_passes times a source's size the target stops
    there and the excess is shared out again. In order of size per weight, the sources that stop come first,
    and the level of the others is the first one that its own source can reach.
    """
    one = written(items.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n_rows")), "mix-sizes")
    n = one.count()
    # Null sources come last: by code point, as strings compare in Spark.
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = running(one, by_name, {"source_no": F.lit(1).cast("long")}, n).withColumn("source_no", F.col("source_no").cast("int"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("source_no", F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", (F.col("size") * max_passes).cast("double"))
    by_ratio = [F.col("cap") / F.col("weight"), F.col("source_no")]
    level_at = running(ranked, by_ratio, {"capped": F.col("cap"), "weighed": F.col("weight")}, n)
    sums = ranked.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    reach = F.col("cap") / F.col("weight")
    level = (F.lit(float(sums["size"] or 0)) - F.col("capped")) / (F.lit(float(sums["weight"] or 1)) - F.col("weighed"))
    reached = level_at.select(level.alias("level"), reach.alias("reach"), "source_no").filter("level <= reach").agg(F.min_by("level", F.struct("reach", "source_no")).alias("level")).first()["level"]
    # Without words in any source every target is 0, its cap.
    target = F.col("cap") if reached is None else F.least("cap", F.lit(reached) * F.col("weight"))
    size = F.greatest(F.col("size"), F.lit(1))
    blocks = F.greatest(F.col("size") / BLOCK_WORDS, F.col("n_rows") / BLOCK_ROWS, F.lit(1.0))
    return (
        ranked.withColumn("target", target)
        .withColumn("passes", F.least(F.lit(max_passes), F.floor(F.col("target") / size)).cast("int"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("size")))
        .withColumn("bits", F.ceil(F.log2(blocks)).cast("int"))
        .select("source", "source_no", "size", "n_rows", "target", "passes", "rest", "bits")
    )


def sized(docs: DataFrame, key: str, text: str, source: str, seed: int = SEED) -> DataFrame:
    """docs with source, size (words) and place (a hash of the row's key and text)."""
    return docs.select(
        "*",
        quoted(source).alias("mix_source"),
        word_count(quoted(text)).alias("mix_size"),
        F.xxhash64(F.lit(seed), quoted(key), quoted(text)).alias("mix_place"),
    )


def mix(
    rows: DataFrame, items: DataFrame | None = None, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES,
    shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> Mix:
    """Draw rows (from sized()) so that each source's words come near its target.

    items: the same rows' mix_source, mix_size and mix_place from a written table, where rows itself is costly
    to read; size: the words of one of its rows. A source's words are off its target by half a row's size at most. A row is drawn max_passes
    times at most; rows without words may be drawn but count nothing. Sources without words, and empty tables,
    have the target 0. Null is a source. The result depends on keys, texts and seed alone.
    """
    items, size = rows if items is None else items, F.col("mix_size") if size is None else size
    narrow = items.select(F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), F.col("mix_place").alias("place"))
    sources = written(plan_sources(narrow, weights, max_passes), "mix-sources")
    total = sources.agg(F.count("*").alias("n"), F.sum("target").alias("words")).first()
    depth = math.ceil(math.log2(max(MIN_SHARDS, (total["words"] or 0.0) / shard_words)))
    known = F.broadcast(sources) if total["n"] <= BROADCAST_SOURCES else sources

    def located(df: DataFrame, source: str, place: str) -> DataFrame:
        s = known.select(F.col("source").alias("s_source"), "source_no", F.col("size").alias("source_size"), "target", "passes", "rest", "bits")
        mask = F.expr("shiftleft(1L, bits) - 1L")
        # An odd multiplier permutes the numbers below a power of two.
        odd, shift = F.xxhash64(F.lit(seed), "source_no").bitwiseOR(F.lit(1)), F.xxhash64(F.lit(seed + 1), "source_no")
        rank = (F.expr(f"`{place}`").bitwiseAND(mask)).alias("block")
        held = df.join(s, F.col(f"`{source}`").eqNullSafe(F.col("s_source"))).drop("s_source").withColumn("block", rank)
        return held.withColumn("block", _permuted(F.col("block"), odd, shift, mask))

    # Words before each block in its source's order, in two levels so that no window holds a whole source.
    per_block = located(narrow, "source", "place").groupBy("source_no", "block").agg(
        F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("rest", "passes", "bits"))
    ).withColumn("stretch", F.shiftright("block", 8))
    per_block = written(per_block, "mix-blocks")
    stretches = per_block.groupBy("source_no", "stretch").agg(F.sum("words").alias("s_words"))
    stretches = stretches.select(
        "source_no", "stretch",
        F.coalesce(F.sum("s_words").over(W.partitionBy("source_no").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s_before"),
    )
    inner = W.partitionBy("source_no", "stretch").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        per_block.withColumn("in_before", F.coalesce(F.sum("words").over(inner), F.lit(0)))
        .join(stretches, ["source_no", "stretch"])
        .withColumn("cut", F.col("rest") - F.col("s_before") - F.col("in_before"))
        .select("source_no", "block", "passes", "bits", "cut", "words")
    )
    blocks = written(blocks, "mix-cuts")

    # Positions of a source's draws: pass after pass of its blocks; the last pass ends with the cut one.
    quotas = blocks.groupBy("source_no").agg(
        F.first("passes").alias("passes"), F.first("bits").alias("bits"),
        F.max(F.when(F.col("cut") > 0, F.col("block") + 1).otherwise(0)).alias("last"),
    ).select(F.col("source_no").alias("no"), F.expr("passes * shiftleft(1L, bits) + last").alias("q"))
    tree = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("no", "q"))).alias("quotas"))
    tree = tree.select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(depth):
        tree = split(tree, seed + 2)
        if level % 5 == 4:
            tree = written(tree.repartition("node"), "mix-tree")
    shards = tree.select(F.col("node").alias("shard"), F.explode("quotas").alias("x")).select("shard", "x.no", "x.q").filter("q > 0")
    ends = F.sum("q").over(W.partitionBy("no").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    places = (
        shards.withColumn("end", ends)
        .select("no", "shard", F.explode(F.expr("sequence(end - q, end - 1)")).alias("at"))
        .withColumnRenamed("no", "source_no")
    )
    bits = sources.select("source_no", F.col("bits").alias("b"))
    places = places.join(F.broadcast(bits) if total["n"] <= BROADCAST_SOURCES else bits, "source_no").select(
        "source_no", (F.expr("at & (shiftleft(1L, b) - 1L)")).alias("block"), F.expr("shiftright(at, b)").cast("int").alias("mix_pass"), (F.col("shard") - (1 << depth)).alias("mix_shard")
    )
    drawn = places.join(blocks.select("source_no", "block", "cut", (F.col("words") <= F.col("cut")).alias("inside"), F.col("passes").alias("full")), ["source_no", "block"])
    drawn = written(drawn.withColumn("whole", (F.col("mix_pass") < F.col("full")) | F.col("inside")).drop("full", "inside"), "mix-draws")
    n_drawn = drawn.count()
    held = located(rows, "mix_source", "mix_place")
    whole = held.join(hinted(drawn.filter("whole").drop("whole", "cut"), n_drawn), ["source_no", "block"])
    # One block a source is drawn in part; of its rows those come first whose hash is less.
    order = W.partitionBy("source_no", "block").orderBy("mix_place").rowsBetween(W.unboundedPreceding, -1)
    part = held.join(hinted(drawn.filter("not whole").drop("whole"), total["n"]), ["source_no", "block"]).withColumn("mix_words", size)
    before = F.coalesce(F.sum("mix_words").over(order), F.lit(0))
    part = part.withColumn("mix_before", before).filter(F.col("mix_before") + F.col("mix_words") / 2 <= F.col("cut")).drop("mix_before", "mix_words", "cut")
    return Mix(sources, whole.unionByName(part).drop("passes", "rest", "bits", "block"))


def _permuted(block: Column, odd: Column, shift: Column, mask: Column) -> Column:
    # Only the low bits count, so reduced factors keep the product in range.
    low = F.lit((1 << 31) - 1)
    return (block * odd.bitwiseAND(mask).bitwiseAND(low) + shift.bitwiseAND(mask)).bitwiseAND(mask)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix with the columns of docs: a row for each draw, dealt by shard and shuffled within it.

    Null texts have no words and may be drawn with their block; null is a source; repeated rows are drawn each;
    an empty table gives no rows. Texts of any length count whole: a source's words are off its target by half a
    text at most.
    """
    rows = sized(docs, key, text, source)
    items = written(rows.select("mix_source", "mix_size", "mix_place"), "mix-items")
    held = rows.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), "mix_source", "mix_place")
    draws = mix(held, items, word_count(F.col("row").getField(text)), **options).draws
    return (
        draws.repartition("mix_shard", F.pmod("mix_place", F.lit(16)))
        .sortWithinPartitions("mix_shard", F.xxhash64("mix_place", "mix_pass"))
        .select("row.*")
    )


def taken_words(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Per row of docs: key, size, source_size, target, taken, copies and shards (the output shard of each copy).

    Rows that the mix leaves out take 0; null texts have no words; null is a source; repeated rows are drawn
    each; an empty table gives no rows. Other columns are ignored.
    """
    plain = docs.select(quoted(key).alias("key"), quoted(text).alias("text"), quoted(source).alias("source"))
    sized_rows = sized(plain, "key", "text", "source").select(F.col("key").alias("mix_key"), F.monotonically_increasing_id().alias("mix_row"), "mix_source", "mix_size", "mix_place")
    rows = written(sized_rows, "mix-items")
    mixed = mix(rows, **options)
    got = mixed.draws.groupBy("mix_row").agg(
        F.sum("mix_size").alias("taken"), F.count("*").alias("copies"), F.sort_array(F.collect_list(F.col("mix_shard").cast("int"))).alias("shards")
    )
    s = mixed.sources.select("source", F.col("size").alias("source_size"), "target")
    return (
        rows.join(got, "mix_row", "left")
        .join(s, F.col("mix_source").eqNullSafe(F.col("source")))
        .select(
            F.col("mix_key").alias(key), F.col("mix_size").alias("size"), "source_size", "target",
            F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"),
        )
    )


def query(spark, sf_dir):
    return taken_words(table(spark, sf_dir, "documents"))
