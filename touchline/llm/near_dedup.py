"""Near-duplicate components with SetSketch registers.

Texts with the same shingle set are one class. A class's registers are cut into bands; classes that agree in a
band share a bucket. Buckets are linked in rounds: all members are compared with one pivot of their bucket,
the links so far are merged into components, and the next round compares members with another pivot only
where they are still apart. What then remains apart in small buckets is compared pair by pair, and in large
ones by an exact prefix join. A pair is compared by the joint likelihood of its registers first, which
discards what is clearly under the threshold, and confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, free_name, quoted, table, written
from .exact_dedup import probe
from .graph import components, hinted
from .shingles import SetSketch, set_id, shingle_sets

#: Links need 100 * |intersection| >= PERCENT * |union|.
PERCENT = 75
#: A pair at the threshold shares none of the bands with probability (1 - 0.75^5)^40 = 2e-5.
BANDS, ROWS = 40, 5
#: A pair is discarded unseen if its likeliest similarity is lower and exp(20) times as likely.
DOUBT = 20.0
#: Rounds with one pivot in each bucket.
ROUNDS = 2
#: Members of a bucket that are compared pair by pair.
SMALL_BUCKET = 24
#: Members that may share a hash before it counts as hot.
HOT = 256
#: About so many members of a bucket meet in a task where a bucket is joined with what belongs to it.
DEAL = 256
#: Rows of an Arrow batch of texts, and of pairs with both sets.
TEXT_ROWS, PAIR_ROWS = 2000, 500
#: Bytes of text that are shingled at a time.
BATCH_BYTES = 1 << 21


def _batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(column):
        texts, size, start = [], 0, at
        while at < len(column) and size < BATCH_BYTES:
            texts.append(column[at].as_py() or b"")
            size += len(texts[-1])
            at += 1
        yield start, texts


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, n (size of the shingle set), set_id, registers and band keys (null for empty sets)."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(BANDS * ROWS)
        for b in batches:
            for start, texts in _batches(b.column("text")):
                sets = shingle_sets(texts)
                full = [s for s in sets if len(s)]
                regs = sketch.registers(full) if full else np.zeros((0, BANDS * ROWS), np.uint16)
                keys = sketch.bands(regs, ROWS)
                ids, rows, bands, k = [], [], [], 0
                for s in sets:
                    ids.append(set_id(s) if len(s) else None)
                    rows.append(regs[k].tobytes() if len(s) else None)
                    bands.append(keys[k].tobytes() if len(s) else None)
                    k += len(s) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("key").slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()),
                        pa.array(rows, pa.binary()), pa.array([None if x is None else np.frombuffer(x, np.int64) for x in bands], pa.list_(pa.int64())),
                    ],
                    names=["key", "n", "set_id", "regs", "bands"],
                )

    src = docs.select(quoted(key).alias("key"), quoted(text).cast("binary").alias("text"))
    return src.mapInArrow(run, f"key {key_type}, n long, set_id binary, regs binary, bands array<long>")


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(set_id, n, regs, hashes) of the wanted classes (set_id, rep, n, regs), from their representatives' texts."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in _batches(b.column("text")):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep").slice(start, len(texts)), pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["rep", "set_id", "hashes"],
                )

    src = docs.select(quoted(key).alias("rep"), quoted(text).cast("binary").alias("text"))
    # A bit filter of bounded size leaves out most texts that nobody asks for.
    asked = probe(src.withColumn("digest", F.col("rep")), wanted.select(F.col("rep").alias("digest"))).filter("maybe")
    found = asked.select("rep", "text").mapInArrow(run, f"rep {key_type}, set_id binary, hashes binary")
    return found.join(wanted, ["rep", "set_id"]).groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("n", "regs", "hashes")))


def _linked(pairs: DataFrame, rows: int, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those that are linked: likelihood first, then the full sets."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(BANDS * ROWS)
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            best, ahead = sketch.similarity(ra, rb, na, nb, PERCENT / 100)
            keep = (best >= PERCENT / 100) | (ahead < DOUBT)
            for i in np.flatnonzero(keep):
                p, q = (np.frombuffer(batch.column(c)[int(i)].as_py(), np.uint64) for c in ("hashes_a", "hashes_b"))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = 100 * both >= PERCENT * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "regs", "hashes")))

    full = side("a").join(hinted(pairs, rows), "a").join(side("b"), "b")
    full = full.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
    return full.select("a", "b", "n_a", "n_b", "regs_a", "regs_b", "hashes_a", "hashes_b").mapInArrow(compared, "a binary, b binary")


def _deals(members: Column) -> Column:
    """Into how many parts a bucket of so many members is dealt."""
    return F.ceil(members / DEAL).cast("int")


def _dealt(df: DataFrame) -> DataFrame:
    """df, a row for each bucket (with members), once for each part: so a hot bucket's join is split."""
    return df.withColumn("deal", F.explode(F.sequence(F.lit(0), _deals(F.col("members")) - 1))).drop("members")


def _prefix_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of members of one bucket (bucket, set_id, label) that have different labels and can be linked.

    A linked pair shares 3/7 of the sum of its sizes at least, and one of the rarest |set| - ceil(0.75 |set|) + 1
    hashes of each. A hash is hot if more than HOT members hold it. A pair that shares a cold one of its rarest
    hashes is found by a join on these, whose work HOT bounds for each row. Any other pair shares hot hashes
    only, so both have as many as the link needs; these are compared within their buckets. Hashes that members
    of one label alone hold don't count, and members with too few others are out.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(x.as_py(), np.int64) for x in b.column("hashes")]
            yield pa.RecordBatch.from_arrays([b.column("set_id"), b.column("label"), pa.array(rows, pa.list_(pa.int64()))], names=["set_id", "label", "hs"])

    members = rest.select("set_id", "label").distinct()
    held = members.join(sets.select("set_id", "hashes"), "set_id").mapInArrow(spread, "set_id binary, label binary, hs array<long>")
    held = written(held, "near-residue")
    each = held.select("set_id", "label", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("df"), (F.min("label") != F.max("label")).alias("apart"))
    ordered = each.join(counts, "h").groupBy("set_id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h", "apart"))).alias("hs"))
    ordered = (
        ordered.withColumn("shared", F.size(F.filter("hs", lambda x: x["apart"])))
        .withColumn("hot", F.size(F.filter("hs", lambda x: x["apart"] & (x["df"] > HOT))))
        .withColumn("hs", F.filter(F.slice("hs", F.lit(1), F.expr(f"int(n - ceil({PERCENT} * n / 100.0) + 1)")), lambda x: x["apart"] & (x["df"] <= HOT)))
        .filter(F.col("shared") * 100 >= F.col("n") * PERCENT)
    )
    ordered = written(ordered, "near-prefixes")

    def sides(df: DataFrame, on: str, count: str) -> DataFrame:
        left, right = (df.select(on, F.col("set_id").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col(count).alias(f"c{x}")) for x in "ab")
        enough = F.least("ca", "cb") * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT
        return left.join(right, (left[on] == right[on]) & (F.col("la") < F.col("lb")) & enough).select("a", "b")

    cold = sides(ordered.select("set_id", "label", "n", "shared", F.explode("hs.h").alias("h")), "h", "shared")
    hot = ordered.filter(F.col("hot") * 100 >= F.col("n") * PERCENT).select("set_id", "n", "hot")
    return cold.unionByName(sides(rest.join(hot, "set_id"), "bucket", "hot")).distinct()


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the least key of its component) and kept.

    Rows link if their shingle sets' Jaccard similarity is 0.75 or more, and form components through links.
    Null and empty texts have no shingles and are linked with nothing but rows of their own key. Rows with a
    null key are not linked: component_id is null and kept false. Repeated rows get the same result, and are
    all kept or all dropped. Other columns are ignored, names may hold anything, an empty table gives no rows, and
    texts of any length are read whole.
    """
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        base = written(sketched(docs, key, text), "near-base")
    classes = written(
        base.filter("n > 0 AND key IS NOT NULL").groupBy("set_id").agg(
            F.min("key").alias("rep"), *(F.first(c).alias(c) for c in ("n", "regs", "bands"))
        ),
        "near-classes",
    )
    each = classes.select("set_id", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("members"), F.min("set_id").alias("pivot")).filter("members > 1")
    part = F.pmod(F.xxhash64("set_id"), _deals(F.col("members"))).cast("int")
    members = written(each.join(shared, "bucket").withColumn("deal", part), "near-members")
    wanted = classes.select("set_id", "rep", "n", "regs").join(members.select("set_id"), "set_id", "left_semi")
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        sets = written(_sets(docs, key, text, written(wanted, "near-wanted")), "near-sets")

    labels: DataFrame | None = None
    labelled = 0
    done: DataFrame | None = None

    def link(pairs: DataFrame) -> bool:
        """Compare pairs (a, b), and merge components; whether there were pairs to compare."""
        nonlocal labels, labelled, done
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "near-pairs")
        rows = pairs.count()
        if not rows:
            return False
        done = pairs if done is None else done.unionByName(pairs)
        with arrow_rows(docs.sparkSession, PAIR_ROWS):
            found = written(_linked(pairs, rows, sets), "near-links")
        if labels is None:
            labels = components(found)
        elif not found.isEmpty():
            # Later links join components: their graph is that of the labels.
            old = hinted(labels, labelled)
            of = {x: old.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab"}
            between = found.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            merged = components(between.filter("a != b")).select(F.col("node").alias("label"), F.col("label").alias("root"))
            moved = labels.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            new = merged.join(labels, merged["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), F.col("root").alias("label"))
            labels = written(moved.unionByName(new), "near-labels")
        labelled = labels.count()
        return True

    def apart(df: DataFrame) -> DataFrame:
        """Members with their labels, in buckets that hold several labels."""
        known = df.join(hinted(labels.withColumnRenamed("node", "set_id"), labelled), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        mixed = known.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("members").alias("members"))
        mixed = _dealt(mixed.filter("lo != hi").select("bucket", "members"))
        return written(known.join(mixed, ["bucket", "deal"]).select("bucket", "deal", "members", "set_id", "label"), "near-apart")

    if link(members.filter("set_id != pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b"))):
        # Buckets of two members are settled by their pivot.
        rest = apart(members.filter("members > 2").select("bucket", "deal", "members", "set_id"))
        for k in range(1, ROUNDS):
            pivots = rest.groupBy("bucket").agg(F.min_by(F.struct("set_id", "label"), F.xxhash64(F.lit(k), "set_id")).alias("p"), F.first("members").alias("members"))
            pairs = rest.join(_dealt(pivots), ["bucket", "deal"]).filter("label != p.label").select(F.col("set_id").alias("a"), F.col("p.set_id").alias("b"))
            if not link(pairs):
                break
            rest = apart(rest.select("bucket", "deal", "members", "set_id"))
        small = rest.filter(F.col("members") <= SMALL_BUCKET)
        left = small.select("bucket", F.col("set_id").alias("a"), F.col("label").alias("la"))
        right = small.select("bucket", F.col("set_id").alias("b"), F.col("label").alias("lb"))
        pairs = left.join(right, "bucket").filter("la < lb").select("a", "b")
        large = rest.filter(F.col("members") > SMALL_BUCKET)
        link(pairs if large.isEmpty() else pairs.unionByName(_prefix_pairs(large, sets)))

    roots = classes.select("set_id", "rep")
    if labels is not None:
        roots = roots.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    else:
        roots = roots.withColumn("label", F.col("set_id"))
    least = roots.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_set = roots.join(least, "label").select("set_id", "component_id")
    # Texts without words have no class to look up: they all share the null set_id.
    alone = base.filter("set_id IS NULL").select("key", "n", F.col("key").alias("component_id"))
    found = base.filter("set_id IS NOT NULL").join(of_set, "set_id").select("key", "n", "component_id")
    # A null key is in no class's count of keys, so its own class may be unknown; it has no component either way.
    unkeyed = base.filter("set_id IS NOT NULL AND key IS NULL").select("key", "n", F.col("key").alias("component_id"))
    return found.filter("key IS NOT NULL").unionByName(alone).unionByName(unkeyed).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("key"), F.lit(False)).alias("kept")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that near_components keeps, with all their columns whatever their names; rows with a null key
    stay, repeated rows stay or go together, null and empty texts stay, texts of any length are compared whole, and an
    empty table gives no rows."""
    verdict = written(near_components(docs.select(quoted(key), quoted(text)), key, text), "near-verdict")
    gone = free_name(docs, "drop_key")
    drop = verdict.filter(~F.col("kept") & quoted(key).isNotNull()).select(quoted(key).alias(gone)).distinct()
    return docs.join(drop, quoted(key) == F.col(gone), "left_anti")


def query(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) END) AS sh FROM w
), h AS (SELECT doc_id, hash(sh) AS sh FROM s
), n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.i >= 75 * (x.n + y.n - c.i)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b
), m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""
