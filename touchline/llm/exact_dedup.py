"""Exact deduplication with a log-structured merge index (built-in functions only).

Rows enter memtables (the rows of one writing task), which are flushed as runs: Parquet files sorted by digest,
with a Bloom filter on it. Compaction merges the runs of a level into one sorted run of the next, with one entry
per digest that holds the row to keep so far. Digests that occur more than once go into a bit filter sized by
their number, which sends only possible hits to byte verification: that compares the whole normalised texts.
Further batches can be added to an index and looked up in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, new_path, quoted, table, written

#: Runs of a level that a compaction merges.
FANOUT = 4
#: Bits of a filter for each of its entries, and the number of entries up to which it is broadcast (a 64-bit word
#: for each 8 of them); beyond it rows are joined instead.
FILTER_BITS, FILTER_ENTRIES = 8, 1 << 22


def normal_text(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _digest(norm: Column, bits: int) -> Column:
    return F.unhex(F.substring(F.sha2(norm, 256), 1, bits // 4))


def flush(entries: DataFrame) -> DataFrame:
    """Level 0: each task's entries (digest and more) as a run sorted by digest, with a Bloom filter."""
    path = new_path(entries.sparkSession, "dedup-runs")
    (
        entries.sortWithinPartitions("digest")
        .write.option("parquet.bloom.filter.enabled#digest", "true")
        .option("parquet.bloom.filter.expected.ndv#digest", "50000")
        .option("parquet.bloom.filter.max.bytes", "131072")
        .parquet(path)
    )
    return entries.sparkSession.read.schema(entries.schema).parquet(path)


def kept(largest: bool) -> Column:
    """Aggregate: the keep (key and more) of the largest or smallest key; null keys come last either way."""
    keep = F.col("keep")
    return F.max(keep) if largest else F.min_by(keep, F.struct(keep["key"].isNull(), keep))


def compact(runs: DataFrame, largest: bool) -> DataFrame:
    """Merge runs (digest, keep, n): one entry per digest, sorted, with the row to keep and the number of rows."""
    merged = runs.groupBy("digest").agg(kept(largest).alias("keep"), F.sum("n").alias("n"))
    return written(merged.sortWithinPartitions("digest"), "dedup-index")


def _bit_of(digest: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(digest)
    return F.pmod(h, F.lit(words)).cast("int"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")


def hit_filter(hits: DataFrame, words: int) -> DataFrame:
    """(word, bits) rows over the digests of hits: `words` rows at most."""
    word, bit = _bit_of(F.col("digest"), words)
    bits = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    return hits.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(bits)


def probe(df: DataFrame, hits: DataFrame, words: int | None = None) -> DataFrame:
    """df, which has a digest, with a column maybe: false only if hits doesn't hold the digest.

    The hits are counted: up to FILTER_ENTRIES of them make a broadcast bit filter of FILTER_BITS bits each, more
    are joined. words: the size of the filter, without a count.
    """
    if words is None:
        n = hits.count()
        if n > FILTER_ENTRIES:
            held = hits.select("digest").distinct().withColumn("held", F.lit(True))
            return df.join(held, "digest", "left").withColumn("maybe", F.coalesce("held", F.lit(False))).drop("held")
        words = 1 << max(10, (n * FILTER_BITS // 64).bit_length())
    word, bit = _bit_of(F.col("digest"), words)
    return (
        df.withColumns({"word": word, "bit": bit})
        .join(F.broadcast(hit_filter(hits, words)), "word", "left")
        .withColumn("maybe", F.expr("coalesce(bits & shiftleft(1L, bit), 0L) != 0"))
        .drop("word", "bit", "bits")
    )


@dataclass(frozen=True)
class MergeIndex:
    """Runs by level, each (digest, keep struct<key>, n): batches are added at level 0, and FANOUT runs of a level
    become one of the next, so an entry is rewritten once a level. Null keys lose against all others."""

    largest: bool = False
    runs: tuple[tuple[int, DataFrame], ...] = field(default=())

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> MergeIndex:
        """The index with a batch: its rows flushed as a run, and full levels merged."""
        digest = F.unhex(F.sha2(normal_text(quoted(text)), 256))
        entries = flush(docs.select(digest.alias("digest"), F.struct(quoted(key).alias("key")).alias("keep"), F.lit(1).cast("long").alias("n")))
        runs = [*self.runs, (0, entries)]
        level = 0
        while len(full := [r for k, r in runs if k == level]) >= FANOUT:
            merged = full[0]
            for r in full[1:]:
                merged = merged.unionByName(r)
            runs = [(k, r) for k, r in runs if k != level] + [(level + 1, compact(merged, self.largest))]
            level += 1
        return MergeIndex(self.largest, tuple(runs))

    def entries(self) -> DataFrame | None:
        """(digest, key, n) over all runs; None before the first batch."""
        if not self.runs:
            return None
        every = self.runs[0][1]
        for _, r in self.runs[1:]:
            every = every.unionByName(r)
        return every.groupBy("digest").agg(kept(self.largest).alias("keep"), F.sum("n").alias("n")).select("digest", F.col("keep.key").alias("key"), "n")

    def known(self, docs: DataFrame, older: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, known_key, n): the rows of a new batch whose text the index holds, verified by the bytes of `older`,
        the rows that were added. A filter over the batch's digests picks the entries of each run, so an index far
        larger than the batch is read but not shuffled."""
        norm = normal_text(quoted(text))
        batch = docs.select(quoted(key).alias("key"), norm.alias("norm"), F.unhex(F.sha2(norm, 256)).alias("digest"))
        asked = written(batch.select("digest").distinct(), "dedup-asked")
        found = None
        for _, run in self.runs:
            part = probe(run, asked).filter("maybe").drop("maybe")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return batch.select("key", F.col("key").alias("known_key"), F.lit(0).cast("long").alias("n")).limit(0)
        found = written(found.join(asked, "digest").groupBy("digest").agg(kept(self.largest).alias("keep"), F.sum("n").alias("n")), "dedup-known")
        old_digest = F.unhex(F.sha2(normal_text(quoted(text)), 256))
        old = probe(older.select(quoted(key).alias("known_key"), normal_text(quoted(text)).alias("old"), old_digest.alias("digest")), found.select("digest")).filter("maybe").drop("maybe")
        # The kept row's own text, once however often it is repeated.
        old = old.join(found, (old["digest"] == found["digest"]) & old["known_key"].eqNullSafe(found["keep.key"])).select(old["digest"], "known_key", "old", "n").dropDuplicates(["digest"])
        return batch.join(old, "digest").filter("norm = old").select("key", "known_key", "n")


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", digest_bits: int = 256
) -> DataFrame:
    """Per row of docs: key, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical after lower-casing A-Z; null counts as empty. The largest
    key of a group stays (keep="smallest": the smallest); null keys come last. Of repeated rows (same key,
    same text) exactly one is kept. Other columns are ignored. An empty table gives no rows. digest_bits under
    256 shortens the index key; whatever collides is told apart by the bytes.
    """
    largest = keep == "largest"
    src = docs.select(quoted(key).alias("key"), quoted(text).alias("text"))
    norm = normal_text(F.col("text"))
    entries = flush(
        src.select("key", F.monotonically_increasing_id().alias("row_no"), F.sha2(norm, 256).alias("sha")).select(
            "key", "row_no", "sha", F.unhex(F.substring("sha", 1, digest_bits // 4)).alias("digest")
        )
    )
    index = compact(entries.select("digest", F.struct("key", "row_no").alias("keep"), F.lit(1).cast("long").alias("n")), largest)

    hits = index.filter("n > 1").select("digest")
    probed = src.select(norm.alias("norm")).withColumn("digest", _digest(F.col("norm"), digest_bits))
    maybe = probe(probed, hits).filter("maybe")
    # All members of a group have the same bytes if and only if the least and the greatest text are equal.
    clash = written(
        maybe.groupBy("digest")
        .agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        .filter("lo != hi")
        .select("digest"),
        "dedup-clashes",
    )
    if clash.isEmpty():
        found = entries.join(index, "digest")
        return _verdict(found, "keep", "n", key)
    # Digests with different texts: these rows are grouped anew by their full SHA-256 and text.
    plain = _verdict(entries.join(index, "digest").join(clash, "digest", "left_anti"), "keep", "n", key)
    texts = written(
        src.select("key", norm.alias("norm"), F.sha2(norm, 256).alias("sha"))
        .withColumn("digest", F.unhex(F.substring("sha", 1, digest_bits // 4)))
        .join(clash, "digest", "left_semi")
        .withColumn("row_no", F.monotonically_increasing_id()),
        "dedup-clashing",
    )
    groups = texts.withColumn("keep", F.struct("key", "row_no")).groupBy("sha", "norm").agg(kept(largest).alias("keep"), F.count("*").alias("n"))
    return plain.unionByName(_verdict(texts.join(groups, ["sha", "norm"]), "keep", "n", key))


def _verdict(found: DataFrame, keep: str, n: str, key: str) -> DataFrame:
    return found.select(
        F.col("key").alias(key),
        F.col(f"{keep}.key").alias("keep_id"),
        F.col(n).cast("long").alias("group_size"),
        (F.col("row_no") == F.col(f"{keep}.row_no")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns whatever their names; of repeated rows one. Null texts count as
    empty ones, texts of any length are compared whole, and an empty table gives no rows.

    Only rows whose text may occur twice (by the bit filter) are shuffled.
    """
    verdict = written(exact_dedup(docs.select(quoted(key), quoted(text)), key, text, keep), "dedup-verdict")
    hits = verdict.filter("group_size > 1").select(F.unhex("text_sha256").alias("digest"))
    held = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"))
    in_row = lambda name: F.col("row").getField(name)
    held = held.withColumn("digest", F.unhex(F.sha2(normal_text(in_row(text)), 256)))
    probed = probe(held, hits)
    stays = verdict.filter("kept").select(quoted(key).alias("stay"), F.unhex("text_sha256").alias("stay_digest"))
    copies = probed.filter("maybe").withColumn("row_key", in_row(key))
    copies = copies.join(stays, (copies["digest"] == stays["stay_digest"]) & copies["row_key"].eqNullSafe(stays["stay"]), "left_semi").dropDuplicates(["digest", "row_key"])
    return probed.filter("not maybe").select("row.*").unionByName(copies.select("row.*"))


def query(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
