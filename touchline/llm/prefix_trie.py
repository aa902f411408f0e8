"""The trie of conversation prefixes: one node for each distinct sequence of first turns.

Conversations become keys of fixed-width turn ids. Equal ones meet before any tree is built, and keys are dealt out by
range, so that a tree in a task holds neighbours; trees are built over bounded blocks of keys. What a block says of
a node adds up with what others say, so a first turn that a third of all conversations share is a few rows a task.
Sums over subtrees need the nodes of all blocks (childless nodes, and words once for each node), hence a second pass:
a key whose least conversation is the least of a node answers for that node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_fold, quoted, table, word_count, written
from .radix import WIDTH, turn_nodes

#: Bytes of keys (and as many again for each key's own cost) that one tree holds.
BLOCK, KEY_COST = 1 << 22, 64
ROWS = 20_000
#: Conversation ids that share all bits but these are joined into one string before they are hashed.
ID_BITS = 9

LONGS = ("hi", "lo", "parent_hi", "parent_lo", "depth", "words", "conv_id", "n_convs", "end_conv", "leaves", "each", "once")
NODES = T.StructType([T.StructField(n, T.LongType()) for n in LONGS])


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), turn id and words of each row. Turns that tie go by their ids; rows without a
    conversation are left out, as they have no id to be rebuilt by."""
    who, said = F.coalesce(quoted(role), F.lit("")), F.coalesce(quoted(text), F.lit(""))
    whole = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    digest = F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, WIDTH)
    rows = df.filter(quoted(conv).isNotNull()).select(quoted(conv).cast("long").alias("conv_id"), quoted(turn).alias("turn"), digest.alias("id"), word_count(said).alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id"))
    return rows.select("conv_id", place.alias("place"), "id", "words")


def sequences(rows: DataFrame, span: int = 20, folds: int = 4) -> DataFrame:
    """conv_id, ids and words of each rebuilt conversation: the first h turns of the conversation that begins its span
    of ids, then its own after its first h; h is crc32 of its decimal id modulo folds. A conversation is one row."""
    convs = rows.select("conv_id").distinct().withColumn("h", doc_fold(F.col("conv_id"), folds))
    base = F.col("conv_id") - F.col("conv_id") % span
    donors = rows.filter((F.col("conv_id") % span == 0) & (F.col("place") < folds)).withColumnRenamed("conv_id", "base")
    head = convs.withColumn("base", base).join(donors, "base").filter("place <= h").select("conv_id", F.lit(0).alias("part"), "place", "id", "words")
    own = rows.filter(F.col("place") > doc_fold(F.col("conv_id"), folds)).select("conv_id", F.lit(1).alias("part"), "place", "id", "words")
    none = convs.select("conv_id", F.lit(2).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("words"))
    turns = F.filter(F.sort_array(F.collect_list(F.struct("part", "place", "id", "words"))), lambda t: t["id"].isNotNull())
    return head.unionByName(own).unionByName(none).groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


def end_hashes(members: DataFrame) -> DataFrame:
    """whole, ends_sha256: SHA-256 of the ascending, comma-joined conversations of each group `whole`.

    Ids are joined in stretches first; a hash goes over its stretches in order, one at a time, so a group of any size
    takes little memory. The hash itself can't be split: a group is hashed by one task.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = members.groupBy("whole", F.shiftright("conv_id", ID_BITS).alias("stretch")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[str, str]] = []
            for whole, part in zip(b.column("whole").to_pylist(), b.column("ids"), strict=True):
                if whole != current:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = whole, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.as_py().encode())
            yield made(done)
        if current is not None:
            yield made([(current, state.hexdigest())])

    def made(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], pa.string()) for c in (0, 1)], names=["whole", "ends_sha256"])

    return parts.repartition("whole").sortWithinPartitions("whole", "stretch").mapInArrow(run, "whole string, ends_sha256 string")


def block_nodes(keys: DataFrame) -> DataFrame:
    """Rows of `turn_nodes` for blocks of keys (ids, words, conv_id, n_convs, childless, owned); they add up by hi, lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        cost = 0
        for b in batches:
            columns = [b.column(c) for c in ("ids", "words", "conv_id", "n_convs", "childless", "owned")]
            for i in range(b.num_rows):
                ids, *rest = (c[i].as_py() for c in columns)
                block.append((b"".join(ids), *rest))
                cost += len(block[-1][0]) + KEY_COST
                if cost >= BLOCK:
                    yield from batched(turn_nodes(*zip(*block, strict=True)))
                    block, cost = [], 0
        if block:
            yield from batched(turn_nodes(*zip(*block, strict=True)))

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                yield as_batch(held)
                held = []
        if held:
            yield as_batch(held)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(LONGS))

    return keys.select("ids", "words", "conv_id", "n_convs", "childless", "owned").repartitionByRange("ids").mapInArrow(run, NODES)


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = 20, folds: int = 4) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations, as the contract of op13 states them.

    Null roles and texts are empty, null turns come first, turns that tie go by their digest; rows without a conversation
    id are left out. Repeated rows are turns of their own, equal conversations are members of the same nodes, extra
    columns are ignored, texts of any length are hashed whole, an empty table has no nodes. The ids of one conversation
    are one row: 16 bytes a turn, up to 2 GB. Turns are told apart by 128 bits of SHA-256.
    """
    rows = written(numbered(df, conv, turn, role, text), "trie-turns")
    seqs = written(sequences(rows, span, folds).withColumn("whole", F.sha2(F.array_join(F.transform("ids", F.hex), ""), 256)), "trie-sequences")
    equal = seqs.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    ends = end_hashes(seqs.select("whole", "conv_id"))
    keys = written(equal.join(ends, "whole").join(seqs.select("conv_id", "ids", "words"), "conv_id"), "trie-keys")

    first = block_nodes(keys.withColumns({"childless": F.lit(False), "owned": F.lit(0).cast("long")}))
    same = ["parent_hi", "parent_lo", "depth", "words", "end_conv"]
    nodes = written(first.groupBy("hi", "lo").agg(*(F.max(c).alias(c) for c in same), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")), "trie-nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count("*").alias("n_children"))
    tall = nodes.join(kids, ["hi", "lo"], "left").fillna(0, ["n_children"])

    last = tall.filter("end_conv IS NOT NULL").select(F.col("end_conv").alias("conv_id"), (F.col("n_children") == 0).alias("childless"))
    owned = nodes.filter("depth > 0").groupBy("conv_id").agg(F.count("*").alias("owned"))
    marked = keys.join(last, "conv_id").join(owned, "conv_id", "left").fillna(0, ["owned"])
    below = block_nodes(marked).groupBy("hi", "lo").agg(F.sum("leaves").alias("n_leaves"), (F.sum("each") - F.sum("once")).alias("saved_tokens"))

    above = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"))
    ended = keys.select(F.col("conv_id").alias("end_conv"), "ends_sha256")
    out = tall.join(below, ["hi", "lo"]).join(ended, "end_conv", "left").join(above, ["parent_hi", "parent_lo"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def query(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id, turn,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM t
), steps AS (
  SELECT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS ops
  FROM (SELECT DISTINCT conv_id FROM r)
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, ops), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
  FROM steps
), parts AS (
  SELECT c.conv_id, 0 AS part, r.place, r.id, r.words FROM c JOIN r ON r.conv_id = c.base AND r.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, r.place, r.id, r.words FROM c JOIN r ON r.conv_id = c.conv_id AND r.place > c.h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, words,
         string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING) AS node FROM parts
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c
), e AS (
  SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM s
), n AS (
  SELECT node, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM e GROUP BY node
), k AS (
  SELECT left(node, 64 * (depth - 1)::INTEGER) AS node, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1
), m AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (node)
), up AS (
  SELECT left(node, 64 * d::INTEGER) AS node, sum((n_children = 0)::INTEGER) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT m.*, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1
)
SELECT m.conv_id, m.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       up.n_leaves::BIGINT AS n_leaves, up.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN up USING (node) LEFT JOIN n p ON m.depth > 0 AND p.node = left(m.node, 64 * (m.depth - 1)::INTEGER)
"""
