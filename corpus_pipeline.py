"""A corpus pipeline: toxicity filter, exact and near deduplication, source mixing, segmentation.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that go on, each of
whose results is written as Parquet and read again as the next one's docs. Rows with null or empty texts pass the
toxicity filter, are copies of each other, and are linked with nothing; null sources are mixed as a source; repeated
rows are copies; empty tables give empty results; extra columns are dropped at the first stage. Texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import exact_dedup, mixing, near_dedup, segmentation, toxicity
from touchline.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.5 or more go; labels are learned outside the held-out fold."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.keep_distinct(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest doc_id stays."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a text: sources are drawn to their targets, up to three times."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with each text's sampled piece ids and whether they decode to it. Null and empty
    texts have no pieces."""
    coded = segmentation.encode(docs.select(*COLUMNS), decoded="decoded")
    return coded.withColumn("lossless", coded["decoded"].eqNullSafe(coded["text"]) | coded["text"].isNull()).drop("decoded")


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("sentencepiece", segmented),
]

#: The learned scores, the hashes and the sampling have no counterpart in SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
