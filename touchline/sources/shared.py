"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may go without it and gets a fresh temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("touchline.tables.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-touchline-")
        spark.conf.set("touchline.tables.dir", base)
    return base.rstrip("/")


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled and never broadcast.

    Spark takes the size of a table from its compressed files and counts nothing for what explode adds, so it would
    gather millions of rows on the driver.
    """
    return df.hint("merge")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: the rows of df as a Parquet table in the shared folder.

    What several branches read is computed once, and survives the loss of an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
