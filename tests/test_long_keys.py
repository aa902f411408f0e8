"""One key with very many rows: what is still to come is looked up in one pass."""

import time

from pyspark.sql import functions as F

from touchline.operators import situations
from touchline.operators import timeseries as ts

N = 200_000


def test_one_long_key(spark):
    """Seen at the first and the last row only, and every tenth row from the middle on."""
    n = F.col("id")
    seen = (n == 0) | (n == N - 1) | ((n > N / 2) & (n % 10 == 0))
    rows = spark.range(N).select(F.lit("k").alias("k"), (n * 1.0).alias("t"), F.when(seen, n * 2.0).alias("x"), F.when(seen, F.lit(1.0)).alias("c"), (n == 5).alias("asks"), (n >= N - 20).alias("plays"))
    start = time.time()
    g = ts.gaps(rows, ["k"], "t", "t", F.col("x").isNotNull()).agg(F.count("*").alias("n"), F.max("duration").alias("most")).first()
    assert (g["n"], g["most"]) == (N // 20, N / 2 + 10)
    filled = ts.interpolate(rows, ["k"], "t", "t", ["x"], N, "c").agg(F.count("x").alias("n"), F.max(F.abs(F.col("x") - 2 * F.col("t"))).alias("off")).first()
    assert filled["n"] == N and filled["off"] < 1e-6
    (r,) = situations.resumptions(rows, ["k"], "t", F.col("asks"), F.col("plays"), 5, 1e9).collect()
    assert r["resumed_t"] == N - 20
    assert time.time() - start < 60
