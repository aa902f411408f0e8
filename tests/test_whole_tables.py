"""Queries that take all rows of their tables."""

from pathlib import Path

import pytest

from touchline.plans import domain_queries as dq
from touchline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_every_order_is_labelled_and_every_line_is_a_candidate(spark):
    labels, cands = dq.labels_and_candidates(spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert labels.count() == orders
    assert cands.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for name in ("orders_detection_sweep_whole", "orders_detection_any_whole"):
        rows = QUERIES[name](spark, SF).collect()
        assert {sum(r["n_labelled"] for r in rows if r["floor"] == f) for f in (0.05, 0.3, 0.6)} == {orders}
