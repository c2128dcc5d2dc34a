"""SURVEY §5 (4): a query gives the same rows at 1 and at 16 shuffle partitions."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import _norm

SF = "/root/testdata/sf0.001"
KEYS = ["roas_trend", "retention_matrix", "channel_rfm", "ltv_pct_rank", "holdout_split", "roc_auc",
        "budget_allocation", "mc_bands", "customer_clv", "txn_profile"]


def _rows(spark, name, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    df = E.queries()[name](spark, SF)
    return sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", KEYS)
def test_same_rows_at_1_and_16_partitions(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        a = _rows(spark, name, 1)
        b = _rows(spark, name, 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
