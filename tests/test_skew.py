"""One customer owns a third of all orders: results stay exact, no step collapses to one task."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest

from acqlens.operators import rfm
from acqlens.session import scratch_path
from acqlens.sources import fixtures

HOT = 7


@pytest.fixture(scope="module")
def skewed_dir(spark):
    rng = np.random.default_rng(3)
    n_other, n_hot = 4000, 2000
    cust = rng.integers(0, 60, n_other)
    cust = np.where(cust == HOT, HOT + 1, cust)
    custkeys = np.concatenate([cust, np.full(n_hot, HOT)])
    start = np.datetime64("1998-01-01")
    days = np.concatenate([rng.integers(0, 1200, n_other), rng.integers(0, 40, n_hot)])  # hot: many per day
    orders = pd.DataFrame({
        "o_orderkey": np.arange(len(custkeys), dtype=np.int64),
        "o_custkey": custkeys.astype(np.int64),
        "o_orderstatus": rng.choice(["F", "O", "P"], len(custkeys)),
        "o_totalprice": np.round(rng.uniform(1, 5000, len(custkeys)), 2),
        "o_orderdate": (start + days.astype("timedelta64[D]")).astype("datetime64[us]"),
        "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], len(custkeys)),
    })
    customer = pd.DataFrame({
        "c_custkey": np.arange(60, dtype=np.int64), "c_name": [f"c{i}" for i in range(60)],
        "c_nationkey": (np.arange(60) % 25).astype(np.int32), "c_acctbal": rng.uniform(-500, 9000, 60),
        "c_mktsegment": rng.choice(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], 60),
    })
    d = scratch_path(spark, "skew")
    spark.createDataFrame(orders).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(customer).write.parquet(f"{d}/customer.parquet")
    return d, orders


def test_players_exact_under_skew(spark, skewed_dir):
    d, orders = skewed_dir
    p = {r.user_id: r for r in fixtures.players(spark, d).collect()}
    o = orders.assign(d=orders.o_orderdate.dt.date)
    for u in (HOT, 3, 12):
        g = o[o.o_custkey == u]
        first = g.d.min()
        w = g[g.d <= first + dt.timedelta(days=89)]
        assert p[u].ltv_day90 == pytest.approx(w.o_totalprice.sum() / 5000.0, rel=1e-12)
        assert p[u].matches_played == 5 * len(g)
        assert p[u].days_active == g.d.nunique()
        assert p[u].win_rate_week1 == pytest.approx((w.o_orderstatus == "F").mean(), rel=1e-12)


def test_rfm_exact_under_skew(spark, skewed_dir):
    d, orders = skewed_dir
    t = fixtures.txns(spark, d)
    got = {r.user_id: r for r in rfm.rfm_summary(t, "2000-12-31").collect()}
    o = orders.assign(d=orders.o_orderdate.dt.date)
    o = o[o.d <= dt.date(2000, 12, 31)]  # the observation window
    days = o.groupby(["o_custkey", "d"]).o_totalprice.sum().reset_index()
    for u in (HOT, 5):
        g = days[days.o_custkey == u].sort_values("d")
        assert got[u].frequency == len(g) - 1
        assert got[u].monetary_value == pytest.approx(g.o_totalprice.iloc[1:].mean(), rel=1e-9)


def test_no_single_task_step_under_skew(spark, skewed_dir):
    d, _ = skewed_dir
    plan = fixtures.players(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert re.search(r"HashAggregate\(keys=\[u#\d+L?, d#\d+\], functions=\[partial_", plan)
