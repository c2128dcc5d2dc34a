"""The order-level stream against the batch aggregate."""

import random

import pytest
from pyspark.sql import functions as F

from acqlens.operators import kpis
from acqlens.session import scratch_path
from acqlens.sources import fixtures
from acqlens.sources.tables import read_table
from acqlens.streaming import orders_stream
from tests.conftest import SF_SMALL


def rows(df):
    return {(r.month, r.acquisition_channel): (pytest.approx(r.revenue, rel=1e-9), pytest.approx(r.spend, rel=1e-9)) for r in df.collect()}


def test_late_orders_and_restarts(spark):
    """Orders in files of any order, the stream stopped between them: the rows of A3."""
    customer, orders = read_table(spark, SF_SMALL, "customer").where("c_custkey < 60"), read_table(spark, SF_SMALL, "orders").where("o_custkey < 60")
    src, out, ckpt = (scratch_path(spark, f"test-orders-{x}") for x in ("in", "out", "ckpt"))
    parts = [orders.where(F.abs(F.hash("o_orderkey")) % 3 == k).coalesce(1) for k in range(3)]
    parts[0].write.parquet(src)
    parts[1].write.mode("append").parquet(src)
    first = orders_stream.refresh(spark, src, customer, out, ckpt, "3650 days", 1)
    so_far = kpis.roas_trend(fixtures.derive_player_columns(fixtures.players_base(customer, parts[0].unionByName(parts[1]))))
    assert rows(first) == rows(so_far)
    parts[2].write.mode("append").parquet(src)
    got = orders_stream.refresh(spark, src, customer, out, ckpt, "3650 days", 1)
    assert rows(got) == rows(kpis.roas_trend(fixtures.derive_player_columns(fixtures.players_base(customer, orders))))
    assert rows(orders_stream.refresh(spark, src, customer, out, ckpt, "3650 days")) == rows(got)  # nothing new


def test_closed_customers_keep_their_value(spark):
    """Orders in time order and a short watermark: the 90 days are closed and later orders change nothing."""
    src, out, ckpt = (scratch_path(spark, f"test-closed-{x}") for x in ("in", "out", "ckpt"))
    customer = read_table(spark, SF_SMALL, "customer").where("c_custkey < 20")
    orders = read_table(spark, SF_SMALL, "orders").where("o_custkey < 20")
    for year in range(1995, 2002, 2):
        orders.where(F.year("o_orderdate").isin(year, year + 1)).coalesce(1).write.mode("append").parquet(src)
        got = orders_stream.refresh(spark, src, customer, out, ckpt, "10 days")
    assert rows(got) == rows(kpis.roas_trend(fixtures.derive_player_columns(fixtures.players_base(customer, orders))))


def test_day_sums_against_all_orders():
    rng = random.Random(6)
    for _ in range(200):
        orders = [(rng.randrange(0, 300), rng.randrange(1, 100)) for _ in range(rng.randrange(1, 20))]
        known: dict[int, int] = {}
        while orders:
            batch, orders = orders[:3], orders[3:]
            new: dict[int, int] = {}
            for d, c in batch:
                new[d] = new.get(d, 0) + c
            seen = seen + batch if known else batch
            known = orders_stream.add_days(known, new)
            first = min(d for d, _ in seen)
            assert sum(known.values()) == sum(c for d, c in seen if d < first + 90) and min(known) == first
            assert len(known) <= 90


def test_a_customer_costs_three_calls():
    """Rows in, rows out, and one read, one write and one timer for a new customer."""
    from pyspark.sql import Row

    calls = []

    class Fake:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def registerTimer(self, at):
            calls.append("registerTimer")

    p = orders_stream.FirstDays()
    p.handle = p.state = Fake()
    got = list(p.handleInputRows((7,), iter([Row(d=3, cents=5), Row(d=1, cents=2)]), None))
    assert got == [Row(u=7, old_install=None, old_cents=None, install=1, cents=7)]
    assert calls == ["get", "registerTimer", "update"]
    assert list(p.handleInputRows((7,), iter([Row(d=2, cents=1)]), None)) == [Row(u=7, old_install=1, old_cents=7, install=1, cents=8)]
