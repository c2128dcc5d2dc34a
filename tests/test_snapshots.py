"""As-of joins and the point-in-time player table."""

import datetime as dt
import random

from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.operators.asof import as_of
from acqlens.sources import snapshots
from acqlens.sources.tables import read_table
from tests.conftest import SF_SMALL

TABLES = ("customer", "orders", "lineitem", "events")


def test_as_of_against_brute_force(spark):
    rng = random.Random(2)
    facts = [(rng.choice([1, 2, 2, 2, 3, None]), rng.choice([*range(20), None]), rng.randrange(9), rng.choice([None, "a", "b", "c"])) for _ in range(400)]
    cutoffs = [(rng.choice([1, 2, 3, 4, None]), rng.choice([-1, *range(22), None]), f"m{i}") for i in range(60)] + [(2, 5, "m0")] * 2
    got = as_of(spark.createDataFrame(cutoffs, "k int, t int, name string"), spark.createDataFrame(facts, "k int, t int, x long, v string").repartition(5), "k", "t", ["x"], ["v"]).collect()
    want = []
    for k, t, name in cutoffs:
        mine = [] if None in (k, t) else sorted((f[1], f[3] or "", f[2]) for f in facts if f[0] == k and f[1] is not None and f[1] <= t)
        known = [v for _, v, _ in mine if v]
        want.append((k, t, name, sum(x for *_, x in mine), known[-1] if known else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "k int, t int, x long, v string")
    assert {r.x for r in as_of(spark.createDataFrame(cutoffs, "k int, t int, name string"), empty, "k", "t", ["x"], ["v"]).collect()} == {0}


def test_one_shuffle_and_no_pairs(spark):
    facts = spark.range(1000).selectExpr("id % 5 as k", "cast(id as int) as t", "id as x")
    plan = as_of(facts.select("k", "t"), facts, "k", "t", ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_features_know_nothing_of_later_days(spark):
    """All facts from a player's cutoff on are changed or dropped: no feature of that cutoff moves."""
    customer, orders, lineitem, events = (read_table(spark, SF_SMALL, t) for t in TABLES)
    first = orders.groupBy(F.col("o_custkey").alias("u")).agg(F.min(F.to_date("o_orderdate")).alias("i"))
    week = ["user_id", "install_date", *K.FEATURE_COLUMNS]
    whole = snapshots.build(customer, orders, lineitem, events)

    early = orders.join(first, orders.o_custkey == first.u).where("datediff(to_date(o_orderdate), i) < 7").select(orders["*"])
    shipped = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(first, F.col("o_custkey") == first.u)
    sent = shipped.where("datediff(to_date(l_shipdate), i) < 7").select(lineitem["*"])
    begun = events.groupBy(F.col("user_id").alias("x")).agg(F.min(F.to_date("ts")).alias("b"))
    seen = events.join(begun, events.user_id == begun.x).where("datediff(to_date(ts), b) < 7").select(events["*"])
    cut = snapshots.build(customer, early, sent, seen)
    assert sorted(map(str, whole.select(week).collect())) == sorted(map(str, cut.select(week).collect()))
    assert cut.agg(F.sum("retained_day7"), F.sum("ltv_day90")).first() == (0, 0.0)

    end = F.lit(K.OBSERVATION_END).cast("date")
    old = snapshots.build(customer, orders.where(F.to_date("o_orderdate") <= end), lineitem.where(F.to_date("l_shipdate") <= end), events)
    churn = ["user_id", *K.CHURN_FEATURE_COLUMNS]
    here = whole.where(F.col("install_date") <= end)
    assert sorted(map(str, here.select(churn).collect())) == sorted(map(str, old.select(churn).collect()))


def test_labels_beyond_the_data_are_unknown(spark):
    rows = snapshots.player_snapshots(spark, SF_SMALL)
    late = F.date_add("install_date", 89) > F.lit(K.SNAPSHOT_DATE).cast("date")
    assert rows.where(late & F.col("retained_day7").isNotNull()).count() == 0
    assert rows.where(~late & F.col("ltv_day90").isNull()).count() == 0
    assert rows.where((F.col("install_date") > F.lit(dt.date(2000, 12, 31))) != F.col("churned").isNull()).count() == 0
