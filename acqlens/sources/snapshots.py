"""Point-in-time player table: features known at a cutoff, labels from strictly later days.

Facts are orders (by order day), line items (by ship day, or the order day where that is later)
and events.  The events run on a clock of their own (one month of 2024), so a player's events are
placed by their age: the first one falls on the install day, as in a telemetry stream.

Cutoffs per player: day 6 after install (features of the first week), day 89 (labels of retention
and value), the observation end (churn features) and 90 days later (churn label).  A label is the
difference of what is known at two cutoffs, and null where its last day lies beyond the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.functions import expressions as X
from acqlens.operators.asof import as_of
from acqlens.sources.fixtures import _literal_map
from acqlens.sources.tables import read_table

WEEK_DAYS, VALUE_DAYS, CHURN_DAYS = 7, 90, 90
MEASURES = ["n_orders", "order_days", "spend", "urgent", "n_items", "quantity", "kept", "ship_days", "n_events", "clicks", "event_value"]
COUNTS = ["n_orders", "order_days", "urgent", "n_items", "kept", "ship_days", "n_events", "clicks"]
CUTOFFS = ["week", "value", "churn", "later"]


def _fact(df: DataFrame, **measures) -> DataFrame:
    """(u, d, all measures): one row per player and day, 0 for the measures not given."""
    made = df.groupBy("u", "d").agg(*[v.alias(c) for c, v in measures.items()])
    return made.select("u", "d", *[(F.col(c) if c in measures else F.lit(0)).cast("long" if c in COUNTS else "double").alias(c) for c in MEASURES])


def player_days(orders: DataFrame, lineitem: DataFrame, events: DataFrame, first: DataFrame) -> DataFrame:
    """All facts per player and day; ``first`` holds (u, i), each player's first order day."""
    o = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"), F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderpriority")
    bought = _fact(o, n_orders=F.count("*"), order_days=F.lit(1), spend=F.sum("o_totalprice"), urgent=F.count_if(F.col("o_orderpriority") == "1-URGENT"))
    items = lineitem.select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("shipped"), "l_quantity", "l_returnflag").join(
        o.select("k", "u", F.col("d").alias("ordered")), "k")
    # an item is known once it is shipped and its order placed
    sent = _fact(items.withColumn("d", F.greatest("shipped", "ordered")), n_items=F.count("*"), quantity=F.sum("l_quantity"),
                 kept=F.count_if(F.col("l_returnflag") != "R"), ship_days=F.sum(F.datediff("shipped", "ordered")))
    e = events.select(F.col("user_id").alias("u"), F.to_date("ts").alias("day"), "event_type", "value").groupBy("u", "day").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.sum("value").alias("value"))
    begun = e.groupBy("u").agg(F.min("day").alias("begun"))  # a row per player, so no player's events meet in one row
    placed = e.join(begun, "u").join(first, "u").select("u", F.expr("date_add(i, datediff(day, begun))").alias("d"), "n", "clicks", "value")
    seen = _fact(placed, n_events=F.sum("n"), clicks=F.sum("clicks"), event_value=F.sum("value"))
    return bought.unionByName(sent).unionByName(seen)


def build(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, events: DataFrame) -> DataFrame:
    """One row per customer with an order: features at their cutoffs and later labels."""
    day = F.to_date("o_orderdate")
    first = orders.groupBy(F.col("o_custkey").alias("u")).agg(
        F.min(day).alias("i"), F.min_by(F.struct("o_orderstatus"), F.struct(day, "o_orderstatus")).alias("opening"))
    marks = first.select("u", F.explode(F.array(
        *[F.struct(F.lit(n).alias("name"), d.alias("d")) for n, d in zip(CUTOFFS, (
            F.date_add("i", WEEK_DAYS - 1), F.date_add("i", VALUE_DAYS - 1), F.lit(K.OBSERVATION_END).cast("date"),
            F.date_add(F.lit(K.OBSERVATION_END).cast("date"), CHURN_DAYS)))])).alias("c")).select("u", "c.name", "c.d")
    known = as_of(marks, player_days(orders, lineitem, events, first.select("u", "i")), "u", "d", MEASURES)
    wide = known.groupBy("u").agg(*[F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n}_{c}") for n in CUTOFFS for c in MEASURES])
    p = customer.join(first, customer.c_custkey == first.u).join(wide, "u")

    def col(name):
        return F.col(name)

    def ratio(of, whole):
        return F.try_divide(of, whole)

    last = F.lit(K.SNAPSHOT_DATE).cast("date")
    end = F.lit(K.OBSERVATION_END).cast("date")
    here = F.col("i") <= end  # players of the churn snapshot
    bal = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    out = p.select(
        F.col("c_custkey").alias("user_id"),
        F.col("i").alias("install_date"),
        _literal_map(K.SEGMENT_TO_CHANNEL)[F.col("c_mktsegment")].alias("acquisition_channel"),
        F.element_at(F.array(*[F.lit(c) for c in K.COUNTRIES]), (F.col("c_nationkey") % 7 + 1).cast("int")).alias("country"),
        F.when(F.col("opening.o_orderstatus") == "F", "iOS").otherwise("Android").alias("device_type"),
        (col("week_n_events") > 0).cast("int").alias("clan_member"),
        (col("week_urgent") > 0).cast("int").alias("pass_royale_active"),
        (bal / 2000.0).alias("cost_per_install"),
        (1 + F.least(col("week_n_orders") + col("week_n_items"), F.lit(13))).cast("int").alias("king_level"),
        F.floor(F.round(col("week_quantity") * 30 + col("week_event_value"), 6)).cast("int").alias("trophies_end_week1"),
        F.least(col("week_n_events") + col("week_n_items"), F.lit(60)).cast("int").alias("battles_week1"),
        ratio(col("week_kept") + col("week_clicks"), col("week_n_items") + col("week_n_events")).alias("win_rate_week1"),
        F.floor(col("week_quantity")).cast("int").alias("cards_upgraded_week1"),
        F.when(F.date_add("i", VALUE_DAYS - 1) <= last, (
            (col("value_n_orders") > col("week_n_orders")) | (col("value_n_events") > col("week_n_events"))).cast("int")).alias("retained_day7"),
        F.when(F.date_add("i", VALUE_DAYS - 1) <= last, (col("value_spend") - col("week_spend")) / 5000.0).alias("ltv_day90"),
        F.floor(F.round(col("churn_quantity") * 30 + col("churn_event_value"), 6)).cast("int").alias("trophies"),
        ratio(col("churn_kept") + col("churn_clicks"), col("churn_n_items") + col("churn_n_events")).alias("win_rate"),
        (col("churn_n_items") + col("churn_n_events")).cast("int").alias("matches_played"),
        col("churn_order_days").cast("int").alias("days_active"),
        (col("churn_urgent") > 0).cast("int").alias("pass_royale"),
        F.when(here, 30.0 * col("churn_n_orders") / (F.datediff(end, F.col("i")) + 1)).alias("avg_sessions_per_day"),
        ratio(col("churn_ship_days"), col("churn_n_items")).alias("avg_battle_duration"),
        (col("churn_spend") / 5000.0).alias("total_spend"),
        F.when(here, (col("later_n_orders") == col("churn_n_orders")).cast("int")).alias("churned"),
    )
    return out.withColumn("arena_id", X.trophies_to_arena("trophies_end_week1"))


def player_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(*(read_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "events")))
