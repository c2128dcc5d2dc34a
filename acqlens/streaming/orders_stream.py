"""ST1 from the orders themselves: the ROAS trend (A3) kept up to date while orders arrive.

A customer's install day is the first order day seen so far, and its value the orders of the 90
days from there, so an order that arrives late may move both.  Each customer has a state of its own
(``transformWithState``): the install day and the day sums of its 90 days, at most 90 numbers.  A
change is sent on as a retraction of what the customer counted for before and its new share.  The
state is kept on rows, as most customers have few orders and a data frame for each costs more.  Once
the watermark has passed the 90 days, no order can change them any more: a timer drops the day sums
and only marks the customer as closed.

Every micro-batch writes its changes per (month, channel) to a folder of its own, which a repeated
batch overwrites, so restarts count nothing twice.  All amounts are whole cents: sums are exact and
retractions leave no residue.  Orders are summed per (customer, day) before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from acqlens import constants as K
from acqlens.operators import kpis
from acqlens.session import ship
from acqlens.sources.fixtures import _literal_map

DAYS = 90
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDERS_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
_CHANGE = "u long, old_install int, old_cents long, install int, cents long"


def add_days(known: dict[int, int], new: dict[int, int]) -> dict[int, int]:
    """Day sums of the 90 days from the first day, after ``new`` sums have arrived."""
    days = dict(known)
    for d, cents in new.items():
        days[d] = days.get(d, 0) + cents
    last = min(days) + DAYS - 1
    return {d: c for d, c in days.items() if d <= last}


class FirstDays(StatefulProcessor):
    """State per customer: (days, cents) of the first 90 days, or closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("first_days", "days array<int>, cents array<bigint>, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known: dict[int, int] = {}
        held = self.state.get()  # None where there is none; each call is a round trip to the JVM
        if held is not None:
            days, cents, closed = held
            if closed:
                return
            known = dict(zip(days, cents))
        new: dict[int, int] = {}
        for r in rows:
            new[r.d] = new.get(r.d, 0) + r.cents
        if not new:
            return
        held = add_days(known, new)
        first, before = min(held), min(known) if known else None
        if before != first:
            if before is not None:
                self.handle.deleteTimer(_end(before))
            self.handle.registerTimer(_end(first))
        if held != known:
            self.state.update((list(held), list(held.values()), False))
            yield Row(u=key[0], old_install=before, old_cents=sum(known.values()) if known else None, install=first, cents=sum(held.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.update(([], [], True))
        return iter(())

    def close(self) -> None:
        pass


def _end(install: int) -> int:
    """Milliseconds at the end of the 90 days."""
    return (install + DAYS) * 86_400_000


def _by_day(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield p.groupby(["u", "ts"], as_index=False)["cents"].sum()


def customer_changes(orders_stream: DataFrame, lateness: str) -> DataFrame:
    """Changes of each customer's install day and 90-day value, from a stream of orders.

    Orders without a customer, a date or an amount are left out; those later than ``lateness``
    behind the newest one may be dropped.
    """
    ship(orders_stream.sparkSession)
    facts = orders_stream.select(F.col("o_custkey").alias("u"), F.date_trunc("day", "o_orderdate").alias("ts"),
                                 F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")).dropna()
    days = facts.mapInPandas(_by_day, "u long, ts timestamp, cents long").withWatermark("ts", lateness)
    return days.withColumn("d", F.unix_date(F.to_date("ts"))).groupBy("u").transformWithState(
        statefulProcessor=FirstDays(), outputStructType=_CHANGE, outputMode="Update", timeMode="EventTime")


def _cells(changes: DataFrame, customer: DataFrame) -> DataFrame:
    """Retractions and additions per (month, channel)."""
    who = customer.select(F.col("c_custkey").alias("u"), _literal_map(K.SEGMENT_TO_CHANNEL)[F.col("c_mktsegment")].alias("acquisition_channel"),
                          F.round(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100).cast("long").alias("balance"))
    side = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("old_install").alias("i"), F.col("old_cents").alias("c")),
                             F.struct(F.lit(1).alias("sign"), F.col("install").alias("i"), F.col("cents").alias("c"))))
    both = changes.join(who, "u").select("acquisition_channel", "balance", side.alias("x")).where("x.i is not null and acquisition_channel is not null")
    month = F.date_format(F.date_from_unix_date("x.i"), "yyyy-MM")
    return both.groupBy(month.alias("month"), "acquisition_channel").agg(
        F.sum("x.sign").alias("players"), F.sum(F.col("x.sign") * F.col("x.c")).alias("cents"), F.sum(F.col("x.sign") * F.col("balance")).alias("balance"))


def refresh(spark: SparkSession, orders_dir: str, customer: DataFrame, output_dir: str, checkpoint_dir: str,
            lateness: str = "120 days", max_files_per_trigger: int | None = None) -> DataFrame:
    """Process the order files that have arrived and return the trend; call it again for new ones.
    ``orders_dir`` is a folder of files or one file."""
    reader = spark.readStream.schema(ORDERS_SCHEMA)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(orders_dir)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        reader, orders_dir = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        _cells(batch, customer).write.mode("overwrite").parquet(f"{output_dir}/epoch={epoch}")

    held = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the store that transformWithState needs
    try:
        query = (customer_changes(reader.parquet(orders_dir), lateness).writeStream.outputMode("update")
                 .option("checkpointLocation", checkpoint_dir).foreachBatch(write_batch).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, held) if held else spark.conf.unset(_PROVIDER)
    return trend(spark.read.schema("month string, acquisition_channel string, players long, cents long, balance long, epoch long").parquet(output_dir))


def trend(cells: DataFrame) -> DataFrame:
    """(month, acquisition_channel, revenue, spend, roas) from all batches' changes."""
    total = cells.groupBy("month", "acquisition_channel").agg(*[F.sum(c).alias(c) for c in ("players", "cents", "balance")]).where("players > 0")
    return total.select("month", "acquisition_channel", (F.col("cents") / 500_000.0).alias("revenue"), (F.col("balance") / 200_000.0).alias("spend")).withColumn(
        "roas", kpis.X.safe_ratio("revenue", "spend"))
