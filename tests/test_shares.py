"""Shares per source file, and sketches that merge."""

import pytest
from pyspark.sql import functions as F

from acqlens.operators import kpis, sketches
from acqlens.schemas import PLAYERS_SCHEMA
from acqlens.session import scratch_path
from acqlens.sources import shares


def by_channel(rows, version):
    return rows.groupBy(*version, "acquisition_channel").agg(F.sum("ltv_day90").alias("revenue"), F.count("*").alias("n"))


def total(table):
    return {r.acquisition_channel: (pytest.approx(r.revenue), r.n) for r in table.groupBy("acquisition_channel").agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("n")).collect()}


def test_a_new_or_changed_file_is_read_alone(spark, players_small):
    name, src = "test-" + scratch_path(spark, "x").rsplit("-", 1)[1], scratch_path(spark, "test-shares")
    p = spark.createDataFrame(players_small.collect(), PLAYERS_SCHEMA)

    def want():
        return total(by_channel(spark.read.schema(PLAYERS_SCHEMA).parquet(src), []))

    for k in range(3):
        p.where(f"user_id % 3 = {k}").coalesce(1).write.mode("append").parquet(src)
        table, read = shares.maintained(spark, name, src, PLAYERS_SCHEMA, by_channel)
        assert len(read) == 1 and total(table) == want()
    table, read = shares.maintained(spark, name, src, PLAYERS_SCHEMA, by_channel)
    assert read == [] and total(table) == want()

    path = sorted(shares.file_versions(spark, src))[0]  # one file gives way to another
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    other = scratch_path(spark, "test-shares-other")
    p.where("user_id % 3 = 0").limit(5).coalesce(1).write.parquet(other)
    new = next(iter(shares.file_versions(spark, other)))
    fs.delete(hadoop, False)
    fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new), hadoop)
    table, read = shares.maintained(spark, name, src, PLAYERS_SCHEMA, by_channel)
    assert read == [path] and total(table) == want()
    assert "PartitionFilters: [version" in table._jdf.queryExecution().executedPlan().toString()


def test_shares_of_nothing(spark):
    src = scratch_path(spark, "test-no-shares")
    spark.createDataFrame([], PLAYERS_SCHEMA).write.parquet(src)
    table, _ = shares.maintained(spark, "test-none-" + src[-6:], src, PLAYERS_SCHEMA, by_channel)
    assert table.collect() == [] and set(table.columns) == {"version", "acquisition_channel", "revenue", "n"}


@pytest.mark.parametrize("k", sorted(sketches.RANK_ERROR))
def test_merged_sketches_keep_their_rank_error(spark, k):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 90).alias("day"), F.exp(F.rand(5) * 4).alias("x"), F.when(F.col("id") % 5 > 0, F.rand(6)).alias("y")).cache()
    daily = sketches.sketch(df, ["g", "day"], ["x", "y"], k)
    for q in (0.5, 0.9):
        for r in sketches.quantiles(daily, ["g"], ["x", "y"], q, k).collect():
            for v in ("x", "y"):
                below = df.where((F.col("g") == r.g) & F.col(v).isNotNull()).agg(F.avg((F.col(v) <= r[v]).cast("double"))).first()[0]
                assert abs(below - q) <= 2 * sketches.RANK_ERROR[k] + 1e-3  # the bound holds in 99 of 100 cases


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", d, float(v)) for d, v in enumerate((5, 1, 9, 3, 7))] + [("b", 0, 2.0), ("c", 0, None)], "g string, d int, x double")
    got = {r.g: r.x for r in sketches.quantiles(sketches.sketch(df, ["g", "d"], ["x"]), ["g"], ["x"]).collect()}
    assert got["a"] == 5.0 and got["b"] == 2.0 and got["c"] is None
