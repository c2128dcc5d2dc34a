import datetime as dt

import pytest
from pyspark.sql import functions as F

from acqlens.operators import cohorts, kpis, models


def test_legacy_install_and_login_fallbacks(spark):
    base = spark.createDataFrame([(1, dt.date(2024, 1, 1), 10, 3, 1)],
                                 "user_id int, acquisition_date date, days_active int, days_since_last_login int, retained_day7 int")
    a = cohorts.with_activity_dates(base).first()
    assert a.install_date == dt.date(2024, 1, 1) and a.last_login_date == dt.date(2024, 1, 8)
    b = cohorts.with_activity_dates(base.drop("days_active")).first()
    assert b.last_login_date == dt.date(2024, 1, 15)  # retained -> 14 days
    c = cohorts.with_activity_dates(base.select("user_id", "acquisition_date")).first()
    assert c.last_login_date == dt.date(2024, 1, 4)  # default 3 days
    with pytest.raises(ValueError):
        cohorts.with_activity_dates(base.select("user_id"))


def test_retention_matrix_and_empty_average(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), dt.date(2024, 1, 1)), (dt.date(2024, 1, 2), dt.date(2024, 2, 20)),
         (dt.date(2024, 1, 3), dt.date(2024, 1, 11)), (dt.date(2024, 1, 8), dt.date(2024, 1, 9))],
        "install_date date, last_login_date date")
    m = {r.install_week: r for r in cohorts.retention_matrix(cohorts.cohort_frame(df)).collect()}
    w1 = m["2024-01-01/2024-01-07"]
    assert (w1.D1, w1.D7, w1.D30) == (66.7, 66.7, 33.3)
    empty = cohorts.retention_matrix(cohorts.cohort_frame(df.filter("false")))
    assert cohorts.average_retention(empty).first().asDict() == {"d1": 0.0, "d7": 0.0, "d30": 0.0}
    curve = [r.day_label for r in cohorts.retention_curve(empty).orderBy("position").collect()]
    assert curve == ["D1", "D7", "D30"]


def test_required_column_guard(spark, players_small):
    with pytest.raises(ValueError, match="days_active"):
        models.require_columns(players_small.drop("days_active"), ["days_active", "churned"], "churn")


def test_single_row_std_is_zero(spark):
    df = spark.createDataFrame([("TikTok", 1.5)], "acquisition_channel string, roas_90d double")
    assert kpis.channel_roas_stats(df).first().roas_std == 0.0


def test_null_channel_dropped(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0, dt.date(2024, 1, 1)), ("A", 2.0, 1.0, dt.date(2024, 1, 1))],
                               "acquisition_channel string, ltv_day90 double, cost_per_install double, acquisition_date date")
    assert [r.acquisition_channel for r in kpis.roas_trend(df).collect()] == ["A"]


def test_players_invariants(players_small):
    agg = players_small.agg(
        F.count("*").alias("n"), F.min("arena_id").alias("amin"), F.max("arena_id").alias("amax"),
        F.count_if(F.col("churned") != (F.col("days_since_last_login") >= 14).cast("int")).alias("bad_churn"),
        F.count_if(F.col("install_date") != F.col("acquisition_date")).alias("bad_alias"),
    ).first()
    assert agg.n > 0 and agg.amin >= 1 and agg.amax <= 15 and agg.bad_churn == 0 and agg.bad_alias == 0


def test_weighted_retention(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 9)), (dt.date(2024, 1, 8), dt.date(2024, 1, 8))],
                               "install_date date, last_login_date date")
    w = cohorts.weighted_retention(cohorts.cohort_frame(df)).first()
    assert (w.d1_weighted, w.d7_weighted, w.d30_weighted) == (50.0, 50.0, 0.0)


def test_preprocessor_codes_and_scales(spark):
    df = spark.range(50).selectExpr("cast(id % 12 as string) as k", "cast(id % 12 as int) as i", "cast(id as double) as x", "1.0D as same")
    pre = models.fit_preprocessor(df, ["k", "i"], ["x", "same"])
    codes = {(r["column"], r["value"]): r["code"] for r in pre.codes.collect()}
    assert codes == {**{("k", v): n for n, v in enumerate(sorted(str(i) for i in range(12)))}, **{("i", str(i)): i for i in range(12)}}
    rows = spark.createDataFrame([("10", 10, 24.5, 1.0), ("new", 99, None, 3.0), (None, None, 0.0, None)], "k string, i int, x double, same double")
    got = [tuple(r) for r in pre.transform(rows).select(*pre.output_names()).collect()]
    assert sorted(got, key=str) == sorted([(2, 10, 0.0, 0.0), (-1, -1, None, 2.0), (-1, -1, pytest.approx(-24.5 / pre.stds["x"]), None)], key=str)
    assert models.fit_preprocessor(df, [], []).output_names() == []


def test_preprocessor_of_many_categories(spark):
    """Far more categories than literals could hold; joined without a broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(300_000).selectExpr("format_string('%07d', id) as k", "id")
        pre = models.fit_preprocessor(df, ["k"], [])
        wrong = pre.transform(df.unionByName(spark.sql("select 'unknown' as k, -1L as id"))).where("cat_k <> id").count()
        assert wrong == 0 and pre.codes.count() == 300_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_purchasers_guard_and_model_loader(spark, players_small):
    from acqlens.session import scratch_path

    assert kpis.purchasers(players_small, require_nonempty=True).count() > 0
    with pytest.raises(ValueError, match="purchasers"):
        kpis.purchasers(players_small.withColumn("is_purchaser", F.lit(0)), require_nonempty=True)
    assert models.load_model(spark, scratch_path(spark, "no-model")) is None


@pytest.mark.parametrize("extra, value", [("", ()), (", arena_id int", (14,))])
def test_normalise_profiles(spark, extra, value):
    df = spark.createDataFrame([(1, True, False, 1250, 0.5, *value)],
                               "user_id long, clan_member boolean, pass_royale_active boolean, "
                               "trophies_end_week1 int, win_rate_week1 double" + extra)
    r = models.normalise_profiles(df).first()
    assert (r.clan_member, r.pass_royale_active, r.arena_id) == (1, 0, 5)
    assert (r.trophies, r.win_rate, r.pass_royale) == (1250, 0.5, 0)
