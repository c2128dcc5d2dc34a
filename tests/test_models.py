"""Boosted-tree pipelines with few trees: train, save, load, score, gates."""

import pytest
from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.operators import models, ranks
from acqlens.session import scratch_path
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def fitted(spark, players_small):
    return {s.name: models.train_model(players_small, s, maxIter=3, maxDepth=3) for s in (models.RETENTION, models.LTV, models.CHURN)}


def test_save_load_scores_alike(spark, fitted):
    for name, (model, test) in fitted.items():
        path = scratch_path(spark, f"test-model-{name}")
        models.save_model(model, path)
        again = models.load_model(spark, path)
        a = {r.user_id: r.prediction for r in model.transform(test).select("user_id", "prediction").collect()}
        b = {r.user_id: r.prediction for r in again.transform(test).select("user_id", "prediction").collect()}
        assert a == b and len(a) > 0


def test_importances_and_scores(spark, fitted, players_small):
    imp = models.feature_importances(fitted["churn"][0], spark).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1.0) and len(imp) == len(K.CHURN_FEATURE_COLUMNS)
    scored = models.score_players(players_small, *(fitted[n][0] for n in ("retention", "ltv", "churn"))).cache()
    assert scored.count() == players_small.count()
    r = scored.agg(F.min("retention_probability"), F.max("retention_probability"), F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0 <= min(r) and max(r) <= 1
    assert {x.churn_risk for x in scored.select("churn_risk").distinct().collect()} <= {"Low", "Medium", "High"}
    sanity = models.prediction_sanity(scored).first()
    assert sanity.negative_predictions == scored.where("ltv_estimate < 0").count()


def test_gates_of_fitted_models(fitted):
    ret, ret_test = fitted["retention"]
    ltv, ltv_test = fitted["ltv"]
    auc = ranks.roc_auc(models.positive_probability(ret.transform(ret_test)), "retained_day7", "p")
    rows = {r.gate: r for r in models.quality_gates(auc, models.regression_metrics(ltv.transform(ltv_test), "ltv_day90", "prediction")).collect()}
    assert set(rows) == {"roc_auc", "r2", "negative_predictions"}
    assert rows["roc_auc"].passed == (rows["roc_auc"].value >= K.AUC_GATE)


def test_metrics_reach_the_history(spark, fitted):
    from acqlens.sources import tables

    path = scratch_path(spark, "test-model-metrics")
    for spec in (models.RETENTION, models.CHURN):
        tables.save_metrics(models.evaluate_classifier(*fitted[spec.name], spec), path)
    assert {r.model for r in tables.load_metrics(spark, path).collect()} == {"retention", "churn"}


def test_split_of_null_labels_and_ties(spark):
    df = spark.range(300).selectExpr("id as user_id", "case when id % 3 = 0 then null else cast(id % 3 as int) end as y")
    got = {(r.y, r.is_test): r["count"] for r in ranks.holdout_split(df, "user_id", 0.2, 42, "y").groupBy("y", "is_test").count().collect()}
    assert got == {(y, t): n for y in (None, 1, 2) for t, n in ((True, 20), (False, 80))}
    counts = {r.y: r.n for r in ranks.train_counts(df, 0.2, "y").collect()}
    assert counts == {None: 80, 1: 80, 2: 80}


def test_no_row_shuffle_without_static_broadcast(spark, players_small):
    from acqlens.operators import kpis  # noqa: F401

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = models.channel_baseline(players_small.select("acquisition_channel", "ltv_day90"))
        split = ranks.holdout_split(players_small.select("user_id", "retained_day7"), "user_id", 0.2, 42, "retained_day7")
        for df in (joined, split):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_fits_run_side_by_side(spark):
    from threading import Barrier

    from acqlens.plans import catalog

    both = Barrier(2)
    assert catalog._side_by_side(spark, SF_SMALL, *[lambda k=k: (both.wait(60), k)[1] for k in range(2)]) == [0, 1]
