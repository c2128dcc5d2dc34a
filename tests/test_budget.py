import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.operators import budget
from acqlens.sources import dims

# The reference's worked example: budget 100,000, minimum 1,000 per channel, cap 40%.
EXAMPLE_ROAS = {"TikTok": 1.8, "YouTube": 3.2, "Instagram": 2.1, "Facebook": 2.4, "Google": 2.8}


def _stats(spark, roas, std=None):
    std = std or {c: 0.0 for c in roas}
    return spark.createDataFrame([(c, float(r), float(std[c])) for c, r in roas.items()],
                                 "acquisition_channel string, roas_mean double, roas_std double")


def _inputs(spark, rows, roas=EXAMPLE_ROAS, mins=None):
    return budget.scenario_inputs(dims.scenarios(spark, rows), _stats(spark, roas), dims.saturation_dim(spark),
                                  dims.min_spend_dim(spark, mins))


def _bisect(budget_, roas, sat, lo, hi):
    """Brute-force reference: bisection on the KKT multiplier."""
    r = np.maximum(np.array(roas), K.ROAS_FLOOR)
    x = lambda lam: np.clip(sat * (r / lam - 1), lo, hi)
    a, b = 1e-12, 1e6
    for _ in range(400):
        m = math.sqrt(a * b)
        if x(m).sum() > budget_:
            a = m
        else:
            b = m
    return x(math.sqrt(a * b))


def test_reference_example(spark):
    alloc = budget.budget_allocation(_inputs(spark, [(1, 100000.0, 0.40)]))
    rep = budget.allocation_report(alloc)
    tot = budget.allocation_totals(rep).first()
    assert tot["total_percentage"] > 99.0
    assert tot["total_expected_return"] > 100000.0
    got = {r["acquisition_channel"]: r["allocation"] for r in alloc.collect()}
    chans = list(EXAMPLE_ROAS)
    sat = np.array([K.CHANNEL_SATURATION[c] for c in chans])
    ref = _bisect(100000.0, [EXAMPLE_ROAS[c] for c in chans], sat, np.full(5, 1000.0), np.full(5, 40000.0))
    for c, v in zip(chans, ref):
        assert got[c] == pytest.approx(v, rel=1e-9, abs=1e-6)
    assert all(1000.0 - 1e-9 <= v <= 40000.0 + 1e-9 for v in got.values())


@pytest.mark.parametrize("b,share", [(30000.0, 0.6), (900000.0, 0.25), (50000.0, 0.2), (12345.0, 0.9)])
def test_matches_bisection(spark, b, share):
    alloc = budget.budget_allocation(_inputs(spark, [(1, b, share)])).collect()
    got = {r["acquisition_channel"]: r["allocation"] for r in alloc}
    chans = list(EXAMPLE_ROAS)
    sat = np.array([K.CHANNEL_SATURATION[c] for c in chans])
    ref = _bisect(b, [EXAMPLE_ROAS[c] for c in chans], sat, np.full(5, 1000.0), np.full(5, share * b))
    assert sum(got.values()) == pytest.approx(b, rel=1e-9)
    for c, v in zip(chans, ref):
        assert got[c] == pytest.approx(v, rel=1e-7, abs=1e-4)


def test_statuses(spark):
    rows = [(1, 100000.0, 0.4), (4, 50000.0, 0.2), (5, 4000.0, 0.4), (6, 50000.0, 0.1), (7, 0.0, 0.4),
            (8, 50000.0, 1.5), (9, 6000.0, 0.15), (10, 6000.0, 0.19)]
    v = {r["scenario_id"]: r["status"] for r in budget.scenario_validation(_inputs(spark, rows)).collect()}
    assert v == {1: "ok", 4: "ok", 5: "min_exceeds_budget", 6: "cap_below_budget", 7: "bad_budget",
                 8: "bad_share", 9: "min_exceeds_cap", 10: "cap_below_budget"}
    # every channel at its cap is a valid, exact solution
    alloc = budget.budget_allocation(_inputs(spark, [(4, 50000.0, 0.2)])).collect()
    assert all(r["allocation"] == pytest.approx(10000.0) for r in alloc)


def test_min_above_cap(spark):
    mins = {c: 0.0 for c in K.CHANNELS}
    mins["Google"] = 30000.0
    v = budget.scenario_validation(_inputs(spark, [(1, 50000.0, 0.5)], mins=mins)).first()
    assert v["status"] == "min_above_cap"


def test_monte_carlo_bands(spark):
    alloc = budget.budget_allocation(_inputs(spark, [(1, 100000.0, 0.40)]))
    sims = budget.simulate_returns(alloc, n_draws=500)
    bands = {r["acquisition_channel"]: r for r in budget.mc_bands(sims).collect()}
    assert set(bands) == set(K.CHANNELS) | {"TOTAL"}
    for r in bands.values():
        assert r["p10"] <= r["p50"] <= r["p90"] and r["std"] > 0
    # normals are keyed by (seed, draw, channel): identical on a different partitioning
    again = budget.mc_bands(budget.simulate_returns(alloc.repartition(7), n_draws=500))
    again = {r["acquisition_channel"]: r["p50"] for r in again.collect()}
    assert all(again[c] == pytest.approx(bands[c]["p50"], rel=1e-12) for c in bands)
    z = sims.agg(F.count("*").alias("n")).first()["n"]
    assert z == 500 * 5
    hist = budget.mc_histogram(sims).agg(F.sum("n").alias("n"), F.max("bin").alias("mb")).first()
    assert hist["n"] == 500 and hist["mb"] <= 39


def test_hash_normal_moments(spark):
    df = spark.range(20000).select(budget.hash_normal(42, F.col("id"), F.lit("x")).alias("z"))
    m = df.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(m["m"]) < 0.03 and abs(m["s"] - 1) < 0.03


@pytest.mark.parametrize("ranges", [None, 8])
def test_one_scenario_of_many_campaigns(spark, ranges):
    """200,000 campaigns of one scenario, next to a small one, against bisection."""
    n = 200_000
    roas = F.expr("0.2D + (id * 7919 % 10007) / 2500.0D")
    big = spark.range(n).select(F.lit(1).alias("scenario_id"), F.lit(5e8).alias("budget"), F.col("id").cast("string").alias("acquisition_channel"),
                                roas.alias("roas"), (1000.0 + F.col("id") * 31 % 977).alias("saturation"), (F.col("id") % 3 * 10.0).alias("min_spend"))
    small = big.where("id < 50").withColumns({"scenario_id": F.lit(2), "budget": F.lit(20_000.0)})
    inputs = big.unionByName(small).withColumns({
        "share": F.when(F.col("scenario_id") == 1, 2e-5).otherwise(0.05), "roas_std": F.lit(0.0), "roas_opt": F.col("roas")}).withColumn(
        "cap", F.col("share") * F.col("budget"))
    got = budget.budget_allocation(inputs, ranges).select("scenario_id", F.col("acquisition_channel").cast("int").alias("k"), "status", "allocation",
                                                          "roas", "saturation", "min_spend", "cap", "budget").toPandas()
    assert set(got.status) == {"ok"}
    for _, g in got.groupby("scenario_id"):
        want = _bisect(g.budget.iloc[0], g.roas.to_numpy(), g.saturation.to_numpy(), g.min_spend.to_numpy(), g.cap.to_numpy())
        assert np.allclose(g.allocation.to_numpy(), want, rtol=1e-7, atol=1e-6)
        assert g.allocation.sum() == pytest.approx(g.budget.iloc[0], rel=1e-9)
    if ranges:
        points = spark.read.parquet(sorted_paths(spark, "breakpoints")[-1])
        assert points.where("scenario_id = 1").select("range").distinct().count() > 4


def sorted_paths(spark, name):
    import glob
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sorted(glob.glob(f"{folder}/{name}-*"), key=os.path.getmtime)
