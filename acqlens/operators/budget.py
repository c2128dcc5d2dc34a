"""Budget allocation over a *table of scenarios*.

The reference solves one budget with a local solver and simulates it in a Python loop.  Here
every scenario row is solved and simulated on executors:

- the concave allocation is solved exactly from its KKT conditions: with multiplier
  ``lam`` each channel spends ``clip(sat * (roas / lam - 1), min, cap)``; the total is
  monotone in ``lam`` and piecewise ``A + C / lam`` between 2n breakpoints, so cumulative
  sums over the breakpoints sorted by ``lam`` (range-partitioned, so that one scenario may
  take many tasks) locate the active piece and give ``lam`` in closed form;
- Monte Carlo draws are rows (``explode(sequence(...))`` per scenario/channel); normals come
  from md5 of (seed, draw, channel) via Box-Muller, so results are identical on any
  partitioning and on any retry after an executor loss.

Scenario x channel rows are generated by exploding the configured channel list (a bounded
fan-out), then joined to the per-channel statistics on the channel key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acqlens import constants as K
from acqlens.functions import expressions as X
from acqlens.operators import kpis
from acqlens.session import scratch_path

STATUS_OK = "ok"


# --- O1 / J4 / J5 -----------------------------------------------------------------------
def scenario_inputs(
    scenarios: DataFrame,
    channel_stats: DataFrame,
    saturation: DataFrame,
    min_spend: DataFrame,
    channels: list[str] | None = None,
    default_saturation: float = K.DEFAULT_SATURATION,
) -> DataFrame:
    """One row per (scenario, channel) with clipped optimizer inputs and the unclipped ROAS.

    The channels are those observed in ``channel_stats``, or the given list.
    """
    stats = channel_stats.select("acquisition_channel", "roas_mean", "roas_std").filter(F.col("acquisition_channel").isNotNull())
    if channels:
        sc = scenarios.select("scenario_id", "budget", "share",
                              F.explode(F.array(*[F.lit(c) for c in channels])).alias("acquisition_channel"))
        sc = sc.join(stats, "acquisition_channel", "left")
    else:  # the scenarios travel as one array (a scalar subquery) and are exploded on every channel
        every = scenarios.agg(F.collect_list(F.struct("scenario_id", "budget", "share")).alias("every"))
        sc = (stats.withColumn("every", every.scalar())
              .select("acquisition_channel", "roas_mean", "roas_std", F.inline("every")))
    # dimension sides are keyed by channel
    j = (
        sc.join(F.broadcast(saturation), "acquisition_channel", "left")
        .join(F.broadcast(min_spend), "acquisition_channel", "left")
    )
    return j.select(
        "scenario_id", "budget", "share", "acquisition_channel",
        F.coalesce(F.col("roas_mean"), F.lit(0.0)).alias("roas"),
        F.coalesce(F.col("roas_std"), F.lit(0.0)).alias("roas_std"),
        F.greatest(F.coalesce(F.col("roas_mean"), F.lit(0.0)), F.lit(K.ROAS_FLOOR)).alias("roas_opt"),
        F.greatest(F.coalesce(F.col("saturation"), F.lit(default_saturation)), F.lit(K.SATURATION_FLOOR)).alias("saturation"),
        F.coalesce(F.col("min_spend"), F.lit(0.0)).alias("min_spend"),
        (F.col("share") * F.col("budget")).alias("cap"),
    )


# --- F8 ------------------------------------------------------------------------------------
def scenario_validation(inputs: DataFrame) -> DataFrame:
    """Per scenario: the reference's guards as a status label instead of an exception."""
    agg = inputs.groupBy("scenario_id", "budget", "share").agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.sum("min_spend").alias("min_total"),
        F.max("min_spend").alias("max_min"),
        F.first("cap").alias("cap"),
    )
    b, s = F.col("budget"), F.col("share")
    cap_total = F.col("n_channels") * F.col("cap")
    status = (
        F.when(b <= 0, "bad_budget")
        .when((s <= 0) | (s > 1), "bad_share")
        .when(F.col("min_total") > b, "min_exceeds_budget")
        .when(F.col("min_total") > cap_total + 1e-6, "min_exceeds_cap")
        .when(F.col("max_min") > F.col("cap"), "min_above_cap")
        .when(cap_total < b * (1 - 1e-12), "cap_below_budget")
        .otherwise(STATUS_OK)
    )
    return agg.select("scenario_id", "budget", "share", "n_channels", "min_total", "cap", status.alias("status"))


# --- O2 / W5 -------------------------------------------------------------------------------
def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _solve_lambda(inputs_ok: DataFrame, scenarios: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """(scenario_id, lam): the KKT multiplier of every feasible scenario.

    As lam falls, a channel leaves its minimum at one breakpoint and reaches its cap at another, and
    the total spend between two breakpoints is a + c / lam.  The breakpoints of all scenarios are
    range-partitioned together by (scenario, falling lam) and written once; totals per (scenario,
    range) become offsets, and running sums inside the ranges do the rest.  So a scenario may have
    any number of campaigns: it is spread over as many tasks as its share of the breakpoints.
    """
    r, s, lo, hi = F.col("roas_opt"), F.col("saturation"), F.col("min_spend"), F.col("cap")
    events = inputs_ok.select("scenario_id", F.explode(F.array(
        # at lam = roas / (1 + min/sat) the channel leaves its minimum
        F.struct((r / (1 + lo / s)).alias("lam"), (-lo - s).alias("da"), (s * r).alias("dc")),
        # at lam = roas / (1 + cap/sat) it reaches its cap
        F.struct((r / (1 + hi / s)).alias("lam"), (s + hi).alias("da"), (-s * r).alias("dc")),
    )).alias("e")).groupBy("scenario_id", "e.lam").agg(F.sum("e.da").alias("da"), F.sum("e.dc").alias("dc"))  # ties move together
    order = ["scenario_id", F.desc("lam")]
    ranged = events.repartitionByRange(n_ranges, *order) if n_ranges else events.repartitionByRange(*order)
    points = _stored(ranged.withColumn("range", F.spark_partition_id()), "breakpoints")  # the same ranges in every later stage

    before = Window.partitionBy("scenario_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = points.groupBy("scenario_id", "range").agg(F.sum("da").alias("sa"), F.sum("dc").alias("sc")).select(
        "scenario_id", "range", F.coalesce(F.sum("sa").over(before), F.lit(0.0)).alias("a1"), F.coalesce(F.sum("sc").over(before), F.lit(0.0)).alias("c1"))
    within = Window.partitionBy("scenario_id", "range").orderBy(F.desc("lam")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = points.select("scenario_id", "range", "lam", F.sum("da").over(within).alias("a2"), F.sum("dc").over(within).alias("c2"))
    totals = kpis.small_side(scenarios.select("scenario_id", "budget", F.col("min_total").alias("a0"), "c_scale"))
    cum = run.join(kpis.small_side(offsets), ["scenario_id", "range"]).join(totals, "scenario_id").select(
        "scenario_id", "budget", "c_scale", "lam", (F.col("a0") + F.col("a1") + F.col("a2")).alias("a"), (F.col("c1") + F.col("c2")).alias("c"))
    total_at = F.col("a") + F.col("c") / F.col("lam")
    piece = (
        cum.filter(total_at <= F.col("budget") * (1 + 1e-12))
        .groupBy("scenario_id")
        .agg(F.min_by(F.struct("a", "c", "lam", "budget", "c_scale"), F.col("lam")).alias("p"))
        .select("scenario_id", "p.*")
    )
    interior = F.col("c") > F.col("c_scale") * 1e-12
    return piece.select(
        "scenario_id",
        F.when(interior, F.col("c") / (F.col("budget") - F.col("a"))).otherwise(F.col("lam")).alias("lam"),
    )


def budget_allocation(inputs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Optimal spend per (scenario, channel); NULL allocation for infeasible scenarios.

    The inputs are written once, so that the steps don't compute them again; results per scenario
    are joined back as a broadcast below a checked number of rows.
    """
    inputs = _stored(inputs, "scenario-inputs")
    scale = inputs.groupBy("scenario_id").agg(F.sum(F.col("saturation") * F.col("roas_opt")).alias("c_scale"))
    scenarios = _stored(scenario_validation(inputs).join(scale, "scenario_id"), "scenarios")
    with_status = inputs.join(kpis.small_side(scenarios.select("scenario_id", "status")), "scenario_id")
    lam = _stored(_solve_lambda(with_status.filter(F.col("status") == STATUS_OK), scenarios, n_ranges), "multipliers")
    x = X.clip(
        F.col("saturation") * (F.col("roas_opt") / F.col("lam") - 1), F.col("min_spend"), F.col("cap")
    )
    return with_status.join(kpis.small_side(lam), "scenario_id", "left").withColumn(
        "allocation", F.when(F.col("status") == STATUS_OK, x)
    ).drop("lam")


# --- O3 / A17 ------------------------------------------------------------------------------
def allocation_report(allocation: DataFrame) -> DataFrame:
    """Percentages, expected return and marginal ROAS at the *unclipped* ROAS, scenario totals."""
    a = allocation.filter(F.col("status") == STATUS_OK)
    ret = X.channel_return("allocation", "roas", "saturation")
    rep = a.select(
        "scenario_id", "budget", "acquisition_channel", "allocation",
        (F.col("allocation") / F.col("budget") * 100.0).alias("percentage"),
        ret.alias("expected_return"),
        X.marginal_roas("allocation", "roas", "saturation").alias("marginal_roas"),
    )
    total = rep.groupBy("scenario_id").agg(F.sum("expected_return").alias("total_expected_return"))
    return rep.withColumns(
        {
            "share_pct_r1": F.bround("percentage", 1),
            "marginal_roas_r2": F.bround("marginal_roas", 2),
            "allocation_display": X.format_usd_k("allocation"),
        }
    ).join(kpis.small_side(total), "scenario_id")


def allocation_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("scenario_id", "budget").agg(
        F.sum("allocation").alias("total_allocation"),
        F.sum("percentage").alias("total_percentage"),
        F.sum("expected_return").alias("total_expected_return"),
    ).withColumn("return_over_budget", F.col("total_expected_return") / F.col("budget"))


# --- O4 / A18 / A19 ------------------------------------------------------------------------
def hash_normal(seed: int, draw: Column, key: Column) -> Column:
    """Standard normal from md5(seed|draw|key) by Box-Muller: the same value on every engine,
    partitioning and retry (Spark's ``randn`` depends on partition layout)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), key))
    scale = float(2 ** 52)
    u1 = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / scale
    u2 = (F.conv(F.substring(h, 14, 13), 16, 10).cast("double") + 0.5) / scale
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def simulate_returns(
    allocation: DataFrame,
    n_draws: int = K.MC_SIMULATIONS,
    seed: int = K.SEED,
    roas_cv: float = K.ROAS_CV,
) -> DataFrame:
    """(scenario_id, acquisition_channel, draw, ret): return under ROAS noise at fixed spend."""
    a = allocation.filter(F.col("status") == STATUS_OK)
    mean = F.greatest(F.col("roas"), F.lit(K.ROAS_FLOOR))
    std0 = F.when(F.col("roas_std") > 0, F.col("roas_std")).otherwise(mean * roas_cv)
    std = F.greatest(std0, mean * K.MIN_STD_FRACTION)
    rows = a.select(
        "scenario_id", "acquisition_channel", "allocation", "saturation",
        mean.alias("m"), std.alias("sd"),
        F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"),
    )
    sampled = F.greatest(
        F.col("m") + F.col("sd") * hash_normal(seed, F.col("draw"), F.col("acquisition_channel")),
        F.lit(K.ROAS_FLOOR),
    )
    return rows.select(
        "scenario_id", "acquisition_channel", "draw",
        X.channel_return("allocation", sampled, "saturation").alias("ret"),
    )


def _band_aggs(col: str) -> list[Column]:
    q = F.percentile(F.col(col), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return [
        q.alias("q"),
        F.avg(col).alias("mean"),
        F.stddev_pop(col).alias("std"),
    ]


def _unpack(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in ("q", "mean", "std")],
        F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "mean", "std",
    )


def simulated_totals(sims: DataFrame) -> DataFrame:
    return sims.groupBy("scenario_id", "draw").agg(F.sum("ret").alias("total"))


def mc_bands(sims: DataFrame) -> DataFrame:
    """P10/P50/P90 (exact, interpolated), mean and population std per channel and in total.

    A group here is one scenario's draws (n_draws rows, a parameter), so the exact
    percentile buffer is bounded regardless of how many scenarios or players there are.
    """
    per_channel = _unpack(sims.groupBy("scenario_id", "acquisition_channel").agg(*_band_aggs("ret")))
    total = _unpack(
        simulated_totals(sims).groupBy("scenario_id").agg(*_band_aggs("total"))
    ).withColumn("acquisition_channel", F.lit("TOTAL"))
    return per_channel.unionByName(total)


def mc_histogram(sims: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width histogram of simulated totals per scenario (last bin closed), with the
    scenario's P10 / P50 / P90 markers on every bin row (both keyed by scenario)."""
    t = simulated_totals(sims)
    stats = t.groupBy("scenario_id").agg(
        F.min("total").alias("lo"), F.max("total").alias("hi"),
        F.percentile(F.col("total"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("total") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = (
        t.join(stats.select("scenario_id", "lo", "hi"), "scenario_id")
        .groupBy("scenario_id", b.cast("int").alias("bin"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.join(stats.select("scenario_id", "q"), "scenario_id").select(
        "scenario_id", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "n",
        F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"),
    )


# --- O5 / P23 ------------------------------------------------------------------------------
def allocation_with_bands(report: DataFrame, bands: DataFrame) -> DataFrame:
    b = bands.filter(F.col("acquisition_channel") != "TOTAL").select(
        "scenario_id", "acquisition_channel", "p10", "p50", "p90")
    return report.join(b, ["scenario_id", "acquisition_channel"], "left").withColumns(
        {
            "error_plus": F.col("p90") - F.col("p50"),
            "error_minus": F.col("p50") - F.col("p10"),
            "return_p50_display": X.format_usd_k("p50"),
            "return_band_display": F.concat(X.format_usd_k("p10"), F.lit(" – "), X.format_usd_k("p90")),
        }
    )
