import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acqlens.operators import ranks


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "g": rng.choice(["a", "b", "c"], n),
        "v": np.round(rng.exponential(10, n), 1),  # many ties
        "y": rng.integers(0, 2, n),
    })
    pdf.loc[:900, "v"] = 0.0  # a hot value holding a third of the rows
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("buckets", [1, 5, 32])
def test_pct_rank_matches_pandas(data, buckets):
    pdf, df = data
    got = ranks.pct_rank(df, "v", "pr", n_buckets=buckets).toPandas().sort_values("id")
    exp = pdf["v"].rank(pct=True)
    assert np.allclose(got["pr"].to_numpy(), exp.to_numpy(), rtol=0, atol=1e-12)


def test_grouped_percentiles_match_numpy(data):
    pdf, df = data
    got = ranks.exact_percentiles(df, "v", [0.1, 0.5, 0.9], ["g"], n_buckets=7).toPandas()
    for (g, p), val in got.set_index(["g", "p"])["value"].items():
        assert val == pytest.approx(np.percentile(pdf.loc[pdf.g == g, "v"], p * 100), abs=1e-9)


def test_medians_wide(data):
    pdf, df = data
    got = ranks.exact_medians(df.withColumn("w", F.col("v") * 2), ["v", "w"], ["g"], n_buckets=4).toPandas()
    for _, row in got.iterrows():
        sub = pdf[pdf.g == row["g"]]
        assert row["v"] == pytest.approx(sub.v.median()) and row["w"] == pytest.approx(2 * sub.v.median())


def test_roc_auc_brute_force(data):
    pdf, df = data
    got = ranks.roc_auc(df, "y", "v", n_buckets=6).first()["roc_auc"]
    pos, neg = pdf.loc[pdf.y == 1, "v"].to_numpy(), pdf.loc[pdf.y == 0, "v"].to_numpy()
    cmp = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert got == pytest.approx(cmp / (len(pos) * len(neg)), abs=1e-12)


def test_holdout_split_exact_counts_and_partition_invariance(data):
    pdf, df = data
    a = ranks.holdout_split(df, "id", 0.2, 42, "y", n_buckets=8)
    counts = a.groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n")).collect()
    for r in counts:
        assert r["t"] == int(np.ceil(0.2 * r["n"]))
    b = ranks.holdout_split(df.repartition(13), "id", 0.2, 42, "y", n_buckets=3)
    sa = {r["id"] for r in a.filter("is_test").select("id").collect()}
    sb = {r["id"] for r in b.filter("is_test").select("id").collect()}
    assert sa == sb
