"""Histogram boosting against plain restatements and against MLlib's trees."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from acqlens.operators import boosting, models, ranks
from acqlens.operators.boosting import BoostParams
from acqlens.session import scratch_path

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(size=(n, 4))
    x[:, 2] = rng.integers(0, 3, n)
    logit = 2 * np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] == 1) - 0.5
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(float)
    t = 3 * np.sin(x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=n) / 2
    data = [(i, *map(float, x[i]), float(y[i]), float(t[i]), bool(i % 5 == 0)) for i in range(n)]
    return spark.createDataFrame(data, "user_id long, a double, b double, c double, d double, y double, t double, is_test boolean").repartition(4).cache()


def table(model):
    return [(t.feature.tolist(), t.code.tolist(), np.round(t.value, 9).tolist()) for t in model.trees]


def test_as_good_as_mllib(rows):
    train, test = rows.where("not is_test"), rows.where("is_test")
    mine = boosting.fit(train, FEATURES, "y", BoostParams(trees=25, depth=4))
    auc = ranks.roc_auc(test.withColumn("s", mine.margin(*FEATURES)), "y", "s").first()["roc_auc"]
    to_vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    theirs = GBTClassifier(labelCol="y", maxIter=25, maxDepth=4, stepSize=0.1, seed=42).fit(to_vector.transform(train))
    scored = theirs.transform(to_vector.transform(test)).withColumn("s", vector_to_array("probability")[1])
    want = ranks.roc_auc(scored.select("y", "s"), "y", "s").first()["roc_auc"]
    assert auc > want - 0.01 and auc > 0.8


def test_regression_learns(rows):
    train, test = rows.where("not is_test"), rows.where("is_test")
    model = boosting.fit(train, FEATURES, "t", BoostParams(kind="regressor", trees=40, depth=4, step=0.2))
    r2 = models.regression_metrics(test.withColumn("p", model.margin(*FEATURES)), "t", "p").first()["r2"]
    assert r2 > 0.9
    share = dict(model.importances())
    assert sum(share.values()) == pytest.approx(1) and share["a"] > share["d"] and share["b"] > share["c"]


def test_against_plain_boosting(spark):
    """Few distinct values, so that every value is a bin: the exact greedy trees are known."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, size=(300, 2)).astype(float)
    y = (rng.random(300) < 0.2 + 0.1 * x[:, 0] * (x[:, 1] > 2)).astype(float)
    p = BoostParams(trees=4, depth=2, step=0.3)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double").repartition(3)
    model = boosting.fit(df, ["a", "b"], "y", p)

    base = math.log(y.mean() / (1 - y.mean()))
    margin = np.full(300, base)

    def grow(at, g, h, depth):
        value = -p.step * g[at].sum() / (h[at].sum() + p.l2)
        best = (1e-9, None)
        if depth < p.depth:
            whole = g[at].sum() ** 2 / (h[at].sum() + p.l2)
            for f in range(2):
                for cut in range(6):
                    left, right = at & (x[:, f] <= cut), at & (x[:, f] > cut)
                    if h[left].sum() >= 1 and h[right].sum() >= 1:
                        gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - whole
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
        if best[1] is None:
            out = np.zeros(300)
            out[at] = value
            return out
        return sum(grow(side, g, h, depth + 1) for side in best[1])

    for _ in range(p.trees):
        q = 1 / (1 + np.exp(-margin))
        margin = margin + grow(np.ones(300, dtype=bool), q - y, q * (1 - q), 0)
    got = {(r.a, r.b): r.m for r in df.select("a", "b", model.margin("a", "b").alias("m")).collect()}
    for r, m in zip(x, margin):
        assert got[tuple(r)] == pytest.approx(m, abs=1e-9)


def test_margins_brought_up_to_date_change_nothing(rows):
    small = rows.limit(600).repartition(2).cache()
    grown = [table(boosting.fit(small, FEATURES, "y", BoostParams(trees=6, depth=3, refresh=r))) for r in (1, 4, 50)]
    assert grown[0] == grown[1] == grown[2]


def test_bad_guesses_cost_jobs_only(rows, monkeypatch):
    """Trees guessed from a few rows, or from all, are the same trees."""
    small = rows.limit(800).repartition(3).cache()
    jobs, summed = [], boosting._summed
    monkeypatch.setattr(boosting, "_summed", lambda parts: (jobs.append(1), summed(parts))[1])
    grown = []
    for n in (20, 100, 10_000):
        grown.append(table(boosting.fit(small, FEATURES, "y", BoostParams(trees=4, depth=4, guess_rows=n))))
        assert len(jobs) <= 16
        if n > 800:
            assert len(jobs) <= 8
        jobs.clear()
    assert grown[0] == grown[1] == grown[2]


def test_sums_of_many_partitions(rows, monkeypatch):
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    small = rows.limit(600).repartition(5).cache()
    p = BoostParams(trees=2, depth=3)
    many = table(boosting.fit(small, FEATURES, "y", p))
    monkeypatch.undo()
    assert many == table(boosting.fit(small, FEATURES, "y", p))


def test_weights_count_like_copies(rows):
    small = rows.limit(300).withColumn("w", F.when(F.col("y") == 1, 3.0).otherwise(1.0)).cache()
    copies = small.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    p = BoostParams(trees=3, depth=3, bins=256)
    assert table(boosting.fit(small, FEATURES, "y", p, "w")) == table(boosting.fit(copies, FEATURES, "y", p))


def test_missing_values_empty_tables_and_storage(spark, rows):
    some = rows.limit(500).selectExpr("if(user_id % 3 = 0, null, a) as a", "if(user_id % 4 = 0, double('NaN'), b) as b", "y", "user_id").cache()
    model = boosting.fit(some, ["a", "b"], "y", BoostParams(trees=3, depth=3))
    path = scratch_path(spark, "test-trees")
    model.save(spark, path)
    again = boosting.BoostedTrees.load(spark, path)
    assert table(again) == table(model) and again.features == ["a", "b"]
    scored = some.select(model.margin("a", "b").alias("m"), again.margin("a", "b").alias("n"))
    assert scored.where("m <> n or isnan(m)").count() == 0
    nothing = boosting.fit(some.where("y > 5"), ["a", "b"], "y")
    assert nothing.trees == [] and some.select(nothing.margin("a", "b").alias("m")).where("m <> 0").count() == 0
    one = boosting.fit(some.withColumn("y", F.lit(1.0)), ["a", "b"], "y", BoostParams(trees=2))
    assert all((t.feature < 0).all() for t in one.trees)


def test_best_split_is_the_largest_gain():
    rng = np.random.default_rng(0)
    sums = rng.normal(size=(3, 2, 5, 2))
    sums[..., 1] = np.abs(sums[..., 1]) + 1
    sums[:, 1] *= sums[:, :1].sum(axis=2) / sums[:, 1:].sum(axis=2)  # each feature has the node's totals
    sums[..., 1] = np.abs(sums[..., 1])
    p = BoostParams(min_child_weight=0.0)
    found = boosting.best_splits(sums, p)
    for n in range(3):
        gains = {}
        for f in range(2):
            for c in range(4):
                s = [sums[n, f, : c + 1].sum(axis=0), sums[n, f, c + 1 :].sum(axis=0), sums[n, f].sum(axis=0)]
                a, b, t = (v[0] ** 2 / (v[1] + 1) for v in s)
                gains[f, c] = a + b - t
        best = max(gains, key=gains.get)
        assert (found["feature"][n], found["code"][n]) == best


def test_the_driver_gets_splits_not_sums(rows, monkeypatch):
    """What a job sends to the driver doesn't grow with its partitions, nor with the bins."""
    import pickle

    from pyspark import RDD

    sizes, collect = [], RDD.collect

    def weighed(rdd):
        got = collect(rdd)
        sizes.append(len(pickle.dumps(got)))
        return got

    monkeypatch.setattr(RDD, "collect", weighed)
    monkeypatch.setattr(boosting, "FILE_ROWS", 100)
    boosting.fit(rows.limit(600).repartition(6), FEATURES, "y", BoostParams(trees=3, depth=4, guess_rows=1))
    assert len(sizes) > 3 and max(sizes) < 10_000


def test_levels_guessed_wrongly_are_guessed_no_more(rows, monkeypatch):
    calls, node_sums = [], boosting._node_sums
    monkeypatch.setattr(boosting, "_node_sums", lambda *a: (calls.append(1), node_sums(*a))[1])
    small = rows.limit(800).withColumn("y", (F.rand(1) > 0.5).cast("double")).repartition(2).cache()
    p = BoostParams(trees=30, depth=3, guess_rows=20)
    model = boosting.fit(small, FEATURES, "y", p)
    assert len(model.trees) == 30 and len(calls) < 90  # one per level and tree, or more, where all are guessed
