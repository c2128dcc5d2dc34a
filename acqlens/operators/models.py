"""Model operators: preprocessing, boosted trees, scoring, metrics.

Design:

- The mixed preprocessor gives ordinal codes to categories and standardises numbers.  Codes are a
  table (column, value, code), ranked like any other values, so a column may have any number of
  categories; it is joined where codes are needed, and Spark broadcasts it only below its own
  limit.  Values not seen in training, and nulls, get -1.
- The trees are grown by :mod:`acqlens.operators.boosting`; a fitted model is its preprocessor and
  its trees, and saves and loads as Parquet.
- Class weighting (negatives / positives on the training split) is a weight per row.
- Splits come from :func:`acqlens.operators.ranks.holdout_split` (hash-ordered, exact
  stratum counts, identical on any partitioning).
- Metrics are SQL aggregates over the scored test rows (one pass); ROC-AUC uses the
  distributed tie-averaged rank in ``ranks.roc_auc``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from acqlens import constants as K
from acqlens.functions import expressions as X
from acqlens.operators import boosting, kpis, ranks
from acqlens.operators.kpis import require_columns
from acqlens.session import reliable_checkpoint, scratch_path


# --- A16 -------------------------------------------------------------------------------------
def class_weight(train: DataFrame, label: str, count: str | None = None) -> DataFrame:
    """negatives / max(positives, 1) on the training rows (or on rows that carry a count)."""
    n = F.col(count) if count else F.lit(1)
    total = lambda y: F.coalesce(F.sum(F.when(F.col(label) == y, n)), F.lit(0)).cast("long")
    return train.agg(total(0).alias("negatives"), total(1).alias("positives")).withColumn("class_weight", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)))


# --- M1 / M2: preprocessing --------------------------------------------------------------------
def category_codes(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): the distinct values of each column, as text, numbered from 0 in
    their own order (numbers by size, texts by bytes).  Nulls have no code."""
    spark = train.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, value string, code int")
    numeric = {f.name for f in train.schema.fields if isinstance(f.dataType, NumericType)}
    sortable = [F.when(F.col(c).isNotNull(), F.struct((F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
                                                      F.col(c).cast("string").alias("text"))).alias(c) for c in columns]
    distinct = train.select(*sortable).unpivot([], columns, "column", "value").distinct()
    codes = ranks.value_ranks(distinct, "value", ["column"]).select("column", F.col("value.text").alias("value"), F.col("before").cast("int").alias("code"))
    path = scratch_path(spark, "category-codes")
    codes.write.parquet(path)
    return spark.read.schema(codes.schema).parquet(path)


@dataclass
class FittedPreprocessor:
    categorical: list[str]
    codes: DataFrame                     # (column, value, code) of the training rows
    means: dict[str, float]
    stds: dict[str, float]

    def output_names(self) -> list[str]:
        return [f"cat_{c}" for c in self.categorical] + [f"num_{c}" for c in self.means]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a ``cat_`` or ``num_`` column for each input column."""
        out = df
        for c in self.categorical:
            mine = self.codes.where(F.col("column") == c).select(F.col("value").alias(f"key_{c}"), F.col("code").alias(f"code_{c}"))
            out = out.join(mine, F.col(c).cast("string") == F.col(f"key_{c}"), "left").drop(f"key_{c}")
        return out.select(
            *df.columns, *[F.coalesce(F.col(f"code_{c}"), F.lit(-1)).alias(f"cat_{c}") for c in self.categorical],
            *[((F.col(c).cast("double") - F.lit(m)) / F.lit(self.stds[c] or 1.0)).alias(f"num_{c}") for c, m in self.means.items()])


def fit_preprocessor(train: DataFrame, categorical: list[str], numeric: list[str]) -> FittedPreprocessor:
    """Category codes as a table; mean and population std per numeric column from one aggregate
    (a constant column is only centred)."""
    row = train.agg(F.lit(0), *[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
    return FittedPreprocessor(list(categorical), category_codes(train, categorical),
                              {c: float(row[f"m_{c}"] or 0.0) for c in numeric}, {c: float(row[f"s_{c}"] or 0.0) for c in numeric})


def preprocessed_features(players: DataFrame) -> DataFrame:
    pre = fit_preprocessor(players, K.CATEGORICAL_FEATURES, K.NUMERIC_FEATURES)
    return pre.transform(players).select("user_id", *pre.output_names())


# --- model pipelines ---------------------------------------------------------------------------
@dataclass
class ModelSpec:
    name: str
    label: str
    categorical: list[str]
    numeric: list[str]
    kind: str            # "classifier" | "regressor"
    params: dict
    stratify: bool
    weighted: bool


RETENTION = ModelSpec("retention", K.RETENTION_TARGET, K.CATEGORICAL_FEATURES, K.NUMERIC_FEATURES,
                      "classifier", K.RETENTION_GBT, True, True)
LTV = ModelSpec("ltv", K.LTV_TARGET, K.CATEGORICAL_FEATURES, K.NUMERIC_FEATURES,
                "regressor", K.LTV_GBT, False, False)
CHURN = ModelSpec("churn", K.CHURN_TARGET, [], K.CHURN_FEATURE_COLUMNS,
                  "classifier", K.CHURN_GBT, True, True)


def split(df: DataFrame, spec: ModelSpec, test_size: float = K.TEST_SIZE, seed: int = K.SEED) -> DataFrame:
    return ranks.holdout_split(df, "user_id", test_size, seed, spec.label if spec.stratify else None)


@dataclass
class FittedModel:
    spec: ModelSpec
    pre: FittedPreprocessor
    trees: boosting.BoostedTrees

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and, for a classifier, ``probability`` of label 1."""
        margin = self.trees.margin(*self.pre.output_names())
        scored = self.pre.transform(df).withColumn("margin_", margin)
        if self.spec.kind == "classifier":
            p = 1 / (1 + F.exp(-F.col("margin_")))
            return scored.select(*df.columns, p.alias("probability"), (F.col("margin_") > 0).cast("double").alias("prediction"))
        return scored.select(*df.columns, F.col("margin_").alias("prediction"))


def tree_params(spec: ModelSpec, **overrides) -> boosting.BoostParams:
    given = dict(spec.params, **overrides)
    return boosting.BoostParams(kind=spec.kind, trees=given.pop("maxIter"), depth=given.pop("maxDepth"), step=given.pop("stepSize"), **given)


def train_model(players: DataFrame, spec: ModelSpec, **overrides) -> tuple[FittedModel, DataFrame]:
    """Fit on the training split; returns the model and the *test* rows for evaluation.  Rows
    whose label is null (not known yet) belong to neither."""
    require_columns(players, spec.categorical + spec.numeric + [spec.label, "user_id"], spec.name)
    known = players.where(F.col(spec.label).isNotNull())
    data = split(known.select("user_id", *spec.categorical, *spec.numeric, spec.label), spec)
    # the split is a global rank: compute it once, on the shared checkpoint folder, so the
    # training and test sides (and any retry) read the same rows
    data = reliable_checkpoint(data.withColumn(spec.label, F.col(spec.label).cast("double")))
    train = data.filter(~F.col("is_test"))
    test = data.filter(F.col("is_test"))
    weight_col = None
    if spec.weighted:
        cw = class_weight(train, spec.label).first()["class_weight"]
        train = train.withColumn("w", F.when(F.col(spec.label) == 1, F.lit(float(cw))).otherwise(F.lit(1.0)))
        weight_col = "w"
    pre = fit_preprocessor(train, spec.categorical, spec.numeric)
    trees = boosting.fit(pre.transform(train), pre.output_names(), spec.label, tree_params(spec, **overrides), weight_col)
    return FittedModel(spec, pre, trees), test


def positive_probability(scored: DataFrame, out: str = "p") -> DataFrame:
    return scored.withColumn(out, F.col("probability"))


# --- M6 / M7 / M8: metrics ------------------------------------------------------------------------
def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row wide metrics -> (metric, value) rows."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("mv")).select("mv.*")


def classification_metrics(scored: DataFrame, label: str, score: str, pred: str | None = None,
                           threshold: float = 0.5) -> DataFrame:
    """(metric, value): accuracy, precision, recall (0 on zero division), f1, roc_auc.

    The confusion matrix is one global aggregate; ROC-AUC goes through the distributed
    tie-averaged rank.  The two one-row results are stacked with a union (no join).
    """
    yhat = F.col(pred) if pred else (F.col(score) >= threshold).cast("int")
    y = F.col(label).cast("int")
    base = scored.select(y.alias("y"), yhat.cast("int").alias("yhat"), F.col(score).alias("s"))
    cm = base.agg(
        F.count_if((F.col("y") == 1) & (F.col("yhat") == 1)).alias("tp"),
        F.count_if((F.col("y") == 0) & (F.col("yhat") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("yhat") == 0)).alias("fn"),
        F.count_if((F.col("y") == 0) & (F.col("yhat") == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    metrics = cm.select(
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )
    auc = ranks.roc_auc(base, "y", "s")
    return _long(metrics, ["accuracy", "precision", "recall", "f1"]).unionByName(_long(auc, ["roc_auc"]))


def regression_metrics(scored: DataFrame, label: str, pred: str) -> DataFrame:
    """R^2 = 1 - SSE/SST, RMSE, MAE and the number of negative predictions, in one pass."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    agg = scored.agg(
        F.sum((y - p) * (y - p)).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.count_if(p < 0).alias("negative_predictions"),
    )
    return agg.select(
        (1 - F.col("sse") / F.col("sst")).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        "mae",
        "negative_predictions",
    )


def quality_gates(auc: DataFrame, reg: DataFrame, auc_gate: float = K.AUC_GATE, r2_gate: float = K.R2_GATE) -> DataFrame:
    """(gate, value, threshold, passed) rows: AUC >= 0.75, R^2 >= 0.70, no negative predictions."""
    a = auc.select(F.lit("roc_auc").alias("gate"), F.col("roc_auc").cast("double").alias("value"),
                   F.lit(auc_gate).alias("threshold"), (F.col("roc_auc") >= auc_gate).alias("passed"))
    r = reg.select(F.lit("r2").alias("gate"), F.col("r2").cast("double").alias("value"),
                   F.lit(r2_gate).alias("threshold"), (F.col("r2") >= r2_gate).alias("passed"))
    n = reg.select(F.lit("negative_predictions").alias("gate"), F.col("negative_predictions").cast("double").alias("value"),
                   F.lit(0.0).alias("threshold"), (F.col("negative_predictions") == 0).alias("passed"))
    return a.unionByName(r).unionByName(n)


def channel_baseline(players: DataFrame) -> DataFrame:
    """Per-channel mean LTV as a prediction (the simplest LTV model; A13 joined back)."""
    means = players.groupBy("acquisition_channel").agg(F.avg("ltv_day90").alias("ltv_estimate"))
    return players.join(kpis.small_side(means), "acquisition_channel", "left")


# --- M3-M5, M9, M10 ------------------------------------------------------------------------------
def evaluate_classifier(model: FittedModel, test: DataFrame, spec: ModelSpec) -> DataFrame:
    scored = positive_probability(model.transform(test))
    return classification_metrics(scored, spec.label, "p", pred="prediction").select(
        F.lit(spec.name).alias("model"), "metric", "value")


def evaluate_regressor(model: FittedModel, test: DataFrame, spec: ModelSpec) -> DataFrame:
    m = regression_metrics(model.transform(test), spec.label, "prediction")
    return _long(m, m.columns).select(F.lit(spec.name).alias("model"), "metric", "value")


def feature_importances(model: FittedModel, spark) -> DataFrame:
    """M9: (feature, importance) ascending; a fitted model attribute, one value per feature."""
    return spark.createDataFrame(model.trees.importances(), "feature string, importance double").orderBy("importance")


FLAG_COLUMNS = ["clan_member", "pass_royale_active", "pass_royale"]


def normalise_profiles(profiles: DataFrame) -> DataFrame:
    """A table of submitted profiles made model-ready -- boolean flags become 0/1 ints,
    ``arena_id`` is derived from trophies whatever was submitted, trophies/win-rate aliases are filled.
    Decided from the schema at plan-build time, so the result is a single projection."""
    types = dict(profiles.dtypes)
    out = profiles.withColumns(
        {c: F.col(c).cast("int") for c in FLAG_COLUMNS if types.get(c) == "boolean"}
    )
    cols = set(out.columns)
    if "trophies_end_week1" in cols:
        out = out.withColumn("arena_id", X.trophies_to_arena("trophies_end_week1"))
    for alias, src in (("trophies", "trophies_end_week1"), ("win_rate", "win_rate_week1"),
                       ("pass_royale", "pass_royale_active")):
        if alias not in cols and src in cols:
            out = out.withColumn(alias, F.col(src))
    return out


def score_players(players: DataFrame, retention: FittedModel, ltv: FittedModel, churn: FittedModel) -> DataFrame:
    """Table in, table out -- three fitted pipelines applied in sequence."""
    players = normalise_profiles(players)
    feats = sorted(set(K.FEATURE_COLUMNS + K.CHURN_FEATURE_COLUMNS) - {"acquisition_channel"})
    base = players.select("user_id", "acquisition_channel", *feats)
    keep = base.columns
    r = positive_probability(retention.transform(base), "retention_probability").select(*keep, "retention_probability")
    lt = ltv.transform(r).withColumnRenamed("prediction", "ltv_estimate").select(*keep, "retention_probability", "ltv_estimate")
    c = positive_probability(churn.transform(lt), "churn_probability")
    return c.select("user_id", "acquisition_channel", "retention_probability", "ltv_estimate", "churn_probability",
                    X.risk_band("churn_probability").alias("churn_risk"))


def prediction_sanity(scored: DataFrame, pred: str = "ltv_estimate") -> DataFrame:
    """negative-prediction count and range of a prediction column."""
    return scored.agg(F.count_if(F.col(pred) < 0).alias("negative_predictions"),
                      F.min(pred).alias("min_prediction"), F.max(pred).alias("max_prediction"),
                      F.count(F.lit(1)).alias("rows"))


# --- S4: model persistence -----------------------------------------------------------------
def save_model(model: FittedModel, path: str) -> None:
    """Trees, category codes and a line of JSON, each in a folder of its own below ``path``."""
    spark = model.pre.codes.sparkSession
    about = json.dumps({"spec": model.spec.name, "categorical": model.pre.categorical, "means": model.pre.means, "stds": model.pre.stds})
    model.pre.codes.write.mode("overwrite").parquet(f"{path}/codes")
    model.trees.save(spark, f"{path}/trees")
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(spark, path: str) -> FittedModel | None:
    """Load a saved model; ``None`` when nothing is stored at ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/model")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    about = json.loads(spark.read.text(f"{path}/model").first()["value"])
    spec = {s.name: s for s in (RETENTION, LTV, CHURN)}[about["spec"]]
    pre = FittedPreprocessor(about["categorical"], spark.read.schema("column string, value string, code int").parquet(f"{path}/codes"), about["means"], about["stds"])
    return FittedModel(spec, pre, boosting.BoostedTrees.load(spark, f"{path}/trees"))
