"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

``document_statistics`` turns every whole text into a short vector of transformed statistics
(logs of counts, logits of shares).  ``fit`` takes first and second moments per class, which
Spark sums from per-task partial sums, shrinks each class covariance towards the pooled one
and towards its diagonal, and keeps the Cholesky factor.  A score is the logistic of the
difference of the two log densities (Mahalanobis distance plus log determinant) and the log
prior odds; the factors are inverted once and broadcast.

Defined results: a null text counts as empty; empty texts get the score of the all-zero
statistics; without two labelled classes every score is the share of label 1 (0.5 if there
are no labels).  Statistics that are constant in training carry no weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acqlens.llm.common import map_arrow

NAMES = ("log_chars", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "exclamation",
         "bar", "line_break", "log_line", "repeated_lines", "distinct_words", "top_word", "short_words",
         "symbol_words", "sentences", "caps_words")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CLASS = np.zeros(128, dtype=np.int8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-?", "#*$%&<>@^~=_+/\\{}[]`", "!", "|", "\n"), 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _k


@dataclass(frozen=True)
class QdaParams:
    pool: float = 0.6  # weight of the pooled covariance in each class covariance
    diagonal: float = 0.05  # weight of the diagonal
    ridge: float = 1e-3
    temper: float = 0.35  # statistics of one text are dependent; scales the log density difference


def _logit(share: float) -> float:
    share = min(max(share, 0.0), 1.0)
    return float(np.log((share + 1e-3) / (1 - share + 1e-3)))


def statistics_of(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``NAMES``."""
    text = text or ""
    n = len(text)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_CLASS[cps[cps < 128]], minlength=8)
    words = _WORD.findall(text)
    w = max(len(words), 1)
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(n, 1)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(sum(map(len, words)) / w),
        _logit((kinds[1] + sum(x.isupper() for x in seen if not x.isascii())) / m),
        _logit(kinds[2] / m), _logit(kinds[3] / m), _logit(kinds[4] / m), _logit(kinds[5] / m), _logit(kinds[6] / m),
        _logit(kinds[7] / m), np.log1p(len(words) / max(len(lines), 1)),
        _logit(1 - len(set(lines)) / max(len(lines), 1)), _logit(len(seen) / w),
        _logit(max(seen.values(), default=0) / w), _logit(sum(len(x) <= 2 for x in words) / w),
        _logit(sum(c for x, c in seen.items() if not x[-1].isalnum() and x[-1] not in ".,;:?!'\")") / w),
        _logit(text.count(". ") / w), _logit(sum(c for x, c in seen.items() if x.isupper() and len(x) > 2) / w),
    ]


def document_statistics(docs: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """``docs`` without its text and with the statistics as an array of doubles; a column that
    has that name already is replaced."""
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    keep = [i for i in range(len(docs.columns)) if i != at]
    schema = T.StructType([docs.schema[i] for i in keep] + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last: dict[str | None, list[float]] = {}
            rows = []
            for t in b.column(at).to_pylist():
                if t not in last:
                    last[t] = statistics_of(t)
                rows.append(last[t])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(rows, pa.list_(pa.float64()))],
                names=[*(b.schema.names[i] for i in keep), out_col])

    return map_arrow(docs, run, schema)


@dataclass
class QdaModel:
    mean: np.ndarray  # classes x statistics
    whiten: np.ndarray  # classes x statistics x statistics: inverse Cholesky factors
    log_det: np.ndarray
    log_odds: float
    constant: float | None  # the score where no discriminant could be fitted
    temper: float


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), len(NAMES))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES) + 1
    sums = np.zeros((2, d, d))
    for b in batches:
        x = np.hstack([np.ones((len(b), 1)), _matrix(b.column(0))])
        y = np.array(b.column(1).to_pylist(), dtype=int)
        for k in (0, 1):
            sums[k] += x[y == k].T @ x[y == k]
    k, i, j = np.nonzero(np.ones_like(sums))
    yield pa.RecordBatch.from_pydict({"k": k, "i": i, "j": j, "s": sums.ravel()})


def fit(labelled: DataFrame, stats_col: str = "stats", label_col: str = "quality",
        params: QdaParams = QdaParams()) -> QdaModel:
    """Fit on all rows whose label is 0 or 1."""
    rows = labelled.select(F.col(stats_col).alias("x"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    d = len(NAMES) + 1
    got = (map_arrow(rows, _moments, "k long, i long, j long, s double")
           .groupBy("k", "i", "j").agg(F.sum("s").alias("s")).toPandas())  # 2 x 19 x 19 numbers
    m = np.zeros((2, d, d))
    m[got["k"], got["i"], got["j"]] = got["s"]
    n = m[:, 0, 0]
    if (n < 2).any():
        return QdaModel(np.zeros((2, d - 1)), np.zeros((2, d - 1, d - 1)), np.zeros(2), 0.0,
                        float(n[1] / n.sum()) if n.sum() else 0.5, params.temper)
    mean = m[:, 0, 1:] / n[:, None]
    scatter = m[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    scale = np.diag(pooled).clip(min=1e-12)
    whiten, log_det = np.zeros_like(scatter), np.zeros(2)
    for k in (0, 1):
        cov = (1 - params.pool) * scatter[k] / n[k] + params.pool * pooled
        cov = (1 - params.diagonal) * cov + params.diagonal * np.diag(np.diag(cov))
        factor = np.linalg.cholesky(cov + params.ridge * np.diag(scale) + 1e-9 * np.eye(d - 1))
        whiten[k], log_det[k] = np.linalg.inv(factor), np.log(np.diag(factor)).sum()
    return QdaModel(mean, whiten, log_det, float(np.log(n[1] / n[0])), None, params.temper)


def score_matrix(x: np.ndarray, model: QdaModel) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(x), model.constant)
    density = [-0.5 * (((x - model.mean[k]) @ model.whiten[k].T) ** 2).sum(axis=1) - model.log_det[k] for k in (0, 1)]
    z = model.log_odds + model.temper * (density[1] - density[0])
    return 1 / (1 + np.exp(-z.clip(-500, 500)))


def score(stats: DataFrame, model: QdaModel, stats_col: str = "stats", out_col: str = "score") -> DataFrame:
    """``stats`` with the probability of label 1 added (or replaced)."""
    stats = stats.drop(out_col)
    shared = stats.sparkSession.sparkContext.broadcast(model)
    at = stats.columns.index(stats_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(score_matrix(_matrix(b.column(at)), shared.value))],
                names=[*b.schema.names, out_col])

    return map_arrow(stats, run, T.StructType([*stats.schema.fields, T.StructField(out_col, T.DoubleType())]))
