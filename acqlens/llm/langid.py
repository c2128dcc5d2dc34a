"""Language identification: multinomial naive Bayes over hashed character n-grams.

One pass over the training texts counts hashed n-grams per language; the counts are summed by
Spark and become a log-probability matrix of (buckets x languages), whose size depends on the
parameters and not on the corpus.  The matrix is broadcast, and every text is scored by
gathering the matrix rows of its n-grams (the non-zeros of its sparse count row) in numpy.

Defined results: a null text or one without letters gets ``und`` with score 0; an empty
training set gives ``und`` for every text; ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acqlens.llm.common import map_arrow

UNDETERMINED = "und"
_TABLES: list[np.ndarray] = []


@dataclass(frozen=True)
class LangIdParams:
    buckets: int = 1 << 16
    orders: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5


def _folded() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for everything that is no letter."""
    if not _TABLES:
        fold = np.full(0x110000, 32, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                fold[cp] = ord(low) if len(low) == 1 else cp
        _TABLES.append(fold)
    return _TABLES[0]


def features(texts: list[str], p: LangIdParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-gram ids of all texts one after the other, ids per text, letters per text.

    Every run of non-letters is one blank, and each text is framed by blanks.
    """
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    blank = (32).to_bytes(4, "little")
    cps = np.frombuffer(b"".join(x for r in raw for x in (blank, r, blank)), dtype=np.uint32)
    doc = np.repeat(np.arange(len(raw)), [len(r) // 4 + 2 for r in raw])
    cps = _folded()[cps]
    keep = np.ones(len(cps), dtype=bool)
    keep[1:] = (cps[1:] != 32) | (cps[:-1] != 32) | (doc[1:] != doc[:-1])
    cps, doc = cps[keep], doc[keep]
    letters = np.bincount(doc[cps != 32], minlength=len(raw))
    ids, owner = [], []
    h = np.zeros(len(cps), dtype=np.uint64)
    for n in range(1, max(p.orders) + 1):
        h = h[: len(cps) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + cps[n - 1 :].astype(np.uint64) + np.uint64(n)
        if n in p.orders:
            x = h ^ (h >> np.uint64(31))
            x *= np.uint64(0xBF58476D1CE4E5B9)
            first = doc[: len(x)]
            inside = cps != 32 if n == 1 else first == doc[n - 1 :]
            ids.append((x[inside] >> np.uint64(40)).astype(np.int64) % p.buckets)
            owner.append(first[inside])
    ids_, owner_ = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    return ids_[order], np.bincount(owner_, minlength=len(raw)), letters


def _pieces(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _count(p: LangIdParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in _pieces(texts, 1 << 19):
                ids, per, _ = features(texts[lo:hi], p)
                names = langs[lo:hi]
                for lang in set(names):
                    mine = np.repeat(np.array([x == lang for x in names]), per)
                    got = np.bincount(ids[mine], minlength=p.buckets)
                    counts[lang] = counts[lang] + got if lang in counts else got
                    docs[lang] = docs.get(lang, 0) + names.count(lang)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(at) + 1), pa.string()),
                "bucket": pa.array(np.append(at, -1), pa.int64()),  # -1: number of documents
                "n": pa.array(np.append(c[at], docs[lang]), pa.int64()),
            })
    return run


@dataclass
class LangIdModel:
    langs: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray
    params: LangIdParams


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang",
        params: LangIdParams = LangIdParams()) -> LangIdModel:
    """Fit on all rows of ``train`` with a text and a language."""
    rows = train.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(
        F.col("t").isNotNull() & F.col("l").isNotNull())
    sums = (map_arrow(rows, _count(params), "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages x buckets rows at most
    langs = sorted(sums["lang"].unique())
    counts, docs = np.zeros((params.buckets, len(langs))), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        mine = sums[sums["lang"] == lang]
        grams = mine[mine["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), j] = grams["n"].to_numpy()
        docs[j] = mine.loc[mine["bucket"] < 0, "n"].sum()
    log_prob = np.log(counts + params.smoothing) - np.log(counts.sum(axis=0) + params.smoothing * params.buckets)
    return LangIdModel(langs, log_prob.astype(np.float32), np.log(docs / max(docs.sum(), 1)) if langs else docs, params)


def score_texts(texts: list[str | None], model: LangIdModel) -> tuple[list[str], np.ndarray]:
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return names, scores
    at = [i for i, t in enumerate(texts) if t]
    some = [texts[i] for i in at]
    for lo, hi in _pieces(some, max(1 << 14, (1 << 20) // len(model.langs))):
        ids, per, letters = features(some[lo:hi], model.params)
        has = np.flatnonzero(per)
        total = np.zeros((hi - lo, len(model.langs)))
        if len(has):
            total[has] = np.add.reduceat(model.log_prob[ids], (np.cumsum(per) - per)[has], axis=0, dtype=np.float64)
        total += model.log_prior
        best = total.argmax(axis=1)
        top = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for k in np.flatnonzero(letters):
            names[at[lo + k]], scores[at[lo + k]] = model.langs[best[k]], top[k]
    return names, scores


def predict(docs: DataFrame, model: LangIdModel, text_col: str = "text",
            name_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability added; columns that
    have these names already are replaced."""
    docs = docs.drop(name_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = score_texts(b.column(at).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*b.schema.names, name_col, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(name_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return map_arrow(docs, run, schema)


