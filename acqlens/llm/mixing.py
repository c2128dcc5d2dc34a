"""Mixing to target weights with soft domain membership.

A classifier learned from the labelled table (naive Bayes over hashed byte 4-grams, its
posteriors tempered by text length) gives every document a probability for each domain.
Nonnegative document rates then minimise, by projected gradient,

    sum_k ((sum_i rate_i tokens_i p_ik - target_k) / mass_k)^2 mass_k + ridge * sum_i tokens_i (rate_i - 1)^2

where target_k is the domain's weight times the token budget.  A step needs the K expected
domain totals only: each iteration is one Spark aggregate over the stored (tokens, posteriors)
table, K numbers reach the driver, and tasks replay the short list of past steps to get their
documents' rates, so no rate table is rewritten.

Tokens are those that packing makes of a text, its end mark included.

Defined results: null and empty texts have zero tokens and uniform posteriors; domains without
any mass are left out and the other weights are rescaled; without labelled rows all rates are 1.
The classifier learns from at most ``most_labelled`` labelled rows, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acqlens.llm.common import chunks, map_arrow, stored
from acqlens.llm.packing import default_vocabulary, encoder


@dataclass(frozen=True)
class MixParams:
    weights: dict[str, float] = field(default_factory=lambda: {"q1t0": 0.90, "q0t0": 0.08, "q1t1": 0.02})
    budget: float | None = None  # tokens; by default those of the corpus
    most_labelled: int = 20_000
    buckets: int = 1 << 17
    smoothing: float = 0.5
    dependence: float = 0.65  # log densities are divided by the number of 4-grams to this power
    ridge: float = 0.01
    iterations: int = 40
    tolerance: float = 1e-3


def grams(blobs: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 4-grams of all texts one after the other, and their numbers."""
    buf = np.frombuffer(b"".join(blobs) + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    x = buf[:-3] | buf[1:-2] << np.uint32(8) | buf[2:-1] << np.uint32(16) | buf[3:] << np.uint32(24)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    size = np.array([len(b) for b in blobs], dtype=np.int64)
    inside = np.ones(len(x), dtype=bool)
    ends = np.cumsum(size)
    for k in (1, 2, 3):  # 4-grams that run into the next text
        at = ends - k
        inside[at[(at >= 0) & (size >= k)]] = False
    return (x[inside] % np.uint32(buckets)).astype(np.int64), np.maximum(size - 3, 0)


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in batches:
            blobs, names = _bytes(b.column(0).to_pylist()), b.column(1).to_pylist()
            for lo, hi in chunks(blobs):
                ids, n = grams(blobs[lo:hi], buckets)
                for name in set(names[lo:hi]):
                    mine = np.array([x == name for x in names[lo:hi]])
                    got = np.bincount(ids[np.repeat(mine, n)], minlength=buckets)
                    sums[name] = sums[name] + got if name in sums else got
                    docs[name] = docs.get(name, 0) + int(mine.sum())
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"domain": pa.array([name] * (len(at) + 1), pa.string()), "bucket": np.append(at, -1), "n": np.append(c[at], docs[name])})
    return run


@dataclass
class DomainModel:
    domains: list[str]
    log_prob: np.ndarray  # buckets x domains
    log_prior: np.ndarray
    dependence: float


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: quality and toxicity together."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("domain"))


def fit_domains(docs: DataFrame, labelled: DataFrame, params: MixParams, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    sample = labelled.select(F.col("doc_id").alias("id_"), "domain").orderBy(F.xxhash64("id_"), "id_", "domain").limit(params.most_labelled)
    rows = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(sample), F.col(id_col) == F.col("id_")).select(text_col, "domain")  # bounded above
    sums = map_arrow(rows, _count(params.buckets), "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["domain"].unique())
    counts, docs_of = np.zeros((params.buckets, len(names))), np.zeros(len(names))
    for k, name in enumerate(names):
        mine = sums[sums["domain"] == name]
        some = mine[mine["bucket"] >= 0]
        counts[some["bucket"].to_numpy(), k] = some["n"].to_numpy()
        docs_of[k] = mine.loc[mine["bucket"] < 0, "n"].sum()
    log_prob = np.log(counts + params.smoothing) - np.log(counts.sum(axis=0) + params.smoothing * params.buckets)
    return DomainModel(names, log_prob.astype(np.float32), np.log(docs_of / max(docs_of.sum(), 1)) if names else docs_of,
                       params.dependence)


def posteriors(blobs: list[bytes], model: DomainModel) -> np.ndarray:
    """(texts x domains); 4-grams of one text are far from independent, hence the tempering."""
    k = len(model.domains)
    out = np.full((len(blobs), k), 1 / max(k, 1))
    if not k:
        return out
    for lo, hi in chunks(blobs, 1 << 19):
        ids, n = grams(blobs[lo:hi], len(model.log_prob))
        has = np.flatnonzero(n)
        if not len(has):
            continue
        total = np.add.reduceat(model.log_prob[ids], (np.cumsum(n) - n)[has], axis=0, dtype=np.float64)
        total = (total - total.max(axis=1, keepdims=True)) / (n[has] ** model.dependence)[:, None] + model.log_prior
        p = np.exp(total - total.max(axis=1, keepdims=True))
        out[lo + has] = p / p.sum(axis=1, keepdims=True)
    return out


def token_counts(texts: list[str | None], vocabulary: str | None = None) -> list[int]:
    """Packed tokens of each text; equal texts are encoded once."""
    enc = encoder(vocabulary)
    known = {t: len(enc.encode(t)) + 1 if t else 0 for t in set(texts)}
    return [known[t] for t in texts]


def score_domains(docs: DataFrame, model: DomainModel, text_col: str = "text", with_text: bool = False,
                  tokens_col: str = "tokens_", posterior_col: str = "posterior_", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the number of tokens and the domain posteriors of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    keep = [i for i in range(len(docs.columns)) if with_text or i != at]
    schema = T.StructType([docs.schema[i] for i in keep] + [
        T.StructField(tokens_col, T.LongType()), T.StructField(posterior_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            blobs = _bytes(texts)
            p = posteriors(blobs, shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, max(p.shape[1], 1))[: len(b) + 1] if p.size else np.zeros(len(b) + 1), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(token_counts(texts, vocabulary), pa.int64()), lists],
                names=[*(b.schema.names[i] for i in keep), tokens_col, posterior_col])

    return map_arrow(docs, run, schema)


def replay(p: np.ndarray, steps: list[np.ndarray], ridge: float) -> np.ndarray:
    """Rates after the given steps of projected gradient, from rate 1."""
    rate = np.ones(len(p))
    for e in steps:
        rate = np.maximum(0.0, rate - (p @ e + ridge * (rate - 1)) / (1 + ridge))
    return rate


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), k)


def fit_rates(scored: DataFrame, domains: list[str], params: MixParams, tokens_col: str = "tokens_",
              posterior_col: str = "posterior_") -> list[np.ndarray]:
    """The gradient steps that lead to the rates, from a stored table of tokens and posteriors."""
    k = len(domains)
    steps: list[np.ndarray] = []
    rows = scored.select(F.col(tokens_col), F.col(posterior_col)).where(F.col(tokens_col) > 0)

    def totals(done: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(k)
            for b in batches:
                p = _matrix(b.column(1), k)
                s += (replay(p, done, params.ridge) * b.column(0).to_numpy()) @ p
            yield pa.RecordBatch.from_pydict({"k": np.arange(k), "s": s})

        out = np.zeros(k)
        for r in map_arrow(rows, run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():  # K rows
            out[r["k"]] = r["s"]
        return out

    if not k:
        return steps
    mass = totals([])
    weight = np.array([params.weights.get(d, 0.0) for d in domains]) * (mass > 0)
    if not mass.sum() or not weight.sum():
        return steps
    target = weight / weight.sum() * (params.budget or mass.sum())
    now = mass
    for _ in range(params.iterations):
        steps.append(np.where(mass > 0, (now - target) / np.where(mass > 0, mass, 1), 0.0))
        now = totals(steps)
        if np.abs(now - target).max() <= params.tolerance * target.sum():
            break
    return steps


def with_rates(scored: DataFrame, steps: list[np.ndarray], params: MixParams, posterior_col: str = "posterior_",
               rate_col: str = "rate_") -> DataFrame:
    at = scored.columns.index(posterior_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(steps[0]) if steps else 0
            rate = replay(_matrix(b.column(at), k), steps, params.ridge) if steps else np.ones(len(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate)], names=[*b.schema.names, rate_col])

    return map_arrow(scored, run, T.StructType([*scored.schema.fields, T.StructField(rate_col, T.DoubleType())]))


def document_rates(docs: DataFrame, labels: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id",
                   text_col: str = "text", with_text: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` (its text only if asked for) with tokens_, posterior_ and rate_ (replaced if they
    are there already), and the domains' names."""
    docs = docs.drop("tokens_", "posterior_", "rate_")
    model = fit_domains(docs, domain_of(labels), params, id_col, text_col)
    scored = stored(score_domains(docs, model, text_col, with_text), "mix-scored")
    return with_rates(scored, fit_rates(scored, model.domains, params), params), model.domains


def sample_by_rate(docs: DataFrame, labels: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``docs`` with every row taken as often as its rate says: the whole part, and once more
    with the probability of the rest, decided by a hash of id and text (the same in every run)."""
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # out of the way of added columns
    i, t = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rated, _ = document_rates(rows, labels, params, i, t, with_text=True)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(i), F.col(t)), F.lit(1 << 30)) / (1 << 30)
    times = (F.floor("rate_") + (chance < F.col("rate_") - F.floor("rate_")).cast("int")).cast("int")
    taken = rated.withColumn("times_", times).where("times_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_"))))
    return taken.select(*rows.columns).toDF(*docs.columns)
