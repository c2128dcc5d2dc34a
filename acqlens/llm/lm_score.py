"""Stupid-backoff language-model scores from n-gram counts of the corpus itself.

The corpus is dealt into chunks.  Each chunk's n-grams are counted locally and its distinct
n-grams, sorted by hash and delta-coded, go to the count tables, which are partitioned by hash
range.  There the chunks' rows are summed per n-gram and every chunk gets the totals of its own
n-grams back, in its own order; joined to the chunk's exploded n-grams they give each
occurrence its counts, summed per document.  An n-gram travels once per chunk however often it
occurs, so frequent words make no hot key, and the exchanged counts grow with the corpus.  Words
and bigrams are counted first, then the longer n-grams length by length: only the totals, a
byte or so for each, are kept from one round to the next.

Counts leave the scored document itself out.  S(w | context) is the relative frequency if the
n-gram occurs elsewhere, else ``backoff`` times the score with one context word less; a word
that occurs nowhere else counts as half an occurrence.  Words are those between white space,
lower-cased (A-Z).

Defined results: texts without words have n_words 0, log_score 0 and no perplexity; equal rows
are scored apart (copies count as occurrences elsewhere).
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acqlens.llm.common import discard, sequence_hashes, ship, stored_alone, trimmed, word_hashes


@dataclass(frozen=True)
class BackoffParams:
    order: int = 3
    backoff: float = 0.4
    chunk_bytes: int = 4 << 20  # of text; a task holds one chunk
    table_bytes: int = 8 << 20  # of text; a count table holds one hash range's share of its n-grams


def deal(size: int, least: int, params: BackoffParams) -> tuple[int, int]:
    """Numbers of chunks and of count tables for so many bytes of text: both follow the size, so
    neither task grows with the corpus, and there are at least as many as shuffle partitions."""
    return max(least, -(-size // params.chunk_bytes)), max(least, -(-size // params.table_bytes))


def _narrow(d: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of bytes per delta that takes least, the deltas' bytes, and which are too large for it."""
    n, large = 8, np.zeros(len(d), dtype=bool)
    while n > 1:
        more = d >= np.uint64((1 << 8 * (n - 1)) - 1)
        if 8 * (np.count_nonzero(more) - np.count_nonzero(large)) > len(d):
            break
        n, large = n - 1, more
    return n, np.where(large, np.uint64((1 << 8 * n) - 1), d).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n], large


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as deltas of the number of bytes that takes least, those too large
    for it listed after them."""
    d = np.diff(x, prepend=np.uint64(0))
    n, head, large = _narrow(d)
    return bytes([n]) + len(d).to_bytes(8, "little") + head.tobytes() + d[large].astype("<u8").tobytes()


def pack_pieces(x: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """``pack_sorted`` of every piece between neighbouring ``cuts``, none of them empty, made at
    once: the pieces get small where there are many, and share one number of bytes."""
    d = np.diff(x, prepend=np.uint64(0))
    d[cuts[:-1]] = x[cuts[:-1]]
    n, head, large = _narrow(d)
    before = np.concatenate(([0], np.cumsum(large)))[cuts].tolist()
    head, rest, cuts = head.tobytes(), d[large].astype("<u8").tobytes(), cuts.tolist()
    return [bytes([n]) + (z - a).to_bytes(8, "little") + head[n * a : n * z] + rest[8 * i : 8 * j]
            for a, z, i, j in zip(cuts, cuts[1:], before, before[1:])]


def unpack_pieces(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all pieces one after the other, and how many each has."""
    width = np.array([b[0] for b in pieces], dtype=np.int64)
    size = np.array([int.from_bytes(b[1:9], "little") for b in pieces], dtype=np.int64)
    d = np.empty(size.sum(), dtype=np.uint64)
    for n in np.unique(width).tolist():
        own = np.flatnonzero(width == n).tolist()
        wide = np.zeros((size[own].sum(), 8), dtype=np.uint8)
        wide[:, :n] = np.frombuffer(b"".join(pieces[i][9 : 9 + n * k] for i, k in zip(own, size[own].tolist())), dtype=np.uint8).reshape(-1, n)
        part = wide.view("<u8").ravel()
        if n < 8:
            part[part == np.uint64((1 << 8 * n) - 1)] = np.frombuffer(b"".join(pieces[i][9 + n * k :] for i, k in zip(own, size[own].tolist())), dtype="<u8")
        if len(own) == len(pieces):
            d = part
        else:
            d[np.repeat(width == n, size)] = part
    x = np.cumsum(d, dtype=np.uint64)
    start = (np.cumsum(size) - size)[size > 0]
    return x - np.repeat(x[start] - d[start], size[size > 0]), size


def unpack_sorted(b: bytes) -> np.ndarray:
    n, size = b[0], int.from_bytes(b[1:9], "little")
    wide = np.zeros((size, 8), dtype=np.uint8)
    wide[:, :n] = np.frombuffer(b, dtype=np.uint8, count=n * size, offset=9).reshape(-1, n)
    d = wide.view("<u8").ravel()
    if n < 8:
        d[d == np.uint64((1 << 8 * n) - 1)] = np.frombuffer(b, dtype="<u8", offset=9 + n * size)
    return np.cumsum(d, dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as single bytes, those of 255 and more listed after them."""
    large = x >= 255
    return len(x).to_bytes(8, "little") + np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype("<i8").tobytes()


def unpack_counts(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    out = np.frombuffer(b, dtype=np.uint8, count=n, offset=8).astype(np.int64)
    out[out == 255] = np.frombuffer(b, dtype="<i8", offset=8 + n)
    return out


def _ngrams(texts: list[str | None], lengths: Iterable[int]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and for each length the start positions and hashes of its n-grams."""
    words, per = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    doc = np.repeat(np.arange(len(per)), per)
    out = []
    for k in lengths:
        h = sequence_hashes(words, k)
        at = np.flatnonzero(doc[: len(h)] == doc[k - 1 :]) if len(h) else np.empty(0, dtype=np.int64)
        out.append((at, h[at]))
    return per, out


def _count(order: int, tables: int):
    """A function for each round, which counts a chunk's n-grams of one or two lengths."""
    edges = np.array([(i << 64) // tables for i in range(1, tables)], dtype=np.uint64)

    def run(chunk: pa.Table, lengths: tuple[int, ...]) -> pa.Table:
        rows: dict[str, list] = {"part": [], "chunk": [], "n": [], "hashes": [], "counts": []}
        _, grams = _ngrams(chunk.column("text").to_pylist(), lengths)
        for n, (_, h) in zip(lengths, grams):
            u, c = np.unique(h, return_counts=True)
            cuts = np.concatenate(([0], np.searchsorted(u, edges), [len(u)]))
            for part in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[part], cuts[part + 1])
                for name, v in zip(rows, (int(part), chunk.column("chunk")[0].as_py(), n, pack_sorted(u[s]), pack_counts(c[s]))):
                    rows[name].append(v)
        return pa.table(rows, schema=pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    def of(lengths: tuple[int, ...]):
        return lambda chunk: run(chunk, lengths)
    return [of(lengths) for lengths in ((1, 2)[:order], *((n,) for n in range(3, order + 1)))]


def _total(part: pa.Table) -> pa.Table:
    """Sums per n-gram over all chunks of one count table, returned in each chunk's order."""
    chunk, n = part.column("chunk").to_numpy(), part.column("n").to_numpy()
    out: list[bytes] = [b""] * len(chunk)
    for k in np.unique(n):
        at = np.flatnonzero(n == k)
        hashes = [unpack_sorted(part.column("hashes")[int(i)].as_py()) for i in at]
        counts = np.concatenate([unpack_counts(part.column("counts")[int(i)].as_py()) for i in at])
        _, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, weights=counts).astype(np.int64)[back]
        ends = np.cumsum([len(h) for h in hashes])
        for i, h, e in zip(at, hashes, ends):
            out[i] = pack_counts(total[e - len(h) : e])
    return pa.table({"chunk": part.column("chunk"), "n": part.column("n"), "part": part.column("part"), "totals": pa.array(out, pa.binary())})


def _score(p: BackoffParams):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        per, grams = _ngrams(chunk.column("text").to_pylist(), range(1, p.order + 1))
        doc = np.repeat(np.arange(len(per)), per)
        where = list(zip(answers.column("n").to_pylist(), answers.column("part").to_pylist(), range(len(answers))))
        counts = []  # for each length: counts elsewhere of the n-gram that starts at a position
        for n, (at, h) in enumerate(grams, 1):
            total = [unpack_counts(answers.column("totals")[i].as_py()) for m, _, i in sorted(where) if m == n]
            _, back = np.unique(h, return_inverse=True)
            elsewhere = np.zeros(len(doc))
            if len(h):
                _, own, size = np.unique(back * len(per) + doc[at], return_inverse=True, return_counts=True)
                elsewhere[at] = np.concatenate(total)[back] - size[own]
            counts.append(elsewhere)
        first = np.concatenate(([0], np.cumsum(per)[:-1])) if len(per) else np.empty(0)
        place = np.arange(len(doc)) - first[doc] if len(doc) else np.empty(0)
        log = np.zeros(len(doc))
        todo = np.ones(len(doc), dtype=bool)
        factor = np.zeros(len(doc))
        for n in range(p.order, 1, -1):
            can = np.flatnonzero(todo & (place >= n - 1))
            start = can - (n - 1)
            seen = counts[n - 1][start] > 0
            log[can[seen]] = factor[can[seen]] + np.log(counts[n - 1][start[seen]]) - np.log(counts[n - 2][start[seen]])
            todo[can[seen]] = False
            factor[can[~seen]] += math.log(p.backoff)
        log[todo] = factor[todo] + np.log(np.maximum(counts[0][todo], 0.5))
        size = len(per)
        return pa.table({
            "doc_id": chunk.column("doc_id"), "n_words": pa.array(per, pa.int64()),
            "part_score": np.bincount(doc, weights=log, minlength=size)[:size],
            "n_unigram": pa.array(np.bincount(doc, weights=todo, minlength=size)[:size].astype(np.int64))})
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: BackoffParams = BackoffParams()) -> DataFrame:
    """Per row: doc_id, n_words, log_score (natural log, summed) and perplexity per word."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    chunks, tables = deal(size, int(spark.conf.get("spark.sql.shuffle.partitions")), params)
    id_type = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int").alias("chunk"))
    rounds = []
    for count in _count(params.order, tables):
        counted = dealt.groupBy("chunk").applyInArrow(trimmed(count), "part int, chunk int, n int, hashes binary, counts binary")
        rounds.append(stored_alone(counted.groupBy("part").applyInArrow(trimmed(_total), "chunk int, n int, part int, totals binary"), "lm-totals"))
    answers = reduce(DataFrame.unionByName, rounds)
    scored = stored_alone(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        trimmed(_score(params)), f"doc_id {id_type}, n_words long, part_score double, n_unigram long"), "lm-scored")
    discard(*rounds)
    words = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    log_score = F.col("part_score") - F.col("n_unigram") * F.log(F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)).cast("double"))
    return (scored.withColumn("log_score", log_score)
            .select("doc_id", "n_words", "log_score",
                    F.when(F.col("n_words") > 0, F.exp(-F.col("log_score") / F.col("n_words"))).alias("perplexity")))
