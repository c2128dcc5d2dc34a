"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is its set of distinct word shingles.  Circulant MinHash needs two permutations of
the 32-bit ring: the first scatters the shingles, the second, shifted by k on the ring, gives
signature coordinate k for every k.  Coordinates are grouped into bands; documents that agree
on a band are candidates.

Documents with the same set form one class, and only classes are compared.  Within a bucket
classes are first compared with one pivot, the class that shares buckets with the most others
(the text that the copies derive from, as a rule); buckets that still hold several components
get another pivot, and when that no longer pays, what is left is compared pair by pair within its
buckets, first by a long sketch of further signature coordinates (crowded buckets in blocks, in
the tasks), and pairs whose sketches agree nearly as often as linked ones do, four standard
deviations off at most, on their sets.  So every pair of classes in a bucket is compared or
known to be connected, and nothing is capped.  Links are confirmed on the full sets.

Defined results: null or empty texts have no shingles and link with nothing (also not with
each other); a text of fewer words than a shingle is one shingle; repeated rows and equal ids
are one class; rows with a null id are classes without a link unless their sets match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acqlens.llm.common import chunks, fresh, map_arrow, mix64, sequence_hashes, stored, word_hashes
from acqlens.llm.components import components


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    bands: int = 20
    rows: int = 4  # 20 bands of 4: a pair at 0.8 is missed with probability 3e-5
    sketch: int = 1024  # coordinates of the sketch, 8 bits each
    num: int = 80  # link where den * intersection >= num * union
    den: int = 100


def shingle_sets(blobs: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and their numbers."""
    words, per = word_hashes(blobs)
    sets, start = [], 0
    for k in per:
        w = words[start : start + k]
        start += k
        sets.append(np.unique(sequence_hashes(w, n if k >= n else k)) if k else words[:0])
    return (np.concatenate(sets) if sets else words), np.array([len(s) for s in sets], dtype=np.int64)


def _ring(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit ring, computed in place in ``x`` with scratch ``a``."""
    for shift, mult in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=a)
        np.bitwise_xor(x, a, out=x)
        np.multiply(x, np.uint32(mult), out=x)
    np.right_shift(x, np.uint32(16), out=a)
    return np.bitwise_xor(x, a, out=x)


def band_hashes(shingles: np.ndarray, counts: np.ndarray, p: MinHashParams) -> np.ndarray:
    """(documents x bands) band keys; rows of empty documents are 0."""
    out = np.zeros((len(counts), p.bands), dtype=np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    ring = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)  # first permutation
    ends = np.cumsum(counts[has])
    lo = 0
    while lo < len(has):  # some ten thousand shingles at a time stay in the cache
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + 32768, side="right")))
        part, starts = ring[base : ends[hi - 1]], np.concatenate(([0], ends[lo : hi - 1] - base))
        x, a = np.empty_like(part), np.empty_like(part)
        for band in range(p.bands):
            key = np.full(hi - lo, np.uint64(band), dtype=np.uint64)
            for k in range(band * p.rows, (band + 1) * p.rows):
                np.add(part, np.uint32(k), out=x)  # the circular shift
                least = np.minimum.reduceat(_ring(x, a), starts)
                key = key * np.uint64(0x9E3779B97F4A7C15) + least
            out[has[lo:hi], band] = mix64(key)
        lo = hi
    return out


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes: A-Z only


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHashParams = MinHashParams()) -> DataFrame:
    """Per row: id, number of shingles, set key (null if empty) and band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = _lower(b.column(1).to_pylist())
            for lo, hi in chunks(blobs, 4 << 20):
                sets, n = shingle_sets(blobs[lo:hi], params.shingle)
                bands = band_hashes(sets, n, params)
                ends = np.cumsum(n)
                keys = [hashlib.blake2b(sets[e - k : e].tobytes(), digest_size=16).digest() if k else None for e, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, params.bands), pa.int32()), pa.array(bands.view(np.int64).ravel()))],
                    names=["doc_id", "n_shingles", "set_key", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return map_arrow(rows, run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets_of(p: MinHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = _lower(b.column(1).to_pylist())
            for lo, hi in chunks(blobs, 4 << 20):
                sets, n = shingle_sets(blobs[lo:hi], p.shingle)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([sets[e - k : e].tobytes() for e, k in zip(ends, n)], pa.binary())],
                    names=["id", "shingles"])
    return run


_BLOCK = 512
_SHIFT = 1 << 16  # the sketch's coordinates lie beyond those of the bands


def _sketches(p: MinHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [r.as_buffer() for r in b.column(1)]
            ends = np.cumsum([r.size // 8 for r in raws])
            lo = 0
            while lo < len(raws):  # as in band_hashes
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + 32768, side="right")))
                part = np.concatenate([np.frombuffer(r, dtype=np.uint64) for r in raws[lo:hi]])
                part, starts = (mix64(part) >> np.uint64(32)).astype(np.uint32), np.concatenate(([0], ends[lo : hi - 1] - base))
                x, a, out = np.empty_like(part), np.empty_like(part), np.empty((hi - lo, p.sketch), dtype=np.uint8)
                for k in range(p.sketch):
                    np.add(part, np.uint32(_SHIFT + k), out=x)
                    out[:, k] = np.minimum.reduceat(_ring(x, a), starts).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in out], pa.binary())], names=["id", "sketch"])
                lo = hi
    return run


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        bucket = t.column(0).to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and len(held):
        yield held


def _agreeing(p: MinHashParams):
    share = p.num / p.den
    enough = p.sketch * share - 4 * (p.sketch * share * (1 - share)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_buckets(batches):
            bucket, one, two, block, ids, n, label = (t.column(k).to_numpy() for k in range(7))
            sketch = np.frombuffer(b"".join(t.column(7).to_pylist()), dtype=np.uint8).reshape(len(t), p.sketch)
            held, found = t.column(8), []
            edge = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1
            for s, e in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(t)]))):
                for i in range(s, e - 1):
                    j = np.arange(i + 1, e)
                    j = j[(label[j] != label[i]) & (p.den * np.minimum(n[j], n[i]) >= p.num * np.maximum(n[j], n[i]))
                          & ((one[i] == two[i]) | (block[j] != block[i]))]
                    if len(j):
                        j = j[(sketch[j] == sketch[i]).sum(axis=1) >= enough]
                    for k in j:  # a pair is reported in the first of the buckets it shares
                        if min(set(held[int(i)].as_py()) & set(held[int(k)].as_py())) == bucket[i]:
                            found.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def _close_pairs(open_: DataFrame, sets: DataFrame, params: MinHashParams) -> DataFrame:
    """Pairs of classes of different components that share a bucket and may be linked."""
    held = open_.groupBy("id").agg(F.collect_set("bucket").alias("held"))  # as many as there are bands at most
    told = stored(map_arrow(sets.join(held.select("id"), "id").select("id", "shingles"), _sketches(params), "id long, sketch binary"),
                  "minhash-sketches").join(held, "id")
    blocks = open_.groupBy("bucket").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("k"))
    rows = (open_.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).join(told, "id")
            .select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block",
                    "id", "n", "label", "sketch", "held"))
    return map_arrow(rows.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "id"),
                     _agreeing(params), "a long, b long")


def _verify(p: MinHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                if p.den * len(small) < p.num * len(large):
                    link.append(False)
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                link.append(p.den * both >= p.num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(link, pa.bool_())], names=["a", "b", "link"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    params: MinHashParams = MinHashParams()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable)."""
    rows = stored(signatures(docs, id_col, text_col, params), "minhash-signatures")
    classes = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = classes.select("id", "n", F.posexplode("bands").alias("band", "key")).select(
        "id", "n", F.xxhash64("band", "key").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    members = stored(members.join(crowded, "bucket"), "minhash-buckets")  # (id, n, bucket) where several classes meet
    compared = members.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(compared, "id").dropDuplicates(["id"])
    sets = stored(map_arrow(texts.select("id", "t"), _sets_of(params), "id long, shingles binary"), "minhash-sets")

    labels, tested, used, edges, before = None, None, None, [], None
    while True:
        if labels is None:
            open_ = members.withColumn("label", F.col("id"))
        else:
            named = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
            several = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
            open_ = stored(named.join(several, "bucket"), "minhash-open")
        # pairs still unknown: between components that meet in a bucket
        sizes = open_.groupBy("bucket", "label").agg(F.count("*").alias("m")).groupBy("bucket").agg(
            (F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("twice"), F.sum("m").alias("m"))
        r = sizes.agg(F.coalesce(F.sum("twice"), F.lit(0)) / 2, F.coalesce(F.sum("m"), F.lit(0))).first()
        unknown, width = float(r[0]), int(r[1])
        if not width:
            break
        listing = before is not None and (unknown <= width or unknown > 0.95 * before)
        sized = lambda m, n: F.lit(params.den) * F.least(m, n) >= F.lit(params.num) * F.greatest(m, n)
        if listing:  # every remaining pair
            pairs = _close_pairs(open_, sets, params)
        else:  # one pivot per bucket, each round another one
            near = open_.groupBy("bucket").agg(F.count("*").alias("m"))
            reach = open_.join(near, "bucket").groupBy("id").agg(F.sum("m").alias("reach"))
            free = open_ if used is None else open_.join(used, "id", "left_anti")
            pivot = stored(free.join(reach, "id").groupBy("bucket").agg(
                F.max_by(F.struct("id", "n", "label"), F.struct("reach", F.negative("id"))).alias("p")), "minhash-pivots")
            used = pivot.select("p.id") if used is None else used.unionByName(pivot.select("p.id"))
            pairs = (open_.join(pivot, "bucket").where((F.col("label") != F.col("p.label")) & sized(F.col("n"), F.col("p.n")))
                     .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        first = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a")
        found = stored(map_arrow(
            first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b").select("a", "b", "s", "t"),
            _verify(params), "a long, b long, link boolean"), "minhash-links")
        tested = found.select("a", "b") if tested is None else tested.unionByName(found.select("a", "b"))
        edges.append(found.where("link").select("a", "b"))
        every = edges[0]
        for e in edges[1:]:
            every = every.unionByName(e)
        labels = components(every)
        if listing:
            break
        before = unknown
    out = rows.select("doc_id", "n_shingles", "set_key")
    names = classes.select("set_key", F.col("id").alias("class_id"))
    if labels is not None:
        names = names.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select(
            "set_key", F.coalesce("label", "class_id").alias("component_id"))
    else:
        names = names.withColumnRenamed("class_id", "component_id")
    # the set key of copies may be held by a third of all rows: one row per key on the other side
    return out.join(names, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         params: MinHashParams = MinHashParams()) -> DataFrame:
    """``docs`` with one row per group: the smallest id.  Rows without shingles or id all stay;
    of rows that repeat an id, one stays if they have shingles."""
    found = stored(near_duplicates(docs, id_col, text_col, params), "minhash-found").where("doc_id is not null and n_shingles > 0")
    g = fresh("gone", docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(g)).distinct()
    out = docs.join(gone, F.col(id_col) == F.col(g), "left_anti")
    again = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(g)), "minhash-again")
    if again.limit(1).count():
        single = out.join(again, F.col(id_col) == F.col(g), "left_anti")
        repeated = out.join(again, F.col(id_col) == F.col(g), "left_semi")
        out = single.unionByName(repeated.groupBy(id_col).agg(*(F.first(c).alias(c) for c in docs.columns if c != id_col)).select(*docs.columns))
    return out
