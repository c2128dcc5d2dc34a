"""Embedding near-duplicates by collision-counting projections.

Many one-dimensional projections are sorted and every vector opens a window around its own
value; a pair is counted once for every projection in which it meets in a window.  One
projection alone separates little (far pairs still meet in nearly half of them, whatever the
number of vectors), so each sorted list is divided into cells by the signs of further
projections.  The number of signs grows with the logarithm of the number of vectors, which
keeps the collisions in proportion, and the number of lists is then calibrated so that a pair
at the threshold reaches the required count with the wanted probability.  Pairs that reach it
are verified by exact cosine in double precision.

Equal vectors form one class, compared once.  A crowded cell is divided into blocks that are
paired, so that no task holds a whole cell; nothing is capped.

Defined results: null, zero or empty vectors and vectors with null or non-finite components
link with nothing; vectors of different length don't link; repeated rows are separate vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acqlens.llm.common import map_arrow, stored
from acqlens.llm.components import components

_BLOCK = 1024


@dataclass(frozen=True)
class CollisionParams:
    threshold: float = 0.9
    recall: float = 0.995
    count: int = 2  # windows in which a pair has to meet
    seed: int = 7


@dataclass(frozen=True)
class Calibration:
    lists: int
    signs: int
    half_width: float  # in units of the projection of a unit vector of one dimension
    count: int


def calibrate(n: int, p: CollisionParams) -> Calibration:
    """Signs per list from the number of vectors, lists from the recall at the threshold."""
    signs = max(4, math.ceil(math.log2(max(n, 2))) - 3)
    same = 1 - math.acos(p.threshold) / math.pi
    z = 1.96  # the window holds 95 % of the pairs at the threshold
    meet = 0.95 * same ** signs
    lists = p.count
    while sum(math.comb(lists, k) * meet ** k * (1 - meet) ** (lists - k) for k in range(p.count)) > 1 - p.recall:
        lists += 1
    return Calibration(lists, signs, z * math.sqrt(2 - 2 * p.threshold), p.count)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and double-precision unit vector of every valid vector; nulls for the others."""
    for b in batches:
        keys, units = [], []
        for v in b.column(1).to_pylist():
            x = np.array(v, dtype=np.float64) if v and None not in v else np.empty(0)
            top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if not top:
                keys.append(None)
                units.append(None)
                continue
            keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
            units.append(((x / top) / np.linalg.norm(x / top)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "key", "unit"])


def _projections(cal: Calibration, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, units = b.column(0).to_numpy(), b.column(1).to_pylist()
            sizes = np.array([len(u) // 8 for u in units])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                if d not in axes:
                    axes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), cal.lists, cal.signs + 1))
                x = np.frombuffer(b"".join(units[i] for i in at)).reshape(len(at), int(d))
                y = np.einsum("nd,dls->nls", x, axes[d], optimize=True)
                bits = (y[:, :, 1:] > 0) @ (1 << np.arange(cal.signs, dtype=np.int64))
                # one number per (length, list, cell)
                cell = ((int(d) * cal.lists + np.arange(cal.lists)) << cal.signs) + bits
                yield pa.RecordBatch.from_pydict({"cell": cell.ravel(), "x": y[:, :, 0].ravel(), "id": np.repeat(ids[at], cal.lists)})
    return run


def _windows(half_width: float):
    def pairs(cell: np.ndarray, x: np.ndarray, i: np.ndarray, one: np.ndarray, two: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, step = np.arange(len(cell) - 1), 1
        while len(at):
            at = at[at + step < len(cell)]
            to = at + step
            near = (cell[at] == cell[to]) & (one[at] == one[to]) & (two[at] == two[to]) & (x[to] - x[at] <= half_width)
            at, to = at[near], to[near]
            emit = (one[at] == two[at]) | (block[at] != block[to])
            a, b = i[at[emit]], i[to[emit]]
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on in the next batch
            if cut:
                yield from pairs(*(c[:cut] for c in (cols[0], cols[3], cols[4], cols[1], cols[2], cols[5])))
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield from pairs(*(held[k] for k in (0, 3, 4, 1, 2, 5)))
    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = b.column(2).to_pylist(), b.column(3).to_pylist()
            cos = np.array([np.dot(np.frombuffer(s), np.frombuffer(t)) if len(s) == len(t) else -1.0 for s, t in zip(u, v)])
            keep = pa.array(cos >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(keep)
    return run


def links(classes: DataFrame, params: CollisionParams = CollisionParams()) -> DataFrame:
    """Pairs (a < b) of stored classes (id, unit) whose cosine reaches the threshold."""
    cal = calibrate(classes.count(), params)
    points = stored(map_arrow(classes.select("id", "unit"), _projections(cal, params.seed), "cell long, x double, id long"), "emb-points")
    crowd = points.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    placed = (points.join(crowd, "cell").withColumn("k", blocks)
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
              .select("cell", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "x", "id", "block"))
    order = ["cell", "one", "two", "x", "id"]
    met = map_arrow(placed.repartition("cell", "one", "two").sortWithinPartitions(*order), _windows(cal.half_width), "a long, b long")
    often = met.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= cal.count)
    left = often.join(classes.select(F.col("id").alias("a"), F.col("unit").alias("u")), "a")
    both = left.join(classes.select(F.col("id").alias("b"), F.col("unit").alias("v")), "b").select("a", "b", "u", "v")
    return stored(map_arrow(both, _verify(params.threshold), "a long, b long"), "emb-links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    params: CollisionParams = CollisionParams()) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = stored(map_arrow(source, _classes, "vec_id long, key binary, unit binary"), "emb-rows")
    classes = stored(rows.where("key is not null and vec_id is not null").groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("unit").alias("unit")), "emb-classes")
    found = links(classes, params)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("id").alias("b"), "size")
    linked = both.join(size, "b").groupBy("a").agg(F.sum("size").alias("more"))
    named = (classes.join(linked, F.col("id") == F.col("a"), "left").drop("a")
             .join(components(found).withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left")
             .select("key", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("label", "id").alias("component_id")))
    return rows.drop("unit").join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
