"""Histogram gradient boosting: quantile bins stored once, at most one Spark job per tree level.

The training rows are turned into blocks of bin codes (one byte per feature and row) and written
once; the margins of the trees grown so far travel with them.  Each tree is added to the margins
once, in blocks kept by the executors, and every ``refresh`` trees to a written table, so a lost
executor costs a re-read and at most ``refresh`` trees of arithmetic per row.  A job is one
aggregate: every task adds its blocks' gradients and Hessians into (node, feature, bin) sums, these
arrays, whose size follows from the parameters alone, are added up by tasks for a few nodes each,
and the same tasks pick the split of each node by its second-order gain.  The driver gets a split
and six sums per node, whatever the number of tasks, and leaf values come from these.

A job asks for several levels at once: the driver guesses the splits below the open nodes from a
sample of at most ``guess_rows`` rows, and the job sums all nodes of the guessed tree over all rows.
A guess that the full sums confirm has its children's sums already; below one that they don't, the
next job asks again.  A level whose guesses mostly fail is guessed no more.  So the trees are those
of one job per level, the sample only saves jobs.

Bins are weighted quantiles: the distinct values of all features are ranked together by
``ranks.value_ranks`` and cut at equal shares of the weight.  Bin 0 holds nulls and NaNs, which
always go left.  The block jobs are RDD jobs: a level is far too short for a query's planning.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acqlens.operators import ranks
from acqlens.session import scratch_path, ship

BLOCK_ROWS = 65_536
FILE_ROWS = 2 * BLOCK_ROWS
FAN_IN = 32  # arrays of a node summed by one task
NODES = 8  # nodes whose sums meet in one task
GUESS_TRIALS = 5
MIN_GAIN = 1e-9


@dataclass(frozen=True)
class BoostParams:
    """``kind``: classifier (logistic loss on labels 0/1) or regressor (squared loss)."""

    kind: str = "classifier"
    trees: int = 200
    depth: int = 6
    step: float = 0.1
    bins: int = 64           # bin 0, for missing values, included; at most 256
    l2: float = 1.0
    min_child_weight: float = 1.0
    refresh: int = 20
    guess_rows: int = 65_536

    def __post_init__(self):
        if not 2 <= self.bins <= 256 or self.kind not in ("classifier", "regressor"):
            raise ValueError(f"bad parameters: {self}")


@dataclass
class Tree:
    """A complete binary tree by heap order: children of node i are 2i + 1 and 2i + 2.  ``feature``
    is -1 at leaves; a row goes left where its value is missing or at most ``threshold``."""

    feature: np.ndarray
    code: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32), *(np.zeros(n) for _ in range(4)))

    def leaves(self, columns, cut: np.ndarray, rows: int) -> np.ndarray:
        """Node of each row as far as the tree is grown; columns[f] holds feature f of all rows."""
        node = np.zeros(rows, dtype=np.int32)
        todo = np.arange(rows)
        while len(todo):
            at = node[todo]
            split = self.feature[at] >= 0
            todo, at = todo[split], at[split]
            if not len(todo):
                break
            x = columns[self.feature[at], todo]
            node[todo] = 2 * at + np.where(x > cut[at], 2, 1)  # false for NaN: left
        return node


def gradients(kind: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted loss by the margin."""
    if kind == "classifier":
        p = 1.0 / (1.0 + np.exp(-margin))
        return w * (p - y), w * p * (1.0 - p)
    return w * (margin - y), w


def best_splits(sums: np.ndarray, p: BoostParams) -> dict[str, np.ndarray]:
    """Best split per node from sums[node, feature, bin, (gradient, Hessian)]; gain <= 0: none.
    Ties go to the smallest feature and bin."""
    total = sums[:, 0].sum(axis=1)
    left = sums.cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left

    def score(s):
        return s[..., 0] ** 2 / (s[..., 1] + p.l2)

    gain = score(left) + score(right) - score(total)[:, None, None]
    gain = np.where((left[..., 1] >= p.min_child_weight) & (right[..., 1] >= p.min_child_weight), gain, -np.inf)
    flat = gain.reshape(len(sums), -1)
    at = flat.argmax(axis=1)
    feature, code = np.divmod(at, gain.shape[2])
    node = np.arange(len(sums))
    return {"feature": feature, "code": code, "gain": flat[node, at], "total": total, "left": left[node, feature, code], "right": right[node, feature, code]}


# --- bins and blocks -------------------------------------------------------------------------
def quantile_edges(train: DataFrame, features: list[str], bins: int, weight: str | None = None) -> list[np.ndarray]:
    """Upper edges of the bins 1, 2, ... of each feature, by equal shares of the weight; the last
    bin is open.  A value that alone exceeds a share has a bin of its own."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = train.select(w.alias("w"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).unpivot(
        ["w"], [f"x{i}" for i in range(len(features))], "feature", "x").where("not isnan(x)")
    r = ranks.value_ranks(long, "x", ["feature"], weight_col="w")
    share = F.least(F.floor((F.col("before") + F.col("cnt") / 2) / F.col("n") * (bins - 1)), F.lit(bins - 2))
    found = r.groupBy("feature", share.alias("bin")).agg(F.max("x").alias("edge")).collect()  # features x bins
    out = []
    for i in range(len(features)):
        edges = sorted(row["edge"] for row in found if row["feature"] == f"x{i}")
        out.append(np.array(edges[:-1], dtype=np.float64))
    return out


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]) if names else np.zeros((0, batch.num_rows))


def _encode(edges: list[np.ndarray], base: float):
    names = [f"x{i}" for i in range(len(edges))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            x, y, w = (np.concatenate(c, axis=-1) for c in zip(*held))
            codes = np.stack([np.where(np.isnan(v), 0, np.searchsorted(e, v) + 1).astype(np.uint8) for v, e in zip(x, edges)])
            return pa.record_batch([pa.array([c], pa.binary()) for c in (codes.tobytes(), y.tobytes(), w.tobytes(), np.full(len(y), base).tobytes())],
                                   ["codes", "y", "w", "margin"])

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                held.append((_columns(part, names), *_columns(part, ["y", "w"])))
                size += part.num_rows
                if size >= BLOCK_ROWS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()
    return run


def _opened(block, trees: list[Tree], n_features: int) -> tuple[np.ndarray, ...]:
    """Codes, labels, weights and margins of a block, with ``trees`` added to the margins."""
    y, w, margin = (np.frombuffer(block[c]) for c in ("y", "w", "margin"))
    codes = np.frombuffer(block["codes"], dtype=np.uint8).reshape(n_features, len(y))
    for t in trees:
        margin = margin + t.value[t.leaves(codes, t.code, len(y))]
    return codes, y, w, margin


def _node_sums(p: BoostParams, codes: np.ndarray, g: np.ndarray, h: np.ndarray, tree: Tree, asked: np.ndarray) -> np.ndarray:
    """sums[node, feature, bin, (gradient, Hessian)] of the ``asked`` nodes, level by level."""
    place = np.full(len(tree.feature), -1)
    place[asked] = np.arange(len(asked))
    out = np.zeros((len(asked), len(codes), p.bins, 2))
    node, rows = np.zeros(len(g), dtype=np.int32), np.arange(len(g))
    for _ in range(p.depth):
        at = place[node]
        some = np.flatnonzero(at >= 0)
        if len(some):
            first = at[some].min()  # the nodes of a level lie together in the sorted ``asked``
            count = at[some].max() - first + 1
            cell, of = (at[some] - first) * p.bins, rows[some]
            for f in range(len(codes)):
                idx = cell + codes[f, of]
                for k, v in enumerate((g, h)):
                    out[first : first + count, f, :, k] += np.bincount(idx, v[of], count * p.bins).reshape(count, p.bins)
        split = tree.feature[node] >= 0
        node, rows = node[split], rows[split]
        if not len(node):
            break
        node = 2 * node + np.where(codes[tree.feature[node], rows] > tree.code[node], 2, 1)
    return out


def _job_sums(p: BoostParams, n_features: int, tree: Tree, asked: np.ndarray):
    """A partition's sums of the ``asked`` nodes, as (share of the nodes, (partition, sums))."""
    def run(index: int, blocks) -> Iterator[tuple]:
        sums = None
        for block in blocks:
            codes, y, w, margin = _opened(block, [], n_features)
            mine = _node_sums(p, codes, *gradients(p.kind, margin, y, w), tree, asked)
            sums = mine if sums is None else sums + mine
        if sums is not None:
            for share in range(_shares(asked)):
                yield share, (index, sums[share * NODES : (share + 1) * NODES])
    return run


def _shares(asked: np.ndarray) -> int:
    return -(-len(asked) // NODES)


def _job_splits(p: BoostParams):
    def run(shares) -> Iterator[tuple]:
        for share, (_, sums) in shares:
            yield share, best_splits(sums, p)
    return run


def _sampled(n_features: int, share: float):
    def run(blocks) -> Iterator[tuple]:
        for k, block in enumerate(blocks):
            codes, y, w, margin = _opened(block, [], n_features)
            some = np.random.default_rng(k).random(len(y)) < share
            yield codes[:, some], y[some], w[some], margin[some]
    return run


def _guessed(p: BoostParams, tree: Tree, open_: np.ndarray, codes: np.ndarray, g: np.ndarray, h: np.ndarray, record: np.ndarray) -> tuple[Tree, np.ndarray]:
    """``tree`` with guessed splits below the ``open_`` nodes, and the nodes to ask for.
    ``record`` has per level how many times it was guessed and how many times rightly."""
    guess, nodes, asked = Tree(*(v.copy() for v in tree.__dict__.values())), open_, []
    worth = (record[:, 0] < GUESS_TRIALS) | (2 * record[:, 1] >= record[:, 0])
    while len(nodes):
        asked.append(nodes)
        nodes = nodes[worth[_level(nodes)]]
        if not len(nodes):
            break
        found = best_splits(_node_sums(p, codes, g, h, guess, nodes), p)
        good = found["gain"] > MIN_GAIN
        parents = nodes[good]
        guess.feature[parents], guess.code[parents] = found["feature"][good], found["code"][good]
        nodes = _inner(np.concatenate((2 * parents + 1, 2 * parents + 2)), p)
    return guess, np.sort(np.concatenate(asked))


def _level(nodes: np.ndarray) -> np.ndarray:
    return np.log2(nodes + 1).astype(int)


def _inner(nodes: np.ndarray, p: BoostParams) -> np.ndarray:
    """Those of ``nodes`` that may be split, that is, above the last level."""
    return nodes[nodes < 2**p.depth - 1]


def _added(tree: Tree, n_features: int):
    def run(block: dict) -> dict:
        return {**block, "margin": _opened(block, [tree], n_features)[3].tobytes()}
    return run


def _advance(trees: list[Tree], n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            margins = [_opened(r, trees, n_features)[3].tobytes() for r in rows]
            yield pa.record_batch([*(batch.column(c) for c in ("codes", "y", "w")), pa.array(margins, pa.binary())], ["codes", "y", "w", "margin"])
    return run


_BLOCK_SCHEMA = "codes binary, y binary, w binary, margin binary"


def _stored(df: DataFrame, name: str):
    """The blocks written to the shared folder, and an RDD of them kept by the executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    blocks = df.sparkSession.read.schema(df.schema).parquet(path)
    return blocks, blocks.rdd.map(lambda r: r.asDict()).persist(StorageLevel.MEMORY_AND_DISK)


# --- the model -------------------------------------------------------------------------------
@dataclass
class BoostedTrees:
    features: list[str]
    params: BoostParams
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, *columns: Column | str) -> Column:
        """Margin of rows given as one numeric column per feature."""
        trees, base = self.trees, self.base
        ship(SparkSession.active())

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for xs in batches:
                x = np.stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in xs])
                out = np.full(x.shape[1], base)
                for t in trees:
                    out += t.value[t.leaves(x, t.threshold, x.shape[1])]
                yield pd.Series(out)

        return score(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns])

    def importances(self) -> list[tuple[str, float]]:
        """Share of the total gain per feature."""
        gain = np.zeros(len(self.features))
        for t in self.trees:
            split = t.feature >= 0
            np.add.at(gain, t.feature[split], t.gain[split])
        return list(zip(self.features, (gain / (gain.sum() or 1.0)).tolist()))

    def save(self, spark, path: str) -> None:
        rows = [(k, i, int(t.feature[i]), int(t.code[i]), float(t.threshold[i]), float(t.value[i]), float(t.gain[i]), float(t.cover[i]))
                for k, t in enumerate(self.trees) for i in range(len(t.feature)) if t.feature[i] >= 0 or t.value[i] or t.cover[i]]
        schema = "tree int, node int, feature int, code int, threshold double, value double, gain double, cover double"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        about = json.dumps({"features": self.features, "params": asdict(self.params), "base": self.base, "trees": len(self.trees)})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> BoostedTrees:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        params = BoostParams(**about["params"])
        trees = [Tree.empty(params.depth) for _ in range(about["trees"])]
        for r in spark.read.parquet(f"{path}/trees").collect():  # bounded by the parameters
            t = trees[r["tree"]]
            for c in ("feature", "code", "threshold", "value", "gain", "cover"):
                getattr(t, c)[r["node"]] = r[c]
        return cls(about["features"], params, about["base"], trees)


def fit(train: DataFrame, features: list[str], label: str, params: BoostParams = BoostParams(), weight: str | None = None) -> BoostedTrees:
    """Boosted trees on numeric ``features``; rows without a label are left out.

    An empty table gives a model without trees.  Equal partitions give equal models; the order in
    which tasks end doesn't matter, other partitions change the last bits of the sums.
    """
    p, d = params, len(features)
    spark = train.sparkSession
    ship(spark)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = train.where(F.col(label).isNotNull()).select(
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), w.alias("w"))
    total = data.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.count("*").alias("n")).first()
    if not total["w"] or not d:
        return BoostedTrees(list(features), p, 0.0)
    mean = total["wy"] / total["w"]
    base = mean
    if p.kind == "classifier":
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        base = float(np.log(mean / (1 - mean)))
    edges = quantile_edges(data, [f"x{i}" for i in range(d)], p.bins, "w")
    # files of some size: a task's time should be in its rows, and each task has sums of its own
    data = data.coalesce(-(-total["n"] // FILE_ROWS))
    frame, blocks = _stored(data.mapInArrow(_encode(edges, base), _BLOCK_SCHEMA), "boost-blocks")
    share = min(1.0, p.guess_rows / max(1, total["n"]))
    codes, y, w, margin = (np.concatenate(c, axis=-1) for c in zip(*blocks.mapPartitions(_sampled(d, share)).collect()))
    w = w / share
    model, pending, old, record = BoostedTrees(list(features), p, base), [], None, np.zeros((p.depth, 2), dtype=int)
    for _ in range(p.trees):
        if len(pending) == p.refresh:
            last = blocks
            frame, blocks = _stored(frame.mapInArrow(_advance(pending, d), _BLOCK_SCHEMA), "boost-blocks")
            last.unpersist()
            pending = []
        tree, open_ = Tree.empty(p.depth), np.array([0])
        g, h = gradients(p.kind, margin, y, w)
        while len(open_):
            guess, asked = _guessed(p, tree, open_, codes, g, h, record)
            shares = _summed((blocks.mapPartitionsWithIndex(_job_sums(p, d, guess, asked)), _shares(asked)))
            parts = [f for _, f in sorted(shares.mapPartitions(_job_splits(p)).collect(), key=lambda r: r[0])]
            found = {c: np.concatenate([f[c] for f in parts]) for c in parts[0]}
            open_ = _settled(p, tree, guess, open_, asked, found, edges, record)
            if old is not None:  # the job has made the blocks that follow
                old.unpersist()
                old = None
        model.trees.append(tree)
        pending.append(tree)
        margin = margin + tree.value[tree.leaves(codes, tree.code, len(y))]
        if len(pending) < p.refresh:
            old, blocks = blocks, blocks.map(_added(tree, d)).persist(StorageLevel.MEMORY_AND_DISK)
    for b in (old, blocks):
        if b is not None:
            b.unpersist()
    return model


def _summed(parts):
    """The partitions' arrays of each share of the nodes, added in the partitions' order, as an RDD;
    ``parts`` is the RDD of :func:`_job_sums` and the number of shares.  At most FAN_IN arrays of a
    share meet in a task; with more partitions, their sums are added up in the same way."""
    sums, shares = parts
    left = sums.getNumPartitions()
    while left > 1:
        fan, left = FAN_IN, -(-left // FAN_IN)
        keyed = sums.map(_keyed(fan, left))
        sums = keyed.partitionBy(shares * left, int).mapPartitions(_reduced(left))
    return sums


def _keyed(fan: int, groups: int):
    return lambda r: (r[0] * groups + r[1][0] // fan, r[1])


def _reduced(groups: int):
    def run(rows) -> Iterator[tuple]:
        held: dict[int, list] = {}
        for key, part in rows:
            held.setdefault(key, []).append(part)
        for key, some in held.items():
            yield key // groups, (key % groups, np.add.reduce([s for _, s in sorted(some, key=lambda part: part[0])]))
    return run


def _settled(p: BoostParams, tree: Tree, guess: Tree, nodes: np.ndarray, asked: np.ndarray, splits: dict[str, np.ndarray], edges: list[np.ndarray], record: np.ndarray) -> np.ndarray:
    """Splits of ``nodes`` and, where a guess holds, of the nodes below, from the ``splits`` of the
    ``asked`` nodes; returns the nodes still to be asked for."""
    left_open = []
    while len(nodes):
        found = {c: v[np.searchsorted(asked, nodes)] for c, v in splits.items()}
        good = found["gain"] > MIN_GAIN
        tree.cover[nodes] = found["total"][:, 1]
        tree.value[nodes] = -p.step * found["total"][:, 0] / (found["total"][:, 1] + p.l2)
        parents = nodes[good]
        tree.feature[parents], tree.code[parents], tree.gain[parents] = (found[c][good] for c in ("feature", "code", "gain"))
        tree.threshold[parents] = [_edge(edges[f], c) for f, c in zip(found["feature"][good], found["code"][good])]
        for side, name in ((1, "left"), (2, "right")):
            s = found[name][good]
            tree.value[2 * parents + side] = -p.step * s[:, 0] / (s[:, 1] + p.l2)
            tree.cover[2 * parents + side] = s[:, 1]
        held = (tree.feature[parents] == guess.feature[parents]) & (tree.code[parents] == guess.code[parents])
        for level in np.unique(_level(parents[guess.feature[parents] >= 0])):
            record[level] += 1, held[_level(parents) == level].all()
        below = [_inner(np.concatenate((2 * of + 1, 2 * of + 2)), p) for of in (parents[held], parents[~held])]
        left_open.append(below[1])
        nodes = below[0]
    return np.concatenate(left_open)


def _edge(edges: np.ndarray, code: int) -> float:
    """Largest value of bins 0..code."""
    return -np.inf if code == 0 else float(edges[code - 1]) if code <= len(edges) else np.inf
