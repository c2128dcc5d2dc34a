"""Spelling variants: words one edit apart, found through asymmetric chunks.

A word of L code points contributes two disjoint chunks, its first L // 2 code points and the
rest; words of L and of L + 1 code points contribute their positional grams of those lengths.
One edit between two words (the shorter one gives the chunks) lies in one chunk, so the other is
a gram of the second word, at the chunk's own place or shifted by one.  Grams that no chunk can
meet within that shift aren't sent.  Rows that share (length, place, chunk) meet in one task and
are verified on all their code points.

Where many words share a chunk, the chunk rule is applied again to the part that may still
differ: the edit lies in one half of it, the other half joins the key.  Groups over
``most_rows`` are divided so by Spark, in rounds; smaller ones inside the task.  A part of one
code point can't be divided further, but then a group holds fewer words than the square of the
alphabet.  No pair is lost, and each is counted once: equally long words in the part that holds
the differing place, others in the part where their common prefix ends.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acqlens.llm.common import map_arrow, mix64, powers, stored

LETTERS = "A-Za-zÀ-ÿ"
_FLUSH = 300_000  # distinct words a task holds before it hands its counts on
_LONG = 1 << 22
_FEW = 48  # groups up to this size are compared directly


def _count(shortest: int, typo_mod: int | None):
    run = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def lowered(w: str) -> str:  # A-Z only
        return w.lower() if w.isascii() else w.encode("latin-1").lower().decode("latin-1")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found = Counter(run.findall(text) if len(text) < _LONG else (m.group() for m in run.finditer(text)))
                of_id = zlib.crc32(f"{id_.as_py() if id_.is_valid else ''}:".encode())
                for w, n in found.items():
                    w = lowered(w)
                    if typo_mod:
                        h = zlib.crc32(w.encode(), of_id)
                        if h % typo_mod == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < shortest:
                                continue
                    held[w] += n
                if len(held) > _FLUSH:
                    yield out()
        if held:
            yield out()
    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, at_least: int = 2,
                typo_mod: int | None = None) -> DataFrame:
    """(word, n) over all texts: maximal runs of letters, A-Z lower-cased, of ``shortest`` code
    points or more that occur ``at_least`` times.

    ``typo_mod`` plants typing errors: with h the crc32 of ``<id>:<word>``, a word loses its code
    point h % length in the documents where typo_mod divides h.  Null and empty texts have no
    words, a null id counts as an empty one, repeated rows count again.
    """
    counted = map_arrow(docs.select(F.col(id_col).cast("string"), F.col(text_col)), _count(shortest, typo_mod), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def _key(length: Column, lo: Column, hi: Column, longer: Column) -> Column:
    """Hash of the chunk outside [lo, hi) of the shorter word; [lo, hi + longer) of this one."""
    return F.xxhash64(length, lo, hi, F.expr("left(word, lo)"), F.expr("substring(word, hi + longer + 1)"))


def _keyed(parts: DataFrame) -> DataFrame:
    return parts.withColumn("key", _key(F.col("length"), F.col("lo"), F.col("hi"), F.col("longer")))


def _divided(rows: DataFrame) -> DataFrame:
    """Each row once for either half of its part [lo, hi)."""
    halves = F.expr("array(named_struct('lo', lo, 'hi', (lo + hi) div 2), named_struct('lo', (lo + hi) div 2, 'hi', hi))")
    return _keyed(rows.withColumn("half", F.explode(halves)).select("word", "n", "length", "longer", "half.lo", "half.hi"))


def _rows(counts: DataFrame) -> DataFrame:
    """Chunk and gram rows: a word as the shorter or equal one, and as the longer one."""
    whole = F.expr("explode(array(named_struct('length', length(word), 'longer', 0), named_struct('length', length(word) - 1, 'longer', 1)))")
    both = counts.select("word", "n", whole.alias("as")).select("word", "n", "as.length", "as.longer", F.lit(0).alias("lo"), F.col("as.length").alias("hi"))
    return _divided(both.where("length > 0"))


class _Run:
    """Words of ``length`` (and, ``longer``, of one more) code points whose edit lies in [lo, hi),
    in groups that share the rest; per word its near words are counted and the best one kept."""

    def __init__(self, words: list[str], n: np.ndarray, length: int, longer: np.ndarray, lo: int, hi: int, group: np.ndarray):
        self.words, self.n, self.length, self.longer = words, n, length, longer
        size = length + 1
        chars = np.zeros((len(words), size), dtype=np.uint32)
        for of, take in ((longer == 0, length), (longer == 1, size)):
            at = np.flatnonzero(of)
            if len(at):
                chars[at, :take] = np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le"), dtype=np.uint32).reshape(len(at), take)
        self.chars = chars.astype(np.uint8) if chars.max(initial=0) < 256 else chars
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        up, self.down = powers(size + 1)
        self.prefix = np.zeros((len(words), size + 1), dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[:size], axis=1, out=self.prefix[:, 1:])
        self.near = np.zeros(len(words), dtype=np.int64)
        self.best = np.full(len(words), -1, dtype=np.int64)
        self._within(np.arange(len(words)), group, lo, hi)

    def _within(self, rows: np.ndarray, group: np.ndarray, lo: int, hi: int) -> None:
        order = np.lexsort((self.longer[rows], group))
        rows, group = rows[order], group[order]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        size = np.diff(edge)
        usable = (size > 1) & (self.longer[rows[edge[:-1]]] == 0)  # without a shorter word there is no pair
        direct = usable & ((size <= _FEW) | (hi - lo <= 1))
        self._compare(rows, edge[:-1][direct], edge[1:][direct], lo, hi)
        crowded = np.repeat(usable & ~direct, size)
        if crowded.any():
            rows, group = rows[crowded], group[crowded]
            mid, shift = (lo + hi) // 2, self.longer[rows]
            for start, end, by, part in ((lo, mid, 0 * shift, (mid, hi)), (mid, hi, shift, (lo, mid))):
                kept = (self.prefix[rows, end + by] - self.prefix[rows, start + by]) * self.down[start + by]
                self._within(rows, mix64(group * np.uint64(0xD6E8FEB86659FD93) + mix64(kept)), *part)

    def _compare(self, rows: np.ndarray, first: np.ndarray, end: np.ndarray, lo: int, hi: int) -> None:
        """All pairs (shorter or equal, other) of the groups rows[first:end], some at a time."""
        sizes = end - first
        if not len(sizes):
            return
        at = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        at, ends = (x[self.longer[rows[at]] == 0] for x in (at, np.repeat(end, sizes)))
        later = ends - at - 1
        done = np.concatenate(([0], np.cumsum(later)))
        most = max(1, (1 << 23) // (self.length + 1))
        a = 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(done, done[a] + most, "right")) - 1)
            i = np.repeat(at[a:z], later[a:z])
            j = i + 1 + np.arange(done[z] - done[a]) - np.repeat(done[a:z] - done[a], later[a:z])
            self._verify(rows[i], rows[j], lo, hi)
            a = z

    def _verify(self, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> None:
        m, found = self.length, []
        for longer in (0, 1):
            of = self.longer[j] == longer
            x, y = i[of], j[of]
            if not len(x):
                continue
            a, b = self.chars[x, :m], self.chars[y]
            differ = a != b[:, :m]
            prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), m)
            if longer:
                shifted = (a != b[:, 1:])[:, ::-1]
                suffix = np.where(shifted.any(axis=1), shifted.argmax(axis=1), m)
                near = (prefix + suffix >= m) & (prefix >= lo) & ((prefix < hi) | (hi == m))
            else:
                near = (differ.sum(axis=1) == 1) & (prefix >= lo) & (prefix < hi)
            found += [(x[near], y[near]), (y[near], x[near])]
        if not found:
            return
        of, other = (np.concatenate(side) for side in zip(*found))
        if not len(of):
            return
        self.near += np.bincount(of, minlength=len(self.near))
        order = np.lexsort((self.rank[other], -self.n[other], of))
        of, other = of[order], other[order]
        head = np.concatenate(([True], of[1:] != of[:-1]))
        of, other = of[head], other[head]
        held = self.best[of]
        better = (held < 0) | (self.n[other] > self.n[held]) | ((self.n[other] == self.n[held]) & (self.rank[other] < self.rank[held]))
        self.best[of[better]] = other[better]

    def table(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.near)
        return pa.record_batch([
            pa.array([self.words[i] for i in some], pa.string()), pa.array(self.near[some]),
            pa.array(self.n[self.best[some]]), pa.array([self.words[i] for i in self.best[some]], pa.string())],
            ["word", "n_near", "best_n", "best"])


def _meet(cells: int):
    """Batches sorted by (length, lo, hi, key), worked through in runs of whole groups."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.table(batch.columns, batch.schema.names) if held is None else pa.concat_tables([held, pa.table(batch.columns, batch.schema.names)])
            if held.num_rows and held.num_rows * (int(held["length"][-1].as_py()) + 2) >= cells:
                key = held["key"].to_numpy()
                cut = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
                yield from runs(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield from runs(held)

    def runs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        part = np.stack([rows[c].to_numpy() for c in ("length", "lo", "hi")])
        edge = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
        for a, z in zip(edge, islice(edge, 1, None)):
            some, (length, lo, hi) = rows.slice(a, z - a), part[:, a].tolist()
            made = _Run(some["word"].to_pylist(), some["n"].to_numpy(), length, some["longer"].to_numpy(), lo, hi, some["key"].to_numpy().astype(np.int64).view(np.uint64)).table()
            if made.num_rows:
                yield made
    return meet


def variants(counts: DataFrame, ratio: int = 10, most_rows: int = 20_000, cells: int = 2_000_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of distinct words.

    Words are near if they differ by one inserted, deleted or replaced code point; n_near counts
    them.  ``form`` is the near word of largest n (ties: the smallest in code-point order) where
    that n is ``ratio`` times the word's own or more, else null; ``root`` follows forms to the
    last.  An empty word has no chunk and no near words.  An empty table gives an empty one.

    ``most_rows``: groups above it are divided by Spark.  ``cells``: code points that a task
    compares at a time.  Plan-time actions: one small count per round.
    """
    counts = stored(counts.select("word", "n"), "spelling-counts")
    ready, rows = [], _rows(counts)
    while True:
        crowded = stored(rows.groupBy("key").count().where(F.col("count") > most_rows).select("key"), "spelling-crowded")
        if not crowded.limit(1).count():
            break
        divisible = F.col("hi") - F.col("lo") > 1
        ready += [rows.join(crowded, "key", "left_anti"), rows.where(~divisible).join(crowded, "key", "left_semi")]
        rows = _divided(rows.where(divisible).join(crowded, "key", "left_semi").select(*rows.columns))
        rows = stored(rows, "spelling-divided")
    for more in ready:
        rows = rows.unionByName(more.select(*rows.columns))
    dealt = rows.select("length", "lo", "hi", "key", "longer", "word", "n").repartition("key").sortWithinPartitions("length", "lo", "hi", "key")
    met = map_arrow(dealt, _meet(cells), "word string, n_near long, best_n long, best string")
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), "best"))
    nothing = counts.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    judged = met.withColumn("n", F.lit(None).cast("long")).unionByName(nothing).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("top"))
    has = -F.col("top.minus") >= ratio * F.col("n")
    formed = stored(judged.select("word", F.when(has, F.col("top.best")).alias("form"), "n", "n_near",
                                  F.when(has, -F.col("top.minus")).alias("form_n")), "spelling-forms")
    roots = formed.join(_roots(formed.where("form is not null").select("word", F.col("form").alias("root"))), "word", "left")
    return roots.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """Last word of each chain; lengths double each round, and n grows along a chain, so it ends."""
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        steps = after.select("word", "root")
