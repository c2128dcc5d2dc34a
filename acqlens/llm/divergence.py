"""Source divergence audit: how a source's terms differ from other sources and from its language.

Each term of a language is a row of its nonzero counts, ordered by source.  Rows go into a
frequent-pattern tree: equal rows are one path with a multiplicity, and rows with equal beginnings
share nodes.  With p(a, c) the share of a term that source ``a`` has c times, the sum of a
divergence f over all terms is V * f(p(a, 0), p(b, 0)), plus a correction for each count of ``a``
or ``b`` alone, plus one for each pair of counts that meet in a row.  The last are taken once for
each (node, ancestor) of the tree, times the node's multiplicity, whatever the number of rows below.

Rows are range-sorted by (language, row), so that a task's rows share beginnings; every task
builds the trees of its own rows, some at a time.  A path that lies in two trees is counted in
both with its own multiplicities, which add up.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acqlens.llm.common import map_arrow, stored

SCALE = 1_000_000_000
_FLUSH = 500_000  # distinct (group, term) a task holds before it hands its counts on
_NODES = 100_000  # items of rows in one tree
_LOW = 32  # corrections are summed as high and low halves, exact for up to 2**31 terms a task


# UTF-8 bytes: letters of ASCII lower-cased, bytes of other characters kept, the rest blanks
_LETTERS = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: defaultdict = defaultdict(lambda: (Counter(), Counter()))  # (lang, source) -> occurrences and documents of each term
    names = ["lang", "source", "term", "n", "docs"]

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(n.values(), pa.int64(), size=len(terms)), pa.array([docs[t] for t in terms], pa.int64())], names)
        held.clear()

    seen = set()
    size = 0
    for batch in batches:
        for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            group = lang or "", source or ""
            seen.add(group)
            text = text.as_py()
            if not text:
                continue
            n, docs = held[group]
            before = len(n)
            terms = text.translate(_LETTERS).split()
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size > _FLUSH:
                yield from out()
                size = 0
    yield from out()
    if seen:
        langs, sources = zip(*seen)
        nothing = pa.array([0] * len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array([None] * len(seen), pa.string()), nothing, nothing], names)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and documents that have
    it.  Every group has a row with a null term besides.  All rows of a language's term lie in one
    partition."""
    counted = map_arrow(docs.select(text_col, lang_col, source_col), _count, "lang string, source string, term string, n long, docs long")
    return counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    return F.expr(f"1 + ({SCALE} * ({n} + 1)) div ({total} + {terms})")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, items: [(source, share, share of nothing)] by source, terms), sorted by lang and
    items, into corrections (lang, a, b, high, low) of f(a, b)."""
    known: dict[tuple, dict] = {}  # equal items are one object, made once

    def rows() -> Iterator[tuple]:
        for batch in batches:
            items = batch.column("items")
            fields = (items.values.field(name).to_pylist() for name in ("source", "p", "zero"))
            flat = [known.get(x) or known.setdefault(x, dict(zip(("source", "p", "zero"), x))) for x in zip(*fields)]
            cuts = items.offsets.to_pylist()
            yield from zip(batch.column("lang").to_pylist(), (flat[a:z] for a, z in zip(cuts, cuts[1:])), batch.column("terms").to_pylist())
            if len(known) > _NODES:
                known.clear()

    held: list[tuple] = []
    size, lang = 0, None
    for row in rows():
        if held and (row[0] != lang or size >= _NODES):
            yield _corrections(lang, held)
            held, size = [], 0
        lang = row[0]
        held.append(row)
        size += len(row[1])
    if held:
        yield _corrections(lang, held)


class Tree:
    """Frequent-pattern tree of sorted rows: parent, item and multiplicity of each node."""

    def __init__(self, rows: list[tuple[list, int]]):
        self.items: list = []
        parent, times, path, before = [], [], [], []
        for items, n in rows:
            same = 0
            for x, y in zip(items, before):
                if x is not y and x != y:
                    break
                same += 1
            del path[same:]
            for at in path:
                times[at] += n
            for item in items[same:]:
                parent.append(path[-1] if path else -1)
                path.append(len(self.items))
                self.items.append(item)
                times.append(n)
            before = items
        self.parent, self.times = np.array(parent, dtype=np.int64), np.array(times, dtype=np.int64)

    def node_ancestors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, their k-th ancestors) for k = 1, 2, ... as far as any has one."""
        node, up = np.arange(len(self.parent)), self.parent
        while True:
            has = up >= 0
            node, up = node[has], up[has]
            if not len(node):
                return
            yield node, up
            up = self.parent[up]


def _corrections(lang: str, rows: list[tuple]) -> pa.RecordBatch:
    tree = Tree([(items, n) for _, items, n in rows])
    names = sorted({i["source"] for i in tree.items})
    number = {s: k for k, s in enumerate(names)}
    source = np.array([number[i["source"]] for i in tree.items])
    p, zero = (np.array([i[c] for i in tree.items], dtype=np.int64) for c in ("p", "zero"))

    def f(x, y):
        return (x - y) * (x - y) // y

    high: defaultdict = defaultdict(int)
    low: defaultdict = defaultdict(int)
    for node, up in tree.node_ancestors():
        times = tree.times[node]
        for a, b in ((node, up), (up, node)):
            more = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
            pair = source[a] * len(names) + source[b]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            tops = np.add.reduceat((times * (more >> _LOW))[order], head)
            rest = np.add.reduceat((times * (more & ((1 << _LOW) - 1)))[order], head)
            for k, t, r in zip(pair[head].tolist(), tops.tolist(), rest.tolist()):
                high[k] += t
                low[k] += r
    keys = list(high)
    return pa.record_batch([
        pa.array([lang] * len(keys), pa.string()), pa.array([names[k // len(names)] for k in keys], pa.string()),
        pa.array([names[k % len(names)] for k in keys], pa.string()), pa.array([high[k] for k in keys], pa.int64()),
        pa.array([low[k] for k in keys], pa.int64())], ["lang", "a", "b", "high", "low"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", at_least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    A language keeps its terms of ``at_least`` documents or more.  Part ``pair``: each other source
    of the language, value the sum of f over all kept terms; part ``term``: the ``top`` kept terms
    that the source has, with a larger share than the language.  Null texts, languages and sources
    are read as ''.  Repeated rows count again; empty and very long texts need no care; an empty
    table gives no rows.  Ties of value are ordered by item.
    """
    counts = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    counts = stored(counts.where((F.col("docs") >= at_least) | F.col("term").isNull()).select("lang", "term", "n", "sources"), "audit-kept")
    kept = counts.where("term is not null")
    occur = counts.where("term is null").select("lang", F.explode("sources.source").alias("source"))  # every group
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    one = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("s")).select("lang", "term", "lang_n", "s.source", "s.n")
    totals = one.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(occur.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
        .withColumn("zero", F.when(F.col("v") > 0, _share("0", "total", "v"))), "audit-groups")

    shared = one.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    terms = shared.withColumn("q", _share("lang_n", "lang_total", "v")).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    exact = "decimal(38,0)"
    alone = shared.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    met = alone.join(other, "lang").where("source <> other").select("lang", "source", "other", F.explode(F.expr(
        f"array(named_struct('a', source, 'b', other, 'more', {_f('p', 'other_zero')} - {_f('zero', 'other_zero')}),"
        f" named_struct('a', other, 'b', source, 'more', {_f('other_zero', 'p')} - {_f('other_zero', 'zero')}))")).alias("x"), "terms")
    single = met.select("lang", "x.a", "x.b", (F.col("x.more").cast(exact) * F.col("terms")).cast(exact).alias("value"))
    rows = shared.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("items")).where(
        F.size("items") > 1).groupBy("lang", "items").agg(F.count("*").alias("terms"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(tasks, "lang", "items").sortWithinPartitions("lang", "items")
    double = map_arrow(sorted_, _pairs, "lang string, a string, b string, high long, low long").select(
        "lang", "a", "b", (F.col("high").cast(exact) * F.lit(1 << _LOW).cast("decimal(11,0)") + F.col("low")).cast(exact).alias("value"))
    ground = groups.select("lang", F.col("source").alias("a"), "v", F.col("zero").alias("za")).join(
        groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb")), "lang").where("a <> b").select(
        "lang", "a", "b", F.coalesce((F.expr(_f("za", "zb")).cast(exact) * F.col("v")).cast(exact), F.lit(0).cast(exact)).alias("value"))
    pairs = ground.unionByName(single).unionByName(double).groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value")).select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)
