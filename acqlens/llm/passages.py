"""Repeated passages of words, removed through FM-indexes of the places where texts may agree.

Every window of ``window`` words has an anchor, its leftmost run of ``gram`` words with the
smallest hash, and equal windows have equal anchors.  The words of the consecutive windows of one
anchor are its context.  Contexts of an anchor that occurs once can't repeat.  The others are dealt
by anchor to shards, each different context once, and a shard builds an FM-index (wavelet matrix
over word numbers) of its contexts.  Streaming them through it by backward search gives the
matching statistics: for each window the interval of suffixes that begin with it, and the earliest
place in that interval.  A window is removed wherever it isn't that place.

An anchor with more than ``most_contexts`` different contexts would overfill a shard: its windows
are compared by two 64-bit hashes and their earliest place is found by a grouped minimum.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from acqlens.llm.common import map_arrow, mix64, powers, sequence_hashes, stored, trimmed, word_hashes
from acqlens.llm.fm_index import FMIndex

_BLOCK = 4 << 20  # bytes of text hashed together
_LENGTH = np.uint64(63)  # the low bits of a context's hash hold its number of windows


@dataclass(frozen=True)
class PassageParams:
    """Windows of ``window`` words with anchors of ``gram`` words (at most 63 windows share an
    anchor's place); shards of about ``shard_contexts`` contexts."""

    window: int = 20
    gram: int = 6
    shard_contexts: int = 20_000
    most_contexts: int = 20_000

    def __post_init__(self):
        if not 0 <= self.window - self.gram < 62:
            raise ValueError("window - gram must lie between 0 and 61")


def _blocks(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, b in enumerate(blobs):
        size += len(b)
        if size >= _BLOCK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(blobs):
        yield first, len(blobs)


def _anchors(words: np.ndarray, counts: np.ndarray, p: PassageParams):
    """(document, first window, windows, anchor hash, context hash) of the contexts of documents
    that lie one after the other in ``words``; windows never cross documents."""
    ends = np.cumsum(counts)
    grams = sequence_hashes(words, p.gram)
    span = p.window - p.gram + 1
    n = len(words) - p.window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    least, have = grams, 1
    while have < span:  # minimum over a growing run of grams
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    starts = np.arange(n)
    doc = np.searchsorted(ends, starts, "right")
    whole = starts + p.window <= ends[doc]
    # leftmost gram of the window that has the smallest hash: the anchor moves on only when it must
    place = np.full(n, -1, dtype=np.int64)
    for k in reversed(range(span)):
        place = np.where(grams[k : k + n] == least[:n], starts + k, place)
    starts, doc, place = starts[whole], doc[whole], place[whole]
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),) * 2
    head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    windows = np.diff(np.append(head, len(starts)))
    first = starts[head]
    up, down = powers(len(words) + 1)
    run = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=run[1:])
    ctx = mix64((run[first + windows + p.window - 1] - run[first]) * down[first] + mix64((place[head] - first).astype(np.uint64) + np.uint64(7)))
    ctx = (ctx & ~_LENGTH) | windows.astype(np.uint64)
    base = ends - counts
    return doc[head], first - base[doc[head]], windows, grams[place[head]], ctx


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _occurrences(p: PassageParams):
    """Batches (id, text) into (h, salt, weight, ctx, id, at, crc): anchors that a block of text has
    once with salt 0 and weight 1, those it has more often salted, and one witness of weight 2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            for lo, hi in _blocks(blobs):
                doc, first, _, h, ctx = _anchors(*word_hashes(blobs[lo:hi]), p)
                if not len(doc):
                    continue
                crc = np.array([zlib.crc32(b) for b in blobs[lo:hi]], dtype=np.int64)[doc]
                _, which, times = np.unique(h, return_inverse=True, return_counts=True)
                known = times[which] > 1
                salt = np.where(known, 1 + (mix64(ctx ^ (np.uint64(31) * first.astype(np.uint64) + ids[lo:hi][doc].astype(np.uint64))) >> np.uint64(56)).astype(np.int64), 0)
                witness = np.unique(h[known])
                nothing = np.zeros(len(witness), dtype=np.int64)
                columns = [np.concatenate(c) for c in (
                    (h.view(np.int64), witness.view(np.int64)), (salt, nothing), (np.ones(len(h), dtype=np.int64), nothing + 2),
                    (ctx.view(np.int64), nothing), (ids[lo:hi][doc], nothing), (first, nothing), (crc, nothing))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "salt", "weight", "ctx", "id", "at", "crc"])
    return run


def _texts(p: PassageParams):
    """Rows (text, asked: [(h, ctx, at)]) into the contexts' words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, crc, text, asked in zip(*(batch.column(c).to_pylist() for c in ("id", "crc", "text", "asked"))):
                words = text.encode("utf-8", "surrogatepass").split()
                for x in asked:
                    n = (x["ctx"] & 63) + p.window - 1
                    rows.append((x["h"], x["ctx"], id_, x["at"], crc, b" ".join(words[x["at"] : x["at"] + n])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (*[pa.int64()] * 5, pa.binary()))],
                                                 ["h", "ctx", "id", "at", "crc", "words"])
    return run


def _indexed(p: PassageParams):
    """One shard: the FM-index of its contexts, all of them streamed through it; per context a bit
    for each window that is the earliest place of its words."""
    def run(rows: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        text, lengths = [], []
        for words in rows["words"].to_pylist():
            mine = [number.setdefault(w, len(number) + 1) for w in words.split()]
            text += mine
            text.append(0)
            lengths.append(len(mine))
        text, lengths = np.array(text, dtype=np.int64), np.array(lengths, dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
        which, place, lo, _ = FMIndex(text, p.window).matching_statistics(text, starts, lengths)
        id_, at = rows["id"].to_numpy()[which], rows["at"].to_numpy()[which] + place
        order = np.lexsort((at, id_, lo))
        least = np.concatenate(([True], lo[order][1:] != lo[order][:-1])) if len(lo) else np.zeros(0, dtype=bool)
        # two rows of one id can hold a window at the same place: neither is earlier
        tied = np.zeros(len(lo), dtype=bool)
        head = np.maximum.accumulate(np.where(least, np.arange(len(lo)), 0)) if len(lo) else order
        tied[order] = (id_[order] == id_[order][head]) & (at[order] == at[order][head])
        first = np.zeros(len(lengths), dtype=np.int64)
        np.bitwise_or.at(first, which[tied], np.int64(1) << place[tied])
        return pa.table({"h": rows["h"], "ctx": rows["ctx"], "first": pa.array(first)})
    return run


def _window_hashes(p: PassageParams):
    """Contexts into their windows, by two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, ctx, id_, at, words in zip(*(batch.column(c).to_pylist() for c in ("h", "ctx", "id", "at", "words"))):
                words = words.split()
                for k in range(len(words) - p.window + 1):
                    digest = hashlib.blake2b(b" ".join(words[k : k + p.window]), digest_size=16).digest()
                    rows.append((h, ctx, id_, at + k, k, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["h", "ctx", "id", "at", "k", "w1", "w2"])
    return run


def _cut(with_kept: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = words
                if runs:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, [r["lo"] for r in runs], 1)
                    np.add.at(edge, [r["hi"] for r in runs], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                left = b" ".join(kept)
                for name, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass") if with_kept else None)):
                    out[name].append(v)
            names = ["n_words", "n_removed", "kept_sha256"] + ["kept"] * with_kept
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c], pa.int64() if c.startswith("n_") else pa.string()) for c in names)], ["doc_id", *names])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PassageParams = PassageParams(), with_kept: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words.

    Each word goes that lies in a window whose words also start earlier: in a row of smaller id, or
    in a row of the same id at a smaller place (so exact copies of a row, id included, fare alike).
    Ids are integers, other types raise TypeError; a null id comes after all.  Null and empty texts
    have no words, texts below a window's length lose none, an empty table gives an empty one.

    Plan-time actions: counts of the contexts and of crowded anchors.
    """
    p, spark = params, docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    id_ = F.col(id_col).cast("long")
    last = F.lit(np.iinfo(np.int64).max)
    source = docs.select(id_.alias("doc_id"), F.coalesce(id_, last).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn(
        "crc", F.crc32(F.col("text").cast("binary")))

    seen = map_arrow(docs.select(id_, F.col(text_col)), _occurrences(p), "h long, salt long, weight long, ctx long, id long, at long, crc long")
    weight = F.when(F.col("salt") > 0, 2).otherwise(F.sum("weight").over(Window.partitionBy("h", "salt")))
    found = stored(seen.withColumn("w", weight).where("w > 1 and weight = 1").select("h", "ctx", "id", "at", "crc"), "passage-anchors")
    contexts = stored(found.groupBy("h", "ctx").agg(F.min(F.struct("id", "at", "crc")).alias("m")).select("h", "ctx", "m.*"), "passage-contexts")
    crowded = stored(contexts.groupBy("h").count().where(F.col("count") > p.most_contexts).select("h"), "passage-crowded")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-contexts.count() // p.shard_contexts))

    asked = contexts.groupBy("id", "crc").agg(F.collect_list(F.struct("h", "ctx", "at")).alias("asked"))
    words = map_arrow(source.select("id", "crc", "text").join(asked, ["id", "crc"]), _texts(p), "h long, ctx long, id long, at long, crc long, words binary")
    words = stored(words.dropDuplicates(["h", "ctx"]), "passage-words")  # repeated rows give theirs again
    few = words.join(crowded, "h", "left_anti") if crowded.limit(1).count() else words
    answers = few.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInArrow(trimmed(_indexed(p)), "h long, ctx long, first long")
    if few is not words:
        each = stored(map_arrow(words.join(crowded, "h", "left_semi").select("h", "ctx", "id", "at", "words"), _window_hashes(p),
                                "h long, ctx long, id long, at long, k long, w1 long, w2 long"), "passage-windows")
        least = each.groupBy("w1", "w2").agg(F.min(F.struct("id", "at")).alias("m"))
        answers = answers.unionByName(each.join(least, ["w1", "w2"]).groupBy("h", "ctx").agg(
            F.sum(F.when(F.struct("id", "at") == F.col("m"), F.expr("shiftleft(1L, cast(k as int))")).otherwise(0)).alias("first")))

    verdict = contexts.select("h", "ctx", F.col("id").alias("least_id"), F.col("at").alias("least_at")).join(answers, ["h", "ctx"])
    verdict = stored(verdict, "passage-verdicts")  # both sides of the next join are shuffled as they are, so Spark can split a hot context
    judged = found.join(verdict, ["h", "ctx"]).withColumn("windows", F.expr("cast(ctx & 63 as int)"))
    # the first place of a context keeps the windows found first; at all others every window is late
    late = F.expr("""case when id = least_id and at = least_at
        then filter(sequence(0, windows - 1), k -> (shiftright(first, k) & 1) = 0) else array(-1) end""")
    runs = judged.withColumn("k", F.explode(late)).select(
        "id", "crc", F.expr("at + greatest(k, 0)").alias("lo"), F.expr(f"at + if(k < 0, windows - 1, k) + {p.window}").alias("hi"))
    gone = runs.groupBy("id", "crc").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    return map_arrow(source.join(gone, ["id", "crc"], "left").select("doc_id", "text", "runs"), _cut(with_kept, p.window),
                     "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_kept)
