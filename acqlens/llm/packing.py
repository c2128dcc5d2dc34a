"""Best-fit packing of token pieces into fixed-length sequences, in bulk-synchronous rounds.

``tokenize`` cuts every document's ids into pieces of at most ``capacity`` (only longer
documents are cut; the first piece takes the remainder).  ``pack`` places the pieces:

1. Unplaced pieces and the gaps of open sequences are range-sorted together, largest first.
2. Each task sweeps its range: a piece takes the smallest gap that holds it and that no larger
   piece has taken (its successor among the gaps), so conflicts go by rank in the sort order.
   What a range leaves over is matched across ranges from the ranges' two counts alone.
3. Gaps are updated.  Of the pieces that fit no gap the largest open new sequences; the others
   go into the next round, where they find the gaps that those have left.

A gap that could hold several of the remaining pieces is offered as several slots, so the
number of rounds doesn't grow with the number of pieces.  Rounds exchange (id, length) rows;
only per-range counts and a histogram of lengths (at most ``capacity`` rows) reach the driver.

Defined results: a null text is empty and yields the end token alone; equal rows are packed
one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acqlens.llm.common import map_arrow, stored

END = 2
log = logging.getLogger(__name__)
ROWS_PER_TASK = 250_000
_ENCODERS: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as the tokenizers library gives them with its
    defaults: added tokens are found in the text first, the rest is split by the pattern.

    The file's ids are its merge ranks, so the merging itself can be done by tiktoken, which gives
    the same ids several times faster (tested).  Runs of LONG or more white-space characters are
    cut out before the pattern sees them, as it recurses over them: by the pattern all of such a
    run but the character that may lead the next word is one piece.
    """

    LONG = 4096

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))})
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in self.added}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.spaces = re.compile(f"[{_WHITE}]{{{self.LONG},}}")

    def encode(self, text: str) -> list[int]:
        if not any(x in text for x in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        if len(text) < self.LONG:
            return self.bpe.encode_ordinary(text)
        out, at = [], 0
        for m in self.spaces.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.bpe.encode_ordinary(text[at : m.start()])
            out += self.bpe._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.bpe.encode_ordinary(text[at:])


_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # the characters of Unicode's White_Space


def encoder(path: str | None = None) -> Encoder:
    """Encoder of a vocabulary file (the default one, where this process runs), kept per worker."""
    path = path or default_vocabulary()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are full."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
             capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32 and, if asked for, ``ids``
    (little-endian unsigned 32-bit).  ``uid`` is unique once the result is stored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(vocabulary), TaskContext.get().partitionId() << 33
        for b in batches:
            texts, at, cols, known = b.column(1).to_pylist(), [], [[], [], [], [], []], {}
            for i, text in enumerate(texts):
                if text not in known:
                    ids = np.asarray(enc.encode(text or "") + [END], dtype="<u4")
                    raw = ids.tobytes()
                    known[text] = [(s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), raw[4 * s : 4 * (s + n)] if with_ids else None)
                                   for s, n in piece_bounds(len(ids), capacity)]
                for k, (s, n, crc, raw) in enumerate(known[text]):
                    at.append(i)
                    for c, v in zip(cols, (k, s, n, crc, raw)):
                        c.append(v)
            out = [pa.array(np.arange(uid, uid + len(at))), b.column(0).take(pa.array(at, pa.int64())),
                   pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            uid += len(at)
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[4], pa.binary())] * with_ids, names=names)

    return map_arrow(rows, run, schema)


def _collected(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    parts = list(batches)
    return {n: np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) if parts else np.empty(0, dtype=np.int64)
            for k, n in enumerate(parts[0].schema.names if parts else ("kind", "v", "id"))}


def match_sorted(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matched (gap, piece) positions of one sorted range: each piece takes the last gap before
    it that is still free.  Pairs are the brackets of equal depth that follow one another."""
    step = np.where(is_gap, 1, -1)
    run = np.cumsum(step)
    low = np.minimum(np.minimum.accumulate(run), 0) if len(run) else run
    after = run - low
    before = after - step  # of a piece that finds no gap: after stays 0, before would be 1
    lost = ~is_gap & (np.diff(low, prepend=0) < 0)
    depth = np.where(is_gap, after, before)
    order = np.lexsort((np.arange(len(step)), depth))
    order = order[~lost[order]]
    g, d = is_gap[order], depth[order]
    pair = np.flatnonzero(g[:-1] & ~g[1:] & (d[:-1] == d[1:])) if len(order) else np.empty(0, dtype=np.int64)
    return order[pair], order[pair + 1]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid = TaskContext.get().partitionId()
    c = _collected(batches)
    if not len(c["v"]):
        return
    is_gap = c["kind"] == 0
    gaps, pieces = match_sorted(is_gap)
    left = np.ones(len(is_gap), dtype=bool)
    left[gaps] = left[pieces] = False
    for status, at in ((1, pieces), (2, np.flatnonzero(left & ~is_gap)), (3, np.flatnonzero(left & is_gap))):
        yield pa.RecordBatch.from_pydict({
            "pid": pa.array(np.full(len(at), pid), pa.int32()), "status": pa.array(np.full(len(at), status), pa.int32()),
            "rank": pa.array(np.arange(len(at)), pa.int64()), "id": pa.array(c["id"][at], pa.int64()),
            "v": pa.array(c["v"][at], pa.int64()), "seq": pa.array(c["id"][gaps] if status == 1 else np.full(len(at), -1), pa.int64())})


def across(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Matches between ranges from (pieces left, gaps left) per range, largest sizes first:
    (piece range, first piece rank, number, gap range, last gap rank); gap ranks go down."""
    stack: list[list[int]] = []
    out = []
    for pid in sorted(counts):
        pieces, gaps = counts[pid]
        done = 0
        while done < pieces and stack:
            top = stack[-1]
            n = min(pieces - done, top[1])
            out.append((pid, done, n, top[0], top[1] - 1))
            done, top[1] = done + n, top[1] - n
            if not top[1]:
                stack.pop()
        if gaps:
            stack.append([pid, gaps])
    return out


def _position(matches: list[tuple[int, int, int, int, int]]):
    base = np.cumsum([0] + [m[2] for m in matches])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid, status, rank = (b.column(k).to_numpy() for k in (0, 1, 2))
            pos = np.full(len(b), -1, dtype=np.int64)
            for k, (pp, first, n, gp, last) in enumerate(matches):
                p = (status == 2) & (pid == pp) & (rank >= first) & (rank < first + n)
                g = (status == 3) & (pid == gp) & (rank <= last) & (rank > last - n)
                pos[p], pos[g] = base[k] + rank[p] - first, base[k] + last - rank[g]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(pos), b.column(3), b.column(4)], names=["status", "pos", "id", "v"])
    return run


def _open(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Next-fit over one range of pieces, largest first; a sequence is named after its first piece."""
        seq, used = -1, capacity
        for b in batches:
            ids, sizes, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, n in zip(ids, sizes):
                if used + n > capacity:
                    seq, used = i, 0
                used += n
                out.append(seq)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["id", "v", "seq"])
    return run


def pack(pieces: DataFrame, capacity: int = 1024, uid_col: str = "uid", length_col: str = "length") -> DataFrame:
    """(uid, sequence_id, offset) of every piece; ``pieces`` must be stored (stable uids)."""
    sized = pieces.select(F.col(uid_col).alias("id"), F.col(length_col).cast("long").alias("v"))
    full = sized.where(F.col("v") >= capacity).select("id", F.col("id").alias("seq"), "v", F.lit(0).alias("round"))
    spark = pieces.sparkSession
    items = sized.where(F.col("v") < capacity)
    gaps, placed, number = spark.createDataFrame([], "seq long, free long"), [full], 0
    hist = _histogram(items)
    n_gaps, most_free = 0, 0
    while hist:
        number += 1
        log.debug("round %d: %d pieces of %d..%d, %d gaps up to %d", number, sum(hist.values()), min(hist), max(hist), n_gaps, most_free)
        n_items, least, largest = sum(hist.values()), min(hist), max(hist)
        swept = None
        if most_free >= least:
            each = max(1, -(-n_items // n_gaps))
            slots = F.greatest(F.lit(1), F.least(F.floor(F.col("free") / largest), F.lit(each))).cast("int")
            offered = (gaps.where(F.col("free") >= least).withColumn("k", slots)
                       .withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("k"))))
                       .select(F.lit(0).alias("kind"), (F.floor(F.col("free") / F.col("k")) + F.when(
                           F.col("slot") == 1, F.col("free") % F.col("k")).otherwise(0)).cast("long").alias("v"), F.col("seq").alias("id")))
            rows = items.select(F.lit(1).alias("kind"), "v", "id").unionByName(offered)
            order = [F.desc("v"), F.asc("kind"), F.asc("id")]
            tasks = -(-(n_items + n_gaps) // ROWS_PER_TASK)
            swept = stored(map_arrow(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order), _sweep,
                                     "pid int, status int, rank long, id long, v long, seq long"), "pack-sweep")
            counts: dict[int, list[int]] = {}
            for r in swept.where("status > 1").groupBy("pid", "status").count().collect():  # two rows per task
                counts.setdefault(r["pid"], [0, 0])[r["status"] - 2] = r["count"]
            matches = across({k: (a, b) for k, (a, b) in counts.items()})
            matched = swept.where("status = 1").select("id", "seq", "v")
            items = swept.where("status = 2").select("id", "v")
            if matches:
                left = stored(map_arrow(swept.where("status > 1"), _position(matches), "status int, pos long, id long, v long"), "pack-left")
                matched = matched.unionByName(
                    left.where("status = 2 and pos >= 0").select("pos", "id", "v")
                    .join(left.where("status = 3 and pos >= 0").select("pos", F.col("id").alias("seq")), "pos").select("id", "seq", "v"))
                items = left.where("status = 2 and pos < 0").select("id", "v")
            matched = stored(matched, "pack-matched") if matches else matched
            placed.append(matched.withColumn("round", F.lit(number)))
            taken = matched.groupBy("seq").agg(F.sum("v").alias("taken"))
            gaps = gaps.join(taken, "seq", "left").select("seq", (F.col("free") - F.coalesce("taken", F.lit(0))).alias("free"))
            hist = _histogram(items)
            if not hist:
                break
            gaps = stored(gaps.where(F.col("free") >= min(hist)), "pack-gaps")
            n_gaps, most_free = _gap_stats(gaps)
        cut = _opening_size(hist, most_free, capacity)
        if cut is not None:
            order = [F.desc("v"), F.asc("id")]
            opening = sum(n for v, n in hist.items() if v >= cut)
            opened = stored(map_arrow(
                items.where(F.col("v") >= cut).select("id", "v").repartitionByRange(-(-opening // ROWS_PER_TASK), *order)
                .sortWithinPartitions(*order), _open(capacity), "id long, v long, seq long"), "pack-opened")
            placed.append(opened.withColumn("round", F.lit(number)))
            items = items.where(F.col("v") < cut)
            hist = {v: n for v, n in hist.items() if v < cut}
            if hist:
                new = opened.groupBy("seq").agg((F.lit(capacity) - F.sum("v")).alias("free")).where(F.col("free") >= min(hist))
                gaps = stored(gaps.unionByName(new), "pack-gaps")
                n_gaps, most_free = _gap_stats(gaps)
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p.select("id", "seq", "v", "round"))
    before = Window.partitionBy("seq").orderBy("round", "id").rowsBetween(Window.unboundedPreceding, -1)  # a sequence's pieces
    return every.select(F.col("id").alias(uid_col), F.col("seq").alias("sequence_id"),
                        F.coalesce(F.sum("v").over(before), F.lit(0)).cast("long").alias("offset"))


def _histogram(items: DataFrame) -> dict[int, int]:
    return {r["v"]: r["count"] for r in items.groupBy("v").count().collect()}  # at most one row per length


def _gap_stats(gaps: DataFrame) -> tuple[int, int]:
    r = gaps.agg(F.count("*"), F.coalesce(F.max("free"), F.lit(0))).first()
    return r[0], r[1]


def _opening_size(hist: dict[int, int], most_free: int, capacity: int) -> int | None:
    """Pieces of this length or more open sequences now: those that fit no gap, as far as about
    the same number of them fills a sequence.  Smaller ones wait for the gaps these leave."""
    largest = max(hist)
    if largest <= most_free:
        return None
    each = capacity // largest
    # pieces of an eighth or less leave little of a sequence unused however they are grouped
    band = 0 if each >= 8 else capacity // (each + 1) if each < 4 else 2 * largest // 3
    return max(band, most_free) + 1


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                   capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    pieces = stored(tokenize(docs, id_col, text_col, vocabulary, capacity, with_ids), "pack-pieces")
    columns = [c for c in pieces.columns if c != "uid"]
    return pieces.join(pack(pieces, capacity), "uid").select(*columns, "sequence_id", "offset")
