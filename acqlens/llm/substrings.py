"""Repeated-substring removal by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if it lies in a ``width``-byte string that also starts in a document with a smaller
id.  Only suffixes that can matter are sorted, cut off at ``width`` bytes:

1. Every window of ``width`` bytes has an anchor, its gram of ``gram`` bytes with the smallest
   hash (leftmost on ties), so equal windows have equal anchors.  Chunks of documents send their
   distinct anchor hashes, sorted and delta-coded, to hash ranges and get one bit back for each:
   does another document have it?
2. The windows of a shared anchor form one context string, known by its hash.  Equal contexts
   need no comparison: every document but the smallest loses all of their windows.
3. Different contexts of one anchor can share windows.  As equal windows have equal anchors, the
   contexts are dealt by anchor to regions of some runs each, and no region has anything to merge
   with another: what runs and key ranges exchange grows with the contexts, not their square.
   Runs first learn, as in step 1, which windows occur in several contexts: a window whose hash
   occurs once has no equal.  The other suffixes are sorted in runs, each run front-coded (shared
   prefix length and the rest), exchanged by key range and merged with loser trees that keep the
   prefix lengths known and compare only the bytes after them.  Equal neighbours share the
   smallest document, which goes back to the runs.
4. Chunks remove the covered bytes from their documents.

What occurs in many documents travels once per chunk or run, so copied passages make no hot
key.  Nothing is capped.

Defined results: null texts are empty; texts shorter than ``width`` lose nothing; equal ids
don't remove each other; rows with a null id lose nothing and remove nothing.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acqlens.llm.common import chunks as blocks
from acqlens.llm.common import discard, mix64, powers, running_sums, ship, stored_alone, stretch_hashes, trimmed
from acqlens.llm.lm_score import pack_pieces, unpack_pieces


_BLOCK = 1 << 15  # bytes of text worked on at a time, so that the arrays stay in the processor's cache


@dataclass(frozen=True)
class SubstringParams:
    width: int = 50
    gram: int = 24  # at most width
    chunk_bytes: int = 4 << 20  # of text; a task holds one chunk
    run_contexts: int = 16_000  # contexts per sorted run, and per key range of the merge
    region_runs: int = 16  # runs per region, about


def gram_hashes(run: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive bytes."""
    return stretch_hashes(run, slice(0, len(run) - k), slice(k, None))


def gram_order(run: np.ndarray, k: int) -> np.ndarray:
    """A number for every k consecutive bytes whose upper half orders them: their hash before its
    last mixing, which only its lower half needs."""
    h = run[k:] - run[:-k]
    h *= powers(len(run))[1][: len(h)]
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(blobs: list[bytes], p: SubstringParams) -> list[np.ndarray]:
    """Anchors of all blobs, which lie one after the other in one buffer: hash, key of the context
    (a hash of the bytes of all the anchor's windows), blob, and the first and last start of the
    windows in the buffer."""
    none = np.empty(0, dtype=np.int64)
    none = [none.astype(np.uint64), none, none, none, none]
    buf = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    size = np.array([len(b) for b in blobs], dtype=np.int64)
    long_ = size >= p.width
    if not long_.any():
        return none
    run = running_sums(buf)
    least = gram_order(run, p.gram)
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    least = sliding_min(least, p.width - p.gram + 1)
    ends = np.cumsum(size)
    new = np.empty(len(least) + 1, dtype=bool)  # where an anchor's windows begin, or those across two texts
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:-1])
    new[np.minimum((ends - size)[long_], len(least))] = True
    new[np.minimum((ends - p.width + 1)[long_], len(least))] = True
    first = np.flatnonzero(new[:-1])
    last = np.append(first[1:], len(least)) - 1
    blob = np.searchsorted(ends, first, side="right")
    use = np.flatnonzero(first + p.width <= ends[blob])
    first, last, blob = first[use], last[use], blob[use]
    anchor = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    key = stretch_hashes(run, first, last + p.width).view(np.int64)
    # hashed again: the smallest of a window's hashes would crowd the first hash ranges
    return [mix64(stretch_hashes(run, anchor, anchor + p.gram)), key, blob, first, last]


def _blobs(chunk: pa.Table) -> list[bytes]:
    """The texts as bytes; those of rows without an id are left empty."""
    ids = chunk.column("doc_id").is_null().to_pylist()
    return [b"" if n else (t or "").encode("utf-8", "surrogatepass") for t, n in zip(chunk.column("text").to_pylist(), ids)]


def _chunk_anchors(blobs: list[bytes], p: SubstringParams) -> list[np.ndarray]:
    """``anchors``, some blobs at a time."""
    found, base = [anchors([], p)], 0
    for lo, hi in blocks(blobs, _BLOCK):
        h, key, doc, first, last = anchors(blobs[lo:hi], p)
        found.append([h, key, doc + lo, first + base, last + base])
        base += sum(map(len, blobs[lo:hi]))
    return [np.concatenate(x) for x in zip(*found)]


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by ``h``, where in it each number's group begins, the groups' sizes, and the distinct numbers."""
    order = np.argsort(h)
    x = h[order]
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))[: len(x)]
    return order, start, np.diff(np.append(start, len(x))), x[start]


def _chunk_hashes(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a chunk, and whether several documents of it have them."""
    order, start, _, u = _groups(h)
    if not len(u):
        return u, np.empty(0, dtype=bool)
    doc = doc[order]
    return u, np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)


def _bit_places(size: np.ndarray) -> np.ndarray:
    """Where the bits of pieces of so many bits are, if each piece begins a byte of its own."""
    room = -(-size // 8) * 8
    return np.arange(size.sum()) + np.repeat(np.cumsum(room) - room - (np.cumsum(size) - size), size)


def _pack_bits(bits: np.ndarray, size: np.ndarray) -> list[bytes]:
    room = -(-size // 8)
    wide = np.zeros(8 * room.sum(), dtype=bool)
    wide[_bit_places(size)] = bits
    raw = np.packbits(wide).tobytes()
    return [raw[e - k : e] for e, k in zip(np.cumsum(room).tolist(), room.tolist())]


def _unpack_bits(pieces: list[bytes], size: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(pieces), dtype=np.uint8))[_bit_places(size)].astype(bool)


def _by_range(chunk: int, u: np.ndarray, several: np.ndarray, tables: int) -> pa.Table:
    """A chunk's sorted hashes and their marks, cut up by hash range."""
    edges = np.array([(i << 64) // tables for i in range(1, tables)], dtype=np.uint64)
    cuts = np.concatenate(([0], np.searchsorted(u, edges), [len(u)]))
    some = np.flatnonzero(np.diff(cuts))
    cuts = np.append(cuts[some], len(u))
    return pa.table({
        "part": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int32()),
        "hashes": pa.array(pack_pieces(u, cuts) if len(some) else [], pa.binary()),
        "several": pa.array(_pack_bits(several, np.diff(cuts)), pa.binary())})


def _send(p: SubstringParams, tables: int):
    def run(chunk: pa.Table) -> pa.Table:
        h, _, doc, _, _ = _chunk_anchors(_blobs(chunk), p)
        u, several = _chunk_hashes(h, chunk.column("doc_id").fill_null(0).to_numpy()[doc])
        return _by_range(chunk.column("chunk")[0].as_py(), u, several, tables)
    return run


def _shared(part: pa.Table) -> pa.Table:
    h, size = unpack_pieces(part.column("hashes").to_pylist())
    several = _unpack_bits(part.column("several").to_pylist(), size)
    order, start, n, _ = _groups(h)
    yes = np.empty(len(h), dtype=bool)
    yes[order] = np.repeat((n > 1) | np.logical_or.reduceat(several[order], start), n)
    return pa.table({"chunk": part.column("chunk"), "part": part.column("part"),
                     "shared": pa.array(_pack_bits(yes, size), pa.binary()), "n": pa.array(size, pa.int32())})


def _heads(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, key), stable, and where in it each pair's group begins."""
    order = np.lexsort((key, h))
    a, b = h[order], key[order]
    return order, np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)])


def _match(h: np.ndarray, key: np.ndarray, in_h: np.ndarray, in_key: np.ndarray) -> np.ndarray:
    """For each (h, key) its place among the distinct pairs (in_h, in_key), or -1."""
    seen = np.zeros(1 << 22, dtype=bool)  # most have no equal, and needn't be sorted
    seen[in_key.view(np.uint64) >> np.uint64(42)] = True
    some = np.flatnonzero(seen[key.view(np.uint64) >> np.uint64(42)])
    n = len(in_h)
    order, head = _heads(np.concatenate((in_h, h[some])), np.concatenate((in_key, key[some])))
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    out = np.full(len(h), -1)
    out[some] = np.where(at[n:] < n, at[n:], -1)
    return out


def _pairs_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows.column("h").to_numpy().view(np.uint64), rows.column("key").to_numpy()


def _told(answers: pa.Table) -> np.ndarray:
    """What the hash ranges said of a chunk's distinct hashes, in their order."""
    got = sorted(zip(answers.column("part").to_pylist(), answers.column("shared").to_pylist(), answers.column("n").to_pylist()))
    return _unpack_bits([b for _, b, _ in got], np.array([n for _, _, n in got], dtype=np.int64))


def _contexts(p: SubstringParams):
    """The chunk's contexts of shared anchors: smallest document, and whether others have it too."""
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        h, key, doc, _, _ = _chunk_anchors(_blobs(chunk) if len(answers) else [], p)
        number = chunk.column("doc_id").fill_null(0).to_numpy()[doc]
        if len(answers):
            order, _, n, _ = _groups(h)
            use = order[np.repeat(_told(answers), n)]
            h, key, number = h[use], key[use], number[use]
        order, head = _heads(h, key)
        number = number[order]
        least, most = (f.reduceat(number, head) if len(head) else number for f in (np.minimum, np.maximum))
        n = chunk.column("chunk")[0].as_py() if len(chunk) else 0
        return pa.table({"chunk": pa.array([n] * len(head), pa.int32()), "h": h[order][head].view(np.int64), "key": key[order][head],
                         "doc": least, "several": least != most})
    return run


def _texts_of(p: SubstringParams):
    """The bytes of the contexts asked for, one copy of each."""
    def run(chunk: pa.Table, asked: pa.Table) -> pa.Table:
        blobs = _blobs(chunk) if len(asked) else []
        h, key, _, first, last = _chunk_anchors(blobs, p)
        at = _match(h, key, *_pairs_of(asked))
        hit = np.flatnonzero(at >= 0)
        at, place = np.unique(at[hit], return_index=True)
        place = hit[place]
        asked = asked.select(["h", "key", "doc"]).take(pa.array(at))
        buf = b"".join(blobs)
        return asked.append_column("context", pa.array([buf[a : z + p.width] for a, z in zip(first[place].tolist(), last[place].tolist())], pa.binary()))
    return run


# --- front-coded runs and their merge -------------------------------------------------------

def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known already."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return known
    x = int.from_bytes(a[known : known + n], "big") ^ int.from_bytes(b[known : known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


def front_code(rows: np.ndarray, heads: np.ndarray | None = None) -> tuple[bytes, bytes]:
    """A sorted run of strings of one width (a matrix of bytes): the prefix length that each
    shares with the one before, and the bytes after it.  Those at ``heads`` are given in full."""
    n, width = rows.shape
    shared = np.zeros(n, dtype="<u2")
    if n > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    if heads is not None:
        shared[heads] = 0
    return shared.tobytes(), rows[np.arange(width) >= shared[:, None]].tobytes()


def decode(shared: bytes, rest: bytes, width: int) -> tuple[list[int], list[bytes]]:
    """(prefixes shared with the string before, strings) of a front-coded run."""
    lcp = np.frombuffer(shared, dtype="<u2").astype(np.int64)
    new = np.arange(width) >= lcp[:, None]
    rows = np.zeros(new.shape, dtype=np.uint8)
    rows[new] = np.frombuffer(rest, dtype=np.uint8)
    place = np.arange(len(lcp))
    for j in range(width):  # a byte that isn't sent is that of the last string that sent one
        rows[:, j] = rows[np.maximum.accumulate(np.where(new[:, j], place, 0)), j]
    raw = rows.tobytes()
    return lcp.tolist(), [raw[i : i + width] for i in range(0, len(raw), width)]


def merge_runs(decoded: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int]]:
    """Merge sorted runs with a loser tree: (run, prefix shared with the string before).

    Every contestant carries the prefix it shares with the last winner.  The longer one is the
    smaller string; only on a tie bytes are compared, and from the end of that prefix on.
    """
    runs = [zip(*d) for d in decoded]
    k = 1
    while k < len(runs):
        k *= 2
    text: list[bytes | None] = [None] * k
    lcp = [0] * k
    for i, r in enumerate(runs):
        head = next(r, None)
        if head is not None:
            text[i] = head[1]

    def beats(i: int, j: int) -> bool:
        """Whether i comes out before j; the loser's prefix becomes the one it shares with the winner."""
        a, b = text[i], text[j]
        if a is None or b is None:
            return b is None
        if lcp[i] != lcp[j]:
            return lcp[i] > lcp[j]
        if a == b:
            lcp[j] = len(a)
            return True
        n = common_prefix(a, b, lcp[i])
        first = a[n:] <= b[n:]
        lcp[j if first else i] = n
        return first

    loser = [0] * k
    level = list(range(k))
    start = k
    while len(level) > 1:  # play the first round
        start //= 2
        up = []
        for g in range(0, len(level), 2):
            i, j = level[g], level[g + 1]
            won = i if beats(i, j) else j
            loser[start + g // 2] = j if won == i else i
            up.append(won)
        level = up
    win = level[0]
    while text[win] is not None:
        yield win, lcp[win]
        head = next(runs[win], None)
        if head is None:
            text[win], lcp[win] = None, 0
        else:
            lcp[win], text[win] = head
        node, mine = (win + k) // 2, lcp[win]
        alive = text[win] is not None
        while node:
            other = loser[node]
            theirs = lcp[other]
            if text[other] is None or alive and mine > theirs:
                pass  # the longer known prefix decides without looking at a byte
            elif not alive or mine < theirs or not beats(win, other):
                win, loser[node] = other, win
                mine, alive = theirs, True
            node //= 2


def _window_hashes(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a run's contexts, the start of every window in them, its hash, and the windows per context."""
    context = rows.column("context").to_pylist()
    size = np.array([len(c) for c in context], dtype=np.int64)
    n = size - width + 1
    buf = np.frombuffer(b"".join(context), dtype=np.uint8)
    start = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return buf, start, gram_hashes(running_sums(buf), width)[start], n


def _windows(rows: pa.Table, width: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that occur several times: the distinct ones in order (a matrix of bytes), the
    smallest document of each, the places of all among the run's windows and their numbers among
    the distinct ones; and the windows per context."""
    buf, start, h, n = _window_hashes(rows, width)
    order, _, times, _ = _groups(h)
    told = _told(answers)
    use, times = order[np.repeat(told, times)], times[told]
    every = np.lib.stride_tricks.sliding_window_view(buf, width)[start[use]]
    head = np.cumsum(times) - times
    first = every[head]  # one of each hash is sorted, unless different windows share one
    same = (every == np.repeat(first, times, axis=0)).all()
    sort = _strings(first if same else every)
    by = np.argsort(sort)
    sort = sort[by]
    new = np.concatenate(([True], sort[1:] != sort[:-1]))[: len(by)]
    number = np.empty(len(by), dtype=np.int64)
    number[by] = np.cumsum(new) - 1
    if same:
        number = np.repeat(number, times)
    doc = np.repeat(rows.column("doc").to_numpy(), n)[use]
    least = np.full(np.count_nonzero(new), np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    return (first if same else every)[by[new]], least, use, number, n


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings of their width, which compare as the bytes do."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _send_windows(width: int, tables: int):
    def run(rows: pa.Table) -> pa.Table:
        _, _, times, u = _groups(_window_hashes(rows, width)[2])
        return _by_range(rows.column("run")[0].as_py(), u, times > 1, tables)
    return run


def _make_runs(width: int, edges: list[bytes]):
    def run(rows: pa.Table, shared: pa.Table) -> pa.Table:
        order, least, _, _, _ = _windows(rows, width, shared)
        cuts = np.concatenate(([0], np.searchsorted(_strings(order), np.array(edges, dtype=f"S{width}")), [len(order)]))
        some = np.flatnonzero(np.diff(cuts))
        cuts = np.append(cuts[some], len(order))
        prefix, rest = front_code(order, cuts[:-1])
        sent = np.concatenate(([0], np.cumsum(width - np.frombuffer(prefix, dtype="<u2").astype(np.int64))))[cuts]
        docs = least.astype("<i8").tobytes()
        return pa.table({
            "part": pa.array(some, pa.int32()), "run": pa.array([rows.column("run")[0].as_py()] * len(some), pa.int32()),
            **{name: pa.array([raw[a:z] for a, z in zip(at, at[1:])], pa.binary())
               for name, raw, at in (("shared", prefix, (2 * cuts).tolist()), ("rest", rest, sent.tolist()), ("docs", docs, (8 * cuts).tolist()))}})
    return run


@dataclass(frozen=True)
class Region:
    """A share of the anchors: number of its first run and of its first key range, how many of each, and
    the key ranges' edges."""
    first: int
    runs: int
    edges: list[bytes]


def _region_of(rows: pa.Table, regions: list[Region]) -> Region:
    return regions[bisect_right(regions, rows.column("run")[0].as_py(), key=lambda r: r.first) - 1]


def _numbered(made: pa.Table, first: int) -> pa.Table:
    """Parts of one region as parts of all."""
    return made.set_column(made.schema.get_field_index("part"), "part", pc.add(made.column("part"), pa.scalar(first, pa.int32())))


def _send_region(width: int, regions: list[Region]):
    def run(rows: pa.Table) -> pa.Table:
        r = _region_of(rows, regions)
        return _numbered(_send_windows(width, r.runs)(rows), r.first)
    return run


def _make_region(width: int, regions: list[Region]):
    def run(rows: pa.Table, shared: pa.Table) -> pa.Table:
        r = _region_of(rows, regions)
        return _numbered(_make_runs(width, r.edges)(rows, shared), r.first)
    return run


def _merge(width: int):
    def run(part: pa.Table) -> pa.Table:
        docs = [np.frombuffer(b, dtype="<i8") for b in part.column("docs").to_pylist()]
        lcp, text = decode(*(b"".join(part.column(c).to_pylist()) for c in ("shared", "rest")), width)  # a run's first shares nothing
        ends = np.cumsum([len(d) for d in docs]).tolist()
        out = np.array(list(merge_runs([(lcp[e - len(d) : e], text[e - len(d) : e]) for e, d in zip(ends, docs)])), dtype=np.int64)
        place = np.argsort(out[:, 0], kind="stable")  # of the runs' strings, one run after the other
        doc = np.empty(len(out), dtype=np.int64)
        doc[place] = np.concatenate(docs)
        new = out[:, 1] < width
        answer = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1][place].astype("<i8")
        return pa.table({"run": part.column("run"), "part": part.column("part"),
                         "least": pa.array([answer[e - len(d) : e].tobytes() for e, d in zip(ends, docs)], pa.binary())})
    return run


def _masks(width: int):
    """One byte per window of the contexts that have some in a smaller document.  ``answers``: what
    the hash ranges said (with n), and the smallest documents that the merge found (without)."""
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        merged = answers.column("n").is_null()
        _, _, use, number, n = _windows(rows, width, answers.filter(pc.invert(merged)))
        merged = answers.filter(merged)
        got = sorted(zip(merged.column("part").to_pylist(), merged.column("shared").to_pylist()))
        least = np.concatenate([np.empty(0, dtype=np.int64)] + [np.frombuffer(b, dtype="<i8") for _, b in got])
        gone = np.zeros(n.sum(), dtype=np.uint8)
        gone[use] = least[number] < np.repeat(rows.column("doc").to_numpy(), n)[use]
        ends = np.cumsum(n)
        hit = np.add.reduceat(gone, ends - n, dtype=np.int64) > 0
        raw = gone.tobytes()
        return pa.table({"h": rows.column("h").filter(pa.array(hit)), "key": rows.column("key").filter(pa.array(hit)),
                         "mask": pa.array([raw[e - k : e] for e, k in zip(ends[hit], n[hit])], pa.binary())})
    return run


def _apply(p: SubstringParams, with_kept: bool):
    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        blobs = _blobs(chunk)
        starts = ends = np.empty(0, dtype=np.int64)  # of covered stretches, in the chunk's bytes
        if len(found):
            h, key, doc, first, last = _chunk_anchors(blobs, p)
            at = _match(h, key, *_pairs_of(found))
            use = np.flatnonzero(at >= 0)
            at, first, last = at[use], first[use], last[use]
            later = chunk.column("doc_id").fill_null(0).to_numpy()[doc[use]] > found.column("least").to_numpy()[at]
            some = np.flatnonzero(~later & found.column("mask").is_valid().to_numpy()[at])
            hit = [a + np.flatnonzero(np.frombuffer(m, dtype=np.uint8)) for a, m in zip(first[some], found.column("mask").take(pa.array(at[some])).to_pylist())]
            starts = np.sort(np.concatenate([first[later], *hit]))
            ends = np.sort(np.concatenate([last[later], *hit])) + p.width
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        texts, nulls = chunk.column("text"), chunk.column("doc_id").is_null().to_pylist()
        base = 0
        for lo, hi in blocks(blobs, _BLOCK):
            size = np.array([len(b) for b in blobs[lo:hi]], dtype=np.int64)
            at = np.concatenate(([0], np.cumsum(size)))
            a, z = np.searchsorted(starts, (base, base + at[-1]))  # a stretch lies in one text, so as many end as start
            removed = runs = np.zeros(hi - lo, dtype=np.int64)
            kept = blobs[lo:hi]
            if z > a:
                gone = np.cumsum(np.bincount(starts[a:z] - base, minlength=at[-1] + 1) - np.bincount(ends[a:z] - base, minlength=at[-1] + 1))[: at[-1]] > 0
                begun = gone.copy()
                begun[1:] &= ~gone[:-1]
                begun[at[:-1][size > 0]] = gone[at[:-1][size > 0]]
                before, begun = (np.concatenate(([0], np.cumsum(x)))[at] for x in (gone, begun))
                removed, runs = np.diff(before), np.diff(begun)
                rest = np.frombuffer(b"".join(kept), dtype=np.uint8)[~gone].tobytes()
                cuts = (at - before).tolist()
                kept = [rest[i:j] for i, j in zip(cuts, cuts[1:])]
            base += at[-1]
            for i, b, one in zip(range(lo, hi), blobs[lo:hi], kept):
                if nulls[i]:
                    b = one = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                out["n_bytes"].append(len(b))
                out["kept_sha256"].append(hashlib.sha256(one).hexdigest())
                out["kept"].append(one if with_kept else b"")
            out["n_removed"] += removed.tolist()
            out["n_spans"] += runs.tolist()
        return pa.table({"doc_id": chunk.column("doc_id"), **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")},
                         "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                         **({"kept": pa.array(out["kept"], pa.binary())} if with_kept else {})})
    return run


def _deal_runs(rivals: DataFrame, n_rivals: int, runs: int, p: SubstringParams) -> tuple[DataFrame, list[Region]]:
    """Contexts with the runs they are in, and the regions.  A region has runs by its contexts, so
    a crowded anchor's is as finely cut as the others; the driver gets a count per region and an
    edge per key range."""
    n = -(-runs // p.region_runs)
    dealt = rivals.withColumn("region", F.pmod(F.xxhash64("h"), F.lit(n)).cast("int"))
    size = dict(map(tuple, dealt.groupBy("region").count().collect()))
    each = max(1, -(-n_rivals // runs))
    per = [max(1, -(-size.get(i, 0) // each)) for i in range(n)]
    first = list(accumulate(per, initial=0))[:n]
    own = F.element_at(F.lit(per), F.col("region") + 1)
    one = Window.partitionBy("region")
    sample = dealt.where(F.pmod("key", F.lit(max(1, n_rivals // (64 * runs)))) == 0).select(
        "region", own.alias("runs"), F.substring("context", 1, p.width).alias("edge"))
    sample = sample.select("region", "runs", "edge", F.row_number().over(one.orderBy("edge")).alias("i"), F.count("*").over(one).alias("n"))
    edges = sample.where("i < n and floor(i * runs / n) > floor((i - 1) * runs / n)").select("region", "edge").collect()
    found: list[set[bytes]] = [set() for _ in range(n)]
    for region, edge in edges:
        found[region].add(bytes(edge))
    return (dealt.withColumn("run", F.element_at(F.lit(first), F.col("region") + 1) + F.pmod(F.xxhash64("key"), own).cast("int")),
            [Region(*x) for x in zip(first, per, map(sorted, found))])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   params: SubstringParams = SubstringParams(), with_kept: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept
    bytes (a cut may fall inside a character, so they are binary).

    Chunks are read again whenever their bytes are needed; what is stored and exchanged between
    are hashes, and the bytes of contexts that have rivals.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n_chunks = max(tables, -(-size // params.chunk_bytes))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.pmod(F.xxhash64(id_col, text_col), F.lit(n_chunks)).cast("int").alias("chunk")).groupBy("chunk")
    sent = dealt.applyInArrow(trimmed(_send(params, tables)), "part int, chunk int, hashes binary, several binary")
    shared = sent.groupBy("part").applyInArrow(trimmed(_shared), "chunk int, part int, shared binary, n int")
    found = stored_alone(dealt.cogroup(shared.groupBy("chunk")).applyInArrow(
        trimmed(_contexts(params)), "chunk int, h long, key long, doc long, several boolean"), "sub-found")

    contexts = stored_alone(found.groupBy("h", "key").agg(F.min("doc").alias("doc"), F.min("chunk").alias("chunk")), "sub-distinct")
    several = contexts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    asked = contexts.join(several, "h")
    rivals = stored_alone(dealt.cogroup(asked.groupBy("chunk")).applyInArrow(trimmed(_texts_of(params)), "h long, key long, doc long, context binary"), "sub-rivals")
    n_rivals = rivals.count()
    runs = max(1, min(tables, n_rivals), -(-n_rivals // params.run_contexts))
    rivals_in, regions = _deal_runs(rivals, n_rivals, runs, params)
    dealt_runs = rivals_in.groupBy("run")
    sent = dealt_runs.applyInArrow(trimmed(_send_region(params.width, regions)), "part int, chunk int, hashes binary, several binary")
    again = stored_alone(sent.groupBy("part").applyInArrow(trimmed(_shared), "chunk int, part int, shared binary, n int").withColumnRenamed("chunk", "run"), "sub-again")
    made = dealt_runs.cogroup(again.groupBy("run")).applyInArrow(
        trimmed(_make_region(params.width, regions)), "part int, run int, shared binary, rest binary, docs binary")
    merged = made.groupBy("part").applyInArrow(trimmed(_merge(params.width)), "run int, part int, least binary")
    answers = again.unionByName(merged.select("run", "part", F.col("least").alias("shared"), F.lit(None).cast("int").alias("n")))
    masks = stored_alone(dealt_runs.cogroup(answers.groupBy("run")).applyInArrow(trimmed(_masks(params.width)), "h long, key long, mask binary"), "sub-masks")
    discard(rivals, again)
    verdict = contexts.select("h", "key", F.col("doc").alias("least")).join(masks, ["h", "key"], "left")
    # a chunk needn't hear of a context that takes nothing from it
    judged = found.join(verdict, ["h", "key"]).where("doc > least or several or mask is not null").select("chunk", "h", "key", "least", "mask")
    judged = stored_alone(judged, "sub-judged")
    discard(found, contexts, masks)
    return dealt.cogroup(judged.groupBy("chunk")).applyInArrow(
        trimmed(_apply(params, with_kept)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
