import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from acqlens.llm import components, embeddings, lm_score, minhash, substrings
from tests.llm.helpers import SCHEMA, awkward, frame, prose


def united(items, links):
    parent = {i: i for i in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(20, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)] + [(5, 5)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = united({x for e in edges for x in e}, edges)
    assert got == want


def near_copies(n=60):
    """Chains of near copies whose ends aren't similar, so pivots alone don't connect them."""
    rng = random.Random(9)
    out = []
    for g in range(3):
        words = prose(rng, 80).split()
        for k in range(n // 3):
            words = words.copy()
            words[(7 * k) % len(words)] = f"w{g}x{k}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n", [4, 5])
def test_minhash_components(spark, n, monkeypatch):
    monkeypatch.setattr(minhash, "_BLOCK", 8)  # crowded buckets are divided
    rows = awkward() + [(1000 + i, t, "en", "s", len(t)) + ("",) * 6 for i, t in enumerate(near_copies())]
    got = {}
    for r in minhash.near_duplicates(frame(spark, rows), params=minhash.MinHashParams(shingle=n)).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    sets = {r[0]: shingles(r[1], n) for r in rows}
    some = [i for i in sets if i is not None and sets[i]]
    links = [(a, b) for a in some for b in some if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = united([i for i in sets if i is not None], links)
    assert len(links) > 30
    for i, label in want.items():
        assert got[i] == {(len(sets[i]), label)}
    assert sum(map(len, got.values())) == len(got)


def test_minhash_stage_keeps_one_of_each_group(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert ids[6] == 1 and ids[7] == 0 and ids[None] == 1 and ids[0] == 1 and ids[1] == 1
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    sets = [np.unique(a[:3000]), np.unique(a[500:3500])]
    p = minhash.MinHashParams(bands=400, rows=1)
    bands = minhash.band_hashes(np.concatenate(sets), np.array([len(s) for s in sets]), p)
    assert abs((bands[0] == bands[1]).mean() - 2500 / 3500) < 0.08


def naive_repeats(rows, width=50):
    least, out = {}, []
    for i, t in sorted((r[0], (r[1] or "").encode()) for r in rows if r[0] is not None):
        for a in range(len(t) - width + 1):
            least.setdefault(t[a : a + width], i)
    for r in rows:
        t = (r[1] or "").encode()
        gone = bytearray(len(t))
        if r[0] is not None:
            for a in range(len(t) - width + 1):
                if least[t[a : a + width]] < r[0]:
                    gone[a : a + width] = b"\1" * width
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(spark):
    rng = random.Random(2)
    rows = awkward()
    passage = prose(rng, 40)
    for k in range(25):  # one passage in changing surroundings, cut at every place
        rows.append((2000 - k, prose(rng, 5) + passage[k : len(passage) - 2 * k] + prose(rng, 6), "en", "s", 1) + ("",) * 6)
    got = Counter(tuple(r) for r in substrings.remove_repeats(frame(spark, rows)).collect())
    assert got == naive_repeats(rows)
    assert sum(n for (_, _, removed, _, _), n in got.items() if removed) > 20
    assert substrings.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_runs_exchange_with_their_region_only(spark, monkeypatch):
    """What runs and key ranges exchange grows with the runs, not their square."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        passage = prose(rng, 20)
        for k in range(4):
            rows.append((4 * i + k, prose(rng, 4) + passage[3 * k : len(passage) - k] + prose(rng, 4), "en", "s", 1) + ("",) * 6)
    kept, stored_alone = {}, substrings.stored_alone

    def count(df, name):
        out = stored_alone(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(substrings, "stored_alone", count)
    got = Counter(tuple(r) for r in substrings.remove_repeats(frame(spark, rows), params=substrings.SubstringParams(run_contexts=3)).collect())
    assert got == naive_repeats(rows)
    runs = -(-kept["sub-rivals"] // 3)
    assert runs > 100
    assert kept["sub-again"] < 24 * runs  # a run and a range that have hashes in common; over 60 a run if all met


def test_a_crowded_anchor_has_several_runs(spark):
    p = substrings.SubstringParams(run_contexts=10, region_runs=4)
    rows = [(7 if i < 300 else i, i * 2654435761 % (1 << 40), i, b"%050d" % i + b"x") for i in range(400)]
    dealt, regions = substrings._deal_runs(spark.createDataFrame(rows, "h long, key long, doc long, context binary"), 400, 40, p)
    got = dealt.collect()
    sizes = Counter(r["run"] for r in got)
    assert len(got) == 400 and len(regions) == 10 and max(sizes.values()) < 40
    assert {r["run"] for r in got} <= set(range(regions[-1].first + regions[-1].runs))
    home = [substrings._region_of(pa.table({"run": [r["run"]]}), regions).first for r in got]
    assert len({(r["h"], f) for r, f in zip(got, home)}) == 101  # equal anchors, one region
    for r, after in zip(regions, regions[1:] + [None]):
        assert len(r.edges) < r.runs and r.edges == sorted(set(r.edges)) and (after is None or after.first == r.first + r.runs)


def test_packed_pieces():
    rng = np.random.default_rng(2)
    for n in (1, 7, 3000):
        x = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        cuts = np.unique(np.concatenate(([0, n], rng.integers(0, n, 9))))
        pieces = lm_score.pack_pieces(x, cuts)
        for a, z, b in zip(cuts, cuts[1:], pieces):
            assert (lm_score.unpack_sorted(b) == x[a:z]).all()
        y, size = lm_score.unpack_pieces([*pieces, lm_score.pack_sorted(x[:0]), lm_score.pack_sorted(x)])
        assert (y == np.concatenate((x, x))).all() and size.tolist() == [*np.diff(cuts), 0, n]
        bits = rng.random(n) < 0.5
        assert (substrings._unpack_bits(substrings._pack_bits(bits, np.diff(cuts)), np.diff(cuts)) == bits).all()


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    rng = random.Random(21)
    text = [prose(rng, 30).encode()[:60] for _ in range(6)]
    rows = pa.table({"run": pa.array([0] * 12, pa.int32()), "doc": list(range(12)), "context": pa.array(text * 2, pa.binary())})
    sent = substrings._shared(substrings._send_windows(50, 1)(rows))
    want = substrings._windows(rows, 50, sent)
    real = substrings._window_hashes
    monkeypatch.setattr(substrings, "_window_hashes", lambda *a: (*real(*a)[:2], real(*a)[2] % np.uint64(5), real(*a)[3]))
    got = substrings._windows(rows, 50, substrings._shared(substrings._send_windows(50, 1)(rows)))
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and len(want[0]) == 66
    assert (want[3][np.argsort(want[2])] == got[3][np.argsort(got[2])]).all()


def test_only_windows_that_occur_again_are_sorted():
    import pyarrow as pa

    rng = random.Random(8)
    shared = prose(rng, 30).encode()[:70]
    rows = [pa.table({"run": pa.array([r] * 20, pa.int32()), "h": list(range(20)), "key": list(range(20)), "doc": list(range(100 * r, 100 * r + 20)),
                      "context": pa.array([shared if i == 3 else prose(rng, 30).encode()[:70] for i in range(20)], pa.binary())}) for r in range(3)]
    sent = pa.concat_tables(substrings._send_windows(50, 4)(r) for r in rows).to_pandas()
    answers = pa.concat_tables(substrings._shared(pa.Table.from_pandas(part, preserve_index=False)) for _, part in sent.groupby("part"))
    for r, x in enumerate(rows):
        mine = answers.filter(pa.compute.equal(answers.column("chunk"), r))
        made = substrings._make_runs(50, [])(x, mine)
        (got,) = [substrings.decode(*c, 50)[1] for c in zip(made.column("shared").to_pylist(), made.column("rest").to_pylist())]
        assert got == sorted(shared[i : i + 50] for i in range(21))  # 21 of 420


def test_anchor_hashes_fill_the_ranges():
    rng = random.Random(9)
    h = substrings.anchors([prose(rng, 20_000).encode()], substrings.SubstringParams())[0]
    counts = np.bincount((h >> np.uint64(60)).astype(int), minlength=16)
    assert counts.max() < 1.3 * len(h) / 16


def test_loser_tree_knows_every_prefix():
    rng = random.Random(3)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(8)) for _ in range(rng.randint(0, 25))) for _ in range(k)]
        coded = [substrings.front_code(np.frombuffer(b"".join(r), dtype=np.uint8).reshape(-1, 8)) for r in runs]
        decoded = [substrings.decode(*c, 8) for c in coded]
        assert [d[1] for d in decoded] == runs
        at, out = [0] * k, []
        for run, shared in substrings.merge_runs(decoded):
            s = runs[run][at[run]]
            at[run] += 1
            assert not out or shared == substrings.common_prefix(out[-1], s, 0)
            out.append(s)
        assert out == sorted(sum(runs, []))


def test_sorted_and_count_coding():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    assert (lm_score.unpack_sorted(lm_score.pack_sorted(x)) == x).all()
    dense = np.cumsum(np.full(1000, 200, dtype=np.uint64))
    far = np.append(dense, [np.uint64(1 << 63), np.uint64((1 << 64) - 1)])
    for y in (dense, far, far[:0], far[-1:]):
        assert (lm_score.unpack_sorted(lm_score.pack_sorted(y)) == y).all()
    assert len(lm_score.pack_sorted(far)) < 1100  # two large gaps don't widen all the others
    c = np.array([1, 254, 255, 256, 10**12, 0])
    assert (lm_score.unpack_counts(lm_score.pack_counts(c)) == c).all()


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "_BLOCK", 16)  # crowded cells are divided
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))
    x[50:130] = x[50] + 0.16 * rng.standard_normal((80, 32))  # one large group near the threshold
    x[200], x[201] = x[10], 3 * x[11]
    rows = [(int(i), [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [], 1), (903, [float("nan")] * 32, 2), (904, [None] + [1.0] * 31, 2), (905, rows[5][1][:16], 2), rows[20]]
    got = Counter(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    valid = [r for r in rows if r[0] < 900]
    u = np.array([r[1] for r in valid])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u.T
    close = cos >= 0.9
    np.fill_diagonal(close, False)
    label = united([r[0] for r in valid], [(valid[a][0], valid[b][0]) for a, b in zip(*np.nonzero(close))])
    want = Counter((r[0], int(close[k].sum()), label[r[0]]) for k, r in enumerate(valid))
    want += Counter((r[0], 0, r[0]) for r in rows if 900 <= r[0])
    found, expected = sum(n for (_, n, _) in got.elements()), sum(n for (_, n, _) in want.elements())
    assert found >= 0.98 * expected and expected > 1000
    assert sum((got & want).values()) >= 0.9 * len(rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_calibration_reaches_recall():
    for n in (10, 1000, 10**6):
        cal = embeddings.calibrate(n, embeddings.CollisionParams())
        assert cal.lists < 400 and cal.signs >= 4
