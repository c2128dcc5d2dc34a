import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from acqlens.llm import fm_index, passages
from tests.llm.helpers import WORD, awkward, frame, prose


@pytest.mark.parametrize("size, width", [(3, 1), (3, 4), (40, 5), (2, 20), (300, 20)])
def test_fm_index_finds_what_plain_search_finds(size, width):
    rng = np.random.default_rng(size + width)
    parts = [rng.integers(1, size, rng.integers(0, 60)) for _ in range(12)]
    parts += [parts[0], parts[1][:30], np.concatenate((parts[2], parts[3]))]
    text = np.concatenate([np.append(x, 0) for x in parts])
    index = fm_index.FMIndex(text, width)
    starts = np.cumsum([0] + [len(x) + 1 for x in parts])[:-1]
    lengths = np.array([len(x) for x in parts])

    def count(x):
        return sum(1 for i in range(len(text) - len(x) + 1) if (text[i : i + len(x)] == x).all())

    which, place, lo, hi = index.matching_statistics(text, starts, lengths)
    assert len(which) == sum(max(0, len(x) - width + 1) for x in parts)
    for w, k, a, z in zip(which, place, lo, hi):
        assert z - a == count(parts[w][k : k + width])
    foreign = np.concatenate((parts[0][::-1], parts[4][:40], [size + 5], parts[0]))
    _, place, lo, hi = index.matching_statistics(foreign, np.array([0]), np.array([len(foreign)]))
    got = dict(zip(place.tolist(), (hi - lo).tolist()))
    assert got == {k: n for k in range(len(foreign) - width + 1) if (n := count(foreign[k : k + width]))}
    lo, hi = index.search(np.array([parts[0][:3], [1, size + 1, 1]]) if len(parts[0]) > 2 and width > 2 else np.ones((1, 1), dtype=np.int64))
    assert (hi >= lo).all()


def plain(rows, window=20):
    rows = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    places = {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for r in rows:
        for s in range(len(r[1]) - window + 1):
            w, at = tuple(r[1][s : s + window]), (order(r), s)
            places[w] = min(places.get(w, at), at)
    out = Counter()
    for r in rows:
        gone = set()
        for s in range(len(r[1]) - window + 1):
            if places[tuple(r[1][s : s + window])] < (order(r), s):
                gone.update(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(r[1]) if i not in gone)
        out[r[0], len(r[1]), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


def texts():
    rng = random.Random(5)
    passage = prose(rng, 55)
    out = [prose(rng, rng.randrange(0, 40)) + " " + passage + "\n" + prose(rng, rng.randrange(0, 40)) for _ in range(40)]
    out += ["ha " * 200, "ha " * 90 + "x " + "ha " * 50, "a b " * 80, passage + " " + passage, prose(rng, 19), passage.replace(" ", " \t"), ("word " * 19).strip()]
    near = prose(rng, 300).split()
    for i in range(6):
        near = near.copy()
        near[40 * i + 7] = f"other{i}"
        out.append(" ".join(near))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("params", [
    {}, {"shard_contexts": 5}, {"most_contexts": 6}, {"window": 8, "gram": 3, "most_contexts": 1}, {"window": 5, "gram": 5}])
def test_against_brute_force(spark, params):
    rows = awkward() + [(2000 + 3 * i, t, "en", "s", 0) + ("",) * 6 for i, t in enumerate(texts())]
    rows += [(7, prose(random.Random(8), 60), "en", "s", 0) + ("",) * 6]  # another row of id 7
    p = passages.PassageParams(**params)
    got = Counter(tuple(r) for r in passages.remove_repeats(frame(spark, rows), params=p, with_kept=True).collect())
    want = plain(rows, p.window)
    assert got == want
    assert sum(k[2] for k in want) > 1000


def test_empty_and_wrong_ids(spark):
    docs = frame(spark, awkward())
    assert passages.remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(TypeError):
        passages.remove_repeats(docs, id_col="id")
