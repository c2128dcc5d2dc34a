import random
import re
import zlib
from collections import Counter

import pytest

from acqlens.llm import spelling
from tests.llm.helpers import awkward, frame


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        top = min(near, default=(0, None))
        form = top[1] if near and -top[0] >= ratio * n else None
        out[w] = [form, n, len(near), -top[0] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def found(spark, counts, **kw):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    rows = spelling.variants(df, **kw).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def vocabulary(seed, size, letters, lengths):
    rng = random.Random(seed)
    out = {}
    while len(out) < size:
        if out and rng.random() < 0.7:  # an edit of an earlier word
            w = rng.choice(list(out))
            i = rng.randrange(len(w))
            w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]))
        else:
            w = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        if w:
            out[w] = rng.choice((2, 2, 3, 20, 30, 400, 5000))
    return out


@pytest.mark.parametrize("letters, lengths, kw", [
    ("abcdeàé", (7, 8, 9, 12), {}),
    ("ab", (7, 8, 9), {"most_rows": 40, "cells": 300}),  # crowded groups, small runs
    ("aæ日😀", (1, 2, 3, 5), {"most_rows": 10}),
])
def test_variants_against_all_pairs(spark, letters, lengths, kw, monkeypatch):
    monkeypatch.setattr(spelling, "_FEW", 6)
    counts = vocabulary(len(letters), 350, letters, lengths)
    assert found(spark, counts, **kw) == plain(counts)


def test_ties_chains_long_words_and_nothing(spark):
    long_ = "x" * 5000
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdefi": 20, "abcdexh": 2000, long_: 3, long_ + "x": 40, long_[:-1] + "y": 5, "aaaaaaa": 7, "aaaaaaaa": 7}
    got = found(spark, counts)
    assert got == plain(counts)
    assert got["abcdefg"][:2] == ("abcdefh", "abcdexh") and got[long_][0] == long_ + "x"
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_one_chunk_shared_by_most_words(spark, monkeypatch):
    """A third of the words begin alike: the group is divided, and no pair is lost."""
    rng = random.Random(3)
    counts = {"longbeginning" + "".join(rng.choice("abcd") for _ in range(rng.choice((6, 7)))): rng.choice((2, 50)) for _ in range(500)}
    assert found(spark, counts, most_rows=60) == plain(counts)


def test_word_counts(spark):
    rows = awkward() + [(900, "Ärgernis ärgernis ÀÉÎÕÜß× " + "Letters" * 30 + " oneletters1twoletters", "en", "s", 1) + ("",) * 6]
    want = Counter()
    for id_, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                want[w] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(frame(spark, rows), typo_mod=31).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert spelling.word_counts(frame(spark, rows).limit(0), typo_mod=31).count() == 0
