import re
from collections import Counter, defaultdict

from acqlens.llm import divergence
from tests.llm.helpers import awkward, frame


def plain(rows, top=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = [s for x, s in groups if x == lang]
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pair), 1)}
            out |= {(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(sorted(term)[:top], 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    rows = awkward() + [(500 + i, f"the red Fox {i % 4} and the big{i % 5} bear ähre Ähre", ("en", "fr")[i % 2], f"s{i % 6}", 9) + ("",) * 6 for i in range(60)]
    rows += [(700, None, "xx", "lonely", 0) + ("",) * 6, (701, "once", "yy", "a", 0) + ("",) * 6, (702, "other", "yy", "b", 0) + ("",) * 6]
    assert found(divergence.audit(frame(spark, rows))) == plain(rows)
    assert found(divergence.audit(frame(spark, rows), top=2)) == plain(rows, top=2)


def test_empty(spark):
    assert divergence.audit(frame(spark, awkward()).limit(0)).collect() == []


def test_tree_shares_paths():
    rows = [([1, 2, 3], 2), ([1, 2, 4], 1), ([1, 5], 7), ([2, 3], 1)]
    tree = divergence.Tree(rows)
    assert len(tree.items) == 7  # 1, 2, 3, 4, 5 below 1; 2, 3 apart
    pairs = Counter()
    for node, up in tree.node_ancestors():
        for n, u in zip(node, up):
            pairs[tree.items[u], tree.items[n]] += int(tree.times[n])
    want = Counter()
    for items, n in rows:
        for i, x in enumerate(items):
            for y in items[i + 1 :]:
                want[x, y] += n
    assert pairs == want


def test_trees_of_any_size_agree(spark, monkeypatch):
    rows = [
        ([{"source": f"s{k}", "p": 10**6 * (k + i % 3 + 1), "zero": 1000 + k} for k in range(6) if i >> k & 1], 1 + i % 4) for i in range(3, 64)]
    rows.sort(key=lambda r: [(x["source"], x["p"]) for x in r[0]])
    whole = divergence._corrections("en", [("en", *r) for r in rows]).to_pylist()
    parts = [x for r in rows for x in divergence._corrections("en", [("en", *r)]).to_pylist()]

    def total(found):
        out = Counter()
        for x in found:
            out[x["a"], x["b"]] += x["high"] * 2**32 + x["low"]
        return out
    assert total(whole) == total(parts)
