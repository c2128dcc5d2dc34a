import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acqlens.llm import langid, line_rules, lm_score, mixing, packing, quality, secrets
from tests.llm.helpers import WORD, awkward, frame, prose

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_scan(spark):
    rows = awkward()
    opaque = "ghp0Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    rows += [(500 + i, f"shared {opaque}X", "en", f"own{i}", 1) + ("",) * 6 for i in range(6)] + [(600, f"só {opaque}Y alone", "en", "own9", 1) + ("",) * 6]
    got = secrets.digest_columns(secrets.scan(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), r
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == o for x in want) for o in range(3))
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    by = {r["doc_id"]: r for r in got}
    assert by[600]["spans"] == f"opaque:3:{3 + len(opaque) + 1}" and by[500]["spans"] == ""  # copied by many owners


def test_secret_redaction(spark):
    rows = awkward()
    docs = frame(spark, rows)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[14] == '[SECRET]" and [SECRET]' and by[0] is None and by[5] == rows[5][1]
    assert by[17] == "日本語 テキスト 😀😀 [SECRET] tail"
    assert secrets.redact(docs.limit(0)).count() == 0


def test_secrets_of_one_owner_in_many_documents(spark):
    opaque = "ghp0Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    page = lambda k: f"{'x ' * k}{opaque} password: hunter2hunter2"
    rows = [(i, page(i % 250), "en", "one", 1, f"r{i}") + ("",) * 5 for i in range(400)]
    docs = frame(spark, rows)
    for r in secrets.digest_columns(secrets.scan(docs)).collect():
        assert (r["n_live"], r["n_example"]) == (2, 0) and "opaque:" in r["spans"], r
    assert all(r["text"].endswith("[SECRET] [SECRET]") for r in secrets.redact(docs).collect())
    copies = frame(spark, [(i, page(0), "en", "one", 1, f"r{i}") + ("",) * 5 for i in range(400)])
    for rows_, repos in ((docs, 250), (copies, 1)):  # copies of one text within an owner count once
        found = secrets.scan(rows_, repo_col="id").select("found").collect()
        assert len(found) == 400 and {(x["repos"], x["live"]) for r in found for x in r[0] if x["o"] < 3} == {(repos, repos <= 200)}


def test_opaque_tokens_are_mixed_one_by_one(spark):
    plain = ["einkeitchzukeitheitlang", "-" * 30, "/usr/share/some/folder/name", "ALLUPPERCASE0123456789X"]
    opaque = "ghp0Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    text = " ".join(plain[:2] + [opaque] + plain[2:] + [opaque + "Z"])
    docs = frame(spark, [(1, text, "en", "one", 1) + ("",) * 6, (2, " ".join(plain), "en", "one", 1) + ("",) * 6])
    by = {r["doc_id"]: r for r in secrets.digest_columns(secrets.scan(docs)).collect()}
    at = [text.index(opaque), text.rindex(opaque)]
    assert by[1]["spans"] == f"opaque:{at[0]}:{at[0] + 25},opaque:{at[1]}:{at[1] + 26}" and by[2]["spans"] == ""
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert out == {1: " ".join(plain[:2] + ["[SECRET]"] + plain[2:] + ["[SECRET]"]), 2: " ".join(plain)}


def test_line_rules(spark):
    rows = awkward()
    shared = "a line that a whole host shares. " * 9
    rows += [(700 + i, f"{shared}\n{prose_line(i)}", "en", "hosted", 1) + ("",) * 6 for i in range(40)]
    rows += [(800 + i, "\n".join(prose_line(100 * i + k) for k in range(8)), "en", "hosted", 1) + ("",) * 6 for i in range(40)]
    got = line_rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        t = texts[r["id"]]
        w = WORD.findall(t)
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        if r["id"] and 700 <= r["id"] < 740:
            assert r["removed_words"] == 63 and not r["kept"]
        if r["id"] and 800 <= r["id"]:
            assert r["removed_words"] == 0 and r["kept"] == (not r["base_failed"])
    assert line_rules.judge(frame(spark, rows).limit(0)).count() == 0


def test_line_rules_large_host(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(words) + f"\nown line {'abcdefghij'[i % 10] * (i + 1)}", "en", "big", 1) + ("",) * 6 for i in range(300)]
    rows += [(1000 + i, "rare line\n" + "".join(f"{i} and {k} are here " for k in range(20)) + "z" * (i + 1), "en", "big", 1) + ("",) * 6 for i in range(20)]
    filler = spark.range(40_000).selectExpr(
        "id + 10000 AS doc_id", "concat('q', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text", "'en' AS lang", "'big' AS source", "1L AS n_chars",
        *(f"'' AS {c}" for c in ("id", "score", "chunk", "h", "rate_", "gone")))
    by = {r["id"]: r for r in line_rules.judge(frame(spark, rows).unionByName(filler)).where("id < 10000").collect()}
    assert len(by) == 320
    for i in range(300):  # a line of 300 documents is in under 1 % of the host's
        assert by[i]["removed_words"] == 60 and not by[i]["base_failed"] and not by[i]["kept"]
    assert all(by[1000 + i]["removed_words"] == 0 for i in range(20))  # no more documents than the limit


def test_line_rules_count_documents(spark):
    page = "\n".join(prose_line(k) for k in range(10))
    rows = [(i, page, "en", "copied", 1) + ("",) * 6 for i in range(500)]  # one text, many documents
    rows += [(1000, page.upper().replace("\n", "\n\n") + " more", "en", "copied", 1) + ("",) * 6]
    rows += [(2000, page, "en", "other", 1) + ("",) * 6] * 30  # a repeated row is one document
    by = {r["id"]: r for r in line_rules.judge(frame(spark, rows)).collect()}
    assert all(by[i]["removed_words"] == 80 and not by[i]["kept"] for i in range(500))
    assert by[1000]["removed_words"] == 72 and not by[1000]["kept"]
    assert by[2000]["removed_words"] == 0


def prose_line(k):
    import random

    return prose(random.Random(k), 8)


def test_secrets_in_a_text_of_very_many(spark):
    """20,000 matches in one text: found where plain search finds them, and in time."""
    import time

    words = [f"naïve {k} token='v{k:08d}x' 😀" if k % 3 else f"{k:032x} AKIA{k:016d}" for k in range(20_000)]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text, "s"), (2, "password = short12345", "s")], "doc_id long, text string, source string")
    secrets.scan(docs.where("doc_id = 2")).collect()
    began = time.time()
    got = {r.id: r.base for r in secrets.scan(docs).select("id", "base").collect()}
    assert time.time() - began < 60
    want = []
    for kind, pattern in enumerate((re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}"))):
        want += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if kind or len(m.group(1)) >= 8]
    assert [(x.s, x.o, x.e) for x in got[1]] == sorted(want) and len(want) > 25_000


def test_encoder_on_long_white_space_and_marks():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder()
    mark = "<|endoftext|>"
    texts = [f"hello {mark} world", mark, mark * 3, f" {mark}\n\n{mark} x", "<|endoftext|", ""]
    for white in (" ", "\n", "\t\r\n ", "\u3000", "\x85 ", "\x1c", "\u200b"):
        for n in (4095, 4096, 5000, 20_000):
            run = (white * n)[:n]
            texts += [run, run + "word", "word" + run, f"a{run}b{run} c", run + "'s", run + "\x1f" + run, f"{run}{mark}{run}x", run + "é" + run]
    for text in texts:
        assert enc.encode(text) == tok.encode(text, add_special_tokens=False).ids, (len(text), text[:20], text[-20:])
    for white in (" ", "\n"):  # the library itself takes these in pieces
        assert len(enc.encode("a" + white * 5_000_000 + "b")) > 2_000_000


def test_operators_on_megabytes_of_white_space(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b"), (2, "\n" * 1_500_000), (3, "plain <|endoftext|> text")], "doc_id long, text string")
    got = {r.doc_id: r.n for r in packing.tokenize(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == {1: 2_000_002, 2: 750_001, 3: len(packing.encoder().encode("plain <|endoftext|> text")) + 1}
    assert dict(zip((1, 2, 3), mixing.token_counts([r.text for r in docs.orderBy("doc_id").collect()]))) == got


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 40)  # several ranges, so that matches cross them
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = awkward() + [(3000 + i, prose_line(i) * (i % 17 + 1), "en", "s", 1) + ("",) * 6 for i in range(150)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(frame(spark, rows), with_ids=True).toPandas()
    want = Counter()
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, first, *range(first + 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = Counter((None if i != i else int(i), *map(int, x)) for i, *x in zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32))
    assert got == want
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length == s.offset).all() and s.length.sum() <= 1024
    best = 0
    gaps: list[int] = []
    for n in sorted(out.length, reverse=True):  # exact best-fit decreasing
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            best += 1
            gaps.append(1024 - n)
    assert out.sequence_id.nunique() <= best + 3
    assert packing.pack_documents(frame(spark, rows).limit(0)).count() == 0


def test_match_across_ranges():
    assert packing.across({0: (0, 3), 1: (2, 1), 2: (3, 0)}) == [(1, 0, 2, 0, 2), (2, 0, 1, 1, 0), (2, 1, 1, 0, 0)]


def naive_backoff(rows, order):
    words = [(r[1] or "").encode().lower().split() for r in rows]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [Counter() for _ in range(order)]
    for w in words:
        for n in range(order):
            total[n].update(grams(w, n + 1))
    size = sum(map(len, words))
    for r, w in zip(rows, words):
        own = [grams(w, n + 1) for n in range(order)]
        count = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        s = 0.0
        for j in range(len(w)):
            for n in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - n + 1 : j + 1])
                if n == 1:
                    s += math.log(max(count(g), 0.5) / max(size - len(w), 1))
                elif count(g):
                    s += math.log(count(g) / count(g[:-1]))
                    break
                else:
                    s += math.log(0.4)
        yield r[0], len(w), s


@pytest.mark.parametrize("order", [2, 3])
def test_backoff_scores(spark, order):
    rows = awkward()
    got = sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in lm_score.score(frame(spark, rows), params=lm_score.BackoffParams(order=order)).collect())
    want = sorted((str(a), b, c) for a, b, c in naive_backoff(rows, order))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert lm_score.score(frame(spark, rows).limit(0)).count() == 0


def test_backoff_tables_follow_the_size(spark, monkeypatch):
    p = lm_score.BackoffParams(chunk_bytes=4000, table_bytes=500)
    assert lm_score.deal(10, 8, p) == (8, 8) and lm_score.deal(100_000, 8, p) == (25, 200)
    rows, seen = awkward(), []
    real = lm_score._count
    monkeypatch.setattr(lm_score, "_count", lambda order, tables: seen.append(tables) or real(order, tables))
    got = sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in lm_score.score(frame(spark, rows), params=p).collect())
    want = sorted((str(a), b, c) for a, b, c in naive_backoff(rows, 3))
    assert seen == [lm_score.deal(sum(len((r[1] or "").encode()) for r in rows), int(spark.conf.get("spark.sql.shuffle.partitions")), p)[1]] and seen[0] > 50
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_backoff_counts_travel_in_rounds(spark, monkeypatch):
    rounds = []
    real = lm_score.stored_alone

    def seen(df, name):
        out = real(df, name)
        if name == "lm-totals":
            rounds.append(sorted(r[0] for r in out.select("n").distinct().collect()))
        return out
    monkeypatch.setattr(lm_score, "stored_alone", seen, raising=False)
    lm_score.score(frame(spark, awkward()), params=lm_score.BackoffParams(order=4)).collect()
    assert rounds == [[1, 2], [3], [4]]


def test_backoff_query_uses_trigrams(spark):
    from acqlens.llm import queries

    small = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["log_score"] for r in queries.op8_backoff_score(spark, small).collect()}
    want = {a: s for a, _, s in naive_backoff([tuple(r) for r in spark.read.parquet(small + "/documents.parquet").select("doc_id", "text").collect()], 3)}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_language_id(spark):
    syllables = {"en": "the and ing tion her", "de": "der sch ung keit zu ü", "ja": "日 本 語 テ キ"}
    import random

    rng = random.Random(8)
    rows = [(i, prose(rng, 40, syllables[k]).upper() if i % 5 == 0 else prose(rng, 40, syllables[k]), k, "s", 1) + ("x",) * 6
            for i, k in enumerate(["en", "de", "ja"] * 30)]
    docs = frame(spark, rows + awkward()[:5])
    model = langid.fit(frame(spark, rows).where("doc_id % 3 <> 7 and doc_id < 60"))
    got = langid.predict(docs, model, score_col="score").collect()
    assert all(r["lang_pred"] == r["lang"] and 0.9 < r["score"] <= 1 for r in got if r["n_chars"] == 1 and r["text"] and len(r["text"]) > 9)
    assert {r["lang_pred"] for r in got if not (r["text"] or "").strip()} == {"und"}
    p = model.params
    one = langid.features(["Ab, cd"], p)[0]
    many = langid.features(["", "Ab, cd", "zz"], p)
    assert sorted(one) == sorted(many[0][: many[1][1]]) and list(many[2]) == [0, 4, 2]  # independent of neighbours
    counts = Counter((n, g) for n in (1, 2, 3) for g in [" ab cd "[i : i + n] for i in range(8 - n)] if g != " ")
    assert len(one) == sum(counts.values()) and len(set(one)) == len(counts)
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality.document_statistics(docs.select("doc_id", "text")).cache()
    model = quality.fit(stats.where("doc_id % 2 = 0").join(labels, "doc_id"))
    rows = quality.score(stats.where("doc_id % 2 = 1"), model).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows) > 0
    x = np.array([quality.statistics_of(t) for t in ("Some text.", "", None)])
    assert np.isfinite(x).all() and (x[1] == x[2]).all()
    for k, cov in enumerate(model.whiten):  # cached factors give the Gaussian log densities
        s = np.linalg.inv(cov.T @ cov)
        d = x[0] - model.mean[k]
        assert np.isclose(-0.5 * d @ np.linalg.solve(s, d), -0.5 * ((cov @ d) ** 2).sum())
    none = quality.fit(stats.limit(0).join(labels, "doc_id"))
    assert none.constant == 0.5
    odd = quality.score(quality.document_statistics(frame(spark, awkward()).select("doc_id", "text", "score")), model)
    assert all(0 <= r["score"] <= 1 for r in odd.collect())


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    p = mixing.MixParams(weights={"q1t0": 0.9, "q0t0": 0.06, "q1t1": 0.04})
    rated, domains = mixing.document_rates(docs.select("doc_id", "text"), labels, p)
    g = rated.toPandas()
    post = np.stack(g.posterior_)
    share = (g.rate_.to_numpy() * g.tokens_.to_numpy()) @ post / g.tokens_.sum()
    want = np.array([p.weights.get(d, 0) for d in domains])
    # the optimum of the same problem by a long plain run of the same steps in numpy
    steps, mass = [], g.tokens_.to_numpy() @ post
    for _ in range(400):
        rate = mixing.replay(post, steps, p.ridge)
        steps.append(((rate * g.tokens_) @ post - want * g.tokens_.sum()) / mass)
    best = (mixing.replay(post, steps, p.ridge) * g.tokens_.to_numpy()) @ post / g.tokens_.sum()
    assert (g.rate_ >= 0).all() and np.abs(share - best).max() < 0.01
    rows = awkward()
    out = mixing.sample_by_rate(frame(spark, rows), labels, p)
    assert out.columns == frame(spark, rows).columns
    none = mixing.sample_by_rate(frame(spark, rows), labels.limit(0), p)
    assert none.count() == len(rows)  # without labels every rate is 1
    assert mixing.sample_by_rate(frame(spark, rows).limit(0), labels, p).count() == 0


def test_mixing_counts_packed_tokens(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = [None, "", "one two three", "x7Q" * 700, "日本語テキスト" * 200, prose_line(3), prose_line(3)]
    docs = frame(spark, [(i, t, "en", "s", 1) + ("",) * 6 for i, t in enumerate(texts)])
    packed = dict(packing.tokenize(docs).groupBy("doc_id").sum("length").collect())
    rated, _ = mixing.document_rates(docs.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r["tokens_"] for r in rated.collect()}
    assert got == {i: packed[i] if t else 0 for i, t in enumerate(texts)}
    assert got[3] > 100 and got[4] > 100  # texts without spaces aren't one token
