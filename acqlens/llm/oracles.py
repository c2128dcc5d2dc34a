"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def _components(links: str, nodes: str) -> str:
    """Smallest id reachable, from a two-way link table (u, w) and a node table (id)."""
    return f"""reach(u, c) AS (
  SELECT id, id FROM {nodes} UNION SELECT {links}.u, reach.c FROM reach JOIN {links} ON {links}.w = reach.u
), comp AS (SELECT u AS id, min(c) AS component_id FROM reach GROUP BY u)"""


OP3 = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, s, t[s + 1 : s + 50] AS g
      FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 49)) AS s FROM b)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
hit AS (SELECT w.doc_id, w.s, lag(w.s) OVER p AS before, lead(w.s) OVER p AS after
        FROM w JOIN m USING (g) WHERE m.least < w.doc_id WINDOW p AS (PARTITION BY w.doc_id ORDER BY w.s)),
n AS (SELECT doc_id, sum(least(50, coalesce(after - s, 50))) AS n_removed,
             count(*) FILTER (WHERE before IS NULL OR s - before > 50) AS n_spans,
             list(s ORDER BY s) FILTER (WHERE before IS NULL OR s - before > 50) AS starts,
             list(s + 50 ORDER BY s) FILTER (WHERE after IS NULL OR after - s > 50) AS ends
      FROM hit GROUP BY doc_id),
k AS (SELECT b.doc_id, b.t, n.n_removed, n.n_spans,
             list_concat([0], coalesce(n.ends, [])) AS a, list_concat(coalesce(n.starts, []), [octet_length(b.t)]) AS z
      FROM b LEFT JOIN n USING (doc_id))
SELECT doc_id, octet_length(t) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda i: hex(t[a[i] + 1 : z[i]])), ''))) AS kept_sha256
FROM k"""

OP4 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT x.id AS u, y.id AS w FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_components("l", "v")}
SELECT v.id AS vec_id, (SELECT count(*) FROM l WHERE l.u = v.id) AS n_links, comp.component_id,
       v.id = comp.component_id AS kept
FROM v JOIN comp USING (id)"""

OP5 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), s AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM d
), e AS (SELECT id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT x.id AS u, y.id AS w FROM e x JOIN e y ON x.g = y.g AND x.id <> y.id
      GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
{_components("l", "d")}
SELECT s.id AS doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, comp.component_id, s.id = comp.component_id AS kept
FROM s JOIN comp USING (id)"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls
  FROM documents
), tri AS (
  SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
ln AS (SELECT doc_id, host, len(regexp_extract_all(x, '{_WORD}')) AS words,
         regexp_replace(lower(array_to_string(regexp_extract_all(x, '{_WORD}'), ' ')), '[0-9]', '0', 'g') AS norm
       FROM (SELECT doc_id, host, unnest(ls) AS x FROM d)),
freq AS (SELECT host, norm FROM ln GROUP BY host, norm HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT doc_id, sum(words) AS n FROM ln JOIN freq ON freq.host IS NOT DISTINCT FROM ln.host AND freq.norm = ln.norm GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS removed_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - removed_words) * 100 < n_words * 30) AS kept,
  CAST(removed_words AS BIGINT) AS removed_words
FROM r"""

OP11 = rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), r AS (
  SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents) GROUP BY ALL
), b AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, 128 + (unicode(x) & 63)] END)) AS bytes FROM r
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda x: x::BIGINT)),
    lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255) + 1]))) AS h FROM b, tab
), c AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), k AS (
  SELECT word, i, word[1 : i - 1] AS a, word[i + 1 :] AS z FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM c)
), one AS (
  SELECT x.word AS u, y.word AS w FROM k x JOIN k y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT k.word, c.word FROM k JOIN c ON c.word = k.a || k.z
  UNION SELECT c.word, k.word FROM k JOIN c ON c.word = k.a || k.z
), near AS (
  SELECT u, w, n, count(*) OVER (PARTITION BY u) AS n_near, row_number() OVER (PARTITION BY u ORDER BY n DESC, w) AS rank
  FROM one JOIN c ON c.word = one.w
), f AS (
  SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN near.n >= 10 * c.n THEN w END AS form,
         CASE WHEN near.n >= 10 * c.n THEN near.n END AS form_n
  FROM c LEFT JOIN near ON near.u = c.word AND rank = 1
), chain(word, tip) AS (
  SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.tip WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, chain.tip AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain USING (word) JOIN f AS last ON last.word = chain.tip AND last.form IS NULL"""

OP12 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
g AS (SELECT doc_id, s, w[s] AS word, CASE WHEN s + 19 <= len(w) THEN array_to_string(w[s : s + 19], ' ') END AS g FROM x),
h AS (SELECT doc_id, s, word, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1 AS late FROM g),
k AS (SELECT doc_id, s, word, bool_or(late) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM h),
n AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY s) FILTER (WHERE NOT gone) AS kept
      FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)"""

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(ts), '{_UPPER}', '{_LOWER}') AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM grp LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (total.total + v.v) AS p,
         1 + 1000000000 * (k.n + 1) // CAST(v.total + v.v AS BIGINT) AS q
  FROM grp g JOIN total USING (lang, source) JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON (s.lang, s.source, s.item) = (a.lang, a.source, b.source)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {"op3_suffix_dedup": OP3, "op4_embedding_dedup": OP4, "op5_minhash_dedup": OP5, "op10_line_rules": OP10, "op11_spelling_variants": OP11, "op12_fm_index_dedup": OP12,
           "op13_source_divergence": OP13}
