"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Candidates are the spans of fixed patterns plus opaque tokens (long mixed runs).  Each
candidate value is hashed, and the distinct owners that hold it are counted over the whole
corpus, and the distinct repositories if there is a column for them (copies of one text within
an owner count as one).  A value that few owners hold looks like a live credential; one that
many owners or repositories hold is a copied example.  Without repositories the owners decide
alone: documents do not stand in for them, since their number grows with the corpus.  Opaque tokens are reported as spans
only when they look live, so the frequency decides what the scan adds.

Positions come from the matches of a pattern and the pieces between them, by running sums.

Defined results: null or empty texts have no spans; very long texts and texts with very many
matches take time in proportion; equal rows get equal results; null owners count as one owner; rows are told apart by id, owner, repository and text, so clashing extra
columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acqlens.llm.common import fresh, stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
OPAQUE = "[A-Za-z0-9_+/=-]{20,}"
MIXED = "m rlike '[0-9]' and m rlike '[A-Z]' and m rlike '[a-z]'"
KINDS = ("assign", "access", "hex", "opaque")  # in the order that breaks ties
_SPAN = "struct<s:int,o:int,e:int,h:string,w:int>"


@dataclass(frozen=True)
class SecretParams:
    most_owners: int = 3  # a live credential is held by at most so many owners
    most_repositories: int = 200  # and by at most so many repositories, where these are known
    shortest_value: int = 8


def _quoted(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_BLOCK = 128  # lengths summed at a time


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _total(array: str, first: str, count: str) -> str:
    return f"aggregate(slice({array}, {first}, {count}), 0, (a, x) -> a + x)"


def _spans(kind: int, pattern: str, value: str, keep: str) -> str:
    """SQL: spans of one pattern in ``t``, of those matches ``m`` that ``keep`` holds for.

    The pieces of text between the matches come from splitting by the same pattern, so a match
    starts where the lengths of all before it end.  These running sums are taken in blocks: the time
    grows with the text and the number of matches, not with their product.
    """
    empty, regex = f"cast(array() as array<{_SPAN}>)", _quoted(pattern)
    block = f"(i div {_BLOCK})"
    start = f"starts[{block}] + {_total('lens', f'cast({block} * {_BLOCK} + 1 as int)', f'i % {_BLOCK}')} + char_length(between[i])"
    spans = f"""transform(filter(transform(ms, (m, i) -> named_struct('m', m, 's', {start})), x -> {_let('m', 'x.m', f'({keep})')}),
        x -> {_let('m', 'x.m', f"""cast(named_struct('s', x.s, 'o', {kind}, 'e', x.s + char_length(m), 'h', sha2({value}, 256),
            'w', char_length({value})) as {_SPAN})""")})"""
    blocks = f"sequence(0, cast((size(ms) - 1) div {_BLOCK} as int))"
    spans = _let("starts", f"transform({blocks}, b -> {_total('sums', '1', 'b')})", spans)
    spans = _let("sums", f"transform({blocks}, b -> {_total('lens', f'b * {_BLOCK} + 1', str(_BLOCK))})", spans)
    spans = _let("lens", "transform(ms, (m, i) -> char_length(between[i]) + char_length(m))", spans)
    spans = _let("between", f"split(t, {regex}, -1)", spans)
    return _let("ms", f"regexp_extract_all(t, {regex}, 0)", f"case when exists(ms, m -> {keep}) then {spans} else {empty} end")


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str | None, owner_col: str,
               params: SecretParams) -> DataFrame:
    """One row per document: id, repository, owner, text digest and the candidate spans."""
    rows = docs.select(
        F.col(id_col).alias("id"), (F.lit(None) if repo_col is None else F.col(repo_col)).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    value = f"regexp_extract(m, {_quoted(ASSIGN)}, 2)"
    assign = _spans(0, ASSIGN, value, f"char_length({value}) >= {params.shortest_value}")
    spans = f"""case when t = '' then cast(array() as array<{_SPAN}>) else array_sort(concat(
        {assign},
        {_spans(1, ACCESS, "m", "true")},
        {_spans(2, HEX, "m", "true")},
        {_spans(3, OPAQUE, "m", MIXED)})) end"""
    return rows.select("id", "repo", "owner", F.sha2("t", 256).alias("digest"), F.expr(spans).alias("spans"))


def _joined(spans: Column) -> Column:
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["o"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"], x["e"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None,
         owner_col: str = "source", params: SecretParams = SecretParams()) -> DataFrame:
    """Per row of ``docs``: id, digest, owner, repo, ``base`` (pattern spans), ``found`` (all spans,
    with ``live``, owners and repositories of each; null repositories if there is no column for
    them), ordered by start and kind."""
    rows = stored(candidates(docs, id_col, text_col, repo_col, owner_col, params), "secret-candidates")
    key = ["id", "repo", "owner", "digest"]
    each = rows.where(F.size("spans") > 0).dropDuplicates(key).select(*key, F.explode("spans").alias("x"))
    each = stored(each, "secret-spans")  # plain rows on both sides of the join below: Spark can split a value that most texts hold
    live = F.col("owners") <= params.most_owners
    if repo_col is None:
        held = (each.groupBy(F.col("x.h").alias("h"), "owner").agg(F.lit(1).alias("one"))
                .groupBy("h").agg(F.lit(None).cast("long").alias("repos"), F.count("*").alias("owners")))
    else:
        held = (each.groupBy(F.col("x.h").alias("h"), "owner", "digest").agg(F.min("repo").alias("repo"))
                .groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
                .groupBy("h", "owner").agg(F.count("*").alias("repos"))
                .groupBy("h").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners")))
        live &= F.col("repos") <= params.most_repositories
    judged = (each.withColumn("h", F.col("x.h")).join(stored(held, "secret-holders"), "h")
              .select(*key, F.struct("x.s", "x.o", "x.e", "x.h", live.alias("live"), "owners", "repos").alias("x")))
    # a document's own spans: bounded by its length
    per_doc = judged.groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("found"))
    left, right = rows.alias("l"), per_doc.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    cond = same[0] & same[1] & same[2] & same[3]
    empty = F.expr("cast(array() as array<struct<s:int,o:int,e:int,h:string,live:boolean,owners:bigint,repos:bigint>>)")
    found = F.filter(F.coalesce(F.col("r.found"), empty), lambda x: (x["o"] < 3) | x["live"])
    return (left.join(right, cond, "left")
            .select(*(F.col(f"l.{k}").alias(k) for k in key), found.alias("found"))
            .withColumn("base", F.filter("found", lambda x: x["o"] < 3)))


def digest_columns(scanned: DataFrame) -> DataFrame:
    count = lambda c, o: F.size(F.filter(c, lambda x: x["o"] == o)).cast("long")
    n = lambda cond: F.size(F.filter("found", cond)).cast("long")
    return scanned.select(
        F.col("id").alias("doc_id"), count("base", 0).alias("n_assign"), count("base", 1).alias("n_access"),
        count("base", 2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), n(lambda x: x["live"]).alias("n_live"),
        n(lambda x: ~x["live"]).alias("n_example"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None,
           owner_col: str = "source", params: SecretParams = SecretParams(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live span replaced by ``mark``; copied examples and all else stay.

    The text has to meet its spans, so only documents with a live span are looked up by key.
    """
    i, d, c = (fresh(x, docs) for x in ("secret_id", "secret_digest", "secret_cut"))
    hits = (scan(docs, id_col, text_col, repo_col, owner_col, params)
            .withColumn("cut", F.filter("found", lambda x: x["live"])).where(F.size("cut") > 0)
            .select(F.col("id").alias(i), F.col("digest").alias(d), F.transform("cut", lambda x: F.struct(x["s"], x["e"])).alias(c))
            .dropDuplicates([i, d]))
    text = f"`{text_col}`"
    cut = F.expr(f"""aggregate({c}, named_struct('p', 0, 'o', ''),
        (a, x) -> case when x.s >= a.p
            then named_struct('p', x.e, 'o', concat(a.o, substring({text}, a.p + 1, x.s - a.p), '{mark}'))
            else named_struct('p', greatest(a.p, x.e), 'o', a.o) end,
        a -> concat(a.o, substring({text}, a.p + 1)))""")
    cond = F.col(id_col).eqNullSafe(F.col(i)) & F.sha2(F.col(text_col), 256).eqNullSafe(F.col(d))
    joined = docs.join(hits, cond, "left").withColumn(text_col, F.when(F.col(c).isNotNull(), cut).otherwise(F.col(text_col)))
    return joined.select(*docs.columns)
