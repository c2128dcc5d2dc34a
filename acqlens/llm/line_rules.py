"""Quality rules with cross-document line frequency; DataFrame functions only.

Lines are normalised (lower case, digits to 0, white space collapsed) and hashed; for each
host the distinct documents that hold a line are counted: lines are exploded once per distinct
text, weighted by the text's number of documents (equal rows are one document).  Lines in more documents than the limit are removed, whatever the size of the host,
and documents that lose too many of their words are rejected.  Base rules look at one document alone.

Defined results: null or empty texts have zero words and fail the base rules; a null host is a
host of its own; equal rows get equal results.  Rows are told apart by id, host and text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acqlens.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class LineRuleParams:
    fewest_words: int = 50
    repeat_percent: int = 50
    line_documents: int = 20  # a line in no more documents of a host is never removed
    kept_percent: int = 30  # a document must keep this share of its words


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array."""
    def windows(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.size(w) - 2)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(t: Column) -> Column:
        ordered = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        flagged = lambda s: F.filter(
            F.transform(s, lambda x, k: F.when(
                (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(
            _let(F.sort_array(_let(ordered, flagged)), covered))

    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(windows(w), repeated)))


def document_rules(docs: DataFrame, id_col: str, text_col: str, host_col: str, params: LineRuleParams) -> DataFrame:
    """One row per document: identity, base statistics, and its lines as (hash, words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("t"))
    squeezed = lambda x: F.trim(F.regexp_replace(x, SPACE, " "))
    lines = _let(
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0),
        lambda a: F.struct(
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"),
            F.transform(a, lambda x: _let(squeezed(x), lambda y: F.struct(
                F.xxhash64(F.regexp_replace(F.lower(y), "[0-9]", "0")).alias("h"),
                (F.length(y) - F.length(F.translate(y, " ", "")) + 1).alias("w")))).alias("all")))
    words = F.array_remove(F.split("t", SPACE), "")
    return rows.select(
        "id", "host", F.sha2("t", 256).alias("digest"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), _repeat_words(words).cast("long").alias("n_repeat_words"),
    ).select(
        "id", "host", "digest", "word_chars", "n_symbols", "n_repeat_words", F.col("lines.dup").alias("n_dup_lines"),
        F.col("lines.all").alias("lines"),
    ).withColumn("n_words", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["w"]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          params: LineRuleParams = LineRuleParams()) -> DataFrame:
    """Per row of ``docs``: id, host, base statistics, removed words, ``base_failed`` and ``kept``."""
    rows = stored(document_rules(docs, id_col, text_col, host_col, params).drop("t"), "line-rules")
    host = F.coalesce("host", F.lit("\x00"))
    texts = rows.groupBy(host.alias("host"), "digest").agg(F.first("lines").alias("lines"))
    copies = (rows.select(host.alias("host"), "digest", "id").distinct()
              .groupBy("host", "digest").agg(F.count("*").alias("copies")))
    frequent = (texts.join(copies, ["host", "digest"])
                .select("host", "copies", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
                .groupBy("host", "h").agg(F.sum("copies").alias("n"))
                .where(F.col("n") > params.line_documents)
                .select("host", "h"))
    lost = (texts.select("host", "digest", F.explode("lines").alias("x"))
            .groupBy("host", "digest", F.col("x.h").alias("h")).agg(F.sum("x.w").alias("w"))
            .join(frequent, ["host", "h"])
            .groupBy("host", "digest").agg(F.sum("w").alias("removed_words")))
    out = rows.drop("lines").withColumn("host_", host)
    out = (out.join(lost.select(F.col("host").alias("host_"), "digest", "removed_words"), ["host_", "digest"], "left")
           .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")))
    failed = (F.col("n_words") < params.fewest_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * params.repeat_percent)
    depleted = (F.col("n_words") - F.col("removed_words")) * 100 < F.col("n_words") * params.kept_percent
    return out.drop("host_", "digest").withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
