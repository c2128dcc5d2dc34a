"""Global ranks, exact quantiles, ROC-AUC and deterministic hold-out splits, without one-task windows.

A window with an ORDER BY but no PARTITION BY moves every row into one task.  Everything
global here goes through :func:`value_ranks` instead:

1. collapse to distinct ``(group, value)`` with counts (partial aggregation; a value shared by
   a third of the rows becomes one row);
2. range-partition those rows by ``(group, value)`` and write them once, each with the number
   of its range (Spark samples the bounds; ranks are exact for any bounds);
3. total the counts per ``(group, range)`` -- a table of at most groups + ranges rows -- and
   turn it into offsets with a window over that small table;
4. inside each ``(group, range)`` a partitioned running sum gives the rank within the range;
   offset + in-range rank is the global rank.

Every shuffle is keyed, and the number of ranges follows the shuffle partitions (or AQE's
advisory size), so it is not capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acqlens.session import scratch_path


def value_ranks(
    df: DataFrame,
    value_col: str,
    group_cols: list[str] | None = None,
    weight_col: str | None = None,
    sum_cols: list[str] | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Distinct values with their counts and global position inside their group.

    Returns ``group_cols + [value_col, cnt, <sum_cols>, before, n]`` where ``before`` is the
    number of rows in the group with a strictly smaller value and ``n`` the group size.
    NULL values are dropped (pandas ranks ignore them too).
    """
    g = list(group_cols or [])
    sums = list(sum_cols or [])
    cnt = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    counts = (
        df.filter(F.col(value_col).isNotNull())
        .groupBy(*g, value_col)
        .agg(cnt.alias("cnt"), *[F.sum(c).alias(c) for c in sums])
    )
    order = [*g, value_col]
    ranged = counts.repartitionByRange(n_buckets, *order) if n_buckets else counts.repartitionByRange(*order)
    # written, so that the ranges are the same ones in every later stage and retry
    path = scratch_path(df.sparkSession, "value-ranks")
    ranged.withColumn("bucket", F.spark_partition_id()).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)

    totals = counts.groupBy(*g, "bucket").agg(F.sum("cnt").alias("bcnt"))
    by_group = Window.partitionBy(*g) if g else Window.partitionBy()
    offsets = totals.select(
        *g,
        "bucket",
        (F.sum("bcnt").over(by_group.orderBy("bucket")) - F.col("bcnt")).alias("offset"),
        F.sum("bcnt").over(by_group).alias("n"),
    )
    in_bucket = Window.partitionBy(*g, "bucket").orderBy(value_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counts.withColumn("cum", F.sum("cnt").over(in_bucket)).alias("r")
    o = offsets.alias("o")
    same = F.col("r.bucket") == F.col("o.bucket")
    for c in g:  # a null group is a group
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    # offsets has about groups + ranges rows; AQE turns this into a broadcast join at runtime
    return ranked.join(o, same).select(
        *[F.col(f"r.{c}").alias(c) for c in [*g, value_col, "cnt", *sums]],
        (F.col("offset") + F.col("cum") - F.col("cnt")).alias("before"), "n"
    )


def average_rank(ranks: DataFrame) -> Column:
    """1-based rank with ties averaged (pandas ``rank(method='average')``)."""
    return F.col("before") + (F.col("cnt") + 1) / 2.0


def pct_rank(df: DataFrame, value_col: str, out_col: str, group_cols: list[str] | None = None,
             n_buckets: int | None = None) -> DataFrame:
    """``Series.rank(pct=True)``: average rank / n, joined back to every input row by value."""
    g = list(group_cols or [])
    r = value_ranks(df, value_col, g, n_buckets=n_buckets)
    r = r.select(*g, value_col, (average_rank(r) / F.col("n")).alias(out_col))
    # equi-join on (group, value); a value held by many rows is a skewed key on the left
    # side only, which AQE's skew-join splitting handles
    return df.join(r, g + [value_col], "left")


def exact_percentiles(
    df: DataFrame,
    value_col: str,
    probs: list[float],
    group_cols: list[str] | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Exact linearly-interpolated percentiles per group (numpy / ``percentile`` semantics).

    Only the <= 2 distinct values around each target position are kept per (group, p), so
    nothing is ever collected per group.  Output: ``group_cols + [p, value]``.
    """
    g = list(group_cols or [])
    r = value_ranks(df, value_col, g, n_buckets=n_buckets)
    p_arr = F.array(*[F.lit(float(p)) for p in probs])
    pos = F.col("p") * (F.col("n") - 1)
    lo = F.floor(pos)
    hi = F.ceil(pos)
    first, last = F.col("before"), F.col("before") + F.col("cnt") - 1
    hits = (
        r.select("*", F.explode(p_arr).alias("p"))
        .withColumn("lo", lo)
        .withColumn("hi", hi)
        .filter(((F.col("lo") >= first) & (F.col("lo") <= last)) | ((F.col("hi") >= first) & (F.col("hi") <= last)))
    )
    v = F.col(value_col).cast("double")
    agg = hits.groupBy(*g, "p").agg(
        F.max(F.when((F.col("lo") >= first) & (F.col("lo") <= last), v)).alias("v_lo"),
        F.max(F.when((F.col("hi") >= first) & (F.col("hi") <= last), v)).alias("v_hi"),
        F.first(F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1))).alias("frac"),
    )
    return agg.select(
        *g, "p", (F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))).alias("value")
    )


def exact_medians(df: DataFrame, value_cols: list[str], group_cols: list[str], n_buckets: int | None = None) -> DataFrame:
    """Exact interpolated median of several columns per group, one wide row per group.

    The columns are unpivoted to ``(group, metric, value)`` and ranked in a single pass keyed
    by ``(group, metric)``, then pivoted back over the known metric names (no distinct pass).
    """
    long = df.select(*group_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot(
        group_cols, value_cols, "metric", "v")
    med = exact_percentiles(long, "v", [0.5], group_cols + ["metric"], n_buckets)
    return med.groupBy(*group_cols).pivot("metric", value_cols).agg(F.first("value"))


def roc_auc(scored: DataFrame, label_col: str, score_col: str, group_cols: list[str] | None = None,
            n_buckets: int | None = None) -> DataFrame:
    """Mann-Whitney ROC-AUC with tie-averaged ranks (equals sklearn / MLlib with exact bins)."""
    g = list(group_cols or [])
    base = scored.select(*g, F.col(score_col).cast("double").alias("score"),
                         F.col(label_col).cast("long").alias("pos"))
    r = value_ranks(base, "score", g, sum_cols=["pos"], n_buckets=n_buckets)
    agg = r.groupBy(*g).agg(
        F.sum(F.col("pos") * average_rank(r)).alias("rank_sum"),
        F.sum("pos").alias("n_pos"),
        F.sum("cnt").alias("n"),
    )
    n_neg = F.col("n") - F.col("n_pos")
    pos, neg = F.col("n_pos").cast("double"), n_neg.cast("double")  # their products overflow a long
    auc = (F.col("rank_sum") - pos * (pos + 1) / 2.0) / (pos * neg)
    return agg.select(*g, F.when((F.col("n_pos") > 0) & (n_neg > 0), auc).alias("roc_auc"))


def split_hash(key: Column, seed: int) -> Column:
    """A 60-bit integer from md5(seed|key): a partition-independent sort key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 15), 16, 10).cast("long")


_PREFIX_BITS = 44  # the hash has 60 bits: 2**16 prefixes


def holdout_cutoffs(df: DataFrame, key_col: str, test_size: float, seed: int, stratify_col: str | None = None) -> DataFrame:
    """(stratum, cutoff): the hash of the last test row of each stratum.

    Counts per (stratum, hash prefix) -- at most 65,536 rows per stratum -- show the prefix in
    which the ``ceil(test_size*n)``-th smallest hash lies and its place there; a second pass
    over the rows of that prefix alone finds it.  A null stratum is a stratum.
    """
    stratum = F.col(stratify_col) if stratify_col else F.lit(0)
    keyed = df.select(stratum.alias("stratum"), split_hash(F.col(key_col), seed).alias("h")).filter(F.col("h").isNotNull())
    prefix = F.shiftright("h", _PREFIX_BITS)
    counts = keyed.groupBy("stratum", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("stratum")
    place = counts.select(
        "stratum", "prefix", "c",
        (F.sum("c").over(w.orderBy("prefix")) - F.col("c")).alias("before"),
        F.ceil(F.sum("c").over(w) * float(test_size)).alias("take"),
    ).filter((F.col("before") < F.col("take")) & (F.col("before") + F.col("c") >= F.col("take")))
    k, p = keyed.alias("k"), F.broadcast(place.alias("p"))  # one row per stratum
    inside = k.join(p, F.col("k.stratum").eqNullSafe(F.col("p.stratum")) & (F.shiftright("k.h", _PREFIX_BITS) == F.col("p.prefix")))
    numbered = inside.select(F.col("k.stratum").alias("stratum"), F.col("k.h").alias("h"), (F.col("take") - F.col("before")).alias("nth")).withColumn(
        "i", F.row_number().over(Window.partitionBy("stratum").orderBy("h")))
    return numbered.filter(F.col("i") == F.col("nth")).select("stratum", F.col("h").alias("cutoff"))


def holdout_split(
    df: DataFrame,
    key_col: str,
    test_size: float,
    seed: int,
    stratify_col: str | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Adds ``is_test``: within each stratum the ``ceil(test_size*n)`` smallest hash keys are test.

    Exact per-stratum counts like ``train_test_split``, reproducible on any partitioning
    (it does not reproduce scikit-learn's permutation).  Rows are compared with their
    stratum's cutoff where they are; no row is shuffled.  Rows without a key are training rows.
    """
    cut = F.broadcast(holdout_cutoffs(df, key_col, test_size, seed, stratify_col).alias("cut_"))  # one row per stratum
    stratum = F.col(f"rows_.{stratify_col}") if stratify_col else F.lit(0)
    test = F.coalesce(split_hash(F.col(f"rows_.{key_col}"), seed) <= F.col("cut_.cutoff"), F.lit(False))
    return (df.alias("rows_").join(cut, stratum.eqNullSafe(F.col("cut_.stratum")), "left")
            .select(*[F.col(f"rows_.{c}").alias(c) for c in df.columns], test.alias("is_test")))


def train_counts(df: DataFrame, test_size: float, stratify_col: str) -> DataFrame:
    """(stratum, n): training rows per stratum of :func:`holdout_split`, from the counts alone."""
    n = F.count(F.lit(1))
    return df.groupBy(stratify_col).agg((n - F.ceil(n * float(test_size))).alias("n"))
