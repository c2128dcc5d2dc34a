"""As-of join: what was known of a key at a point in time.

Facts and cutoffs of a key are sorted together by day, and each cutoff takes the running totals
(or last values) of the facts up to and including its day: one shuffle by key for any number of
cutoffs, and no range join that pairs every cutoff with every earlier fact.  Facts should come
collapsed to a row per (key, day), which bounds a hot key by its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(cutoffs: DataFrame, facts: DataFrame, key: str, at: str, sums: list[str], lasts: list[str] | None = None) -> DataFrame:
    """Each row of ``cutoffs`` (``key``, ``at``, any others) with the sum of each column of ``sums``
    and the last non-null value of each of ``lasts`` over the key's facts with ``at`` <= its own.

    Sums are 0 and last values null where there is no such fact.  Rows with a null key or day match
    nothing: facts of that kind are left out, cutoffs get 0 and null.  Of two facts at the same time
    the last value is that of the greater one, so results don't depend on the order of rows.
    """
    lasts = list(lasts or [])
    measures = [*sums, *lasts]
    others = [c for c in cutoffs.columns if c not in (key, at)]
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    marks = cutoffs.select(F.col(key).alias("key_"), F.col(at).alias("at_"), F.lit(1).alias("mark_"), F.struct(F.lit(0).alias("_"), *others).alias("row_"),
                           *[F.lit(None).cast(facts.schema[c].dataType).alias(f"m_{c}") for c in measures])
    rows = facts.where(known).select(F.col(key).alias("key_"), F.col(at).alias("at_"), F.lit(0).alias("mark_"),
                                     F.lit(None).cast(marks.schema["row_"].dataType).alias("row_"), *[F.col(c).alias(f"m_{c}") for c in measures])
    order = Window.partitionBy("key_").orderBy("at_", "mark_", *[f"m_{c}" for c in lasts]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    real = F.col("key_").isNotNull() & F.col("at_").isNotNull()
    run = marks.unionByName(rows).select(
        "key_", "at_", "mark_", "row_",
        *[F.coalesce(F.when(real, F.sum(f"m_{c}").over(order)), F.lit(0)).alias(c) for c in sums],
        *[F.when(real, F.last(f"m_{c}", ignorenulls=True).over(order)).alias(c) for c in lasts])
    return run.where("mark_ = 1").select(F.col("key_").alias(key), F.col("at_").alias(at), *[F.col(f"row_.{c}").alias(c) for c in others], *measures)
