"""Medians from mergeable quantile sketches (KLL), per group and day.

Exact medians need all values again for every new period.  A sketch of a day is a few kilobytes
whatever the rows, and sketches of any days merge into one of the whole span.  With size ``k`` the
rank of a quantile is off by at most RANK_ERROR[k] of the rows (in 99 of 100 sketches); groups of at
most ``k`` values are exact up to the choice between two middle ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_ERROR = {200: 0.0133, 800: 0.0037, 4000: 0.0009}  # of a single quantile, published for KLL sketches
K = 800


def sketch(df: DataFrame, groups: list[str], values: list[str], k: int = K) -> DataFrame:
    """One sketch column ``<value>_kll`` per value, by ``groups``; nulls are left out."""
    return df.groupBy(*groups).agg(*[F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(k)).alias(f"{v}_kll") for v in values])


def quantiles(sketches: DataFrame, groups: list[str], values: list[str], q: float = 0.5, k: int = K) -> DataFrame:
    """The ``q`` quantile of each value over all sketches of a group; null without values."""
    merged = sketches.groupBy(*groups).agg(*[F.kll_merge_agg_double(f"{v}_kll", F.lit(k)).alias(v) for v in values])
    return merged.select(*groups, *[F.when(F.kll_sketch_get_n_double(v) > 0, F.kll_sketch_get_quantile_double(v, F.lit(float(q)))).alias(v) for v in values])
