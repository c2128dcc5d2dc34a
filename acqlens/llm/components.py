"""Connected components over an edge table, by smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acqlens.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every vertex that has an edge; label is the smallest id reachable.

    Each round every vertex takes the smallest label among its neighbours and then that
    label's own label, so paths shorten by halves.  Labels live in stored tables; only the
    number of changed rows reaches the driver.  Loops and repeated edges are harmless.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    both = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("id"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("label").alias("m"))
        hooked = labels.join(near, F.col("id") == F.col("u")).select(
            "id", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        root = labels.select(F.col("id").alias("r"), F.col("label").alias("jump"))
        after = stored(hooked.join(root, F.col("new") == F.col("r"), "left").select(
            "id", "old", F.least("new", F.coalesce("jump", "new")).alias("label")), "cc-labels")
        if not after.where("label <> old").limit(1).count():
            return after.select("id", "label")
        labels = after.select("id", "label")
