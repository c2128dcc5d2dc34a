"""Named queries (Spark) and their DuckDB oracle statements.

Each entry pairs a ``(spark, sf_dir) -> DataFrame`` builder with the SQL that computes the
same table from the raw parquet views.  Floating columns whose last bits depend on
summation order (partitioning, engine) are listed per query in ``doubles`` and reported on
a binary grid of ``2**-bits`` on both sides (``round_half_even(x * 2**bits) / 2**bits``).
A binary grid, unlike a decimal one, never puts an exact decimal tie (money divided by a
day count) on a rounding midpoint, so summation-order noise cannot flip the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()
    bits: int = 24
    tags: tuple[str, ...] = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] = (), bits: int = 24):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(fn, sql, tuple(doubles), bits)
        return fn

    return deco


def _round_df(df: DataFrame, q: Query) -> DataFrame:
    if not q.doubles:
        return df
    k = float(2 ** q.bits)
    return df.withColumns({c: F.bround(F.col(c).cast("double") * k, 0) / k for c in q.doubles})


def _round_sql(q: Query) -> str:
    body = q.sql.strip().rstrip(";")
    if not q.doubles:
        return body
    k = f"{float(2 ** q.bits)!r}"
    repl = ", ".join(f"round_even(CAST({c} AS DOUBLE) * {k}, 0) / {k} AS {c}" for c in (f'"{d}"' for d in q.doubles))
    return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) AS q_"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from acqlens.plans import catalog  # noqa: F401  (populates REGISTRY)

    def wrap(q: Query):
        return lambda spark, sf_dir: _round_df(q.build(spark, sf_dir), q)

    return {name: wrap(q) for name, q in REGISTRY.items()}


def oracle_statements() -> dict[str, str]:
    from acqlens.plans import catalog  # noqa: F401

    return {name: _round_sql(q) for name, q in REGISTRY.items() if q.sql}
