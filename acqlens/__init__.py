"""acqlens: user-acquisition and player-lifecycle analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; all row work runs
as native Spark expressions (no Python UDFs).  Sub-packages:

- ``sources``   table readers, adapter views over the TPC-H style inputs, sinks
- ``functions`` pure ``Column`` expressions (scalar formulas, special functions, formatting)
- ``operators`` DataFrame -> DataFrame operators (KPIs, cohorts, RFM, ranks, budget, CLV, ML)
- ``plans``     the named query registry and matching DuckDB oracle SQL
- ``streaming`` Structured Streaming variants
"""

from acqlens.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
