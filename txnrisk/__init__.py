"""txnrisk — transaction-risk analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames and is built from
Catalyst expressions, so the optimizer sees the whole plan (pushdown,
pruning, partial aggregation, AQE) and nothing row-shaped crosses into
Python.
"""

from txnrisk.session import ensure_session_defaults, get_spark

__all__ = ["get_spark", "ensure_session_defaults"]
