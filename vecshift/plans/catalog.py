"""Registry of all queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def _with_session_setup(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpoint_dir(spark)
        return fn(spark, sf_dir)
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries  # noqa: F401  (registers)
    from .queries import QUERIES
    return {k: _with_session_setup(v) for k, v in QUERIES.items()}


def all_oracle_sql() -> dict[str, str]:
    from . import queries  # noqa: F401  (registers)
    from .oracle import ORACLE
    return dict(ORACLE)
