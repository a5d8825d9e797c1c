"""The registered monitoring queries and, for each that SQL can express, the same in SQL.

Objects are the users of `events`; a row of it is a cycle, in order of time; the signals click,
purchase, error, signup and view have an update in the rows of their kind.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL. Keys of verdicts, which are arrays, are registered as text."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumn("key", F.array_join(F.transform("key", lambda k: k.cast("string")), ",")) if dict(out.dtypes).get("key") == "array<bigint>" else out

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


from objwatch.plans import (  # noqa: E402, F401  (registering)
    queries_object,
    queries_output,
    queries_scalar,
    queries_source,
    queries_stream,
    queries_world,
)
