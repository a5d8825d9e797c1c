"""Access to signals over time, as columns over windows of a key.

A cell that is not null is an update. `prev` and `history` count updates strictly before the row,
whether or not the row itself is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objwatch.plans import ordering


def _over(keys: list[str], order: list[str]) -> str:
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    return f"({part}ORDER BY {', '.join(f'`{c}`' for c in order)})"


def current(signal: str) -> Column:
    return F.col(signal)


def get(signal: str) -> Column:
    """The value if the row updates the signal, else null."""
    return F.col(signal)


def fresh(signal: str) -> Column:
    return F.col(signal).isNotNull()


def default(value: Column, other) -> Column:
    return F.coalesce(value, other if isinstance(other, Column) else F.lit(other))


def last(signal: str, keys: list[str], order: list[str], other=None) -> Column:
    """The last update up to and including this row, else other."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(signal, ignorenulls=True).over(w)
    return held if other is None else default(held, other)


def history(signal: str, n: int, keys: list[str], order: list[str], other=None) -> Column:
    """The n-th last update before this row (n >= 1), or the row's own value (n = 0), else other."""
    n = abs(n)
    value = F.col(signal) if n == 0 else F.expr(f"lag(`{signal}`, {n}) IGNORE NULLS OVER {_over(keys, order)}")
    return value if other is None else default(value, other)


def prev(signal: str, keys: list[str], order: list[str], other=None) -> Column:
    return history(signal, 1, keys, order, other)


def after_row(signal: str, n: int, keys: list[str], order: list[str]) -> Column:
    """history(n) as it is after this row, until the object's next one: the row's own update counts."""
    before = history(signal, n, keys, order)
    earlier = F.col(signal) if n == 1 else history(signal, n - 1, keys, order)
    return F.when(F.col(signal).isNotNull(), earlier).otherwise(before)


def retained(signal: str, n: int, keys: list[str], order: list[str]) -> Column:
    """The last n + 1 updates up to this row, newest first."""
    values = [after_row(signal, k, keys, order) for k in range(1, n + 2)]
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def class_history(df: DataFrame, signal: str, n: int, order: list[str], bucket: Column, name: str) -> DataFrame:
    """Add history(n) over all objects of a class. bucket is a non-decreasing function of the order."""
    return ordering.global_history(df, bucket, order, signal, n, name)


def split_history(df: DataFrame, signal: str, n: int, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Add history(n) by keys where a single object may have more rows than one task should see: its rows are dealt by bucket, too."""
    return ordering.global_history(df, bucket, order, signal, n, name, keys)
