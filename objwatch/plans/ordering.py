"""Totals and positions over one global order, without a window over all rows.

Rows are dealt to consecutive ranges of the order ("buckets", a non-decreasing function of it).
Windows run inside a bucket; what earlier buckets amount to is added up on one row per bucket
and joined back. That is done in two levels: buckets within groups of COARSE consecutive ones, and then one row
per group, which is the only table that one task sees whole: a row for some ten million of the trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType


def _names(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


#: Buckets of a group.
COARSE = 4096


def _group(frame: DataFrame) -> Column:
    """The group of a bucket, a non-decreasing function of it: numbers by ranges, structs (file, block ...) by their first field."""
    kind = frame.schema["_bucket"].dataType
    if isinstance(kind, NumericType):
        return F.floor(F.col("_bucket") / COARSE)
    return F.col("_bucket")[kind.names[0]] if isinstance(kind, StructType) else F.col("_bucket")


def _before(sums: DataFrame, columns: tuple[str, ...] = ("_sum",)) -> DataFrame:
    """(_b, _before ...): of each bucket of sums(_bucket, columns), the sums over all buckets before it, as columns named _before and the column."""
    grouped = sums.withColumn("_group", _group(sums))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own, all_ = Window.partitionBy("_group").orderBy(F.col("_bucket").asc_nulls_first()), Window.orderBy(F.col("_group").asc_nulls_first())
    inside = grouped.select("_group", F.col("_bucket").alias("_b"), *[upto(c, own).alias(f"_inside{c}") for c in columns])
    tops = grouped.groupBy("_group").agg(*[F.sum(c).alias(c) for c in columns])
    tops = tops.select(F.col("_group").alias("_g"), *[upto(c, all_).alias(f"_outside{c}") for c in columns])
    return inside.join(tops, F.col("_group").eqNullSafe(F.col("_g"))).select("_b", *[(F.col(f"_inside{c}") + F.col(f"_outside{c}")).alias(f"_before{c}") for c in columns])


def global_rank(df: DataFrame, bucket: Column, order: list[str], name: str = "cycle") -> DataFrame:
    """Add the position of each row, from 0, in the order (bucket, *order)."""
    dealt = df.withColumn("_bucket", bucket)
    offsets = _before(dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_sum")))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*_names(order))) - 1
    ranked = dealt.withColumn("_own", own).join(offsets, F.col("_bucket").eqNullSafe(F.col("_b")))
    return ranked.withColumn(name, F.col("_before_sum") + F.col("_own")).drop("_bucket", "_b", "_before_sum", "_own")


def running_total(df: DataFrame, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of value over all rows up to and including this one."""
    return running_totals(df, bucket, order, {value: name})


def running_totals(df: DataFrame, bucket: Column, order: list[str], names: dict[str, str]) -> DataFrame:
    """Add the sums of several columns over all rows up to and including this one, under names[column]."""
    dealt = df.withColumn("_bucket", bucket)
    offsets = _before(dealt.groupBy("_bucket").agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in names]), tuple(names))
    w = Window.partitionBy("_bucket").orderBy(*_names(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"_own{v}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in names}).join(offsets, F.col("_bucket").eqNullSafe(F.col("_b")))
    out = out.withColumns({n: F.col(f"_before{v}") + F.col(f"_own{v}") for v, n in names.items()})
    return out.drop("_bucket", "_b", *[f"{x}{v}" for v in names for x in ("_before", "_own")])


def global_history(df: DataFrame, bucket: Column, order: list[str], value: str, n: int, name: str, keys: list[str] = ()) -> DataFrame:
    """Add the n-th last non-null value of all rows before this one: over the whole frame, or over those with the same keys.

    A row looks into its own bucket first; for what is missing there, each bucket carries the
    last n values of all buckets before it. So one key may have any share of the rows.
    """
    keys = list(keys)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*_names(order))
    dealt = df.withColumn("_bucket", bucket)
    seen = F.count(value).over(within.rowsBetween(Window.unboundedPreceding, -1))
    ordering = ", ".join(f"`{c}` ASC NULLS FIRST" for c in order)
    own = F.expr(f"lag(`{value}`, {n}) IGNORE NULLS OVER (PARTITION BY {', '.join([*[f'`{k}`' for k in keys], '_bucket'])} ORDER BY {ordering})")
    local = dealt.withColumn("_seen", F.coalesce(seen, F.lit(0))).withColumn("_own", own)

    back = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    tails = dealt.where(F.col(value).isNotNull()).withColumn("_back", back).where(F.col("_back") <= n)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.least(F.count(value), F.lit(n)).alias("_n"))
    upto = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_n", upto.alias("_upto"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = tails.join(counts, same).select(*[F.col(f"_k{i}").alias(f"_v{i}") for i in range(len(keys))], (F.col("_upto") + F.col("_n") - F.col("_back")).alias("_at"), F.col(value).alias("_value"))
    wanted = local.join(counts, same).withColumn("_want", F.when(F.col("_seen") < n, F.col("_upto") - (n - F.col("_seen"))))
    found = F.col("_want") == F.col("_at")
    for i in range(len(keys)):
        found &= F.col(f"_k{i}").eqNullSafe(F.col(f"_v{i}"))
    out = wanted.join(numbered, found, "left").withColumn(name, F.when(F.col("_seen") >= n, F.col("_own")).otherwise(F.col("_value")))
    return out.select(*[c for c in df.columns if c != name], name)
