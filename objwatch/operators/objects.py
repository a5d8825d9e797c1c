"""Collections of objects: which row updates which object, since when each is alive, what it is now."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objwatch.operators import temporal
from objwatch.plans import ordering


@dataclass(frozen=True)
class ObjectSet:
    """Rows that update objects of one class: key is not null; order is the total order of rows.

    rows has key, order, and signals. Everything the class offers is one shuffle by key.
    """

    rows: DataFrame
    key: str
    order: list[str]
    signals: list[str]
    keys: list[str] = field(default_factory=list)  # what state is kept by; the key, and the life if objects may end
    ends: str | None = None  # the column that says after which row an object has ended, if objects may

    def __post_init__(self):
        if not self.keys:
            object.__setattr__(self, "keys", [self.key])

    @cached_property
    def single(self) -> bool:
        """Whether all rows are one object's (whose lives never overlap), by the least and the greatest key."""
        least, most = self.rows.agg(F.min(self.key), F.max(self.key)).first()
        return least == most

    # signals over time
    def current(self, signal: str) -> Column:
        return temporal.current(signal)

    def last(self, signal: str, other=None) -> Column:
        return temporal.last(signal, self.keys, self.order, other)

    def prev(self, signal: str, other=None) -> Column:
        return temporal.prev(signal, self.keys, self.order, other)

    def history(self, signal: str, n: int, other=None) -> Column:
        return temporal.history(signal, n, self.keys, self.order, other)

    def fresh(self, signal: str) -> Column:
        return temporal.fresh(signal)

    def retain(self, signal: str, n: int) -> Column:
        return temporal.retained(signal, n, self.keys, self.order)

    def let(self, name: str, value: Column, when: Column | None = None) -> ObjectSet:
        """A derived signal, which has updates where when holds and value is not null, and history like any other."""
        if name in self.rows.columns:
            raise ValueError(f"{name} is there already")
        column = value if when is None else F.when(when, value)
        return replace(self, rows=self.rows.withColumn(name, column), signals=[*self.signals, name])

    # lives of objects
    def activations(self) -> DataFrame:
        """The first row of each object."""
        w = Window.partitionBy(*self.keys).orderBy(*self.order)
        return self.rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def lives(self) -> DataFrame:
        """(keys, first, last): the first and last order value (one struct) of each object. Adds up before the shuffle."""
        at = F.struct(*self.order)
        return self.rows.groupBy(*self.keys).agg(F.min(at).alias("first"), F.max(at).alias("last"))

    def spans(self, at: str) -> DataFrame:
        """(keys, start, end): when each object starts and, unless it is null, ends, by the number `at` of those rows. Adds up before the shuffle."""
        end = F.lit(None).cast(dict(self.rows.dtypes)[at]) if self.ends is None else F.max(F.when(F.col(self.ends), F.col(at)))
        return self.rows.groupBy(*self.keys).agg(F.min(at).alias("start"), end.alias("end"))

    def snapshot(self, until: Column | None = None) -> DataFrame:
        """The last value of each signal of each live object, of the rows where until holds. Objects that have ended by then are not there."""
        rows = self.rows if until is None else self.rows.where(until)
        at = F.struct(*self.order)
        held = [F.max_by(F.col(s), F.when(F.col(s).isNotNull(), at)).alias(s) for s in self.signals]
        if self.ends is None:
            return rows.groupBy(*self.keys).agg(*held)
        return rows.groupBy(*self.keys).agg(*held, F.bool_or(self.ends).alias("_gone")).where("not _gone").drop("_gone")

    def ending(self, when: Column) -> ObjectSet:
        """Objects end after a row where when holds: later rows of the key are a new object's, told apart by the column life.

        An object is alive in the cycle of the row that ends it, and gone from the next one on and at clock ticks of that time.
        """
        w = Window.partitionBy(self.key).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        life = F.coalesce(F.sum(F.when(when, 1).otherwise(0)).over(w), F.lit(0)).alias("life")
        ended = F.coalesce(when, F.lit(False)).alias("ends")
        return replace(self, rows=self.rows.select("*", life, ended), keys=[self.key, "life"], ends="ends")

    def versions(self, lasts: list[str] = (), histories: dict[str, int] | None = None, at: str | None = None) -> DataFrame:
        """What each object is between its rows, as intervals [lo, hi) of the order number `at`.

        Without histories, a row gives one version, up to the object's next row, or of its own cycle only where it ends the
        object. With them (depth by signal), it gives two: the row's own cycle, and the rest, where the row's own update
        counts as a past one. Columns: keys, lo, hi (null: still so), is_fresh, `s` for each
        of lasts (held value), `s_now` (the row's own value, null in the rest), `s_1` ... `s_n` for histories.
        """
        at = at or self.order[0]
        w = Window.partitionBy(*self.keys).orderBy(*self.order)
        held = [self.last(s).alias(s) for s in lasts]
        own = [F.col(s).alias(f"{s}_now") for s in dict.fromkeys([*lasts, *(histories or {})])]
        place = F.lead(at).over(w)
        place = (place if self.ends is None else F.when(F.col(self.ends), F.col(at) + 1).otherwise(place)).alias("_next")
        if not histories:
            whole = self.rows.select(*self.keys, F.col(at).alias("lo"), place, *held)
            return whole.withColumnRenamed("_next", "hi").withColumn("is_fresh", F.lit(None).cast("boolean"))
        past = [f for s, n in histories.items() for k in range(1, n + 1) for f in (self.history(s, k).alias(f"{s}_{k}_then"), temporal.after_row(s, k, self.keys, self.order).alias(f"{s}_{k}_after"))]
        both = self.rows.select(*self.keys, F.col(at).alias("lo"), place, *held, *own, *past).withColumn("is_fresh", F.explode(F.array(F.lit(True), F.lit(False))))
        out = both.withColumn("hi", F.when(F.col("is_fresh"), F.col("lo") + 1).otherwise(F.col("_next"))).withColumn("lo", F.when(F.col("is_fresh"), F.col("lo")).otherwise(F.col("lo") + 1))
        for s, n in histories.items():
            for k in range(1, n + 1):
                out = out.withColumn(f"{s}_{k}", F.when(F.col("is_fresh"), F.col(f"{s}_{k}_then")).otherwise(F.col(f"{s}_{k}_after"))).drop(f"{s}_{k}_then", f"{s}_{k}_after")
        for s in dict.fromkeys([*lasts, *histories]):
            out = out.withColumn(f"{s}_now", F.when(F.col("is_fresh"), F.col(f"{s}_now")))
        return out.drop("_next").where("hi is null or lo < hi")


def objects(df: DataFrame, key: str, signals: list[str], order: list[str]) -> ObjectSet:
    """The rows of a trace that update objects of one class. One trace may carry several classes, each with its own key."""
    return ObjectSet(df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, *order, *signals])), key, order, signals)


def active_at(objs: ObjectSet, points: DataFrame, at: str, bucket: Column, ticks: bool = False) -> DataFrame:
    """(at, n_active): how many objects are alive at each value of points[at], those that start there included.

    An object that ends is alive in the cycle of its end; ticks: but not at a tick of that time, as rows come before ticks.
    Starts count one more and ends one less, so the cost is objects and points. bucket is a non-decreasing function of at.
    """
    spans, kind = objs.spans(at), dict(objs.rows.dtypes)[at]
    edges = spans.select(F.col("start").alias(at), F.lit(1).alias("d"))
    if objs.ends is not None:
        edges = edges.unionByName(spans.where("end is not null").select((F.col("end") + (0 if ticks else 1)).cast(kind).alias(at), F.lit(-1).alias("d")))
    changes = edges.groupBy(at).agg(F.sum("d").alias("_d")).withColumn("_kind", F.lit(0))
    both = changes.unionByName(points.select(at).distinct().withColumns({"_d": F.lit(0).cast("bigint"), "_kind": F.lit(1)}))
    return ordering.running_total(both, bucket, [at, "_kind"], "_d", "n_active").where("_kind = 1").select(at, "n_active")
