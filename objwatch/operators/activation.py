"""When rules are evaluated: on rows, on rows with certain updates, or on clocks.

Clocks use whole numbers as times (microseconds, nanoseconds or cycles; all of one trace alike).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objwatch.operators.objects import ObjectSet

#: Seconds of a unit of duration; hertz of a unit of frequency.
SECONDS = {"ns": Fraction(1, 10**9), "us": Fraction(1, 10**6), "ms": Fraction(1, 1000), "s": Fraction(1), "min": Fraction(60), "h": Fraction(3600), "d": Fraction(86400), "w": Fraction(604800), "a": Fraction(31536000)}
HERTZ = {"uHz": Fraction(1, 10**6), "mHz": Fraction(1, 1000), "Hz": Fraction(1), "kHz": Fraction(1000), "MHz": Fraction(10**6), "GHz": Fraction(10**9)}


@dataclass(frozen=True)
class Gate:
    """A condition on which signals a row updates. names: those that every row it lets through has."""

    column: Column
    names: frozenset[str] = field(default_factory=frozenset)

    def __and__(self, other: Gate) -> Gate:
        return Gate(self.column & other.column, self.names | other.names)

    def __or__(self, other: Gate) -> Gate:
        return Gate(self.column | other.column, self.names & other.names)

    def check(self, reads: set[str]) -> None:
        """A rule may read in a row only what the gate makes sure of."""
        if reads - self.names:
            raise ValueError(f"the gate does not imply an update of {sorted(reads - self.names)}")


def always() -> Gate:
    return Gate(F.lit(True))


def fresh(*signals: str) -> Gate:
    """All of the signals have updates."""
    gate = Gate(F.lit(True))
    for s in signals:
        gate &= Gate(F.col(s).isNotNull(), frozenset([s]))
    return gate


@dataclass(frozen=True)
class Every:
    """A clock; per_object: one for each object, from its start on."""

    seconds: Fraction
    per_object: bool = False

    def step(self, unit: str = "us") -> int:
        """The period in whole units."""
        n = self.seconds / SECONDS[unit]
        if n.denominator != 1 or n <= 0:
            raise ValueError(f"{self.seconds} s is no positive whole number of {unit}")
        return int(n)


def every(period: str, per: str | None = None) -> Every:
    """A clock by duration ("200ms", "0.2s", "1d") or frequency ("5Hz")."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*", period)
    if not m or m[2] not in SECONDS | HERTZ:
        raise ValueError(f"no duration or frequency: {period!r}")
    n = Fraction(m[1])
    if n <= 0:
        raise ValueError("a period must be positive")
    return Every(n * SECONDS[m[2]] if m[2] in SECONDS else 1 / (n * HERTZ[m[2]]), per == "object")


def global_ticks(rows: DataFrame, time: str, step: int, zero: int = 0, until: int | None = None, name: str = "tick") -> DataFrame:
    """Times zero + step, zero + 2 step ... up to the last time of rows, or until."""
    end = F.max(time) if until is None else F.greatest(F.max(time), F.lit(until))
    one = rows.agg(end.alias("_end")).where(F.col("_end") >= zero + step)
    return one.select(F.explode(F.sequence(F.lit(zero + step).cast("bigint"), F.col("_end").cast("bigint"), F.lit(step).cast("bigint"))).alias(name))


def local_ticks(objs: ObjectSet, time: str, step: int, end: int, name: str = "tick") -> DataFrame:
    """(keys, tick): for each object the times start + step, start + 2 step ... up to end, and before its own end if it has one."""
    lives = _lives_until(objs, time, end).where(F.col("start") + step <= F.col("_until"))
    return lives.select(*objs.keys, F.explode(F.sequence((F.col("start") + step).cast("bigint"), F.col("_until"), F.lit(step).cast("bigint"))).alias(name))


def _lives_until(objs: ObjectSet, time: str, end: int) -> DataFrame:
    """(keys, start, end, _until): the last time at which an object may tick; it has ended at a tick of the time of the row that ends it."""
    return objs.spans(time).withColumn("_until", F.least(F.lit(end), F.col("end") - 1).cast("bigint"))


def ticks_of_objects(objs: ObjectSet, time: str, step: int, end: int, zero: int = 0, name: str = "tick") -> DataFrame:
    """(keys, tick): the ticks of the shared clock at which each object is alive."""
    first = F.greatest(F.ceil((F.col("start") - zero) / step), F.lit(1)) * step + zero
    lives = _lives_until(objs, time, end).withColumn("_first", first.cast("bigint")).where(F.col("_first") <= F.col("_until"))
    return lives.select(*objs.keys, F.explode(F.sequence(F.col("_first"), F.col("_until"), F.lit(step).cast("bigint"))).alias(name))


def merged_ticks(frames: dict[str, DataFrame], name: str = "tick") -> DataFrame:
    """(tick, clocks): one row for each time at which any clock ticks, with the sorted names of those that do."""
    both = None
    for clock, frame in frames.items():
        own = frame.select(name, F.lit(clock).alias("_clock"))
        both = own if both is None else both.unionByName(own)
    return both.groupBy(name).agg(F.array_sort(F.collect_set("_clock")).alias("clocks"))


def state_at(objs: ObjectSet, ticks: DataFrame, time: str, lasts: list[str], histories: dict[str, int] | None = None, name: str = "tick") -> DataFrame:
    """(keys, tick, signals): what each object holds at its ticks; an update at the time of a tick counts.

    ticks is (keys, tick). Updates and ticks are sorted together by object: one shuffle and no
    join of ranges. An object that has ended by a tick has no row there. With histories, `s_1` ... `s_n` are the last updates; on a tick nothing is
    fresh, so `s_1` is the held value.
    """
    signals = list(dict.fromkeys([*lasts, *(histories or {})]))
    order = [c for c in objs.order if c != time]
    gone = F.lit(False) if objs.ends is None else F.col(objs.ends)
    updates = objs.rows.select(*objs.keys, F.col(time).cast("bigint").alias(name), F.lit(0).alias("_kind"), gone.alias("_gone"), *order, *signals)
    own = ticks.select(*objs.keys, F.col(name).cast("bigint"), F.lit(1).alias("_kind"), F.lit(False).alias("_gone"), *[F.lit(None).cast(dict(objs.rows.dtypes)[c]).alias(c) for c in [*order, *signals]])
    sort = [name, "_kind", *order]
    w = Window.partitionBy(*objs.keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    part = f"(PARTITION BY {', '.join(f'`{k}`' for k in objs.keys)} ORDER BY {', '.join(f'`{c}`' for c in sort)})"
    held = [F.last(s, ignorenulls=True).over(w).alias(s) for s in lasts]
    past = [F.expr(f"lag(`{s}`, {k}) IGNORE NULLS OVER {part}").alias(f"{s}_{k}") for s, n in (histories or {}).items() for k in range(1, n + 1)]
    alive = [] if objs.ends is None else [F.max("_gone").over(w).alias("_gone")]
    found = updates.unionByName(own).select(*objs.keys, name, "_kind", *alive, *held, *past).where("_kind = 1").drop("_kind")
    return found.where("not _gone").drop("_gone") if alive else found
