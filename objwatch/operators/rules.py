"""Rules over one object, and verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objwatch.operators.activation import Gate, always, fresh
from objwatch.operators.objects import ObjectSet

#: Columns of a verdict.
VERDICT = ["rule", "level", "cycle_kind", "cycle_id", "ts", "key", "value"]
LEVELS = ("info", "alert", "violation")


@dataclass(frozen=True)
class Expr:
    """A column together with the signals that it reads in the row itself."""

    column: Column
    reads: frozenset[str] = field(default_factory=frozenset)

    def _with(self, other, op: Callable) -> Expr:
        if isinstance(other, Expr):
            return Expr(op(self.column, other.column), self.reads | other.reads)
        return Expr(op(self.column, other), self.reads)

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: a / b)

    def __mod__(self, o):
        return self._with(o, lambda a, b: a % b)

    def __lt__(self, o):
        return self._with(o, lambda a, b: a < b)

    def __le__(self, o):
        return self._with(o, lambda a, b: a <= b)

    def __gt__(self, o):
        return self._with(o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._with(o, lambda a, b: a >= b)

    def __eq__(self, o):
        return self._with(o, lambda a, b: a == b)

    def __ne__(self, o):
        return self._with(o, lambda a, b: a != b)

    def __and__(self, o):
        return self._with(o, lambda a, b: a & b)

    def __or__(self, o):
        return self._with(o, lambda a, b: a | b)

    def __invert__(self):
        return Expr(~self.column, self.reads)

    def __neg__(self):
        return Expr(-self.column, self.reads)

    def __abs__(self):
        return Expr(F.abs(self.column), self.reads)

    __hash__ = None


class Handle:
    """The object of a row, for rules: self.speed.now, .last(d), .prev(d), .history(n, d), .default(d), .fresh."""

    def __init__(self, objs: ObjectSet):
        self._objs = objs

    def __getattr__(self, signal: str) -> SignalHandle:
        if signal.startswith("_") or signal not in self._objs.rows.columns:
            raise AttributeError(signal)
        return SignalHandle(self._objs, signal)


@dataclass(frozen=True)
class SignalHandle:
    objs: ObjectSet
    signal: str

    @property
    def now(self) -> Expr:
        return Expr(self.objs.current(self.signal), frozenset([self.signal]))

    @property
    def fresh(self) -> Expr:
        return Expr(self.objs.fresh(self.signal))

    def get(self) -> Expr:
        return Expr(F.col(self.signal))

    def default(self, other) -> Expr:
        return Expr(F.coalesce(F.col(self.signal), F.lit(other)), frozenset([self.signal]))

    def last(self, other=None) -> Expr:
        return Expr(self.objs.last(self.signal, other))

    def history(self, n: int, other=None) -> Expr:
        """The n-th update before this row. It is gated like a read in the row, unless a default stands in."""
        return Expr(self.objs.history(self.signal, n, other), frozenset([self.signal]))

    def prev(self, other=None) -> Expr:
        return self.history(1, other)


def inferred_gate(reads: frozenset[str]) -> Gate:
    """All signals that a rule reads in the row must have updates; a rule that reads none has no gate and is refused."""
    if not reads:
        raise ValueError("the rule reads no signal in the row; say when it is evaluated")
    return fresh(*sorted(reads))


def verdicts(rows: DataFrame, rule: str, level: Column | str, value: Column, cycle: str, ts: str, key: Column | None, kind: str = "event") -> DataFrame:
    """rows as verdicts."""
    return rows.select(
        F.lit(rule).alias("rule"), (F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(kind).alias("cycle_kind"), F.col(cycle).cast("bigint").alias("cycle_id"),
        F.col(ts).alias("ts"), (F.lit(None) if key is None else F.array(key)).cast("array<bigint>").alias("key"), value.cast("string").alias("value"),
    )


def object_rule(objs: ObjectSet, name: str, guard, level: str, message: Column | str, when: Gate | None = None, otherwise: tuple[str, Column | str] | None = None, cycle: str = "cycle", ts: str = "ts") -> DataFrame:
    """Verdicts where guard holds for the object of the row.

    guard is a Column, or a function of a Handle; for a function, when is inferred from what it reads unless
    given. otherwise is (level, message) for rows where the guard is false; a null guard gives nothing.
    Both branches are one pass over the rows.
    """
    if level not in LEVELS or otherwise and otherwise[0] not in LEVELS:
        raise ValueError(f"levels are {LEVELS}")
    if callable(guard) and not isinstance(guard, Column):
        made = guard(Handle(objs))
        when = when or inferred_gate(made.reads)
        guard = made.column
    when = when or always()
    text = lambda m: F.lit(m) if isinstance(m, str) else m
    rows = objs.rows.withColumn("_guard", guard)
    if otherwise is None:
        fired = rows.withColumn("_value", text(message)).where(when.column & F.col("_guard"))
        return verdicts(fired, name, level, F.col("_value"), cycle, ts, F.col(objs.key))
    rows = rows.withColumn("_value", F.when(F.col("_guard"), text(message)).otherwise(text(otherwise[1])))
    fired = rows.where(when.column & F.col("_guard").isNotNull())
    return verdicts(fired, name, F.when(F.col("_guard"), level).otherwise(otherwise[0]), F.col("_value"), cycle, ts, F.col(objs.key))


def first_match(clauses: list[tuple]) -> Column:
    """The value of the first clause (guard, value) or (guard, value, gate) whose guard (and gate) holds and whose value is not null."""
    options = []
    for guard, value, *gate in clauses:
        holds = guard & gate[0].column if gate else guard
        options.append(F.when(holds, value if isinstance(value, Column) else F.lit(value)))
    return F.coalesce(*options)
