"""Rules quantified over objects, as joins of what objects are between their updates.

Every object contributes versions, each valid on an interval of cycles; a body is constant
where the versions that it binds overlap. So bindings are joined once per overlap and not once per
cycle, and per-cycle truth comes from adding up where satisfying intervals begin and end.
Overlaps are found by an equality join: of two intervals that overlap, one holds the first cycle of
the other. An interval is put into the one or two cells of a grid as wide as itself, its first cycle into one cell
of each grid; so a version makes as many rows as there are grids, a logarithm of the trace, however
long it lasts. Equalities in the body become further join keys by themselves, and near() adds some. A body
without either compares all pairs that live at the same time, which is reported by a warning; its grids
end at CROWDED cycles, so that no key has more than so many first cycles.

These joins are never broadcast: a side with its cells is many times the size that Spark estimates from the files.
They are sort-merge joins, which spill and whose skewed partitions Spark splits at run time.
"""

from __future__ import annotations

import contextlib
import io
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objwatch.operators.activation import state_at
from objwatch.operators.objects import ObjectSet
from objwatch.operators.rules import verdicts
from objwatch.plans import ordering


#: Cycles of a range over which one task adds up.
TOTALS = 1 << 14
#: Grids are BASE, BASE ** 2 ... cycles wide.
BASE = 8
#: The widest grid, as a power of BASE, of joins without any other key: longer intervals are put into each cell they meet. There,
#: an interval has a match in each of its cycles, so that costs little beside the result.
CROWDED = 4


def grids(end: int, most: int | None = None) -> int:
    """How many grids a trace of end cycles has: the last one's cells are at least as wide, or it is grid number most."""
    n = 1
    while BASE**n < end and n != most:
        n += 1
    return n


def _cell(at: Column, grid: Column) -> Column:
    return F.struct(grid.alias("grid"), F.floor(at / F.pow(F.lit(float(BASE)), grid)).alias("cell"))


def interval_cells(lo: Column, hi: Column, n: int | None = None) -> Column:
    """The cells, one or two, of [lo, hi) in the first grid that is at least as wide as it; all that it meets in grid n if that is narrower."""
    width = hi - lo
    grid = F.greatest(F.lit(1), F.ceil(F.log(float(BASE), width.cast("double"))).cast("int"))
    grid = F.when(F.pow(F.lit(float(BASE)), grid) < width, grid + 1).otherwise(grid)
    if n is not None:
        grid = F.least(grid, F.lit(n))
    first, last = (F.floor(x / F.pow(F.lit(float(BASE)), grid)) for x in (lo, hi - 1))
    return F.transform(F.sequence(first, last), lambda c: F.struct(grid.alias("grid"), c.alias("cell")))


def point_cells(at: Column, n: int) -> Column:
    """The cells of a cycle in all n grids. Of an interval and a cycle in it, they have exactly one in common."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda g: _cell(at, g))


def joined_overlaps(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], end: int, on: Column | None = None, most: int | None = None) -> DataFrame:
    """left and right joined where their intervals, columns a and b, overlap and `on` holds; each pair once. most: see grids()."""
    n = grids(end, most)
    tagged = lambda cells, role: F.transform(cells, lambda c: F.struct(F.lit(role).alias("role"), c["grid"].alias("grid"), c["cell"].alias("cell")))
    lo, hi, low, high = F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1])
    one = left.withColumn("_a", F.explode(F.concat(tagged(point_cells(lo, n), 0), tagged(interval_cells(lo, hi, n), 1))))
    two = right.withColumn("_b", F.explode(F.concat(tagged(interval_cells(low, high, n), 0), tagged(point_cells(low, n), 1))))
    one = one.select("*", F.col("_a.role").alias("_ra"), F.col("_a.grid").alias("_ga"), F.col("_a.cell").alias("_ca")).drop("_a")
    two = two.select("*", F.col("_b.role").alias("_rb"), F.col("_b.grid").alias("_gb"), F.col("_b.cell").alias("_cb")).drop("_b")
    met = (F.col("_ra") == F.col("_rb")) & (F.col("_ga") == F.col("_gb")) & (F.col("_ca") == F.col("_cb"))
    within = F.when(F.col("_ra") == 0, (low <= lo) & (lo < high)).otherwise((lo < low) & (low < hi))
    met = met & within if on is None else met & within & on
    return one.join(two.hint("merge"), met).drop("_ra", "_ga", "_ca", "_rb", "_gb", "_cb")


class Var:
    """A bound object in a body: a.speed.last(0), .prev(0), .history(n, d), .now; a != b compares objects."""

    def __init__(self, name: str, objs: ObjectSet):
        self._name, self._objs = name, objs
        self._lasts: dict[str, None] = {}
        self._histories: dict[str, int] = {}

    def __getattr__(self, signal: str) -> _Signal:
        if signal.startswith("_") or signal not in self._objs.rows.columns:
            raise AttributeError(signal)
        return _Signal(self, signal)

    @property
    def uid(self) -> Column:
        return F.col(f"{self._name}__{self._objs.key}")

    def __eq__(self, other):
        return self.uid == other.uid

    def __ne__(self, other):
        return self.uid != other.uid

    __hash__ = None


@dataclass(frozen=True)
class _Signal:
    var: Var
    signal: str

    def _column(self, suffix: str, other) -> Column:
        value = F.col(f"{self.var._name}__{self.signal}{suffix}")
        return value if other is None else F.coalesce(value, F.lit(other))

    def last(self, other=None) -> Column:
        self.var._lasts[self.signal] = None
        return self._column("", other)

    def history(self, n: int, other=None) -> Column:
        n = abs(n)
        self.var._histories[self.signal] = max(n, self.var._histories.get(self.signal, 0))
        return self._column(f"_{n}", other)

    def prev(self, other=None) -> Column:
        return self.history(1, other)

    def now(self, other=None) -> Column:
        """The value in the cycle that updates it; null in others."""
        self.var._histories.setdefault(self.signal, 1)
        return self._column("_now", other)


@dataclass(frozen=True)
class Near:
    """|a.signal - b.signal| <= eps, for one signal or each of several (position: ("x", "y")), as a join on cells and the exact test.

    Cells are three eps wide; one side is put into its own cell, the other into each that it is near to: 1.7 by dimension on average, two at most.
    """

    a: str
    b: str
    signal: str | tuple[str, ...]
    eps: float

    @property
    def signals(self) -> tuple[str, ...]:
        return (self.signal,) if isinstance(self.signal, str) else tuple(self.signal)


@dataclass(frozen=True)
class Quantified:
    """Bindings of variables to collections and a body. end is the first cycle after the trace.

    given is a guard: exists asks for given and body, forall for body wherever given holds. What the guard says of
    equal signals is a join key for both.
    """

    bindings: dict[str, ObjectSet]
    body: Callable[..., Column]
    at: str = "cycle"
    end: int = 0
    near: Near | None = None
    kind: str = "exists"
    given: Callable[..., Column] | None = None
    _vars: dict[str, Var] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if not self._vars:
            self._vars.update({v: Var(v, o) for v, o in self.bindings.items()})

    def condition(self, negate: bool = False) -> Column:
        """Guard and body; or, negated, guard and not the body, where null is not."""
        out = self.body(*self._vars.values())
        if negate:
            out = ~F.coalesce(out, F.lit(False))
        if self.given is not None:
            out = self.given(*self._vars.values()) & out
        if self.near:
            a, b = (self._vars[v] for v in (self.near.a, self.near.b))
            for x in self.near.signals:
                out = (F.abs(getattr(a, x).last() - getattr(b, x).last()) <= self.near.eps) & out
        return out

    def _side(self, v: str, frame: DataFrame) -> DataFrame:
        return frame.select(*[F.col(c).alias(f"{v}__{c}") for c in frame.columns])

    def _cells(self, v: str, frame: DataFrame) -> DataFrame:
        if not self.near or v not in (self.near.a, self.near.b):
            return frame
        width = 3.0 * self.near.eps or 1.0
        for x in self.near.signals:
            at = F.col(f"{v}__{x}").cast("double")
            if v == self.near.b:
                more = F.abs(at) * 1e-12 + self.near.eps * (1 + 1e-6)  # more than the exact test's rounding
                frame = frame.withColumn(f"{v}__cell_{x}", F.explode(F.sequence(F.floor((at - more) / width), F.floor((at + more) / width))))
            else:
                frame = frame.withColumn(f"{v}__cell_{x}", F.floor(at / width))
        return frame

    def _same_cells(self, names: list[str], v: str) -> Column | None:
        """The join keys of near() when v comes to the variables of names."""
        if not self.near or v not in (self.near.a, self.near.b) or not {self.near.a, self.near.b} <= {*names, v}:
            return None
        return reduce(and_, [F.col(f"{self.near.a}__cell_{x}") == F.col(f"{self.near.b}__cell_{x}") for x in self.near.signals])

    def _crowded(self, sides: list[DataFrame], condition: Column) -> bool:
        """Whether the body gives a join no key, which the plan of a join on the body alone shows; if so, warn."""
        if len(sides) < 2 or self.near:
            return False
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            reduce(lambda x, y: x.join(y), sides).where(condition).explain()
        found = "CartesianProduct" in plan.getvalue() or "NestedLoopJoin" in plan.getvalue()
        if found:
            warnings.warn("the body has no equality or near(): all pairs of objects alive together are compared", stacklevel=4)
        return found

    def _versions(self, v: str, objs: ObjectSet, reads: list[Var]) -> DataFrame:
        """Versions of a collection for what any of reads does with its signals, under the names of variable v."""
        lasts = list(dict.fromkeys(s for x in reads for s in x._lasts))
        histories = {s: max(x._histories.get(s, 0) for x in reads) for x in reads for s in x._histories}
        rows = objs.versions(lasts, histories or None, self.at).withColumn("hi", F.coalesce("hi", F.lit(self.end)))
        return self._side(v, rows.where("lo < hi"))

    def _bindings(self, condition: Column, kept: list[Column] = ()) -> DataFrame:
        """(lo, hi, v__key ..., kept): where a binding satisfies the condition."""
        names, sets = list(self.bindings), list(self.bindings.values())
        keys = [F.col(f"{v}__{k}") for v, o in self.bindings.items() for k in o.keys]
        sides = [self._cells(v, self._versions(v, o, [self._vars[v]])) for v, o in self.bindings.items()]
        most = CROWDED if self._crowded(sides, condition) else None
        if len(sets) > 1 and all(o is sets[0] for o in sets) and sets[0].single:
            # all variables are the one object that there is
            rows = self._versions(names[0], sets[0], list(self._vars.values()))
            out = rows.select("*", *[F.col(c).alias(v + c.removeprefix(names[0])) for v in names[1:] for c in rows.columns]).where(condition)
            return out.select(F.col(f"{names[0]}__lo").alias("lo"), F.col(f"{names[0]}__hi").alias("hi"), *keys, *kept)
        out = sides[0].withColumns({"_lo": F.col(f"{names[0]}__lo"), "_hi": F.col(f"{names[0]}__hi")})
        for i, v in enumerate(names[1:], 1):
            parts = [c for c in (self._same_cells(names[:i], v), condition if i == len(names) - 1 else None) if c is not None]
            out = joined_overlaps(out, sides[i], ("_lo", "_hi"), (f"{v}__lo", f"{v}__hi"), self.end, reduce(and_, parts) if parts else None, most)
            out = out.withColumns({"_lo": F.greatest("_lo", f"{v}__lo"), "_hi": F.least("_hi", f"{v}__hi")})
        if len(names) == 1:
            out = out.where(condition)
        return out.select(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), *keys, *kept)

    def intervals(self, negate: bool = False) -> DataFrame:
        """(lo, hi, v__key ...): where a binding satisfies the body (or, negated, does not, but the guard).

        An object that has ended is bound in the cycle of its end, and then no more.
        """
        return self._bindings(self.condition(negate))

    def counts(self, cycles: DataFrame, negate: bool = False) -> DataFrame:
        """cycles and n: how many bindings satisfy the body at each of them."""
        return sweep(self.intervals(negate), cycles, self.at)

    def truth(self, cycles: DataFrame) -> DataFrame:
        """cycles and holds. Over no objects at all, forall holds and exists does not."""
        if self.kind == "forall":
            return self.counts(cycles, negate=True).withColumn("holds", F.col("n") == 0).drop("n")
        return self.counts(cycles).withColumn("holds", F.col("n") > 0).drop("n")

    def witnesses(self, cycles: DataFrame) -> DataFrame:
        """cycles with each binding that satisfies the body there."""
        return expand(self.intervals(), cycles, self.at, self.end)

    def at_ticks(self, states: dict[str, DataFrame], tick: str = "tick", negate: bool = False) -> DataFrame:
        """(tick, v__key ...): bindings that satisfy the body, from the objects' states at ticks; a tick is a join key by itself."""
        condition = self.condition(negate)
        out, names = None, list(self.bindings)
        for v in names:
            side = self._cells(v, self._side(v, states[v]))
            if out is None:
                out = side
                continue
            on = F.col(f"{names[0]}__{tick}") == F.col(f"{v}__{tick}")
            same = self._same_cells(names[: names.index(v)], v)
            on = on if same is None else on & same
            if v == names[-1]:
                on &= condition
            out = out.join(side, on)
        if len(names) == 1:
            out = out.where(condition)
        return out.select(F.col(f"{names[0]}__{tick}").alias(tick), *[F.col(f"{v}__{k}") for v, o in self.bindings.items() for k in o.keys])

    def states(self, ticks: dict[str, DataFrame], time: str, tick: str = "tick") -> dict[str, DataFrame]:
        """The states that at_ticks() needs; ticks is (keys, tick) by variable. Variables over one collection share what they can."""
        self.condition()
        return {v: state_at(o, ticks[v], time, list(self._vars[v]._lasts), self._vars[v]._histories or None, tick) for v, o in self.bindings.items()}


def exists(body: Callable[..., Column], bindings: dict[str, ObjectSet], **more) -> Quantified:
    return Quantified(bindings, body, kind="exists", **more)


def forall(body: Callable[..., Column], bindings: dict[str, ObjectSet], **more) -> Quantified:
    return Quantified(bindings, body, kind="forall", **more)


def any_of(body: Callable[[object], Column], items: list) -> Column:
    """exists over a list that is written out."""
    out = F.lit(False)
    for x in items:
        out = out | body(x)
    return out


def all_of(body: Callable[[object], Column], items: list) -> Column:
    out = F.lit(True)
    for x in items:
        out = out & body(x)
    return out


def together(rules: dict[str, Quantified], cycles: DataFrame) -> DataFrame:
    """cycles and one boolean column per rule: the truth of many rules over the same bindings, from one join and one sum.

    All rules bind the same variables to the same collections (the very objects), and have the same end. A binding is joined
    if any rule wants it (forall: its violations), and carries a flag for each rule; what all bodies have in common stays a join key.
    If all rules have a near() of the same signals, cells are those of the widest.
    """
    first, *others = rules.values()
    for q in others:
        if list(q.bindings) != list(first.bindings) or any(q.bindings[v] is not o for v, o in first.bindings.items()) or (q.end, q.at) != (first.end, first.at):
            raise ValueError("the rules bind different variables or collections")
    flags = {f"_w{i}": q.condition(negate=q.kind == "forall") for i, q in enumerate(rules.values())}
    for q in others:  # what any rule reads, the common versions have
        for v, x in q._vars.items():
            first._vars[v]._lasts.update(x._lasts)
            for s, n in x._histories.items():
                first._vars[v]._histories[s] = max(n, first._vars[v]._histories.get(s, 0))
    nears = [q.near for q in rules.values()]
    common = all(n and (n.a, n.b, n.signals) == (nears[0].a, nears[0].b, nears[0].signals) for n in nears)
    joint = replace(first, near=replace(nears[0], eps=max(n.eps for n in nears)) if common else None)
    found = joint._bindings(reduce(or_, flags.values()), [F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in flags.items()])
    counted = sweep(found, cycles, first.at, dict(zip(flags, rules, strict=True)))
    return counted.withColumns({name: F.col(name) == 0 if q.kind == "forall" else F.col(name) > 0 for name, q in rules.items()})


def sweep(intervals: DataFrame, cycles: DataFrame, at: str, weights: dict[str, str] | None = None) -> DataFrame:
    """cycles and n: how many of the intervals [lo, hi) each is in. Linear in intervals and cycles.

    weights: sums of such columns of the intervals instead, under the names given.
    """
    names = weights or {"_one": "n"}
    rows = intervals if weights else intervals.withColumn("_one", F.lit(1))
    edge = lambda p, sign: F.struct(F.col(p).alias(at), *[(F.col(w) * sign).alias(w) for w in names])
    edges = rows.select(F.explode(F.array(edge("lo", 1), edge("hi", -1))).alias("x"))
    edges = edges.groupBy(F.col(f"x.{at}").alias(at)).agg(*[F.sum(f"x.{w}").alias(w) for w in names]).withColumn("_kind", F.lit(0))
    points = cycles.withColumns({**{w: F.lit(0).cast("bigint") for w in names}, "_kind": F.lit(1)})
    both = points.unionByName(edges, allowMissingColumns=True)
    return ordering.running_totals(both, F.floor(F.col(at) / TOTALS), [at, "_kind"], names).where("_kind = 1").drop("_kind", *names)


def expand(intervals: DataFrame, cycles: DataFrame, at: str, end: int) -> DataFrame:
    """cycles joined with each interval that they are in; end is the first cycle after the trace."""
    n = grids(end, CROWDED)
    dealt = intervals.withColumn("_in", F.explode(interval_cells(F.col("lo"), F.col("hi"), n)))
    points = cycles.withColumn("_point", F.explode(point_cells(F.col(at), n)))
    met = (F.col("_point.grid") == F.col("_in.grid")) & (F.col("_point.cell") == F.col("_in.cell"))
    return points.join(dealt.hint("merge"), met & (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("_point", "_in", "lo", "hi")


def inner(outer: DataFrame, found: DataFrame, keys: list[str], some: bool) -> DataFrame:
    """(lo, hi, keys): where an outer binding holds and some (or no) interval of found does.

    outer is (lo, hi, keys); found is (lo, hi, keys, ...): satisfying bindings of the inner quantifier, or violating
    ones. exists-in-exists takes satisfying ones and some; forall-in-exists takes violating ones and not some.
    """
    both = outer.select("lo", "hi", *keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(found.select("lo", "hi", *keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    edge = F.explode(F.array(F.struct(F.col("lo").alias("p"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("p"), F.lit(-1).alias("d"))))
    sums = both.select(*keys, "_a", "_b", edge.alias("x")).groupBy(*keys, F.col("x.p").alias("lo")).agg(F.sum(F.col("_a") * F.col("x.d")).alias("_a"), F.sum(F.col("_b") * F.col("x.d")).alias("_b"))
    w = Window.partitionBy(*keys).orderBy("lo")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = sums.select(*keys, "lo", F.lead("lo").over(w).alias("hi"), F.sum("_a").over(upto).alias("_in"), F.sum("_b").over(upto).alias("_n"))
    return steps.where("_in > 0 and hi is not null").where("_n > 0" if some else "_n = 0").select("lo", "hi", *keys)


def world_rule(name: str, truth: DataFrame, level: str, message: Column | str, cycle: str, ts: str, when: Column | None = None, kind: str = "event") -> DataFrame:
    """Verdicts of a frame with the column holds, where when holds too."""
    fired = truth.where("holds") if when is None else truth.where(when).where("holds")
    return verdicts(fired, name, level, F.lit(message) if isinstance(message, str) else message, cycle, ts, None, kind)


def dedup_messages(found: DataFrame, how: str, per: list[str], message: str = "value", pair: list[str] | None = None) -> DataFrame:
    """One row for messages of a cycle that count as the same.

    "text": the same text. "digits": the same numbers in any order, or the same text where there are none.
    "pair": the same objects in any order. Of equal ones, the least text stays.
    """
    if how == "text":
        key = F.col(message)
    elif how == "digits":
        numbers = F.array_sort(F.transform(F.regexp_extract_all(message, F.lit(r"(\d+)")), lambda x: x.cast("decimal(38,0)")))
        key = F.when(F.col(message).rlike(r"\d"), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")).otherwise(F.concat(F.lit("t:"), message))
    elif how == "pair":
        key = F.array_join(F.array_sort(F.array(*[F.col(k).cast("bigint") for k in pair])), ",")
    else:
        raise ValueError(how)
    return found.groupBy(*per, key.alias("_same")).agg(F.min(message).alias(message)).drop("_same")


def episodes(truth: DataFrame, at: str, bucket: Column) -> DataFrame:
    """(lo, hi, cycles): runs of consecutive cycles at which a rule holds. truth is one row per cycle, cycles numbered without gaps."""
    held = truth.where("holds").select(at)
    ranked = ordering.global_rank(held, bucket, [at], "_rank")
    return ranked.groupBy((F.col(at) - F.col("_rank")).alias("_island")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("cycles")).drop("_island")


AGGREGATES = {
    "count": F.count, "min": F.min, "max": F.max, "sum": F.sum, "product": F.product, "avg": F.avg, "bool_and": F.bool_and, "bool_or": F.bool_or,
    "variance": F.var_pop, "stddev": F.stddev_pop, "median": F.median,
}


def agg_objects(states: DataFrame, signal: str, how: str | dict[str, str], tick: str = "tick", where: Column | None = None) -> DataFrame:
    """(tick, value): an aggregate over the objects alive at each tick, from their states; where keeps some of them (those fresh at the tick, say).

    how may be {name: aggregate}, for several at once. "percentile:p" and "covariance:other signal" are aggregates, too.
    """
    rows = states if where is None else states.where(where)
    wanted = {"value": how} if isinstance(how, str) else how
    return rows.groupBy(tick).agg(*[_aggregate(signal, x).alias(name) for name, x in wanted.items()])


#: Ticks of a block, as a power of two: longer blocks are cut into such before they become ticks, so no row makes more.
BLOCK_LEVEL = 12


def agg_at_ticks(objs: ObjectSet, signal: str, how: str | dict[str, str], time: str, step: int, end: int, zero: int = 0, tick: str = "tick") -> DataFrame:
    """(tick, value): agg_objects() of what objects hold at the ticks zero + step, zero + 2 step ... up to end of a shared clock, without their states.

    An object between two rows holds a value for a range of ticks, which is cut into aligned blocks of 1, 2, 4 ... ticks, at
    most two of each length. Blocks are added up over all objects first and become ticks only then, so rows are versions and ticks, each
    times a logarithm, and not objects times ticks. For aggregates that can be added up in parts: count, sum, min, max, avg, bool_and, bool_or.
    As with state_at(), an update at the time of a tick counts, of updates at one time the last one, and an object that has
    ended by then does not. Null values count for nothing; a tick at which no object is alive has no row; rows without a time are no updates.
    """
    wanted = {"value": how} if isinstance(how, str) else how
    if unknown := set(wanted.values()) - {"count", "sum", "min", "max", "avg", "bool_and", "bool_or"}:
        raise ValueError(f"{sorted(unknown)} cannot be added up in parts; take agg_objects()")
    last = (end - zero) // step
    order = [time, *(c for c in objs.order if c != time)]
    w = Window.partitionBy(*objs.keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    gone = F.lit(False) if objs.ends is None else F.max(objs.ends).over(so_far)
    updates = objs.rows.where(F.col(time).isNotNull())
    held = updates.select(F.last(signal, ignorenulls=True).over(so_far).alias("_value"), F.col(time).cast("bigint").alias("_lo"), F.lead(time).over(w).cast("bigint").alias("_hi"), gone.alias("_gone")).where("not _gone")

    def number(at: str) -> Column:  # of the first tick from this time on, in whole numbers
        return F.expr(f"(`{at}` - {zero} - pmod(`{at}` - {zero}, {step})) div {step} + if(pmod(`{at}` - {zero}, {step}) > 0, 1, 0)")

    after = F.least(F.coalesce(number("_hi"), F.lit(last + 1)), F.lit(last + 1))
    ranges = held.select("_value", F.greatest(number("_lo"), F.lit(1)).cast("bigint").alias("_a"), after.cast("bigint").alias("_b")).where("_a < _b")
    levels = max(last + 1, 1).bit_length()
    blocks = F.expr(f"""flatten(transform(sequence(0, {levels - 1}), l -> filter(array(
        struct(l AS level, shiftright(_a + shiftleft(1L, l) - 1, l) AS block, shiftright(_a + shiftleft(1L, l) - 1, l) % 2 = 1 AS odd),
        struct(l AS level, shiftright(_b, l) - 1 AS block, shiftright(_b, l) % 2 = 1 AS odd)),
        x -> x.odd AND shiftright(_a + shiftleft(1L, l) - 1, l) < shiftright(_b, l))))""")
    parts = ranges.select("_value", F.explode(blocks).alias("_x")).select("_value", "_x.level", "_x.block")
    sums = {"sum", "avg"} & set(wanted.values())
    own = {"_n": F.count("_value"), "_min": F.min("_value"), "_max": F.max("_value")} | ({"_sum": F.sum("_value")} if sums else {})
    more = {"_n": F.sum("_n"), "_min": F.min("_min"), "_max": F.max("_max")} | ({"_sum": F.sum("_sum")} if sums else {})
    added = parts.groupBy("level", "block").agg(*[x.alias(c) for c, x in own.items()])

    def cut(frame: DataFrame, level: Column) -> DataFrame:
        """Blocks as rows of their blocks of this level."""
        first, width = F.expr("shiftleft(block, level - _to)"), F.expr("shiftleft(1L, level - _to)")
        return frame.withColumn("_to", level).select("*", F.explode(F.sequence(first, first + width - 1)).alias("_block")).drop("level", "block").withColumnsRenamed({"_to": "level", "_block": "block"})

    short = cut(added, F.least(F.col("level"), F.lit(BLOCK_LEVEL))).groupBy("level", "block").agg(*[x.alias(c) for c, x in more.items()])
    ticks = cut(short, F.lit(0)).groupBy("block").agg(*[x.alias(c) for c, x in more.items()])
    of = {"count": "_n", "sum": "_sum", "min": "_min", "max": "_max", "bool_and": "_min", "bool_or": "_max"}
    found = [(F.col("_sum").cast("double") / F.when(F.col("_n") > 0, F.col("_n")) if x == "avg" else F.col(of[x])).alias(name) for name, x in wanted.items()]
    return ticks.select((F.col("block") * step + zero).alias(tick), *found)


def _aggregate(signal: str, how: str) -> Column:
    name, _, more = how.partition(":")
    if name == "percentile":
        return F.percentile(signal, float(more))
    return F.covar_pop(signal, more) if name == "covariance" else AGGREGATES[name](signal)
