"""Rules that compare a number of one object with a number of another, without looking at pairs.

How many pairs of objects satisfy left(a) > right(b) in each cycle: cycles are cut into blocks. In a block, versions that are alive at
its start or begin in it come as updates in order, and each update changes the count by how many of the other side, alive at that time, have a smaller (or larger) number.
That is a count of points in time and value, found for all updates of a block together by halving: for each power of two, the updates of every second stretch of that length
are counted against those of the stretch before it, sorted by value. So the work is versions times a logarithm, whatever the number of pairs.

A block's group is as large as the versions alive in it. Where that is too many, values are cut into ranges, too: pairs from different ranges
are products of how many are alive in each, and only pairs of one range are compared. A range of one value needs no comparison, so equal values are no
large group either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objwatch.operators.objects import ObjectSet
from objwatch.operators.quantify import TOTALS, Quantified, Var, joined_overlaps, sweep
from objwatch.plans import ordering

#: Cycles of a block; rows of a group beyond which values are cut into ranges, and at how many values at most.
BLOCK, CROWD, MOST_CUTS = 1 << 14, 1_000_000, 32
OPS = (">", ">=", "<", "<=")


def earlier_below(value: np.ndarray, weight: np.ndarray, asks: np.ndarray, strict: bool) -> np.ndarray:
    """For each position that asks, the sum of the weights at earlier positions that do not, of smaller values (or of equal ones too, if not strict)."""
    n, found = len(value), np.zeros(len(value), np.int64)
    first = asks if strict else ~asks  # of equal values
    order = np.lexsort((~first, value))
    weight = np.where(asks, 0, weight)
    for level in range(max(0, n - 1).bit_length()):
        paired = order[np.argsort(order >> (level + 1), kind="stable")]  # by stretches of 2 ** (level + 1), within them by value
        odd = (paired >> level & 1).astype(bool)
        upto = np.cumsum(np.where(odd, 0, weight[paired]))
        begins = np.flatnonzero(np.diff(paired >> (level + 1), prepend=-1))
        base = np.repeat(np.concatenate([[0], upto[begins[1:] - 1]]), np.diff(np.append(begins, n)))
        found[paired] += np.where(odd & asks[paired], upto - base, 0)
    return found


def count_changes(side: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """(at, d): how the number of pairs changes of which one of side 0 has a larger value than one of side 1, both in [lo, hi)."""
    n = len(lo)
    at = np.concatenate([lo, hi])
    sign = np.concatenate([np.ones(n, np.int64), -np.ones(n, np.int64)])
    order = np.lexsort((sign, at))
    at, sign, side, value = at[order], sign[order], np.concatenate([side, side])[order], np.concatenate([value, value])[order]
    # a left one asks for smaller right ones; a right one, by the negative values, for larger left ones
    d = np.where(side == 0, earlier_below(value, sign, side == 0, strict), earlier_below(-value, sign, side == 1, strict)) * sign
    times, place = np.unique(at, return_inverse=True)
    return times, np.bincount(place, d, len(times)).astype(np.int64)


def pair_counts(left: DataFrame, right: DataFrame, op: str, cycles: DataFrame, at: str = "cycle", block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """cycles and n: how many pairs of a row of left(lo, hi, x) and one of right(lo, hi, x), both alive in the cycle, have left.x op right.x. Null x is in no pair."""
    if op not in OPS:
        raise ValueError(f"comparisons are {OPS}")
    if op in ("<", "<="):
        left, right, op = right, left, op.replace("<", ">")
    strict = op == ">"
    both = left.select("lo", "hi", F.col("x").cast("double"), F.lit(0).alias("side")).unionByName(right.select("lo", "hi", F.col("x").cast("double"), F.lit(1).alias("side"))).where("x is not null and not isnan(x) and lo < hi")
    div = lambda x: F.floor(x / block)
    dealt = both.withColumn("block", F.explode(F.sequence(div(F.col("lo")), div(F.col("hi") - 1))))
    dealt = dealt.withColumns({"lo": F.greatest("lo", F.col("block") * block), "hi": F.least("hi", (F.col("block") + 1) * block)})
    largest = dealt.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    cuts = sorted(set(both.approxQuantile("x", [k / (n + 1) for k in range(1, n + 1)], 0.01))) if (n := min(MOST_CUTS, largest // crowd)) else []
    # ranges of values: 0, 2, 4 ... between the cuts, 1, 3, 5 ... the cuts themselves
    area = lambda: reduce(add, [F.when(F.col("x") > c, 2).when(F.col("x") == c, 1).otherwise(0) for c in cuts], F.lit(0))

    def changes(rows: pd.DataFrame) -> pd.DataFrame:
        times, d = count_changes(*(rows[c].to_numpy() for c in ("side", "lo", "hi", "x")), strict)
        return pd.DataFrame({"at": times, "d": d})

    fine = dealt.withColumn("area", area()).where("area % 2 = 0").groupBy("block", "area").applyInPandas(changes, "at bigint, d bigint").where("d <> 0")
    sums, names = fine.select(F.col("at").alias(at), F.col("d").alias("_d")), {"_d": "_n"}
    if cuts:
        edge = F.explode(F.array(F.struct(F.col("lo").alias(at), F.lit(1).alias("s")), F.struct(F.col("hi").alias(at), F.lit(-1).alias("s")))).alias("x")
        moves = both.select(area().alias("area"), "side", edge)
        alive = {f"_{s}{r}": F.when((F.col("side") == i) & (F.col("area") == r), F.col("x.s")).otherwise(0).cast("bigint") for i, s in enumerate("lr") for r in range(2 * len(cuts) + 1)}
        coarse = moves.select(F.col(f"x.{at}").alias(at), *[c.alias(name) for name, c in alive.items()]).groupBy(at).agg(*[F.sum(name).alias(name) for name in alive])
        sums, names = sums.unionByName(coarse, allowMissingColumns=True), names | {name: f"{name}n" for name in alive}
    sums = sums.groupBy(at).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).withColumn("_kind", F.lit(0))
    points = cycles.withColumns({**{c: F.lit(0).cast("bigint") for c in names}, "_kind": F.lit(1)})
    total = ordering.running_totals(points.unionByName(sums, allowMissingColumns=True), F.floor(F.col(at) / TOTALS), [at, "_kind"], names).where("_kind = 1")
    n = F.col("_n")
    for r in range(2 * len(cuts) + 1) if cuts else ():
        below = [F.col(f"_r{j}n") for j in range(r)] + ([F.col(f"_r{r}n")] if r % 2 and not strict else [])
        n = n + F.col(f"_l{r}n") * reduce(add, below, F.lit(0))
    return total.withColumn("n", n).drop("_kind", *names, *names.values())


def two_largest(versions: DataFrame, cycles: DataFrame, at: str = "cycle", block: int = BLOCK) -> DataFrame:
    """cycles, top and second: the largest and the second largest x, ties counted, of the rows of versions(lo, hi, x) alive in each cycle; null where there is none.

    Of the versions that are alive in a whole block, only two can be among them. All others begin or end in the block, and so are no more than twice its cycles if
    a cycle updates one object.
    """
    both = versions.select("lo", "hi", F.col("x").cast("double")).where("x is not null and not isnan(x) and lo < hi")
    div = lambda x: F.floor(x / block)
    dealt = both.withColumn("block", F.explode(F.sequence(div(F.col("lo")), div(F.col("hi") - 1))))
    dealt = dealt.withColumns({"lo": F.greatest("lo", F.col("block") * block), "hi": F.least("hi", (F.col("block") + 1) * block)})
    whole = F.col("hi") - F.col("lo") == block
    kept = dealt.where(whole).withColumn("_k", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("x")))).where("_k <= 2").drop("_k")
    rows = kept.unionByName(dealt.where(~whole)).select("block", "lo", "hi", "x", F.lit(None).cast("bigint").alias("c"))
    asked = cycles.select(F.col(at).cast("bigint").alias("c")).distinct().select(div(F.col("c")).alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in (("lo", "bigint"), ("hi", "bigint"), ("x", "double"))], "c")

    def paint(group: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(group["c"].dropna().to_numpy(np.int64))
        own = group[group["c"].isna()].sort_values("x", ascending=False)
        begins, ends = (np.searchsorted(points, own[c].to_numpy(np.int64)).tolist() for c in ("lo", "hi"))
        found = np.full((2, len(points)), np.nan)
        nexts = [list(range(len(points) + 1)) for _ in range(2)]  # the first point from each on that has no value yet

        def free(k: int, i: int) -> int:
            chain = nexts[k]
            while chain[i] != i:
                chain[i] = chain[chain[i]]
                i = chain[i]
            return i

        for begin, end, x in zip(begins, ends, own["x"].tolist(), strict=True):
            first = free(0, begin)
            second = free(1, begin)
            # points that have their first value already, and no second one
            while second < end:
                if nexts[0][second] != second:
                    found[1, second], nexts[1][second] = x, second + 1
                second = free(1, second + 1)
            while first < end:
                found[0, first], nexts[0][first] = x, first + 1
                first = free(0, first)
        return pd.DataFrame({"c": points, "top": found[0], "second": found[1]})

    tops = asked.unionByName(rows).groupBy("block").applyInPandas(paint, "c bigint, top double, second double")
    clean = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c)
    return cycles.join(tops.select("c", clean("top"), clean("second")), F.col(at) == F.col("c")).drop("c")


@dataclass(frozen=True)
class Compare:
    """Pairs of objects with left(a) op right(b); where has conditions on each by itself.

    distinct: a pair of an object with itself does not count. slack: where left and right are so close, the body decides, for rules that are the same comparison only up
    to rounding (a.x + b.x > c as a.x > c - b.x); such pairs are found by a join on cells. end is the first cycle after the trace.
    """

    bindings: dict[str, ObjectSet]
    left: Callable[[Var], Column]
    op: str
    right: Callable[[Var], Column]
    where: dict[str, Callable[[Var], Column]] = field(default_factory=dict)
    distinct: bool = False
    slack: float = 0.0
    body: Callable[[Var, Var], Column] | None = None
    at: str = "cycle"
    end: int = 0

    def _sides(self) -> tuple[Quantified, list[DataFrame]]:
        """The versions of both variables, with their numbers as v__x."""
        q = Quantified(self.bindings, lambda *_: F.lit(True), self.at, self.end)
        a, b = (q._vars[v] for v in self.bindings)
        wanted = {a._name: self.left(a), b._name: self.right(b)}
        kept = {v: self.where[v](q._vars[v]) for v in self.where}
        if self.slack:
            self.body(a, b)
        sides = []
        for v, o in self.bindings.items():
            rows = q._versions(v, o, [q._vars[v]]).withColumn(f"{v}__x", wanted[v])
            sides.append(rows.where(kept[v]) if v in kept else rows)
        return q, sides

    def counts(self, cycles: DataFrame) -> DataFrame:
        """cycles and n: how many pairs satisfy the rule in each."""
        if self.op not in OPS:
            raise ValueError(f"comparisons are {OPS}")
        if self.slack and self.body is None:
            raise ValueError("within the slack, a body has to decide")
        q, (one, two) = self._sides()
        a, b = self.bindings
        plain = lambda rows, v, x: rows.select(F.col(f"{v}__lo").alias("lo"), F.col(f"{v}__hi").alias("hi"), x.alias("x"))
        margin = self.slack if self.op in (">", ">=") else -self.slack
        op = self.op if not self.slack else self.op[0]
        right = F.col(f"{b}__x") + margin if self.slack else F.col(f"{b}__x")
        n = pair_counts(plain(one, a, F.col(f"{a}__x")), plain(two, b, right), op, cycles, self.at)
        parts = {"n": 1}
        if self.distinct:
            n = sweep(self._alone(q, op, margin), n.withColumnRenamed("n", "_pairs"), self.at).withColumnRenamed("n", "_alone")
            parts = {"_pairs": 1, "_alone": -1}
        if self.slack:
            names = {c: f"_of{c}" for c in parts}
            n = sweep(self._close(q, one, two), n.withColumnsRenamed(names), self.at).withColumnRenamed("n", "_near")
            parts = {names[c]: s for c, s in parts.items()} | {"_near": 1}
        total = reduce(add, [F.col(c) * s for c, s in parts.items()])
        return n.withColumn("n", total).drop(*[c for c in parts if c != "n"])

    def truth(self, cycles: DataFrame) -> DataFrame:
        """cycles and holds: is there such a pair."""
        return self.counts(cycles).withColumn("holds", F.col("n") > 0).drop("n")

    def _alone(self, q: Quantified, op: str, margin: float) -> DataFrame:
        """Versions that satisfy the comparison, and both conditions, with themselves."""
        a, b = self.bindings
        if self.bindings[a] is not self.bindings[b]:
            raise ValueError("objects of two collections are distinct anyway")
        rows = q._versions(a, self.bindings[a], list(q._vars.values()))
        rows = rows.select("*", *[F.col(c).alias(b + c.removeprefix(a)) for c in rows.columns])
        x, y = self.left(q._vars[a]), self.right(q._vars[b]) + F.lit(margin)
        holds = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
        conditions = [holds, *[w(q._vars[v]) for v, w in self.where.items()]]
        return rows.where(reduce(and_, conditions)).select(F.col(f"{a}__lo").alias("lo"), F.col(f"{a}__hi").alias("hi"))

    def _close(self, q: Quantified, one: DataFrame, two: DataFrame) -> DataFrame:
        """Pairs within the slack that satisfy the body."""
        a, b = self.bindings
        x, y, width = F.col(f"{a}__x").cast("double"), F.col(f"{b}__x").cast("double"), 3.0 * self.slack
        more = F.abs(y) * 1e-12 + self.slack * (1 + 1e-6)
        one = one.withColumn(f"{a}__cell", F.floor(x / width))
        two = two.withColumn(f"{b}__cell", F.explode(F.sequence(F.floor((y - more) / width), F.floor((y + more) / width))))
        # what the sum above counts is x > y + slack, or x < y - slack, so exactly the rest is looked at here
        beyond = x > y + self.slack if self.op in (">", ">=") else x < y - self.slack
        within = ~beyond & (F.abs(x - y) <= more) & self.body(q._vars[a], q._vars[b])
        if self.distinct:
            within &= q._vars[a] != q._vars[b]
        met = joined_overlaps(one, two, (f"{a}__lo", f"{a}__hi"), (f"{b}__lo", f"{b}__hi"), self.end, (F.col(f"{a}__cell") == F.col(f"{b}__cell")) & within)
        return met.select(F.greatest(f"{a}__lo", f"{b}__lo").alias("lo"), F.least(f"{a}__hi", f"{b}__hi").alias("hi"))
