"""How many pairs of objects of one collection are close to each other in one or two dimensions, without looking at pairs.

Objects are dealt to cells of the first number, and to lines of equal second ones. In a cell, versions begin and end in order, and each changes the count by how
many that are alive then lie within reach: of those sorted by the first number, a range, whose ends the exact test decides. All of a cell are counted together (earlier_below() of
inequality.py), over the whole trace; where a cell has too many versions, in blocks of cycles. So the work is versions times a logarithm. In two dimensions it is that for each two lines within
reach, which suits second numbers that many objects share (whole numbers, say).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objwatch.operators.inequality import earlier_below
from objwatch.operators.objects import ObjectSet
from objwatch.operators.quantify import TOTALS, Quantified, Var
from objwatch.plans import ordering

#: Versions of a cell that a task counts at once; more are cut into blocks of cycles.
CROWD = 250_000
#: How many times as wide as the reach a cell is.
WIDE = 8


def _range(x: np.ndarray, values: np.ndarray, reach: float, holds: Callable) -> tuple[np.ndarray, np.ndarray]:
    """For each x, the range of the sorted values for which holds(x, value), which are neighbours around it; reach is about how far it goes."""
    n, middle = len(values), np.searchsorted(values, x)
    lo, hi = np.minimum(np.searchsorted(values, x - reach), middle), np.maximum(np.searchsorted(values, x + reach, "right"), middle)
    at = lambda i: values[np.clip(i, 0, n - 1)]
    for change in (lambda: ((lo > 0) & holds(x, at(lo - 1)), -1, 0), lambda: ((lo < middle) & ~holds(x, at(lo)), 1, 0), lambda: ((hi < n) & holds(x, at(hi)), 0, 1), lambda: ((hi > middle) & ~holds(x, at(hi - 1)), 0, -1)):
        while n and (more := change())[0].any():
            lo, hi = lo + more[0] * more[1], hi + more[0] * more[2]
    return lo, hi


def close_changes(lo: np.ndarray, hi: np.ndarray, x: np.ndarray, guest: np.ndarray, same: bool, reach: float, holds: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(at, d): how the number of pairs changes of a host and a guest (same: or of two hosts), both in [lo, hi), that holds(x, x)."""
    n = len(lo)
    at, sign = np.concatenate([lo, hi]), np.repeat([1, -1], n)
    order = np.lexsort((sign, at))
    at, sign, x, guest = at[order], sign[order], np.tile(x, 2)[order], np.tile(guest, 2)[order]
    d = np.zeros(2 * n, np.int64)
    for put, ask in ((~guest, np.ones(2 * n, bool) if same else guest), (guest, ~guest)):
        values = np.unique(x[put])
        if not len(values) or not ask.any():
            continue
        asking, putting = np.flatnonzero(ask), np.flatnonzero(put)
        begin, end = _range(x[asking], values, reach, holds)
        rank = np.searchsorted(values, x[putting])
        # an update first asks for both ends of its range, and counts itself from then on
        places = np.concatenate([asking * 3, asking * 3 + 1, putting * 3 + 2])
        line = np.argsort(places)
        value, weight = np.concatenate([begin, end, rank])[line], np.concatenate([np.zeros(2 * len(asking), np.int64), sign[putting]])[line]
        found = np.empty(len(places), np.int64)
        found[line] = earlier_below(value, weight, places[line] % 3 < 2, True)
        k = len(asking)
        found = found[k : 2 * k] - found[:k]
        itself = (sign[asking] < 0) & put[asking] & (end > begin)  # what ends is there still
        d[asking] += (found - itself) * sign[asking]
    times, place = np.unique(at, return_inverse=True)
    return times, np.bincount(place, d, len(times)).astype(np.int64)


@dataclass(frozen=True)
class Close:
    """Pairs of distinct objects, each pair once, whose numbers in signals (one or two) are at most reach apart; strict: less than that.

    where is a condition that both objects of a pair meet. end is the first cycle after the trace.
    """

    objs: ObjectSet
    signals: tuple[str, ...]
    reach: float
    strict: bool = False
    where: Callable[[Var], Column] | None = None
    at: str = "cycle"
    end: int = 0

    def _rows(self) -> DataFrame:
        """(lo, hi, x, y)"""
        q = Quantified({"v": self.objs}, lambda _: F.lit(True), self.at, self.end)
        v = q._vars["v"]
        x, y = (getattr(v, self.signals[0]).last().cast("double"), getattr(v, self.signals[1]).last().cast("double") if len(self.signals) > 1 else F.lit(0.0))
        kept = F.lit(True) if self.where is None else self.where(v)
        rows = q._versions("v", self.objs, [v]).where(kept).select(F.col("v__lo").cast("bigint").alias("lo"), F.col("v__hi").cast("bigint").alias("hi"), x.alias("x"), (y + 0.0).alias("y"))
        return rows.where("abs(x) < double('Infinity') and abs(y) < double('Infinity')")  # null, nan and infinite ones are close to nothing

    def changes(self, crowd: int = CROWD) -> DataFrame:
        """(at, d): how the number of pairs changes."""
        rows, width = self._rows(), WIDE * self.reach or 1.0
        cell = lambda x: F.floor(x / width)
        more = F.abs("x") * 1e-12 + self.reach * (1 + 1e-6)  # more than the exact test's rounding
        met = F.sequence(cell(F.col("x") - more), cell(F.col("x") + more))
        if len(self.signals) == 1:
            lines = rows.withColumns({"y1": F.lit(0.0), "y2": F.lit(0.0)})
            host, guests = lines.withColumn("cell", cell(F.col("x"))), lines.withColumn("cell", F.explode(met)).where(F.col("cell") < cell(F.col("x")))
        else:
            ys = rows.select("y").distinct()
            near = ys.withColumn("_cell", cell(F.col("y")))
            reached = F.explode(F.sequence(cell(F.col("y") - self.reach * (1 + 1e-6) - F.abs("y") * 1e-12), cell(F.col("y"))))
            two = ys.select(F.col("y").alias("y2"), reached.alias("_cell")).join(near.withColumnRenamed("y", "y1"), "_cell").where("y1 <= y2")
            apart = F.sqrt((F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
            two = two.where(apart < self.reach if self.strict else apart <= self.reach).select("y1", "y2")
            host = rows.join(two, F.col("y") == F.col("y1")).withColumn("cell", cell(F.col("x")))
            # of one line, a pair is that of the cell of the smaller number
            guests = rows.join(two, F.col("y") == F.col("y2")).withColumn("cell", F.explode(met)).where((F.col("y1") < F.col("y2")) | (F.col("cell") < cell(F.col("x"))))
        keys = ["y1", "y2", "cell"]
        dealt = host.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).select(*keys, "lo", "hi", "x", "guest")
        most = dealt.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if (parts := -(-most // crowd)) > 1:
            block = max(1, -(-self.end // parts))
            div = lambda x: F.floor(x / block)
            dealt, keys = dealt.withColumn("block", F.explode(F.sequence(div(F.col("lo")), div(F.col("hi") - 1)))), [*keys, "block"]
            dealt = dealt.withColumns({"lo": F.greatest("lo", F.col("block") * block), "hi": F.least("hi", (F.col("block") + 1) * block)})
        reach, strict, flat = self.reach, self.strict, len(self.signals) == 1

        def count(group: pd.DataFrame) -> pd.DataFrame:
            y = float(group["y2"].iloc[0]) - float(group["y1"].iloc[0])

            def holds(a, b):
                apart = np.abs(a - b) if flat else np.sqrt((a - b) * (a - b) + y * y)
                return apart < reach if strict else apart <= reach

            times, d = close_changes(*(group[c].to_numpy() for c in ("lo", "hi", "x")), group["guest"].to_numpy(bool), y == 0, float(np.sqrt(max(0.0, reach * reach - y * y))), holds)
            return pd.DataFrame({"at": times[d != 0], "d": d[d != 0]})

        return dealt.groupBy(*keys).applyInPandas(count, "at bigint, d bigint")

    def counts(self, cycles: DataFrame, crowd: int = CROWD) -> DataFrame:
        """cycles and n: how many pairs are close in each."""
        return totals({"n": self.changes(crowd)}, cycles, self.at)


def changes_of(intervals: DataFrame) -> DataFrame:
    """(at, d) of intervals [lo, hi), each of which counts one."""
    edge = lambda p, d: F.struct(F.col(p).cast("bigint").alias("at"), F.lit(d).cast("bigint").alias("d"))
    return intervals.select(F.explode(F.array(edge("lo", 1), edge("hi", -1))).alias("x")).select("x.*")


def totals(changes: dict[str, DataFrame], cycles: DataFrame, at: str) -> DataFrame:
    """cycles and, for each name, the sum of its changes (at, d) up to there."""
    names = {f"_d{i}": name for i, name in enumerate(changes)}
    zero = F.lit(0).cast("bigint")
    both = cycles.withColumns({**dict.fromkeys(names, zero), "_kind": F.lit(1)})
    for c, frame in zip(names, changes.values(), strict=True):
        both = both.unionByName(frame.groupBy(F.col("at").alias(at)).agg(F.sum("d").alias(c)).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    return ordering.running_totals(both, F.floor(F.col(at) / TOTALS), [at, "_kind"], names).where("_kind = 1").drop("_kind", *names)
