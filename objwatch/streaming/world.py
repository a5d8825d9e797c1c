"""Quantified rules on streams, cycle by cycle, exact up to the watermark.

The objects' own state (lives.py) gives out rows once the watermark has passed them, in each batch all rows between its mark and the
one before. A row changes what its object is: what it was until then is in the row, as its last updates. So a row says by itself how many
bindings of one variable it adds and takes away. For two variables, open versions are kept in state by the join key of the body: a version that opens
or closes meets those open at the time, and no others. Where the key is the whole body, how many are open is all that is kept. How many bindings hold in a cycle is the running sum of these changes over the batch, on top of one number that
is carried from batch to batch. The work of a batch is in proportion to its rows and, for pairs with more of a body than the key, to the versions open under their keys.

Within the order (time, order) of a trace, a change has a phase: 0 is before a cycle is evaluated, 1 the evaluation, 2 after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from objwatch.plans import ordering

#: Keys among which evaluations of cycles are dealt on their way through the state of pairs.
LANES = 256
#: Microseconds of a range over which one task adds changes up.
RANGE_US = 60_000_000
#: The order of what is no row, behind all rows of its time.
BEHIND = (1 << 63) - 1


@dataclass(frozen=True)
class Piece:
    """What an object is in one phase of a row of life_stream(): "fresh" in its cycle, "after" it, "before" it; "end": before an end by silence."""

    which: str

    def _or(self, value: Column, other) -> Column:
        return value if other is None else F.coalesce(value, F.lit(other))

    def last(self, signal: str, other=None) -> Column:
        """The held value. Before a row, that is the update before it, so the stream keeps one at least."""
        return self._or(F.col(f"{signal}_1" if self.which == "before" else f"{signal}_last"), other)

    def history(self, signal: str, n: int, other=None) -> Column:
        n = abs(n)
        value = F.col(f"{signal}_{n}")
        if self.which == "after":  # the row's own update counts
            value = F.when(F.col(signal).isNotNull(), F.col(f"{signal}_last" if n == 1 else f"{signal}_{n - 1}")).otherwise(value)
        return self._or(value, other)

    def prev(self, signal: str, other=None) -> Column:
        return self.history(signal, 1, other)

    def now(self, signal: str, other=None) -> Column:
        """The value in the cycle that updates it; null in others."""
        return self._or(F.col(signal) if self.which == "fresh" else F.lit(None), other)


def _is_event() -> Column:
    return F.col("kind") == "event"


def _placed(rows: DataFrame, steps: list[Column]) -> DataFrame:
    """(us, order, step ...): the steps of each row that are not null."""
    wanted = F.filter(F.array(*steps), lambda x: x.isNotNull())
    return rows.where("kind <> 'tick'").select("us", F.coalesce("order", F.lit(BEHIND)).alias("order"), F.explode(wanted).alias("x")).select("us", "order", "x.*")


def one_changes(states: DataFrame, holds: Callable[[Piece], Column]) -> DataFrame:
    """(us, order, phase, d): how many more objects satisfy holds; a row of phase 1 for each cycle. Null does not hold."""
    n = {w: F.coalesce(holds(Piece(w)), F.lit(False)).cast("bigint") for w in ("before", "fresh", "after", "end")}
    zero = F.lit(0).cast("bigint")
    arrives = n["fresh"] - F.when(F.col("starts"), zero).otherwise(n["before"])
    leaves = F.when(_is_event(), F.when(F.col("ends"), zero).otherwise(n["after"]) - n["fresh"]).otherwise(-n["end"])
    step = lambda phase, d: F.struct(F.lit(phase).alias("phase"), d.alias("d"))
    return _placed(states, [F.when(_is_event() & (arrives != 0), step(0, arrives)), F.when(_is_event(), step(1, zero)), F.when(leaves != 0, step(2, leaves))])


def pair_changes(states: DataFrame, on: Callable[[Piece], Column], columns: dict[str, Callable[[Piece], Column]] | None = None, body: Callable | None = None, history: bool = False) -> DataFrame:
    """(us, order, phase, d): how many more pairs (a, b) of objects with the same `on` satisfy the body; a row of phase 1 for each cycle.

    columns are what the body reads of an object, as numbers (double) or text; body(a, b) gets one of a and b as values and the other as numpy arrays, under these
    names and uid, and gives an array of truth (a missing number is nan, which compares as false). A pair of an object with itself counts, so bodies say
    a.uid != b.uid where it must not. Without a body, pairs are two different objects, each pair once. history: on, or any column, reads history() or now(), so an object changes after its cycle, too. An object without a key `on` is in no pair.
    """
    columns = columns or {}
    kinds = {c: "string" if states.select(F.array(f(Piece("fresh")))).dtypes[0][1] == "array<string>" else "double" for c, f in columns.items()}

    def edge(which: str, phase: int, sign: int) -> Column:
        p = Piece(which)
        return F.struct(F.concat(F.lit("="), on(p).cast("string")).alias("key"), F.lit(phase).alias("phase"), F.lit(sign).alias("sign"), F.col("key").alias("uid"), *[f(p).cast(kinds[c]).alias(c) for c, f in columns.items()])

    lane = F.concat(F.lit("#"), F.pmod(F.xxhash64("us", "order"), F.lit(LANES)).cast("string"))
    mark = F.struct(lane.alias("key"), F.lit(1).alias("phase"), F.lit(0).alias("sign"), F.col("key").alias("uid"), *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    starts, ends = F.col("starts"), F.col("ends")
    steps = [F.when(_is_event() & ~starts, edge("before", 0, -1)), F.when(_is_event(), edge("fresh", 0, 1)), F.when(_is_event(), mark), F.when(F.col("kind") == "end", edge("end", 2, -1))]
    if history:
        steps += [F.when(_is_event(), edge("fresh", 2, -1)), F.when(_is_event() & ~ends, edge("after", 2, 1))]
    else:
        steps += [F.when(_is_event() & ends, edge("fresh", 2, -1))]
    edges = _placed(states, steps).where("key is not null")
    schema = StructType([StructField("us", LongType()), StructField("order", LongType()), StructField("phase", LongType()), StructField("d", LongType())])
    found = edges.groupBy("key").transformWithStateInPandas(statefulProcessor=PairProcessor(kinds, body) if body else AlikeProcessor(), outputStructType=schema, outputMode="Append", timeMode="None")
    return found.withColumn("phase", F.col("phase").cast("int"))


class AlikeProcessor(StatefulProcessor):
    """How many versions are open under one join key: each that opens or closes is in a pair with every other one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", StructType([StructField("n", LongType())]))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "order", "phase", "sign"], kind="stable")
        d = np.zeros(len(batch), np.int64)
        if not key[0].startswith("#"):
            sign = batch["sign"].to_numpy(np.int64)
            after = (self.open.get()[0] if self.open.exists() else 0) + np.cumsum(sign)
            d = np.where(sign > 0, after - 1, -after)
            self.open.update((int(after[-1]),))
        out = batch.assign(d=d)[["us", "order", "phase", "d"]].astype("int64")
        yield out[(d != 0) | key[0].startswith("#")]


class PairProcessor(StatefulProcessor):
    """The versions open under one join key. What arrives in a batch is all between two marks, so it is applied at once, in order; a version closes before another opens."""

    def __init__(self, kinds: dict[str, str], body: Callable):
        self.kinds, self.body = kinds, body

    def init(self, handle: StatefulProcessorHandle) -> None:
        types = {"double": DoubleType(), "string": StringType()}
        self.open = handle.getMapState("open", StructType([StructField("uid", LongType())]), StructType([StructField(f"c{i}", types[k]) for i, k in enumerate(self.kinds.values())] or [StructField("none", LongType())]))

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "order", "phase", "sign"], kind="stable")
        if key[0].startswith("#"):
            yield batch.assign(d=0)[["us", "order", "phase", "d"]].astype("int64")
            return
        held = {k[0]: tuple(v) for k, v in self.open.iterator()}
        # places are taken again, so there are as many as versions are open at a time, whatever the batch
        n = len(held) + max(0, int(batch["sign"].cumsum().max()))
        uid, alive, top, free = np.zeros(n, np.int64), np.zeros(n, bool), len(held), []
        columns = {c: np.full(n, np.nan) if k == "double" else np.full(n, None, object) for c, k in self.kinds.items()}
        at = {}
        for i, (u, values) in enumerate(held.items()):
            at[u], uid[i], alive[i] = i, u, True
            for c, x in zip(columns, values, strict=False):
                columns[c][i] = np.nan if x is None and self.kinds[c] == "double" else x

        def met(i: int) -> int:
            """Pairs of version i with itself and those alive."""
            one = SimpleNamespace(uid=uid[i], **{c: x[i] for c, x in columns.items()})
            others = SimpleNamespace(uid=uid[:top], **{c: x[:top] for c, x in columns.items()})
            alone = SimpleNamespace(uid=uid[i : i + 1], **{c: x[i : i + 1] for c, x in columns.items()})
            with np.errstate(invalid="ignore"):
                found = [np.broadcast_to(self.body(one, others), top)[alive[:top]], np.broadcast_to(self.body(others, one), top)[alive[:top]], np.broadcast_to(self.body(one, alone), 1)]
            return sum(int(x.sum()) for x in found)

        new = {c: batch[c].to_numpy() for c in ("sign", "uid", *self.kinds)}
        d, touched = np.zeros(len(batch), np.int64), set()
        for k in range(len(batch)):
            u = int(new["uid"][k])
            touched.add(u)
            if new["sign"][k] < 0:
                i = at.pop(u)
                alive[i] = False
                d[k] = -met(i)
                free.append(i)
            else:
                if free:
                    i = free.pop()
                else:
                    i, top = top, top + 1
                uid[i] = u
                for c in columns:
                    columns[c][i] = new[c][k]
                d[k] = met(i)
                at[u], alive[i] = i, True
        for u in touched:
            if u in at:
                values = tuple(columns[c][at[u]] for c in columns)
                self.open.updateValue((u,), tuple(None if x is None or x != x else float(x) if self.kinds[c] == "double" else x for c, x in zip(columns, values, strict=True)) or (0,))
            elif u in held:
                self.open.removeKey((u,))
        out = batch.assign(d=d)[["us", "order", "phase", "d"]].astype("int64")
        if (d != 0).any():
            yield out[d != 0]


def truth_batches(spark: SparkSession, path: str, sink: str, range_us: int = RANGE_US) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for changes: appends (cycle_id, us, n), how many bindings hold in each cycle.

    A batch's rows are under its number, so one that runs again replaces its own. Under path is one number for each batch, what holds after it.
    """

    def run(batch: DataFrame, number: int) -> None:
        carried = spark.read.parquet(f"{path}/carry-{number - 1}").first()[0] if number else 0
        batch.persist()
        try:
            sums = batch.groupBy("us", "order", "phase").agg(F.sum("d").alias("d"))
            total = ordering.running_totals(sums, F.floor(F.col("us") / range_us), ["us", "order", "phase"], {"d": "n"})
            total.where("phase = 1").select(F.col("order").alias("cycle_id"), "us", (F.col("n") + carried).alias("n")).write.mode("overwrite").parquet(f"{sink}/batch={number}")
            batch.agg((F.coalesce(F.sum("d"), F.lit(0)) + carried).alias("n")).write.mode("overwrite").parquet(f"{path}/carry-{number}")
        finally:
            batch.unpersist()

    return run
