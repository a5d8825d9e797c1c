"""Objects on streams: several typed signals, derived signals, clocks and ends, in keyed state.

Rows of an object are applied in the order of (time, order): they wait in state until the watermark has passed them, so that a
late neighbour still finds its place. They wait as sorted chunks of Arrow columns, and are applied a frame of columns at a time: what a
signal held, or was n updates ago, is a position in the array of its updates, which a count of updates so far gives for all rows of a
frame at once. A frame has rows of many objects, those of a lane; between batches, the state keeps the last updates of each signal of an object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: Waiting rows are sorted by so many and kept in chunks; rows are applied and given out in frames of about FRAME.
RUN, CHUNK, FRAME = 1 << 16, 4096, 10_000
#: Objects are dealt to so many lanes by their keys; the state of a lane is kept together.
LANES = 256
#: Partitions of a stream, four lanes each: every one starts Python, and opens and commits a store, in every batch, however few rows it has.
STORES = LANES // 4
#: Spark's name of a signal's type, and what it is in state, in Arrow and in frames.
KINDS = {
    "double": (DoubleType(), pa.float64(), "Float64"),
    "bigint": (LongType(), pa.int64(), "Int64"),
    "boolean": (BooleanType(), pa.bool_(), "boolean"),
    "string": (StringType(), pa.string(), "string"),
}


class Frame:
    """Rows of a lane's objects as columns, the rows of a life together and in order. Functions of derived signals read these; null is pd.NA.

    life numbers the lives by row; slot has the place of each life's earlier updates in past, -1 for a new one.
    """

    def __init__(self, us: np.ndarray, life: np.ndarray, slot: np.ndarray, past: dict):
        self.us, self._life, self._slot, self._past = us, life, slot, past
        self._first = np.searchsorted(life, np.arange(len(slot)))
        self._now: dict = {}
        self._fresh: dict[str, np.ndarray] = {}
        self._base: dict[str, np.ndarray] = {}
        self._count: dict[str, np.ndarray] = {}
        self._values: dict = {}

    def add(self, name: str, column) -> None:
        fresh = ~np.asarray(column.isna(), bool)
        upto = np.concatenate([[0], np.cumsum(fresh)])
        base = upto[self._first]
        self._now[name], self._fresh[name], self._base[name], self._count[name] = column, fresh, base, upto[1:] - base[self._life]
        self._values[name] = type(column)._concat_same_type([column[fresh], *self._past.get(name, [])])

    def _nth(self, name: str, life: np.ndarray, j: np.ndarray):
        """Update number j of a life in this frame; -1, -2 ... are those before it."""
        past, slot, back = self._past.get(name, []), self._slot[life], -1 - j
        size = len(past[0]) if past else 0
        held = np.where((slot >= 0) & (back < len(past)), len(self._values[name]) - len(past) * size + back * size + slot, -1)
        return pd.api.extensions.take(self._values[name], np.where(j >= 0, self._base[name][life] + j, held), allow_fill=True)

    def now(self, name: str):
        """The value that the row itself gives, or null."""
        return self._now[name]

    def fresh(self, name: str) -> np.ndarray:
        return self._fresh[name]

    def last(self, name: str):
        """The last update up to and including the row."""
        return self._nth(name, self._life, self._count[name] - 1)

    def history(self, name: str, n: int):
        """The n-th last update before the row; its own value for n = 0."""
        n = abs(n)
        return self.now(name) if n == 0 else self._nth(name, self._life, self._count[name] - self._fresh[name] - n)

    def prev(self, name: str):
        return self.history(name, 1)

    def upto(self, life: np.ndarray, us: np.ndarray) -> np.ndarray:
        """The last row of each life of that time or before; -1 if it is not in this frame."""
        n = len(self.us)
        order = np.lexsort((np.arange(n + len(us)) >= n, np.concatenate([self.us, us]), np.concatenate([self._life, life])))
        seen = np.empty(len(order), np.int64)
        seen[order] = np.cumsum(order < n) - 1
        return np.where(seen[n:] >= self._first[life], seen[n:], -1)

    def after(self, name: str, life: np.ndarray, rows: np.ndarray, n: int):
        """The n-th last update of each life once a row of its (-1: none yet) is applied."""
        return self._nth(name, life, np.concatenate([[0], self._count[name]])[rows + 1] - n)


@dataclass(frozen=True)
class Let:
    """A derived signal: an update in rows where when holds and value is not null. Both are functions of a Frame, and may read signals and lets before it."""

    name: str
    kind: str
    value: Callable[[Frame], object]
    when: Callable[[Frame], object] | None = None


@dataclass(frozen=True)
class Clock:
    """Ticks every step_us: from each object's start on, or, with zero_us, at the times zero_us + step_us, zero_us + 2 step_us ... of a shared clock."""

    name: str
    step_us: int
    zero_us: int | None = None

    def first(self, born: np.ndarray) -> np.ndarray:
        if self.zero_us is None:
            return born + self.step_us
        return self.zero_us + self.step_us * np.maximum(1, -((self.zero_us - born) // self.step_us))


@dataclass(frozen=True)
class Objects:
    """What is kept of the objects of a stream.

    signals: types by name (double, bigint, boolean, string). depth: how many updates before a row are kept, of all signals and lets or by name.
    ends: a condition on a row's own values, a function of a Frame; the row after one that meets it is a new object's.
    silence_us: an object ends when no row has come for longer than that.
    """

    signals: dict[str, str]
    lets: tuple[Let, ...] = ()
    depth: int | dict[str, int] = 1
    clocks: tuple[Clock, ...] = ()
    ends: Callable[[Frame], object] | None = None
    silence_us: int | None = None

    @property
    def names(self) -> dict[str, str]:
        return {**self.signals, **{x.name: x.kind for x in self.lets}}

    def back(self, name: str) -> int:
        return self.depth if isinstance(self.depth, int) else self.depth.get(name, 1)

    def schema(self) -> StructType:
        """Of the rows given out: kind is event, tick or end (of silence); born tells the lives of an object apart."""
        fixed = [("key", LongType()), ("us", LongType()), ("order", LongType()), ("kind", StringType()), ("clock", StringType()), ("born", LongType()), ("starts", BooleanType()), ("ends", BooleanType())]
        own = [(c, KINDS[kind][0]) for s, kind in self.names.items() for c in (s, f"{s}_last", *[f"{s}_{k}" for k in range(1, self.back(s) + 1)])]
        return StructType([StructField(*x) for x in fixed + own])


class _Lives:
    """Objects that are looked at, by slot. past has the last updates of each signal, the latest first; null: there are fewer."""

    def __init__(self, spec: Objects):
        self.spec, self.slot = spec, {}
        self.alive, self.born, self.seen = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.due = np.zeros((0, len(spec.clocks)), np.int64)
        self.past = {s: [pd.array([], KINDS[k][2]) for _ in range(spec.back(s) + 1)] for s, k in spec.names.items()}

    def slots(self, keys: list[int], load: Callable[[int], tuple | None]) -> np.ndarray:
        if new := [k for k in dict.fromkeys(keys) if k not in self.slot]:
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
            found = [load(k) for k in new]
            nothing = (0, 0, [0] * len(self.spec.clocks), *[[]] * len(self.past))
            born, seen, due, *past = zip(*[nothing if x is None else x for x in found], strict=True)
            self.alive = np.append(self.alive, [x is not None for x in found])
            self.born, self.seen = np.append(self.born, np.array(born, np.int64)), np.append(self.seen, np.array(seen, np.int64))
            self.due = np.concatenate([self.due, np.array(due, np.int64).reshape(len(new), len(self.spec.clocks))])
            for held, updates in zip(self.past.values(), past, strict=True):
                for i, column in enumerate(held):
                    more = pd.array([x[i] if len(x) > i else pd.NA for x in updates], column.dtype)
                    held[i] = type(column)._concat_same_type([column, more])
        return np.array([self.slot[k] for k in keys], np.int64)


class LifeProcessor(StatefulProcessor):
    """State of a lane of objects: their waiting rows; of each object the last updates of its signals and when its clocks are due.

    All objects of a lane are applied together, so what Python costs goes by frames and not by objects; an object is read from the state and written once in a
    batch that has rows or ticks of it. One timer is set, for the earliest of what the lane waits for. lanes: rows have a column key; without, a lane is one object, which it is named after.
    """

    def __init__(self, spec: Objects, lanes: bool = False):
        self.spec, self.lanes = spec, lanes
        self.arrow = pa.schema([*([("key", pa.int64())] if lanes else []), ("us", pa.int64()), ("order", pa.int64()), *[(s, KINDS[k][1]) for s, k in spec.signals.items()]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long = lambda name: StructField(name, LongType())
        self.waiting = handle.getMapState("waiting", StructType([long("us"), long("number")]), StructType([StructField("rows", BinaryType())]))
        self.chunks = handle.getValueState("chunks", StructType([long("n")]))
        self.held = handle.getMapState("held", StructType([long("key")]), StructType([long("born"), long("seen"), StructField("due", ArrayType(LongType())), *[StructField(f"s{i}", ArrayType(KINDS[k][0])) for i, k in enumerate(self.spec.names.values())]]))
        self.due = handle.getMapState("due", StructType([long("key")]), StructType([long("us")]))  # the earliest of its clocks and its silence
        self.timer = handle.getValueState("timer", StructType([long("ms")]))

    def close(self) -> None:
        pass

    # rows that wait

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, kept = [], []
        for batch in rows:
            if len(batch):
                columns = pa.Table.from_pandas(batch[self.arrow.names], preserve_index=False)
                kept.append(pa.table([columns[f.name].cast(f.type) for f in self.arrow], schema=self.arrow))
                if sum(map(len, kept)) >= RUN:
                    first.append(self._wait(pa.concat_tables(kept)))
                    kept = []
        if kept:
            first.append(self._wait(pa.concat_tables(kept)))
        if first:
            self._wake(min(first))
        return iter(())

    def _wait(self, rows: pa.Table) -> int:
        """Keep rows as a run: chunks by time, each under its first time and a number of its own. Returns the first time."""
        run = rows.sort_by([("us", "ascending"), ("order", "ascending")]).combine_chunks()
        n = self.chunks.get()[0] if self.chunks.exists() else 0
        for i in range(0, len(run), CHUNK):
            part = run.slice(i, CHUNK).combine_chunks().to_batches()[0]
            self.waiting.updateValue((part["us"][0].as_py(), n), (part.serialize().to_pybytes(),))
            n += 1
        self.chunks.update((n,))
        return run["us"][0].as_py()

    def _ready(self, mark: int, later: list[int]) -> Iterator[pa.Table]:
        """Rows before mark in order, as tables, taken out of the state; later gets the first time that waits on.

        Chunks are opened in order of their first times: rows before the next one's have their place. They are sorted once as many are new
        as are open, so that many chunks of one time cost a logarithm.
        """
        held, new = self.arrow.empty_table(), []
        merged = lambda: pa.concat_tables([held, *new]).sort_by([("us", "ascending"), ("order", "ascending")]).combine_chunks()
        for us, number in sorted(self.waiting.keys()):
            if us >= mark:
                later.append(us)
                break
            if sum(map(len, new)) >= max(CHUNK, len(held)):
                held, new = merged(), []
                at = int(np.searchsorted(held["us"].to_numpy(), us))
                if at:
                    yield held.slice(0, at)
                held = held.slice(at)
            new.append(pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(self.waiting.getValue((us, number))[0]), self.arrow)]))
            self.waiting.removeKey((us, number))
        held = merged()
        at = int(np.searchsorted(held["us"].to_numpy(), mark))
        if at:
            yield held.slice(0, at)
        if at < len(held):
            later.append(self._wait(held.slice(at)))
        elif not later:
            self.chunks.clear()

    def _frames(self, mark: int, later: list[int]) -> Iterator[pa.Table]:
        kept: list[pa.Table] = []
        for part in self._ready(mark, later):
            for i in range(0, len(part), FRAME):
                kept.append(part.slice(i, FRAME))
                if sum(map(len, kept)) >= FRAME:
                    yield pa.concat_tables(kept).combine_chunks()
                    kept = []
        if kept:
            yield pa.concat_tables(kept).combine_chunks()

    def _wake(self, us: int) -> None:
        ms = us // 1000 + 1
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    # what rows and ticks make of the objects

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        later, out = [], []
        self.timer.clear()
        for made in self._made(key[0], timerValues.getCurrentWatermarkInMs() * 1000, later):
            out.append(made)
            if sum(map(len, out)) >= FRAME:
                yield pd.concat(out)
                out = []
        if later:
            self._wake(min(later))
        if out:
            yield pd.concat(out)

    def _made(self, lane: int, mark: int, later: list[int]) -> Iterator[pd.DataFrame]:
        """All rows given out up to mark; later gets the times for which the lane waits."""
        lives, old = _Lives(self.spec), self.held.exists()
        load = lambda k: self.held.getValue((k,)) if old else None
        for rows in self._frames(mark, later):
            yield from self._apply(lane, lives, rows, load)
        if self.spec.clocks or self.spec.silence_us is not None:
            if old:
                due = {k[0]: x[0] for k, x in self.due.iterator() if k[0] not in lives.slot}
                lives.slots([k for k, us in due.items() if us < mark], load)
                later += [us for us in due.values() if us >= mark]
            alive = np.flatnonzero(lives.alive)
            over = mark - lives.seen[alive] > self.spec.silence_us if self.spec.silence_us is not None else np.zeros(len(alive), bool)
            keys = np.array(list(lives.slot), np.int64)
            yield from self._fall_silent(lives, keys[alive[over]], alive[over])
            yield from self._pass(lives, keys[alive[~over]], alive[~over], np.full(int((~over).sum()), mark))
        self._save(lives, old, later)

    def _save(self, lives: _Lives, old: bool, later: list[int]) -> None:
        quiet, timed = self.spec.silence_us, bool(self.spec.clocks) or self.spec.silence_us is not None
        past = [list(zip(*[column.tolist() for column in held], strict=True)) for held in lives.past.values()]
        for key, i in lives.slot.items():
            if lives.alive[i]:
                due = lives.due[i].tolist()
                self.held.updateValue((key,), (int(lives.born[i]), int(lives.seen[i]), due, *[[x for x in updates[i] if x is not pd.NA] for updates in past]))
                if timed:
                    later.append(min([*due, *([] if quiet is None else [int(lives.seen[i]) + quiet])]))
                    self.due.updateValue((key,), (later[-1],))
            elif old and self.held.getValue((key,)) is not None:
                self.held.removeKey((key,))
                if timed:
                    self.due.removeKey((key,))

    def _apply(self, lane: int, lives: _Lives, rows: pa.Table, load: Callable[[int], tuple | None]) -> Iterator[pd.DataFrame]:
        """Rows given out for rows in order, and the ticks of their objects up to the last of them; lives is brought up to date."""
        quiet, n = self.spec.silence_us, len(rows)
        if self.lanes:
            rows = rows.take(np.argsort(rows["key"].to_numpy(), kind="stable"))
        key, us, order = rows["key"].to_numpy() if self.lanes else np.full(n, lane), rows["us"].to_numpy(), rows["order"].to_numpy()
        columns = {s: pd.array(rows[s].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.float64(): pd.Float64Dtype(), pa.bool_(): pd.BooleanDtype(), pa.string(): pd.StringDtype()}.get), KINDS[k][2]) for s, k in self.spec.signals.items()}
        ends = np.zeros(n, bool)
        if self.spec.ends is not None:
            alone = Frame(us, np.arange(n), np.full(n, -1), {})
            for s, c in columns.items():
                alone.add(s, c)
            ends = _true(self.spec.ends(alone))
        # a life begins with an object's first row, after a row that ends one, and after a silence
        opens = np.append(True, key[1:] != key[:-1])
        cuts = opens.copy()
        cuts[1:] |= ends[:-1]
        if quiet is not None:
            cuts[1:] |= np.diff(us) > quiet
        first = np.flatnonzero(cuts)
        last, keys, opens = np.append(first[1:], n) - 1, key[first], opens[first]
        slot = lives.slots(keys.tolist(), load)
        if quiet is not None:
            gone = opens & lives.alive[slot] & (us[first] - lives.seen[slot] > quiet)
            yield from self._fall_silent(lives, keys[gone], slot[gone])
        goes_on = opens & lives.alive[slot]
        born = np.where(goes_on, lives.born[slot], us[first])
        life = np.cumsum(cuts) - 1
        frame = Frame(us, life, np.where(goes_on, slot, -1), lives.past)
        for s, c in columns.items():
            frame.add(s, c)
        for let in self.spec.lets:
            value = pd.array(let.value(frame), KINDS[let.kind][2])
            if let.when is not None:
                value[~_true(let.when(frame))] = pd.NA
            frame.add(let.name, value)
        own = {c: x for s in self.spec.names for c, x in [(s, frame.now(s)), (f"{s}_last", frame.last(s)), *[(f"{s}_{k}", frame.history(s, k)) for k in range(1, self.spec.back(s) + 1)]]}
        yield self._rows(key, us, "event", own, order, None, born[life], cuts & ~goes_on[life], ends)
        # ticks up to the last row see the rows before them; at the same time, rows come first
        goes, seen = np.append(keys[1:] == keys[:-1], False), us[last]
        silent = goes & ~ends[last]
        due = np.stack([np.where(goes_on, lives.due[slot, i], c.first(us[first])) for i, c in enumerate(self.spec.clocks)], 1) if self.spec.clocks else np.zeros((len(first), 0), np.int64)
        yield from self._ticks(frame, keys, born, due, np.where(silent, seen + (quiet or 0) + 1, seen))
        if silent.any():
            yield self._ended(frame, np.flatnonzero(silent), last[silent], keys[silent], born[silent], seen[silent] + quiet)
        kept = np.flatnonzero(~goes)
        at = slot[kept]
        lives.alive[at], lives.born[at], lives.seen[at], lives.due[at] = ~ends[last[kept]], born[kept], seen[kept], due[kept]
        after = {s: [frame.after(s, kept, last[kept], i + 1) for i in range(len(held))] for s, held in lives.past.items()}
        for s, held in lives.past.items():
            for i, column in enumerate(held):
                column[at] = after[s][i]

    def _without_rows(self, lives: _Lives, slot: np.ndarray) -> Frame:
        frame = Frame(np.zeros(0, np.int64), np.zeros(0, np.int64), slot, lives.past)
        for s, k in self.spec.names.items():
            frame.add(s, pd.array([], KINDS[k][2]))
        return frame

    def _pass(self, lives: _Lives, keys: np.ndarray, slot: np.ndarray, until: np.ndarray) -> Iterator[pd.DataFrame]:
        """The ticks of objects before until, without a row of theirs."""
        due = lives.due[slot]
        yield from self._ticks(self._without_rows(lives, slot), keys, lives.born[slot], due, until)
        lives.due[slot] = due

    def _fall_silent(self, lives: _Lives, keys: np.ndarray, slot: np.ndarray) -> Iterator[pd.DataFrame]:
        """Objects tick as long as the silence lasts, and are gone after that."""
        if len(slot):
            over = lives.seen[slot] + self.spec.silence_us
            yield from self._pass(lives, keys, slot, over + 1)
            yield self._ended(self._without_rows(lives, slot), np.arange(len(slot)), np.full(len(slot), -1), keys, lives.born[slot], over)
            lives.alive[slot] = False

    def _ended(self, frame: Frame, life: np.ndarray, rows: np.ndarray, keys: np.ndarray, born: np.ndarray, over: np.ndarray) -> pd.DataFrame:
        return self._rows(keys, over, "end", self._state(frame, life, rows), None, None, born, False, True)

    def _state(self, frame: Frame, life: np.ndarray, rows: np.ndarray) -> dict:
        """What lives hold after rows of the frame (-1: before all of theirs)."""
        nothing = lambda kind: pd.array([pd.NA] * len(rows), KINDS[kind][2])
        return {c: x for s, k in self.spec.names.items() for c, x in [(s, nothing(k)), (f"{s}_last", frame.after(s, life, rows, 1)), *[(f"{s}_{n}", frame.after(s, life, rows, n)) for n in range(1, self.spec.back(s) + 1)]]}

    def _ticks(self, frame: Frame, keys: np.ndarray, born: np.ndarray, due: np.ndarray, until: np.ndarray) -> Iterator[pd.DataFrame]:
        """Ticks of all clocks before until, in frames; due (by life and clock) moves on. Nothing is fresh at a tick."""
        for c, clock in enumerate(self.spec.clocks):
            n = np.maximum(0, -((due[:, c] - until) // clock.step_us))
            upto = np.cumsum(n)
            for lo in range(0, int(upto[-1]) if len(n) else 0, FRAME):
                number = np.arange(lo, min(lo + FRAME, upto[-1]))
                life = np.searchsorted(upto, number, "right")
                ticks = due[life, c] + (number - upto[life] + n[life]) * clock.step_us
                yield self._rows(keys[life], ticks, "tick", self._state(frame, life, frame.upto(life, ticks)), None, clock.name, born[life], False, False)
            due[:, c] += n * clock.step_us

    def _rows(self, key, us, kind: str, own: dict, order, clock: str | None, born, starts, ends) -> pd.DataFrame:
        n = len(us)
        order = pd.array([pd.NA] * n if order is None else order, "Int64")
        return pd.DataFrame({"key": key, "us": us, "order": order, "kind": kind, "clock": pd.array([clock] * n, "string"), "born": born, "starts": starts, "ends": ends, **own}, index=range(n))


def _true(x) -> np.ndarray:
    """Where a condition holds; null does not."""
    x = pd.array(x, "boolean")
    return x.fillna(False).to_numpy(bool)


def life_stream(stream: DataFrame, key: str, ts: str, order: str, spec: Objects, delay: str) -> DataFrame:
    """Events, ticks and ends of all objects of a stream, as Objects.schema() and ts says, once the watermark, `delay` behind the latest time, has passed them.

    Rows without a key or a time are no object's, but one with a time moves the watermark: so a bounded stream is brought to its end. Results do not depend on the order of arrival, as far as rows come before the watermark.
    """
    plain = [F.col(s).cast(k).cast("string" if k == "bigint" else k).alias(s) for s, k in spec.signals.items()]  # pandas has no whole numbers beside nulls
    rows = stream.select(F.col(key).cast("bigint").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(order).cast("bigint").alias("order"), *plain)
    # a condition on the time, too, so that it is not applied before the watermark sees the rows
    timed = rows.withWatermark("ts", delay).where(F.when(F.col("ts").isNotNull(), F.col("key").isNotNull()))
    found = timed.withColumn("lane", F.pmod(F.xxhash64("key"), F.lit(LANES))).groupBy("lane").transformWithStateInPandas(statefulProcessor=LifeProcessor(spec, lanes=True), outputStructType=spec.schema(), outputMode="Append", timeMode="EventTime")
    return found.withColumn("ts", F.timestamp_micros("us"))


# what monitors put out, from the rows of life_stream(): projections, so they run on the stream


def stream_delta(states: DataFrame, derived: list[str]) -> DataFrame:
    """(cycle_id, change, stream, key, value): starts, ends and updates of derived signals. The end of a silence has no cycle."""
    return _changes(states, [*_lives(), *_updates("update", derived)])


def stream_full_delta(states: DataFrame, derived: list[str], inputs: list[str], rules: list[tuple]) -> DataFrame:
    """stream_delta(), the fresh inputs, and the rules (name, guard, message) that fire in a row."""
    fired = [(guard & (F.col("kind") == "event"), "fired", name, message) for name, guard, message in rules]
    return _changes(states, [*_lives(), *_updates("update", derived), *_updates("input", inputs), *fired])


def stream_snapshots(states: DataFrame, signals: list[str]) -> DataFrame:
    """(cycle_id, key, signals): what the object of each row holds after it."""
    return states.where("kind = 'event'").select(F.col("order").alias("cycle_id"), "key", *[F.col(f"{s}_last").alias(s) for s in signals])


def _lives() -> list[tuple]:
    return [(F.col("starts"), "activate", "object", F.lit(None)), (F.col("ends"), "deactivate", "object", F.lit(None))]


def _updates(change: str, names: list[str]) -> list[tuple]:
    return [((F.col("kind") == "event") & F.col(s).isNotNull(), change, s, F.col(s)) for s in names]


def _changes(states: DataFrame, wanted: list[tuple]) -> DataFrame:
    made = [F.when(when, F.struct(F.lit(change).alias("change"), F.lit(name).alias("stream"), value.cast("string").alias("value"))) for when, change, name, value in wanted]
    rows = states.select(F.col("order").alias("cycle_id"), "key", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x"))
    return rows.select("cycle_id", "x.change", "x.stream", "key", "x.value")
