"""The state of objects on streams against a literal model, whatever the batches, chunks and frames."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from objwatch.streaming import lives
from objwatch.streaming.lives import Clock, Let, LifeProcessor, Objects

SPEC = Objects(
    {"a": "double", "b": "string", "n": "bigint"},
    (
        Let("c", "double", lambda f: f.now("a") - f.prev("a"), lambda f: f.fresh("b")),
        Let("d", "bigint", lambda f: f.last("n") - f.history("n", 2)),
        Let("up", "boolean", lambda f: f.last("c") > f.prev("c")),
    ),
    {"a": 2, "d": 0},
    (Clock("own", 20_000), Clock("shared", 30_000, 1_000)),
    ends=lambda f: f.now("a") == 0,
    silence_us=55_000,
)
KEPT = {"a": 2, "b": 1, "n": 1, "c": 1, "d": 0, "up": 1}


def model(rows, mark):
    """Rows, ticks and ends of one object before mark: rows are (us, order, a, b, n)."""
    out, past, born, seen, due = [], None, None, None, {}

    def held(k):
        return {x: v for s, n in KEPT.items() for x, v in [(s, None), (f"{s}_last", past[s][0] if past[s] else None), *[(f"{s}_{i}", past[s][i - 1] if len(past[s]) >= i else None) for i in range(1, n + 1)]]}

    def ticks(until):
        for name, step in (("own", 20_000), ("shared", 30_000)):
            while due[name] < until:
                out.append((due[name], None, "tick", name, born, False, False, held(None)))
                due[name] += step

    def silent():
        nonlocal past
        ticks(seen + 55_001)
        out.append((seen + 55_000, None, "end", None, born, False, True, held(None)))
        past = None

    for us, order, a, b, n in sorted(rows, key=lambda r: r[:2]):
        if us >= mark:
            break
        if past is not None and us - seen > 55_000:
            silent()
        starts = past is None
        if starts:
            past, born = {s: [] for s in KEPT}, us
            due = {"own": us + 20_000, "shared": 1_000 + 30_000 * max(1, -((1_000 - us) // 30_000))}
        ticks(us)
        before = {s: list(x) for s, x in past.items()}
        now = {"a": a, "b": b, "n": n}

        def put(s):
            if now[s] is not None:
                past[s].insert(0, now[s])

        for s in "abn":
            put(s)
        now["c"] = a - before["a"][0] if a is not None and b is not None and before["a"] else None
        put("c")
        now["d"] = past["n"][0] - before["n"][1] if len(before["n"]) > 1 else None
        put("d")
        now["up"] = past["c"][0] > before["c"][0] if past["c"] and before["c"] else None
        put("up")
        own = {x: v for s, k in KEPT.items() for x, v in [(s, now[s]), (f"{s}_last", past[s][0] if past[s] else None), *[(f"{s}_{i}", before[s][i - 1] if len(before[s]) >= i else None) for i in range(1, k + 1)]]}
        out.append((us, order, "event", None, born, starts, a == 0, own))
        seen = us
        if a == 0:
            past = None
    if past is not None:
        if mark - seen > 55_000:
            silent()
        else:
            ticks(mark)
    return out


class Held(dict):
    """Map and value state."""

    updateValue, getValue, removeKey = dict.__setitem__, dict.get, dict.pop  # noqa: N815
    iterator = dict.items
    exists = lambda self: bool(self)
    get = lambda self: self["v"]

    def update(self, v):
        self["v"] = v


class Handle:
    def __init__(self):
        self.timers = set()

    getMapState = getValueState = lambda self, *_: Held()  # noqa: E731, N815
    registerTimer = lambda self, ms: self.timers.add(ms)  # noqa: E731, N815
    deleteTimer = lambda self, ms: self.timers.discard(ms)  # noqa: E731, N815


class Times:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms  # noqa: N815


def played(batches, spec=SPEC, delay=300):
    """Run the processor of one object over batches; a batch's rows come before its timers, which see the time of the batches before."""
    p, handle, found, latest = LifeProcessor(spec), Handle(), [], None
    p.init(handle)
    for batch in [*batches, []]:
        now = Times(0 if latest is None else latest // 1000 - delay)
        if batch:
            columns = dict(zip(["us", "order", *spec.signals], map(list, zip(*batch, strict=True)), strict=True))
            for s, kind in spec.signals.items():  # as pandas gets them from Spark
                columns[s] = pd.Series([None if x is None else str(x) for x in columns[s]] if kind == "bigint" else columns[s], dtype=float if kind == "double" else object)
            frame = pd.DataFrame(columns)
            assert not list(p.handleInputRows((7,), iter([frame]), now))
        assert len(handle.timers) <= 1
        while handle.timers and min(handle.timers) <= now.getCurrentWatermarkInMs():
            handle.timers.pop()
            for made in p.handleExpiredTimer((7,), now, None):
                assert list(made.columns) == [f for f in spec.schema().names if f != "ts"]
                found += made.astype(object).where(made.notna(), None).to_dict("records")
        assert len(handle.timers) <= 1
        if batch:
            latest = max(latest or 0, *[r[0] for r in batch])
    return found, (latest // 1000 - delay) * 1000


def rows_of(r, n):
    us, out = 5_000, []
    for i in range(n):
        us += r.choice([0, 0, 1_000, 7_000, 20_000, 30_000, 56_000, 200_000]) if r.random() < 0.6 else r.randrange(9_000)
        out.append((us, i, r.choice([None, 0.0, 1.5, 4.0]), r.choice([None, "x", "yy"]), r.choice([None, 3, 2**60 + r.randrange(9)])))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_lives_equal_the_model(seed, monkeypatch):
    """Types that differ, gated lets with a history, ends, silences and three clocks; out of order, over many batches, chunks and frames."""
    monkeypatch.setattr(lives, "CHUNK", 3)
    monkeypatch.setattr(lives, "FRAME", 4 if seed % 2 else 10_000)
    r = random.Random(seed)
    rows = rows_of(r, 60)
    mixed = sorted(rows, key=lambda x: x[0] + r.randrange(250_000))  # less out of order than the delay
    batches = []
    while mixed:
        k = r.choice([1, 5, 30])
        batches.append(mixed[:k])
        mixed = mixed[k:]
    last = max(x[0] for x in rows) + 900_000
    got, mark = played([*batches, [(last, 99, 1.0, None, None)]])
    names = [x for s, n in KEPT.items() for x in (s, f"{s}_last", *[f"{s}_{k}" for k in range(1, n + 1)])]
    plain = sorted(repr((x["us"], x["order"], x["kind"], x["clock"], x["born"], bool(x["starts"]), bool(x["ends"]), {c: (bool(x[c]) if c.startswith("up") and x[c] is not None else x[c]) for c in names})) for x in got)
    want = sorted(repr(x) for x in model([*rows, (last, 99, 1.0, None, None)], mark))
    assert plain == want and {"event", "tick", "end"} <= {x["kind"] for x in got}


def test_many_ticks_come_in_frames(monkeypatch):
    monkeypatch.setattr(lives, "FRAME", 100)
    spec = Objects({"a": "double"}, clocks=(Clock("own", 1_000),))
    p, handle = LifeProcessor(spec), Handle()
    p.init(handle)
    list(p.handleInputRows((1,), iter([pd.DataFrame({"us": [0, 500_000], "order": [0, 1], "a": [1.0, 2.0]})]), Times(0)))
    handle.timers.clear()  # it has fired
    made = list(p.handleExpiredTimer((1,), Times(1_000), None))
    assert max(map(len, made)) <= 200 and sum(map(len, made)) == 2 + 999
    ticks = pd.concat(made)
    ticks = ticks[ticks["kind"] == "tick"]
    assert (ticks["a_last"] == np.where(ticks["us"] < 500_000, 1.0, 2.0)).all() and list(ticks["us"]) == list(range(1_000, 1_000_000, 1_000))
    assert handle.timers == {1_001}


def test_nothing_is_left_of_objects_that_are_gone():
    spec = Objects({"a": "double"}, silence_us=10_000, clocks=(Clock("own", 4_000),))
    p, handle = LifeProcessor(spec), Handle()
    p.init(handle)
    list(p.handleInputRows((1,), iter([pd.DataFrame({"us": [0], "order": [0], "a": [1.0]})]), Times(0)))
    handle.timers.clear()
    kinds = [k for made in p.handleExpiredTimer((1,), Times(50), None) for k in made["kind"]]
    assert kinds == ["event", "tick", "tick", "end"]
    assert not (p.waiting or p.chunks or p.held or p.due or p.timer or handle.timers)


# ---- counts of the engine


def test_batch_counts(spark):
    """A batch that is reported twice counts once; one without rows has no latest time."""
    from types import SimpleNamespace as N

    from objwatch.streaming import monitor

    def progress(batch, rows, dropped, latest, mark="2024-01-01T00:00:00.000Z"):
        seen = {} if rows is None else {"arrivals": {"rows": rows, "latest": latest}}
        return N(batchId=batch, observedMetrics=seen, stateOperators=[N(numRowsDroppedByWatermark=d) for d in dropped], eventTime={"watermark": mark} if mark else {})

    found = monitor.batch_counts(spark, [progress(0, 5, [0], 1_000_000, None), progress(1, None, [0], None), progress(2, 4, [3, 1], 2_500_000), progress(2, None, [0], None), progress(3, 2, [], None)])
    got = [(r["batch"], r["rows"], r["dropped"], r["latest"]) for r in found.select("batch", "rows", "dropped", F.unix_micros("latest").alias("latest")).orderBy("batch").collect()]
    assert got == [(0, 5, 0, 1_000_000), (1, 0, 0, None), (2, 4, 4, 2_500_000), (3, 2, 0, None)]
    assert [r[0] is None for r in found.orderBy("batch").select("watermark").collect()] == [True, False, False, False]
    assert monitor.batch_counts(spark, []).count() == 0
