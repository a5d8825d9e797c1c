"""Objects of a lane, which are applied together, against the literal model of each by itself."""

import random

import pandas as pd
import pytest
from test_streams import KEPT, SPEC, Handle, Times, model, rows_of

from objwatch.streaming import lives
from objwatch.streaming.lives import LifeProcessor, Objects


def fed(p, handle, rows, mark):
    """One batch of (key, us, order, signals), whose rows come before its timers."""
    if rows:
        frame = pd.DataFrame(dict(zip(["key", "us", "order", *p.spec.signals], map(list, zip(*rows, strict=True)), strict=True)))
        for s, kind in p.spec.signals.items():
            frame[s] = pd.Series([None if x is None else str(x) if kind == "bigint" else x for x in frame[s].astype(object).where(frame[s].notna(), None)], dtype=float if kind == "double" else object)
        if "n" in frame:  # whole numbers that a float would round
            frame["n"] = pd.Series([None if r[-1] is None else str(r[-1]) for r in rows], dtype=object)
        assert not list(p.handleInputRows((0,), iter([frame]), Times(mark)))
    made = []
    while handle.timers and min(handle.timers) <= mark:
        handle.timers.pop()
        made += list(p.handleExpiredTimer((0,), Times(mark), None))
    assert len(handle.timers) <= 1
    return made


@pytest.mark.parametrize("seed", range(8))
def test_lanes_equal_the_model_of_each_object(seed, monkeypatch):
    monkeypatch.setattr(lives, "CHUNK", 5)
    monkeypatch.setattr(lives, "FRAME", 7 if seed % 2 else 10_000)
    r = random.Random(seed)
    of = {key: [(us + key, i, a, b, n) for us, i, a, b, n in rows_of(r, r.choice([1, 20, 40]))] for key in (3, 11, -4, 2**40, 8)}
    mixed = sorted(((key, *row) for key, rows in of.items() for row in rows), key=lambda x: x[1] + r.randrange(250_000))
    last = max(x[1] for x in mixed) + 900_000
    mixed.append((99, last, 0, 1.0, None, None))
    of[99] = [(last, 0, 1.0, None, None)]
    p, handle, found, latest = LifeProcessor(SPEC, lanes=True), Handle(), [], None
    p.init(handle)
    while mixed or latest is not None:
        k = r.choice([1, 5, 30])
        batch, mixed = mixed[:k], mixed[k:]
        found += fed(p, handle, batch, 0 if latest is None else latest // 1000 - 300)
        if not batch:
            break
        latest = max(latest or 0, *[x[1] for x in batch])
    found = [x for made in found for x in made.astype(object).where(made.notna(), None).to_dict("records")]
    names = [x for s, n in KEPT.items() for x in (s, f"{s}_last", *[f"{s}_{k}" for k in range(1, n + 1)])]
    plain = sorted(repr((x["key"], (x["us"], x["order"], x["kind"], x["clock"], x["born"], bool(x["starts"]), bool(x["ends"]), {c: (bool(x[c]) if c.startswith("up") and x[c] is not None else x[c]) for c in names}))) for x in found)
    want = sorted(repr((key, x)) for key, rows in of.items() for x in model(rows, (latest // 1000 - 300) * 1000))
    assert plain == want and {"event", "tick", "end"} <= {x["kind"] for x in found}


def test_what_python_does_goes_by_frames_and_not_by_objects():
    """Three rows of each of a thousand objects are one frame, and each object is written once."""
    p, handle = LifeProcessor(Objects({"value": "double"}), lanes=True), Handle()
    p.init(handle)
    made = fed(p, handle, [(key, 1_000 + 10 * i, i, float(i)) for i in range(3) for key in range(1000)], 5)
    assert len(made) == 1 and len(made[0]) == 3000
    assert made[0][made[0]["order"] == 2]["value_1"].eq(1.0).all() and len(p.held) == 1000 and not p.waiting
    made = fed(p, handle, [(7, 9_000, 3, 8.0)], 20)
    assert [x.to_dict("records")[0]["value_1"] for x in made] == [2.0]
