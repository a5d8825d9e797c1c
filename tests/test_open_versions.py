"""Versions open under a join key of a stream: as many places as are open at a time."""

import random

import pandas as pd
from test_streams import Handle, Times

from objwatch.streaming.world import PairProcessor


def test_places_of_closed_versions_are_taken_again():
    """Six objects, hundreds of versions, two batches: a version never meets more than the places of six, and pairs are those of a plain count."""
    seen = []

    def body(a, b):
        seen.extend(len(x.uid) for x in (a, b) if hasattr(x.uid, "__len__"))
        return (a.uid < b.uid) & (a.v > b.v)

    p = PairProcessor({"v": "double"}, body)
    p.init(Handle())
    r, alive, n, us = random.Random(3), {}, 0, 0
    for _ in range(2):
        rows, want = [], []
        for _ in range(300):
            us, u = us + 1, r.randrange(6)
            if u in alive:
                rows.append((us, 0, 0, -1, u, alive.pop(u)))
            if r.random() < 0.8:
                alive[u] = float(r.randrange(5))
                rows.append((us, 0, 0, 1, u, alive[u]))
            want.append((us, sum(a < b and alive[a] > alive[b] for a in alive for b in alive)))
        made = list(p.handleInputRows(("=1",), iter([pd.DataFrame(rows, columns=["us", "order", "phase", "sign", "uid", "v"])]), Times(0)))
        d = pd.concat(made).groupby("us")["d"].sum()
        for us_, count in want:
            n += int(d.get(us_, 0))
            assert n == count
    assert max(seen) <= 6
