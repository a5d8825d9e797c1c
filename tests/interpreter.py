"""A literal model of the monitor, cycle by cycle, for tests only: rows are dicts, None is absent."""

from __future__ import annotations


class Model:
    """Feeds rows one at a time; state(n) of an object is the list of its updates, newest first, by signal."""

    def __init__(self, key: str, signals: list[str]):
        self.key, self.signals, self.objects = key, signals, {}
        self.fresh: dict[tuple, bool] = {}

    def cycle(self, row: dict) -> None:
        self.fresh = {}
        k = row[self.key]
        if k is None:
            return
        held = self.objects.setdefault(k, {s: [] for s in self.signals})
        for s in self.signals:
            if row[s] is not None:
                held[s].insert(0, row[s])
                self.fresh[k, s] = True

    def last(self, k, s, default=None):
        past = self.objects[k][s]
        return past[0] if past else default

    def history(self, k, s, n, default=None):
        past = self.objects[k][s][1:] if self.fresh.get((k, s)) else self.objects[k][s]
        return past[n - 1] if len(past) >= n else default

    def exists(self, body) -> bool:
        return any(body(k) is True for k in self.objects)

    def forall(self, body) -> bool:
        return all(body(k) is True for k in self.objects)

    def pairs(self, body) -> list[tuple]:
        return [(a, b) for a in self.objects for b in self.objects if body(a, b) is True]
