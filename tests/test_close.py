"""Counts of close pairs against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_monitor import cars, frame, trace

from objwatch.operators.close import Close, close_changes
from objwatch.operators.quantify import Near, exists


@pytest.mark.parametrize("seed", range(20))
def test_changes_equal_all_pairs(seed):
    r = np.random.default_rng(seed)
    n, same, strict = int(r.integers(0, 40)), bool(seed % 2), bool(seed % 3)
    lo = r.integers(0, 30, n)
    hi, x, guest = lo + r.integers(1, 12, n), r.choice([0.1, 0.2, 0.3, 0.1 + 0.2, 0.7, 1.0], n), r.random(n) < 0.4
    holds = lambda a, b: np.abs(a - b) < 0.2 if strict else np.abs(a - b) <= 0.2
    at, d = close_changes(lo, hi, x, guest, same, 0.2, holds)
    for t in range(45):
        alive = [i for i in range(n) if lo[i] <= t < hi[i]]
        want = sum(bool(holds(x[i], x[j])) for k, i in enumerate(alive) for j in alive[k + 1 :] if guest[i] != guest[j] or same and not guest[i])
        assert d[at <= t].sum() == want


@pytest.mark.parametrize(("seed", "crowd"), [(0, 10**6), (1, 9)])
def test_close_equals_joins(spark, seed, crowd):
    """In one and two dimensions, strict or not, with a condition, objects that end, and cells cut into blocks."""
    rows = trace(500 + seed, 80, 6)
    o, cycles, end = cars(spark, rows).ending(F.col("b") == 5), frame(spark, rows).select("cycle"), len(rows)
    column = lambda df: [r["n"] for r in df.orderBy("cycle").collect()]
    some = lambda x: x.b.last(1.0) > 0
    apart = lambda a, b: F.sqrt((a.a.last() - b.a.last()) * (a.a.last() - b.a.last()) + (a.b.last() - b.b.last()) * (a.b.last() - b.b.last()))
    cases = [
        (Close(o, ("a",), 1.0, end=end), lambda a, b: a.uid < b.uid, Near("a", "b", "a", 1.0)),
        (Close(o, ("a",), 2.0, where=some, end=end), lambda a, b: (a.uid < b.uid) & some(a) & some(b), Near("a", "b", "a", 2.0)),
        (Close(o, ("a", "b"), 2.0, True, end=end), lambda a, b: (a.uid < b.uid) & (apart(a, b) < 2.0), Near("a", "b", ("a", "b"), 2.0)),
        (Close(o, ("a", "b"), 2.0, end=end), lambda a, b: (a.uid < b.uid) & (apart(a, b) <= 2.0), Near("a", "b", ("a", "b"), 2.0)),
    ]
    for made, body, near in cases:
        want = column(exists(body, {"a": o, "b": o}, near=near, end=end).counts(cycles))
        assert column(made.counts(cycles, crowd)) == want and max(want) > 1


def test_no_pairs_are_made(spark):
    """Four thousand objects in one place, to the end: eight million pairs, and as many intervals in a join."""
    from objwatch.operators.objects import objects

    t = spark.range(4000).select(F.col("id").alias("cycle"), F.col("id").alias("user"), F.lit(0.5).alias("x"), F.lit(1.0).alias("y"))
    for signals in (("x",), ("x", "y")):
        got = Close(objects(t, "user", ["x", "y"], ["cycle"]), signals, 1.0, end=4000).counts(t.select("cycle"))
        assert got.where("cycle = 3999").first()["n"] == 4000 * 3999 // 2
