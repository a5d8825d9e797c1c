"""Comparisons of two objects' numbers against all pairs."""

import operator
import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_monitor import cars, frame, trace

from objwatch.operators import inequality
from objwatch.operators.inequality import Compare
from objwatch.operators.quantify import exists

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


@pytest.mark.parametrize("seed", range(20))
def test_counts_of_earlier_smaller_values(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 70))
    value, weight, asks, strict = r.integers(0, 8, n).astype(float), r.integers(-1, 2, n), r.random(n) < 0.5, bool(seed % 2)
    want = [sum(int(weight[k]) for k in range(i) if not asks[k] and (value[k] < value[i] or not strict and value[k] == value[i])) if asks[i] else 0 for i in range(n)]
    assert inequality.earlier_below(value, weight, asks, strict).tolist() == want


def sides(seed, end=300):
    r = random.Random(seed)
    one = lambda: [(lo, min(end, lo + r.choice([1, 2, 20, 100, 300])), r.choice([None, float("nan"), 3.0, 3.0, float(r.randrange(9))])) for _ in range(60) for lo in [r.randrange(end - 1)]]
    return one(), one()


@pytest.mark.parametrize(("op", "crowd"), [(">", 10**6), (">=", 10**6), (">", 10), (">=", 10), ("<", 10), ("<=", 10)])
def test_pair_counts_equal_all_pairs(spark, op, crowd):
    """With blocks of few cycles, and with values cut into many ranges, some of one value that many share."""
    left, right = sides(len(op) + crowd % 7)
    frames = [spark.createDataFrame(rows, "lo bigint, hi bigint, x double") for rows in (left, right)]
    cycles = spark.range(300).select(F.col("id").alias("cycle")).where("cycle % 3 <> 1")
    got = inequality.pair_counts(*frames, op, cycles, block=32, crowd=crowd).collect()
    holds = OPS[op]
    alive = lambda rows, c: [x for lo, hi, x in rows if lo <= c < hi and x is not None and x == x]
    want = {c: sum(holds(x, y) for x in alive(left, c) for y in alive(right, c)) for c in range(300) if c % 3 != 1}
    assert {r["cycle"]: r["n"] for r in got} == want and max(want.values()) > 20


@pytest.mark.parametrize("seed", range(2))
def test_two_largest_equal_sorting(spark, seed):
    left, _ = sides(seed + 50)
    df = spark.createDataFrame(left, "lo bigint, hi bigint, x double")
    cycles = spark.range(0, 310, 1 + seed).select(F.col("id").alias("cycle"))
    got = {r["cycle"]: (r["top"], r["second"]) for r in inequality.two_largest(df, cycles, block=16).collect()}
    for c in range(0, 310, 1 + seed):
        found = sorted((x for lo, hi, x in left if lo <= c < hi and x is not None and x == x), reverse=True)
        assert got[c] == (*found[:2], *[None] * (2 - len(found[:2])))


@pytest.mark.parametrize("seed", range(2))
def test_comparisons_equal_joins(spark, seed):
    rows = trace(400 + seed, 80, 6)
    o, cycles, args = cars(spark, rows).ending(F.col("b") == 5), frame(spark, rows).select("cycle"), {"end": len(rows)}
    column = lambda df, c: [r[c] for r in df.orderBy("cycle").collect()]
    pair, some = {"a": o, "b": o}, {"a": lambda a: a.b.last(1.0) > 0}
    cases = [
        (Compare(pair, lambda a: a.a.last(), ">", lambda b: b.b.prev(2.0), some, **args), lambda a, b: (a.b.last(1.0) > 0) & (a.a.last() > b.b.prev(2.0))),
        (Compare(pair, lambda a: a.a.last(), "<=", lambda b: b.a.last(), some, True, **args), lambda a, b: (a.b.last(1.0) > 0) & (a != b) & (a.a.last() <= b.a.last())),
        (Compare(pair, lambda a: a.a.last(), ">=", lambda b: 0.3 - b.a.last() * 0.1, {}, True, 1e-9, lambda a, b: a.a.last() + b.a.last() * 0.1 >= 0.3, **args), lambda a, b: (a != b) & (a.a.last() + b.a.last() * 0.1 >= 0.3)),
        (Compare(pair, lambda a: a.a.last() * 0.1, "<", lambda b: 0.7 - b.a.last() * 0.1, some, False, 1e-9, lambda a, b: a.a.last() * 0.1 + b.a.last() * 0.1 < 0.7, **args), lambda a, b: (a.b.last(1.0) > 0) & (a.a.last() * 0.1 + b.a.last() * 0.1 < 0.7)),
    ]
    for made, body in cases:
        want = column(exists(body, pair, **args).counts(cycles), "n")
        assert column(made.counts(cycles), "n") == want and max(want) > 3
    assert column(cases[0][0].truth(cycles), "holds") == [n > 0 for n in column(cases[0][0].counts(cycles), "n")]


def test_what_cannot_be_compared(spark):
    o = cars(spark, [(1, 1.0, 0.0)])
    left = lambda a: a.a.last()
    make = partial(Compare, {"a": o, "b": o}, left)
    for wrong in (make("=", left), make(">", left, slack=1.0)):
        with pytest.raises(ValueError):
            wrong.counts(frame(spark, [(1, 1.0, 0.0)]).select("cycle"))
