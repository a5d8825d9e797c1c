"""Aggregates over objects at ticks: by blocks of ticks, against the states of all objects and against a literal loop."""

import random

import pytest
from pyspark.sql import functions as F

from objwatch.operators import activation, quantify
from objwatch.operators.objects import objects

HOW = {"n": "count", "low": "min", "top": "max", "total": "sum", "mean": "avg"}


def literal(rows, step, end, zero, ends):
    """(tick, n, low, top, total, mean) cycle by cycle; rows: (uid, at, n, v)."""
    out = []
    for tick in range(zero + step, end + 1, step):
        state, alive = {}, {}
        for uid, at, _, v in sorted((r for r in rows if r[1] is not None and r[1] <= tick), key=lambda r: (r[0], r[1], r[2])):
            if not alive.get(uid):
                state[uid] = None
            state[uid] = state[uid] if v is None else v
            alive[uid] = not (ends and v is not None and v > 90)
        if any(alive.values()):
            held = [state[u] for u in state if alive[u] and state[u] is not None]
            out.append((tick, len(held), *((min(held), max(held), sum(held), sum(held) / len(held)) if held else (None,) * 4)))
    return out


def found(spark, rows, step, end, zero=0, ends=False):
    frame = spark.createDataFrame(rows, "uid bigint, at bigint, n bigint, v bigint").withColumn("level", F.lit("x")).withColumn("block", F.lit("y"))
    objs = objects(frame, "uid", ["v"], ["at", "n"])
    objs = objs.ending(F.col("v") > 90) if ends else objs
    return objs, sorted(tuple(r) for r in quantify.agg_at_ticks(objs, "v", HOW, "at", step, end, zero).select("tick", *HOW).collect())


@pytest.mark.parametrize("ends", [False, True])
@pytest.mark.parametrize(("seed", "step", "zero"), [(0, 1, 0), (1, 7, 0), (2, 50, 3), (3, 3, -100), (4, 1000, 0), (5, 10, 120)])
def test_blocks_equal_a_literal_loop(spark, seed, step, zero, ends):
    r = random.Random(seed)
    rows = [(r.randrange(6), r.choice([None, *[r.randrange(300)] * 9]), n, r.choice([None, r.randrange(100)])) for n in range(80)]
    objs, got = found(spark, rows, step, 320, zero, ends)
    assert got == literal(rows, step, 320, zero, ends)
    if zero >= 0:
        whole = objects(objs.rows.where("at is not null"), "uid", ["v"], ["at", "n"])
        whole = whole.ending(F.col("v") > 90) if ends and "life" not in objs.rows.columns else whole
        if not ends:
            states = activation.state_at(whole, activation.ticks_of_objects(whole, "at", step, 320, zero), "at", ["v"])
            assert got == sorted(tuple(x) for x in quantify.agg_objects(states, "v", HOW).select("tick", *HOW).collect())


def test_long_blocks_are_cut(spark):
    """One update, held for more ticks than a block has, and one in between."""
    end = 5 * 2**quantify.BLOCK_LEVEL + 77
    _, got = found(spark, [(1, 0, 0, 4), (2, 9000, 1, 10), (1, 12_345, 2, None)], 1, end)
    assert got == [(t, 1, 4, 4, 4, 4.0) if t < 9000 else (t, 2, 4, 10, 14, 7.0) for t in range(1, end + 1)]


def test_nothing_to_add_up(spark):
    assert found(spark, [], 5, 100)[1] == []
    assert found(spark, [(1, 50, 0, 1)], 60, 50)[1] == []
    assert found(spark, [(1, 50, 0, None)], 60, 130)[1] == [(60, 0, None, None, None, None), (120, 0, None, None, None, None)]
    assert found(spark, [(None, 50, 0, 3)], 60, 130)[1] == []


def test_nanoseconds_are_whole_numbers(spark):
    zero = 1_700_000_000_000_000_001
    assert [t for t, *_ in found(spark, [(1, zero + 11, 0, 1)], 10, zero + 45, zero)[1]] == [zero + 20, zero + 30, zero + 40]


def test_values_held_throughout(spark):
    """Many objects with one update each, whose blocks are the same."""
    _, got = found(spark, [(u, 0, 0, u) for u in range(200)], 1, 1000)
    assert got == [(t, 200, 0, 199, 19_900, 99.5) for t in range(1, 1001)]


def test_flags_and_what_cannot_be_added_up(spark):
    frame = spark.createDataFrame([(1, 1, True), (2, 1, None), (2, 3, False)], "uid bigint, at bigint, v boolean")
    objs = objects(frame, "uid", ["v"], ["at"])
    got = quantify.agg_at_ticks(objs, "v", {"all": "bool_and", "some": "bool_or"}, "at", 2, 4)
    assert sorted(map(tuple, got.collect())) == [(2, True, True), (4, False, True)]
    with pytest.raises(ValueError, match="median"):
        quantify.agg_at_ticks(objs, "v", "median", "at", 2, 4)
