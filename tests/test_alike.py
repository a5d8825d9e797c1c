"""Counts of objects that hold the same against all choices of them."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_monitor import cars, frame, trace

from objwatch.operators.alike import Alike, chain_changes
from objwatch.operators.quantify import exists


@pytest.mark.parametrize("seed", range(20))
def test_chains_equal_all_choices(seed):
    r = np.random.default_rng(seed)
    k, rows = int(r.integers(1, 4)), []
    for uid in r.permutation(50)[: int(r.integers(1, 9))].tolist():
        cuts = sorted(set(r.integers(0, 30, 6).tolist()))
        rows += [(lo, hi, uid, *(r.random(k) < 0.7)) for lo, hi in zip(cuts, cuts[1:], strict=False) if r.random() < 0.8]
    lo, hi, uid, *may = (np.array(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, int)] * 3 + [np.zeros(0, bool)] * k
    at, d = chain_changes(lo, hi, uid, list(may))
    assert len(set(at.tolist())) == len(at)
    for t in range(31):
        alive = sorted((x for x in rows if x[0] <= t < x[1]), key=lambda x: x[2])
        want = sum(all(x[3 + i] for i, x in enumerate(chosen)) for chosen in combinations(alive, k))
        assert d[at <= t].sum() == want


@pytest.mark.parametrize(("seed", "crowd"), [(0, 10**6), (1, 7)])
def test_alike_equals_joins(spark, seed, crowd):
    """Objects that end, null keys, conditions that some versions of a key meet, and keys cut into blocks."""
    rows = trace(900 + seed, 80, 6)
    o, cycles, end = cars(spark, rows).ending(F.col("b") == 5), frame(spark, rows).select("cycle"), len(rows)
    key = lambda x: F.floor(x.a.last() / 2)
    some = lambda x: x.b.last(1.0) > 0
    column = lambda df: [r["n"] for r in df.orderBy("cycle").collect()]
    pair = lambda a, b: (key(a) == key(b)) & (a.uid < b.uid)
    cases = [
        (Alike(["a", "b"], o, key, end=end), pair, "ab"),
        (Alike(["a", "b"], o, key, {"a": some}, end=end), lambda a, b: pair(a, b) & some(a), "ab"),
        (Alike(["a", "b", "c"], o, key, {"b": some}, end=end), lambda a, b, c: pair(a, b) & pair(b, c) & some(b), "abc"),
    ]
    for made, body, names in cases:
        want = column(exists(body, dict.fromkeys(names, o), end=end).counts(cycles))
        assert column(made.counts(cycles, crowd)) == want and max(want) > 1
    assert not any("__" in c for c in made.counts(cycles).columns)


def test_no_pairs_are_made(spark):
    """Four thousand objects that all hold the same, to the end: eight million pairs, and as many intervals in a join."""
    from objwatch.operators.objects import objects

    t = spark.range(4000).select(F.col("id").alias("cycle"), F.col("id").alias("user"), F.lit(1).alias("x"))
    o = objects(t, "user", ["x"], ["cycle"])
    for where in ({}, {"a": lambda x: x.uid % 2 == 0}):
        got = Alike(["a", "b"], o, lambda x: x.x.last(), where, end=4000).counts(t.select("cycle")).where("cycle = 3999").first()["n"]
        assert got == (4000 * 3999 // 2 if not where else sum(3999 - u for u in range(0, 4000, 2)))


@pytest.mark.parametrize(("seed", "listed", "step"), [(0, 1024, 1), (1, 3, 1), (2, 5, 9000)])
def test_witnesses_equal_joins(spark, seed, listed, step):
    """Objects that end or not, null keys, conditions, cycles asked for twice or without objects, lists and blocks of a few cycles, and cycles far apart."""
    from objwatch.operators.objects import objects

    rows = trace(700 + seed, 80, 6)
    t = frame(spark, rows).withColumn("cycle", F.col("cycle") * step)
    end = (len(rows) - 1) * step + 1
    asked = t.where("cycle % 3 <> 1").select("cycle").unionByName(t.where("cycle % 7 = 0").select("cycle")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS cycle"))
    key = lambda x: F.floor(x.a.last() / 2)
    some = lambda x: x.b.last(1.0) > 0
    pair = lambda a, b: (key(a) == key(b)) & (a.uid < b.uid)
    o = objects(t, "uid", ["a", "b"], ["cycle"])
    o = o.ending(F.col("b") == 5) if seed else o
    cases = [
        (Alike(["a", "b"], o, key, {"a": some}, end=end), lambda a, b: pair(a, b) & some(a), "ab"),
        (Alike(["a", "b", "c"], o, key, end=end), lambda a, b, c: pair(a, b) & pair(b, c), "abc"),
    ]
    for made, body, names in cases:
        want = exists(body, dict.fromkeys(names, o), end=end).witnesses(asked)
        got = made.witnesses(asked, listed)
        assert got.schema["cycle"] == want.schema["cycle"] and set(got.columns) == set(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) != []
    assert made.witnesses(asked.where("cycle is null")).count() == 0


def test_binding_witnesses_shuffles_no_pairs(spark, tmp_path):
    """Two hundred users that hold the same to the end: 19,900 pairs, which were shuffled for each range of cycles that they last."""
    from objwatch.plans import catalog

    held = spark.range(200).selectExpr("id AS event_id", "id AS user_id", "'view' AS event_type", "150.5D AS value")
    errors = spark.range(1, 61).selectExpr("id * 1000 AS event_id", "999L AS user_id", "'error' AS event_type", "5D AS value")
    held.unionByName(errors).selectExpr("*", "timestamp_ntz'2024-01-02' AS ts", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    sc = spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    assert catalog.QUERIES["binding_witnesses"](spark, str(tmp_path)).count() == 60 * 19_900
    assert sum(n for stage, n in shuffled().items() if stage not in before) < 10_000


def test_keys_share_the_cycles_of_witnesses(spark, tmp_path):
    """Three hundred pairs of users, each with a whole value of its own to the end, and 20,000 cycles, which were shuffled once for each value."""
    from objwatch.plans import catalog

    held = spark.range(600).selectExpr("id AS event_id", "id AS user_id", "'view' AS event_type", "CAST(100.5 + id % 300 AS DOUBLE) AS value")
    errors = spark.range(20_000).selectExpr("1000 + id * 64 + xxhash64(id) % 32 AS event_id", "999L AS user_id", "'error' AS event_type", "5D AS value")
    held.unionByName(errors).selectExpr("*", "timestamp_ntz'2024-01-02' AS ts", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    sc = spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = shuffled()
    assert catalog.QUERIES["binding_witnesses"](spark, str(tmp_path)).count() == 300 * 20_000
    assert sum(n for stage, n in shuffled().items() if stage not in before) < 1_200_000
