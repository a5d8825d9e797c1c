"""Scenarios and randomized equality with the literal model."""

import random
import warnings
from dataclasses import replace

import pytest
from interpreter import Model
from pyspark.sql import functions as F

from objwatch.operators import activation, quantify, rules, temporal, verdicts
from objwatch.operators.activation import always, every, fresh
from objwatch.operators.objects import active_at, objects
from objwatch.operators.quantify import Near, exists, forall
from objwatch.operators.schema import ObjectClass, flatten_signals
from objwatch.plans import ordering

SCHEMA = "cycle bigint, ts timestamp_ntz, uid bigint, a double, b double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None, *r) for i, r in enumerate(rows)], SCHEMA)


def cars(spark, rows):
    return objects(frame(spark, rows), "uid", ["a", "b", "ts"], ["cycle"])


def fired(df):
    return [r["cycle_id"] for r in df.orderBy("cycle_id").collect()]


def test_sum_of_two_signals(spark):
    rows = [(1, 10.0, 85.0), (1, -33.0, -55.0), (1, -11.0, -47.0), (1, 23.0, 83.0), (1, 47.0, -93.0), (1, 82.0, -82.0), (1, 27.0, 59.0), (1, -92.0, 62.0)]
    assert fired(rules.object_rule(cars(spark, rows), "r", lambda me: me.a.now + me.b.now > 0.0, "alert", "m")) == [0, 3, 6]


def test_pairwise_distance(spark):
    rows = [(1, 0.0, 0.0), (2, 1.0, 0.0), (1, 0.1, 0.0), (2, 0.3, 0.0), (1, 0.2, 0.0)]
    o, cycles = cars(spark, rows), frame(spark, rows).select("cycle")
    far = lambda a, b: (a != b) & (F.abs(a.a.last() - b.a.last()) < 0.4)
    found = exists(far, {"a": o, "b": o}, end=5).truth(cycles)
    assert [r["holds"] for r in found.orderBy("cycle").collect()] == [False, False, False, True, True]
    near = exists(lambda a, b: a != b, {"a": o, "b": o}, end=5, near=Near("a", "b", "a", 0.4)).truth(cycles)
    assert [r["holds"] for r in near.orderBy("cycle").collect()] == [False, False, False, True, True]
    apart = lambda a, b: F.sqrt((a.a.last(0.0) - b.a.last(0.0)) ** 2 + (a.b.last(0.0) - b.b.last(0.0)) ** 2)
    both = exists(lambda a, b: (a != b) & (apart(a, b) < 0.4), {"a": o, "b": o}, end=5, near=Near("a", "b", ("a", "b"), 0.4)).truth(cycles)
    assert [r["holds"] for r in both.orderBy("cycle").collect()] == [False, False, False, True, True]


def test_versions_make_a_logarithm_of_rows(spark):
    """However long versions last, each is a few rows of the join: 100 objects and 10,000, in a trace of 20,000 cycles."""
    n = quantify.grids(20_000)
    for count in (100, 10_000):
        rows = spark.range(20_000).select(F.col("id").alias("cycle"), (F.col("id") % count).alias("uid"))
        o = objects(rows, "uid", [], ["cycle"]).versions([], None, "cycle").withColumn("hi", F.coalesce("hi", F.lit(20_000)))
        made = o.select(F.explode(F.concat(quantify.point_cells(F.col("lo"), n), quantify.interval_cells(F.col("lo"), F.col("hi")))))
        assert made.count() <= 20_000 * (n + 2) and n == 5


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_are_found_once(spark, seed):
    r = random.Random(seed)
    sides = [[(i, lo, lo + r.choice([1, 2, 7, 8, 9, 64, 65, 500])) for i in range(60) for lo in [r.randrange(600)]] for _ in range(2)]
    end = max(hi for side in sides for _, _, hi in side)
    left, right = (spark.createDataFrame(rows, f"{x} long, {x}lo long, {x}hi long") for rows, x in zip(sides, "ab", strict=True))
    got = quantify.joined_overlaps(left, right, ("alo", "ahi"), ("blo", "bhi"), end).select("a", "b").collect()
    want = [(i, k) for i, lo, hi in sides[0] for k, low, high in sides[1] if lo < high and low < hi]
    assert sorted(map(tuple, got)) == sorted(want)
    points = spark.range(end).select(F.col("id").alias("cycle"))
    inside = quantify.expand(left.withColumnsRenamed({"alo": "lo", "ahi": "hi"}), points, "cycle", end).collect()
    assert sorted((x["cycle"], x["a"]) for x in inside) == sorted((c, i) for i, lo, hi in sides[0] for c in range(lo, hi))


def test_a_body_without_keys_warns(spark):
    o = cars(spark, [(1, 1.0, 0.0), (2, 2.0, 0.0)])
    pair = {"a": o, "b": o}
    with pytest.warns(UserWarning, match="no equality"):
        exists(lambda a, b: (a != b) & (a.a.last() < b.a.last()), pair, end=2).intervals()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        exists(lambda a, b: (a != b) & (a.a.last() == b.a.last()), pair, end=2).intervals()
        forall(lambda a, b: a.b.last() == 1, pair, end=2, given=lambda a, b: (a != b) & (a.a.last() == b.a.last())).truth(frame(spark, [(1, 1.0, 0.0), (2, 2.0, 0.0)]).select("cycle"))


def test_forall_with_a_guard(spark):
    rows = [(1, 1.0, 5.0), (2, 1.0, 7.0), (3, 2.0, 9.0), (2, 3.0, None), (1, 2.0, None), (None, None, None), (3, None, 5.0)]
    o, cycles = cars(spark, rows), frame(spark, rows).select("cycle")
    q = forall(lambda a, b: a.b.last() == b.b.last(), {"a": o, "b": o}, end=len(rows), given=lambda a, b: (a != b) & (a.a.last() == b.a.last()))
    assert [r["holds"] for r in q.truth(cycles).orderBy("cycle").collect()] == [True, False, False, True, False, False, True]


@pytest.mark.parametrize(
    ("kind", "body", "rows", "holds"),
    [
        (forall, lambda c: c.a.last(-1.0) >= 0, [(None, None, None)], True),
        (exists, lambda c: c.a.last(1.0) > 0, [(None, None, None)], False),
        (exists, lambda c: F.lit(True), [(1, 7.0, None)], True),
        (forall, lambda c: F.lit(False), [(1, 7.0, None)], False),
        (exists, lambda c: c.a.last(0.0) >= c.a.prev(0.0), [(1, 5.0, None)], True),
    ],
)
def test_micro_cases(spark, kind, body, rows, holds):
    q = kind(body, {"c": cars(spark, rows)}, end=1)
    assert q.truth(frame(spark, rows).select("cycle")).first()["holds"] is holds


def test_self_pairs_are_allowed_unless_excluded(spark):
    rows = [(1, 7.0, None)]
    o, cycles = cars(spark, rows), frame(spark, rows).select("cycle")
    assert exists(lambda a, b: a.a.last() == b.a.last(), {"a": o, "b": o}, end=1).truth(cycles).first()["holds"]
    assert not exists(lambda a, b: (a != b) & (a.a.last() == b.a.last()), {"a": o, "b": o}, end=1).truth(cycles).first()["holds"]


def test_always_fires_on_rows_without_signals(spark):
    found = verdicts.same_frame_rules(frame(spark, [(None, None, None)]), [("r", "info", F.lit(True), F.lit("m"))], "cycle", "ts", None)
    assert found.count() == 1


def test_a_pure_theta_body_warns(spark):
    o = cars(spark, [(1, 1.0, None)])
    with pytest.warns(UserWarning, match="all pairs"):
        exists(lambda a, b: a.a.last() < b.a.last(), {"a": o, "b": o}, end=1).intervals()


def trace(seed, n=60, ids=4):
    r = random.Random(seed)
    cell = lambda: None if r.random() < 0.4 else float(r.randrange(6))
    return [(None if r.random() < 0.1 else r.randrange(ids), cell(), cell()) for _ in range(n)]


def as_dicts(rows):
    return [{"uid": u, "a": a, "b": b} for u, a, b in rows]


@pytest.mark.parametrize("seed", range(4))
def test_temporal_access_equals_the_model(spark, seed):
    rows = trace(seed)
    o, m, want = cars(spark, rows), Model("uid", ["a", "b"]), {}
    for i, row in enumerate(as_dicts(rows)):
        m.cycle(row)
        if row["uid"] is not None:
            k = row["uid"]
            want[i] = (m.last(k, "a", -1.0), m.history(k, "a", 1), m.history(k, "a", 3, -2.0), tuple(m.objects[k]["b"][:3]))
    got = o.rows.select("cycle", o.last("a", -1.0).alias("l"), o.prev("a").alias("p"), o.history("a", -3, -2.0).alias("h"), o.retain("b", 2).alias("r")).collect()
    assert {r["cycle"]: (r["l"], r["p"], r["h"], tuple(r["r"])) for r in got} == want


@pytest.mark.parametrize("seed", range(4))
def test_quantifiers_equal_the_model(spark, seed):
    rows = trace(100 + seed)
    o, cycles, m = cars(spark, rows), frame(spark, rows).select("cycle"), Model("uid", ["a", "b"])
    want = []
    for row in as_dicts(rows):
        m.cycle(row)
        nz = lambda x: 0.0 if x is None else x
        one = m.exists(lambda k: nz(m.last(k, "a")) - nz(m.history(k, "a", 1)) > 1)
        every_ = m.forall(lambda k: nz(m.last(k, "b")) >= nz(m.history(k, "b", 2)))
        pair = m.pairs(lambda a, b: a != b and m.last(a, "a") is not None and m.last(a, "a") == m.last(b, "a"))
        triple = any(len({a, b, c}) == 3 and m.last(a, "a") is not None and m.last(a, "a") == m.last(b, "a") == m.last(c, "a") for a in m.objects for b in m.objects for c in m.objects)
        top = m.exists(lambda k: m.last(k, "a") is not None and all(x == k or m.last(x, "a") is None or m.last(x, "a") < m.last(k, "a") for x in m.objects))
        want.append((one, every_, len(pair), triple, top))
    args = {"end": len(rows)}
    one = exists(lambda c: c.a.last(0.0) - c.a.prev(0.0) > 1, {"c": o}, **args).truth(cycles)
    all_ = forall(lambda c: c.b.last(0.0) >= c.b.history(2, 0.0), {"c": o}, **args).truth(cycles)
    pair = exists(lambda a, b: (a != b) & (a.a.last() == b.a.last()), {"a": o, "b": o}, **args)
    triple = exists(lambda a, b, c: (a != b) & (b != c) & (a != c) & (a.a.last() == b.a.last()) & (b.a.last() == c.a.last()), {"a": o, "b": o, "c": o}, **args).truth(cycles)
    outer = exists(lambda a: a.a.last().isNotNull(), {"a": o}, **args).intervals()
    against = exists(lambda a, b: (a != b) & (b.a.last() >= a.a.last()), {"a": o, "b": o}, **args).intervals()
    top = quantify.sweep(quantify.inner(outer, against, ["a__uid"], some=False), cycles, "cycle")
    column = lambda df, c: [r[c] for r in df.orderBy("cycle").collect()]
    got = list(zip(column(one, "holds"), column(all_, "holds"), column(pair.counts(cycles), "n"), column(triple, "holds"), [n > 0 for n in column(top, "n")], strict=True))
    assert got == want
    assert pair.witnesses(cycles).count() == sum(w[2] for w in want)


def test_results_do_not_depend_on_partitions(spark):
    rows = trace(7, 200, 9)
    seen = set()
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        o = cars(spark, rows)
        q = exists(lambda a, b: (a.uid < b.uid) & (a.a.last() == b.a.last()), {"a": o, "b": o}, end=200)
        seen.add(tuple(r["n"] for r in q.counts(frame(spark, rows).select("cycle")).orderBy("cycle").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


@pytest.mark.parametrize("seed", range(3))
def test_global_order(spark, seed):
    rows = trace(seed, 80)
    df, bucket = frame(spark, rows), F.floor(F.col("cycle") / 7)
    got = ordering.global_rank(ordering.global_history(df, bucket, ["cycle"], "a", 2, "h"), bucket, ["cycle"], "n").orderBy("cycle").collect()
    past, want = [], []
    for _, a, _ in rows:
        want.append(past[1] if len(past) > 1 else None)
        past = past if a is None else [a, *past]
    assert [r["h"] for r in got] == want
    assert [r["n"] for r in got] == list(range(80))


@pytest.mark.parametrize("n", [1, 3])
def test_history_of_split_objects(spark, n):
    rows = trace(11, 120, 3)
    df = frame(spark, rows)
    got = temporal.split_history(df, "a", n, ["uid"], ["cycle"], F.floor(F.col("cycle") / 9), "h").collect()
    past, want = {}, {}
    for i, (u, a, _) in enumerate(rows):
        own = past.setdefault(u, [])
        want[i] = own[n - 1] if len(own) >= n else None
        if a is not None:
            own.insert(0, a)
    assert {r["cycle"]: r["h"] for r in got} == want


def test_ticks_see_events_of_their_own_time(spark):
    df = spark.createDataFrame([(0, 10, 1, 1.0), (1, 20, 1, 2.0), (2, 20, 2, 5.0), (3, 45, 1, 3.0)], "cycle bigint, t bigint, uid bigint, a double")
    o = objects(df, "uid", ["a", "t"], ["cycle"])
    got = activation.state_at(o, activation.ticks_of_objects(o, "t", 20, 45), "t", ["a"], {"a": 1})
    assert sorted((r["uid"], r["tick"], r["a"], r["a_1"]) for r in got.collect()) == [(1, 20, 2.0, 2.0), (1, 40, 2.0, 2.0), (2, 20, 5.0, 5.0), (2, 40, 5.0, 5.0)]
    local = activation.local_ticks(o, "t", 15, 45)
    assert sorted((r["uid"], r["tick"]) for r in local.collect()) == [(1, 25), (1, 40), (2, 35)]


def test_periods_and_gates():
    assert every("5Hz").step("ms") == 200 and every("0.2s").step("ms") == 200 and every("1d").step("us") == 86_400_000_000
    with pytest.raises(ValueError):
        every("3 parsecs")
    with pytest.raises(ValueError):
        every("3Hz").step("ms")


def test_gates_imply_reads(spark):
    fresh("a", "b").check({"a"})
    (fresh("a") | fresh("a", "b")).check({"a"})
    with pytest.raises(ValueError):
        (fresh("a") | fresh("b")).check({"a"})
    with pytest.raises(ValueError):
        rules.object_rule(cars(spark, [(1, 1.0, 1.0)]), "r", lambda me: me.a.last(0.0) > 0.0, "info", "m")


def test_else_needs_a_guard_that_is_not_null(spark):
    rows = [(1, 1.0, None), (1, None, None), (1, -1.0, None)]
    o = cars(spark, rows)
    got = rules.object_rule(o, "r", F.col("a") > 0, "alert", "yes", always(), otherwise=("info", "no"))
    assert [(r["cycle_id"], r["level"], r["value"]) for r in got.orderBy("cycle_id").collect()] == [(0, "alert", "yes"), (2, "info", "no")]


def test_objects_that_end_start_afresh(spark):
    rows = [(1, 1.0, None), (1, 0.0, None), (1, 2.0, None)]
    o = cars(spark, rows).ending(F.col("a") == 0)
    assert [(r["life"], r["p"]) for r in o.rows.select("cycle", "life", o.prev("a").alias("p")).orderBy("cycle").collect()] == [(0, None), (0, 1.0), (1, None)]


def test_messages_with_the_same_numbers_collapse(spark):
    df = spark.createDataFrame([(1, "(1, 2)"), (1, "(2, 1)"), (1, "(1, 12)"), (1, "text"), (1, "text"), (2, "(2, 1)")], "cycle bigint, value string")
    assert sorted(tuple(r) for r in quantify.dedup_messages(df, "digits", ["cycle"]).collect()) == [(1, "(1, 12)"), (1, "(1, 2)"), (1, "text"), (2, "(2, 1)")]


def test_classes_and_inheritance(spark):
    front = ObjectClass("Front", {"angle": "Float64"})
    back = ObjectClass("Back", {"speed": "Float64"}, base=front)
    car = ObjectClass("Car", {"uid": "Int64", "wheels": back})
    assert list(car.leaves()) == ["uid", "wheels.angle", "wheels.speed"]
    df = spark.createDataFrame([(1, (2.0, 3.0))], car.struct())
    assert flatten_signals(df).columns == ["uid", "wheels_angle", "wheels_speed"]
    with pytest.raises(ValueError):
        ObjectClass("Bad", {"angle": "Float64"}, base=front)
    with pytest.raises(ValueError):
        ObjectClass("Bad", {"angle": "Complex"})


def test_truth_intervals(spark):
    df = spark.createDataFrame([(i, i in (1, 2, 5)) for i in range(7)], "cycle bigint, holds boolean")
    got = quantify.episodes(df, "cycle", F.floor(F.col("cycle") / 3)).orderBy("lo").collect()
    assert [(r["lo"], r["hi"], r["cycles"]) for r in got] == [(1, 2, 2), (5, 5, 1)]


def test_verbosity_and_lines(spark):
    found = spark.createDataFrame([("r", "alert", "event", 1, None, [3, 4], "m"), ("s", "info", "event", 1, None, None, None)], "rule string, level string, cycle_kind string, cycle_id bigint, ts timestamp, key array<bigint>, value string")
    assert verdicts.at_most(found, "warnings").count() == 1 and verdicts.at_most(found, "silent").count() == 0 and verdicts.at_most(found, "debug").count() == 2
    assert verdicts.render(found.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))).where("rule = 'r'").first()["line"] == '@2024-01-01 00:00:00.000000 | alert | #r<3, 4> :: value = "m"'


def mortal_model(rows, body_of_pair):
    """Cycle by cycle: objects alive, those whose a is over 2, pairs with the same b; an object goes after a cycle that gives it a zero."""
    m, want = Model("uid", ["a", "b"]), []
    for row in as_dicts(rows):
        m.cycle(row)
        alive = sorted(m.objects)
        want.append((len(alive), sum(1 for k in alive if (m.last(k, "a") or 0) > 2), len(m.pairs(body_of_pair(m))), sum(1 for k in alive if (m.history(k, "b", 1) or 0) > 2)))
        if row["a"] == 0 and row["uid"] is not None:
            del m.objects[row["uid"]]
    return want


@pytest.mark.parametrize("seed", range(4))
def test_objects_that_end_equal_the_model(spark, seed):
    """Births, ends and births again: an object counts in the cycle of its end, and no more from the next one on."""
    rows = trace(200 + seed, 80, 5)
    o, cycles = cars(spark, rows).ending(F.col("a") == 0), frame(spark, rows).select("cycle")
    assert o.rows.where("life > 0").count() > 0
    want = mortal_model(rows, lambda m: lambda a, b: a != b and m.last(a, "b") is not None and m.last(a, "b") == m.last(b, "b"))
    args = {"end": len(rows)}
    column = lambda df, c: [r[c] for r in df.orderBy("cycle").collect()]
    high = exists(lambda c: c.a.last(0.0) > 2, {"c": o}, **args).counts(cycles)
    pair = exists(lambda a, b: (a != b) & (a.b.last() == b.b.last()), {"a": o, "b": o}, **args).counts(cycles)
    before = exists(lambda c: c.b.prev(0.0) > 2, {"c": o}, **args).counts(cycles)
    got = zip(column(active_at(o, cycles, "cycle", F.floor(F.col("cycle") / 7)), "n_active"), column(high, "n"), column(pair, "n"), column(before, "n"), strict=True)
    assert list(got) == want
    assert column(exists(lambda c: F.lit(True), {"c": o}, **args).counts(cycles), "n") == [w[0] for w in want]
    assert {r["uid"] for r in o.snapshot().collect()} == {u for u, life in alive_after(rows)}


def alive_after(rows):
    lives, alive = {}, {}
    for u, a, _ in rows:
        if u is not None:
            alive[u] = lives.setdefault(u, 0)
            if a == 0:
                lives[u] += 1
                del alive[u]
    return set(alive.items())


def test_ticks_of_objects_that_end(spark):
    """A row comes before a tick of its time: an object that ends there does not tick, one that starts there does."""
    df = spark.createDataFrame([(0, 10, 1, 1.0), (1, 40, 1, 0.0), (2, 40, 1, 5.0), (3, 70, 1, 0.0), (4, 80, 2, 1.0)], "cycle bigint, t bigint, uid bigint, a double")
    o = objects(df, "uid", ["a", "t"], ["cycle"]).ending(F.col("a") == 0)
    ticks = activation.ticks_of_objects(o, "t", 20, 100)
    assert sorted(tuple(r) for r in ticks.select("tick", "uid", "life").collect()) == [(20, 1, 0), (40, 1, 1), (60, 1, 1), (80, 2, 0), (100, 2, 0)]
    assert sorted(tuple(r) for r in activation.state_at(o, ticks, "t", ["a"]).select("tick", "a").collect()) == [(20, 1.0), (40, 5.0), (60, 5.0), (80, 1.0), (100, 1.0)]
    asked = spark.createDataFrame([(1, 0, 30), (1, 0, 40), (1, 1, 40), (1, 1, 90)], "uid bigint, life bigint, tick bigint")
    assert sorted(tuple(r) for r in activation.state_at(o, asked, "t", ["a"]).select("life", "tick", "a").collect()) == [(0, 30, 1.0), (1, 40, 5.0)]
    assert sorted(tuple(r) for r in activation.local_ticks(o, "t", 15, 100).select("tick", "life").collect()) == [(25, 0), (55, 1), (95, 0)]
    points = spark.createDataFrame([(t,) for t in (20, 40, 60, 70, 80)], "t bigint")
    assert [r["n_active"] for r in active_at(o, points, "t", F.floor(F.col("t") / 50), ticks=True).orderBy("t").collect()] == [1, 1, 1, 0, 1]


@pytest.mark.parametrize("seed", range(3))
def test_rules_together_equal_each_by_itself(spark, seed):
    rows = trace(300 + seed, 70, 1 if seed == 2 else 5)
    o, cycles = cars(spark, rows), frame(spark, rows).select("cycle")
    pair, args = {"a": o, "b": o}, {"end": len(rows)}
    rules_ = {
        "near": exists(lambda a, b: a.uid < b.uid, pair, near=Near("a", "b", "a", 1.0), **args),
        "nearer": exists(lambda a, b: (a != b) & (a.b.prev(0.0) > 1), pair, near=Near("a", "b", "a", 0.5), **args),
        "all": forall(lambda a, b: a.b.last(0.0) >= 1, pair, near=Near("a", "b", "a", 2.0), **args),
    }
    column = lambda df, c: [r[c] for r in df.orderBy("cycle").collect()]
    for chosen in (rules_, {k: replace(q, near=None, given=lambda a, b: a.a.last() == b.a.last()) for k, q in rules_.items()}, {"near": rules_["near"]}):
        got = quantify.together(chosen, cycles)
        for name, q in chosen.items():
            assert column(got, name) == column(q.truth(cycles), "holds")
    with pytest.raises(ValueError, match="different"):
        quantify.together({**rules_, "other": exists(lambda a, b: a != b, {"a": o, "b": cars(spark, rows)}, **args)}, cycles)


def test_no_pair_join_is_broadcast(spark, sf_dir):
    """A side with its cells is many times what Spark thinks it is."""
    from objwatch.plans import catalog

    for name in ("exists_pair_equi", "exists_pair_band", "pair_distance", "quantify_n", "pair_over_ended", "binding_witnesses"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "v__" not in "".join(x for x in plan.splitlines() if "BroadcastHashJoin" in x) and not any("_ga" in x or "_point" in x for x in plan.splitlines() if "BroadcastHashJoin" in x), name


@pytest.mark.parametrize("most", [1, 2])
def test_crowded_grids_lose_no_overlap(spark, most):
    r = random.Random(most)
    sides = [[(i, lo, lo + r.choice([1, 7, 9, 64, 65, 500])) for i in range(60) for lo in [r.randrange(600)]] for _ in range(2)]
    end = max(hi for side in sides for _, _, hi in side)
    left, right = (spark.createDataFrame(rows, f"{x} long, {x}lo long, {x}hi long") for rows, x in zip(sides, "ab", strict=True))
    got = quantify.joined_overlaps(left, right, ("alo", "ahi"), ("blo", "bhi"), end, most=most).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, lo, hi in sides[0] for k, low, high in sides[1] if lo < high and low < hi)
