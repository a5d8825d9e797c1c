"""Queries over one object at a time: schema, temporal access, activation, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from objwatch.functions import scalar
from objwatch.operators import activation, rules, temporal
from objwatch.operators.activation import always, every, fresh
from objwatch.operators.objects import active_at, objects
from objwatch.operators.schema import flatten_signals
from objwatch.plans.catalog import query
from objwatch.plans.tables import BY_USER, DAY, SPAN, ZERO, E, end_cycle, read, trace, users

HELD = f"last_value({{}} IGNORE NULLS) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LAG = f"lag({{}}, {{}} IGNORE NULLS) OVER ({BY_USER})"


# ---- schema and objects


@query("flatten_nested", "SELECT event_id AS cycle, user_id AS car_uid, value AS car_motion_speed, event_id * 2 AS car_motion_place_x FROM events")
def flatten_nested(spark, sf):
    t = trace(spark, sf)
    place = F.struct((F.col("cycle") * 2).alias("x"))
    return flatten_signals(t.select("cycle", F.struct(F.col("user_id").alias("uid"), F.struct(F.col("value").alias("speed"), place.alias("place")).alias("motion")).alias("car")))


@query("object_streams", f"WITH {E} SELECT user_id, cycle, purchase FROM e WHERE user_id IS NOT NULL AND purchase IS NOT NULL")
def object_streams(spark, sf):
    o = users(spark, sf, "purchase")
    return o.rows.where(o.fresh("purchase")).select("user_id", "cycle", "purchase")


@query("multi_class_row", f"WITH {E} SELECT 'buyer' AS class, user_id AS uid, count(*) AS n FROM e WHERE event_type IN ('purchase', 'click') GROUP BY user_id UNION ALL SELECT 'page', cast(json_extract(props, '$.k') AS BIGINT), count(*) FROM e WHERE event_type IN ('view', 'click') GROUP BY 2")
def multi_class_row(spark, sf):
    t = trace(spark, sf)
    t = t.withColumn("buyer_uid", F.when(F.col("event_type").isin("purchase", "click"), F.col("user_id"))).withColumn("page_uid", F.when(F.col("event_type").isin("view", "click"), F.get_json_object("props", "$.k").cast("bigint")))
    each = [objects(t, f"{c}_uid", [], ["cycle"]).rows.groupBy(F.lit(c).alias("class"), F.col(f"{c}_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n")) for c in ("buyer", "page")]
    return each[0].unionByName(each[1])


@query("active_objects", f"WITH {E}, s AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id), k AS (SELECT unnest(range({ZERO} + {DAY}, (SELECT max(us) FROM e) + 1, {DAY})) AS tick) SELECT tick, (SELECT count(*) FROM s WHERE s.us <= k.tick) AS n_active FROM k")
def active_objects(spark, sf):
    o = users(spark, sf, "value")
    ticks = activation.global_ticks(trace(spark, sf), "us", every("1d").step(), ZERO)
    return active_at(o, ticks.withColumnRenamed("tick", "us"), "us", F.floor(F.col("us") / DAY)).withColumnRenamed("us", "tick")


@query("activation_events", f"WITH {E} SELECT user_id, min(cycle) AS cycle FROM e GROUP BY user_id")
def activation_events(spark, sf):
    return users(spark, sf, "value").activations().select("user_id", "cycle")


@query("deactivation", f"WITH {E}, l AS (SELECT *, coalesce(sum(CASE WHEN error > 100 THEN 1 ELSE 0 END) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM e) SELECT user_id, life, min(cycle) AS first_cycle, max(cycle) AS last_cycle, count(*) AS n, bool_or(coalesce(error > 100, false)) AS ended FROM l GROUP BY user_id, life")
def deactivation(spark, sf):
    o = users(spark, sf, "error").ending(F.col("error") > 100)
    return o.rows.groupBy(*o.keys).agg(F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"), F.count(F.lit(1)).alias("n"), F.bool_or("ends").alias("ended"))


@query("instance_snapshot", f"WITH {E} SELECT user_id, arg_max(click, cycle) FILTER (WHERE click IS NOT NULL) AS click, arg_max(error, cycle) FILTER (WHERE error IS NOT NULL) AS error FROM e GROUP BY user_id")
def instance_snapshot(spark, sf):
    return users(spark, sf, "click", "error").snapshot().select("user_id", "click", "error")


# ---- temporal access


@query("current", f"WITH {E} SELECT cycle, user_id, click FROM e WHERE click IS NOT NULL")
def current(spark, sf):
    o = users(spark, sf, "click")
    return o.rows.where(o.fresh("click")).select("cycle", "user_id", o.current("click").alias("click"))


@query("hold", f"WITH {E} SELECT cycle, user_id, coalesce({HELD.format('click')}, -1) AS held FROM e")
def hold(spark, sf):
    o = users(spark, sf, "click")
    return o.rows.select("cycle", "user_id", o.last("click", -1.0).alias("held"))


@query("prev", f"WITH {E} SELECT cycle, user_id, {LAG.format('click', 1)} AS prev FROM e")
def prev(spark, sf):
    o = users(spark, sf, "click")
    return o.rows.select("cycle", "user_id", o.prev("click").alias("prev"))


@query("history", f"WITH {E} SELECT cycle, user_id, click AS h0, {LAG.format('click', 2)} AS h2, coalesce({LAG.format('click', 5)}, 0) AS h5 FROM e")
def history(spark, sf):
    o = users(spark, sf, "click")
    return o.rows.select("cycle", "user_id", o.history("click", 0).alias("h0"), o.history("click", -2).alias("h2"), o.history("click", -5, 0.0).alias("h5"))


@query("default", f"WITH {E} SELECT cycle, coalesce(view, 0) AS seen FROM e")
def default(spark, sf):
    return trace(spark, sf).select("cycle", temporal.default(F.col("view"), 0.0).alias("seen"))


@query("fresh", f"WITH {E} SELECT cycle, view IS NOT NULL AS is_fresh FROM e")
def fresh_signal(spark, sf):
    return trace(spark, sf).select("cycle", temporal.fresh("view").alias("is_fresh"))


@query("get", f"WITH {E} SELECT cycle, signup AS got FROM e")
def get(spark, sf):
    return trace(spark, sf).select("cycle", temporal.get("signup").alias("got"))


@query("class_scope_history", f"WITH {E} SELECT cycle, lag(click, 1 IGNORE NULLS) OVER (ORDER BY cycle) AS prev_any, lag(click, 3 IGNORE NULLS) OVER (ORDER BY cycle) AS third_any FROM e")
def class_scope_history(spark, sf):
    rows = trace(spark, sf).select("cycle", "click")
    bucket = F.floor(F.col("cycle") / SPAN)
    first = temporal.class_history(rows, "click", 1, ["cycle"], bucket, "prev_any")
    return temporal.class_history(first, "click", 3, ["cycle"], bucket, "third_any").drop("click")


@query("split_history", f"WITH {E} SELECT cycle, user_id, {LAG.format('click', 2)} AS h2 FROM e")
def split_history(spark, sf):
    rows = trace(spark, sf).select("cycle", "user_id", "click")
    return temporal.split_history(rows, "click", 2, ["user_id"], ["cycle"], F.floor(F.col("cycle") / SPAN), "h2").drop("click")


@query("bounded_history", f"WITH {E}, p AS (SELECT user_id, cycle, purchase, count(purchase) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT a.user_id, a.cycle, coalesce(list(b.purchase ORDER BY b.k DESC) FILTER (WHERE b.purchase IS NOT NULL), [])::VARCHAR AS kept FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND b.purchase IS NOT NULL AND b.k BETWEEN a.k - 2 AND a.k AND b.cycle <= a.cycle GROUP BY 1, 2")
def bounded_history(spark, sf):
    o = users(spark, sf, "purchase")
    return o.rows.select("user_id", "cycle", F.concat(F.lit("["), F.array_join(o.retain("purchase", 2), ", "), F.lit("]")).alias("kept"))


@query("versions", f"""WITH {E}, v AS (SELECT user_id, cycle, click, lead(cycle) OVER ({BY_USER}) AS nxt, {LAG.format('click', 1)} AS before, {HELD.format('click')} AS held FROM e)
SELECT user_id, cycle AS lo, cycle + 1 AS hi, true AS is_fresh, held AS click, before AS click_1 FROM v UNION ALL SELECT user_id, cycle + 1, nxt, false, held, held FROM v WHERE nxt IS NULL OR nxt > cycle + 1""")
def versions(spark, sf):
    return users(spark, sf, "click").versions(["click"], {"click": 1}, "cycle").drop("click_now")


# ---- activation


@query("gate_always", f"WITH {E} SELECT 'r' AS rule, 'info' AS level, 'event' AS cycle_kind, cycle AS cycle_id, ts, user_id::VARCHAR AS key, 'on' AS value FROM e")
def gate_always(spark, sf):
    return rules.object_rule(users(spark, sf), "r", F.lit(True), "info", "on", always())


@query("gate_conjunction", f"WITH {E} SELECT 'r' AS rule, 'info' AS level, 'event' AS cycle_kind, cycle AS cycle_id, ts, user_id::VARCHAR AS key, 'both' AS value FROM e WHERE click IS NOT NULL AND value IS NOT NULL AND click < 50")
def gate_conjunction(spark, sf):
    return rules.object_rule(users(spark, sf), "r", F.col("click") < 50, "info", "both", fresh("click") & fresh("value"))


@query("gate_boolean", f"WITH {E} SELECT 'r' AS rule, 'alert' AS level, 'event' AS cycle_kind, cycle AS cycle_id, ts, user_id::VARCHAR AS key, 'any' AS value FROM e WHERE (click IS NOT NULL OR view IS NOT NULL) AND value IS NOT NULL")
def gate_boolean(spark, sf):
    return rules.object_rule(users(spark, sf), "r", F.lit(True), "alert", "any", (fresh("click") | fresh("view")) & fresh("value"))


@query("gate_inferred", f"WITH {E} SELECT 'r' AS rule, 'alert' AS level, 'event' AS cycle_kind, cycle AS cycle_id, ts, user_id::VARCHAR AS key, 'up' AS value FROM (SELECT *, {HELD.format('view')} AS seen FROM e) WHERE click IS NOT NULL AND click > coalesce(seen, 0)")
def gate_inferred(spark, sf):
    return rules.object_rule(users(spark, sf), "r", lambda me: me.click.now > me.view.last(0.0), "alert", "up")


TICKS = f"k AS (SELECT unnest(range({ZERO} + {DAY}, (SELECT max(us) FROM e) + 1, {DAY})) AS tick)"
AS_OF = "SELECT u.user_id, k.tick, (SELECT arg_max(x.{0}, x.cycle) FROM e x WHERE x.user_id = u.user_id AND x.us <= k.tick AND x.{0} IS NOT NULL) AS {0} FROM (SELECT user_id, min(us) AS start FROM e GROUP BY user_id) u JOIN k ON k.tick >= u.start"


@query("tick_global", f"WITH {E}, {TICKS} {AS_OF.format('click')}")
def tick_global(spark, sf):
    o = users(spark, sf, "click")
    end = end_cycle(trace(spark, sf), "us") - 1
    return activation.state_at(o, activation.ticks_of_objects(o, "us", every("1d").step(), end, ZERO), "us", ["click"])


@query("tick_local", f"WITH {E}, u AS (SELECT user_id, min(us) AS start FROM e GROUP BY user_id), k AS (SELECT user_id, unnest(range(start + {5 * DAY}, (SELECT max(us) FROM e) + 1, {5 * DAY})) AS tick FROM u) SELECT k.user_id, k.tick, (SELECT arg_max(x.value, x.cycle) FROM e x WHERE x.user_id = k.user_id AND x.us <= k.tick) AS value FROM k")
def tick_local(spark, sf):
    o = users(spark, sf, "value")
    end = end_cycle(trace(spark, sf), "us") - 1
    return activation.state_at(o, activation.local_ticks(o, "us", every("5d", per="object").step(), end), "us", ["value"])


@query("tick_multi_rate", f"WITH {E}, m AS (SELECT max(us) + 1 AS z FROM e), t AS (SELECT unnest(range({ZERO} + {2 * DAY}, z, {2 * DAY})) AS tick, 'a' AS c FROM m UNION ALL SELECT unnest(range({ZERO} + {3 * DAY}, z, {3 * DAY})), 'b' FROM m) SELECT tick, string_agg(c, '+' ORDER BY c) AS clocks FROM t GROUP BY tick")
def tick_multi_rate(spark, sf):
    t = trace(spark, sf)
    both = activation.merged_ticks({"a": activation.global_ticks(t, "us", every("2d").step(), ZERO), "b": activation.global_ticks(t, "us", every("3d").step(), ZERO)})
    return both.select("tick", F.array_join("clocks", "+").alias("clocks"))


@query("clock_advance", f"WITH {E} SELECT unnest(range({ZERO} + {7 * DAY}, greatest((SELECT max(us) FROM e), {ZERO + 60 * DAY}) + 1, {7 * DAY})) AS tick")
def clock_advance(spark, sf):
    return activation.global_ticks(trace(spark, sf), "us", every("1w").step(), ZERO, until=ZERO + 60 * DAY)


# ---- rules over one object


@query("class_rule", f"WITH {E} SELECT 'big' AS rule, 'alert' AS level, 'event' AS cycle_kind, cycle AS cycle_id, ts, user_id::VARCHAR AS key, 'big purchase of ' || user_id AS value FROM e WHERE purchase > 200")
def class_rule(spark, sf):
    return rules.object_rule(users(spark, sf), "big", lambda me: me.purchase.now > 200.0, "alert", scalar.message("big purchase of {u}", u=F.col("user_id")))


@query("class_rule_diff", f"WITH {E} SELECT 'jump' AS rule, 'violation' AS level, 'event' AS cycle_kind, cycle AS cycle_id, ts, user_id::VARCHAR AS key, 'jump of ' || user_id AS value FROM (SELECT *, {HELD.format('value')} AS now_, {LAG.format('value', 1)} AS then_ FROM e) WHERE abs(now_ - then_) > 150")
def class_rule_diff(spark, sf):
    return rules.object_rule(users(spark, sf, "value"), "jump", lambda me: abs(me.value.last() - me.value.prev()) > 150.0, "violation", scalar.message("jump of {u}", u=F.col("user_id")))


@query("let_stream", f"WITH {E}, l AS (SELECT *, CASE WHEN click IS NOT NULL THEN click * 2 END AS twice FROM e) SELECT cycle, user_id, twice, {LAG.format('twice', 1)} AS before FROM l")
def let_stream(spark, sf):
    o = users(spark, sf, "click").let("twice", F.col("click") * 2, F.col("click").isNotNull())
    return o.rows.select("cycle", "user_id", "twice", o.prev("twice").alias("before"))


@query("let_world", f"WITH {E} SELECT cycle, coalesce(click, 0) + coalesce(view, 0) AS traffic FROM e")
def let_world(spark, sf):
    return trace(spark, sf).select("cycle", (F.coalesce("click", F.lit(0.0)) + F.coalesce("view", F.lit(0.0))).alias("traffic"))


@query("else_rule", f"WITH {E} SELECT 'size' AS rule, CASE WHEN purchase > 100 THEN 'alert' ELSE 'info' END AS level, 'event' AS cycle_kind, cycle AS cycle_id, ts, user_id::VARCHAR AS key, CASE WHEN purchase > 100 THEN 'big' ELSE 'small' END AS value FROM e WHERE purchase IS NOT NULL")
def else_rule(spark, sf):
    return rules.object_rule(users(spark, sf), "size", lambda me: me.purchase.now > 100.0, "alert", "big", otherwise=("info", "small"))


@query("first_match", f"WITH {E} SELECT cycle, CASE WHEN value > 200 THEN 'huge' WHEN value > 100 THEN 'big' WHEN value > 50 THEN event_type END AS size FROM e")
def first_match(spark, sf):
    v = F.col("value")
    return trace(spark, sf).select("cycle", rules.first_match([(v > 200, "huge"), (v > 100, "big"), (v > 50, F.col("event_type"))]).alias("size"))


@query("clause_gate", f"WITH {E} SELECT cycle, CASE WHEN value > 100 AND click IS NOT NULL THEN 'click' WHEN value > 100 AND view IS NOT NULL THEN 'view' WHEN value > 50 THEN 'other' END AS seen FROM e")
def clause_gate(spark, sf):
    v = F.col("value")
    return trace(spark, sf).select("cycle", rules.first_match([(v > 100, "click", fresh("click")), (v > 100, "view", fresh("view")), (v > 50, "other")]).alias("seen"))


@query("self_identity_guard", f"WITH {E} SELECT cycle AS cycle_id, user_id AS uid FROM e WHERE signup > 90")
def self_identity_guard(spark, sf):
    found = rules.object_rule(users(spark, sf), "own", lambda me: me.signup.now > 90.0, "info", "own")
    return found.select("cycle_id", F.element_at("key", 1).alias("uid"))


LIMITS = (40.0, 60.0)


@query("constants", f"WITH {E} SELECT cycle, value BETWEEN 40 AND 60 AS inside FROM e")
def constants(spark, sf):
    limits = scalar.tuple_make(*[F.lit(x) for x in LIMITS])
    return trace(spark, sf).select("cycle", F.col("value").between(scalar.tuple_get(limits, 0), scalar.tuple_get(limits, 1)).alias("inside"))


@query("tuple_make", f"WITH {E} SELECT cycle, '(' || user_id || ', ' || event_type || ')' AS pair FROM e")
def tuple_make(spark, sf):
    return trace(spark, sf).select("cycle", scalar.tuple_text(F.col("user_id"), F.col("event_type")).alias("pair"))


@query("tuple_get", f"WITH {E} SELECT cycle, event_type AS second FROM e")
def tuple_get(spark, sf):
    pair = scalar.tuple_make(F.col("user_id"), F.col("event_type"))
    return trace(spark, sf).select("cycle", scalar.tuple_get(pair, 1).alias("second"))


@query("if_else", f"WITH {E} SELECT cycle, CASE WHEN click IS NOT NULL THEN 1 ELSE 0 END AS is_click FROM e")
def if_else(spark, sf):
    return trace(spark, sf).select("cycle", F.when(F.col("click").isNotNull(), 1).otherwise(0).alias("is_click"))


@query("long_history", "SELECT l_suppkey, l_orderkey, l_linenumber, lag(l_quantity, 2 IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS second_last FROM lineitem")
def long_history(spark, sf):
    o = objects(read(spark, sf, "lineitem"), "l_suppkey", ["l_quantity"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return o.rows.select("l_suppkey", "l_orderkey", "l_linenumber", o.history("l_quantity", 2).alias("second_last"))
