"""Queries over verdicts and their forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from objwatch.functions import scalar
from objwatch.operators import rules, verdicts
from objwatch.plans.catalog import query
from objwatch.plans.tables import BY_USER, E, users


def _found(spark, sf):
    o = users(spark, sf)
    big = rules.object_rule(o, "big", lambda me: me.purchase.now > 100.0, "alert", scalar.message("big {u}", u=F.col("user_id")))
    bad = rules.object_rule(o, "bad", lambda me: me.error.now > 150.0, "violation", "bad")
    seen = rules.object_rule(o, "seen", lambda me: me.view.now > 50.0, "info", "seen")
    return verdicts.evaluate(big, bad, seen)


V = f"""{E}, v AS (SELECT 'big' AS rule, 'alert' AS level, 'event' AS cycle_kind, cycle AS cycle_id, ts, user_id AS uid, 'big ' || user_id AS value FROM e WHERE purchase > 100
UNION ALL SELECT 'bad', 'violation', 'event', cycle, ts, user_id, 'bad' FROM e WHERE error > 150
UNION ALL SELECT 'seen', 'info', 'event', cycle, ts, user_id, 'seen' FROM e WHERE view > 50)"""


@query("evaluate", f"WITH {V} SELECT rule, level, cycle_kind, cycle_id, ts, uid::VARCHAR AS key, value FROM v")
def evaluate(spark, sf):
    return _found(spark, sf)


@query("evaluate_same_frame", f"WITH {V} SELECT rule, level, cycle_kind, cycle_id, ts, uid::VARCHAR AS key, value FROM v WHERE rule <> 'big'")
def evaluate_same_frame(spark, sf):
    o = users(spark, sf)
    return verdicts.same_frame_rules(o.rows, [("bad", "violation", F.col("error") > 150, F.lit("bad")), ("seen", "info", F.col("view") > 50, F.lit("seen"))], "cycle", "ts", "user_id")


D = f"""{E}, d AS (SELECT min(cycle) AS cycle_id, 'activate' AS change, 'object' AS stream, user_id AS uid, NULL AS value FROM e GROUP BY user_id
UNION ALL SELECT cycle, 'update', 'level', user_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END FROM e)"""


def _levels(spark, sf):
    return users(spark, sf).let("level", F.when(F.col("value") > 50, "high").otherwise("low"))


@query("out_delta", f"WITH {D} SELECT cycle_id, change, stream, uid AS key, value FROM d")
def out_delta(spark, sf):
    return verdicts.delta(_levels(spark, sf), "cycle", ["level"])


@query("out_full_delta", f"WITH {D} SELECT cycle_id, change, stream, uid AS key, value FROM d UNION ALL SELECT cycle, 'input', 'event_type', user_id, event_type FROM e UNION ALL SELECT cycle, 'fired', 'big', user_id, 'big' FROM e WHERE purchase > 100")
def out_full_delta(spark, sf):
    o = users(spark, sf, "value", "purchase", "event_type").let("level", F.when(F.col("value") > 50, "high").otherwise("low"))
    found = rules.object_rule(o, "big", lambda me: me.purchase.now > 100.0, "alert", "big")
    return verdicts.full_delta(o, "cycle", ["level"], ["event_type"], found)


@query("out_snapshot", f"WITH {E} SELECT cycle AS cycle_id, user_id, last_value(click IGNORE NULLS) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS click, last_value(error IGNORE NULLS) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS error FROM e")
def out_snapshot(spark, sf):
    return verdicts.snapshots(users(spark, sf, "click", "error"), "cycle").select("cycle_id", "user_id", "click", "error")


@query("out_alarms", f"WITH {V} SELECT cycle_id, rule, level, uid::VARCHAR AS key, value FROM v")
def out_alarms(spark, sf):
    return verdicts.alarms(_found(spark, sf))


@query("filter_verbosity", f"WITH {V} SELECT rule, level, cycle_id FROM v WHERE level IN ('violation', 'alert')")
def filter_verbosity(spark, sf):
    return verdicts.at_most(_found(spark, sf), "warnings").select("rule", "level", "cycle_id")


@query("render_log", f"""WITH {V} SELECT cycle_id, rule, '@' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' | ' || level || ' | #' || rule || '<' || uid || '> :: value = "' || value || '"' AS line FROM v""")
def render_log(spark, sf):
    return verdicts.render(_found(spark, sf))


@query("typed_record", f"WITH {V} SELECT cycle_id, string_agg(CASE WHEN rule = 'big' THEN uid || '=' || value END, ',' ORDER BY uid) AS big, string_agg(CASE WHEN rule = 'bad' THEN uid || '=' || value END, ',' ORDER BY uid) AS bad FROM v WHERE rule IN ('big', 'bad') GROUP BY cycle_id")
def typed_record(spark, sf):
    text = lambda c: F.nullif(F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"])), ","), F.lit("")).alias(c)
    return verdicts.to_records(_found(spark, sf), ["big", "bad"]).select("cycle_id", text("big"), text("bad"))


@query("rule_hits", f"WITH {V} SELECT rule, level, count(*) AS hits, count(DISTINCT cycle_id) AS cycles, min(cycle_id) AS first_cycle, max(cycle_id) AS last_cycle FROM v GROUP BY rule, level")
def rule_hits(spark, sf):
    return verdicts.rule_stats(_found(spark, sf))
