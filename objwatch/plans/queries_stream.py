"""Queries on Structured Streaming: the events are written to the shared folder and read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from objwatch.plans.catalog import query
from objwatch.plans.queries_source import scratch
from objwatch.plans.tables import BY_USER, DAY, ZERO, E, trace
from objwatch.sources.trace import live_source
from objwatch.streaming import lives, monitor, world
from objwatch.streaming.lives import Clock, Let, Objects

HOUR = 3_600_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows that the watermark, in whole milliseconds and an hour behind the last row, has passed.
PASSED = f"us < (SELECT max(us) // 1000 * 1000 - {HOUR} FROM e)"


class _Parts:
    """The trace as a stream; parts are conditions on the rows that arrive together, in order of arrival. A part has as many files as Spark makes.

    more: columns that are put in place of those of the trace.
    """

    def __init__(self, spark, sf, *parts, more=None):
        self.spark, self.rows = spark, trace(spark, sf).withColumns(more or {}).select("cycle", F.col("ts").cast("timestamp").alias("ts"), "us", "user_id", "event_type", "value", "purchase", "error")
        self.path, self.parts = scratch(spark, "events"), parts or ("true",)
        self.rows.limit(0).write.parquet(self.path)
        self.stream = live_source(spark, "parquet", self.rows.schema, path=self.path)

    def run(self, writer, close=False):
        """Write each part and run the stream over it, always on the writer's checkpoint; all files of a part are one batch. The progress of all batches.

        close: at last, a row of no object, far behind all others, brings the watermark past them.
        """
        progress = []

        def drain():
            given = self.spark.conf.get(PARTITIONS)
            self.spark.conf.set(PARTITIONS, min(int(given), lives.STORES))
            try:  # the stream keeps what is set as it starts
                running = writer.trigger(availableNow=True).start()
            finally:
                self.spark.conf.set(PARTITIONS, given)
            running.awaitTermination()
            progress.extend(running.recentProgress)

        for part in self.parts:
            self.rows.where(part).repartitionByRange("us").sortWithinPartitions(F.xxhash64("cycle")).write.mode("append").parquet(self.path)
            drain()
        if close:
            end = F.coalesce(F.max("ts"), F.lit("2000-01-01").cast("timestamp")) + F.expr("INTERVAL 1000 DAYS")
            self.rows.agg(end.alias("ts")).select(*[F.col("ts") if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in self.rows.dtypes]).write.mode("append").parquet(self.path)
            drain()
        return progress


def _result(spark, parts, frame, name):
    """Run a stream to its end and read what it wrote."""
    sink, checkpoint = scratch(spark, name), scratch(spark, f"{name}-log")
    parts.run(frame.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint))
    return spark.read.schema(frame.schema).parquet(sink)


def _batches(spark, parts, run):
    parts.run(parts.stream.writeStream.foreachBatch(run).option("checkpointLocation", scratch(spark, "batches-log")))


def _objects(spark, sf, depth=1, **more):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    parts = _Parts(spark, sf)
    states = monitor.object_stream(parts.stream, "user_id", "ts", "cycle", "value", "1 hour", depth, **more)
    return _result(spark, parts, states, "states")


#: How far values jump, but for views, and whether a jump is higher than the one before.
LEVELS = Objects(
    {"value": "double", "event_type": "string", "error": "double", "number": "bigint"},
    (
        Let("jump", "double", lambda f: f.now("value") - f.prev("value"), lambda f: f.now("event_type") != "view"),
        Let("level", "string", lambda f: ["high" if up else "low" for up in (f.last("jump") > f.prev("jump")).fillna(False)], lambda f: f.fresh("jump")),
    ),
    {"jump": 2, "event_type": 2},
    ends=lambda f: f.now("error") > 100,
)


def _whole(spark, sf, spec, make=lambda states: states):
    """What make() makes of the users' states; rows arrive shuffled."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    parts = _Parts(spark, sf)
    states = lives.life_stream(parts.stream.withColumn("number", F.col("cycle") * 3), "user_id", "ts", "cycle", spec, "1 hour")
    return _result(spark, parts, make(states), "whole")


#: The same with lives, jumps and levels in SQL: a let is a column, whose history counts its own updates.
LV = f"""{E}, p AS (SELECT *, coalesce(sum(CASE WHEN error > 100 THEN 1 ELSE 0 END) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life, coalesce(error > 100, false) AS ends FROM e WHERE {PASSED}),
j AS (SELECT *, CASE WHEN event_type <> 'view' THEN value - lag(value) OVER (PARTITION BY user_id, life ORDER BY cycle) END AS jump FROM p),
k AS (SELECT *, lag(jump, 1 IGNORE NULLS) OVER w AS jump_1, lag(jump, 2 IGNORE NULLS) OVER w AS jump_2, last_value(jump IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS jump_last, lag(event_type, 2) OVER w AS type_2, row_number() OVER w = 1 AS starts FROM j WINDOW w AS (PARTITION BY user_id, life ORDER BY cycle)),
l AS (SELECT *, CASE WHEN jump IS NOT NULL THEN CASE WHEN coalesce(jump > jump_1, false) THEN 'high' ELSE 'low' END END AS level FROM k)"""


@query("stream_state_whole", f"WITH {LV} SELECT cycle, user_id, value AS last, event_type AS kind, type_2, error, cycle * 3 AS number, jump, jump_last, jump_1, jump_2, level, lag(level, 1 IGNORE NULLS) OVER (PARTITION BY user_id, life ORDER BY cycle) AS level_1, starts, ends FROM l")
def stream_state_whole(spark, sf):
    """Signals of three types, derived ones with a gate and a history of their own, of objects that end."""
    found = _whole(spark, sf, LEVELS).where("kind = 'event'")
    return found.select(F.col("order").alias("cycle"), F.col("key").alias("user_id"), F.col("value_last").alias("last"), F.col("event_type").alias("kind"), F.col("event_type_2").alias("type_2"), "error", F.col("number_last").alias("number"), "jump", "jump_last", "jump_1", "jump_2", "level", "level_1", "starts", "ends")


DELTA = "SELECT cycle AS cycle_id, 'activate' AS change, 'object' AS stream, user_id AS key, NULL AS value FROM l WHERE starts UNION ALL SELECT cycle, 'deactivate', 'object', user_id, NULL FROM l WHERE ends UNION ALL SELECT cycle, 'update', 'level', user_id, level FROM l WHERE level IS NOT NULL"


@query("stream_delta", f"WITH {LV} {DELTA}")
def stream_delta(spark, sf):
    """What each cycle changes, as the stream goes on."""
    return _whole(spark, sf, LEVELS, lambda states: lives.stream_delta(states, ["level"]))


@query("stream_full_delta", f"WITH {LV} {DELTA} UNION ALL SELECT cycle, 'input', 'event_type', user_id, event_type FROM l UNION ALL SELECT cycle, 'fired', 'rise', user_id, level FROM l WHERE jump_last > 200 AND jump_1 < 0")
def stream_full_delta(spark, sf):
    rise = ("rise", (F.col("jump_last") > 200) & (F.col("jump_1") < 0), F.col("level"))
    return _whole(spark, sf, LEVELS, lambda states: lives.stream_full_delta(states, ["level"], ["event_type"], [rise]))


@query("stream_snapshots", f"WITH {LV} SELECT cycle AS cycle_id, user_id AS key, value, last_value(error IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS error, jump_last AS jump, last_value(level IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS level FROM l WINDOW w AS (PARTITION BY user_id, life ORDER BY cycle)")
def stream_snapshots(spark, sf):
    return _whole(spark, sf, LEVELS, lambda states: lives.stream_snapshots(states, ["value", "error", "jump", "level"]))


TICKS = f"WITH {E}, p AS (SELECT * FROM e WHERE {PASSED}), u AS (SELECT user_id, min(us) AS start FROM p GROUP BY user_id), m AS (SELECT max(us) // 1000 * 1000 - {HOUR} AS mark FROM e), k AS (SELECT 'own' AS clock, user_id, unnest(range(start + {5 * DAY}, (SELECT mark FROM m), {5 * DAY})) AS tick FROM u UNION ALL SELECT 'daily', user_id, unnest(range({ZERO} + {DAY} * greatest(1, CAST(ceil((start - {ZERO}) / {DAY}) AS BIGINT)), (SELECT mark FROM m), {DAY})) FROM u UNION ALL SELECT 'weekly', user_id, unnest(range({ZERO} + {7 * DAY} * greatest(1, CAST(ceil((start - {ZERO}) / {7 * DAY}) AS BIGINT)), (SELECT mark FROM m), {7 * DAY})) FROM u)"


@query("stream_tick_rates", f"{TICKS} SELECT k.clock, k.user_id, k.tick, (SELECT arg_max(x.value, x.cycle) FROM p x WHERE x.user_id = k.user_id AND x.us <= k.tick) AS last, (SELECT arg_max(x.purchase, x.cycle) FILTER (WHERE x.purchase IS NOT NULL) FROM p x WHERE x.user_id = k.user_id AND x.us <= k.tick) AS bought FROM k")
def stream_tick_rates(spark, sf):
    """Two rates of a shared clock and one of each user's own, on one stream."""
    clocks = (Clock("daily", DAY, ZERO), Clock("weekly", 7 * DAY, ZERO), Clock("own", 5 * DAY))
    found = _whole(spark, sf, Objects({"value": "double", "purchase": "double"}, clocks=clocks)).where("kind = 'tick'")
    return found.select("clock", F.col("key").alias("user_id"), F.col("us").alias("tick"), F.col("value_last").alias("last"), F.col("purchase_1").alias("bought"))


SILENT = f"""{E}, p AS (SELECT *, us - lag(us) OVER ({BY_USER}) AS gap, coalesce(lead(us) OVER ({BY_USER}), (SELECT max(us) // 1000 * 1000 - {HOUR} FROM e)) - us AS until FROM e WHERE {PASSED}),
q AS (SELECT *, sum(CASE WHEN gap > {12 * HOUR} THEN 1 ELSE 0 END) OVER ({BY_USER}) AS life FROM p)"""


@query("stream_silence", f"WITH {SILENT} SELECT 'event' AS kind, user_id, us, value AS last, lag(value) OVER (PARTITION BY user_id, life ORDER BY cycle) AS prev_1, row_number() OVER (PARTITION BY user_id, life ORDER BY cycle) = 1 AS starts FROM q UNION ALL SELECT 'end', user_id, us + {12 * HOUR}, value, lag(value, 0) OVER (PARTITION BY user_id ORDER BY cycle), false FROM q WHERE until > {12 * HOUR}")
def stream_silence(spark, sf):
    """A user of whom nothing is heard for twelve hours is gone, and starts afresh."""
    found = _whole(spark, sf, Objects({"value": "double"}, silence_us=12 * HOUR))
    return found.select("kind", F.col("key").alias("user_id"), "us", F.col("value_last").alias("last"), F.col("value_1").alias("prev_1"), "starts")


@query("live_source", f"WITH {E} SELECT user_id, count(*) AS n, max(value) AS top FROM e GROUP BY user_id")
def live_source_query(spark, sf):
    parts = _Parts(spark, sf)
    got = _result(spark, parts, parts.stream.select("user_id", "value"), "live")
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("stream_state", f"WITH {E} SELECT cycle, user_id, value AS last, lag(value, 1) OVER ({BY_USER}) AS prev_1, lag(value, 2) OVER ({BY_USER}) AS prev_2 FROM e WHERE {PASSED}")
def stream_state(spark, sf):
    return _objects(spark, sf, 2).where("kind = 'event'").select(F.col("order").alias("cycle"), F.col("key").alias("user_id"), "last", "prev_1", "prev_2")


@query("stream_order", f"WITH {E} SELECT 'jump' AS rule, 'alert' AS level, cycle AS cycle_id, user_id::VARCHAR AS key FROM (SELECT *, lag(value, 1) OVER ({BY_USER}) AS before FROM e WHERE {PASSED}) WHERE abs(value - before) > 150")
def stream_order(spark, sf):
    """Rows arrive shuffled; the rule sees them in order."""
    found = monitor.stream_rule(_objects(spark, sf).where("kind = 'event'"), "jump", F.abs(F.col("last") - F.col("prev_1")) > 150, "alert", F.lit("jump"))
    return found.select("rule", "level", "cycle_id", "key")


@query("stream_late", f"WITH {E} SELECT cycle, user_id FROM e WHERE cycle % 10 = 3 AND us < (SELECT max(us) FROM e WHERE cycle % 10 <> 3) - {24 * HOUR}")
def stream_late(spark, sf):
    sink = scratch(spark, "parted")
    parts = _Parts(spark, sf, "cycle % 10 <> 3", "cycle % 10 = 3")
    _batches(spark, parts, monitor.late_batches(spark, scratch(spark, "latest"), "ts", "24 hours", sink))
    return spark.read.parquet(f"{sink}/late").select("cycle", "user_id")


@query("stream_late_counts", f"WITH {E}, l AS (SELECT *, cycle % 10 = 3 AND us <= (SELECT max(us) // 1000 * 1000 - {24 * HOUR} FROM e WHERE cycle % 10 <> 3) AS late FROM e) SELECT count(*) AS rows, count(*) FILTER (late) AS dropped, count(*) FILTER (NOT late) AS kept, count(DISTINCT user_id) FILTER (NOT late) AS users FROM l")
def stream_late_counts(spark, sf):
    """What the engine counts as arrived and as dropped behind the watermark, beside what objects in keyed state have seen."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    parts = _Parts(spark, sf, "cycle % 10 <> 3", "cycle % 10 = 3")
    states = monitor.object_stream(monitor.counted(parts.stream, "ts"), "user_id", "ts", "cycle", "value", "24 hours")
    sink = scratch(spark, "kept")
    progress = parts.run(states.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "kept-log")), close=True)
    counts = monitor.batch_counts(spark, progress)
    kept = spark.read.schema(states.schema).parquet(sink).where("kind = 'event'")
    closing = 1  # the row of no object
    total = counts.agg((F.sum("rows") - closing).alias("rows"), F.sum("dropped").alias("dropped"))
    return total.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("key").alias("users")))


@query("stream_tick_local", f"WITH {E}, p AS (SELECT * FROM e WHERE {PASSED}), u AS (SELECT user_id, min(us) AS start FROM p GROUP BY user_id), k AS (SELECT user_id, unnest(range(start + {5 * DAY}, (SELECT max(us) // 1000 * 1000 - {HOUR} FROM e), {5 * DAY})) AS tick FROM u) SELECT k.user_id, k.tick, (SELECT arg_max(x.value, x.cycle) FROM e x WHERE x.user_id = k.user_id AND x.us <= k.tick) AS last FROM k")
def stream_tick_local(spark, sf):
    states = _objects(spark, sf, step_ms=5 * DAY // 1000)
    return states.where("kind = 'tick'").select(F.col("key").alias("user_id"), F.unix_micros("ts").alias("tick"), "last")


@query("stream_tick_global", f"WITH {E}, k AS (SELECT unnest(range({ZERO} + {DAY}, (SELECT max(us) // 1000 * 1000 - {HOUR} FROM e), {DAY})) AS tick), st AS (SELECT k.tick, e.user_id, arg_max(e.value, e.cycle) AS value FROM k JOIN e ON e.us <= k.tick GROUP BY 1, 2) SELECT tick, count(*) AS objects, max(value) AS most, min(value) AS least FROM st GROUP BY tick")
def stream_tick_global(spark, sf):
    states = _objects(spark, sf, step_ms=DAY // 1000, zero_ms=ZERO // 1000)
    return monitor.tick_windows(states, "1 day").select(F.unix_micros("ts").alias("tick"), "objects", "most", "least")


@query("stream_expire", f"WITH {E}, l AS (SELECT *, coalesce(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM e WHERE {PASSED}) SELECT cycle, user_id, value AS last, lag(value, 1) OVER (PARTITION BY user_id, life ORDER BY cycle) AS prev_1 FROM l")
def stream_expire(spark, sf):
    """An object ends with a value under 5; what it held is forgotten."""
    states = _objects(spark, sf, ends_below=5.0)
    return states.where("kind = 'event'").select(F.col("order").alias("cycle"), F.col("key").alias("user_id"), "last", "prev_1")


#: Arrival up to six hours late, in three parts: of those of the second and third, some are older than some of the one before.
ARRIVAL = f"us + pmod(pmod(cycle, {6 * HOUR}) * 7919, {6 * HOUR})"
#: How long a trace is made, and the user of rows without one.
MONTH, NOBODY = 30 * DAY, -(1 << 63)


def _world(spark, sf, spec, changes, **signals):
    """How many bindings hold in each cycle, once a stream has come to its end.

    The order of users' versions is that of cycles, whatever is in ts, so cycles are spread over a month as the time of the stream. signals: columns besides those of the trace.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    first, last = trace(spark, sf).agg(F.min("cycle"), F.max("cycle")).first()
    us = ZERO + F.floor((F.col("cycle").cast("double") - float(first or 0)) / max(1.0, float(last or 0) - float(first or 0)) * MONTH)
    a, b = (ZERO + k * MONTH // 3 for k in (1, 2))
    more = {"ts": F.timestamp_micros(us), "us": us, "user_id": F.coalesce("user_id", F.lit(NOBODY))}
    parts = _Parts(spark, sf, f"{ARRIVAL} <= {a}", f"{ARRIVAL} > {a} AND {ARRIVAL} <= {b}", f"{ARRIVAL} > {b}", more=more)
    states = lives.life_stream(parts.stream.withColumns(signals), "user_id", "ts", "cycle", spec, "7 hours")
    sink = scratch(spark, "world")
    run = world.truth_batches(spark, scratch(spark, "carry"), sink, MONTH // 32)
    parts.run(changes(states).writeStream.foreachBatch(run).option("checkpointLocation", scratch(spark, "world-log")), close=True)
    return spark.read.schema("cycle_id bigint, us bigint, n bigint").parquet(sink)


@query("stream_world", f"WITH {E}, v AS (SELECT cycle AS lo, coalesce(lead(cycle) OVER ({BY_USER}), (SELECT max(cycle) + 1 FROM e)) AS hi, last_value(purchase IGNORE NULLS) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS purchase FROM e), d AS (SELECT lo AS cycle, 1 AS d FROM v WHERE purchase > 250 UNION ALL SELECT hi, -1 FROM v WHERE purchase > 250), s AS (SELECT cycle, sum(d) AS d FROM d GROUP BY cycle) SELECT cycle AS cycle_id FROM (SELECT e.cycle, sum(s.d) OVER (ORDER BY e.cycle) AS n FROM e LEFT JOIN s ON e.cycle = s.cycle) WHERE n > 0")
def stream_world(spark, sf):
    """A quantified rule on rows that come late, in three parts."""
    found = _world(spark, sf, Objects({"purchase": "double"}), lambda s: world.one_changes(s, lambda u: u.last("purchase", 0.0) > 250))
    return found.where("n > 0").select("cycle_id")


@query("stream_world_history", f"WITH {E}, v AS (SELECT cycle AS lo, coalesce(lead(cycle) OVER ({BY_USER}), (SELECT max(cycle) + 1 FROM e)) AS hi, lag(value, 2) OVER ({BY_USER}) AS in_row, lag(value, 1) OVER ({BY_USER}) AS after_row FROM e), d AS (SELECT unnest([lo, lo + 1]) AS cycle, unnest([1, -1]) AS d FROM v WHERE in_row > 250 UNION ALL SELECT unnest([lo + 1, hi]), unnest([1, -1]) FROM v WHERE after_row > 250), s AS (SELECT cycle, sum(d) AS d, max(own) AS own FROM (SELECT cycle, d, 0 AS own FROM d UNION ALL SELECT cycle, 0, 1 FROM e) GROUP BY cycle) SELECT cycle AS cycle_id FROM (SELECT cycle, own, sum(d) OVER (ORDER BY cycle) AS n FROM s) WHERE own = 1 AND n > 0")
def stream_world_history(spark, sf):
    """A quantified rule on what was two updates ago, also where that came in an earlier batch; after a row, its own update is one of the two."""
    found = _world(spark, sf, Objects({"value": "double"}, depth=2), lambda s: world.one_changes(s, lambda u: u.history("value", 2, 0.0) > 250))
    return found.where("n > 0").select("cycle_id")


@query("stream_world_forall", f"WITH {E}, p AS (SELECT *, coalesce(sum(CASE WHEN error > 100 THEN 1 ELSE 0 END) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life, coalesce(error > 100, false) AS ends FROM e), v AS (SELECT cycle AS lo, CASE WHEN ends THEN cycle + 1 ELSE coalesce(lead(cycle) OVER w, (SELECT max(cycle) + 1 FROM e)) END AS hi, last_value(purchase IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS purchase FROM p WINDOW w AS (PARTITION BY user_id, life ORDER BY cycle)), d AS (SELECT unnest([lo, hi]) AS cycle, unnest([1, -1]) AS d FROM v WHERE NOT coalesce(purchase, 0) < 200), s AS (SELECT cycle, sum(d) AS d FROM d GROUP BY cycle) SELECT cycle AS cycle_id, coalesce(sum(d) OVER (ORDER BY cycle), 0) = 0 AS holds FROM (SELECT e.cycle, s.d FROM e LEFT JOIN s ON e.cycle = s.cycle)")
def stream_world_forall(spark, sf):
    """A rule for all users, of whom some end."""
    spec = Objects({"purchase": "double", "error": "double"}, ends=lambda f: f.now("error") > 100)
    found = _world(spark, sf, spec, lambda s: world.one_changes(s, lambda u: ~(u.last("purchase", 0.0) < 200)))
    return found.select("cycle_id", (F.col("n") == 0).alias("holds"))


PAIRS = "SELECT greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM v a JOIN v b ON a.lo < b.hi AND b.lo < a.hi AND a.code = b.code AND a.user_id < b.user_id"


@query("stream_world_pairs", f"WITH {E}, v AS (SELECT user_id, cycle AS lo, coalesce(lead(cycle) OVER ({BY_USER}), (SELECT max(cycle) + 1 FROM e)) AS hi, value, CAST(floor(value) AS BIGINT) AS code FROM e), x AS ({PAIRS}), d AS (SELECT unnest([lo, hi]) AS cycle, unnest([1, -1]) AS d FROM x), s AS (SELECT cycle, sum(d) AS d FROM d GROUP BY cycle) SELECT cycle AS cycle_id, CAST(coalesce(sum(d) OVER (ORDER BY cycle), 0) AS BIGINT) AS n FROM (SELECT e.cycle, s.d FROM e LEFT JOIN s ON e.cycle = s.cycle)")
def stream_world_pairs(spark, sf):
    """Pairs of users that hold the same whole value, counted in each cycle of a stream."""
    code = lambda u: F.when((F.col("key") != NOBODY) & (u.last("code") != ""), u.last("code"))
    found = _world(spark, sf, Objects({"code": "string"}), lambda s: world.pair_changes(s, code), code=F.coalesce(F.floor("value").cast("string"), F.lit("")))
    return found.select("cycle_id", "n")


@query("stream_processing_time", f"WITH {E} SELECT user_id, count(*) AS n FROM e GROUP BY user_id")
def stream_processing_time(spark, sf):
    """Rows stamped with the time at which they are processed, all of them later than their own."""
    parts = _Parts(spark, sf)
    got = _result(spark, parts, parts.stream.withColumn("at", F.current_timestamp()), "stamped")
    return got.where("at > ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
