"""Queries over ingestion: cells, types, times, binding, sinks. What is read is written from the tables first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from objwatch.operators import rules
from objwatch.plans.catalog import query
from objwatch.plans.tables import SPAN, ZERO, E, trace, users
from objwatch.sources import trace as T


def scratch(spark, name: str) -> str:
    """A new path in the folder that all executors share; in a temporary one only where none is set and all is on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors of a cluster have no folder that they share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="objwatch-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def _cells(spark, sf):
    t = trace(spark, sf)
    seconds = ((F.col("us") - ZERO).cast("decimal(20,6)") / 1_000_000).cast("decimal(28,6)")
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(T.ABSENT))
    return t.select("cycle", cell(F.col("user_id")).alias("uid"), cell(F.when(F.col("click").isNotNull(), F.col("cycle") * 3)).alias("clicks"), seconds.cast("string").alias("Time"))


@query("read_trace_csv", f"WITH {E} SELECT cycle, user_id AS uid, CASE WHEN click IS NOT NULL THEN cycle * 3 END AS clicks, (us - {ZERO}) * 1000 AS ts_ns FROM e")
def read_trace_csv(spark, sf):
    path = scratch(spark, "trace")
    _cells(spark, sf).orderBy("cycle").drop("cycle").write.csv(path, header=True)
    return T.read_trace(spark, path, {"uid": "Int64", "clicks": "UInt32"}).select("cycle", "uid", "clicks", "ts_ns")


@query("absent_cells", f"WITH {E} SELECT cycle, CASE WHEN click IS NOT NULL THEN cast(cycle * 3 AS VARCHAR) END AS clicks FROM e")
def absent_cells(spark, sf):
    return _cells(spark, sf).select("cycle", T.absent(F.col("clicks")).alias("clicks"))


@query("typed_parse", f"WITH {E} SELECT cycle, user_id AS whole, event_type = 'click' AS flag, user_id AS plain, hex(event_type) AS raw, CASE WHEN event_type = 'view' THEN user_id END AS loose, CASE WHEN event_type = 'view' THEN '' ELSE 'loose' END AS errors FROM e")
def typed_parse(spark, sf):
    t = trace(spark, sf)
    cells = t.select(
        "cycle", F.col("user_id").cast("string").alias("whole"), F.when(F.col("event_type") == "click", "true").otherwise("false").alias("flag"), F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("plain"),
        F.hex(F.col("event_type").cast("binary")).alias("raw"), F.when(F.col("event_type") == "view", F.col("user_id").cast("string")).otherwise(F.col("event_type")).alias("loose"),
    )
    typed = T.parse_signals(T.parse_signals(cells, {"whole": "Int64", "flag": "Bool", "plain": "UInt32", "raw": "Bytes"}), {"loose": "Int64"}, strict=False)
    return typed.select("cycle", "whole", "flag", "plain", F.hex("raw").alias("raw"), "loose", F.array_join("errors", ",").alias("errors"))


@query("time_column", f"WITH {E} SELECT cycle, ts AS found, ts AS second FROM e")
def time_column(spark, sf):
    t = trace(spark, sf).select("cycle", "ts", "value")
    return t.select("cycle", F.col(T.time_column(t.columns)).alias("found"), F.col(T.time_column(t.columns, 2)).alias("second"))


@query("time_rel_secs", f"WITH {E} SELECT cycle, cycle * 1000000000 + 250000000 AS ts_ns FROM e")
def time_rel_secs(spark, sf):
    t = trace(spark, sf).select("cycle", F.concat(F.col("cycle").cast("string"), F.lit(".25")).alias("t"))
    return T.decode_time(t, "t", "relative").drop("t")


@query("time_rel_nanos", f"WITH {E} SELECT cycle, cycle * 1000 AS ts_ns FROM e")
def time_rel_nanos(spark, sf):
    t = trace(spark, sf).select("cycle", (F.col("cycle") * 1000).cast("string").alias("t"))
    return T.decode_time(t, "t", "relative_ns").drop("t")


@query("time_delta", f"WITH {E} SELECT cycle, cast(sum(cycle % 7 * 1000000000 + 500000000) OVER (ORDER BY cycle) AS BIGINT) AS ts_ns FROM e")
def time_delta(spark, sf):
    t = trace(spark, sf).select("cycle", F.concat((F.col("cycle") % 7).cast("string"), F.lit(".5")).alias("t"))
    return T.decode_time(t, "t", "offset", order=["cycle"], bucket=F.floor(F.col("cycle") / SPAN)).drop("t")


@query("time_epoch", f"WITH {E} SELECT cycle, (us - min(us) OVER ()) * 1000 AS ts_ns FROM e")
def time_epoch(spark, sf):
    t = trace(spark, sf).select("cycle", (F.col("us").cast("decimal(22,6)") / 1_000_000).cast("decimal(28,6)").cast("string").alias("t"))
    return T.decode_time(t, "t", "absolute").drop("t")


@query("time_rfc3339", f"WITH {E} SELECT cycle, (us - {ZERO}) * 1000 AS ts_ns FROM e")
def time_rfc3339(spark, sf):
    t = trace(spark, sf).select("cycle", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("t"))
    return T.decode_time(t, "t", "rfc3339", start="2024-01-01T00:00:00Z").drop("t")


@query("time_fixed_step", f"WITH {E} SELECT cycle, row_number() OVER (ORDER BY cycle) * 250 AS ts_ns FROM e")
def time_fixed_step(spark, sf):
    t = trace(spark, sf).select("cycle")
    return T.decode_time(t, "", "fixed_step", order=["cycle"], bucket=F.floor(F.col("cycle") / SPAN), step=250)


@query("time_wall", f"WITH {E} SELECT cycle, true AS later FROM e")
def time_wall(spark, sf):
    t = T.decode_time(trace(spark, sf).select("cycle", "us"), "", "wall")
    return t.select("cycle", (F.col("ts_ns") > F.col("us") * 1000).alias("later"))


@query("encode_time", f"WITH {E} SELECT cycle, cast((us - {ZERO}) // 1000000 AS VARCHAR) || '.' || lpad(cast((us - {ZERO}) % 1000000 AS VARCHAR), 6, '0') || '000' AS rel, cast((us - {ZERO}) * 1000 AS VARCHAR) AS ns, cast(us // 1000000 AS VARCHAR) AS unix, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS rfc FROM e")
def encode_time(spark, sf):
    since, at = (F.col("us") - ZERO) * 1000, F.col("us") * 1000
    return trace(spark, sf).select("cycle", T.encode_time(since, "relative").alias("rel"), T.encode_time(since, "relative_ns").alias("ns"), T.encode_time(at, "unix").alias("unix"), T.encode_time(at, "rfc3339").alias("rfc"))


@query("map_fields", f"WITH {E} SELECT cycle, user_id AS uid, value AS speed, cast(NULL AS BIGINT) AS block FROM e")
def map_fields(spark, sf):
    t = trace(spark, sf)
    return T.bind_signals(t, {"cycle": "cycle", "uid": "user_id", "speed": "value", "block": "no_such"}, {"cycle": "bigint", "uid": "bigint", "speed": "double", "block": "bigint"}, strict=False)


@query("positional_bind", f"WITH {E} SELECT cycle, user_id AS uid, cast(NULL AS DOUBLE) AS speed FROM e")
def positional_bind(spark, sf):
    return T.bind_positional(trace(spark, sf).select("cycle", "user_id"), {"cycle": "bigint", "uid": "bigint", "speed": "double"})


@query("empty_event", f"WITH {E} SELECT row_number() OVER (ORDER BY cycle) - 1 AS n, cycle, click, click IS NULL AND view IS NULL AS is_empty FROM e")
def empty_event(spark, sf):
    t = trace(spark, sf).select("cycle", "click", (F.col("click").isNull() & F.col("view").isNull()).alias("is_empty"))
    return T.number_cycles(t, ["cycle"], F.floor(F.col("cycle") / SPAN), "n")


@query("write_verdicts", f"WITH {E} SELECT rule, level, cycle_id, key, value FROM (SELECT 'big' AS rule, 'alert' AS level, cycle AS cycle_id, user_id::VARCHAR AS key, 'big' AS value FROM e WHERE purchase > 100)")
def write_verdicts(spark, sf):
    path = scratch(spark, "verdicts")
    T.write_verdicts(rules.object_rule(users(spark, sf), "big", lambda me: me.purchase.now > 100.0, "alert", "big"), path)
    return spark.read.parquet(path).select("rule", "level", "cycle_id", "key", "value")
