"""The monitor on streams: rules over keyed state (lives.py), and late rows. Quantified rules are in world.py.

Rows behind the watermark never reopen a cycle: Spark drops and counts them; batch_counts() gives these counts, and late_batches() keeps the rows apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objwatch.operators.rules import VERDICT
from objwatch.streaming.lives import Clock, Objects, life_stream

def object_stream(stream: DataFrame, key: str, ts: str, order: str, value: str, delay: str, depth: int = 1, step_ms: int | None = None, zero_ms: int | None = None, ends_below: float | None = None) -> DataFrame:
    """life_stream() of objects with one numeric signal: updates (kind event) and ticks (tick), each with the held value and the updates before it.

    step_ms starts a clock per object, from its first row on; with zero_ms, at the times of one shared clock. An update under ends_below ends the object.
    """
    clocks = (Clock("clock", step_ms * 1000, None if zero_ms is None else zero_ms * 1000),) if step_ms else ()
    ends = None if ends_below is None else lambda f: f.now("value") < ends_below
    rows = stream.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    states = life_stream(rows, "key", "ts", "order", Objects({"value": "double"}, (), depth, clocks, ends), delay)
    past = [F.col(f"value_{k}").alias(f"prev_{k}") for k in range(1, depth + 1)]
    return states.select("key", "ts", "order", "kind", "value", F.col("value_last").alias("last"), *past)


def stream_rule(states: DataFrame, name: str, guard, level: str, message) -> DataFrame:
    """Verdicts over the rows of object_stream() that are events or ticks."""
    fired = states.where(guard)
    return fired.select(F.lit(name).alias("rule"), F.lit(level).alias("level"), F.col("kind").alias("cycle_kind"), F.col("order").alias("cycle_id"), "ts", F.array("key").alias("key"), message.cast("string").alias("value")).select(VERDICT)


def late_batches(spark: SparkSession, path: str, ts: str, delay: str, sink: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that parts rows into sink/on_time and sink/late.

    A row is late if, in the batches before its own, a row was seen that is more than delay newer.
    The latest time is kept under path by batch, so a batch that runs again gives the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{path}/latest-{number - 1}").first()[0] if number > 0 else None
        late = F.lit(False) if before is None else F.col(ts) < F.lit(before) - F.expr(f"INTERVAL {delay}")
        marked = batch.withColumn("_late", late)
        for name, wanted in (("late", F.col("_late")), ("on_time", ~F.col("_late"))):
            marked.where(wanted).drop("_late").write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")
        latest = batch.agg(F.greatest(F.max(ts), F.lit(before).cast("timestamp")).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{path}/latest-{number}")

    return run


def counted(stream: DataFrame, ts: str, name: str = "arrivals") -> DataFrame:
    """The stream, which counts its rows and notes their latest time by batch, for batch_counts(). To be called on what arrives."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.unix_micros(F.max(ts)).alias("latest"))


def batch_counts(spark: SparkSession, progress: list, name: str = "arrivals") -> DataFrame:
    """(batch, rows, dropped, latest, watermark): what each batch of a stream that was counted() took in, and how many rows behind the watermark the engine has dropped.

    progress is what a query that keeps state gives as recentProgress (of its last batches, a hundred unless
    spark.sql.streaming.numRecentProgressUpdates says otherwise), or what a listener has gathered. A batch that is there twice counts once, as it was
    last; one without rows, which only moves the watermark on, has no latest time.
    """
    found = {}
    for p in progress:
        seen = p.observedMetrics.get(name)
        dropped = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        if seen is not None or dropped or p.batchId not in found:
            found[p.batchId] = (p.batchId, seen["rows"] if seen else 0, dropped, seen["latest"] if seen else None, p.eventTime.get("watermark"))
    counts = spark.createDataFrame(list(found.values()), "batch bigint, rows bigint, dropped bigint, latest bigint, watermark string")
    return counts.withColumns({"latest": F.timestamp_micros("latest"), "watermark": F.to_timestamp("watermark")})


def tick_windows(states: DataFrame, step: str) -> DataFrame:
    """Ticks of all objects grouped by the shared clock, for rules that count over objects."""
    return states.where("kind = 'tick'").groupBy(F.window("ts", step), "ts").agg(F.count(F.lit(1)).alias("objects"), F.max("last").alias("most"), F.min("last").alias("least")).drop("window")
