"""The test tables as traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objwatch.operators.objects import ObjectSet, objects

KINDS = ("click", "purchase", "error", "signup", "view")
DAY = 86_400_000_000
#: 2024-01-01 in microseconds: time zero of the ticks.
ZERO = 1_704_067_200_000_000
#: Cycles of one range of the global order.
SPAN = 4096

#: The trace in SQL.
E = "e AS (SELECT event_id AS cycle, ts, epoch_us(ts) AS us, user_id, event_type, value, props, " + ", ".join(f"CASE WHEN event_type = '{k}' THEN value END AS {k}" for k in KINDS) + " FROM events)"
BY_USER = "PARTITION BY user_id ORDER BY cycle"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kinds = [F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in KINDS]
    return events.select(F.col("event_id").alias("cycle"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value", "props", *kinds)


def users(spark: SparkSession, sf_dir: str, *signals: str) -> ObjectSet:
    rows = trace(spark, sf_dir)
    return objects(rows, "user_id", [*(signals or ("value", *KINDS)), "ts", "us"], ["cycle"])


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).select("cycle", "ts")


def end_cycle(rows: DataFrame, at: str = "cycle") -> int:
    """The number after the last cycle."""
    return (rows.agg(F.max(at)).first()[0] or 0) + 1
