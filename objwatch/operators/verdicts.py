"""What monitors put out: merged verdicts, deltas, snapshots, text lines, records, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objwatch.operators.objects import ObjectSet
from objwatch.operators.rules import LEVELS, VERDICT

#: Levels of verbosity in order, and the least one at which a kind of output is shown.
VERBOSITY = ("silent", "violation", "violations", "alert", "warnings", "info", "public", "outputs", "streams", "debug")
SHOWN_FROM = {"violation": 1, "alert": 3, "info": 5, "public": 6, "output": 7, "stream": 8, "debug": 9}


def evaluate(*frames: DataFrame) -> DataFrame:
    """Verdicts of many rules as one frame."""
    return reduce(DataFrame.unionByName, [f.select(VERDICT) for f in frames])


def same_frame_rules(rows: DataFrame, rules: list[tuple[str, str, Column, Column]], cycle: str, ts: str, key: str | None) -> DataFrame:
    """Rules (name, level, guard, message) over one frame, in one pass: each row gives an array of what fires."""
    fired = [F.when(guard, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"), message.cast("string").alias("value"))) for name, level, guard, message in rules]
    hits = rows.select(F.lit("event").alias("cycle_kind"), F.col(cycle).cast("bigint").alias("cycle_id"), F.col(ts).alias("ts"), (F.lit(None) if key is None else F.array(key)).cast("array<bigint>").alias("key"), F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("x"))
    return hits.select("x.rule", "x.level", "cycle_kind", "cycle_id", "ts", "key", "x.value")


def alarms(found: DataFrame) -> DataFrame:
    """Only the rules that fired: cycle, rule, level, key, message."""
    return found.select("cycle_id", "rule", "level", "key", "value")


def delta(objs: ObjectSet, cycle: str, derived: list[str] = ()) -> DataFrame:
    """(cycle_id, change, stream, key, value): starts, ends and updates of derived signals, cycle by cycle."""
    key = F.col(objs.key).cast("bigint")
    line = lambda rows, change, stream, value: rows.select(F.col(cycle).cast("bigint").alias("cycle_id"), F.lit(change).alias("change"), F.lit(stream).alias("stream"), key.alias("key"), value.cast("string").alias("value"))
    parts = [line(objs.activations(), "activate", "object", F.lit(None))]
    if derived:
        pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).cast("string").alias("value")) for s in derived])).alias("x")
        updates = objs.rows.select(F.col(cycle).cast("bigint").alias("cycle_id"), F.lit("update").alias("change"), key.alias("key"), pairs).where("x.value is not null")
        parts.append(updates.select("cycle_id", "change", "x.stream", "key", "x.value"))
    if objs.ends is not None:
        parts.append(line(objs.rows.where(F.col(objs.ends)), "deactivate", "object", F.lit(None)))
    return reduce(DataFrame.unionByName, parts)


def full_delta(objs: ObjectSet, cycle: str, derived: list[str], inputs: list[str], found: DataFrame) -> DataFrame:
    """delta() and the fresh inputs of each cycle and the rules that fired."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), F.col(s).cast("string").alias("value")) for s in inputs])).alias("x")
    given = objs.rows.select(F.col(cycle).cast("bigint").alias("cycle_id"), F.lit("input").alias("change"), F.col(objs.key).cast("bigint").alias("key"), pairs).where("x.value is not null").select("cycle_id", "change", "x.stream", "key", "x.value")
    fired = found.select("cycle_id", F.lit("fired").alias("change"), F.col("rule").alias("stream"), F.element_at("key", 1).alias("key"), "value")
    return delta(objs, cycle, derived).unionByName(given).unionByName(fired)


def snapshots(objs: ObjectSet, cycle: str) -> DataFrame:
    """(cycle_id, key, signals): what the object of each row holds after it; others hold what their own last row says."""
    return objs.rows.select(F.col(cycle).cast("bigint").alias("cycle_id"), *objs.keys, *[objs.last(s).alias(s) for s in objs.signals])


def at_most(found: DataFrame, verbosity: str, level: str = "level") -> DataFrame:
    """The rows whose level is shown at a verbosity."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SHOWN_FROM.items() for x in kv]), F.col(level))
    return found.where(rank <= VERBOSITY.index(verbosity))


def render(found: DataFrame) -> DataFrame:
    """Text lines: @time | level | #rule<key> :: value = "message"."""
    key = F.when(F.col("key").isNull(), "").otherwise(F.concat(F.lit("<"), F.array_join(F.transform("key", lambda k: k.cast("string")), ", "), F.lit(">")))
    line = F.concat(F.lit("@"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" | "), F.col("level"), F.lit(" | #"), F.col("rule"), key, F.lit(' :: value = "'), F.coalesce("value", F.lit("None")), F.lit('"'))
    return found.select("cycle_id", "rule", line.alias("line"))


def to_records(found: DataFrame, rules: list[str]) -> DataFrame:
    """One row per cycle with a map key -> message for each of the rules."""
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("rule") == r, F.struct(F.element_at("key", 1).alias("key"), F.col("value").alias("value")))))).alias(r) for r in rules]
    return found.where(F.col("rule").isin(rules)).groupBy("cycle_id").agg(*maps)


def rule_stats(found: DataFrame) -> DataFrame:
    """(rule, level, hits, cycles, first_cycle, last_cycle) of each rule."""
    per_cycle = found.groupBy("rule", "level", "cycle_id").agg(F.count(F.lit(1)).alias("n"))  # counts of distinct cycles without a set of them
    return per_cycle.groupBy("rule", "level").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("cycles"), F.min("cycle_id").alias("first_cycle"), F.max("cycle_id").alias("last_cycle"))


def totals(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: hits of each level, and the cycles of the trace."""
    hits = found.agg(*[F.count_if(F.col("level") == x).alias(x) for x in LEVELS])
    return hits.join(rows.agg(F.count(F.lit(1)).alias("cycles")))
