"""How many stores a stream keeps its state in."""

from pyspark.sql import functions as F

from objwatch.plans import queries_stream
from objwatch.streaming import lives, monitor

PARTITIONS = "spark.sql.shuffle.partitions"


def test_stores_go_by_lanes_and_not_by_shuffle_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lives, "STORES", 2, raising=False)
    given = spark.conf.get(PARTITIONS)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queries_stream.STORE)
    parts = queries_stream._Parts(spark, sf_dir)
    states = monitor.object_stream(parts.stream, "user_id", "ts", "cycle", "value", "1 hour")
    sink, log = queries_stream.scratch(spark, "stores"), queries_stream.scratch(spark, "stores-log")
    progress = parts.run(states.writeStream.format("parquet").option("path", sink).option("checkpointLocation", log), close=True)
    assert {o.numShufflePartitions for p in progress for o in p.stateOperators} == {2}
    assert spark.conf.get(PARTITIONS) == given == "4"
    assert spark.read.schema(states.schema).parquet(sink).where(F.col("kind") == "event").count() == parts.rows.count()


def test_every_store_has_lanes():
    assert 1 <= lives.STORES <= lives.LANES
