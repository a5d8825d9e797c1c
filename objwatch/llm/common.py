"""What several operators share: tables, shared storage, and bounded membership filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of a membership filter. The filter is broadcast, and this bounds it: one row of 64 bits each.
FILTER_BITS = 1 << 23
#: And of one that is sized by its keys, at most: 8 MB, a million rows.
MOST_BITS = 1 << 26
#: Bytes of an Arrow batch. Spark bounds its rows only, and ten thousand texts are held by the JVM and by the worker at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all is on one machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors of a cluster have no folder that they share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="objwatch-"))
    return sc.getCheckpointDir()


def give_back_memory() -> None:
    """Return freed memory to the system; a Python worker lives on between tasks, beside others and the JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, giving memory back at the end of each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return tidy


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of about BATCH_BYTES or of a row that is longer; memory is given back after each task.

    The limit is a setting of the session and stays; a smaller one that is set already is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    given = conf.get(name)
    if not given.isdigit() or int(given) > BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(tidied(run), schema)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that lost executors cost no recomputation of what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filter_bits(n: int) -> int:
    """Bits of a filter of n keys: 16 a key, which flags about one other key in a hundred. Beyond MOST_BITS it flags more, and results stay exact."""
    return min(MOST_BITS, 1 << max(16, (16 * n - 1).bit_length()))


def _hashed(df: DataFrame, key: str, bits: int) -> DataFrame:
    """Add _word, of bits / 64, and _want, up to four bits in it, by the key's hash."""
    four = " | ".join(f"shiftleft(1L, cast(shiftright(_h, {6 * i}) & 63 as int))" for i in range(4))
    return df.withColumn("_h", F.xxhash64(key)).withColumn("_word", F.expr(f"pmod(shiftright(_h, 24), {bits // 64}L)")).withColumn("_want", F.expr(four)).drop("_h")


def membership_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter over keys[key], four bits a key in one word, as rows (_word, _mask): at most bits / 64 of them."""
    return _hashed(keys.select(key), key, bits).groupBy("_word").agg(F.bit_or("_want").alias("_mask"))


def flag_members(df: DataFrame, key: str, members: DataFrame, flag: str = "_maybe", bits: int = FILTER_BITS) -> DataFrame:
    """Add a flag that is true for all rows whose key is in the filter, and for few others. The broadcast is bounded by bits."""
    joined = _hashed(df, key, bits).join(F.broadcast(members), "_word", "left")
    hit: Column = F.expr("coalesce(_mask & _want, 0L) = _want")
    return joined.withColumn(flag, hit).drop("_want", "_word", "_mask")


def as_rows(docs: DataFrame, *keys: str) -> DataFrame:
    """docs as one struct column _row beside _key, or _key0, _key1 ...: no name of docs can clash with an operator's own."""
    names = ["_key"] if len(keys) == 1 else [f"_key{i}" for i in range(len(keys))]
    return docs.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def without_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in dropped. Only rows that the filter flags are shuffled, so most texts stay where they are."""
    dropped = dropped.select(F.col(key).alias("_gone")).where("_gone is not null").distinct()
    flagged = flag_members(as_rows(docs, key), "_key", membership_filter(dropped, "_gone"))
    passed = flagged.where("not _maybe").select("_row.*")
    checked = flagged.where("_maybe").join(dropped, F.col("_key") == F.col("_gone"), "left_anti").select("_row.*")
    return passed.unionByName(checked)
