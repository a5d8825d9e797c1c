"""Packing by powers of two: each document is cut into pieces of binary lengths, and pieces of one length make a bucket.

A piece is a sequence by itself, so no sequence holds two documents and none is padded. Sequences are numbered bucket by
bucket without gaps, so that a batch is a range of numbers: so many sequences of one length, for as many tokens in any bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objwatch.llm.common import cut_lineage, map_batches, table
from objwatch.llm.packing import crc_of, default_tokenizer, encoded_blocks

LONGEST = 2048
END_ID = 1
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("_part", pa.int32()), ("_nth", pa.int64())])


def binary_cuts(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these sizes, the longest first: as many of `longest` as fit, then each power of two in what is left."""
    whole = sizes // longest
    powers = longest >> np.arange(1, longest.bit_length())
    bits = (sizes[:, None] & powers) > 0
    per = whole + bits.sum(axis=1)
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    length = np.full(len(doc), longest, np.int64)
    length[nth >= whole[doc]] = np.broadcast_to(powers, bits.shape)[bits]
    ends = np.cumsum(length)
    first = np.cumsum(sizes) - sizes
    return doc, ends - length - first[doc], length


def decompose(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset): the pieces of docs(doc_id, text, ...), each a sequence.

    longest is a power of two. bucket is the length's binary logarithm; sequence_id counts the longest bucket first. A null or empty text is
    one piece, of its end_id. A very long one is as many pieces of `longest` as fit and some shorter ones. Repeated rows, and rows
    without an id, are cut each for itself. An empty table gives no rows. Other columns are ignored.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(longest.bit_length(), np.int64)
        for rows, ids, begin in encoded_blocks(batches, path, end_id):
            sizes = np.diff(begin)
            doc, start, length = binary_cuts(sizes, longest)
            # how many pieces of its length the task has cut before
            order = np.argsort(length, kind="stable")
            bucket = np.log2(length[order]).astype(np.int64)
            nth = np.empty(len(doc), np.int64)
            counts = np.bincount(bucket, minlength=len(seen))
            nth[order] = np.arange(len(doc)) - (np.cumsum(counts) - counts)[bucket] + seen[bucket]
            seen += counts
            columns = [rows["doc_id"].take(pa.array(doc)), start, length, crc_of(ids, begin[doc] + start, length), sizes[doc], np.full(len(doc), part), nth]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    # written before it is counted: numbers of a task count only with the rows of the same run of it
    pieces = cut_lineage(map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _part int, _nth bigint"))
    counts = pieces.groupBy("length", "_part").agg((F.max("_nth") + 1).alias("_n"))
    totals = counts.groupBy("length").agg(F.sum("_n").alias("_all"))  # a row for each power of two
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("length", (F.sum("_all").over(Window.orderBy(F.desc("length"))) - F.col("_all")).alias("_base"))
    firsts = counts.select("length", "_part", before(Window.partitionBy("length").orderBy("_part")).alias("_before")).join(F.broadcast(bases), "length")
    numbered = pieces.join(firsts, ["length", "_part"])
    return numbered.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.log2("length").cast("int").alias("bucket"), (F.col("_base") + F.col("_before") + F.col("_nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )


def batches(sequences: DataFrame, tokens: int) -> DataFrame:
    """Add batch: sequences of one bucket, for so many tokens at most, under a struct (bucket, number). tokens is at least the longest length."""
    bases = F.broadcast(sequences.groupBy("bucket").agg(F.min("sequence_id").alias("_base")))  # a row for each power of two
    number = F.call_function("div", F.col("sequence_id") - F.col("_base"), F.call_function("div", F.lit(tokens), F.col("length")))
    return sequences.join(bases, "bucket").withColumn("batch", F.struct("bucket", number.alias("number"))).drop("_base")


def op12_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose(table(spark, sf_dir, "documents"))
