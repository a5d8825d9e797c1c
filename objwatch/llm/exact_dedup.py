"""Exact dedup by a log-structured merge index of text digests (DataFrame functions only).

Digests are logged as they are computed, and dealt to memtables. A memtable is combined, one entry a
digest with its smallest identifier and count, and flushed as a run: files of consecutive ranges of
digests, sorted, and a Bloom filter. A new run probes the filters of the runs before it, and only
entries that a filter knows are looked up there. When a level has FANOUT runs, they are merged range by range
into one of the next level. Digests found again, in a run or across runs, are hits; their texts, and no
others, are read again and compared byte by byte before anything is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objwatch.llm.common import as_rows, cut_lineage, filter_bits, flag_members, fresh_path, membership_filter, table

#: Memtables that a batch is dealt to, and runs of a level that are merged into one of the next.
MEMTABLES, FANOUT = 4, 4
ENTRY = "digest binary, keep_id bigint, group_size bigint"


def normalised(text: str | Column = "text") -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty. Lone spaces are left alone, which is the same and cheaper."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Run:
    """A run's folder with its filter, the filter's bits, and the folder of its entries, which runs written together have beside each other."""

    path: str
    bits: int
    entries: str


class DigestIndex:
    """A log of digests and leveled runs of entries (digest, keep_id, group_size), under a path of the shared folder.

    digest is any function Column -> binary Column; equal digests are only candidates, since hits are
    verified on their bytes. A batch is flushed as `memtables` runs.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest=sha256, memtables: int = MEMTABLES, fanout: int = FANOUT):
        self.spark, self.digest, self.memtables, self.fanout = spark, digest, memtables, fanout
        self.path = path or fresh_path(spark, "digests")
        self.logs: list[str] = []
        self.levels: list[list[Run]] = [[]]
        self.made = 0

    def keyed(self, docs: DataFrame) -> DataFrame:
        text = normalised()
        return docs.select("doc_id", self.digest(text).alias("digest"), text.alias("_text"))

    def flush(self, docs: DataFrame) -> DataFrame:
        """Take docs in; the hits: digests that repeat within docs, or that the index had before."""
        log = f"{self.path}/log-{len(self.logs)}"
        dealt = F.pmod(F.spark_partition_id(), F.lit(self.memtables)).alias("memtable")
        self.keyed(docs).select("digest", "doc_id", dealt).write.partitionBy("memtable").parquet(log)
        self.logs.append(log)
        entries = self._log(log).groupBy("memtable", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        hits = [self.entries().select("digest")]
        for run in self._write(entries, 0):
            own = self.entries(run)
            hits.append(own.where("group_size > 1").select("digest"))
            hits += [self.probe(own, older) for level in self.levels for older in level]
            self.levels[0].append(run)
            self._merge_full_levels()
        return cut_lineage(reduce(DataFrame.unionByName, hits).distinct())

    def probe(self, entries: DataFrame, run: Run) -> DataFrame:
        """The digests of entries that a run has. Entries that the run's filter does not know are not looked up."""
        known = flag_members(entries.select("digest"), "digest", self.spark.read.parquet(f"{run.path}/filter"), bits=run.bits).where("_maybe")
        return known.join(self.entries(run).select("digest"), "digest", "left_semi").select("digest")

    def entries(self, *runs: Run) -> DataFrame:
        """Entries of these runs."""
        paths = [r.entries for r in runs]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def _write(self, entries: DataFrame, level: int) -> list[Run]:
        """A run of a level for each memtable of entries, all in one pass: each file a range of digests, in order, beside its filter."""
        folder = f"{self.path}/level-{level}/entries-{self.made}"
        order = ["memtable", "digest"]
        entries.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("memtable").parquet(folder)
        written = self.spark.read.schema(f"{ENTRY}, memtable int").parquet(folder)
        runs = []
        for k, n in sorted((r["memtable"], r["count"]) for r in written.groupBy("memtable").count().collect()):
            run = Run(f"{self.path}/level-{level}/run-{self.made}", filter_bits(n), f"{folder}/memtable={k}")
            membership_filter(self.entries(run), "digest", run.bits).write.parquet(f"{run.path}/filter")
            runs.append(run)
            self.made += 1
        return runs

    def _merged(self, runs: list[Run]) -> DataFrame:
        return self.entries(*runs).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).withColumn("memtable", F.lit(0))

    def _merge_full_levels(self) -> None:
        for k, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1] += self._write(self._merged(runs), k + 1)
                self.levels[k] = []

    def compact(self) -> DataFrame:
        """Merge all runs into one of the last level; its entries of digests that were seen more than once."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            depth = len(self.levels)
            runs = self._write(self._merged(runs), depth)
            self.levels = [[] for _ in range(depth)] + [runs]
        return (self.entries(*runs) if runs else self.spark.createDataFrame([], ENTRY)).where("group_size > 1")

    def _log(self, *logs: str) -> DataFrame:
        read = self.spark.read.schema("digest binary, doc_id bigint, memtable int")
        return reduce(DataFrame.unionByName, [read.parquet(x) for x in logs])

    def runs(self, *logs: str) -> DataFrame:
        """(digest, doc_id) of all rows that were flushed, or of these logs."""
        return self._log(*(logs or self.logs)).select("digest", "doc_id")

    def seen(self, digests: list[bytes]) -> DataFrame:
        """Entries with one of these digests, over all runs; ranges and filters spare most files."""
        wanted = [bytearray(d) for d in digests]
        runs = [r for level in self.levels for r in level]
        return self._merged(runs).drop("memtable").where(F.col("digest").isin(wanted)) if runs else self.spark.createDataFrame([], ENTRY)


def _groups(docs: DataFrame, index: DigestIndex, earlier: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Verified groups (digest, keep_id, group_size, variants), and the flagged rows with their texts; _own are those of docs."""
    hits = index.flush(docs)
    bits = filter_bits(hits.count())
    texts = index.keyed(docs).withColumn("_own", F.lit(True))
    if earlier is not None:
        texts = texts.unionByName(index.keyed(earlier).withColumn("_own", F.lit(False)))
    flagged = flag_members(texts, "digest", membership_filter(hits, "digest", bits), bits=bits).where("_maybe").drop("_maybe")
    # grouping by the text itself is the byte verification; copies combine before the shuffle
    verified = flagged.groupBy("digest", "_text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("_text")
    groups = verified.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count(F.lit(1)).alias("variants"))
    return cut_lineage(groups.where("variants > 1 or group_size > 1")), flagged


def _split_texts(groups: DataFrame, flagged: DataFrame) -> DataFrame | None:
    """(doc_id, digest, keep_id, group_size) where one digest has several texts; None if no digest has."""
    mixed = groups.where("variants > 1").select("digest")
    if mixed.isEmpty():
        return None
    rows = flagged.join(mixed, "digest", "left_semi").select("doc_id", "digest", "_text", "_own")
    each = rows.groupBy("digest", "_text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.where("_own").join(each, ["digest", "_text"]).drop("_text", "_own")


def duplicate_groups(docs: DataFrame, index: DigestIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of docs(doc_id, text, ...).

    Texts are equal if identical after each run of [\\x20\\x09-\\x0D] is one space; null counts as
    empty, and so all empty texts are one group. The smallest doc_id of a group is kept. Rows
    that repeat a doc_id count in group_size and, if their texts are equal, are one document: all of them are marked alike.
    A null doc_id is kept only if no row of its group has an identifier. Other columns are ignored.
    With an index that has taken in batches before, `earlier` is all of their rows, whose texts hits are verified on,
    and which count in keep_id and group_size; without it, only docs are compared with each other.
    """
    index = index or DigestIndex(docs.sparkSession)
    groups, flagged = _groups(docs, index, earlier)
    apart = _split_texts(groups, flagged)
    single = groups.where("variants = 1").select("digest", "keep_id", "group_size")
    rows = index.runs(index.logs[-1])
    if apart is not None:
        rows = rows.join(groups.where("variants > 1").select("digest"), "digest", "left_anti")
    out = rows.join(single, "digest", "left").withColumn("keep_id", F.coalesce("keep_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint")))
    if apart is not None:
        out = out.unionByName(apart)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """docs, all columns, without the rows that duplicate_groups() does not keep. Only texts of hits are shuffled.

    What goes is told by doc_id and text together: a row that repeats an id with a text of its own stays. Rows without
    an id go if their text has a row that stays.
    """
    index = index or DigestIndex(docs.sparkSession)
    groups, flagged = _groups(docs, index, earlier)
    mixed = groups.where("variants > 1").select("digest")
    single = groups.where("variants = 1").select("digest", "keep_id")
    # with several texts to a digest, its rows are told apart by another digest, of 512 bits
    exact = F.sha2(F.col("_text"), 512)
    found = flagged.join(mixed, "digest", "left_semi")
    several = found.join(found.groupBy("digest", "_text").agg(F.min("doc_id").alias("keep_id")), ["digest", "_text"]).where("_own and not doc_id <=> keep_id").select("doc_id", exact.alias("text"))
    lone = flagged.where("_own").join(single, "digest").where("not doc_id <=> keep_id").select("doc_id", exact.alias("text"))
    gone = cut_lineage(lone.unionByName(several).distinct().select(F.xxhash64("doc_id").alias("_id"), F.col("doc_id").alias("_gone"), F.col("text").alias("_gone_text")))
    bits = filter_bits(gone.count())
    marked = flag_members(as_rows(docs, "doc_id").withColumn("_id", F.xxhash64("_key")), "_id", membership_filter(gone, "_id", bits), bits=bits)
    checked = marked.where("_maybe").withColumn("_exact", F.sha2(normalised("_row.text"), 512))
    checked = checked.join(gone.drop("_id"), F.col("_key").eqNullSafe(F.col("_gone")) & (F.col("_exact") == F.col("_gone_text")), "left_anti")
    return marked.where("not _maybe").select("_row.*").unionByName(checked.select("_row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = duplicate_groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
