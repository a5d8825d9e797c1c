"""Temperature mixing of sources (DataFrame functions only).

A source's weight is its token share to a power, normalised. The exponent lies between 1 (as the
corpus is) and 0 (all sources alike) and is bisected: to the flattest mix in which no source is
repeated more than a limit allows, or to the least change that reaches an entropy. Weights are realised
on the documents: the budget gives each source a number of epochs, whole ones and a part of
one. In each epoch a source's documents are dealt to blocks by a hash; a part of an epoch is
the first blocks, and of the last one the first documents, that fit into the token budget.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objwatch.llm.common import as_rows, cut_lineage, flag_members, membership_filter, table

SPACE = r"[\x20\x09-\x0D]+"
#: Documents of a block, about.
BLOCK_DOCS = 1024
#: Blocks that are added up together.
BLOCK_GROUP = 1024
STEPS = 50


def n_words(text: str = "text") -> Column:
    """Words of a text, which are its tokens here."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), SPACE, -1)
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("bigint")


def order_key(seed: int, epoch: Column) -> Column:
    """A number below 2^60 by which an epoch orders documents; the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Mix:
    """repetition: the most epochs of any source, where the largest source has one; or entropy: the target, in nats.

    budget_tokens: the tokens of the mix; by default as many as give the largest source one epoch, so
    that no document is left out. With entropy None, the repetition limit decides the exponent.
    """

    repetition: float = 1.5
    entropy: float | None = None
    budget_tokens: float | None = None
    seed: int = 11

    def exponent(self, each: DataFrame, top: float, low: float) -> float:
        """The exponent that meets the target, for sources with tokens between low and top."""
        if self.entropy is None:
            # the smallest source's epochs decide, whatever lies between
            def step(acc: Column, _: Column) -> Column:
                mid = (acc["lo"] + acc["hi"]) / 2
                flatter = F.pow(F.lit(low) / F.lit(top), mid - 1) <= self.repetition  # within the limit: try flatter yet
                return F.struct(F.when(flatter, acc["lo"]).otherwise(mid).alias("lo"), F.when(flatter, mid).otherwise(acc["hi"]).alias("hi"))

            start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
            found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["hi"])
            return each.sparkSession.range(1).select(found).first()[0]
        lo, hi = 0.0, 1.0
        for _ in range(-(-STEPS // 4)):  # four bits of the exponent with each pass over the sources
            mids = [lo + (hi - lo) * k / 16 for k in range(1, 16)]
            share = [F.pow(F.col("tokens") / F.lit(top), F.lit(m)) for m in mids]
            sums = each.where("tokens > 0").agg(*[F.sum(x) for x in share], *[F.sum(x * F.log(x)) for x in share]).first()
            entropies = [math.log(sums[k]) - sums[15 + k] / sums[k] for k in range(15)]
            least = next((k for k, e in enumerate(entropies) if e < self.entropy), 15)  # entropy falls as the exponent grows
            lo, hi = ([lo, *mids][least], [*mids, hi][least])
        return lo

    def sources(self, rows: DataFrame) -> DataFrame:
        """(source, tokens, docs, exponent, weight, epochs) of rows(source, tokens). Sources are only added up: there may be any number."""
        each = cut_lineage(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
        ends = each.where("tokens > 0").agg(F.max("tokens"), F.min("tokens")).first()
        top, low = (float(x or 1) for x in ends)
        exponent = self.exponent(each, top, low)
        share = F.pow(F.col("tokens") / F.lit(top), F.lit(exponent))
        z = each.where("tokens > 0").agg(F.sum(share)).first()[0] or 1.0
        weight = F.when(F.col("tokens") > 0, share / F.lit(z)).otherwise(0.0)
        # without tokens a source costs no budget: its documents are taken once
        if self.budget_tokens is None:
            epochs = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(top), F.lit(exponent) - 1)).otherwise(1.0)
        else:
            epochs = F.when(F.col("tokens") > 0, F.lit(float(self.budget_tokens)) * share / F.lit(z) / F.col("tokens")).otherwise(1.0)
        return each.withColumn("exponent", F.lit(exponent)).withColumn("weight", weight).withColumn("epochs", epochs)

    def rows(self, docs: DataFrame) -> DataFrame:
        """(doc_id, source, tokens, epoch, block, key): each taking of a document; epochs are to be read in order of block, then key.

        docs has doc_id, text, source. A null source is a source of its own. Null and empty texts have no
        tokens and cost no budget. Ties of key go by doc_id. Rows that repeat a doc_id are taken
        each for itself, next to each other. An empty table gives no rows. Other columns are ignored.
        """
        rows = cut_lineage(docs.select("doc_id", "source", n_words().alias("tokens")))
        sources = cut_lineage(self.sources(rows).select(F.col("source").alias("s"), "docs", "epochs", F.col("tokens").alias("of")))
        whole = F.floor("epochs").cast("int")
        known = rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("whole", whole).withColumn("part", F.floor((F.col("epochs") - F.col("whole")) * F.col("of")).cast("bigint"))

        def block(epoch: Column) -> Column:
            return F.pmod(order_key(self.seed + 1, epoch), F.floor(F.col("docs") / BLOCK_DOCS) + 1).cast("int")

        kept = ["doc_id", "source", "tokens", "epoch", "block", "key"]
        full = known.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
        full = full.withColumn("block", block(F.col("epoch"))).withColumn("key", order_key(self.seed, F.col("epoch"))).select(kept)
        last = known.where("part > 0").withColumn("epoch", F.col("whole")).withColumn("block", block(F.col("epoch"))).withColumn("key", order_key(self.seed, F.col("epoch")))
        sums = last.groupBy("source", "block").agg(F.sum("tokens").alias("in_block"), F.first("part").alias("part"))
        # in two levels, so that a window has thousands of blocks at most: groups of blocks, and blocks in a group
        sums = sums.withColumn("group", F.floor(F.col("block") / BLOCK_GROUP))
        upto = lambda column, *keys: F.coalesce(F.sum(column).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = sums.groupBy("source", "group").agg(F.sum("in_block").alias("in_group"))
        groups = groups.select(F.col("source").alias("s3"), F.col("group").alias("g3"), upto("in_group", "source", "group").alias("before"))
        sums = sums.withColumn("own", upto("in_block", "source", "group", "block")).join(groups, F.col("source").eqNullSafe(F.col("s3")) & (F.col("group") == F.col("g3")))
        sums = sums.withColumn("room", F.col("part") - F.col("before") - F.col("own")).where("room > 0").select(F.col("source").alias("s2"), F.col("block").alias("b2"), "in_block", "room")
        cut = last.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
        inside = cut.where("in_block <= room").select(kept)
        run = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        edge = cut.where("in_block > room").withColumn("run", run).where("run <= room").select(kept)  # one block of a source
        return full.unionByName(inside).unionByName(edge)

    def realise(self, docs: DataFrame) -> DataFrame:
        """docs, all columns, each row as often as rows() takes its doc_id; only rows taken not once are shuffled."""
        taken = self.rows(docs).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("_n"))
        there = docs.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("_rows"))
        copies = there.join(taken, there["doc_id"].eqNullSafe(taken["doc_id"]) & there["source"].eqNullSafe(taken["source"]), "left").select(there["doc_id"].alias("_id"), there["source"].alias("_source"), F.floor(F.coalesce("_n", F.lit(0)) / F.col("_rows")).cast("int").alias("_n"))
        copies = cut_lineage(copies.where("_n <> 1"))
        flagged = flag_members(as_rows(docs, "doc_id", "source"), "_key0", membership_filter(copies, "_id", 1 << 24), bits=1 << 24)
        passed = flagged.where("not _maybe").select("_row.*")
        checked = flagged.where("_maybe").join(copies, F.col("_key0").eqNullSafe(F.col("_id")) & F.col("_key1").eqNullSafe(F.col("_source")), "left")
        checked = checked.withColumn("_n", F.coalesce("_n", F.lit(1))).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
        return passed.unionByName(checked)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix().rows(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE rows0 AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tokens FROM documents
), src AS (
  SELECT source, sum(tokens)::BIGINT AS of_, count(*) AS docs FROM rows0 GROUP BY source
), ends AS (
  SELECT min(of_)::DOUBLE / max(of_) AS ratio, max(of_)::DOUBLE AS top FROM src WHERE of_ > 0
), b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(ratio, (lo + hi) / 2 - 1) <= 1.5 THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(ratio, (lo + hi) / 2 - 1) <= 1.5 THEN (lo + hi) / 2 ELSE hi END
  FROM b, ends WHERE i < 50
), mix AS (
  SELECT source, docs, of_, CASE WHEN of_ > 0 THEN pow(of_ / top, hi - 1) ELSE 1.0 END AS epochs FROM src, ends, b WHERE i = 50
), known AS (
  SELECT r.*, m.docs, floor(m.epochs)::INT AS whole, floor((m.epochs - floor(m.epochs)) * m.of_)::BIGINT AS part
  FROM rows0 r JOIN mix m ON r.source IS NOT DISTINCT FROM m.source
), taken AS (
  SELECT doc_id, source, tokens, docs, part, unnest(range(whole)) AS epoch, whole FROM known
  UNION ALL
  SELECT doc_id, source, tokens, docs, part, whole, whole FROM known WHERE part > 0
), dealt AS (
  SELECT *, (('0x' || substr(md5('12:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % (docs // 1024 + 1))::INT AS block,
         ('0x' || substr(md5('11:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM taken
), summed AS (
  SELECT source, block, sum(tokens) AS in_block, min(part) AS part FROM dealt WHERE epoch = whole GROUP BY source, block
), rooms AS (
  SELECT source, block, in_block, part - sum(in_block) OVER (PARTITION BY source ORDER BY block) + in_block AS room FROM summed
), cut AS (
  SELECT d.*, in_block, room, sum(d.tokens) OVER (PARTITION BY d.source, d.block ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM dealt d JOIN rooms r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block WHERE d.epoch = d.whole AND room > 0
)
SELECT doc_id, source, tokens, epoch::INT AS epoch, block, key FROM dealt WHERE epoch < whole
UNION ALL
SELECT doc_id, source, tokens, epoch::INT, block, key FROM cut WHERE in_block <= room OR run <= room
"""
