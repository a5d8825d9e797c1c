"""How document filters interact: what each removes, alone and in every order.

Filters are conditions on one text, and being a copy of a smaller doc_id's text, which tries tell (tries.py). All that orders
can show depends on how many documents fail which filters: 32 numbers for each part. So documents are reduced to masks
first, and orders are looked at afterwards.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objwatch.llm.common import table
from objwatch.llm.tries import flag_copies

WHITE = "[\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: A letter's bit in masks.
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}


def text_failures(text: Column) -> dict[str, Column]:
    """The filters on a text by itself: few words, repeated words, capitals, symbols. text is not null."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame) -> DataFrame:
    """(key, part, payload, text): the mask of the filters that each text of docs(doc_id, source, text, ...) fails by itself. Null text and null source count as empty."""
    given = docs.select(F.col("doc_id").alias("key"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = sum((F.when(bad, BIT[f]).otherwise(0) for f, bad in text_failures(F.col("text")).items()), F.lit(0))
    return given.select("key", "part", mask.alias("payload"), "text")


def label_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail the filters of mask, and how many of them have those labels.

    A document is good (toxic) if any row of labels with its doc_id says so. Rows that repeat a doc_id and a text are no copies of each
    other; a row without a doc_id has no labels, and is neither a copy nor copied from. Both sides are added up before the join, so one id or
    part may have any share of the rows.
    """
    flagged = flag_copies(masks(docs))
    mask = F.col("payload") + F.when(F.col("copy"), BIT["E"]).otherwise(0)
    rows = flagged.groupBy(F.col("key").alias("doc_id"), "part", mask.alias("mask")).agg(F.sum("n").alias("n"))
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_of")).agg(said("quality"), said("toxic"))
    known = rows.join(marks, F.col("doc_id") == F.col("_of"), "left")
    held = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0))
    return known.groupBy("part", "mask").agg(F.sum("n").alias("n"), held("quality").alias("good"), held("toxic").alias("toxic"))


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order of filters and step, from (part, mask, n, good, toxic). A part's 32 numbers stand in one row, and orders are looked at there."""
    hist = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("hist"))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(BIT[o[k]]).alias("own"), F.lit(sum(BIT[f] for f in o[:k])).alias("before")) for o in ORDERS for k in range(5)])
    rows = hist.withColumn("_at", F.explode(steps)).select("part", "hist", "_at.*")

    def total(what: str, keep) -> Column:
        return F.aggregate("hist", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(keep(x["mask"]), x[what]).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    earlier = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~earlier(m)
    # of the 120 orders, each filter that a document fails comes first of them in the same number
    shapley = F.aggregate("hist", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(fails(x["mask"]), x["n"] * F.call_function("div", F.lit(len(ORDERS)), F.bit_count(x["mask"]))).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total("n", here).alias("removed"), total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters over docs(doc_id, source, text, ...), by source. An empty table gives no rows."""
    return interactions(label_counts(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
f AS (SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
 + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
 + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a JOIN x b ON b.f <> a.f JOIN x c ON c.f NOT IN (a.f, b.f) JOIN x d ON d.f NOT IN (a.f, b.f, c.f) JOIN x e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) r(k)),
h AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM h"""
