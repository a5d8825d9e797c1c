"""Substring dedup by sliding sentence spans.

Every run of SPAN consecutive sentences is hashed, over the whole corpus. Of equal spans, the
first by (doc_id, position) stays; sentences that any other one covers are removed. A long sentence
counts as several: it is parted at commas and the like, and, where there are none, at words whose last
letter says so, which parts equal wording alike wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from objwatch.llm.common import cut_lineage, filter_bits, flag_members, map_batches, membership_filter, table
from objwatch.llm.rolling import mixed, powers

#: A sentence ends with a line, after . ! ? and what closes it where white space follows, or after a full stop of scripts
#: that set no space; it owns the white space after it.
SENTENCE = re.compile(r"[^\n.!?。．！？｡।。]*(?:[.!?]+(?!\s|$)[^\n.!?。．！？｡।。]*)*(?:[。．！？｡।。]+[”’」』）)]*\s*|[.!?]+\s*|\n\s*|$)")
#: Parts of a sentence of LONG words or more: 10 to 40 words up to one that ends in a mark or one of some letters, or else 40, or the rest.
LONG = 24
PART = re.compile(r"(?:\S+\s+){9,39}?\S*[,;:dgmwy]\s+|(?:\S+\s+){40}|\S[\s\S]*|\s+")
#: Letters of scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han): two of them count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")


def sentences(text: str | None) -> list[str]:
    """Parts of text that, joined, are the text."""
    out: list[str] = []
    for s in SENTENCE.findall(text or ""):
        if s.count(" ") >= LONG:
            out += PART.findall(s)
        elif s:
            out.append(s)
    return out


def word_count(sentence: str, words: list[str]) -> int:
    return len(words) if sentence.isascii() else len(words) + len(UNSPACED.findall(sentence)) // 2


#: Hot hashes are those of more than one in so many rows; how many keys their rows are dealt to.
HOT, SALTS = 1000, 64


@dataclass(frozen=True)
class SpanDedup:
    """span: sentences of a run. min_words: shorter runs are extended until they have so many words.

    Lengthening a run that is all short sentences ("Yes. No. Why?") keeps chance repeats from counting. With long_words,
    a sentence of so many words is a run by itself; without it, as by default, a run has span sentences at least.
    """

    span: int = 2
    min_words: int = 20
    long_words: int | None = None

    def runs(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first, end and two 64-bit hashes of each run: from every sentence on, the shortest that is long enough; and up to every sentence."""
        words = [s.split() for s in parts]
        real = np.array([i for i, w in enumerate(words) if w], np.int64)  # blank parts belong to no run
        n = len(real)
        if not n:
            return real[:0], real[:0], np.zeros((0, 2), np.int64)
        digests = b"".join(xxhash.xxh3_128_digest(" ".join(words[i]).lower().encode()) for i in real)
        count = np.cumsum([0, *(word_count(parts[i], words[i]) for i in real)])
        at = np.arange(n)
        on = np.maximum(at + self.span, np.searchsorted(count, count[:-1] + self.min_words))
        back = np.minimum(at + 1 - self.span, np.searchsorted(count, count[1:] - self.min_words, "right") - 1)
        alone = at[np.diff(count) >= self.long_words] if self.long_words else at[:0]
        pairs = np.unique(np.concatenate([(at * (n + 1) + on)[on <= n], (back * (n + 1) + at + 1)[back >= 0], alone * (n + 1) + alone + 1]))
        a, b = pairs // (n + 1), pairs % (n + 1)
        up, down = powers(n + 1)
        sums = np.zeros((n + 1, 2), np.uint64)
        np.cumsum(np.frombuffer(digests, np.uint64).reshape(-1, 2) * up[:n, None], axis=0, out=sums[1:])
        h = mixed((sums[b] - sums[a]) * down[a][:, None] + (b - a)[:, None].astype(np.uint64))
        return real[a], real[b - 1] + 1, h.view(np.int64)

    def spans(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, first, end, h0, h1): the runs of all texts. doc_id and digest, a hash of the text, tell rows apart."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    found = [self.runs(sentences(t)) for t in part["text"].to_pylist()]
                    per = [len(a) for a, _, _ in found]
                    ids, digests = (np.repeat(part[c].to_numpy(), per) for c in ("doc_id", "digest"))
                    first, end, h = (np.concatenate([x[k] for x in found]) for k in range(3))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(digests), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "digest", "first", "end", "h0", "h1"])

        named = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("digest"), "text")
        return map_batches(named, run, "doc_id bigint, digest bigint, first int, end int, h0 bigint, h1 bigint")

    def covered(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, covered): for texts with a repeat that is not the first, the ranges [first, end) of sentences to remove."""
        place = F.expr("cast(doc_id as decimal(20, 0)) * 4294967296BD + first")  # one number, so that the least is found where the rows are
        marked = self.spans(docs)
        counts = marked.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keep")).where("n > 1")
        counts = cut_lineage(counts)
        size, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        bits = filter_bits(size)
        maybe = flag_members(marked, "h0", membership_filter(counts, "h0", bits), bits=bits).where("_maybe").drop("_maybe")
        # a hash of over a thousandth of all repeats is hot, and fewer than that: its rows are dealt to SALTS keys
        hot = F.broadcast(counts.where(F.col("n") * HOT > (total or 0)).select(F.col("h0").alias("_h0"), F.col("h1").alias("_h1"), F.lit(SALTS).alias("_salts")))
        is_hot = (F.col("h0") == F.col("_h0")) & (F.col("h1") == F.col("_h1"))
        dealt = counts.join(hot, is_hot, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).select("h0", "h1", "_salt", "keep")
        salted = maybe.join(hot, is_hot, "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "digest", "first"), F.coalesce("_salts", F.lit(1))).cast("int"))
        gone = salted.join(dealt, ["h0", "h1", "_salt"]).where(place != F.col("keep"))
        return gone.select("doc_id", "digest", F.struct("first", "end").alias("range")).groupBy("doc_id", "digest").agg(F.collect_set("range").alias("covered"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with repeats cut out of text, and columns n_sentences, n_removed.

        Sentences compare without regard to case and to how white space is written. Null and empty texts
        stay as they are and count no sentence. Of equal texts, the first keeps its sentences and the
        others lose all that a run covers; a text of less than a run is never changed. doc_id and text together
        identify a document: rows that repeat both are one document and are changed alike. Rows
        without doc_id are not looked at. Columns n_sentences and n_removed of docs are replaced. A text within which a run repeats loses the later ones.
        """
        covered = cut_lineage(self.covered(docs))
        bits = filter_bits(covered.count())
        keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        flagged = flag_members(keyed, "_digest", membership_filter(covered, "digest", bits), bits=bits)
        kept = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
        own = [F.col(f"_row.`{c}`").alias(c) for c in kept]
        passed = flagged.where("not _maybe").select(*own, F.expr("cast(null as array<struct<first:int, end:int>>)").alias("_covered"))
        ranges = covered.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("covered").alias("_covered"))
        checked = flagged.where("_maybe").join(ranges, ["_id", "_digest"], "left").select(*own, "_covered")
        schema = StructType([*(f for f in docs.schema.fields if f.name in kept), StructField("n_sentences", LongType()), StructField("n_removed", LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts, total, removed = [], [], []
                    for text, ranges in zip(part["text"].to_pylist(), part["_covered"].to_pylist(), strict=True):
                        parts = sentences(text)
                        stay = np.ones(len(parts), bool)
                        for r in ranges or []:
                            stay[r["first"] : r["end"]] = False
                        texts.append("".join(s for s, k in zip(parts, stay, strict=True) if k) if ranges else text)
                        total.append(len(parts))
                        removed.append(int((~stay).sum()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if c == "text" else part[c] for c in kept), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*kept, "n_sentences", "n_removed"])

        return map_batches(passed.unionByName(checked), run, schema)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SpanDedup().clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
