"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; docs has
the columns of documents, and so has what each stage but the last returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from objwatch.llm import exact_dedup, jaccard, mixing, packing, quality
from objwatch.llm.common import fresh_path, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least one half; the rest go.

    Null and empty texts are scored as the empty text. Repeated rows are scored alike and stay or go together; a null
    doc_id changes nothing. Without any label, all scores are one half, so all stay. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").where("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1, true)")
    model = quality.train(docs, labels)
    return quality.score(docs, model).where("score >= 0.5").select(docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id.

    Null counts as empty. Rows that repeat a doc_id and a text are one document and stay or go together; one that repeats
    only the doc_id stays. Rows without a doc_id go if their text has a row with one; else all of them stay.
    """
    return exact_dedup.drop_duplicates(docs)


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, over any number of steps, the one with the smallest doc_id.

    Null, empty and blank texts have no shingles and are like nothing. Rows without a doc_id stay.
    """
    return jaccard.drop_near_duplicates(docs, jaccard.Join(n=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix of sources in which none is read more than one and a half times as often as the largest, which is read once.

    No document is left out; those that are taken twice are in the result twice. Null is a source of its own; null and
    empty texts count as they are. Repeated rows are taken each.
    """
    return mixing.Mix(repetition=1.5).realise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens.

    A null or empty text is one piece of one token. Repeated rows, and rows without a doc_id, are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_distinct),
    ("n-gram Jaccard join", keep_dissimilar),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier and the tokeniser have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
