"""Binary pieces against the tokenizer on whole texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from objwatch.llm import decompose, packing


def corpus():
    r = random.Random(3)
    words = ["alpha", "Beta", "x1", "don't", "é", "中文", "a-b", "\n", "longerword"]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 60, 700, 2046, 2047, 2048, 2049, 9000)]
    return [(i, t) for i, t in enumerate([*texts, None, texts[4]])] + [(None, texts[5]), (3, texts[3]), (3, "other")]


@pytest.mark.parametrize("longest", [2048, 16, 1])
def test_pieces_are_the_ids_of_whole_texts(spark, longest):
    rows = corpus()
    if longest == 1:
        rows = [x for x in rows if len(x[1] or "") < 50]
    df = spark.createDataFrame([(i, t, "c", 7, 8) for i, t in rows], "doc_id bigint, text string, length string, _part int, bucket int").repartition(3)
    got = decompose.decompose(df, longest=longest).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at, lengths = 0, [longest] * (len(ids) // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if len(ids) % longest >> b & 1]
        for n in lengths:
            want.append((-1 if i is None else i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids), n.bit_length() - 1, 0))
            at += n
        assert at == len(ids)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["bucket"], r["offset"]) for r in got) == sorted(want)
    # sequences are numbered without gaps, bucket by bucket
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])] == sorted((r["length"] for r in got), reverse=True)


def test_cuts_of_many_sizes():
    sizes = np.arange(1, 5000)
    doc, start, length = decompose.binary_cuts(sizes)
    assert (np.bincount(doc, length).astype(int)[: len(sizes)] == sizes).all()
    for d in (0, 2046, 2047, 4998):
        mine = doc == d
        assert list(start[mine]) == list(np.cumsum(length[mine]) - length[mine]) and sorted(length[mine], reverse=True) == list(length[mine])
        assert len(set(length[mine]) - {2048}) == (length[mine] < 2048).sum()


def test_batches_have_one_length(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    got = decompose.batches(decompose.decompose(df), 4096).groupBy("batch").agg(F.countDistinct("length").alias("lengths"), F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r["lengths"] == 1 and r["tokens"] <= 4096 and r["n"] == r["rows"] for r in got)
    by_bucket = {}
    for r in got:
        by_bucket.setdefault(r["batch"]["bucket"], []).append(r["tokens"])
    assert all(sorted(x)[1:] == [4096] * (len(x) - 1) for x in by_bucket.values())


def test_nothing_to_cut(spark):
    assert decompose.decompose(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        decompose.decompose(spark.createDataFrame([], "doc_id bigint, text string"), longest=12)
