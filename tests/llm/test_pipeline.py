"""The pipeline, stage by stage, against plain versions."""

import pyarrow.dataset as ds
import pytest
from brute import components, normal

import corpus_pipeline
from objwatch.llm import packing
from objwatch.llm.common import fresh_path, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, as pandas, the input first."""
    docs = table(spark, SF, "documents")
    out = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = fresh_path(spark, f"test{k}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_all_but_the_last_have_the_columns_of_documents(stages):
    assert len(stages) == 6
    for s in stages[:5]:
        assert list(s.columns) == list(stages[0].columns)


def test_quality_keeps_good_documents(stages):
    labels = ds.dataset(f"{SF}/labels.parquet").to_table().to_pandas()
    kept = labels.doc_id.isin(stages[1].doc_id)
    assert kept[labels.quality == 1].mean() >= 0.95 and kept[labels.quality == 0].mean() <= 0.3
    assert stages[1].merge(stages[0], on=list(stages[0].columns)).shape == stages[1].shape


def test_duplicates_go(stages):
    first = stages[1].assign(t=stages[1].text.map(normal)).groupby("t").doc_id.min()
    assert sorted(stages[2].doc_id) == sorted(first)
    found = components(list(zip(stages[2].doc_id, stages[2].text, strict=True)), 5, 80)
    assert sorted(stages[3].doc_id) == sorted(i for i, c in found.items() if i == c)


def test_mixing_leaves_none_out(stages):
    assert set(stages[4].doc_id) == set(stages[3].doc_id) and stages[4].groupby("doc_id").size().max() <= 2
    assert len(stages[4]) > len(stages[3])


def test_all_is_packed(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in stages[4].text)
    assert stages[5].length.sum() == want and stages[5].groupby("sequence_id").length.sum().max() <= 2048


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[5])


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and blank texts, repeated rows, ids that repeat, a long text, and columns with names of the operators' own."""
    long = " ".join(f"word{i}" for i in range(30_000)) + "."
    good = [f"Some good sentence number {i} with words enough, and another part of it." for i in range(6)]
    rows = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, " \n", None, "a"), (4, long, "en", "a"), (5, good[0], "en", "b"), (5, good[0], "en", "b"), (6, good[0], "en", "a"), (6, good[1], "en", "a"), (None, good[2], "en", "a"), (None, good[2], "en", "a")]
    docs = spark.createDataFrame([(*r, 0, 1, 2, 3) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, _maybe int, digest int")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "odd")
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    for f in frames[1:5]:
        assert f.columns == docs.columns
    distinct = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_distinct(spark, docs, SF).collect()), key=str)
    assert distinct == sorted([(1, None), (3, " \n"), (4, long), (5, good[0]), (5, good[0]), (6, good[1]), (None, good[2]), (None, good[2])], key=str)
    apart = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_dissimilar(spark, docs, SF).collect()), key=str)
    assert apart == sorted([r[:2] for r in rows if r[:2] != (6, good[0])], key=str)
    assert corpus_pipeline.mix_sources(spark, docs, SF).count() >= len(rows)
    assert {r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()} == {r[0] for r in rows}
    assert corpus_pipeline.pack_sequences(spark, docs, SF).where("piece = 0").count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
