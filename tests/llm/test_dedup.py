"""Exact dedup, the n-gram Jaccard join and substring dedup against plain versions."""

import random
from collections import defaultdict

import pytest
from brute import DOCS, components, grams, normal
from pyspark.sql import functions as F

from objwatch.llm import exact_dedup, jaccard, substring
from objwatch.llm.common import table

ODD = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "a\tb"), (6, " "), (7, "b"), (8, "a b "), (None, "a b"), (9, "x" * 200_000), (10, "x" * 200_000), (11, "a b"), (7, "b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def groups_of(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[normal(t)].append(i)
    return out


def check_exact(got, rows):
    want = groups_of(rows)
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str)
    expected = []
    for ids in want.values():
        keep = min((i for i in ids if i is not None), default=None)
        expected += [(i is None, i or 0, keep, len(ids), i == keep) for i in ids]
    assert found == sorted(expected, key=str)


def test_exact_groups(spark):
    check_exact(exact_dedup.duplicate_groups(frame(spark, ODD)).collect(), ODD)


def test_equal_digests_of_other_texts_are_told_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    weak = exact_dedup.DigestIndex(spark, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1).cast("binary"))
    check_exact(exact_dedup.duplicate_groups(frame(spark, rows), weak).collect(), rows)
    weak = exact_dedup.DigestIndex(spark, digest=lambda t: F.lit(b"x"))
    kept = exact_dedup.drop_duplicates(frame(spark, rows), weak)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(7))


def test_index_takes_more_runs(spark):
    index = exact_dedup.DigestIndex(spark)
    index.flush(frame(spark, [(5, "a"), (6, "b")]))
    index.flush(frame(spark, [(2, "a")]))
    assert [(r["keep_id"], r["group_size"]) for r in index.compact().collect()] == [(2, 2)]
    digest = bytes(index.runs().where("doc_id = 6").first()["digest"])
    assert [(r["keep_id"], r["group_size"]) for r in index.seen([digest]).collect()] == [(6, 1)]


def test_a_batch_meets_older_levels(spark, monkeypatch):
    """Batches one after the other: runs move to higher levels, filters are probed, and results are those of all rows so far."""
    r = random.Random(4)
    batches = [[(100 * b + i, f"text {r.randrange(60)}") for i in range(40)] for b in range(5)]
    index = exact_dedup.DigestIndex(spark, memtables=2, fanout=3)
    probed = []
    probe = exact_dedup.DigestIndex.probe
    monkeypatch.setattr(exact_dedup.DigestIndex, "probe", lambda self, entries, run: probed.append(run.path) or probe(self, entries, run))
    before: list = []
    for rows in batches:
        docs = frame(spark, rows).repartition(4, "doc_id")
        got = exact_dedup.duplicate_groups(docs, index, frame(spark, before) if before else None).collect()
        everything = groups_of([*before, *rows])
        want = sorted((i, min(everything[normal(t)]), len(everything[normal(t)]), i == min(everything[normal(t)])) for i, t in rows)
        assert sorted((x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in got) == want
        before += rows
    assert len(index.levels) >= 2 and any("level-1" in p for p in probed)
    new = exact_dedup.DigestIndex(spark).flush(frame(spark, [(1, "a"), (2, "b")]))
    assert new.count() == 0
    for run in (x for level in index.levels for x in level):  # each file has a range of its own, in order
        files = index.entries(run).select("digest", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).collect()
        spans = sorted((min(bytes(x["digest"]) for x in files if x["f"] == f), max(bytes(x["digest"]) for x in files if x["f"] == f)) for f in {x["f"] for x in files})
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(x["group_size"] for x in index.entries(*(x for level in index.levels for x in level)).collect()) == 200


def test_probing_spares_what_no_filter_knows(spark):
    index = exact_dedup.DigestIndex(spark)
    index.flush(frame(spark, [(i, f"old {i}") for i in range(500)]))
    new = index.keyed(frame(spark, [(i, f"new {i}") for i in range(2000)]))
    run = index.levels[-1][0]
    members = spark.read.parquet(f"{run.path}/filter")
    assert exact_dedup.flag_members(new, "digest", members, bits=run.bits).where("_maybe").count() < 100


def test_rows_that_repeat_ids_lose_nothing(spark):
    rows = [(1, "dup"), (2, "dup"), (2, "only here"), (None, "dup"), (None, "alone"), (None, "alone"), (3, None)]
    kept = sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, "dup"), (2, "only here"), (None, "alone"), (None, "alone"), (3, None)], key=str)
    weak = exact_dedup.DigestIndex(spark, digest=lambda t: F.lit(b"x"))
    assert sorted(((r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(frame(spark, rows), weak).collect()), key=str) == kept


def test_exact_keeps_columns_and_takes_empty_tables(spark):
    docs = frame(spark, ODD[:8]).withColumn("digest", F.lit(1)).withColumn("_maybe", F.lit(2)).withColumn("keep_id", F.lit(3))
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 8]
    assert exact_dedup.duplicate_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(frame(spark, [])).count() == 0


def near_copies(seed, n=60, words=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    out, common = [], [r.choice(vocabulary) for _ in range(12)]
    for i in range(n):
        if out and r.random() < 0.6:
            t = r.choice(out)[1].split()
            for _ in range(r.randrange(3)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
        else:
            t = [r.choice(vocabulary) for _ in range(r.randrange(1, words))] + (common if r.random() < 0.5 else [])
        out.append((i * 3 + 1, " ".join(t)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 2, 50), (3, 5, 80), (4, 1, 60)])
def test_components(spark, seed, n, percent):
    rows = [*near_copies(seed), (500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one TWO"), (505, "one")]
    want = components(rows, n, percent)
    got = jaccard.Join(n, percent).components(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(grams(t, n)) for i, t in rows}


def test_members_of_a_bucket_that_are_not_like_its_smallest_are_found(spark):
    """2 and 3 are alike, share n-grams with 1, and neither is like 1."""
    base = [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(base[:30] + [f"x{i}" for i in range(30)])), (2, " ".join(base)), (3, " ".join([*base[:-1], "other"]))]
    want = components(rows, 1, 90)
    assert want == {1: 1, 2: 2, 3: 2}
    for order in (rows, rows[::-1]):
        assert {r["doc_id"]: r["component_id"] for r in jaccard.Join(1, 90).components(frame(spark, order)).collect()} == want


def test_join_takes_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")]
    got = jaccard.Join().components(frame(spark, rows).withColumn("n", F.lit(0)).withColumn("gram", F.lit(0))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (True, 0, 0)]
    assert jaccard.Join().components(frame(spark, [])).count() == 0
    kept = jaccard.drop_near_duplicates(frame(spark, [(3, "a b c d e f"), (2, "a b c d e f"), (4, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4]


def test_components_of_the_test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.op9_jaccard(spark, sf_dir).collect()} == want


def test_long_chains_have_one_label(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 80)] + [(200, 300)], "a bigint, b bigint")
    got = {r["id"]: r["label"] for r in jaccard.connected(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 81)}, 200: 200, 300: 200}


def plain_spans(rows, dedup):
    """Sentences left of each text."""
    parts = {i: substring.sentences(t) for i, t in rows}
    seen, gone = set(), defaultdict(set)
    for i in sorted(parts):
        words = [p.split() for p in parts[i]]
        real = [k for k, w in enumerate(words) if w]
        runs = set()
        for a in range(len(real)):
            for b in range(a + dedup.span, len(real) + 1):
                if sum(len(words[k]) for k in real[a:b]) >= dedup.min_words:
                    runs.add((a, b))
                    break
        for b in range(len(real), 0, -1):
            for a in range(b - dedup.span, -1, -1):
                if sum(len(words[k]) for k in real[a:b]) >= dedup.min_words:
                    runs.add((a, b))
                    break
        if dedup.long_words:
            runs |= {(a, a + 1) for a in range(len(real)) if len(words[real[a]]) >= dedup.long_words}
        for a, b in sorted(runs):
            key = tuple(" ".join(words[k]).lower() for k in real[a:b])
            if key in seen:
                gone[i].update(range(real[a], real[b - 1] + 1))
            seen.add(key)
    return {i: "".join(p for k, p in enumerate(parts[i]) if k not in gone[i]) for i in parts}


@pytest.mark.parametrize("seed", range(3))
def test_sentence_spans(spark, seed):
    r = random.Random(seed)
    sentence = lambda: " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(1, 9))) + r.choice([". ", "! ", ".\n", "\n", "? "])
    passage = "".join(sentence() for _ in range(8))
    rows = [(i, "".join(sentence() for _ in range(r.randrange(0, 6))) + (passage if i % 3 == 0 else "") + "".join(sentence() for _ in range(3)) + (passage if i == 12 else "")) for i in range(20)]
    dedup = substring.SpanDedup(2, 8, 8)
    got = dedup.clean(frame(spark, rows)).collect()
    assert {x["doc_id"]: x["text"] for x in got} == plain_spans(rows, dedup)
    assert sum(x["n_removed"] for x in got) > 20


def test_sentence_spans_take_odd_rows(spark):
    text = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. Fifteen sixteen seventeen eighteen nineteen twenty and one more word."
    rows = [(3, text), (1, text.upper()), (None, text), (5, None), (6, ""), (7, "\n" * 5000), (8, "a. " * 50_000)]
    docs = frame(spark, rows).withColumn("covered", F.lit(1)).withColumn("n_removed", F.lit("x"))
    got = {r["doc_id"]: r for r in substring.SpanDedup().clean(docs).collect()}
    assert got[1]["text"] == text.upper() and got[3]["text"] == "" and got[None]["text"] == text
    assert got[5]["text"] is None and got[6]["text"] == "" and got[5]["n_sentences"] == 0 and got[3]["n_removed"] == 3 and got[3]["covered"] == 1
    assert substring.SpanDedup().clean(frame(spark, [])).count() == 0


def test_rows_that_repeat_ids_lose_only_repeats(spark):
    """Ranges belong to a text, not to an id: the other row of id 2 repeats nothing and keeps all."""
    text = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen. Fifteen sixteen seventeen eighteen nineteen twenty and one more word."
    other = "Another one with words of its own, which nobody has. And a second sentence that is not anywhere else. And a third one of these."
    got = substring.SpanDedup().clean(frame(spark, [(1, text), (2, text), (2, other), (None, other)])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, text), (2, ""), (2, other), (None, other)], key=str)


def test_passages_in_long_sentences_are_found(spark):
    """A passage of 60 words within one sentence, between words that differ."""
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n))
    left = []
    for k in range(20):
        passage = words(60)
        rows = [(2 * k + i, f"{words(30)} {passage} {words(30)}.") for i in range(2)]
        left += [(i, t, passage) for i, t in rows]
    got = {r["doc_id"]: r["text"] for r in substring.SpanDedup().clean(frame(spark, [(i, t) for i, t, _ in left])).collect()}
    assert all(got[i] == t for i, t, _ in left if i % 2 == 0)
    cut = [len(set(p.split()) & set(got[i].split())) for i, _, p in left if i % 2]
    assert sum(n < 50 for n in cut) >= 18 and all(len(t.split()) - len(got[i].split()) <= 60 for i, t, _ in left)


def test_scripts_without_spaces(spark):
    passage = "これは長い文章です。" * 1 + "同じ文がいくつもの文書に出てきます。それを一度だけ残します。ほかの文は消しません。これで終わりです。"
    rows = [(1, "最初の文書。" + passage), (2, "別の文書。" + passage + "最後の文。")]
    got = {r["doc_id"]: r["text"] for r in substring.SpanDedup().clean(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "別の文書。最後の文。"}


def test_hot_spans_are_dealt_to_many_keys(spark):
    """One passage in most documents: its first stays, and the result is that of the plain version."""
    r = random.Random(7)
    passage = "The same passage stands in nearly every document here. It has a second sentence, which is as common as the first one is. "
    rows = [(i, (passage if i % 5 else "") + f"Own words {r.random()} of document {i}. ") for i in range(300)]
    dedup = substring.SpanDedup(2, 8, None)
    got = {x["doc_id"]: x["text"] for x in dedup.clean(frame(spark, rows)).collect()}
    assert got == plain_spans(rows, dedup) and sum(passage in t for t in got.values()) == 1


def test_recall_on_runs_of_fifty_words(spark):
    """Of the documents with 50 words in a row of an earlier one, nine in ten keep no such run."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    cleaned = {r["doc_id"]: r["text"] for r in substring.SpanDedup().clean(docs.select("doc_id", "text")).collect()}

    def runs(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 50]) for i in range(len(words) - 49)}

    seen, repeats, left = set(), 0, 0
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        own = runs(r["text"])
        again = own & seen
        repeats += bool(again)
        left += bool(again & runs(cleaned[r["doc_id"]]))
        seen |= own
    assert repeats > 50 and left <= 0.1 * repeats


def test_sentences_join_to_the_text():
    long = "word, " * 100 + "x" * 5000 + " of many " * 70 + "\u3000a\u2003b " * 50
    for t in [long, "  " + long, long + "\n", "字。" * 90, "", "a", "a.b c. d", "...", ".\n.\n", "x! y? z", "\n\n a.  \n b", "1.5 is a number. So is 2.5."]:
        assert "".join(substring.sentences(t)) == t
    assert substring.sentences("1.5 is a number. So is 2.5.") == ["1.5 is a number. ", "So is 2.5."]


def test_texts_of_one_id_are_documents_of_their_own(spark):
    """A row that repeats a doc_id with another text keeps its own links, and stays unless it is like another document."""
    a = " ".join(f"w{i}" for i in range(60))
    near, other, third = a.replace("w59", "x"), " ".join(f"o{i}" for i in range(40)), " ".join(f"t{i}" for i in range(40))
    rows = [(1, a), (2, near), (2, other), (3, other + " more"), (4, third), (4, third), (4, ""), (5, None), (None, a), (7, third)]
    got = jaccard.Join(5, 80).components(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(1, 56, 1), (2, 56, 1), (2, 36, 2), (3, 37, 2), (4, 36, 4), (4, 36, 4), (4, 0, 4), (5, 0, 5), (None, 56, None), (7, 36, 4)], key=str)
    kept = jaccard.drop_near_duplicates(frame(spark, rows).withColumn("_digest", F.lit(1)).withColumn("_id", F.lit(2)), jaccard.Join(5, 80))
    assert "_digest" in kept.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, a), (2, other), (4, third), (4, third), (4, ""), (5, None), (None, a)], key=str)
    for parts in (1, 7):
        again = jaccard.Join(5, 80).components(frame(spark, rows).repartition(parts, "text")).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_bands_of_sizes_part_no_pair(spark, percent):
    """Sets of every size that share their rarest n-gram, none of them like the smallest."""
    r = random.Random(percent)
    words = [f"v{i}" for i in range(80)]
    rows = [(1, "rare")] + [(i, " ".join(["rare", *words[: r.randrange(4, 80)], *(["end"] * (i % 3))])) for i in range(2, 60)]
    want = components(rows, 1, percent)
    got = jaccard.Join(1, percent).components(frame(spark, rows)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def tasks_of(spark, group, run):
    """What run() returns, and how many tasks its jobs had."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setJobGroup("", "")
    known = sc.statusTracker()
    stages = {s for j in known.getJobIdsForGroup(group) for s in known.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := known.getStageInfo(s)))


@pytest.fixture
def many_partitions(spark):
    """As many tasks as partitions, whatever the rows."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


def test_stars_take_one_round(spark, many_partitions):
    """The driver keeps a record of each task: edges that one round settles have no second one."""
    edges = spark.createDataFrame([(i, 10 * i + k) for i in range(1, 5) for k in range(10, 14)], "a bigint, b bigint").coalesce(1)
    got, tasks = tasks_of(spark, "stars", lambda: {r["id"]: r["label"] for r in jaccard.connected(edges).collect()})
    assert got == {**{i: i for i in range(1, 5)}, **{10 * i + k: min(j for j in range(1, 5) if 0 <= 10 * i + k - 10 * j - 10 < 4) for i in range(1, 5) for k in range(10, 14)}}
    assert tasks <= 12 * many_partitions


def test_a_flush_writes_its_runs_in_one_pass(spark, many_partitions):
    docs = frame(spark, [(i, f"text {i % 30}") for i in range(40)]).repartition(4, "doc_id")
    index = exact_dedup.DigestIndex(spark, memtables=4, fanout=9)
    hits, tasks = tasks_of(spark, "flush", lambda: index.flush(docs))
    assert hits.count() == 10 and len(index.levels[0]) == 4
    assert tasks <= 18 * many_partitions
