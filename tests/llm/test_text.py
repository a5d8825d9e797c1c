"""Personal data, transport streams, packing, language, quality, extraction and mixing."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from brute import DOCS, base_spans, luhn
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from objwatch.llm import extraction, language, mixing, packing, pii, quality, registry, transport
from objwatch.llm.common import table


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def text_of(sf_dir, name="documents", column="text"):
    return ds.dataset(f"{sf_dir}/{name}.parquet").to_table().to_pydict()[column]


# ---- personal data


def odd_texts():
    r = random.Random(5)
    pieces = ["a@b.co", "x.y+z@mail.example.com", "@", ".", "..", "-", " ", "+", "1", "12", "4111 1111 1111 1111", "4111-1111-1111-1111", "4629384405288451", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "+1 (372) 555-7739", "+12", "é", "😀", "(", "_", "a", "0", "_d@e.f", "\n"]
    return ["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(400)]


def test_base_spans(spark):
    texts = [*odd_texts(), None, "", "9" * 50_000, "a" * 50_000 + "@", "x@" + "a." * 20_000, "+1" + "(" * 50_000, "1 " * 40_000, "1.1." * 20_000, "4111111111111111 " * 300]
    rows = list(enumerate(texts))
    got = pii.find_pii(frame(spark, rows)).select("doc_id", pii._joined(F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))).alias("s")).collect()
    want = {i: base_spans(t or "") for i, t in rows}
    assert {r["doc_id"]: r["s"] for r in got} == want
    assert sum(bool(w) for w in want.values()) > 100


def test_checksums(spark):
    digits = ["4111111111111111", "4111111111111112", "79927398713", "0", "18"]
    codes = ["GB82WEST12345698765432", "GB82WEST12345698765433", "DE89370400440532013000"]
    got = spark.createDataFrame([(d,) for d in digits], "d string").select("d", pii.luhn(F.col("d")).alias("ok")).collect()
    assert {r["d"]: r["ok"] for r in got} == {d: luhn(d) for d in digits}
    got = spark.createDataFrame([(c,) for c in codes], "c string").select("c", pii.mod97(F.col("c")).alias("ok")).collect()
    assert {r["c"]: r["ok"] for r in got} == {c: i != 1 for i, c in enumerate(codes)}


def test_spans_beyond_the_base(spark):
    rows = [(1, "my IBAN is GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "social security 123-45-6789"), (4, "part 123-45-6789"), (5, "mail a@b.co, bye")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got == {1: [("iban", 11, 38)], 2: [], 3: [("national_id", 16, 27)], 4: [], 5: [("email", 5, 11)]}
    scores = {r["doc_id"]: [s["score"] for s in r["spans"]] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert scores[5] == [1.0]
    assert pii.redact(frame(spark, rows)).where("doc_id = 5").first()["text"] == "mail ******, bye"
    assert pii.find_pii(frame(spark, []).withColumn("spans", F.lit(1))).count() == 0


# ---- transport streams


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=20_000))
def test_streams_give_back_what_went_in(raw):
    payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
    media = transport.write_stream(payload)
    back = transport.read_stream(media)
    assert back.payload == payload and len(media) % 188 == 0 and media[::188] == b"\x47" * (len(media) // 188)
    assert back.sync_errors == back.table_errors == back.continuity_errors == back.length_errors == 0
    units = -(-len(payload) // transport.ACCESS_UNIT)
    assert back.pts == [(i + 1) * 3600 for i in range(units)]
    assert back.random_access == [i * transport.ACCESS_UNIT for i in range(0, units, 5)]


def test_broken_streams_are_counted():
    media = transport.write_stream(bytes(range(256)) * 9 * 40)
    lost = media[: 188 * 5] + media[188 * 6 :]
    assert transport.read_stream(lost).continuity_errors == 1 and transport.read_stream(lost).length_errors == 1
    assert transport.read_stream(b"\0" + media[1:]).sync_errors == 1
    bad = bytearray(media)
    bad[10] ^= 1
    assert transport.read_stream(bytes(bad)).table_errors >= 1
    for junk in (None, b"", b"x", b"G" * 188, bytes([0x47]) + b"\xff" * 187, media[:188], media[:376], media[:600]):
        transport.read_stream(junk)


def test_media_columns(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 4000), (None, "abc"), (1, "abc")]
    docs = frame(spark, rows).withColumn("media", F.lit(1))
    media = transport.to_media(docs)
    back = {r["doc_id"]: bytes(r["payload"]) for r in transport.read_media(media).collect()}
    digests = transport.media_digests(transport.stored(media)).collect()
    assert len(digests) == 6
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for r in digests:
        text = dict(rows)[r["doc_id"]] or ""
        payload = transport.padded(text)[0]
        assert back[r["doc_id"]] == payload and r["n_bytes"] == len(text.encode()) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(stored[r["doc_id"]]).hexdigest() and r["media_bytes"] == len(stored[r["doc_id"]])
    assert transport.media_digests(transport.stored(transport.to_media(frame(spark, [])))).count() == 0
    broken = media.limit(1).withColumn("media", F.lit(None).cast("binary")).unionByName(media.limit(1).withColumn("media", F.lit(b"G" * 500)))
    assert [(r["payload_bytes"], "errors=0" in r["feature"]) for r in transport.media_digests(broken).collect()] == [(0, False)] * 2


# ---- packing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 12), max_size=12), st.integers(30, 40))
def test_plans_are_packings(counts, capacity):
    plan = packing.plan_packing(counts, capacity)
    fill, ranks, places = Counter(), defaultdict(list), defaultdict(list)
    for w, lo, hi, per, sequence, offset in plan.segments:
        for rank in range(lo, hi):
            q, k = (rank - lo) // per + sequence, (rank - lo) % per
            fill[q] += w
            places[q].append((offset + k * w, w))
            ranks[w].append(rank)
    assert all(sorted(ranks[w]) == list(range(n)) for w, n in counts.items())
    assert all(n <= capacity for n in fill.values()) and sorted(fill) == list(range(plan.sequences))
    for q in places:
        at = 0
        for offset, w in sorted(places[q]):
            assert offset == at
            at += w


def least(items, capacity):
    """Fewest sequences, by trying all."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            k = rooms.index(r)
            go(i + 1, [*rooms[:k], r - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_reduction_never_costs_a_sequence(items):
    """What dominance fixes is part of some best packing."""
    items = sorted(items, reverse=True)
    plan = packing.Plan(dict(Counter(items)), 20)
    plan.reduce()
    rest = sorted((w for w, n in plan.left.items() for _ in range(n)), reverse=True)
    assert plan.reduced + least(rest, 20) == least(items, 20)


def test_pieces_and_places(spark, sf_dir):
    from tokenizers import Tokenizer

    odd = [None, "", "It's they'll", "<|endoftext|> a<|startoftext|>b", "ΟΔΥΣΣΕΥΣ Σ İstanbul ²½ a²b\tz\x1cq", "a_b __ 12a3 don't.. x'", "́a b́", "K Å ß ẞ", "word " * 3000, "word " * 3000]
    rows = list(enumerate([*odd, *text_of(sf_dir)[:60]]))
    got = packing.pack(frame(spark, rows).withColumn("length", F.lit(1)).withColumn("rank", F.lit(1))).toPandas()
    t = Tokenizer.from_file(packing.default_tokenizer())
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i].sort_values("piece")
        cuts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert list(own.length) == [len(c) for c in cuts] and list(own.start) == [2048 * k for k in range(len(cuts))]
        assert list(own.ids_crc32) == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cuts]
    placed = got.sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id").length.cumsum() - placed.length
    assert (before == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_repeated_rows_are_packed_each(spark):
    got = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, "a b")])).toPandas()
    assert len(got) == 3 and sorted(got.offset) == [0, 3, 6] and got.sequence_id.nunique() == 1


def test_ids_of_any_text_are_those_of_the_tokenizer(sf_dir):
    """Random texts of Latin, odd case, marks, separators and special tokens; two rounds with small caches, so that old words are forgotten and found again."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    letters = [*map(chr, range(32, 0x250)), *"Σσς\u0130ıK\u212bſẞßǅ\u0300\u0301\u00a0\u2003\u3000\u200b\t\r\x0b\x1c\u0085\u2028漢字かなไท한١٢½²'’", "'s", "'t", "<|endoftext|>", "<|startoftext|>"]
    kinds = [letters, list(map(chr, range(32, 127))), list("abAB .,'!é\n")]
    texts = ["".join(rng.choice(kinds[i % 3], size=rng.choice([0, 1, 3, 10, 60]))) for i in range(3000)]
    texts += [None, "", "  ", "\n\n", "a" * 5000, "x" * 70 + " " + "y" * 70 + "!", *text_of(sf_dir)[:40]]
    whole, words = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer())
    words.runs.size = words.whole.size = 500
    for _ in range(2):
        for at in range(0, len(texts), 700):
            ids, begin = words.encode(pa.array(texts[at : at + 700], pa.string()))
            for k, t in enumerate(texts[at : at + 700]):
                assert ids[begin[k] : begin[k + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 0], repr(t)


def test_pieces_without_ids_are_dealt_to_many_windows(spark):
    """5,000 rows without an id and of one length: each window of ranks holds a few thousand, and places are unique."""
    got = packing.pack(frame(spark, [(None, "a b")] * 5000)).toPandas()
    assert len(got) == 5000 and not got.duplicated(["sequence_id", "offset"]).any() and got.sequence_id.nunique() == -(-5000 // (2048 // 3))


def test_shards_of_ranks_are_added_up_in_groups(spark, monkeypatch):
    """Ranks within each length are 0, 1, 2 ... without gaps, over many shards and many groups of them."""
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    monkeypatch.setattr(packing, "RANK_SHARDS", 3)
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.when(F.col("id") % 10 == 0, 7).otherwise(2048).alias("length"), F.lit(1).alias("ids_crc32"), F.col("id").alias("_n"))
    got = packing._ranked(pieces).toPandas()
    for n, found in ((300, got[got.length == 7]), (2700, got[got.length == 2048])):
        assert sorted(found["rank"]) == list(range(n))


def test_redaction_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "write to a@b.co now"), (3, "write to a@b.co now"), (None, "a@b.co"), (4, "x" * 100_000 + " a@b.co")]
    got = Counter((r["doc_id"], r["text"]) for r in pii.redact(frame(spark, rows)).collect())
    assert got == Counter((i, t and t.replace("a@b.co", "******")) for i, t in rows)


# ---- language and quality


def held(ids, n, k):
    return np.array([zlib.crc32(str(i).encode()) % n == k for i in ids])


def test_language(spark, sf_dir):
    got = language.op1_language(spark, sf_dir).toPandas().merge(ds.dataset(f"{sf_dir}/documents.parquet").to_table().to_pandas()[["doc_id", "lang"]], on="doc_id")
    assert len(got) == 200 and got.score.between(0, 1).all()
    assert (got.held_out == held(got.doc_id, 4, 2)).all()
    test = got[got.held_out]
    assert (test.lang_pred == test.lang).mean() >= 0.95


def test_language_of_odd_rows(spark):
    rows = [(i, w * 9, lang, "s", 0) for i, (w, lang) in enumerate([("the of and ", "en"), ("der die und ", "de"), ("the and of it ", "en"), ("und die der ein ", "de")])]
    rows += [(10, None, "en", "s", 0), (11, "", "de", "s", 0), (12, "123 !!", "de", "s", 0), (13, "the and", None, "s", 0), (14, "THE AND " * 30_000, "en", "s", 0), (None, "die der", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in language.identify(docs.withColumn("score", F.lit(1)), language.train(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (10, 11, 12, 13, 14, None)] == ["und", "und", "und", "en", "en", "de"]
    assert got[10]["score"] == 0
    empty = spark.createDataFrame([], DOCS)
    assert language.identify(empty, language.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.train(empty)).collect()} == {"und"}


def test_kernel_is_the_share_of_common_grams():
    a, b = language.presence(["abc", "abd"])
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert a.sum() == len(grams("abc ")) and (a & b).sum() == len(grams("abc ") & grams("abd "))
    assert (language.presence(["x", "abc"])[1] == a).all() and (language.presence(["A--b1c"])[0] == language.presence(["a b c"])[0]).all()


def literal_language(bits, labels, texts):
    """Kernel ridge regression as it is written down: kernel values one by one, weights of the landmarks from the normal equations."""
    sets = [set(np.flatnonzero(np.unpackbits(b)).tolist()) for b in bits]
    names = sorted(set(labels))
    turn = [labels[:i].count(x) for i, x in enumerate(labels)]
    marks = sorted(sorted(range(len(labels)), key=lambda i: (turn[i], labels[i]))[: language.LANDMARKS])
    value = lambda a, b: len(a & b) / max(1, len(a) * len(b)) ** 0.5
    k = np.array([[value(a, sets[m]) for m in marks] for a in sets])
    d = np.array([1 / labels.count(x) for x in labels])
    y = np.array([[float(x == n) for n in names] for x in labels])
    weights = np.linalg.pinv((k * d[:, None]).T @ k + language.RIDGE * k[marks], 1e-12, hermitian=True) @ (k * d[:, None]).T @ y
    grams = [set(np.flatnonzero(language.presence([t])[0]).tolist()) for t in texts]
    each = np.array([[value(g, sets[m]) for m in marks] for g in grams]) @ weights
    return [names[i] for i in each.argmax(1)], each.max(1).clip(0, 1)


def test_language_equals_a_literal_version(spark, sf_dir, monkeypatch):
    """The whole query against brute force on its own sample."""
    monkeypatch.setattr(language, "LANDMARKS", 40)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").select("doc_id", "text", "lang")
    rows = docs.orderBy("doc_id").collect()
    lettered = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    names, scores = literal_language(*language.sample_bits(learn), [r["text"] for r in lettered])
    got = {r["doc_id"]: r for r in language.op1_language(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    assert [got[r["doc_id"]]["lang_pred"] for r in lettered] == names
    assert np.abs(np.array([got[r["doc_id"]]["score"] for r in lettered]) - scores).max() < 1e-3


def test_language_sample(spark):
    """Long texts are learned from; rows that repeat, with or without an id, come to the driver once; ties go to the first name."""
    rows = [(i, "lorem ipsum " * 9000, "la", "s", 0) for i in range(3)] + [(7, "the of and", "en", "s", 0)] * 3000 + [(None, "of the and", "en", "s", 0)] * 3000
    bits, labels = language.sample_bits(spark.createDataFrame(rows, DOCS))
    assert labels == ["en", "en", "la", "la", "la"]
    twins = spark.createDataFrame([(1, "same words", "b", "s", 0), (2, "same words", "a", "s", 0)], DOCS)
    assert {r["lang_pred"] for r in language.identify(twins, language.train(twins)).collect()} == {"a"}


def literal_features(net, text):
    """The network's features of one text, window by window."""
    cells = max(1, -(-len(text) // quality.CELL))
    data = text.ljust(cells * quality.CELL, b"\0")
    filters = np.concatenate([net.filters[:, : quality.FILTERS], net.filters[:, quality.FILTERS :]])
    pooled = []
    for c in range(cells):
        values = []
        for at in range(c * quality.CELL, (c + 1) * quality.CELL, quality.STRIDE):
            window = data[at : at + quality.WIDTH].ljust(quality.WIDTH, b"\0")
            values.append(np.concatenate([quality.BYTE_TRAITS[b] for b in window]) @ filters)
        pooled.append(np.maximum(np.max(values, 0) + net.bias, 0))
    chunks, at = [], 0
    while not chunks or at < cells - 1:
        chunks.append(np.max(pooled[at : at + quality.CHUNK], 0))
        at += quality.HOP
    return np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), np.mean(pooled, 0), np.std(pooled, 0), [np.log1p(len(text))]])


def test_quality_features_equal_literal_ones(monkeypatch):
    net = quality.fit_texts(["good words here. " * 20, "&&& bad*** " * 30] * 8, [1, 0] * 8)
    texts = [b"", b"x", b"Some words, 12 of them.", "Größe & maß\n".encode() * 40, b"a b " * 250, bytes(range(256)) * 3]
    want = np.array([literal_features(net, t) for t in texts])
    assert np.allclose(net.features(texts), want, atol=1e-3)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2 * quality.CELL)
    assert np.allclose(net.features(texts), want, atol=1e-3) and np.allclose(net.score(texts), net.probability(want), atol=1e-3)


def test_quality_sample(spark):
    """Long texts are learned from; repeated ids count once; the order of rows changes nothing; short junk is no good text for being short."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(7, "text").union(docs.limit(50)), labels.repartition(5, "doc_id").union(labels.limit(20)))
    odd = [b"buy now!!! $$$ !!! ###", b"| | | | |", b"The house is near the river.", b"Quiet words, and some more of them."]
    assert (model.score(odd) >= 0.5).tolist() == [False, False, True, True]
    assert np.abs(model.score(odd) - again.score(odd)).max() < 0.2
    long = frame(spark, [(1, "Many good words. " * 40_000), (2, "&& ** " * 90_000), (2, "%% "), (3, "Good words. "), (4, "** && ")] + [(5, f"Fine words {i}.") for i in range(2000)])
    marked = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (5, 1), (5, 1)], "doc_id bigint, quality int")
    net = quality.train(long, marked)
    assert isinstance(net, quality.Network)


def literal_step(learner, texts, y):
    """The gradient of the loss in each parameter, by differences; and the loss."""

    def loss(params):
        total = 0.0
        for t, label in zip(texts, y, strict=True):
            net = quality.Network(params["filters"], params["bias"], (0.0, 1.0), ())
            mean = literal_features(net, t)[: quality.FILTERS]
            p = 1 / (1 + np.exp(-(mean @ params["w"] + params["b"][0])))
            total -= np.log(p if label else 1 - p) / len(texts)
        return total

    out = {}
    for name, value in learner.params.items():
        flat = [(i, k) for i in range(0, value.size, max(1, value.size // 9)) for k in (-1, 1)]
        out[name] = {}
        for i, _ in flat[::2]:
            sides = []
            for k in (-1, 1):
                params = {c: v.astype(float) for c, v in learner.params.items()}
                params[name].flat[i] += k * 1e-5
                sides.append(loss(params))
            out[name][i] = (sides[1] - sides[0]) / 2e-5
    return out


def test_filters_learn_from_whole_texts():
    """A step's gradient is that of the loss over every byte, also of texts far longer than any other; and rounds of several tasks are averaged."""
    learner = quality.Learner(np.random.default_rng(1))
    texts, y = [b"good words, here. " * 70 + b"*** &&& ###", b"", b"Bad $$$ 12", b"x" * 700], [1, 0, 0, 1]
    learner.params["bias"] += np.linspace(0.03, 0.09, quality.FILTERS, dtype=np.float32)  # away from where the loss has a bend
    want, taken = literal_step(learner, texts, y), {}
    learner.adam.step = lambda **params: taken.update({k: g for k, (_, g) in params.items()})
    learner.step(texts, np.array(y, float))
    for name, values in want.items():
        for i, g in values.items():
            assert abs(taken[name].flat[i] - g) < 1e-4
    one, two = (quality.Learner(np.random.default_rng(k)) for k in (1, 2))
    for x in (one, two):
        x.round(iter([(t, k) for t, k in zip(texts, y, strict=True)]))
    a, b = one.params["filters"].copy(), two.params["filters"].copy()
    assert np.allclose(quality.Learner.average([(one, 3), (two, 1)]).params["filters"], a * 0.75 + b * 0.25, atol=1e-6)


def test_steps_hold_few_long_texts(monkeypatch):
    monkeypatch.setattr(quality, "STEP_BYTES", 1000)
    learner, steps = quality.Learner(np.random.default_rng(1)), []
    learner.step = lambda texts, y: steps.append((list(map(len, texts[: len(texts) // 2])), y.tolist()))
    learner.round(iter([(b"a" * 600, 1), (b"b" * 600, 0), (b"c" * 300, 1), (b"d" * 5000, 0)] + [(b"e", 1)] * 30))
    assert [x for x, _ in steps] == [[600], [600, 300], [5000], [1] * 24, [1] * 6] and steps[1][1] == [0, 1, 0, 1]


def test_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = quality.op4_quality(spark, sf_dir).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == held(got.doc_id, 3, 1)).all()
    test = got[got.held_out].merge(ds.dataset(f"{sf_dir}/labels.parquet").to_table().to_pandas(), on="doc_id")
    assert (test.predicted == test.quality).mean() >= 0.95


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "x" * 300_000), (None, "a"), (5, "b"), (5, "b")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (None, 0), (9, None)], "doc_id bigint, quality int")
    got = quality.score(docs.withColumn("score", F.lit("x")), quality.train(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert quality.score(docs.limit(0), 0.5).count() == 0


def test_every_byte_counts():
    """Chunks cover the whole text: a change anywhere can change the features."""
    net = quality.fit_texts(["good words here. " * 20, "&&& bad*** " * 30] * 8, [1, 0] * 8)
    clean = b"good words here. " * 400
    base = net.features([clean])
    for at in (0, 3000, len(clean) - 12):
        assert (net.features([clean[:at] + b"&&& bad*** " + clean[at:]]) != base).any()
    together = net.score([clean, b"x", clean[:700]])
    assert np.allclose(together, [net.score([t])[0] for t in (clean, b"x", clean[:700])], atol=1e-5)


# ---- extraction


def test_pages(spark, sf_dir):
    import html as H
    import re

    pages = ds.dataset(f"{sf_dir}/pages.parquet").to_table().to_pydict()
    got = {r["page_id"]: r for r in extraction.op10_extraction(spark, sf_dir).collect()}
    for i, source in zip(pages["page_id"], pages["html"], strict=True):
        article = re.search("<article>(.*)</article>", source, re.S)[1]
        blocks = (" ".join(H.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def site(body, extra=""):
    return f"<html><head><title>t</title></head><body><header>Site</header><nav><a>Home</a></nav>{body}<aside>More</aside>{extra}<footer>Foot</footer></body></html>"


def test_templates_without_article_tags(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [[" ".join(word() for _ in range(30)) for _ in range(3)] for _ in range(12)]
    rows, want = [], {}
    for i, ps in enumerate(texts):
        inner = "".join(f"<p>{p}</p>" for p in ps)
        body = f'<div class="wrap"><div class="body-{1}"><h2>{ps[0][:11]}</h2>{inner}<div class="share">Share this</div><span>Read also</span></div><div class="comments"><p>{"nice " * 9}</p></div></div><div class="cookie-notice">We use cookies</div>'
        rows.append((i, f"https://User@Host.example:80/{i}", site(body, "<form><input><label>Mail</label></form>")))
        want[i] = "\n".join([ps[0][:11], *ps])
    rows.append((50, "https://alone.example/x", site(f"<article><p>One &amp; two&nbsp;<br>three</p><!-- no --><p> </p><script>x<p></script>{'<p>end'}</article>")))
    want[50] = "One & two three\nend"
    rows += [(60, None, None), (61, "", ""), (62, "not a url", "plain  text"), (63, "https://b.example", "<" * 3000), (64, "https://b.example", "<div>" * 5000 + "deep")]
    want |= {60: "", 61: "", 62: "plain text"}
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("salt", F.lit(1))
    got = {r["page_id"]: r["text"] for r in extraction.extract(docs).collect()}
    assert {i: got[i] for i in want} == want and set(got) == {r[0] for r in rows}
    assert extraction.extract(docs.limit(0)).count() == 0


# ---- mixing


@pytest.mark.parametrize("entropy", [0.4, 1.0, 2.5])
def test_entropy_target_equals_a_plain_bisection(spark, entropy):
    sizes = [1, 5, 20, 300, 4000, 4000, 70]
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)] + [(None, 9)], "source string, tokens long")
    got = mixing.Mix(entropy=entropy).sources(rows).collect()
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        w = np.array([*sizes, 9.0]) ** mid
        lo, hi = (lo, mid) if -(w / w.sum() * np.log(w / w.sum())).sum() < entropy else (mid, hi)
    assert all(abs(r["exponent"] - lo) < 1e-9 for r in got) and abs(sum(r["weight"] for r in got) - 1) < 1e-9


def test_blocks_are_added_up_in_groups(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    want = sorted(map(tuple, mixing.Mix(repetition=1.7).rows(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BLOCK_GROUP", 3)
    assert sorted(map(tuple, mixing.Mix(repetition=1.7).rows(docs).collect()), key=str) == want


def test_mixing_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    documents = ds.dataset(f"{sf_dir}/documents.parquet").to_table()
    duck.register("documents", documents)
    got = mixing.op2_mixing(spark, sf_dir).toPandas()
    want = duck.sql(registry.ORACLE_SQL["op2_mixing"]).df()[list(got.columns)]
    order = ["doc_id", "epoch"]
    assert (got.sort_values(order).astype(str).to_numpy() == want.sort_values(order).astype(str).to_numpy()).all()


def test_exact_dedup_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.register("documents", ds.dataset(f"{sf_dir}/documents.parquet").to_table())
    got = registry.QUERIES["op3_exact_dedup"](spark, sf_dir).toPandas()
    want = duck.sql(registry.ORACLE_SQL["op3_exact_dedup"]).df()[list(got.columns)]
    assert (got.sort_values("doc_id").astype(str).to_numpy() == want.sort_values("doc_id").astype(str).to_numpy()).all()


def corpus(spark):
    sizes = {"a": 600, "b": 60, None: 30, "empty": 3}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, None if s == "empty" else "w " * (1 + i % 5), "en", s, 0))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def test_repetition_limit(spark):
    docs = corpus(spark)
    got = mixing.Mix(repetition=3.0).rows(docs).toPandas()
    tokens, there = got.groupby("source", dropna=False).tokens.sum(), docs.toPandas()
    there["n"] = there.text.str.split().str.len().fillna(0)
    epochs = tokens / there.groupby("source", dropna=False).n.sum()
    assert epochs["a"] == 1 and 2.9 <= epochs[np.nan] <= 3.0 and 1 < epochs["b"] < 3
    assert set(got.doc_id) == set(there.doc_id) and (got[got.source == "empty"].epoch == 0).all()
    assert got[got.epoch == 0].doc_id.is_unique and got.groupby("doc_id").size().max() == 3


def test_target_entropy_and_budget(spark):
    docs = corpus(spark).where("source in ('a', 'b')")
    weights = {r["source"]: r["weight"] for r in mixing.Mix(entropy=0.6).sources(docs.select("source", mixing.n_words().alias("tokens"))).collect()}
    assert abs(-sum(w * math.log(w) for w in weights.values()) - 0.6) < 1e-6
    got = mixing.Mix(entropy=0.6, budget_tokens=500).rows(docs).toPandas()
    assert 480 <= got.tokens.sum() <= 500
    for s, w in weights.items():
        assert abs(got[got.source == s].tokens.sum() - 500 * w) <= 5


def test_realised_rows(spark):
    docs = corpus(spark).withColumn("_n", F.lit(1)).withColumn("epoch", F.lit(2))
    mix = mixing.Mix(repetition=2.0)
    taken = Counter(r["doc_id"] for r in mix.rows(docs).collect())
    got = mix.realise(docs)
    assert got.columns == docs.columns and Counter(r["doc_id"] for r in got.collect()) == taken
    assert mix.rows(docs.limit(0)).count() == 0 and mix.realise(docs.limit(0)).count() == 0


def test_words(spark):
    texts = [None, "", " ", "a", " a b\n\tc ", "\n", "é\xa0b"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.n_words().alias("n")).collect()
    assert [r["n"] for r in got] == [0, 0, 0, 1, 3, 0, 1]


def test_documents_are_there(spark, sf_dir):
    assert table(spark, sf_dir, "documents").count() == 200 and pa.__version__
