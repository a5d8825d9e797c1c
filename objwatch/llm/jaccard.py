"""Exact n-gram Jaccard join by vertical partitioning, and the groups that its links make.

N-grams are 64-bit hashes in one global order: by how often whole partitions repeat them, then
by hash. Documents with equal n-gram sets are one set, whose representative is its smallest
doc_id. Sets that can be similar share an n-gram of their prefixes (prefix filter). In each such
bucket every set is first compared with the bucket's smallest one only, so a group of n near
copies costs n comparisons; afterwards, members of a bucket that are still in different
components are compared with each other, so no link between components is missed. To compare,
the n-gram order is cut into fragments; overlaps are counted fragment by fragment and summed per pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objwatch.llm.common import as_rows, cut_lineage, flag_members, map_batches, membership_filter, table, without_ids
from objwatch.llm.rolling import mixed, powers

FRAGMENTS = 8
#: Places of the frequency levels, which are broadcast: one byte each.
LEVEL_SLOTS = 1 << 20
#: N-grams that a task counts together, and the count from which it reports one. Only the order depends on it:
#: links are the same in any order. Prefixes are the first 15 to 20 percent of it, so the first quarter of the hashes is counted.
COUNTED, REPORTED, FIRST = 4_000_000, 4, np.uint64(1 << 62)
#: Words of 64 bits of the shortest and the longest parity signature; all are folded to the shortest, too.
SHORT_WORDS, PARITY_WORDS = 8, 1 << 14
BLOCK_BYTES = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _block_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)  # bytes.lower() changes A-Z only
    ends_of_docs = np.cumsum([len(t) + 1 for t in texts])
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    words = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(ends_of_docs, start, "right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams += words[k : len(grams) + k] * _MIX[k]
    grams = mixed(grams)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            g = grams[a : b - n + 1].copy()
            g.sort()
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:  # fewer words: all of them are the one gram
            out.append(mixed(np.array([np.uint64(b - a) + (words[a:b] * _MIX[n : n + b - a]).sum()], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def gram_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text its distinct word n-grams as sorted hashes; A-Z are lower-cased, words are what ASCII white space parts."""
    raw = [(t or "").encode() for t in texts]
    begin = size = 0
    for i in range(len(raw) + 1):
        if i == len(raw) or i > begin and size + len(raw[i]) > BLOCK_BYTES:
            yield from _block_sets(raw[begin:i], n)
            begin, size = i, 0
        size += len(raw[i]) if i < len(raw) else 0


@dataclass(frozen=True)
class Join:
    """n-grams of n words; similarity of at least percent / 100."""

    n: int = 4
    percent: int = 85

    def prefix(self, size: int) -> int:
        return size - (self.percent * size + 99) // 100 + 1

    def close_sizes(self, a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})"

    def sets(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n, d0, d1) for each row: size and digest of its set; and rows (slot, hot) with what is frequent."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[np.ndarray] = []

            def frequent() -> pa.RecordBatch:
                grams, count = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]), return_counts=True)
                kept.clear()
                grams, count = grams[count >= REPORTED], count[count >= REPORTED]
                none = pa.nulls(len(grams), pa.int64())
                return pa.RecordBatch.from_arrays([none, none, none, none, pa.array((grams % np.uint64(LEVEL_SLOTS)).astype(np.int64)), pa.array(count)], names)

            names = ["doc_id", "n", "d0", "d1", "slot", "hot"]
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    sizes, digests = [], []
                    for s in gram_sets(part["text"].to_pylist(), self.n):
                        sizes.append(len(s))
                        digests.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (None, None))
                        kept.append(s[: np.searchsorted(s, FIRST)])
                    none = pa.nulls(len(sizes), pa.int64())
                    d = [pa.array([x[k] if x[k] is None else int(x[k]) for x in digests], pa.int64()) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), *d, none, none], names)
                    if sum(map(len, kept)) > COUNTED:
                        yield frequent()
            yield frequent()

        return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n bigint, d0 bigint, d1 bigint, slot bigint, hot bigint")

    def prefixes(self, docs: DataFrame, level: np.ndarray) -> DataFrame:
        """(doc_id, n, grams, parity, short): the prefix of each set in the global order, which is (level, hash).

        parity tells for each value of the hashes' last bits whether the set has an odd number of such
        n-grams: two to four bits per n-gram, a power of two. Two sets differ in at least as many
        n-grams as their parities in bits; the longer one is folded to the length of the other.
        short is parity folded to SHORT_WORDS.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    sizes, own, parity = [], [], []
                    for s in gram_sets(part["text"].to_pylist(), self.n):
                        sizes.append(len(s))
                        levels = level[(s % np.uint64(LEVEL_SLOTS)).astype(np.int64)]
                        ordered = s[np.argsort(levels, kind="stable")] if levels.any() else s
                        own.append(ordered[: self.prefix(len(s)) if len(s) else 0])
                        bits = 64 * min(PARITY_WORDS, max(SHORT_WORDS, 1 << max(0, (2 * len(s) - 1 >> 6).bit_length())))
                        odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                        parity.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
                    ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                    grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))
                    starts = np.cumsum([0, *map(len, parity)]).astype(np.int32)
                    parities = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(parity)))
                    folded = np.concatenate([np.bitwise_xor.reduce(x.reshape(-1, SHORT_WORDS), 0) for x in parity])
                    short = pa.FixedSizeListArray.from_arrays(pa.array(folded), SHORT_WORDS).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), grams, parities, short], ["doc_id", "n", "grams", "parity", "short"])

        return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n bigint, grams array<bigint>, parity array<bigint>, short array<bigint>")

    def fragments(self, docs: DataFrame) -> DataFrame:
        """(id, fragment, part): each set cut at fixed places of the hash order."""
        shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    ids, number, parts = [], [], []
                    for doc, s in zip(part["doc_id"].to_pylist(), gram_sets(part["text"].to_pylist(), self.n), strict=True):
                        cuts = np.searchsorted(s >> shift, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                            if b > a:
                                ids.append(doc)
                                number.append(k)
                                parts.append(s[a:b].view(np.int64))
                    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                    arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), arrays], ["id", "fragment", "part"])

        return map_batches(docs.select("doc_id", "text"), run, "id bigint, fragment int, part array<bigint>")

    def links(self, docs: DataFrame, pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar. facts is (id, n, parity).

        Sizes and parities rule pairs out that cannot be; for the rest, texts are read again.
        """
        size_a, size_b = (facts.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
        parity_a, parity_b = (facts.select(F.col("id").alias(x), F.col("parity").alias(f"p_{x}")) for x in "ab")
        sized = pairs.join(size_a, "a").join(size_b, "b").where(self.close_sizes("n_a", "n_b"))
        fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"  # sizes of a pair are at most one doubling apart
        apart = f"aggregate(zip_with({fold.format('p_a', 'p_b')}, {fold.format('p_b', 'p_a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
        sized = sized.join(parity_a, "a").join(parity_b, "b").where(f"{apart} * {100 + self.percent} <= (n_a + n_b) * {100 - self.percent}").drop("p_a", "p_b")
        sized = cut_lineage(sized)
        ids = sized.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = flag_members(docs.select("doc_id", "text"), "doc_id", membership_filter(ids, "id")).where("_maybe")
        parts = cut_lineage(self.fragments(wanted))
        left = parts.select(F.col("id").alias("a"), "fragment", F.col("part").alias("part_a"))
        right = parts.select(F.col("id").alias("b"), "fragment", F.col("part").alias("part_b"))
        each = sized.join(left, "a").join(right, ["b", "fragment"])
        counted = each.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("common"))
        summed = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
        return cut_lineage(summed.where(f"100 * common >= {self.percent} * (n_a + n_b - common)").select("a", "b"))

    def components(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text, ...).

        Null, empty and blank texts have no n-gram, and their component is their own doc_id; a
        text with fewer than n words is one n-gram. A document is a doc_id with a text: rows that repeat both
        are one, and each gives a row; rows that repeat the doc_id only are documents of their own, and a component is called by
        the smallest doc_id in it. Rows without a doc_id link to nothing and have no component. A very long text is read in whole. An
        empty table gives no rows. Other columns are ignored.
        """
        docs = docs.select("doc_id", "text")
        found = cut_lineage(self.sets(docs))
        level = np.zeros(LEVEL_SLOTS, np.uint8)
        hot = found.where("slot is not null").groupBy("slot").agg(F.sum("hot").alias("hot")).toArrow()  # at most LEVEL_SLOTS rows
        level[hot["slot"].to_numpy()] = np.ceil(np.log2(hot["hot"].to_numpy())).astype(np.uint8) if len(hot) else 0
        rows = found.where("slot is null").select("doc_id", "n", "d0", "d1")
        sets = F.xxhash64("n", F.coalesce("d0", F.lit(0)), F.coalesce("d1", F.lit(0)))
        repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min(sets).alias("lo"), F.max(sets).alias("hi")).where("k > 1")
        repeats = repeated.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("lo") != F.col("hi")).alias("other")).first()
        if repeats["other"]:
            return self._components_of_texts(docs, rows)
        if repeats["k"]:
            docs = docs.dropDuplicates(["doc_id"])
        linked = rows.where("n > 0 and doc_id is not null")
        reps = cut_lineage(linked.groupBy("d0", "d1").agg(F.min("doc_id").alias("id"), F.min("n").alias("n")))
        copies = linked.join(reps.select("d0", "d1", "id"), ["d0", "d1"]).where("doc_id <> id").select("doc_id")
        distinct = without_ids(docs.where("doc_id is not null"), copies)

        prefixes = cut_lineage(self.prefixes(distinct, level).where("n > 0"))
        facts = prefixes.select(F.col("doc_id").alias("id"), "n", "parity", *[F.col("short")[i].alias(f"q{i}") for i in range(SHORT_WORDS)])
        grams = prefixes.select(F.col("doc_id").alias("id"), F.posexplode("grams").alias("pos", "gram"))
        # buckets with more than one set; hot n-grams combine before the shuffle
        live = cut_lineage(grams.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("gram", "a"))
        near = flag_members(grams, "gram", membership_filter(live, "gram", 1 << 24), bits=1 << 24).where("_maybe").drop("_maybe")
        members = cut_lineage(near.join(live, "gram").select("gram", "a", F.col("id").alias("b"), "pos"))

        star = members.where("a <> b").select("a", "b").distinct()
        links = self.links(docs, star, facts)
        label = connected(links)
        across = self._across(members, label, facts.drop("parity"))
        if not across.isEmpty() and not (more := self.links(docs, across, facts)).isEmpty():
            label = connected(links.unionByName(more))
        named = reps.join(label, "id", "left").select("d0", "d1", F.coalesce("label", "id").alias("component_id"))
        out = rows.join(named, ["d0", "d1"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))

    def _components_of_texts(self, docs: DataFrame, rows: DataFrame) -> DataFrame:
        """components() where a doc_id has several texts: documents are numbered in order of (doc_id, digest of the text), and joined by number."""
        given, numbers = numbered(docs)
        found = cut_lineage(self.components(given.join(numbers, ["doc_id", "_digest"]).select(F.col("_id").alias("doc_id"), "text").dropDuplicates(["doc_id"])))
        heads = numbers.select(F.col("_id").alias("component_id"), F.col("doc_id").alias("_head"))
        named = found.join(heads, "component_id").select(F.col("doc_id").alias("_id"), "n_shingles", "_head").join(numbers, "_id")
        own = given.where("doc_id is not null").select("doc_id", "_digest").join(named, ["doc_id", "_digest"]).select("doc_id", "n_shingles", F.col("_head").alias("component_id"))
        none = rows.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
        return own.unionByName(none)

    def _across(self, members: DataFrame, label: DataFrame, facts: DataFrame) -> DataFrame:
        """Pairs of one bucket that are in different components, except those with the bucket's smallest set, which are settled.

        A pair is taken where its first common n-gram can be: after positions i and j, no more
        than the rest of either set is in common. Short parities rule most of the others out inside the join. A bucket is split by bands of
        sizes: sets that are alike are in one band or in two that adjoin.
        """
        labelled = members.where("a <> b").join(label.withColumnRenamed("id", "b"), "b", "left").select("gram", "b", "pos", F.coalesce("label", "b").alias("label"))
        labelled = cut_lineage(labelled)
        split = labelled.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram")
        quick = [f"q{i}" for i in range(SHORT_WORDS)]
        width = 1.0001 * math.log(100 / self.percent)  # a little wider, so that rounding parts no pair that is alike
        band = F.floor(F.log("n") / width) if width else F.col("n")
        rest = labelled.join(split, "gram").join(facts.withColumnRenamed("id", "b"), "b").select("gram", "b", "label", "n", (F.col("n") - F.col("pos")).alias("room"), *quick).withColumn("band", band)
        other = rest.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).select("gram", "band", *[F.col(c).alias(f"{c}_c") for c in ("b", "label", "n", "room", *quick)])
        apart = " + ".join(f"bit_count({q} ^ {q}_c)" for q in quick)
        like = f"{100 + self.percent} * least(room, room_c) >= {self.percent} * (n + n_c) and ({apart}) * {100 + self.percent} <= (n + n_c) * {100 - self.percent}"
        pairs = rest.join(other, ["gram", "band"]).where(f"(n < n_c or n = n_c and b < b_c) and label <> label_c and {self.close_sizes('n', 'n_c')} and {like}")
        return cut_lineage(pairs.select(F.least("b", "b_c").alias("a"), F.greatest("b", "b_c").alias("b")).distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b): label is the smallest id of its component.

    Alternating large and small stars: each round hangs the neighbours of a node on the smallest
    of them, until all hang on the smallest of their component. Rounds grow with the logarithm of the size.
    The driver keeps a record of each task, so a round has as few stages as it can, and none follows the last one to see that it was the last.
    """
    edges = edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u > v").distinct()
    while True:
        both = edges.selectExpr("inline(array(struct(u, v), struct(v AS u, u AS v)))")
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("inline(array(struct(u, m AS v), struct(v AS u, m AS v)))").where("u > v")
        edges = cut_lineage(small.distinct())
        if _are_stars(edges):
            return edges.selectExpr("inline(array(struct(u AS id, v AS label), struct(v AS id, v AS label)))").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of edges (u, v), u > v, hangs on one other that hangs on none."""
    ends = edges.selectExpr("inline(array(struct(u AS id, 1 AS hangs, 0 AS holds), struct(v AS id, 0 AS hangs, 1 AS holds)))")
    return ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with _digest, of the text, and (doc_id, _digest, _id): numbers in order of both, for each doc_id and text."""
    given = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = given.where("doc_id is not null").select("doc_id", "_digest").distinct()
    return given, cut_lineage(keys.orderBy("doc_id", "_digest").withColumn("_id", F.monotonically_increasing_id()))


def drop_near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """docs, all columns, with one document of each group of near duplicates: the one with the smallest doc_id.

    A document is a doc_id with a text; of several texts with the smallest doc_id, that of the least digest stays. Rows that repeat both stay or go together. Null, empty and
    blank texts, and rows without a doc_id, stay.
    """
    texts = docs.where("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"))
    if texts.groupBy("doc_id").agg(F.min("_digest").alias("lo"), F.max("_digest").alias("hi")).where("lo <> hi").isEmpty():
        return without_ids(docs, join.components(docs).where("doc_id <> component_id").select("doc_id"))
    rows = as_rows(docs, "doc_id", "text").withColumn("_digest", F.sha2(F.coalesce("_key1", F.lit("")), 256))
    given, numbers = numbered(docs.select("doc_id", "text"))
    found = join.components(given.join(numbers, ["doc_id", "_digest"]).select(F.col("_id").alias("doc_id"), "text"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct().join(numbers, "_id").select("doc_id", "_digest")
    return rows.join(gone, (F.col("_key0") == F.col("doc_id")) & (rows["_digest"] == gone["_digest"]), "left_anti").select("_row.*")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Join().components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""
