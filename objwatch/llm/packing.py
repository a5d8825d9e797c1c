"""Best-fit packing of tokenised documents, after Martello-Toth dominance reduction.

Lengths are at most the capacity, so how many pieces have each length is all that packing needs:
a histogram of at most `capacity` rows goes to the driver, whatever the corpus. There, pieces of
equal length are handled together. The result is a list of segments, "ranks lo to hi of length w
lie k to a sequence from sequence q on at offset o"; each piece finds its own by its rank among
the pieces of its length, which is counted in parallel.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objwatch.llm.common import cut_lineage, map_batches, table

CAPACITY = 2048
END_ID = 0
#: Runs of letters, and other words, whose ids a worker keeps: twice as many at most, and none of over LONGEST characters.
RUN_CACHE, WORD_CACHE, LONGEST = 150_000, 50_000, 64
#: Bytes of texts that are looked at together.
BLOCK_BYTES = 1 << 20
#: Rows of one length that one window of ranks holds, about.
RANK_ROWS = 2_000
#: And such windows of one length whose sizes are added up together.
RANK_SHARDS = 2_048


#: Letters of words that are parts by themselves: Latin ones with one lower case each. And ASCII symbols but the apostrophe, which begins tokens with letters.
LETTERS = "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)]) if c not in "\u00d7\u00f7\u0130")
SYMBOLS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


class _Ids:
    """Token ids of many strings in one array: of string i, ids[begin[i] : begin[i + 1]]."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.begin = ids, np.concatenate([[0], np.cumsum(lengths)])

    def take(self, which: np.ndarray) -> _Ids:
        """The strings of these numbers, one after the other."""
        lengths = self.begin[which + 1] - self.begin[which]
        out = _Ids(self.ids[:0], lengths)
        at = np.arange(out.begin[-1]) + np.repeat(self.begin[which] - out.begin[:-1], lengths)
        out.ids = self.ids[at]
        return out

    def join(self, other: _Ids) -> _Ids:
        """The strings of both."""
        return _Ids(np.concatenate([self.ids, other.ids]), np.diff(np.concatenate([self.begin, other.begin[1:] + self.begin[-1]])))


class _Cache:
    """Ids of strings; learn(strings) finds those it does not hold. It forgets what was not asked for lately: what is found among the old moves to the young."""

    def __init__(self, size: int, learn: Callable[[list[str]], _Ids]):
        self.size, self.learn = size, learn
        self.young, self.old = self._none(), self._none()

    @staticmethod
    def _none() -> tuple[dict[str, int], _Ids]:
        return {}, _Ids(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def of(self, strings: list[str]) -> _Ids:
        """Their ids, in order; strings differ from each other."""
        if len(self.young[0]) > self.size:
            self.old, self.young = self.young, self._none()
        (rows, kept), (old, ids) = self.young, self.old
        at = np.fromiter(map(rows.get, strings, repeat(-1)), np.int64, len(strings))
        missing = np.flatnonzero(at < 0)
        wanted = [strings[i] for i in missing.tolist()]
        before = np.fromiter(map(old.get, wanted, repeat(-1)), np.int64, len(wanted))
        new = np.flatnonzero(before < 0)
        again = np.flatnonzero(before >= 0)
        kept = kept.join(ids.take(before[again])).join(self.learn([wanted[i] for i in new.tolist()]))
        at[missing[np.concatenate([again, new])]] = np.arange(len(rows), len(rows) + len(wanted))
        found = kept.take(at)
        own = at[missing]
        if max(map(len, wanted), default=0) > LONGEST:  # long ones are forgotten at once
            fit = np.array([i for i, s in enumerate(wanted) if len(s) <= LONGEST], np.int64)
            kept = kept.take(np.concatenate([np.arange(len(rows)), own[fit]]))
            wanted, own = [wanted[i] for i in fit.tolist()], np.arange(len(rows), len(rows) + len(fit))
        rows.update(zip(wanted, own.tolist(), strict=True))
        self.young = rows, kept
        return found


class WordTokenizer:
    """Token ids of whole texts, by way of the ids of their words.

    The vocabulary's pre-tokeniser never joins characters across a space or line feed and its
    normaliser has no rule that looks across one, so a text's ids are its words' ids in order. It
    parts letters from symbols, too, and makes letters lower case: words of Latin letters and
    symbols are the ids of their letters in lower case and those of their symbols. Each word of a
    block of texts is looked at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.of_runs = Tokenizer(self.tokenizer.model)  # the vocabulary is shared
        # runs of letters in lower case need no normalising, and a space between them is where they part
        self.of_runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.runs, self.whole = _Cache(RUN_CACHE, self._of_runs), _Cache(WORD_CACHE, self._each)

    def _each(self, strings: list[str]) -> _Ids:
        found = [e.ids for e in self.tokenizer.encode_batch(strings, add_special_tokens=False)]
        return _Ids(np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64))

    def _of_runs(self, runs: list[str]) -> _Ids:
        """Ids of runs of letters, one of which may be empty; joined by spaces, they are one text whose ids the ends of words part."""
        if "" in runs:
            at = runs.index("")
            found = self._of_runs(runs[:at] + runs[at + 1 :])
            return _Ids(found.ids, np.insert(np.diff(found.begin), at, 0))
        ids = [np.array(self.of_runs.encode_batch_fast([" ".join(runs[i : i + 20_000])], add_special_tokens=False)[0].ids, np.uint32) for i in range(0, len(runs), 20_000)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        return _Ids(ids, np.diff(ends, prepend=0)) if len(ends) == len(runs) else self._each(runs)

    def _of_words(self, words: pa.Array) -> _Ids:
        """Ids of words that differ from each other: first those of letters and symbols, in two parts; then all others."""
        letters, symbols = pc.utf8_rtrim(words, SYMBOLS), pc.utf8_ltrim(words, LETTERS)
        size = pc.binary_length(words).to_numpy()
        parted = pc.binary_length(letters).to_numpy() + pc.binary_length(symbols).to_numpy() == size
        letters = pc.utf8_lower(letters.filter(pa.array(parted))).dictionary_encode()
        symbols = symbols.filter(pa.array(parted)).dictionary_encode()
        others = words.filter(pa.array(~parted))
        parts = self.runs.of(letters.dictionary.to_pylist()).join(self.whole.of(symbols.dictionary.to_pylist()))
        n = len(letters)
        both = np.empty(2 * n, np.int64)
        both[::2] = letters.indices.to_numpy()
        both[1::2] = symbols.indices.to_numpy().astype(np.int64) + len(letters.dictionary)
        doubled = parts.take(both)
        found = _Ids(doubled.ids, np.diff(doubled.begin[::2])).join(self.whole.of(others.to_pylist()))
        place = np.empty(len(words), np.int64)
        place[parted] = np.arange(n)
        place[~parted] = n + np.arange(len(others))
        return found.take(place)

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and where each text begins; one entry more is the end."""
        words = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        known = self._of_words(coded.dictionary).join(_Ids(np.array([end_id], np.uint32), np.array([1])))
        per = words.value_lengths().to_numpy()
        ends = np.cumsum(per)
        found = known.take(np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(coded.dictionary)))
        return found.ids, found.begin[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_TOKENIZERS: dict[str, WordTokenizer] = {}  # of this worker


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK_BYTES; a row is never split."""
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > BLOCK_BYTES:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encoded_blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """In a worker: (rows, ids, begin) of blocks of texts; see WordTokenizer.encode()."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    try:
        for batch in batches:
            for lo, hi in _blocks(pc.binary_length(batch["text"]).fill_null(0).to_numpy()):
                part = batch.slice(lo, hi - lo)
                yield part, *_TOKENIZERS[path].encode(part["text"], end_id)
    finally:
        _TOKENIZERS[path].forget()  # a worker lives on, beside others


def crc_of(ids: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[int]:
    """The CRC-32 of stretches of ids as unsigned little-endian numbers of 32 bits."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents of over capacity ids are cut into pieces of capacity."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, begin in encoded_blocks(batches, path):
            sizes = np.diff(begin)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            crc = crc_of(ids, begin[doc] + start, length)
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", "text"), run, PIECES)


class Plan:
    """Segments of a packing. Each is (length, lo, hi, per, sequence, offset): ranks lo..hi-1 of that length, per to a sequence."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left = capacity, {w: n for w, n in counts.items() if n}
        self.lengths = sorted(self.left)
        self.used: dict[int, int] = defaultdict(int)
        self.sequences, self.segments = 0, []
        self.reduced = 0

    def _put(self, w: int, bins: int, per: int, sequence: int, offset: int) -> None:
        """The next bins * per pieces of length w go to bins sequences."""
        lo = self.used[w]
        self.used[w] = hi = lo + bins * per
        self.left[w] -= bins * per
        if not self.left[w]:
            self.lengths.pop(bisect.bisect_left(self.lengths, w))
        self.segments.append((w, lo, hi, per, sequence, offset))

    def _largest(self, room: int) -> int | None:
        at = bisect.bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else None

    def _fix(self, bins: int, *lengths: int) -> None:
        """bins sequences hold these lengths each, for good."""
        offset, first = 0, self.sequences
        for w in dict.fromkeys(lengths):
            per = lengths.count(w)
            self._put(w, bins, per, first, offset)
            offset += w * per
        self.sequences += bins
        self.reduced += bins

    def reduce(self) -> None:
        """Fix every set that dominates all other sets with its largest piece j:

        j alone if nothing else fits; j with a k that fills the sequence; and j with the largest
        k that fits if no two pieces fit beside j, or if k is as large as any two that fit and no three do.
        """
        for j in sorted(self.left, reverse=True):
            while self.left[j]:
                room = self.capacity - j
                n = self.left[j]
                k = self._largest(room)
                if k == j and n == 1:  # its only partner would be itself
                    at = bisect.bisect_left(self.lengths, j)
                    k = self.lengths[at - 1] if at else None
                if k is None:
                    self._fix(n, j)
                    continue
                small = self._smallest(3, j)
                if j + k != self.capacity and len(small) > 1 and small[0] + small[1] <= room and not ((len(small) < 3 or sum(small) > room) and k >= self._best_pair(room, j)):
                    break
                if k == j:
                    self._fix(n // 2, j, j)
                else:
                    self._fix(min(n, self.left[k]), j, k)

    def _smallest(self, n: int, j: int) -> list[int]:
        """The n smallest lengths left beside one piece j, with repetition."""
        out: list[int] = []
        for w in self.lengths:
            out += [w] * min(n - len(out), self.left[w] - (w == j))
            if len(out) == n:
                break
        return out

    def _best_pair(self, room: int, j: int) -> int:
        best, hi = 0, bisect.bisect_right(self.lengths, room) - 1
        for lo in range(hi + 1):
            while hi >= lo and self.lengths[lo] + self.lengths[hi] > room:
                hi -= 1
            if hi < lo:
                break
            a, b = self.lengths[lo], self.lengths[hi]
            if a != b or self.left[a] - (a == j) > 1:
                best = max(best, a + b)
        return best

    def best_fit(self) -> None:
        """Longest first, each piece into the fullest sequence that still takes it; new ones where none does."""
        rooms: list[int] = []  # sorted
        open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)

        def give(room: int, first: int, n: int) -> None:
            if n and room:
                if not open_bins[room]:
                    bisect.insort(rooms, room)
                open_bins[room].append((first, n))

        for w in sorted(self.left, reverse=True):
            while n := self.left[w]:
                at = bisect.bisect_left(rooms, w)
                if at == len(rooms):
                    give(self.capacity, self.sequences, max(1, n // (self.capacity // w)))
                    self.sequences += max(1, n // (self.capacity // w))
                    continue
                room = rooms[at]
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
                per = min(room // w, n)
                fill = min(bins, n // per)
                self._put(w, fill, per, first, self.capacity - room)
                give(room - per * w, first, fill)
                give(room, first + fill, bins - fill)

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.segments, columns=["length", "lo", "hi", "per", "sequence", "offset"]).astype("int64").sort_values(["length", "lo"])


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def _ranked(pieces: DataFrame) -> DataFrame:
    """Add rank, from 0, among the pieces of one length. _n numbers the pieces; no window holds much more than RANK_ROWS rows of a length, whatever their ids.

    What is before a shard is added up in two levels, so that the one window by length alone sees a row for some four million pieces.
    """
    per_length = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("_of"))  # at most `capacity` rows
    shard = F.pmod(F.xxhash64("_n"), F.floor(F.col("_of") / RANK_ROWS) + 1)
    sharded = pieces.join(F.broadcast(per_length), "length").withColumn("_shard", shard)
    sizes = sharded.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_size")).withColumn("_coarse", F.floor(F.col("_shard") / RANK_SHARDS))

    def before(order: str, *keys: str) -> Column:
        return F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = sizes.groupBy("length", "_coarse").agg(F.sum("_size").alias("_size")).select("length", "_coarse", before("_coarse", "length").alias("_outside"))
    inside = sizes.select("length", "_coarse", "_shard", before("_shard", "length", "_coarse").alias("_inside"))
    starts = inside.join(tops, ["length", "_coarse"]).select("length", "_shard", (F.col("_inside") + F.col("_outside")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32", "_n")) - 1
    return sharded.withColumn("_own", own).join(starts, ["length", "_shard"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_of", "_shard", "_own", "_before", "_n")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of docs(doc_id, text, ...): PIECES, sequence_id and offset.

    A null text counts as empty and is one id, END_ID. Repeated rows, and rows without an id, are packed
    each for itself. An empty table gives no rows. Other columns are ignored.
    """
    pieces = cut_lineage(tokenized_pieces(docs, tokenizer, capacity).withColumn("_n", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    segments = plan_packing(counts, capacity).frame()
    columns = {c: segments[c].to_numpy() for c in segments}
    # one number that grows with (length, lo), to search by
    step = max([1, *counts.values()]) + 1
    keys = columns["length"] * step + columns["lo"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, length * step + rank, "right") - 1
            nth = rank - columns["lo"][at]
            per = columns["per"][at]
            sequence = columns["sequence"][at] + nth // per
            offset = columns["offset"][at] + nth % per * length
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(_ranked(pieces), place, f"{PIECES}, sequence_id bigint, offset bigint")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
