"""Which texts are copies of a smaller doc_id's, by compressed tries over ranges of texts.

Three steps. A bounded sample gives separators: the shortest prefixes that part its sorted texts into ranges of equal weight,
so they are as long as their neighbours are alike. Each task inserts the texts of a block into a trie, which settles all rows but the
smallest of each text in the block, and deals that one to the range of its prefix. A task of the second step
inserts the texts of a range into one trie, whose terminals hold the smallest id, and walks it for the flags.
Ranges and blocks only balance the work; the flags do not depend on them.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objwatch.llm.common import BATCH_BYTES, map_batches

#: Ranges of texts, and bytes of the sample (expected) that parts them. Longer texts than LONGEST are not sampled.
RANGES, SAMPLE_BYTES, LONGEST = 1024, 32 << 20, 1 << 20
#: Bytes of texts in the trie of a block, and in the trie of a range, about: larger ranges are dealt to several slots by the texts' hash.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 64 << 20
#: Keys among which rows are dealt that need no trie any more.
SETTLED = 1 << 16


class Node:
    """The end of an edge with the bytes of label; terminal: rows hold the payloads of the texts that end here, least their smallest id."""

    __slots__ = ("children", "label", "least", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.rows, self.least = label, {}, None, None


def _common(a: bytes, b: bytes) -> int:
    """How many bytes a and b begin with in common."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A compressed trie: inner nodes but the root have two children at least or are terminals."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes, key: int | None, row) -> None:
        """Add a whole text with its id (None: of no order) and a payload."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                at = len(text)
            elif text.startswith(child.label, at):
                at += len(child.label)
            else:
                n = _common(child.label, text[at : at + len(child.label)])
                part = node.children[text[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                part.children[child.label[0]] = child
                child, at = part, at + n
            node = child
        if node.rows is None:
            node.rows = []
        node.rows.append((key, row))
        if key is not None and (node.least is None or key < node.least):
            node.least = key

    def terminals(self) -> Iterator[tuple[int | None, list]]:
        """(least id, [(id, payload) ...]) of each different text."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.rows is not None:
                yield node.least, node.rows
            todo += node.children.values()


def separators(texts: DataFrame, text: str, n_bytes: int, ranges: int = RANGES, sample_bytes: int = SAMPLE_BYTES) -> list[bytes]:
    """At most ranges - 1 prefixes in order. Copies in the sample count once, as they cost the second step next to nothing."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({x for b in batches for x in b.column(0).cast(pa.binary()).to_pylist()})
        at = sorted({len(found) * k // ranges for k in range(1, ranges)} - {0})
        yield pa.RecordBatch.from_arrays([pa.array([found[i][: _common(found[i - 1], found[i]) + 1] for i in at], pa.binary())], ["prefix"])

    sample = texts.select(text).where(F.octet_length(text) <= LONGEST).sample(min(1.0, sample_bytes / max(1, n_bytes)), 13)
    return sorted(r["prefix"] for r in map_batches(sample.repartition(1), part, "prefix binary").collect())


FLAGGED = pa.schema([("key", pa.int64()), ("part", pa.string()), ("payload", pa.int32()), ("n", pa.int64()), ("copy", pa.bool_())])
DEALT = pa.schema([*FLAGGED, ("range", pa.int32()), ("slot", pa.int32()), ("text", pa.string())])


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + size], strict=True), schema, strict=True)], schema=schema)


def flag_copies(docs: DataFrame, n_bytes: int | None = None, ranges: int = RANGES, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, part, payload, n, copy): is a text the same as that of any smaller key? Over all of docs(key bigint, part string, payload int, text).

    text is not null; part and payload are carried along. n counts rows that are the same in all of these. Rows of one key and text are no copies of each
    other. A row without a key is no copy, and nothing is a copy of it. n_bytes is the size of all texts, if it is known.
    """
    if n_bytes is None:
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    borders = separators(docs, "text", n_bytes, ranges)
    slots = -(-n_bytes // (ranges * range_bytes)) or 1

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, dealt = Trie(), 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal dealt
            out, size = [], 0
            for least, rows in trie.terminals():
                same = Counter(rows)  # few: copies differ in their ids
                for (k, (part, payload, slot, whole)), n in same.items():
                    dealt += 1
                    if k is None or k != least:  # no copy, or surely one
                        out.append((k, part, payload, n, k is not None, -1, dealt % SETTLED, None))
                        continue
                    out.append((k, part, payload, n, None, bisect.bisect_right(borders, whole), slot % slots, whole.decode()))
                    size += len(whole)
                    if size > BATCH_BYTES:
                        yield from _batches(out, DEALT)
                        out, size = [], 0
            yield from _batches(out, DEALT)

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("key", "part", "payload", "slot")]
            for k, part, payload, slot, whole in zip(*columns, batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                trie.insert(whole, k, (part, payload, slot, whole))
                held += len(whole) + 100
                if held > block_bytes:
                    yield from block()
                    trie, held = Trie(), 0
        yield from block()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = Trie(), None
        flags = lambda trie: _batches([(k, part, payload, n, k > least) for least, rows in trie.terminals() for k, (part, payload, n) in rows], FLAGGED)
        for batch in batches:
            settled = pc.less(batch["range"], 0)
            if pc.any(settled).as_py():
                yield batch.filter(settled).select(FLAGGED.names)
                batch = batch.filter(pc.invert(settled))
            columns = [batch[c].to_pylist() for c in ("key", "part", "payload", "n", "range", "slot")]
            for k, part, payload, n, area, slot, whole in zip(*columns, batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                if (area, slot) != now:
                    yield from flags(trie)
                    trie, now = Trie(), (area, slot)
                trie.insert(whole, k, (part, payload, n))
        yield from flags(trie)

    # a number by the whole text, where ranges are dealt to several slots
    slot = F.lit(0) if slots == 1 else F.pmod(F.xxhash64("text"), F.lit(1 << 30)).cast("int")
    given = docs.select(F.col("key").cast("bigint").alias("key"), "part", F.col("payload").cast("int").alias("payload"), "text", slot.alias("slot"))
    dealt = map_batches(given, settle, "key bigint, part string, payload int, n bigint, copy boolean, range int, slot int, text string")
    return map_batches(dealt.repartition("range", "slot").sortWithinPartitions("range", "slot"), walk, "key bigint, part string, payload int, n bigint, copy boolean")
