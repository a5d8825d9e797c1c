"""Repair of the structure of conversations, as cheapest paths through a lattice of edits.

A conversation's rows are columns of a lattice whose states say what the repaired roles may go on with: an optional system turn,
and then user and assistant in turn. Arcs are edits with whole costs. Prices of nodes are found by the auction algorithm for shortest paths: a path
grows along the arc that its last node's price can pay for, and where there is none, the price rises to the cheapest arc and the path shrinks.
From the last column to the first, paths from each node end at nodes whose prices are settled. Where all prices are settled, arcs that they pay for exactly are those
of cheapest repairs; they are followed from the first column on, all at once, by the least letter.

What is before a column matters for its prices only by the next column's prices to each other, so columns are told apart by few cases.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from objwatch.llm.common import map_batches, table

#: Where roles may go from each state: nothing yet, after the system turn, after a user's, after an assistant's; and where they may end.
GO: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Characters that are not seen at the ends of texts.
WHITE = " \t\n\x0b\x0c\r"
END = "."


def arcs(code: str) -> list[list[tuple[str, int, int, bool]]]:
    """For each state, the arcs (edit, cost, state, stays in the column) of a row: its role's initial, in upper case if the text is cut off; d if it must go; END after the last row."""
    out = []
    for state, go in enumerate(GO):
        found = [("I", INSERT, go[r], True) for r in ROLES if r in go]
        if code == END:
            found += [("", 0, state, False)] if state in ENDS else []
        else:
            found.append(("D", DELETE, state, False))
            if code != "d":
                more = CUT_OFF if code.isupper() else 0
                found += [("K", KEEP + more, go[code.lower()], False)] if code.lower() in go else []
                found += [("R", REROLE + more, go[r], False) for r in ROLES if r in go and r != code.lower()]
        out.append(found)
    return out


def auction(arcs_of: list[list[tuple[str, int, int, bool]]], beyond: tuple[int, ...]) -> list[int]:
    """Prices of a column's states, the costs of their cheapest ways; beyond are those of the next column."""
    price, settled = [min(beyond)] * len(arcs_of), set()
    for origin in range(len(arcs_of)):
        path = [origin]
        while path[-1] not in settled:
            node = path[-1]
            cost, to, stays = min((cost + (price[to] if stays else beyond[to]), to, stays) for _, cost, to, stays in arcs_of[node])
            if price[node] < cost:  # nothing can be paid for: the price rises, the path gives the node up
                price[node] = cost
                if len(path) > 1:
                    path.pop()
            elif stays:
                path.append(to)
            else:
                break
        settled.update(path)
    return price


class Lattice:
    """Columns that were met, by their code and the next column's prices to each other."""

    def __init__(self):
        self.arcs: dict[str, list] = {}
        self.known: dict[tuple, int] = {}
        self.columns: list[tuple[int, tuple, list]] = []  # (least price, prices less that, tight arcs of each state)
        self.steps: dict[tuple, tuple[str, frozenset]] = {}

    def _column(self, code: str, beyond: tuple[int, ...]) -> int:
        if (code, beyond) not in self.known:
            arcs_of = self.arcs.setdefault(code, arcs(code))
            price = auction(arcs_of, beyond)
            tight = [[(edit, to, stays) for edit, cost, to, stays in found if cost + (price[to] if stays else beyond[to]) == price[state]] for state, found in enumerate(arcs_of)]
            self.known[code, beyond] = len(self.columns)
            self.columns.append((min(price), tuple(p - min(price) for p in price), tight))
        return self.known[code, beyond]

    def _step(self, column: int, states: frozenset) -> tuple[str, frozenset]:
        """The least letters that lead from states to the next column, and to which of its states."""
        if (column, states) not in self.steps:
            tight, at, text = self.columns[column][2], states, ""
            while True:
                open_arcs = [arc for state in at for arc in tight[state]]
                edit = min(e for e, _, _ in open_arcs)
                at, text = frozenset(to for e, to, _ in open_arcs if e == edit), text + edit
                if edit != "I":
                    break
            self.steps[column, states] = text, at
        return self.steps[column, states]

    def cheapest(self, codes: str) -> tuple[int, str]:
        """The least cost, and the first in order of the edits that have it."""
        cost, beyond, met = 0, (0,) * len(GO), array("I")
        for code in END + codes[::-1]:
            met.append(self._column(code, beyond))
            least, beyond, _ = self.columns[met[-1]]
            cost += least
        cost += beyond[0]
        states, out = frozenset([0]), []
        for column in reversed(met):
            text, states = self._step(column, states)
            out.append(text)
        return cost, "".join(out)


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


PLAN = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _prepared(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest): null role and text are one space."""
    given = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    return given.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation after each other, by turn, nulls first; equal turns by role and the text's digest."""
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "digest")


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of rows(conv_id, turn, role, text, ...).

    Only marks of rows are brought together, never texts: a byte a row is held, as the audit is.
    """
    return _plans(_prepared(rows), rows.schema["conv_id"].dataType)


def _plans(prepared: DataFrame, kind) -> DataFrame:
    seen = F.rtrim("text", F.lit(WHITE))
    marks = prepared.select("conv_id", "turn", "role", "digest", F.when(seen == "", "b").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "t").otherwise("").alias("mark"))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    # the first turn of each role and text, added up before it is joined: a text may be any share of a conversation
    firsts = marks.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    told = marks.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    told = told.select("conv_id", "turn", "role", "digest", "mark", F.coalesce(at > F.col("_first"), F.lit(False)).alias("again"))
    schema = StructType([StructField("conv_id", kind), *[StructField(c, StringType() if c == "audit" else LongType()) for c in PLAN]])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, out, now, size = Lattice(), [], None, 0

        def plan() -> tuple:
            cost, audit = lattice.cheapest(codes.tobytes().decode("ascii"))
            gaps = last - first + 1 - turns if turns else 0
            return (*now, gaps, *counts, illegal, cost, audit)

        for conv, turn, role, digest, mark, again in _grouped(batches, ("conv_id", "turn", "role", "digest", "mark", "again")):
            if now != (conv,):
                if now is not None:
                    out.append(plan())
                    size += len(out[-1][-1]) + 64
                if size > 1 << 20:
                    yield _records(out, schema)
                    out, size = [], 0
                now, codes, counts, illegal, turns, first, last, before, initial = (conv,), array("b"), [0, 0, 0], 0, 0, None, None, None, None
            if turn is not None and (turns == 0 or turn != last):
                first, last, turns = turn if turns == 0 else first, turn, turns + 1
            fault = 0 if mark == "b" else 1 if again or before == (turn, role, digest) else 2 if mark == "t" else None
            if fault is not None:
                counts[fault] += 1
            illegal += initial is not None and initial + role[:1] not in LEGAL
            initial, before = role[:1], (turn, role, digest)
            code = "d" if fault in (0, 1) else initial if initial in ("s", "u", "a") else "x"
            codes.append(ord(code.upper() if fault == 2 else code))
        if now is not None:
            out.append(plan())
        if out:
            yield _records(out, schema)

    return map_batches(_ordered(told), solve, schema)


def _records(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema.names)


def _edited(rows: DataFrame) -> DataFrame:
    """Of each conversation a row with its plan (place 0), and then its repaired rows in order, by place from 1 on; those of one conversation are in one task and in order."""
    prepared, kind = _prepared(rows), rows.schema["conv_id"].dataType
    planned = _plans(prepared, kind)
    empty = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = planned.select("conv_id", F.lit(0).alias("kind"), empty("turn", "bigint"), empty("role", "string"), empty("digest", BinaryType()), empty("text", "string"), *PLAN)
    texts = prepared.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", *[empty(c, "string" if c == "audit" else "bigint") for c in PLAN])
    schema = StructType([StructField("conv_id", kind), StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType()), *[StructField(c, StringType() if c == "audit" else LongType()) for c in PLAN]])
    none = (None,) * len(PLAN)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now = [], 0, None
        place = at = state = 0
        audit = ""

        def inserted() -> Iterator[tuple]:
            """Rows that the audit puts in here."""
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                r = "u" if "u" in GO[state] else "a"
                state, at, place = GO[state][r], at + 1, place + 1
                yield (now, place, ROLES[r], "", *none)

        for conv, head, role, text, *plan in _grouped(batches, ("conv_id", "kind", "role", "text", *PLAN)):
            if head == 0:
                out += inserted()
                now, place, at, state, audit = conv, 0, 0, 0, plan[-1]
                out.append((conv, 0, None, None, *plan))
                size += len(audit) + 64
            else:
                out += inserted()
                done, at = audit[at], at + 1
                if done != "D":
                    r = role[:1] if done == "K" else "u" if "u" in GO[state] else "a"
                    state, place = GO[state][r], place + 1
                    out.append((conv, place, role if done == "K" else ROLES[r], text, *none))
                    size += len(text) + 64
            if size > 1 << 20:
                yield _records(out, schema)
                out, size = [], 0
        out += inserted()
        if out:
            yield _records(out, schema)

    return map_batches(_ordered(heads.unionByName(texts), "kind"), edit, schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations of rows(conv_id, turn, role, text, ...), numbered from 1.

    Keeping a row is free, giving it the other role costs 1, leaving it out 2, an empty row 5; a text that is cut off costs 5 unless it is left out.
    Blank rows, and those that say again what the role has said, are left out. Of the cheapest repairs, the first by the edits' initials counts.
    Null role and text are one space; a null turn comes first, equal turns go by role and text digest; a null conv_id is one conversation; repeated rows are
    repetitions. A very long text is one value and is held once. A conversation of which nothing is left has no rows. Other columns are ignored.
    """
    return _edited(rows).where("place > 0").select("conv_id", "place", "role", "text")


def digests(rows: DataFrame) -> DataFrame:
    """plans() with repaired_sha256, the digest of a conversation's repaired `role:text`, joined by line feeds. Texts stream through the hash."""
    edited = _edited(rows)
    schema = StructType([*[f for f in edited.schema if f.name == "conv_id" or f.name in PLAN], StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, found = [], None, hashlib.sha256()
        for conv, place, role, text, *plan in _grouped(batches, ("conv_id", "place", "role", "text", *PLAN)):
            if place == 0:
                if head is not None:
                    out.append((*head, found.hexdigest()))
                if len(out) >= 5000:
                    yield _records(out, schema)
                    out = []
                head, found = (conv, *plan), hashlib.sha256()
            else:
                found.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
        if head is not None:
            out.append((*head, found.hexdigest()))
        if out:
            yield _records(out, schema)

    return map_batches(edited, run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults, by a checksum of conversation and turn: some rows are dropped, emptied, stripped of full stops, repeated or given to the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(case == 4, "user").otherwise(filled("role"))
    given = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("_case")).where("_case <> 0")
    return given.withColumn("_copy", F.explode(F.when(F.col("_case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy", "_case")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which damage() leaves nothing have zeros, no edits and the digest of nothing."""
    given = table(spark, sf_dir, "conversations")
    found = digests(damage(given))
    ids = given.select(F.col("conv_id").alias("_id")).distinct()
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    filled: dict[str, Column] = {c: F.coalesce(c, F.lit("" if c == "audit" else 0)) for c in PLAN}
    return out.select(F.col("_id").alias("conv_id"), *[x.alias(c) for c, x in filled.items()], F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
