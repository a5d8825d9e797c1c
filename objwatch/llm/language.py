"""Language identification by a string kernel, Nystroem landmarks and kernel ridge regression.

The kernel is the blended-spectrum presence kernel: the share of character n-grams, of all
lengths in ORDERS, that two texts have in common, |A n B| / sqrt(|A| |B|), with n-grams hashed
to SLOTS places. A text is thus a row of bits. Scores of a block of texts are two matrix
products: kernel values against the landmarks, then one-versus-rest ridge weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objwatch.llm.common import map_batches, table

ORDERS = (1, 2, 3)
SLOTS = 1 << 14
#: Bound of the training sample: rows over all languages (at least 8 a language), of whatever length.
TRAIN_ROWS = 1200
LANDMARKS = 192
RIDGE = 1e-3
UNKNOWN = "und"
#: Code points that one block of presence rows is made from, and its most rows.
BLOCK_CHARS, BLOCK_ROWS = 1 << 20, 128

_ASCII = np.zeros(128, np.uint32)
_ASCII[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def presence(texts: list[str]) -> np.ndarray:
    """(len(texts), SLOTS) booleans: which hashed n-grams a text has. Anything but letters is one blank."""
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) + 1 for t in lowered])
    codes = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, _ASCII[codes & 127], codes)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    letter = codes > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes, row = codes[keep], row[keep]
    out = np.zeros(len(texts) * SLOTS, bool)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[:-1] if n > 1 else h) * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in ORDERS and len(h):
            own = row[: len(h)] == row[n - 1 :]
            slot = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - SLOTS.bit_length() + 1)
            out[(row[: len(h)].astype(np.int64) * SLOTS + slot)[own]] = True
    return out.reshape(len(texts), SLOTS)


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that make blocks; a text is never split."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > BLOCK_CHARS or i - begin >= BLOCK_ROWS):
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, (m, SLOTS / 8)
    weights: np.ndarray  # (m, languages)

    def scorer(self):
        if not self.languages:
            return lambda texts: (np.zeros(len(texts), int), np.zeros(len(texts)))
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        marks = np.ascontiguousarray((marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))).T)
        weights = self.weights.astype(np.float32)

        def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            best, value = np.zeros(len(texts), int), np.zeros(len(texts))
            for lo, hi in blocks(texts):
                rows = presence(texts[lo:hi])
                kernel = rows.astype(np.float32) @ marks / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
                each = kernel @ weights
                best[lo:hi] = each.argmax(1)
                value[lo:hi] = each.max(1)
            return best, np.clip(value, 0, 1)

        return score


def fit(bits: np.ndarray, labels: list[str]) -> Model:
    """One-versus-rest kernel ridge regression in the span of landmarks, which are spread over the languages."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, SLOTS // 8), np.uint8), np.zeros((0, 0)))
    y = np.array([languages.index(x) for x in labels])
    turn = np.zeros(len(y))
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    marks = np.sort(np.lexsort((y, turn))[:LANDMARKS])
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    kernel = (x @ x[marks].T).astype(float)
    values, vectors = np.linalg.eigh(kernel[marks])
    sound = values > 1e-8 * values.max()
    root = vectors[:, sound] / np.sqrt(values[sound])
    phi = kernel @ root
    target = np.eye(len(languages))[y]
    target = target / target.sum(0).clip(1)  # languages count alike, however often they occur
    balance = target.sum(1, keepdims=True)
    solved = np.linalg.solve((phi * balance).T @ phi + RIDGE * np.eye(phi.shape[1]), phi.T @ target)
    return Model(languages, bits[marks], root @ solved)


def has_letter() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def sample_bits(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, list[str]]:
    """Presence bits and languages of at most max(rows, 8 a language) rows of docs(doc_id, text, lang), the first by hash in each language.

    Bits are made where the texts are, from whole texts. Rows that repeat doc_id, text and lang count once, so that
    what comes to the driver is bounded however often rows repeat.
    """
    usable = docs.where(F.col("lang").isNotNull() & has_letter())
    h = F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n")).collect()}
    if not counts:
        return np.zeros((0, SLOTS // 8), np.uint8), []
    quota = max(8, rows // len(counts))
    span = 1 << 30
    cut = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(span, int(span * (1.2 * quota + 20) / n)))])
    chosen = usable.select("lang", "text", h.alias("h")).where(F.pmod("h", F.lit(span)) < F.element_at(cut, F.col("lang"))).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in blocks(texts):
                packed = np.packbits(presence(texts[lo:hi]), axis=1)
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(lo, hi - lo) for c in ("lang", "h")), pa.array([x.tobytes() for x in packed], pa.binary())], ["lang", "h", "bits"])

    got = sorted(map_batches(chosen, run, "lang string, h bigint, bits binary").collect(), key=lambda r: (r["lang"], r["h"], bytes(r["bits"])))
    taken: dict[str, int] = dict.fromkeys(counts, 0)
    bits, labels = [], []
    for r in got:
        if taken[r["lang"]] < quota:
            taken[r["lang"]] += 1
            bits.append(np.frombuffer(bytes(r["bits"]), np.uint8))
            labels.append(r["lang"])
    return np.stack(bits) if bits else np.zeros((0, SLOTS // 8), np.uint8), labels


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return fit(*sample_bits(docs, rows))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text, ...).

    Null, empty and letterless texts are `und` with score 0, as is any text if the model has seen
    no language. The score is the ridge estimate for the language chosen, held between 0 and 1.
    Ties go to the first language in order of name. A very long text is scored whole; what is kept of it is which of a
    fixed number of slots its n-grams fill. Rows are independent, a null doc_id is carried; other columns are ignored.
    """
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                best = np.full(part.num_rows, len(names) - 1)
                value = np.zeros(part.num_rows)
                lettered = np.flatnonzero(part["lettered"].to_numpy(zero_copy_only=False)) if model.languages else []
                if len(lettered):
                    best[lettered], value[lettered] = score(part["text"].take(pa.array(lettered)).to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(names[best], pa.string()), pa.array(value)], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", has_letter().alias("lettered"))
    return map_batches(rows, run, "doc_id bigint, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
