"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, each byte a fixed vector of character traits. Learned filters of
WIDTH bytes slide over them by STRIDE; their outputs are max-pooled over overlapping chunks that
cover the whole document. The chunks' mean, maximum and spread go through one hidden layer into
one probability. Filters are trained by gradient descent through the pooling, over whole texts and where these are: each of
a few tasks goes on from the same filters, and their filters are averaged after each round. Then the head is trained on top.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objwatch.llm.common import cut_lineage, map_batches, table

TRAITS, STRIDE, WIDTH, FILTERS = 8, 4, 8, 32
CELL = 64  # bytes that are pooled first
CHUNK, HOP = 8, 7  # cells of a chunk, and cells from one chunk to the next: chunks overlap by one cell
HIDDEN = 16
FEATURES = 4 * FILTERS + 1
#: Bound of the training sample: rows of each label, of any length. Tasks that learn filters, and texts and bytes of one step of theirs.
TRAIN_ROWS, TASKS, STEP_TEXTS, STEP_BYTES = 700, 4, 24, 1 << 22
EPOCHS, HEAD_STEPS = 12, 600
#: Bytes convolved at once.
BLOCK_BYTES = 1 << 19


def _traits() -> np.ndarray:
    out = np.zeros((256, TRAITS), np.float32)
    for b in range(1, 256):
        c = chr(b)
        out[b, :6] = [b < 128 and c.islower(), b < 128 and c.isupper(), c.isdigit() and b < 128, b in (32, 9), b in (10, 13), b >= 128]
        out[b, 6] = b > 32 and b < 127 and not c.isalnum() and c not in ".,"
        out[b, 7] = c in ".,"
    return out


BYTE_TRAITS = _traits()


def _cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each filled up with 0 to whole cells (one at least), and the number of cells of each."""
    n = np.array([max(1, -(-len(t) // CELL)) for t in texts])
    joined = b"".join(t.ljust(k * CELL, b"\0") for t, k in zip(texts, n, strict=True))
    return np.frombuffer(joined, np.uint8), n


def _cell_maxima(data: np.ndarray, n: np.ndarray, filters: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each cell's maximum over its windows, and, with places, which of them it is; BLOCK_BYTES at a time, as a text may have any length.

    A window may reach into the next cell, but not into the next text: there it sees zeros.
    """
    per = CELL // STRIDE
    begins = (np.cumsum(n) - n) * per
    top, where = [], []
    for a in range(0, len(data), BLOCK_BYTES):
        steps = BYTE_TRAITS[data[a : a + BLOCK_BYTES + STRIDE]].reshape(-1, STRIDE * TRAITS)  # one step more: windows reach into it
        both = steps @ filters  # first and second half of each window
        lo, hi = np.searchsorted(begins, [a // STRIDE, a // STRIDE + len(steps)])
        both[begins[lo:hi] - a // STRIDE, FILTERS:] = 0
        own = min(len(steps), BLOCK_BYTES // STRIDE)
        value = both[:own, :FILTERS]
        after = both[1 : own + 1, FILTERS:]
        value[: len(after)] += after
        value = value.reshape(-1, per, FILTERS)
        top.append(value.max(1))
        if places:
            where.append(value.argmax(1).astype(np.uint8))
    return np.concatenate(top), np.concatenate(where) if places else None


def _chunks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each chunk (chunks, CHUNK), the last one of a text repeated to fill, and the first chunk of each text."""
    per = np.maximum(1, -(-(n - 1) // HOP))
    first = np.cumsum(per) - per
    own = np.repeat(np.arange(len(n)), per)
    begin = (np.arange(per.sum()) - first[own]) * HOP
    inside = np.minimum(begin[:, None] + np.arange(CHUNK), n[own][:, None] - 1)
    return inside + (np.cumsum(n) - n)[own][:, None], first


@dataclass
class Network:
    filters: np.ndarray  # (STRIDE * TRAITS, 2 * FILTERS)
    bias: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]
    head: tuple[np.ndarray, ...]
    shift: float = 0.0  # log odds of the labels' shares, which training evens out

    def features(self, texts: list[bytes]) -> np.ndarray:
        data, n = _cells(texts)
        pooled = np.maximum(_cell_maxima(data, n, self.filters)[0] + self.bias, 0)
        cells, first = _chunks(n)
        chunk = pooled[cells].max(1)
        per = np.diff(np.append(first, len(chunk)))[:, None]
        start = np.cumsum(n) - n
        mean_cell = np.add.reduceat(pooled, start) / n[:, None]
        spread = np.sqrt(np.maximum(np.add.reduceat(pooled**2, start) / n[:, None] - mean_cell**2, 0))
        size = np.log1p([[len(t)] for t in texts])
        return np.concatenate([np.add.reduceat(chunk, first) / per, np.maximum.reduceat(chunk, first), mean_cell, spread, size], 1).astype(np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        w, c, v, d = self.head
        hidden = np.tanh((x - self.scale[0]) / self.scale[1] @ w + c)
        return 1 / (1 + np.exp(-np.clip(hidden @ v + d + self.shift, -40, 40)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        begin = size = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or i > begin and size + len(texts[i]) > BLOCK_BYTES:
                if i > begin:
                    out[begin:i] = self.probability(self.features(texts[begin:i]))
                begin, size = i, 0
            size += len(texts[i]) + CELL if i < len(texts) else 0
        return out


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, **params: tuple[np.ndarray, np.ndarray]) -> None:
        self.t += 1
        for k, (p, g) in params.items():
            m, v = self.state.setdefault(k, (np.zeros_like(p), np.zeros_like(p)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Learner:
    """Filters and their bias as they are learned, by descent of the log loss of a linear score of the chunks' mean."""

    def __init__(self, rng: np.random.Generator):
        draw = lambda scale, *shape: (rng.normal(size=shape) * scale).astype(np.float32)
        self.params = {"filters": draw(0.25, STRIDE * TRAITS, 2 * FILTERS), "bias": np.zeros(FILTERS, np.float32), "w": draw(0.1, FILTERS), "b": np.zeros(1, np.float32)}
        self.adam = _Adam(0.01)

    def step(self, texts: list[bytes], y: np.ndarray) -> None:
        """One step on whole texts. Only the windows that are a chunk's maximum are looked at again for the gradient."""
        filters, bias, w, b = self.params.values()
        data, n = _cells(texts)
        top, where = _cell_maxima(data, n, filters, True)
        pooled = top + bias
        cells, first = _chunks(n)
        which = np.take_along_axis(cells, pooled[cells].argmax(1), 1)  # cell of each chunk's maximum
        top = np.take_along_axis(pooled, which, 0)
        per = np.diff(np.append(first, len(top)))
        mean = np.add.reduceat(np.maximum(top, 0), first) / per[:, None]
        error = (1 / (1 + np.exp(-np.clip(mean @ w + b, -30, 30))) - y) / len(y)
        back = np.repeat(error / per, per)[:, None] * w * (top > 0)
        place = which * (CELL // STRIDE) + np.take_along_axis(where, which, 0)
        steps = data.reshape(-1, STRIDE)
        inside = np.append(np.ones(len(steps), bool), False)  # where a window's second half may be
        inside[(np.cumsum(n) - n) * (CELL // STRIDE)] = False
        g = np.zeros_like(filters)
        for f in range(FILTERS):
            g[:, f] = back[:, f] @ BYTE_TRAITS[steps[place[:, f]]].reshape(-1, STRIDE * TRAITS)
            after = place[:, f] + 1
            g[:, FILTERS + f] = (back[:, f] * inside[after]) @ BYTE_TRAITS[steps[after % len(steps)]].reshape(-1, STRIDE * TRAITS)
        own = {"filters": g, "bias": back.sum(0).astype(np.float32), "w": (error @ mean).astype(np.float32), "b": error.sum(keepdims=True).astype(np.float32)}
        self.adam.step(**{k: (p, own[k]) for k, p in self.params.items()})

    def round(self, rows: Iterator[tuple[bytes, int]]) -> Learner:
        """A step for each STEP_TEXTS rows, or fewer long ones; every text is used whole, and with a snippet of it."""
        held: list[tuple[bytes, int]] = []
        for text, y in chain(rows, [(None, 0)]):
            if held and (text is None or len(held) == STEP_TEXTS or sum(len(t) for t, _ in held) + len(text) > STEP_BYTES):
                self.step([*(t for t, _ in held), *(snippet(t) for t, _ in held)], np.array([y for _, y in held] * 2, float))
                held = []
            held.append((text, y))
        return self

    @staticmethod
    def average(found: list[tuple[Learner, int]]) -> Learner:
        """The mean of learners, weighted by what each has seen, and of what their descent remembers."""
        total = sum(n for _, n in found)
        out = found[0][0]
        mean = lambda parts: sum(x * np.float32(n / total) for x, (_, n) in zip(parts, found, strict=True))
        out.params = {k: mean([x.params[k] for x, _ in found]) for k in out.params}
        out.adam.state = {k: tuple(mean([x.adam.state[k][i] for x, _ in found]) for i in (0, 1)) for k in out.params}
        out.adam.t = max(x.adam.t for x, _ in found)
        return out


def _train_head(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    w, c = rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN)
    v, d = rng.normal(size=HIDDEN) * 0.3, np.zeros(1)
    adam = _Adam(0.01)
    for _ in range(HEAD_STEPS):
        hidden = np.tanh(x @ w + c)
        error = (1 / (1 + np.exp(-np.clip(hidden @ v + d, -30, 30))) - y) / len(y)
        back = error[:, None] * v * (1 - hidden**2)
        adam.step(w=(w, x.T @ back + 2e-4 * w), c=(c, back.sum(0)), v=(v, hidden.T @ error + 2e-4 * v), d=(d, error.sum(keepdims=True)))
    return w, c, v, d


def snippet(text: bytes) -> bytes:
    """A few words of a text: short texts are rare in a sample, and a text's label is that of its parts, good or bad. Which ones depends on the text alone."""
    rng = np.random.default_rng(zlib.crc32(text))
    words = text.split(b" ")
    k = min(len(words), int(rng.integers(1, 16)))
    at = int(rng.integers(0, len(words) - k + 1))
    return b" ".join(words[at : at + k])


def fit(labels: list[int], learn: Callable[[Learner], list[tuple[Learner, int]]], features: Callable[[Network], tuple[np.ndarray, np.ndarray]], odds: float = 0.0, seed: int = 7) -> Network | float:
    """A network, or a constant score if the sample is empty (0.5) or has one label only.

    learn(learner) is a round over all training texts: what each task has made of the learner, and how many texts it saw. features(network) are those of
    the training texts, each as a whole, and of their snippets, which have their labels.
    """
    if len(set(labels)) < 2:
        return float(np.mean(labels)) if labels else 0.5
    rng = np.random.default_rng(seed)
    learner = Learner(rng)
    for _ in range(EPOCHS):
        learner = Learner.average(learn(learner))
    net = Network(learner.params["filters"], learner.params["bias"], (np.zeros(1), np.ones(1)), (), 0.0)
    x = np.concatenate(features(net))
    net.scale = (x.mean(0), x.std(0) + 1e-3)
    net.head = _train_head((x - net.scale[0]) / net.scale[1], np.array([*labels, *labels], float), rng)
    net.shift = odds
    return net


def fit_texts(texts: list[str], labels: list[int], odds: float = 0.0) -> Network | float:
    """fit() on texts that are at hand."""
    raw = [t.encode() for t in texts]
    features = lambda net: tuple(np.concatenate([net.features([f(t)]) for t in raw]) for f in (bytes, snippet))
    return fit(labels, lambda learner: [(learner.round(zip(raw, labels, strict=True)), len(raw))], features, odds)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> Network | float:
    """Fit on at most `rows` documents of either label, the first by hash, of whatever length and whole.

    Labels repeated for a doc_id count once, and of texts with one doc_id one is taken, by hash. Texts stay where they are: filters are
    learned there in rounds, and features come to the driver. Rows of labels without a label or doc_id, and labels without a document, are left out.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    if not counts:
        return 0.5
    span = 1 << 30
    cut = F.create_map(*[F.lit(x) for y, n in sorted(counts.items()) for x in (y, min(span, int(span * (1.3 * rows + 20) / n)))])
    order = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(span))
    chosen = known.withColumn("h", order).where(F.col("h") < F.element_at(cut, F.col("y"))).distinct()  # bounded by rows, and so is its broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    kept = found.groupBy("y", "h", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    first = F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))  # of about 1.3 * rows
    kept = cut_lineage(kept.withColumn("_n", first).where(F.col("_n") <= rows).drop("_n").repartition(TASKS).sortWithinPartitions("h", "doc_id", "y"))
    picked = [(r["y"], r["h"], r["doc_id"]) for r in kept.select("y", "h", "doc_id").collect()]
    place = {key: i for i, key in enumerate(sorted(picked))}

    def learn(learner: Learner) -> list[tuple[Learner, int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = 0

            def texts() -> Iterator[tuple[bytes, int]]:
                nonlocal seen
                for batch in batches:
                    for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                        seen += 1
                        yield text.encode(), y

            made = learner.round(texts())
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary()), pa.array([seen], pa.int64())], ["learner", "seen"])

        return [(pickle.loads(r["learner"]), r["seen"]) for r in map_batches(kept, run, "learner binary, seen bigint").collect()]  # a row for each task

    def features(net: Network) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [t.encode() for t in batch["text"].to_pylist()]
                x = [[net.features([f(t)])[0].astype("<f4").tobytes() for t in raw] for f in (bytes, snippet)]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("y", "h", "doc_id")), *(pa.array(v, pa.binary()) for v in x)], ["y", "h", "doc_id", "whole", "few"])

        out = np.zeros((2, len(picked), FEATURES), np.float32)
        for r in map_batches(kept, run, "y int, h bigint, doc_id bigint, whole binary, few binary").collect():
            for k, c in enumerate(("whole", "few")):
                out[k, place[r["y"], r["h"], r["doc_id"]]] = np.frombuffer(bytes(r[c]), "<f4")
        return out[0], out[1]

    ones = sum(y for y, _, _ in picked)
    share = counts.get(1, 0) / sum(counts.values())
    odds = np.log(share / (1 - share) / (ones / (len(picked) - ones))) if 0 < share < 1 and 0 < ones < len(picked) else 0.0
    return fit([y for y, _, _ in sorted(picked)], learn, features, float(odds))


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """docs and a column score (0 to 1): how likely label 1 is.

    Null counts as empty; an empty text is one cell of zero bytes and gets the score of that.
    A very long text is scored whole, all of its chunks; texts are taken together up to BLOCK_BYTES, or a longer one by itself.
    Rows are independent, repeated ones and those without an id too; an existing column score is replaced.
    """
    kept = [c for c in docs.columns if c != "score"]
    schema = docs.select(kept).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [(t or "").encode() for t in part["text"].to_pylist()]
                value = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(value)], [*kept, "score"])

    return map_batches(docs.select(kept), run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
    scored = score(docs.select("doc_id", "text"), train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
