"""Quality: counts that fail a text by themselves, and a logistic regression on hashed n-grams.

Words, pairs of words and runs of three bytes are hashed into three histograms; the
square roots of their shares are the inputs. The regression is fitted on a sample of labelled
rows, bounded by a parameter; Platt's scaling on a part kept apart makes its output a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import small_batches
from cairn.llm.features import SPACE, SYMBOL, grams, mixed, repeated_lines, repeated_words, word_hashes, words_of

BUCKETS = 4096
FAMILIES = 3
SAMPLE = 3000


def looked_at(text: str) -> tuple[list[int], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the inputs of the regression."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts, ends = words_of(data)
    h = word_hashes(data, starts, ends)
    letters = int(((data & 0xC0) != 0x80).sum() - SPACE[data].sum())
    counts = [int(h.size), letters, int(SYMBOL[data].sum()), repeated_lines(text), repeated_words(h)]
    inputs = np.zeros((FAMILIES, BUCKETS), np.float32)
    if data.size > 2:
        b = data.astype(np.uint32)
        three = (b[:-2] * np.uint32(0x10001) + b[1:-1] * np.uint32(0x0101F) + b[2:]) * np.uint32(0x9E3779B1)
        inputs[0] = np.bincount(three >> np.uint32(20), minlength=BUCKETS)
    for row, g in ((1, h), (2, grams(h, 2))):
        if g.size:
            inputs[row] = np.bincount((mixed(g) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    inputs /= np.maximum(inputs.sum(1, keepdims=True), 1)
    return counts, np.sqrt(inputs, out=inputs).reshape(-1)


class Model:
    """weights and bias of the regression, scale and shift of its calibration."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float, shift: float):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def probability(self, inputs: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * (inputs @ self.weights + self.bias) + self.shift)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 160, decay: float = 2e-4) -> Model | None:
    """x: one row of inputs for each text; y: 1 for good ones; the last fifth calibrates. None if y has one value only."""
    if y.size < 2 or y.min() == y.max():
        return None
    learnt = y.size - y.size // 5
    if y[learnt:].min(initial=1) == y[learnt:].max(initial=0) or y[:learnt].min() == y[:learnt].max():
        learnt = y.size
    a, t = x[:learnt], y[:learnt].astype(np.float32)
    mean = a.mean(0)
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(w.size + 1, np.float32), np.zeros(w.size + 1, np.float32)
    for i in range(1, rounds + 1):
        error = (sigmoid(a @ w - mean @ w + bias) - t) / np.float32(t.size)
        g = np.append(a.T @ error - mean * error.sum() + decay * w, error.sum()).astype(np.float32)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8) * (1 - i / (rounds + 1))
        w -= step[:-1]
        bias -= float(step[-1])
    bias = float(bias - mean @ w)
    b, u = (x[learnt:], y[learnt:]) if learnt < y.size else (x, y)
    z = (b @ w + bias).astype(np.float64)
    # Platt's targets keep the fit finite when the classes part
    good = u.sum()
    target = np.where(u > 0, (good + 1) / (good + 2), 1 / (u.size - good + 2))
    scale, shift = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(scale * z + shift)
        r, k = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(k * z * z).sum() + 1e-6, (k * z).sum()], [(k * z).sum(), k.sum() + 1e-6]])
        ds, db = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        scale, shift = scale - np.clip(ds, -1, 1), shift - np.clip(db, -2, 2)
    return Model(w, bias, float(max(scale, 1e-3)), float(shift))


def labelled(docs: DataFrame, labels: DataFrame, name: str, most: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most `most` labelled documents, those first by a hash of the id; one row for an id."""
    of = labels.select("doc_id", F.col(name).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    of = of.groupBy("doc_id").agg(F.max("label").alias("label"))
    of = of.orderBy(F.xxhash64(F.lit(name), "doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(of), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The regression, from `sample` labelled texts at most; what comes to the driver is bounded by it, whatever the texts' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [looked_at(t.as_py())[1].astype(np.float16).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    rows = labelled(docs, labels, "quality", sample).mapInArrow(run, "doc_id string, label int, x binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(r["doc_id"].encode()), r["doc_id"]))
    if not rows:
        return None
    y = np.array([r["label"] for r in rows])
    x = np.empty((len(rows), FAMILIES * BUCKETS), np.float32)
    for i in range(len(rows) - 1, -1, -1):
        x[i] = np.frombuffer(rows.pop()["x"], np.float16)
    return fit(x, y)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality for every row of docs.

    quality: the probability of label 1; null where the labels have one value only,
    and then only base_failed decides. Null text: no words. Null ids and repeated
    rows stay, one row out for each row in; other columns are not read; an empty
    table gives an empty one. Whole texts are read; nothing is shuffled but the sample.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, sample)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, scores = [], []
            for cell in batch.column(1):
                c, x = looked_at(cell.as_py() or "")
                counts.append(c)
                scores.append(None if model is None else float(model.probability(x[None])[0]))
            c = np.array(counts, np.int64).reshape(-1, 5)
            failed = (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])
            kept = [not f and (s is None or s >= threshold) for f, s in zip(failed, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c[:, i]) for i in range(5)), pa.array(failed), pa.array(kept, pa.bool_()), pa.array(scores, pa.float64())],
                names=["doc_id", *names, "base_failed", "kept", "quality"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return made.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean, quality double")
