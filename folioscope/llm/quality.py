"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.words import mix, word_hashes
from folioscope.runtime import drop, small_batches, written

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
MAX_TRAINING_ROWS = 8000
#: Bytes of distinct features, 8 each, that come to the driver at most; then the rows with the next hashes are left out.
MAX_TRAINING_BYTES = 128 << 20
#: The model has 2 ** BITS weights.
BITS = 20
_BIGRAM = np.uint64(0xA24BAED4963EE407)


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all texts, bounds of each text).

    A word gives its hash, the hash of its shape, and that of its pair with the next word;
    all pairs of a word with itself are one feature.
    """
    words, shapes, bounds = word_hashes(texts, shapes=True)
    pairs = np.where(words[:-1] == words[1:], np.uint64(0), mix(words[:-1] * _BIGRAM + words[1:]))
    counts = np.diff(bounds)
    inside = np.ones(max(0, len(words) - 1), bool)
    inside[bounds[(bounds > 0) & (bounds < len(words))] - 1] = False
    doc = np.repeat(np.arange(len(texts)), counts)
    numbers = np.concatenate([words, shapes, pairs[inside]]) >> np.uint64(64 - bits)
    order = np.argsort(np.concatenate([doc, doc, doc[:-1][inside]]), kind="stable")
    sizes = np.where(counts > 0, 3 * counts - 1, 0)
    return numbers[order].astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Model:
    """weights[k] of feature k; bias. Each occurrence counts 1 / sqrt(occurrences in the text)."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        bits = int(len(self.weights)).bit_length() - 1
        numbers, bounds = features(texts, bits)
        sizes = np.diff(bounds)
        sums = np.zeros(len(texts))
        if len(numbers):  # each text's own sum, whatever the batch
            sums[sizes > 0] = np.add.reduceat(self.weights[numbers].astype(np.float64), bounds[:-1][sizes > 0])
        z = sums / np.sqrt(np.maximum(sizes, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[bytes, int]], bits: int = BITS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """Fit on distinct feature numbers followed by their counts (32-bit integers as bytes) and labels 0 or 1, in the order given; no rows give score 0.5 everywhere."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def weight(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        w = -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2)
        return np.where(np.abs(zk) <= l1, 0.0, w)

    cases = []
    for numbers, label in rows:
        k, c = np.frombuffer(numbers, "<i4").reshape(2, -1)
        cases.append((np.append(k, size), np.append(c / np.sqrt(max(1, c.sum())), 1.0), label))
    for _ in range(epochs):
        for k, x, label in cases:
            w = weight(k)
            p = 1 / (1 + np.exp(-np.clip(float(w @ x), -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - sigma * w
            n[k] += g * g
    every = weight(np.arange(size + 1))
    return Model(every[:-1].astype(np.float32), float(every[-1]))


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode() for x in column.to_pylist()]


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS, bits: int = BITS) -> Model:
    """Fit on at most max_rows labelled documents for which `usable` (of labels.doc_id) holds.

    The sample is the rows with the smallest hash of their id, so it is the same in every
    run; its feature numbers, not its texts, come to the driver. Null labels, and labelled
    ids without a document, are left out; an id with several labels or texts gives a case for each pair.
    """
    small_batches(docs.sparkSession)
    chosen = labels.filter(usable & F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("label"))
    # At most max_rows rows of two numbers.
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, bounds = features(_texts(batch.column("text")), bits)
            # A text's distinct features and how often it has them: no more than its words, and no more than the weights.
            own = [b"".join(x.astype("<i4").tobytes() for x in np.unique(numbers[a:b], return_counts=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.binary())], names=["doc_id", "label", "numbers"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    cases = rows.mapInArrow(run, "doc_id long, label int, numbers binary")
    ranked = cases.withColumn("__h", F.xxhash64("doc_id")).select("__h", "doc_id", "label", F.xxhash64("numbers").alias("__n"), "numbers")
    held = written(ranked, "features")
    so_far = F.sum(F.octet_length("numbers")).over(Window.orderBy("__h", "doc_id", "label", "__n"))  # max_rows rows
    found = held.select("*", so_far.alias("__bytes")).filter(F.col("__bytes") <= MAX_TRAINING_BYTES).collect()
    drop(held)
    order = sorted(found, key=lambda x: (x.doc_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1, x.doc_id, x.label, x.numbers))
    return fit([(bytes(x.numbers), x.label) for x in order], bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; null counts as empty, and an empty text gets the bias alone. Repeated and null ids stay rows; other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 ** bits weights of 4 bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(_texts(batch.column(1))))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from labelled documents outside the fifth that is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
