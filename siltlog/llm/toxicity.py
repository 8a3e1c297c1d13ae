"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest, slices, table
from .textscan import ALNUM, mix, text_bytes, words

#: Places that features are hashed to, as a power of two: the weights take 4 bytes each, so 1 MB is broadcast.
BITS = 18
#: Labelled rows that the classifier is fitted on, at most: those with the smallest hashes of their ids.
TRAINING_ROWS = 10_000
EPOCHS = 3
ALPHA, BETA, L2 = 0.5, 1.0, 0.1
#: L1 for each training row: gradients add up over rows, and so does what they have to exceed.
L1_A_ROW = 0.005
SLICE = 2 << 20


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text and the text that each is of, in order of text: words, pairs of neighbours, and pairs with a word between them."""
    data, offsets = text_bytes(column)
    found = words(data, offsets, ALNUM)
    h, owner = found.hashes(), found.owner()
    kinds, owners = [h], [owner]
    for gap in (1, 2):
        same = owner[gap:] == owner[:-gap]
        kinds.append(mix(h[:-gap] * np.uint64(2 * gap + 1) + mix(h[gap:]))[same])
        owners.append(owner[gap:][same])
    places = (np.concatenate(kinds) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.concatenate(owners) << bits | places
    key = np.unique(key)  # each feature counts once in a text
    return key & ((1 << bits) - 1), key >> bits


class Ftrl:
    """Logistic regression with a learning rate of its own for each weight, and weights that are 0 unless their gradients add up to more than l1."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = 1.0, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last weight is the intercept, which isn't penalised
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (_sigmoid(w.sum()) - label) * weight
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w

    def all_weights(self) -> np.ndarray:
        return self.weights(np.arange(len(self.z))).astype(np.float32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def packed(at: np.ndarray, bits: int = BITS) -> bytes:
    """A text's features: 4 bytes each, or a bitmap of all places where that is not larger (32 kB for 18 bits)."""
    if 32 * len(at) < 1 << bits:
        return at.astype("<i4").tobytes()
    marks = np.zeros(1 << bits, dtype=bool)
    marks[at] = True
    return np.packbits(marks).tobytes()


def unpacked(data: bytes, bits: int = BITS) -> np.ndarray:
    if 8 * len(data) < 1 << bits:
        return np.frombuffer(data, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def packed_features(column: pa.Array, bits: int = BITS) -> list[bytes]:
    """The packed features of each text."""
    at, owner = features(column, bits)
    ends = np.searchsorted(owner, np.arange(len(column) + 1))
    return [packed(at[a:b], bits) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def fit(rows: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the intercept last, from (text, label)."""
    return fit_packed([(packed_features(pa.array([t or ""], pa.large_string()), bits)[0], int(y)) for t, y in rows], bits, epochs)


def fit_packed(rows: list[tuple[bytes, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (packed features, label). Both labels count alike in sum; the order of rows doesn't matter, as they are shuffled by a fixed seed after sorting."""
    rows = sorted(rows)
    model = Ftrl(1 << bits, l1=L1_A_ROW * len(rows))
    positive = sum(y for _, y in rows)
    if 0 < positive < len(rows):
        weight = {1: len(rows) / (2 * positive), 0: len(rows) / (2 * (len(rows) - positive))}
        order = np.random.default_rng(0).permutation(len(rows))
        for _ in range(epochs):
            for i in order:
                data, label = rows[i]
                model.learn(unpacked(data, bits), label, weight[label])
    return model.all_weights()


def score(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    bits = (len(weights) - 1).bit_length() - 1
    at, owner = features(column, bits)
    return _sigmoid(np.bincount(owner, weights[at], len(column)) + weights[-1])


def train(labelled: DataFrame, id_column: str, text_column: str, label_column: str, most: int = TRAINING_ROWS) -> np.ndarray:
    """Weights from the whole texts of `most` labelled rows at most, those with the smallest hashes of their ids.

    Rows without a label are left out; a null text counts as empty, and equal hashes are put in order by features and label. Texts become features where they are read. These go to one task, at most 4 bytes a feature and
    32 kB a text, which sends back the weights only (4 << BITS bytes).
    """
    rows = labelled.filter(F.col(label_column).isNotNull()).select(
        F.col(text_column).alias("text"),
        F.col(label_column).cast("int").alias("label"),
        F.xxhash64(F.col(id_column).cast("string")).alias("place"),
    )
    last = lowest(rows, "place", most)
    if last is None:
        return fit([])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(packed_features(part.column(0)), pa.binary()), part.column(1), part.column(2)], ["features", "label", "place"])

    encoded = rows.filter(F.col("place") <= last).mapInArrow(encode, "features binary, label int, place long")
    chosen = encoded.orderBy("place", "features", "label").limit(most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [r for b in batches for r in zip(b.column("features").to_pylist(), b.column("label").to_pylist(), strict=True)]
        weights = fit_packed(seen)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["weights"])

    found = chosen.select("features", "label").coalesce(1).mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], dtype="<f4") if found else fit([])


def score_toxicity(docs: DataFrame, id_column: str, text_column: str, weights: np.ndarray) -> DataFrame:
    """One row per row of docs: the id and the score of its whole text, 0 to 1.

    The weights are broadcast. A null or empty text has the score of the
    intercept alone. Equal rows and rows with null ids are treated like
    others; other columns aren't read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(part.column(1), shared.value))], ["id", "score"])

    frame = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return frame.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a toxicity score; rows of fold 0 are held out of the training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter((fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    # the sample is chosen by id before texts are joined
    known = known.withColumn("place", F.xxhash64(F.col("doc_id").cast("string")))
    last = lowest(known, "place", TRAINING_ROWS)
    chosen = known.filter(F.col("place") <= F.lit(last)).orderBy("place", "doc_id").limit(TRAINING_ROWS).drop("place")
    weights = train(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "text", "toxic")
    scored = score_toxicity(docs, "doc_id", "text", weights)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
