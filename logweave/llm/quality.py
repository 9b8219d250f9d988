"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text's words appear twice among the n-grams of one to three words: as themselves in lower case, and by their
shape (runs of upper case, lower case, digits and other characters), where a word that repeats the one
before it has a shape of its own.  A feature's value is the square root of its share.

* Learned from at most ``sample`` labelled rows, the first in a seeded hash order of the ids that are not held out; scoring
  covers all rows and whole texts.
* Null and empty texts have the bias alone and so a score as well.  Null labels and labels of unknown ids are ignored;
  a label that stands twice counts twice.
* Repeated rows score alike; an empty table gives an empty result; without labels every score is 0.5, predicted 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import common

BITS = 18
#: Number of the bias among the weights, after all hashed features.
BIAS = 1 << BITS
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
#: Classes of bytes: upper and lower case, digits; bytes of other scripts count as lower case.
_KINDS = bytes(
    65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b
    for b in range(256)
)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def shape(word: bytes) -> bytes:
    return _RUNS.sub(rb"\1", word.translate(_KINDS))


class Words(dict):
    """Feature number of a word and hash of its shape, packed in one integer."""

    def __missing__(self, word: bytes) -> int:
        feature = xxhash.xxh3_64_intdigest(word.lower()) & (BIAS - 1)
        packed = (feature << 32) | xxhash.xxh32_intdigest(shape(word))
        self[word] = packed
        return packed


def features(texts: list[bytes], known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value of all features of the texts, without the bias."""
    if len(known) > 1 << 18:
        known.clear()
    lists = [t.split() for t in texts]
    counts = np.array([len(w) for w in lists], np.int64)
    packed = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(lists)), counts)
    same = np.zeros(len(packed), bool)
    same[1:] = (packed[1:] == packed[:-1]) & (owner[1:] == owner[:-1])
    shapes = (packed & 0xFFFFFFFF).astype(np.uint64)
    shapes = common.mix(np.where(same, shapes ^ np.uint64(0x5BD1E995 << 32), shapes))
    keys = [(owner, packed >> 32)]
    # One to three shapes, two and three words.
    for base, sizes in ((shapes, (1, 2, 3)), (common.mix((packed >> 32).astype(np.uint64)), (2, 3))):
        level = base
        for n in range(1, sizes[-1] + 1):
            if n > 1:
                level = common.mix(level[:-1] * np.uint64(31) + base[n - 1 :])
            if n in sizes:
                inside = owner[: len(level)] == owner[n - 1 : n - 1 + len(level)]
                gram = (level & np.uint64(BIAS - 1)).astype(np.int64)
                keys.append((owner[: len(level)][inside], gram[inside]))
    out_owner, out_feature, out_value = [], [], []
    for of, feature in keys:
        pair, n = np.unique((of << BITS) | feature, return_counts=True)
        of, feature = pair >> BITS, pair & (BIAS - 1)
        out_owner.append(of)
        out_feature.append(feature)
        out_value.append(np.sqrt(n / np.maximum(counts[of], 1)))
    return np.concatenate(out_owner), np.concatenate(out_feature), np.concatenate(out_value)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 5, alpha: float = 0.3,
          beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, seed: int = 5) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates, row by row."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at) -> np.ndarray:
        lead = z[at]
        w = -(lead - np.sign(lead) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(lead) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, label = rows[k]
            x = x.astype(float)
            w = weights(at)
            g = (sigmoid(w @ x) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def learn(documents: DataFrame, labels: DataFrame, sample: int = 8_000) -> np.ndarray:
    """Weights from a bounded sample: its ids are chosen among the labels, its features made on the executors.

    The updates, which follow each other, are one task's, which reads the features from the shared folder; only the
    weights come to the driver.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "label").limit(sample)
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in common.slices(batches, 1 << 20, "text"):
            owner, feature, value = features(batch.column("text").to_pylist(), known)
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("label"),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature[order].astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(value[order].astype(np.float32))),
            ], names=["doc_id", "label", "at", "x"])

    # At most ``sample`` ids are broadcast.
    made = common.written(
        documents.select("doc_id", common.as_binary(F.col("text")).alias("text"))
        .join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
        .transform(common.arrow_map, make, "doc_id bigint, label int, at array<int>, x array<float>"),
        "quality-features",
    )
    files = made.inputFiles()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rows = []
            for file in files:
                rows += _labelled(file)
            rows.sort(key=lambda row: row[:3])
            found = train([(at, x, label) for _, label, _, at, x in rows]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["weights"])

    one = documents.sparkSession.range(1, numPartitions=1)
    return np.frombuffer(one.transform(common.arrow_map, fit, "weights binary").first()["weights"], np.float32)


def _labelled(file: str) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """doc_id, label, a hash for equal ones, features and values (the bias last) of a written file, some rows at a time."""
    where, name = common.place(file)
    with where.open_input_file(name) as source:
        for batch in pq.ParquetFile(source).iter_batches(256):
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
            for k, (doc_id, label) in enumerate(zip(ids, marks, strict=True)):
                at = np.append(batch.column("at")[k].values.to_numpy(), np.int32(BIAS))
                x = np.append(batch.column("x")[k].values.to_numpy(), np.float32(1))
                yield doc_id, label, xxhash.xxh3_64_intdigest(at.tobytes()), at, x


def score(documents: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score",
          batch_bytes: int = 2 << 20) -> DataFrame:
    """The score of every row, in a column ``name``, beside the columns ``keep``."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    words = common.fresh("words", [*keep, name])
    rows = documents.select(*keep, common.as_binary(F.col("text")).alias(words))
    schema = documents.select(*keep, F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = shared.value, Words()
        for batch in common.slices(batches, batch_bytes, words):
            owner, feature, value = features(batch.column(words).to_pylist(), known)
            total = np.bincount(owner, value * w[feature], batch.num_rows) + w[BIAS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(sigmoid(total), pa.float64())],
                names=[*keep, name],
            )

    return rows.transform(common.arrow_map, run, schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(documents, learn(documents, labels), ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    name = common.fresh("score", documents.columns)
    scored = score(documents, learn(documents, labels), documents.columns, name)
    return scored.filter(F.col(name) >= 0.5).select(*documents.columns)
