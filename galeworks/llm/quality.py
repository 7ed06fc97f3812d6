"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, or runs of other signs; line ends count as signs.
TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
#: Distinct tokens whose hash a task remembers; the store is emptied when full.
MEMORY = 400_000
#: Distances in tokens at which a 2-gram that occurs again is counted.
REPEATS = 6


class Hashed(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[token] = h = zlib.crc32(token.encode("utf-8", "surrogatepass")) + 1
        return h


def features(text: str, bits: int, hashes: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots of the hashed word 1- and 2-grams of a whole text, and their weights: log(1 + count), of length 1.

    2-grams that stood up to REPEATS places before count in a slot of their distance as well, whatever their words.
    """
    words = TOKEN.findall(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    again = [np.full(int((two[k:] == two[:-k]).sum()), k, np.uint64) for k in range(1, min(REPEATS, len(two) - 1) + 1)]
    mixed = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), *(a * np.uint64(0x9FB21C651E98DF25) for a in again)])
    slots = (mixed >> np.uint64(64 - bits)).astype(np.int32)
    if len(slots) * 4 > 1 << bits:
        counts = np.bincount(slots, minlength=1 << bits)
        found = np.flatnonzero(counts).astype(np.int32)
        counts = counts[found]
    else:
        found, counts = np.unique(slots, return_counts=True)
    value = np.log1p(counts)
    return found, value / np.sqrt(value @ value)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        z = self.bias + float(self.weights[slots] @ values)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.2) -> QualityModel:
    """FTRL-proximal over sparse rows (slots, values, label), in the given order, `epochs` times; slot 2**bits is the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rate = lambda s: (beta + np.sqrt(n[s])) / alpha

    def weights(s: np.ndarray) -> np.ndarray:
        free = np.where(s == 1 << bits, 0.0, l1)
        return np.where(np.abs(z[s]) <= free, 0.0, -(z[s] - np.sign(z[s]) * free) / (rate(s) + l2))

    for _ in range(epochs):
        for slots, values, label in rows:
            s, x = np.append(slots, 1 << bits), np.append(values, 1.0)
            w = weights(s)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[s] += g - (np.sqrt(n[s] + g * g) - np.sqrt(n[s])) / alpha * w
            n[s] += g * g
    every = weights(np.arange((1 << bits) + 1))
    return QualityModel(every[:-1], float(every[-1]), bits)


def held_out():
    """Whether a row's label is kept from training: crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, bits: int = 18, max_train_docs: int = 4000) -> QualityModel:
    """The model from at most `max_train_docs` labelled documents that are not held out.

    The sample is bounded by that parameter (rows in the order of a checksum of their id); only the labels are ordered, and texts of
    the sample alone are turned into features. Rows without id, label or text are left out; of repeated ids one label is
    taken. Without any labelled row the model scores 0.5.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.crc32(F.concat(F.lit("order"), F.col("doc_id").cast("string")).cast("binary"))
    sample = known.withColumn("turn", order).orderBy("turn", "doc_id").limit(max_train_docs)
    read = docs.where("text is not null").select("doc_id", "text").join(sample, "doc_id").select("doc_id", "turn", "quality", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashed()
        for batch in batches:
            found = [features(t.as_py(), bits, hashes) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1].astype("f4") for f in found], pa.list_(pa.float32()))], names=["doc_id", "turn", "quality", "slots", "val"])

    got = read.select(F.col("doc_id").cast("long"), F.col("turn").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(vectors, "doc_id long, turn long, quality int, slots array<int>, val array<float>").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("turn", "doc_id", "quality")), range(got.num_rows), strict=True))
    seen: dict[int, int] = {}
    for _, doc_id, _, i in rows:
        seen.setdefault(doc_id, i)
    slots, values = got.column("slots"), got.column("val")
    return train_ftrl([(slots[i].values.to_numpy(), values[i].values.to_numpy().astype("f8"), label) for _, doc_id, label, i in rows if seen[doc_id] == i], bits)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row of docs (doc_id, text).

    A score is the sparse dot product of a whole text's n-grams and the weights; null and empty texts get the bias's score. The
    model (2**bits numbers) travels with the task. Null and repeated ids are passed through; null ids are not held out.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits doubles: a fixed bound

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = Hashed(), shipped.value
        for batch in batches:
            scores = [own.score(*features(t.as_py() or "", own.bits, hashes)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores `least` or more, with all their columns, in one pass over the texts."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = Hashed(), shipped.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(*features(t.as_py() or "", own.bits, hashes)) >= least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
