"""Quality by ordinal regression on graded ratings.

A cumulative-link model: P(grade <= j) = logistic(threshold_j - w.x), one weight vector for all
grades and ordered thresholds. x holds hashed words and the hashed letter triples, within a line,
that touch anything but small letters and spaces, each by log(1 + count), scaled to length one. The model is
fitted on at most FIT_ROWS labelled rows, picked by hash of the id; scoring reads every text in
one pass, without a shuffle, and gives each grade's tail probability and the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_and_text, rows_out, text_batches
from .hashing import STEP, joined_bytes, mix, word_hashes

BUCKETS_BITS = 17
BUCKETS = 1 << BUCKETS_BITS
FIT_ROWS = 8_000
KEEP_TAIL = 0.5

FEATURES = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, bucket, value) of every text's features, in order; values of a text have length one."""
    doc, word = word_hashes(texts)
    data, edges = joined_bytes(texts)
    plain = ((data >= 97) & (data <= 122)) | (data == 32) | (data >= 128)
    line = data == 10
    odd = np.flatnonzero(~((plain[:-2] & plain[1:-1] & plain[2:]) | line[:-2] | line[1:-1] | line[2:])) if len(data) > 2 else np.empty(0, np.int64)
    shape = np.where(((data >= 97) & (data <= 122)) | (data >= 128), 97, np.where((data >= 65) & (data <= 90), 65, np.where((data >= 48) & (data <= 57), 48, data))).astype(np.uint64)
    triple = mix(((shape[odd] << np.uint64(16)) | (shape[odd + 1] << np.uint64(8)) | shape[odd + 2]) * STEP + np.uint64(1))
    docs = np.concatenate([doc, np.searchsorted(edges[1:], odd, side="right")]).astype(np.uint64)
    key = (docs << np.uint64(BUCKETS_BITS)) | (np.concatenate([word, triple]) >> np.uint64(64 - BUCKETS_BITS))
    key, n = np.unique(key, return_counts=True)
    d = (key >> np.uint64(BUCKETS_BITS)).astype(np.int64)
    v = np.log1p(n)
    norm = np.sqrt(np.bincount(d, weights=v * v, minlength=len(texts)))
    return d, (key & np.uint64(BUCKETS - 1)).astype(np.int64), v / norm[d]


class Ordinal:
    """weights (BUCKETS) and ascending thresholds (grades - 1)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 2e-4, steps: int = 300, rate: float = 0.3) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam on all rows at once; thresholds are a first value and positive gaps."""
    n, k = len(grade), grades - 1
    share = np.clip(np.array([(grade > j).mean() if n else 0.5 for j in range(k)]), 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    gaps = np.maximum(np.diff(start), 0.05)
    theta = np.concatenate([start[:1], np.log(gaps)])
    w = np.zeros(BUCKETS)
    if n == 0 or grade.min() == grade.max():
        return Ordinal(w, np.concatenate([start[:1], start[0] + np.cumsum(gaps)]))
    used, at = np.unique(bucket, return_inverse=True)
    w_used = np.zeros(len(used))
    m, s = np.zeros(len(used) + k), np.zeros(len(used) + k)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        z = np.bincount(doc, weights=w_used[at] * value, minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = logistic(edges[grade] - z), logistic(edges[grade + 1] - z)
        p = np.maximum(high - low, 1e-9)
        dl, dh = low * (1 - low) / p, high * (1 - high) / p
        gz = (dh - dl) / n  # of the negative log-likelihood by z
        cut_grad = np.bincount(np.minimum(grade, k), weights=-dh / n * (grade < k), minlength=k + 1)[:k] + np.bincount(np.maximum(grade - 1, 0), weights=dl / n * (grade > 0), minlength=k + 1)[:k]
        back = cut_grad[::-1].cumsum()[::-1]
        g = np.concatenate([np.bincount(at, weights=gz[doc] * value, minlength=len(used)) + ridge * w_used, np.concatenate([back[:1], back[1:] * np.exp(theta[1:])])])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w_used -= step[: len(used)]
        theta -= 0.3 * step[len(used) :]
    w[used] = w_used
    return Ordinal(w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        d, bucket, value = text_features(batch.column("text").to_pylist())
        ends = np.searchsorted(d, np.arange(batch.num_rows), side="right")
        cuts = np.concatenate([[0], ends]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
        yield rows_out(FEATURES, [batch.column("doc_id"), batch.column("grade"), *lists])


def _score(model, grades: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = model.value
    for batch in text_batches(batches):
        d, bucket, value = text_features(batch.column("text").to_pylist())
        tails = own.tails(np.bincount(d, weights=own.weights[bucket] * value, minlength=batch.num_rows))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(1)), pa.FixedSizeListArray.from_arrays(pa.array(tails.reshape(-1)), grades - 1).cast(pa.list_(pa.float64()))], names=["doc_id", "expected_grade", "tails"])


def train(docs: DataFrame, graded: DataFrame, grades: int = 3, fit_rows: int = FIT_ROWS) -> Ordinal:
    """graded: (doc_id, grade 0..grades-1). About fit_rows rows are fitted, fewer if there are fewer; a document graded twice counts with its lowest."""
    one = graded.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    share = min(1.0, fit_rows / max(1, one.count()))
    picked = one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    # about fit_rows rows of two numbers
    rows = id_and_text(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "grade")
    table = rows.mapInArrow(_features, "doc_id long, grade int, at array<int>, value array<float>").toArrow()
    lengths = table.column("at").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(table.num_rows), lengths)
    flat = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("at", "value")]
    return fit(doc, flat[0].astype(np.int64), flat[1].astype(np.float64), table.column("grade").to_numpy().astype(np.int64), grades)


def grade_of(quality: Column, toxic: Column) -> Column:
    """The registered query's grades: 0 poor, 1 good but toxic, 2 good."""
    return F.when(quality.isNull(), None).when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)


def score(docs: DataFrame, model: Ordinal, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """(doc_id, expected_grade, tails, kept) of every whole text: tails[j] = P(grade > j); kept if P(grade > 0) reaches keep_tail.

    Null or empty text: no features, the model's base rates. Null doc_id: scored. Repeated rows: a
    row each. Empty table: no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = id_and_text(docs).mapInArrow(partial(_score, shared, len(model.thresholds) + 1), "doc_id long, expected_grade double, tails array<double>")
    return rows.withColumn("kept", F.col("tails")[0] >= keep_tail)
