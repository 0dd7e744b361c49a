"""Target-distribution importance resampling over hashed runs of words.

A document's features are its runs of 1 to n words. One scan reads its bytes once: a ring keeps the
running zlib states of the runs that began at the last words, each next word extends them all by a
space and itself and begins one more, and every state on the way is a feature's CRC, whose bucket is
emitted. No run is ever built as text. Corpus and target are counted by bucket, a bucket's gain is
the log-ratio of their smoothed shares in whole thousandths, a document's weight is the sum of its
features' gains, and Gumbel noise seeded by its id makes the highest scores a sample without
replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discarding, id_and_text, materialize, positioned, rows_out, text_batches

#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20
#: Letters a-z, digits and all beyond ASCII stay, A-Z become a-z, what is left separates words.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

EMITTED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])
WEIGHED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= CHUNK else data.rfind(b" ", at, at + CHUNK) + 1
        if end <= at:  # a word longer than a chunk
            end = data.find(b" ", at) + 1 or len(data)
        yield data[at:end].split()
        at = end


def ring_states(text: str, n: int) -> tuple[int, array]:
    """(words, CRC of every run of 1 to n words): at each word those of the runs that end there, the longest first."""
    crc, out, states, words = zlib.crc32, array("I"), [], 0
    for some in words_of(text):
        words += len(some)
        if n == 1:
            out.extend(map(crc, some))
            continue
        for word in some:
            more = b" " + word
            states = [crc(more, s) for s in states]
            states.append(crc(word))
            out.extend(states)
            if len(states) == n:
                del states[0]
    return words, out


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _emit(n: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        words, features, raw = [], [], []
        for text in batch.column("text").to_pylist():
            count, states = ring_states(text, n)
            words.append(count)
            features.append(len(states))
            raw.append((np.frombuffer(states, np.uint32) % buckets).astype(_width(buckets)).tobytes() if states else b"")
        yield rows_out(EMITTED, [batch.column("doc_id"), words, features, raw])


def emitted(docs: DataFrame, n: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the buckets of a text's features in order, two bytes each (four for over 65,536 buckets)."""
    return id_and_text(docs, id_col, text_col).mapInArrow(partial(_emit, n, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _count(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            total += np.bincount(np.frombuffer(raw.as_buffer(), _width(buckets)), minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: each task sends its sums, and at most one row per bucket comes to the driver."""
    total = np.zeros(buckets, np.int64)
    for row in features.select("buckets").mapInArrow(partial(_count, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket, in doubles."""
    up, down = float(own.sum() + len(own)), float(target.sum() + len(own))
    return np.array([math.floor(1000 * math.log((t + 1.0) * up / ((s + 1.0) * down))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(table, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gain = table.value
    for batch in batches:
        weight = [int(gain[np.frombuffer(raw.as_buffer(), _width(buckets))].sum()) for raw in batch.column("buckets")]
        yield rows_out(WEIGHED, [batch.column(c) for c in ("doc_id", "row", "n_words", "n_features")] + [weight])


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in whole thousandths, by the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    Of the N documents with least_words words or more, floor(percent * N / 100) are drawn by score,
    ties to the smaller doc_id. Null text: no words, weight 0, never drawn. Null doc_id: a row as
    any, its noise that of the empty id, last among ties. Repeated rows: a row each, of
    neighbouring ranks. Very long texts are read whole, a part at a time. Empty table: no rows.
    Empty target: all its counts are 0. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    with discarding(spark):
        features = materialize(emitted(docs, n, buckets).withColumn("row", F.monotonically_increasing_id()), "features")  # the number is written, so it stays with its row
        aim = emitted(target.withColumn("doc_id", F.lit(None)) if "doc_id" not in target.columns else target, n, buckets, text_col=target_text)
        table = spark.sparkContext.broadcast(gains(bucket_counts(features, buckets), bucket_counts(aim, buckets)))  # `buckets` longs
        weighed = features.select("doc_id", "row", "n_words", "n_features", "buckets").mapInArrow(partial(_weigh, table, buckets), "doc_id long, row long, n_words long, n_features long, weight long")
        scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("short", F.col("n_words") < least_words), "scored")
        drawn = scored.filter("not short").count() * percent // 100
        order = [F.col("short").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
        placed = positioned(scored, order, "ranked")
        rank = F.when(~F.col("short") & (F.col("position") < drawn), F.col("position") + 1)
        return materialize(placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank")), "resampled", outer=True)
