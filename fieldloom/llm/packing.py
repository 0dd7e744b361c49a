"""Packing along a space-filling curve.

Each document's ids are hashed to a vector (every id adds its weight, heavier for rarer ids, with
a hashed sign to a hashed one of BUCKETS entries), which is projected to DIMS dimensions; its
direction is put on a grid of BITS a dimension, and the cell's Hilbert index becomes the sort key.
A range sort by (key, doc_id, row) puts like documents side by side, on as many tasks as wanted;
equal keys and ids are split by the row's number, so a large group spreads over tasks. Each task cuts its run
of ids every `length` ids. The rest at a task's end becomes sequences of power-of-two lengths, so
there is no padding at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, materialize, rows_out, small_batches, text_batches
from .hashing import STEP, mix
from .tokens import word_ids

DIMS, BITS, BUCKETS = 4, 12, 4096

KEYED = pa.schema([("doc_id", pa.int64()), ("curve_key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length")] + [("ids", pa.binary())] + [(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")])
DIGEST = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of cells (n x dims, each below 2**bits), by transposed Gray code, for all rows at once."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@lru_cache(maxsize=2)
def projection(size: int, dims: int = DIMS, seed: int = 7) -> np.ndarray:
    """What each id adds to the projected vector: the projection of its bucket, times its sign and a weight that grows with the id, as later merges are rarer."""
    h = mix(np.arange(size, dtype=np.uint64) * STEP + np.uint64(seed))
    sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
    buckets = np.random.Generator(np.random.Philox(seed)).normal(size=(BUCKETS, dims))
    return (buckets[(h % np.uint64(BUCKETS)).astype(np.int64)] * (sign * np.log2(2 + np.arange(size)))[:, None]).astype(np.float32)


def curve_keys(ids: list[np.ndarray], size: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each document; 0 for documents without ids."""
    keys = np.zeros(len(ids), np.int64)
    have = [i for i, v in enumerate(ids) if len(v)]
    if have:
        table = projection(size, dims)
        sums = np.stack([table[ids[i]].sum(0, dtype=np.float64) for i in have])
        unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        cells = np.clip((unit + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
        keys[have] = hilbert_index(cells, bits)
    return keys


def _key(path: str, end_id: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = word_ids(path)
    size = encoder.tokenizer.get_vocab_size()
    end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
    for batch in text_batches(batches):
        raw = [encoder.ids(t) for t in batch.column("text").to_pylist()]
        keys = curve_keys([np.frombuffer(r, encoder.dtype) for r in raw], size)
        raw = [r + end for r in raw]
        yield rows_out(KEYED, [batch.column("doc_id"), keys, [len(r) // encoder.dtype.itemsize for r in raw], raw])


def _cut(length: int, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one task's run, of ids as wide as their number says; sequence ids are the task's number in the upper bits, so that they are unique without a count over tasks."""
    sequence, offset, schema = 0, 0, PIECES if keep else DIGEST
    part, tail = 0, []  # tail: pieces of the sequence that is open

    def out(pieces: list[list]) -> pa.RecordBatch:
        return rows_out(schema, [list(c) for c in zip(*pieces, strict=True)])

    def piece(doc, ids: np.ndarray, a: int, b: int, total: int, seq: int, at: int) -> list:
        raw = ids[a:b].astype("<u4").tobytes()
        return [doc, a, b - a, raw if keep else zlib.crc32(raw), total, (part << 40) + seq, at]

    for batch in text_batches(batches):
        done = []
        columns = (batch.column(n).to_pylist() for n in ("part", "doc_id", "n_tokens", "ids"))
        for part, doc, n, raw in zip(*columns, strict=True):
            ids = np.frombuffer(raw, f"<u{len(raw) // n if n else 2}")
            a = 0
            while a < len(ids):
                b = min(len(ids), a + length - offset)
                tail.append((doc, ids, a, b))
                offset += b - a
                a = b
                if offset == length:
                    at = 0
                    for d, v, c, e in tail:
                        done.append(piece(d, v, c, e, len(v), sequence, at))
                        at += e - c
                    sequence, offset, tail = sequence + 1, 0, []
        if done:
            yield out(done)
    done = []
    room, at = 0, 0  # of the power of two that is open
    for d, v, c, e in tail:
        while c < e:
            if room == 0:
                room, at = 1 << (offset.bit_length() - 1), 0
                offset -= room
            k = min(room, e - c)
            done.append(piece(d, v, c, c + k, len(v), sequence, at))
            c, at, room = c + k, at + k, room - k
            if room == 0:
                sequence += 1
    if done:
        yield out(done)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, length: int = 4096, ids: bool = True) -> DataFrame:
    """Pieces of packed sequences: (doc_id, start, length, ids or ids_crc32, doc_tokens, sequence_id, offset).

    Null text: empty (the end id alone). Null doc_id: kept, first among equal keys. Repeated rows:
    a document each, side by side. Empty table: no pieces. Very long documents are cut over many
    sequences. Other columns are ignored. ids are little-endian unsigned 32-bit. The pieces of a
    sequence lie in one partition, in order.
    """
    keyed = id_and_text(docs).mapInArrow(partial(_key, tokenizer_path, end_id), "doc_id long, curve_key long, n_tokens long, ids binary")
    with small_batches(docs.sparkSession, 4 << 20):
        keyed = materialize(keyed.withColumn("row", F.monotonically_increasing_id()), "curve")  # written with the rows, so a number stays with its row
    ranged = keyed.repartitionByRange("curve_key", "doc_id", "row").sortWithinPartitions("curve_key", "doc_id", "row")
    last = "ids binary" if ids else "ids_crc32 long"
    return ranged.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "ids").mapInArrow(
        partial(_cut, length, ids), f"doc_id long, start long, length long, {last}, doc_tokens long, sequence_id long, offset long"
    )
