"""Token-ID files: static range asymmetric numeral system over independent interleaved blocks.

One frequency table, counted over the whole corpus and scaled to 2**20, serves all files. A block
holds whole documents, but one longer than a block is cut over as many as it needs. Its ids are
dealt round-robin to LANES coders that numpy steps together; each lane has a 64-bit state and shares
one stream of 32-bit words. A block carries a document table, its lanes' starting states, resume
points (state of all lanes and the stream position at every RESUME steps) and a checksum, so blocks,
and parts of a block, decode in parallel: read_range() starts at the resume point before what it wants.

Block layout, little-endian: magic 'FLR2', u32 crc32 of all that follows, u32 documents, u32 ids,
u32 lanes, u32 steps, u32 resume points, u32 words, i64 first token of the block within its file,
i64 ids of the block's first document in blocks before; then i64 doc_id per document, u8 flags per
document (1: id is null, 2: cut), u32 ids per document, u64 state per lane and resume point (the
first is the start), u32 word offset per resume point, u32 words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discarding, id_and_text, materialize, rows_out, text_batches
from .tokens import word_ids

MAGIC = b"FLR2"
SCALE_BITS = 20
LOW = 1 << 31
LANES = 512
RESUME = 128
BLOCK_IDS = 1 << 17
_HEAD = struct.Struct("<IIIIIIqq")
NULL, CUT = 1, 2

TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
BLOCKS = pa.schema([("file_no", pa.int32()), ("block_no", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("cut", pa.bool_()), ("block", pa.binary())])
_PLACE = [("file_no", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64())]
#: before: ids of a cut document in earlier blocks, null for whole documents; in digests only cut ones have ids.
DECODED = pa.schema([*_PLACE, ("before", pa.int64()), ("ids", pa.binary())])
DIGEST = pa.schema([*_PLACE, ("before", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])


# ---------------------------------------------------------------- codec


def scale_counts(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**bits, in proportion to counts."""
    counts = np.asarray(counts, np.float64)
    total, room = counts.sum(), (1 << bits) - len(counts)
    if room < 0:
        raise ValueError("the vocabulary is larger than the scale")
    freq = np.ones(len(counts), np.int64) + (np.floor(counts / total * room).astype(np.int64) if total else 0)
    freq[int(np.argmax(freq))] += (1 << bits) - int(freq.sum())
    return freq


class Table:
    """The shared table: frequency and cumulative start by symbol, and the symbol of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, np.int64))


def encode_ids(ids: np.ndarray, table: Table, lanes: int = LANES, resume: int = RESUME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states by resume point and lane, word offset of each point, words). The last step may be short."""
    bits, shift = np.uint64(SCALE_BITS), np.uint64(32)
    top = np.uint64((LOW >> SCALE_BITS) << 32)
    steps = -(-len(ids) // lanes)
    f, c = table.freq[ids], table.start[ids]
    x = np.full(lanes, LOW, np.uint64)
    chunks, states, sizes = [], [], []
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(len(ids), (s + 1) * lanes)
        fs, xs = f[a:b], x[: b - a]
        if (full := xs >= top * fs).any():
            chunks.append(xs[full].astype(np.uint32))
            xs = np.where(full, xs >> shift, xs)
        else:
            chunks.append(np.empty(0, np.uint32))
        q = xs // fs
        x[: b - a] = (q << bits) + (xs - q * fs) + c[a:b]
        if s % resume == 0:
            states.append(x.copy())
    states, chunks = states[::-1] or [x], chunks[::-1]
    sizes = np.concatenate([[0], np.cumsum([len(k) for k in chunks])]).astype(np.uint32)
    return np.stack(states), sizes[: steps or 1 : resume], np.concatenate(chunks) if chunks else np.empty(0, np.uint32)


def decode_ids(n: int, states: np.ndarray, words: np.ndarray, table: Table, lanes: int, step: int = 0, word: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids from step on (to stop, if given); states and word are those of the resume point at step."""
    mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
    bits, low = np.uint64(SCALE_BITS), np.uint64(LOW)
    x, at = states.copy(), word
    end = n if stop is None else min(n, stop * lanes)
    out = np.empty(end - step * lanes, np.uint32)
    for a in range(step * lanes, end, lanes):
        b = min(end, a + lanes)
        xs = x[: b - a]
        slot = xs & mask
        sym = table.slot[slot]
        out[a - step * lanes : b - step * lanes] = sym
        xs = table.freq[sym] * (xs >> bits) + slot - table.start[sym]
        need = np.flatnonzero(xs < low)
        if len(need):
            xs[need] = (xs[need] << shift) | words[at : at + len(need)].astype(np.uint64)
            at += len(need)
        x[: b - a] = xs
    return out


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, first: int, table: Table, lanes: int = LANES, resume: int = RESUME, before: int = 0, cut: bool = False) -> bytes:
    """before: ids of the first document in earlier blocks; cut: whether that document is cut."""
    lanes = max(1, min(lanes, len(ids) // 8))
    states, offsets, words = encode_ids(ids, table, lanes, resume)
    flags = [NULL * (d is None) | CUT * (cut and k == 0) for k, d in enumerate(doc_ids)]
    body = _HEAD.pack(len(doc_ids), len(ids), lanes, resume, len(offsets), len(words), first, before) + b"".join(
        a.tobytes() for a in (np.array([d or 0 for d in doc_ids], "<i8"), np.array(flags, "u1"), np.array(lengths, "<u4"), states.astype("<u8"), offsets.astype("<u4"), words.astype("<u4"))
    )
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def unpack_block(block: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(doc ids, lengths, ids, first token). Raises if the checksum or the layout is wrong."""
    view = read_block(block)
    ids = decode_ids(view["n"], view["states"][0], view["words"], table, view["lanes"])
    return view["docs"], view["lengths"], ids, view["first"]


def read_block(block: bytes) -> dict:
    if block[:4] != MAGIC or struct.unpack_from("<I", block, 4)[0] != zlib.crc32(memoryview(block)[8:]):
        raise ValueError("damaged block: magic or checksum is wrong")
    docs, n, lanes, resume, points, n_words, first, before = _HEAD.unpack_from(block, 8)
    at = 8 + _HEAD.size

    def take(dtype: str, k: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(block, dtype, k, at)
        at += got.nbytes
        return got

    ids, flags, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    states, offsets, words = take("<u8", points * lanes).reshape(points, lanes), take("<u4", points), take("<u4", n_words)
    names = [None if z & NULL else int(d) for d, z in zip(ids, flags, strict=True)]
    return {"docs": names, "lengths": lengths, "n": n, "lanes": lanes, "resume": resume, "states": states, "offsets": offsets, "words": words, "first": first, "before": before, "cut": bool(docs and flags[0] & CUT)}


def decode_slice(view: dict, table: Table, a: int, b: int) -> np.ndarray:
    """Ids a to b of a block that read_block() has read, decoded from the resume point before a."""
    point = a // view["lanes"] // view["resume"]
    step = point * view["resume"]
    ids = decode_ids(view["n"], view["states"][point], view["words"], table, view["lanes"], step, int(view["offsets"][point]), -(-b // view["lanes"]))
    return ids[a - step * view["lanes"] : b - step * view["lanes"]]


# ---------------------------------------------------------------- Spark stages


def _tokenize(path: str, end_id: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = word_ids(path)
    end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
    for batch in text_batches(batches):
        ids = [encoder.ids(t) + end for t in batch.column("text").to_pylist()]
        yield rows_out(TOKENS, [batch.column("doc_id"), [len(i) // encoder.dtype.itemsize for i in ids], ids])


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of each whole text and the end id, little-endian, two bytes each (four for vocabularies over 65,536)."""
    return id_and_text(docs).mapInArrow(partial(_tokenize, tokenizer_path, end_id), "doc_id long, n_tokens long, ids binary")


def _count(width: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in text_batches(batches):
        new = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width))
        if len(new) > len(total):
            new[: len(total)] += total
            total = new
        else:
            total[: len(new)] += new
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["token", "n"])


def count_tokens(tokens: DataFrame, width: str = "<u2") -> DataFrame:
    """(token, n): at most one row per vocabulary entry; each task sends its own sums only."""
    return tokens.select("ids").mapInArrow(partial(_count, width), "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _encode(table, width: str, block_ids: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = Table(table.value)
    size = np.dtype(width).itemsize
    docs, parts, lengths, first, number, held = [], [], [], 0, 0, 0

    def flush(file_no: int, before: int = 0, cut: bool = False) -> pa.RecordBatch:
        nonlocal docs, parts, lengths, first, number, held
        ids = np.frombuffer(b"".join(parts), width)
        out = rows_out(BLOCKS, [[file_no], [number], [docs[0]], [len(docs)], [len(ids)], [cut], [pack_block(docs, lengths, ids, first, coder, before=before, cut=cut)]])
        docs, parts, lengths, first, number, held = [], [], [], first + held, number + 1, 0
        return out

    file_no = 0
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("file_no", "doc_id", "n_tokens", "ids"))
        for file_no, doc, n, ids in zip(*columns, strict=True):
            if n > block_ids:  # blocks of its own
                if docs:
                    yield flush(file_no)
                for a in range(0, n, block_ids):
                    held = min(block_ids, n - a)
                    docs, parts, lengths = [doc], [ids[size * a : size * (a + held)]], [held]
                    yield flush(file_no, before=a, cut=True)
                continue
            docs.append(doc)
            parts.append(ids)
            lengths.append(n)
            held += n
            if held >= block_ids:
                yield flush(file_no)
    if docs:
        yield flush(file_no)


def _decode(table, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = Table(table.value)
    for batch in batches:
        for file_no, block in zip(batch.column("file_no").to_pylist(), batch.column("block").to_pylist(), strict=True):
            view = read_block(block)
            ids = decode_ids(view["n"], view["states"][0], view["words"], coder, view["lanes"])
            ends = np.cumsum(view["lengths"], dtype=np.int64)
            starts = ends - view["lengths"]
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            cuts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            whole = [None] * len(cuts)
            before = [view["before"], *whole[1:]] if view["cut"] else whole
            place = [[file_no] * len(cuts), view["docs"], view["first"] + starts - (view["before"] if view["cut"] else 0), view["lengths"].astype(np.int64), before]
            if keep:
                yield rows_out(DECODED, [*place, list(map(bytes, cuts))])
            else:
                yield rows_out(DIGEST, [*place, [bytes(cuts[0]), *whole[1:]] if view["cut"] else whole, list(map(zlib.crc32, cuts))])


def _slices(table, start: int, stop: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, ids) of what each block holds of the ids from start to stop; base: ids in files before."""
    coder = Table(table.value)
    for batch in batches:
        for base, block in zip(batch.column("base").to_pylist(), batch.column("block").to_pylist(), strict=True):
            view = read_block(block)
            at = base + view["first"]
            a, b = max(0, start - at), min(view["n"], stop - at)
            if a < b:
                yield pa.RecordBatch.from_arrays([pa.array([at + a]), pa.array([decode_slice(view, coder, a, b).astype("<u4").tobytes()], pa.binary())], names=["start", "ids"])


class TokenFiles:
    """A written set: path/blocks (one Parquet file of blocks per range of doc_id, in ascending order) and path/table (the shared frequencies)."""

    def __init__(self, spark, path: str, freq: np.ndarray | None = None):
        self.spark, self.path = spark, path
        if freq is None:
            rows = spark.read.parquet(f"{path}/table").orderBy("token").collect()  # one row per vocabulary entry
            freq = np.array([r.freq for r in rows], np.int64)
        self.freq = freq

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("file_no int, block_no long, first_doc long, n_docs long, n_tokens long, cut boolean, block binary").parquet(f"{self.path}/blocks")

    def _starts(self) -> DataFrame:
        """Ids in all files before each file: a row per file."""
        totals = self.blocks().groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(self, ids: bool = True) -> DataFrame:
        """(doc_id, start, n_tokens, ids or ids_crc32) decoded from the files; ids are little-endian unsigned 32-bit."""
        table, last = self.spark.sparkContext.broadcast(self.freq), "ids" if ids else "ids_crc32"
        made = "file_no int, doc_id long, local_start long, n_tokens long, before long, ids binary" + ("" if ids else ", ids_crc32 long")
        decoded = lambda which: self.blocks().filter(which).select("file_no", "block").mapInArrow(partial(_decode, table, ids), made)
        whole = decoded("not cut").select("file_no", "doc_id", "local_start", "n_tokens", last)
        joined = F.aggregate(F.array_sort(F.collect_list(F.struct("before", "ids"))), F.lit(b""), lambda x, y: F.concat(x, y["ids"]))
        cut = decoded("cut").groupBy("file_no", "doc_id", "local_start").agg(F.sum("n_tokens").alias("n_tokens"), joined.alias("ids"))
        both = whole.unionByName(cut.select("file_no", "doc_id", "local_start", "n_tokens", "ids" if ids else F.crc32("ids").alias("ids_crc32")))
        # one row per file: bounded by the number of write tasks
        return both.join(F.broadcast(self._starts()), "file_no").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", last)

    def read_range(self, start: int, n: int) -> DataFrame:
        """(start, ids): the n ids of the whole set from start on, in pieces by block. Only blocks that hold some are read, each from the resume point before its first one."""
        table = self.spark.sparkContext.broadcast(self.freq)
        heads = self.blocks().select("file_no", "block_no", "n_tokens", (F.sum("n_tokens").over(Window.partitionBy("file_no").orderBy("block_no")) - F.col("n_tokens")).alias("first"))
        placed = heads.join(F.broadcast(self._starts()), "file_no").withColumn("at", F.col("base") + F.col("first"))
        wanted = placed.filter((F.col("at") < start + n) & (F.col("at") + F.col("n_tokens") > start)).select("file_no", "block_no", "base")
        return self.blocks().join(wanted, ["file_no", "block_no"]).select("base", "block").mapInArrow(partial(_slices, table, start, start + n), "start long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, block_ids: int = BLOCK_IDS) -> TokenFiles:
    """Encode whole texts and write them in ascending doc_id order.

    Null text: empty (the end id alone). Null doc_id: kept, sorted first. Repeated rows and equal
    ids: a document each, equal ids in the order in which they were read, over as many files as
    their number asks for. A document of more than block_ids ids is cut over blocks of its own.
    Empty table: files without blocks. Other columns are ignored. The frequency table is counted over all documents; every vocabulary entry
    has a frequency of at least 1, so a table may also encode later files.
    """
    spark = docs.sparkSession
    width = word_ids(tokenizer_path).dtype.str
    size = word_ids(tokenizer_path).tokenizer.get_vocab_size()
    with discarding(spark):  # the ids' table goes once the files are written
        return _write(docs, path, tokenizer_path, end_id, block_ids, width, size)


def _write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, block_ids: int, width: str, size: int) -> TokenFiles:
    spark = docs.sparkSession
    # the row's number is written with it, so that it stays when an executor is lost
    tokens = materialize(tokenize(docs, tokenizer_path, end_id).withColumn("row", F.monotonically_increasing_id()), "tokens")
    counts = np.zeros(size, np.int64)
    for row in count_tokens(tokens, width).collect():  # at most one row per vocabulary entry
        counts[row.token] = row.n
    freq = scale_counts(counts)
    spark.createDataFrame(pa.table({"token": np.arange(size, dtype=np.int32), "freq": freq})).coalesce(1).write.parquet(f"{path}/table")
    ranged = tokens.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row").withColumn("file_no", F.spark_partition_id())
    table = spark.sparkContext.broadcast(freq)
    blocks = ranged.mapInArrow(partial(_encode, table, width, block_ids), "file_no int, block_no long, first_doc long, n_docs long, n_tokens long, cut boolean, block binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    return TokenFiles(spark, path, freq)
