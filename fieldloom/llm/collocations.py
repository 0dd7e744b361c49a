"""Phrase collocations: contiguous phrases that occur more together than apart.

Texts are cut into pieces at punctuation and line ends; equal pieces of a language become one row
with a multiplicity, so that copied text is counted by weight. Phrases are counted length by length:
a task reads its pieces, emits the phrases of a length with their weights and adds up its own in
DuckDB; sums are dealt to hash buckets, and each bucket adds up in DuckDB, which spills where its
memory ends. A phrase of n words can only be frequent if both its phrases of n - 1 words are: the
frequent ones of a length are marked in a bitmap of SLOTS bits, and the next length's phrases are
emitted only where both parts are marked. Shared bits let rare phrases through, which their own
count removes, so the bitmap saves work and never decides.

A candidate then asks for the counts of its parts: one row per part goes to where the part's count
lies, and answers come back to the candidate by a second shuffle, together with the counts of longer
candidates that contain it.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discarding, materialize, positioned, text_batches
from .hashing import STEP, mix, run_hashes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the bitmap of frequent phrases of one length: 8 MB.
SLOTS = 1 << 26
#: What DuckDB may hold in one task before it spills.
MEMORY = "256MB"
MOST_WORDS = 4
#: Phrases that are spelt out at once.
AT_ONCE = 1 << 17

GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): the distinct pieces of each language, words joined by one space, and how often each occurs."""
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    tidy = cut.select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).filter("piece <> ''")
    return tidy.groupBy("lang", "piece").agg(F.count("*").alias("m"))


class Words:
    """The words of a batch of pieces as places in its bytes; the first and the last word of each piece."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("piece")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        space = np.flatnonzero(self.data == 32)
        self.starts = np.sort(np.concatenate([edges[:-1], space + 1]))
        self.ends = np.sort(np.concatenate([space, edges[1:]]))
        first = np.searchsorted(self.starts, edges[:-1])
        self.piece = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(self.starts))))
        self.last = np.append(first[1:], len(self.starts))[self.piece]  # one past the last word of a word's piece
        self.lang = batch.column("lang")
        seeds = {x: np.uint64(int.from_bytes((x or "").encode()[:7].ljust(7, b"\0"), "little")) for x in self.lang.unique().to_pylist()}
        self.seed = np.array([seeds[x] for x in self.lang.to_pylist()], np.uint64)

    def slots(self, at: np.ndarray, words: int) -> np.ndarray:
        """The bitmap's slot of the phrase of so many words from each word on."""
        return _slots(run_hashes(self.data, self.starts[at], self.ends[at + words - 1]), self.seed[self.piece[at]])

    def phrases(self, at: np.ndarray, words: int) -> pa.StringArray:
        a, b = self.starts[at], self.ends[at + words - 1]
        offsets = np.concatenate([[0], np.cumsum(b - a)])
        body = self.data[np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], b - a)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))


def _slots(hashes: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return mix(hashes * STEP + seed) % np.uint64(SLOTS)


def marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1


@contextmanager
def _database():
    """DuckDB of one task: a thread, a bounded memory, and scratch of its own for what exceeds it, as a Spark task has for its sorts; gone at the end."""
    import duckdb

    scratch = tempfile.mkdtemp(prefix="duckdb-")
    db = duckdb.connect(":memory:")
    try:
        db.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = '{scratch}'; SET preserve_insertion_order = false")
        yield db
    finally:
        db.close()
        shutil.rmtree(scratch, ignore_errors=True)


def _added(rows: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) added up by phrase, those of `least` or more."""
    with _database() as db:
        db.register("given", pa.RecordBatchReader.from_batches(GRAMS, rows))
        for batch in db.sql(f"SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM given GROUP BY ALL HAVING sum(n) >= {int(least)}").to_arrow_reader(16_384):
            yield pa.RecordBatch.from_arrays(list(batch.columns), names=GRAMS.names)


def _emit(words: int, frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most_bytes=1 << 20, most_rows=1 << 16):
            if batch.num_rows:
                w = Words(batch)
                at = np.flatnonzero(np.arange(len(w.starts)) + words <= w.last)
                if words > 1:
                    whole = np.zeros(len(w.starts) + 1, bool)  # by first word: a shorter phrase that is marked
                    part = np.flatnonzero(np.arange(len(w.starts)) + words - 1 <= w.last)
                    whole[part] = marked(frequent.value, w.slots(part, words - 1))
                    at = at[whole[at] & whole[at + 1]]
                for k in range(0, len(at), AT_ONCE):
                    some = at[k : k + AT_ONCE]
                    owner = pa.array(w.piece[some])
                    yield pa.RecordBatch.from_arrays([w.lang.take(owner), w.phrases(some, words), batch.column("m").take(owner)], schema=GRAMS)

    return _added(rows(), 1)


def counted(cut: DataFrame, words: int, least: int, frequent=None) -> DataFrame:
    """(lang, phrase, n) of the phrases of so many words that occur `least` times or more. frequent: a broadcast bitmap of those of one word fewer."""
    sums = cut.select("lang", "piece", "m").mapInArrow(partial(_emit, words, frequent), "lang string, phrase string, n long")
    return sums.repartition("lang", "phrase").mapInArrow(partial(_added, least=least), "lang string, phrase string, n long")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(SLOTS >> 6, np.uint64)
    for batch in batches:
        if batch.num_rows:
            w = Words(batch)
            first = np.flatnonzero(np.diff(w.piece, prepend=-1))
            slots = _slots(run_hashes(w.data, w.starts[first], w.ends[w.last[first] - 1]), w.seed)
            np.bitwise_or.at(bits, (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63)))
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].view(np.int64))], names=["at", "bits"])


def bitmap(phrases: DataFrame) -> np.ndarray:
    """SLOTS bits, those of the given (lang, phrase) set: at most SLOTS / 64 rows come to the driver."""
    found = phrases.select("lang", F.col("phrase").alias("piece")).mapInArrow(_mark, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SLOTS >> 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(cut: DataFrame, least: int, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, phrase, n, words) of all phrases of 1 to most_words words that occur `least` times or more; a table per length."""
    spark, known, all_ = cut.sparkSession, None, None
    for words in range(1, most_words + 1):
        if known is not None:
            known = spark.sparkContext.broadcast(known)
        level = materialize(counted(cut, words, least, known).withColumn("words", F.lit(words)), f"phrases-{words}")
        all_ = level if all_ is None else all_.unionByName(level)
        known = bitmap(level) if words < most_words else None
    return all_


def scored(frequent: DataFrame, most_words: int = MOST_WORDS, percent: int = 80) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers."""
    exact = "decimal(38,0)"
    candidates = frequent.filter("words > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = F.sequence(F.lit(1), F.col("words") - 1)
    parts = F.flatten(F.transform(cuts, lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), joined(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), joined(k + 1, F.col("words") - k).alias("part")))))
    requests = candidates.select("lang", "phrase", F.explode(parts).alias("x")).select("lang", F.col("x.part").alias("part"), "phrase", "x.k", "x.side")
    held = frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    answers = requests.join(held, ["lang", "part"]).select("lang", "phrase", "k", "side", "f")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda a: joined(a, n))))
    covers = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.lit(0).alias("k"), F.lit("cover").alias("side"), F.col("n").alias("f"))
    own = candidates.select("lang", "phrase", F.lit(0).alias("k"), F.lit("own").alias("side"), F.col("n").alias("f"))
    of = lambda side, k=0: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("f")))
    each = [of(side, k).alias(f"{side}{k}") for k in range(1, most_words) for side in "lr"]
    facts = answers.unionByName(own).unionByName(covers).groupBy("lang", "phrase").agg(of("own").alias("a"), of("cover").alias("cover"), *each)
    free = facts.filter(F.col("cover").isNull() | (F.col("cover").cast(exact) * 100 < F.col("a").cast(exact) * percent))

    def cut(k: int) -> Column:
        both = F.col(f"l{k}").cast("decimal(20,0)") + F.col(f"r{k}").cast("decimal(20,0)")
        score = F.expr(f"cast(a as decimal(20,0)) * 2000000 div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
        return F.when(both.isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    best = F.array_min(F.array_compact(F.array(*[cut(k) for k in range(1, most_words)])))
    return free.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", F.col("best.score").alias("score"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to MOST_WORDS words.

    Null text: empty, no pieces. Null lang: `und`. Repeated rows and copied pieces count as often
    as they occur. Ties in score and count: by the phrase's bytes. Very long texts are cut into
    pieces whole. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    with discarding(docs.sparkSession):
        cut = materialize(pieces(docs, text_col, lang_col), "pieces")
        totals = materialize(cut.groupBy("lang").agg(F.sum(F.col("m") * (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)).alias("n")), "totals")
        placed = positioned(scored(frequent_phrases(cut, least), percent=percent), [F.col("lang").asc(), F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], "ranked")
        first = placed.groupBy("lang").agg(F.min("position").alias("first"))
        ranked = placed.join(first, "lang").withColumn("rank", F.col("position") - F.col("first") + 1).filter(F.col("rank") <= top)
        return materialize(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", outer=True)
