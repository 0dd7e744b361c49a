import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import packing, token_files as tf
from fieldloom.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "a", "The  cat's\tsat,on THE mat.\nLé été İstanbul ΣΑΣ 12 345 !!?", "<|endoftext|> x <|startoftext|>", "x\x1cy  z　w 中文 한글", "abc, def. (ghi) don't we'll %%% ***", "word " * 9000, "q" * 30000, "á ́b é̂."]


def truth(texts, end):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def rows(spark, n=len(ODD)):
    return spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(ODD[:n])] if n else [], "doc_id long, text string, start long, sequence_id string")


def test_word_cache_gives_the_library_ids():
    words = WordIds(PATH, cache=3)
    assert words.plain
    for text, ids in zip(ODD, truth(ODD, 0), strict=True):
        assert np.frombuffer(words.ids(text or ""), words.dtype).tolist() == ids[:-1], text


@pytest.mark.parametrize("letters", ["abcDEF éÜß'st'llvem,.!?-_09\n\t ", "aB' 1,.\x0b×÷ºª\xa0\x85É中á́İ𝔘<|"])
def test_parts_are_the_librarys_pre_tokens(letters):
    rng = np.random.default_rng(len(letters))
    texts = ["".join(rng.choice(list(letters), int(rng.integers(1, 60)))) for _ in range(3000)]
    words = WordIds(PATH, cache=500)
    for text, ids in zip(texts, truth(texts, 0), strict=True):
        assert np.frombuffer(words.ids(text), words.dtype).tolist() == ids[:-1], repr(text)


def test_codec_round_trip_and_resume():
    rng = np.random.default_rng(1)
    for n, lanes in ((0, 1), (1, 1), (7, 3), (5000, 16), (4096, 64)):
        ids = np.minimum(rng.zipf(1.3, n) - 1, 999).astype(np.uint16)
        table = tf.Table(tf.scale_counts(np.bincount(ids, minlength=1000)))
        states, offsets, words = tf.encode_ids(ids, table, lanes, resume=10)
        assert (tf.decode_ids(n, states[0], words, table, lanes) == ids).all()
        for k in range(1, len(offsets)):
            assert (tf.decode_ids(n, states[k], words, table, lanes, step=10 * k, word=int(offsets[k])) == ids[10 * k * lanes :]).all()


def test_damage_is_noticed():
    table = tf.Table(tf.scale_counts(np.ones(10)))
    block = bytearray(tf.pack_block([1, None], [2, 1], np.array([1, 2, 3], np.uint16), 0, table))
    assert tf.unpack_block(bytes(block), table)[0] == [1, None]
    block[-1] ^= 1
    with pytest.raises(ValueError):
        tf.unpack_block(bytes(block), table)


@pytest.mark.parametrize("n", [0, 1, len(ODD)])
def test_token_files(spark, tmp_path, n):
    files = tf.write_token_files(rows(spark, n), f"file://{tmp_path}/files", PATH, end_id=1, block_ids=100)
    got = {r.doc_id: r for r in files.documents(ids=False).collect()}
    start = 0
    want = truth(ODD[:n], 1)
    assert len(got) == n
    for i, ids in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    again = tf.TokenFiles(spark, f"file://{tmp_path}/files").documents()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in again.collect()} == dict(enumerate(want))


@pytest.mark.parametrize(("start", "n"), [(0, 5), (90, 30), (333, 9000), (9000, 40000), (10**6, 5), (7, 0)])
def test_ranges_from_resume_points(spark, tmp_path, start, n):
    files = tf.write_token_files(rows(spark), f"file://{tmp_path}/files", PATH, end_id=1, block_ids=100)
    assert files.blocks().groupBy("first_doc").count().filter("count > 50").count() == 2  # the two long texts lie in blocks of their own
    ids = [i for t in truth(ODD, 1) for i in t][start : start + n]
    got = files.read_range(start, n).orderBy("start").collect()
    assert [i for r in got for i in np.frombuffer(r.ids, "<u4").tolist()] == ids and (not got or got[0].start == start)


def test_slices_decode_from_the_resume_point():
    ids = np.random.default_rng(3).integers(0, 50, 70_000).astype(np.uint16)
    table = tf.Table(tf.scale_counts(np.bincount(ids, minlength=50)))
    view = tf.read_block(tf.pack_block([1], [len(ids)], ids, 0, table, lanes=64, resume=32))
    for a, b in ((0, 1), (2047, 2049), (2048, 70_000), (69_999, 70_000), (5000, 5000 + 64 * 32 * 3)):
        assert (tf.decode_slice(view, table, a, b) == ids[a:b]).all()


def test_token_files_null_ids_and_ties(spark, tmp_path):
    df = spark.createDataFrame([(None, "b"), (3, "a a"), (3, "a"), (3, "a")], "doc_id long, text string")
    got = tf.write_token_files(df, f"file://{tmp_path}/t", PATH).documents().orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 3, 3, 3] and sorted(r.n_tokens for r in got[1:]) == [2, 2, 3] and sum(r.n_tokens for r in got) == 9
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


@pytest.fixture
def many_partitions(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_ids_spread_over_files(spark, tmp_path, many_partitions):
    """Rows without ids, and with one id, are dealt to several files and packing tasks; each is there once."""
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    files = tf.write_token_files(df, f"file://{tmp_path}/t", PATH)
    assert files.blocks().groupBy("file_no").count().count() > 2
    got = files.documents().orderBy("start").collect()
    assert len(got) == 400 and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == [None] * 200 + [7] * 200
    pieces = packing.pack(df.withColumn("text", F.lit("same text")), PATH, length=64).collect()
    assert len({r.sequence_id >> 40 for r in pieces}) > 2 and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_hilbert_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    order = cells[np.argsort(packing.hilbert_index(cells, 3))]
    assert sorted(packing.hilbert_index(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, len(ODD)])
def test_packing_covers_each_id_once(spark, n):
    got = packing.pack(rows(spark, n), PATH, end_id=2, length=64).collect()
    want = truth(ODD[:n], 2)
    for i, ids in enumerate(want):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [t for r in own for t in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and {r.doc_tokens for r in own} == {len(ids)}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0


def test_packing_ties_lie_together(spark):
    df = spark.createDataFrame([(i, "same words here" if i % 2 else f"other text {i}") for i in range(40)], "doc_id long, text string")
    got = packing.pack(df, PATH, length=1 << 20).orderBy("sequence_id", "offset").toPandas()
    odd = (got.drop_duplicates("doc_id").doc_id % 2).tolist()
    assert sum(a != b for a, b in zip(odd, odd[1:], strict=False)) <= 2


def test_words_met_are_not_cut_again():
    words = WordIds(PATH)
    first, words._cut = words.ids("The cat, the dog's"), None
    words.words.make = None
    assert words.ids("the dog's\tcat, THE")[-2:] == first[:2]
