"""What a Python worker holds at once: batches of bounded bytes, and one operator's state."""

import gc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from fieldloom.llm import near_dup, packing, tokens, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def bounded(f):
    def run(*args):
        def seen(batches):
            for batch in batches:
                assert batch.nbytes < 6 << 20, f"a batch of {batch.nbytes} bytes"
                yield batch

        return f(*args[:-1], seen(args[-1]))

    return run


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """9 MB of texts in one partition, and a folder with their labels."""
    folder = f"file://{tmp_path_factory.mktemp('long')}"
    rows = spark.range(450).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 2500), i -> concat('w', (id * 31 + i * 7) % 5003))) as text", "'en' as lang", "'web' as source", "0 as n_chars")
    rows.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.range(450).selectExpr("id as doc_id", "1 as quality", "cast(id % 5 = 0 as int) as toxic").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet").coalesce(1), folder


def test_toxicity_gets_small_batches(spark, long_texts, monkeypatch):
    for name in ("_count", "_met", "_feature_rows"):
        monkeypatch.setattr(toxicity, name, bounded(getattr(toxicity, name)))
    corpus_pipeline.toxicity_stage(spark, *long_texts).count()


def test_near_duplicates_get_small_batches(spark, long_texts, monkeypatch):
    monkeypatch.setattr(near_dup, "_sign", bounded(near_dup._sign))
    assert near_dup.near_dup_classes(long_texts[0]).count() == 450


def test_packing_gets_small_batches(spark, long_texts, monkeypatch):
    monkeypatch.setattr(packing, "_key", bounded(packing._key))
    assert packing.pack(long_texts[0], PATH, ids=False).count() >= 450


def test_a_worker_keeps_one_state():
    class Shared:
        id = "a"

        class model:  # noqa: N801
            value = toxicity.Ratios(np.zeros(0, np.uint64), np.zeros(0, np.float32))

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array(["some words"])})
    held = lambda kind: sum(isinstance(x, kind) for x in gc.get_objects())
    list(toxicity._feature_rows(Shared, (), iter([batch])))
    assert held(toxicity.WordScores) == 1
    list(packing._key(PATH, 2, iter([batch])))
    gc.collect()
    assert held(toxicity.WordScores) == 0 and held(tokens.WordIds) == 1
    list(near_dup._sign(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "node": pa.array([b"n"]), "text": pa.array(["some words"])})])))
    gc.collect()
    assert held(tokens.WordIds) == 0
