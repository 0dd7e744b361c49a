"""What the driver holds: no broadcast tables for ratios, no tokenizer, numbers instead of rows."""

import gc

import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from fieldloom.llm import common, near_dup, packing, tokens, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ratios_broadcast_no_table(spark):
    """Also where every table is small enough for it."""
    docs = spark.createDataFrame([(i, f"some words of text {i}", i % 2, 0) for i in range(20)], "doc_id long, text string, label int, fold int")
    grams = toxicity.count_grams(docs)
    out = toxicity.GramTables.of(grams, {"all": F.lit(True)}).ratios(grams.select("gram").distinct(), "all")
    rows = out.collect()
    assert len(rows) == len({r.gram for r in rows}) > 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_packing_leaves_no_tokenizer_in_the_driver(spark):
    common.without_state()
    gc.collect()
    docs = spark.createDataFrame([(1, "a few words"), (2, None), (3, "")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(docs, PATH, ids=False).collect()) == 6
    assert sum(r.length for r in packing.pack(docs, PATH, end_id=None).collect()) == 3
    assert not [x for x in gc.get_objects() if isinstance(x, tokens.WordIds)]


def test_slot_counts_come_as_arrays(spark, monkeypatch):
    """A row object of Python for each of up to RARE_SLOTS counters took over 200 bytes."""
    texts = [" ".join(f"w{i * 7 % 40}" for i in range(30)) + f" x{k}" for k in range(9)]
    signed = near_dup.sign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    expected = sorted((r.band, r.place, r.n) for r in near_dup.rare_shingle_buckets(signed.select("node"), signed.select("node", "shingles")).collect())
    assert expected

    def collect(self):
        raise AssertionError("rows")

    monkeypatch.setattr(DataFrame, "collect", collect)
    got = near_dup.rare_shingle_buckets(signed.select("node"), signed.select("node", "shingles")).toArrow()
    assert sorted(zip(*(got.column(c).to_pylist() for c in ("band", "place", "n")), strict=True)) == expected
