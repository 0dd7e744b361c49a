import os
import random
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fieldloom.llm.queries import oracle_sql, queries  # noqa: E402


def table(spark, folder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[3:6] = ["zqurk", "vobbx", "zqurk"]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    rows.append((1000, rows[1][1], "en", "s", 0))  # an exact copy
    rows.append((1001, rows[2][1] + " tail", "en", "s", 0))  # a near copy
    rows.append((1002, "too short", "en", "s", 0))
    rows.append((1003, None, None, None, None))
    rows.append((1004, " ".join(word() for _ in range(40)) + " password=hunter2hunter2", "en", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = table(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    every = {r[0] for r in rows}
    assert every - set(kept[0]) == {1002, 1003}
    gone = set(kept[0]) - set(kept[1])
    assert {i for i in range(400) if i % 5 == 0} <= gone and len(gone) <= 90
    assert set(kept[1]) - set(kept[2]) == {1000, 1001} - gone
    assert set(kept[3]) == set(kept[2]) and kept[3][1004].endswith("[secret]")
    assert all(kept[3][i] == kept[2][i] for i in kept[3] if i != 1004)
    last = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in last} == set(kept[3])
    assert sum(r.length for r in last) == sum({r.doc_id: r.doc_tokens for r in last}.values())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(oracle_sql()) <= set(queries())
    assert zlib.crc32(b"") == 0 and os.path.exists(corpus_pipeline.__file__)


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, blob string, row string, label int, fold int, all string"


def odd_rows():
    """Repeated and null ids, equal rows, columns with the operators' own names."""
    words = lambda k: " ".join(f"{a}{b}{k}" for a in "lorem ipsum dolor sit".split() for b in "abcdefgh")
    texts = [(1, words(1) + " password=hunter2hunter2"), (1, words(2) + " token: abcdefgh12345678 end"), (None, words(3) + " secret=zzzzzzzz9999"), (None, words(3) + " secret=zzzzzzzz9999"), (None, words(4)), (7, words(5)), (7, words(5)), (7, "too short"), (8, words(6)), (2, words(6)), (None, words(6)), (9, None)]
    return [(i, t, None if n % 2 else "en", "s", n, "k", 1, "b", "r", 1, 2, "a") for n, (i, t) in enumerate(texts)]


def test_rows_are_told_apart_without_ids(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(odd_rows(), ODD)
    short = lambda rows: sorted((str(r.doc_id), (r.text or "")[-12:], r.n_chars) for r in rows)
    quality, toxic, near, secrets, _ = (f for _, f in corpus_pipeline.STAGES)
    good = quality(spark, docs, folder).collect()
    assert short(good) == sorted((str(r[0]), r[1][-12:], r[4]) for r in odd_rows() if r[1] and r[1] != "too short")
    docs = spark.createDataFrame(good, "doc_id long, text string, lang string, source string, n_chars long")
    assert short(toxic(spark, docs, folder).collect()) == short(good)
    kept = near(spark, docs, folder)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    left = kept.collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in left if r.doc_id != 7) == [("1", 0), ("1", 1), ("2", 9), ("None", 2), ("None", 4)] or sorted((str(r.doc_id), r.n_chars) for r in left if r.doc_id != 7) == [("1", 0), ("1", 1), ("2", 9), ("None", 3), ("None", 4)]
    assert len([r for r in left if r.doc_id == 7]) == 1
    clean = secrets(spark, docs, folder).collect()
    assert len(clean) == len(good)
    texts = sorted((str(r.doc_id), r.text) for r in clean)
    assert [t for i, t in texts if i == "1"][0].endswith("[secret]") and [t for i, t in texts if i == "1"][1].endswith("[secret] end")
    assert not any(x in t for _, t in texts for x in ("hunter2", "abcdefgh12345678", "zzzzzzzz"))
    assert sorted(t for _, t in texts if "[secret]" not in t) == sorted(r.text for r in good if "=" not in r.text and ":" not in r.text)
    assert all(r.n_chars == len(r.text) for r in clean if "[secret]" in r.text)


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], ODD).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
