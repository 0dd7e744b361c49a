import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import collocations as C


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def brute(docs, least, top, percent=80):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(x[0] == lang and len(x[1]) > len(p) and inside(x[1]) and 100 * b >= percent * a for x, b in found.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["New", "york", "city", "Über", "naïve", "日本", "a", "b", "c-d", " x"]
    docs = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t", "  "]) for _ in range(rng.randrange(30)))) for _ in range(n)]
    return docs + [("en", None), ("en", ""), ("fr", " ,. \n"), ("en", "new york city hall " * 400), ("en", "x y z w"), ("en", "x y z w")] + [("de", "guten tag allerseits")] * 50


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 7)])
def test_same_as_brute_force(spark, least, top):
    docs = corpus(120, least)
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in docs], "lang string, text string, n int, phrase string")
    got = C.collocations(df, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(docs, least, top)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    a = 6 * 10**12
    rows = [("en", "a b", a, 2), ("en", "a", a + 1, 1), ("en", "b", a + 2, 1), ("en", "a b c", a - 1, 3), ("en", "c", a, 1), ("en", "b c", a - 1, 2)]
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in C.scored(spark.createDataFrame(rows, "lang string, phrase string, n long, words int")).collect()}
    assert got == {"a b c": (a - 1, a + 1, a - 1, 2_000_000 * (a - 1) // (2 * a))}  # cuts at 1 and 2 tie, the first counts


def test_bitmap_marks_the_given_phrases(spark):
    given = [("en", "a b"), ("de", "a b"), (None, "x"), ("en", "日本 y")]
    bits = C.bitmap(spark.createDataFrame(given, "lang string, phrase string"))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "fr", "en"]), pa.array(["z a b c", "q 日本 y", "a b", "b a"])], names=["lang", "piece"])
    w = C.Words(batch)
    pairs = np.flatnonzero(np.arange(len(w.starts)) + 2 <= w.last)
    on = pairs[C.marked(bits, w.slots(pairs, 2))]
    assert w.phrases(on, 2).to_pylist() == ["a b", "日本 y"] and w.piece[on].tolist() == [0, 1]


def test_counts_spill_and_stay_whole(monkeypatch):
    """More distinct phrases than the memory limit holds are counted by spilling."""
    monkeypatch.setattr(C, "MEMORY", "40MB")

    def rows():
        for _ in range(2):
            for k in range(12):
                text = pa.array([f"phrase number {i} " + "x" * 40 for i in range(k * 50_000, (k + 1) * 50_000)])
                yield pa.RecordBatch.from_arrays([pa.array(["en"] * 50_000), text, pa.array([3] * 50_000)], schema=C.GRAMS)

    total = distinct = 0
    for b in C._added(rows(), 6):
        distinct, total = distinct + b.num_rows, total + sum(b.column(2).to_pylist())
    assert (distinct, total) == (600_000, 3_600_000)
