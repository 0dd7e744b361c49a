import math
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import quality_rules as Q, special as S

TEXTS = [
    None, "", "   \n\t", "a b c", "one two three four five six seven eight nine ten", "a b c d e a b c d e", "x " * 50, "l1 a\nl1 a\n\n\nl2\nl1 a", "p q r s t u\x0bp q r s t\x0cp q r s t",
    "%%% a&b <x> | $5 *** " * 5, "é ü ñ z y 中文 字 a b c d e f", "w" * 30000, " ".join(f"w{i % 7919}" for i in range(16000)), "same ten word line is here two times over now\n" * 2 + "tail of other words follows here to make it long enough " * 1,
]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n)


def test_counts_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, None, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, w string")
    got = {r.doc_id: r for r in Q.measures(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert r.stratum == "other"


def test_tails_are_exact(spark):
    cases = [(0, 0), (0, 10), (0, 600), (3, 600), (1, 2000), (5, 2000), (9, 1999), (10, 2000), (40, 10000), (49, 10000), (300, 100000), (10**7 // 2 - 9000, 10**9)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", S.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect():
        p = Fraction(0.005)
        want = float(sum(math.comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(r.k + 1))) if r.n <= 10000 else None
        if want is not None and r.n and r.k < r.n * 0.005:
            assert r.p == pytest.approx(want, rel=1e-8), (r.k, r.n)
    assert 1e-5 < r.p < 1e-4  # four standard deviations below the mean
    # of whole numbers, a beta tail is a binomial one: P(Beta(a, b) < x) = P(Binomial(a + b - 1, x) >= a)
    pairs = [(1, 1), (9, 2), (2, 9), (60, 40), (40, 60), (300, 5)]
    got = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double").select("a", "b", *[S.beta_below(F.col("a"), F.col("b"), x).alias(str(i)) for i, x in enumerate((0.5, 0.9))]).collect()
    for r in got:
        for i, x in enumerate((0.5, 0.9)):
            n, q = int(r.a + r.b) - 1, Fraction(x)
            assert r[str(i)] == pytest.approx(float(sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(int(r.a), n + 1))), rel=1e-9, abs=1e-12)


def labelled(spark, n=4000, bad=0.3):
    junk = "word ## other && thing %% more " * 4
    good = " ".join(f"plain{i}" for i in range(30))
    rows = [(i, junk if i % 10 < bad * 10 else good + f" x{i}", "en", i) for i in range(n)]
    labels = [(i, 0 if i % 10 < bad * 10 else 1, 0) for i in range(n) if i % 2]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rule long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_reject_junk_and_keep_good(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.kept for r in Q.judge(docs, labels).collect()}
    assert len(got) == 4000 and all(k == (i % 10 >= 3) for i, k in got.items())


def strata(spark):
    """(docs, labels): four strata with measures of their own; in each, some good documents have symbols, too."""
    rows, labels = [], []
    for i in range(6000):
        lang = ["en", "de", "fr", "zz"][i % 4]
        j = i // 4
        symbols = 12 if j % 10 == 0 else (j % 7 if lang == "de" and j % 5 == 0 else 0) if j % 100 else 3
        rows.append((i, " ".join([f"plain{j}x{k}" for k in range(40)] + ["##"] * symbols), lang))
        if lang != "fr" or i < 300:
            labels.append((i, int(j % 10 != 0), 0))
    return rows, labels


def test_cutoffs_match_brute_force_in_several_strata(spark):
    rows, labels = strata(spark)
    docs, frame = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    measured = Q.measures(docs).cache()
    got = {r.stratum: [r[f"cut_{x}"] for x in Q.RULES] for r in Q.select_cutoffs(measured, frame).collect()}
    good = {i for i, q, _ in labels if q}
    held = {}
    for r in measured.collect():
        if r.doc_id in good and not r.base_failed:
            held.setdefault(r.stratum, []).append([r[x] for x in Q.RULES])
    want = {}
    for stratum, values in held.items():
        cuts, n, p = [None] * len(Q.RULES), len(values), Fraction(Q.ALPHA)
        for c in Q.CUTOFFS:
            for j in range(len(Q.RULES)):
                tried = [*cuts[:j], c, *cuts[j + 1 :]]
                k = sum(any(t is not None and v > t for v, t in zip(own, tried, strict=True)) for own in values)
                tail = float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
                if tail > Q.DELTA / (len(Q.STRATA) + 1):
                    break
                cuts = tried
            else:
                continue
            break
        if any(cuts):
            want[stratum] = cuts
    assert got == want and len(got) >= 3 and "fr" not in got and got["en"] != got["de"]
    kept = {r.doc_id: r.kept for r in Q.judge(docs, frame).collect()}
    assert not any(kept[i] for i in range(0, 6000, 40)) and sum(kept.values()) > 4000


def test_no_cutoff_without_labels_or_beyond_the_risk(spark):
    docs, labels = labelled(spark, 400)
    assert all(r.kept for r in Q.judge(docs, labels.limit(0)).filter("not base_failed").collect())
    # the same measure in good documents: a cutoff would reject too many of them
    wrong = labels.withColumn("quality", F.lit(1))
    assert all(r.kept for r in Q.judge(docs, wrong).filter("not base_failed").collect())


def test_empty_null_and_repeated(spark):
    docs, labels = labelled(spark, 20)
    assert Q.judge(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "a", "xx"), (1, "a", "xx")], "doc_id long, text string, lang string")
    assert [r.kept for r in Q.judge(odd, labels).collect()] == [False] * 3
