import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from fieldloom.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def runs(t, n):
    w = WORD.findall(lower(t))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def brute(docs, target, n, buckets, percent, least, seed):
    feats = [(d, [h % buckets for h in runs(t, n)], len(WORD.findall(lower(t)))) for d, t in docs]
    s, t = Counter(b for _, f, _ in feats for b in f), Counter(h % buckets for x in target for h in runs(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, f, w in feats:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), w))
    best = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    best = best[: len(best) * percent // 100]
    ranks = {}
    for i, r in enumerate(best):
        ranks.setdefault(r, []).append(i + 1)
    return sorted((r[:4] + ((ranks[r].pop(0) if ranks.get(r) else None),) for r in out), key=repr)


DOCS = [(i, f"Über word{i % 7} x9 Mixed-CASE the the cat {'dog ' * (i % 5)}naïve 日本 {i}") for i in range(60)]
DOCS += [(70, None), (71, ""), (72, "?!\n"), (None, "the cat the dog " * 3), (80, "a b c d e f g"), (80, "a b c d e f g"), (81, "long " * 5000 + "x" * 3000)]


@pytest.mark.parametrize(("n", "buckets"), [(1, 10_000), (2, 97), (4, 70_000)])
def test_same_as_brute_force(spark, monkeypatch, n, buckets):
    monkeypatch.setattr(R, "CHUNK", 64)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, rank string, weight int")
    target = [("the cat sat on word3 naïve"), None, "dog dog"]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = R.resample(docs, aim, n=n, buckets=buckets, percent=30, least_words=6, seed="7")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(DOCS, target, n, buckets, 30, 6, "7")


def test_empty_tables(spark):
    docs, aim = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert R.resample(docs, aim).count() == 0
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r.rank for r in R.resample(some, aim, percent=100, least_words=1).collect()] == [1]


@pytest.mark.parametrize("chunk", [1, 3, 10, 1 << 20])
def test_ring_over_chunks(monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    text = "One  two\tthree-four5 ÄÖ six\n\n7 " + "y" * 40 + " end"
    words, states = R.ring_states(text, 3)
    assert words == len(WORD.findall(lower(text))) and sorted(states) == sorted(runs(text, 3))


def test_weights_draw_like_the_target(spark):
    """Documents made of the target's words are drawn before others of the same length."""
    docs = [(i, "apple pear plum " * 10 if i % 10 == 0 else "stone iron lead " * 10) for i in range(200)]
    got = R.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "pear apple plum")], "item_id long, text string"), n=1, percent=10)
    assert {r.doc_id for r in got.collect() if r.rank} == {i for i in range(0, 200, 10)}
