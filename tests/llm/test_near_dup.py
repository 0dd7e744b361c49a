import random

import numpy as np
import pytest

from fieldloom.llm import near_dup as N


def multiset(text):
    doc, h = N.shingle_hashes([text])
    return h


def brute(texts):
    """Classes over all pairs."""
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [multiset(t or "") for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (len(sets[i]) and len(sets[j]) and N.overlap(sets[i], sets[j]) >= N.SIMILAR):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(texts))]


def test_shingles():
    doc, h = N.shingle_hashes(["a b c d e f", "", "a b c", "b c d e f", " a  b\tc\nd e\x0bf ", "a b c d e a b c d e"])
    by = [h[doc == i].tolist() for i in range(6)]
    assert [len(x) for x in by] == [2, 0, 1, 1, 2, 6] and by[0] == by[4] and by[3][0] in by[0] and len(set(by[5])) == 5


def test_weighted_collision_rate():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 32, 400, dtype=np.uint64)
    wa, wb = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    doc = np.repeat([0, 1], 400)
    got = N.dart_signatures(doc, np.concatenate([shared, shared]), np.concatenate([wa, wb]), 3, k=4000)
    assert (got[2] == 0).all() and (got[:2] != 0).all()
    assert abs((got[0] == got[1]).mean() - want) < 0.03


def test_overlap_counts_repeats():
    a, b = np.array([1, 1, 1, 2], np.uint32), np.array([1, 1, 3], np.uint32)
    assert N.overlap(a, b) == 2 / 5


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = [None, "", "a b", "a b", "a b c"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([12, 60, 300, 2000]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(own) // 60])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    return texts


def test_classes_match_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r.doc_id: r.class_id for r in N.near_dup_classes(df).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    wrong = [i for i, w in enumerate(want) if got[i] != w]
    assert not wrong, [(i, got[i], want[i]) for i in wrong]


def test_large_bucket_of_many_classes(spark):
    # sets of one pool of common shingles: one class of 12, eight of 3, and singles, all in the same large buckets
    rng = np.random.default_rng(4)
    sets = {i: np.sort(rng.choice(60, 51, replace=False)).astype("<u4") for i in range(100)}
    comp = {i: 0 if i < 12 else 12 + (i - 12) // 3 if i < 36 else i for i in sets}
    name = lambda i: i.to_bytes(2, "big")
    signed = {i: N.sketches(N.dart_signatures(np.zeros(51, int), x, np.ones(51), 1))[0].tolist() for i, x in sets.items()}
    cards = spark.createDataFrame([(name(i), 51, *signed[i], name(c)) for i, c in comp.items()], "node binary, weight int, " + ", ".join(f"{c} long" for c in N.SKETCH) + ", comp binary")
    shingles = spark.createDataFrame([(name(i), x.tobytes()) for i, x in sets.items()], "node binary, shingles binary")
    large = N.rare_shingle_buckets(cards, shingles).filter(N.F.col("n") > N.SMALL)
    got = {(r.a[1], r.b[1]) for r in N.verified(N._large_tries(large, cards), shingles).collect()}
    held = {}
    for r in large.collect():
        held.setdefault(r.band, set()).add(r.node[1])
    want = {(a, b) for x in held.values() for a in x for b in x if a < b and comp[a] != comp[b] and N.overlap(sets[a], sets[b]) >= N.SIMILAR}
    singles = {(a, b) for a, b in want if a >= 36}
    assert len(singles) > 20 and got == want


def test_many_classes_round_one_passage(spark):
    """Hundreds of texts share a passage and with it large buckets; among them are classes of several sizes, whose links all have to be found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    passage, texts = [word() for _ in range(60)], []
    for k in range(90):
        own = [word() for _ in range(30)]
        for j in range(rng.choice([1, 1, 2, 3, 12])):
            copy = list(own)
            for _ in range(j % 2):
                copy[rng.randrange(30)] = word()
            texts.append(" ".join(passage + copy))
    got = {r.doc_id: r.class_id for r in N.near_dup_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute(texts)
    assert len(texts) > 250 and len(set(want)) > 60
    wrong = [i for i, w in enumerate(want) if got[i] != w]
    assert not wrong, [(i, got[i], want[i]) for i in wrong]


def test_sketches_tell_similar_from_different():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 32, 3000, dtype=np.uint64)
    a, near, other = pool[:1000], np.concatenate([pool[:890], pool[1000:1110]]), np.concatenate([pool[:400], pool[2000:2600]])
    doc = np.repeat([0, 1, 2], 1000)
    s = N.sketches(N.dart_signatures(doc, np.concatenate([a, near, other]), np.ones(3000), 3))
    far = lambda x, y: sum(int(np.bitwise_count(np.bitwise_or.reduce((x ^ y).view(np.uint64)[h::2]))) for h in (0, 1))
    assert far(s[0], s[1]) <= N.FAR < far(s[0], s[2])


def test_keepers(spark):
    rows = [(b"\x01", None, "a b c d e f"), (b"\x02", 7, "a b c d e f"), (b"\x03", 7, "a b c d e f"), (b"\x04", None, "x"), (b"\x05", None, "x"), (b"\x06", 1, None)]
    got = N.near_dup_keepers(spark.createDataFrame(rows, "key binary, doc_id long, text string"), "key").collect()
    assert sorted(bytes(r.key) for r in got) == [b"\x02", b"\x04", b"\x06"]


@pytest.mark.parametrize("rows", [[], [(None, "x y"), (None, "x y"), (4, "x y"), (4, "x y"), (5, None)]])
def test_null_ids_and_empty_tables(spark, rows):
    got = N.near_dup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.class_id) for r in got) == sorted((str(i), 5 if i == 5 else 4) for i, _ in rows)
