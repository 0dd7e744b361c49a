import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import jaccard_join as J


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                links += 1
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)), key=repr), links


def edited(rng, words, k, word):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = word()
    return w


def corpus(seed, families=6, members=25, size=60):
    rng = random.Random(seed)
    n = iter(range(10**9))
    new = lambda: f"w{next(n)}"
    common = [f"c{i}" for i in range(40)]
    docs = [common + [new() for _ in range(rng.randrange(5, 30))] for _ in range(40)]  # a shared passage
    for _ in range(families):
        base = [rng.choice(common + [f"v{i}" for i in range(300)]) for _ in range(size)]
        chain = base
        for _ in range(members):
            docs.append(edited(rng, base, rng.randrange(0, 4), new))
            chain = edited(rng, chain, 1, new)  # links only from step to step
            docs.append(chain[: rng.randrange(size - 8, size + 1)])
    docs += [rng.sample(common, 3) for _ in range(20)] + [common[:3]] * 3 + [[c.upper() for c in common[:3]]]
    texts = [rng.choice([" ", "\n", "\t "]).join(w) for w in docs]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))
    rows += [(10_001, None), (10_002, ""), (10_003, " \n"), (None, texts[0]), (None, "lone words of a row without id"), (rows[5][0], texts[5]), (10_004, "one"), (10_005, "ONE"), (10_006, "word " * 3000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_components_as_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "BLOCK", [256, 8, 3][seed - 1])
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int")
    want, links = brute(rows)
    got = J.jaccard_components(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and links > 300
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_every_way_of_answering_is_used(spark):
    """Two centres' families: members link by bounds, by differences and by reading, and to none."""
    rng, n = random.Random(5), iter(range(10**9))
    new = lambda: f"w{next(n)}"
    rows = []
    for _ in range(12):
        base = [new() for _ in range(120)]
        rows += [" ".join(edited(rng, base, k, new)) for k in (0, 2, 3, 3, 4, 4, 5, 5, 6, 7, 8) for _ in range(3)]
    docs = list(enumerate(rows))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=repr) == brute(docs)[0]


def test_empty_tables(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = J.jaccard_components(spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(3, 0, 3), (4, 0, 4)]


@pytest.mark.parametrize("step", [1, 2, 3, 50])
def test_lists_of_several_over_batches(step):
    token = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6, 7]
    salt = [0] * 7 + [1, 0, 0, 0]
    rows = pa.RecordBatch.from_arrays([pa.array(token), pa.array(salt, pa.int32()), pa.array(range(11)), pa.array(range(11))], names=["token", "salt", "node", "meta"])
    got = [t for b in J._several(rows.slice(i, step) for i in range(0, 11, step)) for t in b.column("token").to_pylist()]
    assert got == [2, 2, 4, 4, 4, 5, 6, 6]


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.choice(1000, n, replace=False)
        b = np.concatenate([rng.permutation(a)[: max(1, n - int(rng.integers(0, n // 4 + 1)))], 2000 + np.arange(int(rng.integers(0, n // 4 + 1)))])
        both = len(np.intersect1d(a, b))
        if J.linked(both, len(a), len(b)):
            first = [set(np.sort(x)[: J.prefix_size(len(x))].tolist()) for x in (a, b)]
            assert first[0] & first[1]


def test_differences_give_the_overlap():
    sets = ["a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", "x b c d e f g h i j k l m n o p q r s u"]
    lead, x, z = J.shingle_sets(sets)
    plus, minus = [np.setdiff1d(v, lead) for v in (x, z)], [np.setdiff1d(lead, v) for v in (x, z)]
    assert len(lead) - len(np.union1d(*minus)) + len(np.intersect1d(*plus)) == len(np.intersect1d(x, z))


@pytest.mark.parametrize("at_once", [1, 5, 1 << 20])
def test_block_pairs_together_and_one_by_one(monkeypatch, at_once):
    monkeypatch.setattr(J, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for _ in range(40):
        sides = [[(int(rng.integers(0, 60)), int(rng.integers(40, 60)), int(rng.integers(0, 9)), int(rng.integers(0, 4)), int(rng.integers(-1, 3)), 30, 45) for _ in range(int(rng.integers(1, 5)))] for _ in "xy"]
        rows.append(sides)
        for x in sides[0]:
            for y in sides[1]:
                need, n = 80 * (x[1] + y[1]), (x[1], y[1])
                if x[3] == y[3] or 100 * min(n) < 80 * max(n) or 180 * min(x[1] - x[2], y[1] - y[2]) < need or x[4] == y[0] or y[4] == x[0]:
                    continue
                same = x[4] == y[4] and x[4] >= 0
                if same and 180 * (min(x[5], y[5]) + min(x[1] - x[5], y[1] - y[5])) < need:
                    continue
                want.add((min(x[0], y[0]), max(x[0], y[0]), 2 if not same else 0 if 180 * (x[5] + y[5] - x[6]) >= need else 1))
    columns = {f"{s}_{c}": pa.array([[e[k] for e in sides[j]] for sides in rows], pa.list_(pa.int64())) for j, s in enumerate("xy") for k, c in enumerate(J.FACTS)}
    got = {t for b in J._block_pairs(iter([pa.RecordBatch.from_pydict(columns)])) for t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)}
    assert got == want and len(want) > 20
