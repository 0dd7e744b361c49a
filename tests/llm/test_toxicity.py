import random

import numpy as np
import pytest

from fieldloom.llm import toxicity as T


def corpus(spark, n=2400, seed=2):
    rng = random.Random(seed)
    syllables = ["ta", "ro", "mi", "len", "gor", "ash", "ne", "ul"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["zqurk", "Zqurkly,", "vobbx"])
        docs.append((i, " ".join(words), "de"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, fold string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [x[2] for x in labels]


def grams_of(text):
    for w in text.split():
        padded = "\x02" * 4 + T._plain(w) + "\x01"
        yield from (padded[i : i + 5] for i in range(len(padded) - 4))


def kneser_ney(rows):
    """{(letter, context): (toxic, ordinary)} by the definition, with dictionaries."""
    count = {0: {}, 1: {}}
    for text, label in rows:
        for g in grams_of(text):
            count[label][g] = count[label].get(g, 0) + 1
    left = {}
    level = set(count[0]) | set(count[1])
    for order in range(4, 0, -1):
        kept = {}
        for g in level:
            kept[g[1:]] = kept.get(g[1:], 0) + 1
        left[order], level = kept, set(kept)

    def mixed(table, gram, lower):
        total = sum(n for g, n in table.items() if g[:-1] == gram[:-1])
        types = sum(1 for g, n in table.items() if g[:-1] == gram[:-1] and n)
        return lower if not total else max(table.get(gram, 0) - T.DISCOUNT, 0) / total + T.DISCOUNT * types / total * lower

    def p(gram, label):
        v = left[1]
        q = (v.get(gram[-1], 0) + T.FAINT) / (sum(v.values()) + T.FAINT * T.LETTERS)
        for order in range(2, 5):
            q = mixed(left[order], gram[-order:], q)
        return mixed(count[label], gram, q)

    return p


ROWS = [("the cat the dog", 1), ("The, cat there", 0), ("", 1), ("then 中文 they", 0), ("thee oth", 1)]


def test_model_is_kneser_ney(spark):
    df = spark.createDataFrame([(t, y, 0) for t, y in ROWS], "text string, label int, fold int")
    model, p = T.Model.of(T.count_grams(df)), kneser_ney(ROWS)
    tests = sorted({g for t, _ in ROWS for g in grams_of(t)} | {"athex", "\x02\x02\x02zq", "zzzzz", "the\x01\x01", "文文文文文"})
    for g in tests:
        got = [float(q[-1]) for q in model.probabilities(T._codes(g))]
        assert got == pytest.approx([p(g, 1), p(g, 0)], rel=1e-5), g


@pytest.mark.parametrize("most", [1 << 20, 6])
def test_probabilities_sum_to_one(spark, most):
    """Over all letters of Unicode, also where grams are left out."""
    df = spark.createDataFrame([(t, y, 0) for t, y in ROWS], "text string, label int, fold int")
    model = T.Model.of(T.count_grams(df), most=most)
    assert all(len(x.keys) <= most for x in model.shares.values())
    alphabet = sorted({c for t, _ in ROWS for g in grams_of(t) for c in g})
    unseen = next(c for c in map(chr, range(200, 300)) if c not in alphabet)
    for context in ("\x02\x02\x02\x02", "\x02the", "zzzz", "heca", "\x02\x02th"):
        for y in (0, 1):
            each = [float(model.probabilities(T._codes(context + c))[y][-1]) for c in alphabet]
            rest = float(model.probabilities(T._codes(context + unseen))[y][-1]) * (T.LETTERS - len(alphabet))
            assert sum(each) + rest == pytest.approx(1, rel=1e-4)


def test_long_words_are_counted_and_scored_in_pieces(spark):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdé") for _ in range(1000))
    assert max(map(len, T._words("x " + word))) <= len(T.PIECE) + T.LONG + T.ORDER - 1
    df = spark.createDataFrame([(word, 1, 0), (word[:50], 0, 0)], "text string, label int, fold int")
    grams = T.count_grams(df)
    got = {}
    for r in grams.filter("label = 1").collect():
        got[r.gram] = r.n
    want = {}
    for g in grams_of(word):
        want[g] = want.get(g, 0) + 1
    assert got == want
    scores = T.WordScores(model := T.Model.of(grams))
    scores.learn(set(T._words(word)))
    whole = model.log_ratio(T._codes("\x02" * 4 + word + "\x01"))[4:].sum()
    assert sum(scores[w] for w in T._words(word)) == pytest.approx(whole, rel=1e-9)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = T.score(docs, *T.train(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(held) > 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_match_brute_force(spark):
    rows = [("the cat", 1, 0), ("The, cat the", 0, 1), ("", 1, 1), ("the", 1, 0)]
    got = {(r.gram, r.label, r.fold): r.n for r in T.count_grams(spark.createDataFrame(rows, "text string, label int, fold int")).collect()}
    want = {}
    for text, label, fold in rows:
        for g in grams_of(text):
            want[g, label, fold] = want.get((g, label, fold), 0) + 1
    assert got == want


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = corpus(spark, 200)
    flipped = labels.withColumn("toxic", T.F.when(T.fold_of(T.F.col("doc_id")) == T.HELD_OUT, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in T.score(docs, *T.train(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    docs, labels, _ = corpus(spark, 60)
    model, curve = T.train(docs, labels if labelled else labels.limit(0))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "中文 " * 20000), (3, "😀" * 50000)], "doc_id long, text string")
    got = T.score(odd, model, curve).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and T.score(odd.limit(0), model, curve).count() == 0


def test_a_long_word_is_one_word():
    """Its pieces' log ratios add up to one value: windows and the count of words don't change where a word passes the length at which it is cut."""
    long = "abcdefghij" * 20
    words = T._words(f"one {long} two {long} {long}")
    assert len(words) > 10
    scores = {w: 1.0 for w in words}
    pieces = len(T._pieces(T._padded(long)))
    whole, *runs, size = T.features(words, scores)
    assert size == np.log1p(5) and whole == (2 + 3 * pieces) / 5 and runs[0] == pieces


def test_no_gram_is_left_out(spark):
    """Scores don't depend on how many grams are broadcast, and ratios in tables are those of the definition."""
    docs, labels, _ = corpus(spark, 300)
    docs = docs.unionByName(spark.createDataFrame([(1000, "", "de"), (1001, None, "de"), (1002, "zqurk " + "文x" * 90 + " vobbx", "de"), (1002, "one", "de")], docs.schema))
    trained = T.train(docs, labels)
    rows = lambda head: sorted((r.doc_id, r.text, r.score) for r in T.score(docs.fillna(""), *trained, carry=("text",), head=head).collect())
    every = rows(10_000)
    assert len(every) == 304 and rows(40) == every and rows(0) == every
    df = spark.createDataFrame([(t, y, 0) for t, y in ROWS], "text string, label int, fold int")
    p = kneser_ney(ROWS)
    tests = sorted({g for t, _ in ROWS for g in grams_of(t)} | {"athex", "\x02\x02\x02zq", "zzzzz", "the\x01\x01", "文文文文文"})
    got = T.GramTables.of(T.count_grams(df), {"all": T.F.lit(True)}).ratios(spark.createDataFrame([(g,) for g in tests], "gram string"), "all").collect()
    assert len(got) == len(tests)
    for r in got:
        assert r.ratio == pytest.approx(np.log(p(r.gram, 1)) - np.log(p(r.gram, 0)), rel=1e-4, abs=1e-6)


def test_words_are_those_of_split():
    """Over all white space of Unicode and empty, null and blank texts; trimmed words are those of the pattern."""
    texts = ["".join(f"{chr(c)}a{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000), "", None, "  ", " one two\tone\x1c", "b"]
    words, which, ends = T._dealt(T.pa.array(["cut off", *texts])[1:])
    starts = [0, *ends[:-1].tolist()]
    assert [[words[i] for i in which[a:b]] for a, b in zip(starts, ends.tolist(), strict=True)] == [(t or "").split() for t in texts]
    assert len(set(words)) == len(words)
    for w in [*words, "_a_", "'_a'", "--", "a-b,", "É!", "ß.", "«x»", "İ,", "x²)", "_", "\x02a"]:
        assert T._plain(w) == (T._TRIM.sub("", w.lower()) or w)


def test_the_driver_gets_numbers_not_letters(spark):
    """What comes to the driver for the broadcast is some numbers a gram; the grams' letters and their codes took over 400 bytes each."""
    import tracemalloc

    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(12)) for _ in range(60))) for i in range(300)], "doc_id long, text string")
    tables = T.GramTables.of(T.count_grams(docs.limit(3).selectExpr("text", "int(doc_id % 2) as label", "0 as fold")), {"all": T.F.lit(True)})
    grams = len({g for r in docs.collect() for g in grams_of(r.text)})
    assert grams > 100_000
    tracemalloc.start()
    T.feature_rows(docs, tables, "all")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * grams
