from collections import Counter
from itertools import count
from math import exp, log

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from fieldloom.llm import lattice_sampling as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", "Hello  world", "é ﬁ 中 ok\n x ", "thonener 😀 ▁ q\tz", "x" * 3000, "the same words " * 500]


@pytest.fixture(scope="module")
def lat():
    return L.Lattices(PATH)


def all_paths(lat, text):
    """{ids: probability} by listing every segmentation of the whole normalised text."""
    norm = lat.model.normalize(text)

    def go(i):
        if i == len(norm):
            yield (), 0.0
        for end in range(i + 1, len(norm) + 1):
            p = lat.ids.get(norm[i:end])
            if p is not None:
                for rest, w in go(end):
                    yield (p, *rest), w + lat.weight[p]
        if norm[i : i + 1] and norm[i] not in lat.ids:
            own = tuple(lat.bytes_of[b] for b in norm[i].encode())
            for rest, w in go(i + 1):
                yield (*own, *rest), w + lat.byte_weight * len(own)

    found = list(go(0))
    z = sum(exp(w) for _, w in found)
    return {ids: exp(w) / z for ids, w in found}


def test_log_prob_and_decode(lat):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ["in the", "né😀b", "a  bc", "中x"]:
        truth = all_paths(lat, text)
        got = L.sample_texts(lat, np.arange(1), [text], 4)[0]
        assert len({tuple(g[0]) for g in got}) == len(got) == min(4, len(truth))
        for ids, lp, value, inclusion in got:
            assert lp == pytest.approx(log(truth[tuple(ids.tolist())]), abs=1e-9) and inclusion <= 0
            assert lat.decode(ids.tolist()) == sp.decode(ids.tolist()) == text
        assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)


def test_all_segmentations_if_k_is_large(lat):
    truth = all_paths(lat, "of a")
    got = L.sample_texts(lat, np.array([5]), ["of a"], len(truth) + 5)[0]
    assert {tuple(g[0].tolist()) for g in got} == set(truth) and all(g[3] == 0 for g in got)


def test_sampling_law(lat):
    """The ordered pair of the first two draws follows sampling without replacement: p1 * p2 / (1 - p1)."""
    text, n = "a of", 20_000
    truth = all_paths(lat, text)
    pairs = Counter(tuple(tuple(g[0].tolist()) for g in own) for own in L.sample_texts(lat, np.arange(n), [text] * n, 2))
    for (a, b), c in pairs.items():
        want = truth[a] * truth[b] / (1 - truth[a])
        assert abs(c / n - want) < 5 * (want / n) ** 0.5 + 1e-3, (a, b, c / n, want)


def test_inclusion_scores_estimate_sums(lat):
    """Weighting by probability over inclusion probability estimates the total mass 1 without bias."""
    text, n = "over on", 4000
    sums = [sum(exp(lp - inc) for _, lp, _, inc in own) for own in L.sample_texts(lat, np.arange(n), [text] * n, 3)]
    assert abs(np.mean(sums) - 1) < 6 * np.std(sums) / n**0.5


def test_seeded_by_row_key_not_by_batch(lat):
    texts = [f"some words number {i} here" for i in range(40)]
    whole = L.sample_texts(lat, np.arange(40), texts, 3)
    for i in (0, 17, 39):
        alone = L.sample_texts(L.Lattices(PATH), np.array([i]), [texts[i]], 3)[0]
        assert [(g[0].tolist(), round(g[2], 6)) for g in alone] == [(g[0].tolist(), round(g[2], 6)) for g in whole[i]]


@pytest.mark.parametrize("n", [0, len(ODD)])
def test_spark_round_trip(spark, n):
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(count(), ODD[:n], strict=False)] + ([(None, None, 1), (3, ODD[3], 1)] if n else []), "doc_id long, text string, rank int")
    got = L.sample_segmentations(df, PATH, k=3, digest=True).collect()
    assert all(r.restored for r in got)
    if n:
        assert [r.n_pieces for r in got if r.doc_id in (0, None)] == [0, 0]
        same = [(r["rank"], r.ids_crc32, r.perturbed) for r in got if r.doc_id == 3]
        assert sorted(same[: len(same) // 2]) == sorted(same[len(same) // 2 :])
        assert all(len({r.ids_crc32 for r in got if r.doc_id == i}) == 3 for i in (2, 4, 5, 6))
    back = {(r.doc_id, r["rank"]): r.text for r in L.decode_ids(L.sample_segmentations(df, PATH, k=2), PATH).collect()}
    assert all(text == (ODD[i].replace("▁", " ") if i is not None else "") for (i, _), text in back.items())


@pytest.mark.parametrize("sharpness", [L.SHARPNESS, 6.0])
def test_all_paths_of_a_long_word(sharpness):
    """More draws than a word has paths: every path comes once, however little it holds."""
    own = L.Lattices(PATH, sharpness)
    truth = all_paths(own, "thonener")
    got = L.sample_texts(own, np.array([3]), ["thonener"], len(truth) + 5)[0]
    assert len(truth) > 60 and {tuple(g[0].tolist()) for g in got} == set(truth) and len(got) == len(truth)
    assert all(g[3] == 0 and g[1] == pytest.approx(log(truth[tuple(g[0].tolist())]), rel=1e-9, abs=1e-300) for g in got)
    assert sharpness < 1 or min(truth.values()) < 1e-16


def test_law_of_rare_paths():
    """Where the first path holds nearly all mass, the second draw follows the masses of the rest."""
    own, n = L.Lattices(PATH, 12.0), 4000
    truth = all_paths(own, "over")
    top = max(truth, key=truth.get)
    rest = {k: v for k, v in truth.items() if k != top}
    seconds = Counter()
    for draws in L.sample_texts(own, np.arange(n), ["over"] * n, 2):
        assert tuple(draws[0][0].tolist()) == top
        seconds[tuple(draws[1][0].tolist())] += 1
    total = sum(rest.values())
    assert total < 1e-6
    for k, v in rest.items():
        assert abs(seconds[k] / n - v / total) < 5 * (v / total / n) ** 0.5 + 2e-3


def test_chunks_do_not_cut_pieces(lat):
    """Pairs that no piece joins part the chunks; the rest stays together."""
    text = "of\nthe é中x ok!!  a"
    roots, ends = lat.roots_of(["", text, ""])
    assert ends.tolist()[0] == 0 and ends.tolist()[1] == ends.tolist()[2] == len(roots)
    back = {v: k for k, v in lat.roots.items()}
    assert "".join(back[r] for r in roots.tolist()) == lat.model.normalize(text)
