"""Toxicity by two class-conditional Kneser-Ney models of the letters of words.

Per class, the highest order (ORDER letters, padded at a word's start) is counted on its own; all
lower orders are one shared chain of continuation counts (numbers of distinct left extensions)
over both classes, so rare expressions fall back to the same probabilities in both models and
barely move the comparison. Counts come from every labelled training row, by Spark, with the
letters themselves as keys, so no two grams share a count, and stay in tables of the shared folder.
Of all grams that the documents hold, Spark joins the log ratio of the two models; the HEAD grams
that the documents have most are broadcast, and documents with other grams get theirs by a join, so
no gram is left out and HEAD doesn't change a score. A document's evidence is the difference of the two log-likelihoods, normalised by
length: over the whole text, and over its strongest runs of a few words. A logistic curve, fitted
on at most FIT_ROWS labelled rows under a model that hasn't counted them, makes the score.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import isnan

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import discarding, id_and_text, materialize, small_batches, text_batches, without_state, worker_state
from .hashing import STEP, mix

ORDER = 5
#: Grams of one order that a Model in memory may hold; the queries' model is in tables and has no such limit.
MOST = 500_000
#: Grams whose log ratios are broadcast; a join brings those of the others.
HEAD = 500_000
DISCOUNT = 0.75
WINDOWS = (1, 3, 12)
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Of labelled rows, by crc32 of the id: fold 2 is held out, fold 3 also fits the curve.
FOLDS, HELD_OUT, CURVE = 4, 2, 3
#: Words that a worker keeps, and the letters beyond which a word is cut into several.
CACHE, LONG = 400_000, 64
#: Pads before a word, its end, and the mark of a piece of a long word; the share of a count that every letter of Unicode has.
PAD, END, PIECE, FAINT, LETTERS = "\x02" * (ORDER - 1), "\x01", "\x00\x00", 2.0**-10, 0x110000

_TRIM = re.compile(r"^\W+|\W+$")
_MARKS = string.punctuation.replace("_", "")
COUNTED = pa.schema([("word", pa.string()), ("label", pa.int32()), ("fold", pa.int32()), ("n", pa.int64())])
FEATURES = ("whole", *[f"strongest_{w}" for w in WINDOWS], "words")


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0)).cast("int")


def _pieces(padded: str) -> list[str]:
    """A padded word in pieces that overlap by ORDER - 1 letters: each of its grams lies in one of them."""
    return [PIECE + padded[i : i + LONG + ORDER - 1] for i in range(0, len(padded) - ORDER + 1, LONG)]


def _words(text: str) -> list[str]:
    """Words between white space; a long one as its pieces, so that a text without spaces is no single huge word."""
    words = text.split()
    if max(map(len, words), default=0) > LONG:
        return [p for w in words for p in (_pieces(_padded(w)) if len(w) > LONG else (w,))]
    return words


def _dealt(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words between white space (as str.split() takes it) of some texts; of each word in turn, the number in these; and of each text, where its words end. Null texts have none."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = split.flatten()
    some = pc.not_equal(words, "")  # white space at an end leaves an empty word
    ends = np.cumsum(np.append(0, some.to_numpy(zero_copy_only=False)))[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
    coded = words.filter(some).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), ends


def _plain(word: str) -> str:
    bare = (low := word.lower()).strip(_MARKS)
    return bare if bare.isalnum() else _TRIM.sub("", low) or word  # most words need no pattern


def _padded(word: str) -> str:
    """What is counted of a word: without marks at its ends, in lower case, with pads and an end."""
    return word[len(PIECE) :] if word.startswith(PIECE) else PAD + _plain(word) + END


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], dict[str, int]] = {}
    without_state()

    def sums() -> Iterator[pa.RecordBatch]:
        for (label, fold), words in counts.items():
            plain: dict[str, int] = {}
            for w, n in words.items():
                p = _padded(w)
                plain[p] = plain.get(p, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(plain)), pa.array(np.full(len(plain), label, np.int32)), pa.array(np.full(len(plain), fold, np.int32)), pa.array(list(plain.values()), pa.int64())], schema=COUNTED)
        counts.clear()

    for batch in text_batches(batches):
        for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
            own = counts.setdefault((label, fold), {})
            for w in _words(text):
                own[w] = own.get(w, 0) + 1
        if sum(map(len, counts.values())) > CACHE:
            yield from sums()
    yield from sums()


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, label, fold, n) of the ORDER-letter grams of all labelled rows (text, label, fold); a word has a gram per letter and one for its end."""
    words = labelled.select("text", "label", "fold").mapInArrow(_count, "word string, label int, fold int, n long").groupBy("word", "label", "fold").agg(F.sum("n").alias("n"))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - (ORDER - 1)), lambda i: F.substring("word", i, F.lit(ORDER))))
    return words.select(each.alias("gram"), "label", "fold", "n").groupBy("gram", "label", "fold").agg(F.sum("n").alias("n"))


def window_keys(codes: np.ndarray) -> list[np.ndarray]:
    """For 1 to ORDER letters, a 64-bit key of the letters that end at each place (of fewer, where the codes begin)."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(ORDER):
        moved = np.zeros(len(codes), np.uint64)
        moved[n:] = codes[: len(codes) - n] if n else codes
        h = mix(h * STEP + moved + np.uint64(n + 1))
        out.append(h)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_keys(grams: list[str]) -> np.ndarray:
    """The keys of grams of one length, as window_keys gives them."""
    if not grams:
        return np.zeros(0, np.uint64)
    size = len(grams[0])
    return window_keys(_codes("".join(grams)))[size - 1][size - 1 :: size]


class Table:
    """Numbers by 64-bit key; keys that aren't there have the default.

    Keys are hashes, so their upper bits deal them evenly to about as many buckets as there are keys: a lookup reads a bucket's start and a key or two.
    """

    def __init__(self, keys: np.ndarray, values: list[np.ndarray], default: float):
        order = np.argsort(keys)
        self.keys = keys[order]
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.append(np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(keys)).astype(np.int32)
        self.values = [np.append(v[order].astype(np.float32), np.float32(default)) for v in values]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        found = np.full(len(keys), len(self.keys), np.int32)
        live = np.flatnonzero(at < end)
        while len(live):
            here, own = at[live], keys[live]
            held = self.keys[here]
            hit = held == own
            found[live[hit]] = here[hit]
            on = (held < own) & (here + 1 < end[live])
            live = live[on]
            at[live] += 1
        return [v[found] for v in self.values]


class Model:
    """A small model in memory: discounted shares of grams and backoff weights of contexts: of the shared chain, and of both classes at the highest order."""

    def __init__(self, letters: Table, shares: dict[int, Table], backoffs: dict[int, Table]):
        self.letters, self.shares, self.backoffs = letters, shares, backoffs

    @staticmethod
    def of(grams: DataFrame, most: int = MOST) -> Model:
        """From (gram, label, n)."""
        return Model.each(grams, {"all": F.lit(True)}, most)["all"]

    @staticmethod
    def each(grams: DataFrame, rows: dict[str, Column], most: int = MOST) -> dict[str, Model]:
        """A model for every named condition on the rows (gram, label, fold, n), in one pass over the orders. What comes to the driver is, a model, at most `most` grams an order, their contexts, and a number per letter of Unicode."""
        n = lambda name, y: F.sum(F.when(rows[name] & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"{name}_{y}")
        level = materialize(grams.groupBy("gram").agg(*[n(name, y) for name in rows for y in (1, 0)]), "grams")
        counts = {name: (f"{name}_1", f"{name}_0") for name in rows}
        few = level.count() <= most  # so do all lower orders
        shares, backoffs = {name: {} for name in rows}, {name: {} for name in rows}
        for order in range(ORDER, 1, -1):
            for name, (share, back) in _tables(level, counts, order, most, few).items():
                shares[name][order], backoffs[name][order] = share, back
            # the grams of the next lower order, with the number of distinct letters before them
            met = {name: sum((F.col(c) for c in own[1:]), F.col(own[0])) > 0 for name, own in counts.items()}
            level = level.select(F.substring("gram", 2, order).alias("gram"), *[F.when(m, 1).otherwise(0).alias(name) for name, m in met.items()]).groupBy("gram").agg(*[F.sum(name).alias(name) for name in rows])
            counts = {name: (name,) for name in rows}
            if order > 2:
                level = materialize(level, "lower-grams")
        letters = level.toArrow()
        codes = np.array([ord(c) for c in letters.column("gram").to_pylist()], np.uint64)
        out = {}
        for name in rows:
            v = letters.column(name).to_numpy().astype(np.float64)
            total = v.sum() + FAINT * LETTERS
            out[name] = Model(Table(mix(codes), [(v + FAINT) / total], FAINT / total), shares[name], backoffs[name])
        return out

    def probabilities(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place, P(letter | the ORDER - 1 before it) under the toxic and under the ordinary model; the first ORDER - 1 places have no context of their own.

        Grams that occur several times are looked up once.
        """
        keys = window_keys(codes)
        _, at, of = np.unique(keys[ORDER - 1], return_index=True, return_inverse=True)
        p = self.letters.get(mix(codes[at]))[0].astype(np.float64)
        own, before = [k[at] for k in keys], [k[at - 1] for k in keys]
        for order in range(2, ORDER):
            share, back = self.shares[order].get(own[order - 1])[0], self.backoffs[order].get(before[order - 2])[0]
            p = share + back * p
        share, back = self.shares[ORDER].get(own[ORDER - 1]), self.backoffs[ORDER].get(before[ORDER - 2])
        return (share[0] + back[0] * p)[of], (share[1] + back[1] * p)[of]

    def log_ratio(self, codes: np.ndarray) -> np.ndarray:
        """At each place, the logarithm of the two models' quotient."""
        toxic, ordinary = self.probabilities(codes)
        return np.log(toxic) - np.log(ordinary)


def _least_count(level: DataFrame, every: Column, most: int) -> int:
    """The smallest power of two that leaves at most `most` grams with that count or more."""
    sizes = {r.power: r.n for r in level.filter(every > 0).groupBy(F.floor(F.log2(every.cast("double")) + 1e-9).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()}  # a row per power of two
    power, held = max(sizes, default=0) + 1, 0
    while power > 0 and held + sizes.get(power - 1, 0) <= most:
        power, held = power - 1, held + sizes.get(power - 1, 0)
    return 2**power


def _tables(level: DataFrame, counts: dict[str, tuple[str, ...]], order: int, most: int, few: bool) -> dict[str, tuple[Table, Table]]:
    """Of one order and every model, (discounted shares of the grams kept, backoff weights of their contexts); level: gram and, by model, the columns of counts."""
    sums, kept, shares, backs = [], {}, [], []
    context = F.substring("gram", 1, order - 1)
    part = lambda c: F.when(kept[c], F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).otherwise(0.0)
    any_kept = F.lit(False)
    for own in counts.values():
        every = sum((F.col(c) for c in own[1:]), F.col(own[0]))
        keep = every >= (1 if few else _least_count(level, every, most))
        any_kept = any_kept | keep
        for c in own:
            kept[c] = keep
            sums += [F.sum(c).alias(f"total_{c}"), F.sum(part(c)).alias(f"kept_{c}")]
            shares.append(F.coalesce(F.try_divide(part(c), F.col(f"total_{c}")), F.lit(0.0)).alias(f"share_{c}"))
            backs.append((1 - F.coalesce(F.try_divide(F.col(f"kept_{c}"), F.col(f"total_{c}")), F.lit(0.0))).alias(f"back_{c}"))
    contexts = materialize(level.groupBy(context.alias("context")).agg(*sums, F.max(any_kept).alias("any")).filter("any"), "contexts")
    grams = level.filter(any_kept).withColumn("context", context).join(contexts, "context").select("gram", *shares).toArrow()
    above = contexts.select("context", *backs).toArrow()
    keys = gram_keys(grams.column("gram").to_pylist()), gram_keys(above.column("context").to_pylist())
    out = {}
    for name, own in counts.items():
        columns = [grams.column(f"share_{c}").to_numpy() for c in own], [above.column(f"back_{c}").to_numpy() for c in own]
        out[name] = _table(keys[0], columns[0], 0.0), _table(keys[1], columns[1], 1.0)
    return out


def _table(keys: np.ndarray, columns: list[np.ndarray], default: float) -> Table:
    """Of the rows where some column has not the default: others need no place."""
    some = np.logical_or.reduce([c != default for c in columns])
    return Table(keys[some], [c[some] for c in columns], default)


@dataclass
class GramTables:
    """Models in tables, by name: per order (gram, counts) and (context, total and discounted sum of each count), and the letters' counts with their sums."""

    levels: dict[int, tuple[DataFrame, DataFrame]]
    letters: DataFrame
    totals: dict[str, float]
    counts: dict[str, tuple[str, ...]]

    @staticmethod
    def of(grams: DataFrame, rows: dict[str, Column]) -> GramTables:
        """For every named condition on the rows (gram, label, fold, n). The tables outlive the discarding() that this is called in."""
        n = lambda name, y: F.sum(F.when(rows[name] & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"{name}_{y}")
        level = materialize(grams.groupBy("gram").agg(*[n(name, y) for name in rows for y in (1, 0)]), "grams", outer=True)
        top = {name: (f"{name}_1", f"{name}_0") for name in rows}
        counts, levels = top, {}
        for order in range(ORDER, 1, -1):
            own = [c for cs in counts.values() for c in cs]
            sums = [x for c in own for x in (F.sum(c).alias(f"total_{c}"), F.sum(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).alias(f"kept_{c}"))]
            levels[order] = level, materialize(level.groupBy(F.substring("gram", 1, order - 1).alias("context")).agg(*sums), "contexts", outer=True)
            # the grams of the next lower order, with the number of distinct letters before them
            met = {name: sum((F.col(c) for c in cs[1:]), F.col(cs[0])) > 0 for name, cs in counts.items()}
            lower = level.select(F.substring("gram", 2, order).alias("gram"), *[F.when(m, 1).otherwise(0).alias(name) for name, m in met.items()])
            level = materialize(lower.groupBy("gram").agg(*[F.sum(name).alias(name) for name in rows]), "lower-grams", outer=True)
            counts = {name: (name,) for name in rows}
        sums = level.agg(*[F.sum(name).alias(name) for name in rows]).first()
        return GramTables(levels, level, {name: float(sums[name] or 0) + FAINT * LETTERS for name in rows}, top)

    def ratios(self, asked: DataFrame, name: str) -> DataFrame:
        """asked (gram, of ORDER letters, each once) with ratio: the logarithm of the quotient of the last letter's probabilities under the toxic and the ordinary model.

        Joins are merged, however small the tables: a broadcast is held by the driver, in blocks of several MB each, and here they would be a dozen at once. Each order is a query of its own.
        """
        ends = lambda k: asked.select(F.substring("gram", ORDER - k + 1, k).alias("gram")).distinct()
        p = ends(1).join(self.letters.hint("merge"), "gram", "left").select("gram", ((F.coalesce(name, F.lit(0)) + FAINT) / self.totals[name]).cast("float").cast("double").alias("p"))
        for order in range(2, ORDER + 1):
            level, contexts = self.levels[order]
            own = self.counts[name] if order == ORDER else (name,)
            q = (asked if order == ORDER else ends(order)).join(level.select("gram", *own).hint("merge"), "gram", "left").withColumn("context", F.substring("gram", 1, order - 1))
            q = q.join(contexts.select("context", *[f"{x}_{c}" for c in own for x in ("total", "kept")]).hint("merge"), "context", "left")
            q = q.withColumn("end", F.substring("gram", 2, order - 1)).join(p.withColumnRenamed("gram", "end").hint("merge"), "end")
            part = lambda c: F.coalesce(F.try_divide(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)), F.col(f"total_{c}")), F.lit(0.0)).cast("float")
            back = lambda c: (1 - F.coalesce(F.try_divide(F.col(f"kept_{c}"), F.col(f"total_{c}")), F.lit(0.0))).cast("float")
            mixed = [part(c).cast("double") + back(c).cast("double") * F.col("p") for c in own]
            if order < ORDER:
                p = materialize(q.select("gram", mixed[0].alias("p")), "lower-ratios")
        return q.select(*asked.columns, (F.log(mixed[0]) - F.log(mixed[1])).cast("float").alias("ratio"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ratio) of (gram, ratio): eight bytes for a gram's letters, which the driver needn't have."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(gram_keys(batch.column("gram").to_pylist()).view(np.int64)), batch.column("ratio")], names=["key", "ratio"])


class Ratios:
    """Log ratios of grams, as WordScores asks for them; NaN for a gram that it doesn't hold."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray, under: Ratios | None = None):
        self.table, self.under = Table(keys, [ratios], np.nan), under

    def log_ratio(self, codes: np.ndarray) -> np.ndarray:
        found = self.table.get(window_keys(codes)[ORDER - 1])[0].astype(np.float64)
        return found if self.under is None else np.where(np.isnan(found), self.under.log_ratio(codes), found)


def _places(words: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Padded words, one after the other; the places where a gram of one of them ends, and that word's number."""
    padded = [_padded(w) for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.flatnonzero(place >= ORDER - 1)
    return "".join(padded), ends, np.repeat(np.arange(len(words)), sizes)[ends]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}
    without_state()

    def sums() -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            text, ends, of = _places(some)
            n = np.fromiter((counts[w] for w in some), np.int64, len(some))[of]
            _, first, which = np.unique(window_keys(_codes(text))[ORDER - 1][ends], return_index=True, return_inverse=True)
            grams = [text[i - ORDER + 1 : i + 1] for i in ends[first].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.bincount(which, weights=n, minlength=len(grams)).astype(np.int64))], names=["gram", "n"])
        counts.clear()

    for batch in text_batches(batches):
        words, which, _ = _dealt(batch.column("text"))
        for w, n in zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True):
            for p in _pieces(_padded(w)) if len(w) > LONG else (w,):
                counts[p] = counts.get(p, 0) + n
        if len(counts) > CACHE:
            yield from sums()
    yield from sums()


def _absent(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, gram): the grams of each text that the broadcast ones lack, each once."""
    for batch in text_batches(batches, most_rows=512):
        rows, grams = [], []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            whole, ends, _ = _places(list(set(_words(text))))
            lost = ends[np.isnan(shared.model.value.log_ratio(_codes(whole))[ends])]
            own = {whole[i - ORDER + 1 : i + 1] for i in lost.tolist()}
            rows += [row] * len(own)
            grams += own
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(grams, pa.string())], names=["row", "gram"])


def _completed(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, features) of texts whose absent grams come along."""
    for batch in text_batches(batches, most_rows=512):
        found = []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
            words, which, _ = _dealt(pa.array([text]))
            scores = WordScores(Ratios(gram_keys([x["gram"] for x in own]), np.array([x["ratio"] for x in own], np.float32), shared.model.value))
            found.append(_measures(scores.of(words)[which]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c, pa.float64()) for c in zip(*found, strict=True)]], names=["row", *FEATURES])


class WordScores(dict):
    """word -> log ratio of its letters, for the words met so far; starts anew when full."""

    def __init__(self, model: Model | Ratios):
        self.model = model

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(words)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            padded = [_padded(w) for w in part]
            sizes = np.fromiter(map(len, padded), np.int64, len(padded))
            ratio = self.model.log_ratio(_codes("".join(padded)))
            place = np.arange(len(ratio)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ratio[place < ORDER - 1] = 0.0  # pads, or letters that the piece before has
            self.update(zip(part, np.add.reduceat(ratio, np.cumsum(sizes) - sizes).tolist(), strict=True))

    def of(self, words: list[str]) -> np.ndarray:
        """The log ratio of each of these, all different; of a long word, the sum of its pieces'."""
        pieces = {w: _pieces(_padded(w)) for w in words if len(w) > LONG}
        plain = [w for w in words if w not in pieces] if pieces else words
        self.learn({*plain, *(p for ps in pieces.values() for p in ps)})
        return np.fromiter((sum(map(self.__getitem__, pieces[w])) if w in pieces else self[w] for w in words) if pieces else map(self.__getitem__, words), np.float64, len(words))


def features(words: list[str], scores: WordScores) -> tuple[float, ...]:
    """Log ratio per word of the whole text, then of its strongest run of each of WINDOWS (shorter texts as if filled up with neutral words), and the log of the words. Texts without words: zeros."""
    if not words:
        return (0.0,) * len(FEATURES)
    v = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    if any(w.startswith(PIECE) for w in words):  # the pieces of a long word are one word
        later = np.fromiter((w.startswith(PIECE) and not w.startswith(PIECE + PAD) for w in words), bool, len(words))
        v = np.bincount(np.cumsum(~later) - 1, weights=v)
    return _measures(v)


def _measures(v: np.ndarray) -> tuple[float, ...]:
    """features() of the words' log ratios."""
    if not len(v):
        return (0.0,) * len(FEATURES)
    total = np.concatenate([[0.0], np.cumsum(v)])
    runs = [float((total[min(w, len(v)) :] - total[: len(total) - min(w, len(v))]).max() / w) for w in WINDOWS]
    return float(total[-1] / len(v)), *runs, float(np.log1p(len(v)))


def _feature_rows(shared, carry: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scores = worker_state(shared.id, lambda: WordScores(shared.model.value))
    for batch in text_batches(batches):
        words, which, ends = _dealt(batch.column("text"))
        v, starts = scores.of(words)[which], [0, *ends[:-1].tolist()]
        rows = [_measures(v[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)]
        found = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]
        short = pa.array([t if isnan(r[0]) else None for t, r in zip(batch.column("text").to_pylist(), rows, strict=True)], pa.string())  # holds a gram that isn't broadcast
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(batch.column, carry), *found, short], names=["doc_id", *carry, *FEATURES, "short_"])


class Shared:
    """Broadcast ratios and the id by which workers keep its word scores."""

    def __init__(self, spark, model: Ratios):
        self.model = spark.sparkContext.broadcast(model)
        self.id = f"{spark.sparkContext.applicationId}-{self.model._jbroadcast.id()}"


def feature_rows(docs: DataFrame, tables: GramTables, name: str, carry: tuple[str, ...] = (), head: int | None = None) -> DataFrame:
    """(doc_id, carried columns, features) of docs (doc_id, text and what is carried) under one of the models."""
    head = HEAD if head is None else head
    rows = docs.select("doc_id", "text", *[c for c in carry if c != "text"])
    with small_batches(docs.sparkSession, 4 << 20):
        met = materialize(rows.select("text").mapInArrow(_met, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "met-grams")
    known = materialize(tables.ratios(met, name), "ratios")
    every = known.count() <= head
    most = known if every else known.orderBy(F.desc("n"), "gram").limit(head)
    some = most.select("gram", "ratio").mapInArrow(_keyed, "key long, ratio float").toArrow()  # head rows of two numbers at most
    shared = Shared(docs.sparkSession, Ratios(some.column("key").to_numpy().view(np.uint64), some.column("ratio").to_numpy()))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[rows.schema[c] for c in carry], *[T.StructField(f, T.DoubleType()) for f in FEATURES], T.StructField("short_", T.StringType())])
    out = rows.mapInArrow(partial(_feature_rows, shared, carry), schema)
    if every:
        return out.drop("short_")
    with small_batches(docs.sparkSession, 4 << 20):
        out = materialize(out.withColumn("row_", F.monotonically_increasing_id()), "first-features")
    short = out.filter("short_ is not null").select(F.col("row_").alias("row"), F.col("short_").alias("text"))
    own = short.mapInArrow(partial(_absent, shared), "row long, gram string").join(known.select("gram", "ratio"), "gram").groupBy("row").agg(F.collect_list(F.struct("gram", "ratio")).alias("own"))  # as many as the text has
    done = short.join(own, "row").mapInArrow(partial(_completed, shared), T.StructType([T.StructField("row", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]]))
    mended = out.filter("short_ is not null").drop("short_", *FEATURES).join(done, F.col("row_") == F.col("row"))
    columns = ["doc_id", *carry, *FEATURES]
    return out.filter("short_ is null").select(*columns).unionByName(mended.select(*columns))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights (bias last) of standardised features, mapped back to raw ones, by Newton steps. Without both labels: a constant at the share of label 1."""
    k = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
    if len(y) == 0 or y.min() == y.max():
        return np.array([0.0] * k + [np.log(share / (1 - share))])
    mean, std = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w = np.zeros(k + 1)
    penalty = np.diag([ridge] * k + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(k + 1), a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:k] / std
    return np.append(raw, w[k] - (raw * mean).sum())


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[GramTables, np.ndarray]:
    """(tables with the model `whole` over all training rows, curve). A document labelled 0 and 1 counts as toxic; rows of the held-out fold are never read."""
    with discarding(docs.sparkSession), small_batches(docs.sparkSession, 4 << 20):  # the model's tables stay
        return _train(docs, labels, fit_rows)


def _train(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[GramTables, np.ndarray]:
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    rows = id_and_text(docs).withColumn("fold", fold_of(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)
    # texts move once at any size of the labels
    labelled = materialize(rows.join(one.hint("merge"), "doc_id").select("doc_id", "text", "label", "fold"), "labelled")
    grams = materialize(count_grams(labelled), "class-grams")
    tables = GramTables.of(grams, {"part": F.col("fold") != CURVE, "whole": F.lit(True)})
    held = labelled.filter(F.col("fold") == CURVE)
    share = min(1.0, fit_rows / max(1, held.count()))
    held = held.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "text", "label")
    frame = feature_rows(held, tables, "part").join(held.select("doc_id", "label"), "doc_id").toArrow()  # about fit_rows rows of a few numbers
    curve = fit_curve(np.column_stack([frame.column(f).to_numpy() for f in FEATURES]), frame.column("label").to_numpy().astype(float))
    return tables, curve


def score(docs: DataFrame, model: GramTables, curve: np.ndarray, carry: tuple[str, ...] = (), head: int | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, and the columns to carry along.

    Null or empty text: no evidence, the curve's value at zero. Null doc_id: scored, not held out.
    Repeated rows: a row each. Empty table: no rows. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = feature_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[c for c in carry if c != "text"]), model, "whole", carry, head)
    z = F.lit(float(curve[-1]))
    for w, f in zip(curve, FEATURES, strict=False):
        z = z + float(w) * F.col(f)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return rows.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), p.alias("score"), (p >= THRESHOLD).cast("int").alias("predicted"), *carry)
