"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text's elements are its SHINGLE-word shingles, weighted by how often they occur. Every element
owns the plane of (weight, rank); a unit-rate Poisson process of darts is hashed onto it, region
by region, so equal elements get equal darts in every document. A document sees the darts below
its elements' weights; of those that hash to a coordinate, the earliest in rank is kept. Two
documents agree at a coordinate with the probability of their weighted Jaccard similarity, and a
signature costs about the number of elements plus the number of darts, not their product.

Coordinates are grouped into bands; texts that share a band are candidates, and every candidate
link is verified on the whole shingle multisets (32-bit hashes). Links form classes. Copies are
one node from the start. First every node is tried with the member of its buckets that shares
most bands with others. Then small buckets (at most SMALL nodes) that still hold several classes
try all pairs of different classes. Nodes of larger ones are dealt anew by their rarest shingles,
which any similar pair shares and a common passage doesn't reach, and all pairs of different
classes are tried there; large ones of these are joined block by block, so no task gathers a large
bucket. A pair is spared its reading of shingles only where weights, places or signatures tell that
it is not similar: by FAR of the K coordinates or more, of which a similar pair has fewer but for
a chance below 1e-11.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discarding, materialize, small_batches, text_batches, without_state
from .hashing import BASE, STEP, mix, word_hashes, word_runs

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
K = BANDS * ROWS
SMALL = 16
BLOCK = 256
#: Of every coordinate PLANES bits are kept, a plane of bits in two longs; a pair whose planes differ at over FAR coordinates is not similar.
PLANES, FAR = 4, 50
SKETCH = tuple(f"s{k}" for k in range(2 * PLANES))
RARE_SLOTS = 1 << 18
FIRST_RANK = 1 / 64


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 32-bit hash) of every shingle, in order of both, repeats kept.

    Words are runs between ASCII white space. A text of fewer than SHINGLE words, but one at least, has one shingle: all of it.
    """
    doc, h = word_runs(*word_hashes(texts), len(texts), SHINGLE)
    key = (doc.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    key.sort()
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)


@lru_cache(maxsize=256)
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts in a region."""
    k = np.arange(1, int(area + 12 * np.sqrt(area) + 24))
    return np.cumsum(np.exp(np.concatenate([[-area], -area + np.cumsum(np.log(area / k))])))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """(n x k) signatures of n weighted sets given as rows (doc, element, weight); 0 for sets without elements."""
    out = np.zeros((n, k), np.uint64)
    mass = np.bincount(doc, weights=weight, minlength=n)
    darts = k * np.log(k) + 4 * k
    todo = mass > 0
    while todo.any():
        own = todo[doc]
        d, e, x = doc[own], element[own].astype(np.uint64), weight[own].astype(np.float64)
        limit = np.where(mass > 0, darts / np.maximum(mass, 1), 0)
        slots, ranks, names = [], [], []
        band, low_w, high_w = 0, 0.0, 1.0
        while len(d):
            layer, low_r, high_r = 0, 0.0, FIRST_RANK
            while True:
                live = limit[d] > low_r
                if not live.any():
                    break
                dl, el, xl = d[live], e[live], x[live]
                seed = mix(el * STEP + np.uint64(band * 1024 + layer + 1))
                count = np.searchsorted(_poisson((high_w - low_w) * (high_r - low_r)), _uniform(seed))
                rows = np.repeat(np.arange(len(dl)), count)
                if len(rows):
                    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                    name = mix(seed[rows] + (nth.astype(np.uint64) + np.uint64(1)) * BASE)
                    w = low_w + (high_w - low_w) * _uniform(mix(name + np.uint64(1)))
                    r = low_r + (high_r - low_r) * _uniform(mix(name + np.uint64(2)))
                    hit = (w < xl[rows]) & (r < limit[dl[rows]])
                    rows, name, r = rows[hit], name[hit], r[hit]
                    slots.append(dl[rows] * k + (mix(name + np.uint64(3)) % np.uint64(k)).astype(np.int64))
                    ranks.append(r)
                    names.append(name)
                layer, low_r, high_r = layer + 1, high_r, high_r * 2
            wider = x > high_w
            d, e, x = d[wider], e[wider], x[wider]
            band, low_w, high_w = band + 1, high_w, high_w * 2
        slot, rank, name = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
        order = np.lexsort((rank, slot))
        slot, name = slot[order], name[order]
        earliest = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        flat = out.reshape(-1)
        flat[slot[earliest]] = name[earliest]
        full = np.bincount(slot[earliest] // k, minlength=n) == k
        todo &= ~full
        darts *= 2
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """(n x 2 * PLANES) the lowest PLANES bits of every coordinate, two longs a plane."""
    bits = np.zeros((len(signature), PLANES, 128), np.uint8)
    for j in range(PLANES):
        bits[:, j, :K] = (signature >> np.uint64(j)) & np.uint64(1)
    return np.packbits(bits, axis=2, bitorder="little").view("<i8").reshape(len(signature), 2 * PLANES)


def differing(x, y) -> Column:
    """At how many coordinates two sketches differ; x and y give the columns of their longs."""
    parts = []
    for half in (0, 1):
        odd = x(SKETCH[half]).bitwiseXOR(y(SKETCH[half]))
        for j in range(1, PLANES):
            odd = odd.bitwiseOR(x(SKETCH[2 * j + half]).bitwiseXOR(y(SKETCH[2 * j + half])))
        parts.append(F.bit_count(odd))
    return parts[0] + parts[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    without_state()
    for batch in text_batches(batches, most_bytes=1 << 19):
        texts = batch.column("text").to_pylist()
        n = len(texts)
        doc, hashes = shingle_hashes(texts)
        ends = np.searchsorted(doc, np.arange(n), side="right")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if n else ends
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]) if len(doc) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        weight = np.diff(np.concatenate([at, [len(doc)]]))
        signature = dart_signatures(doc[at], hashes[at], weight, n)
        bands = np.zeros((n, BANDS), np.uint64)
        for j in range(ROWS):
            bands = mix(bands * STEP + signature[:, j::ROWS] + np.uint64(1))
        bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)
        raw = hashes.astype("<u4").tobytes()
        columns = {name: batch.column(name) for name in batch.schema.names if name != "text"}
        columns["weight"] = pa.array((ends - starts).astype(np.int32))
        columns["bands"] = pa.array([b.tolist() if e > s else [] for b, s, e in zip(bands, starts, ends, strict=True)], pa.list_(pa.int64()))
        columns |= {c: pa.array(v) for c, v in zip(SKETCH, sketches(signature).T.copy(), strict=True)}
        columns["shingles"] = pa.array([raw[4 * s : 4 * e] for s, e in zip(starts, ends, strict=True)], pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def sign(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(key, if one is named, doc_id, node, weight, bands, sketch, shingles): node is a 128-bit hash of the whole text, weight its number of shingles."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*([F.col(key).alias("key")] if key else []), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    made = "weight int, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH) + ", shingles binary"
    return rows.mapInArrow(_sign, ("key binary, " if key else "") + "doc_id long, node binary, " + made)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    if len(a) + len(b) == 0:
        return 1.0
    both = np.concatenate([_numbered(a), _numbered(b)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def _numbered(a: np.ndarray) -> np.ndarray:
    """Sorted values made distinct: the value and its number among equals."""
    new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
    return (a.astype(np.uint64) << np.uint64(32)) | (np.arange(len(a)) - first).astype(np.uint64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
            if overlap(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) >= SIMILAR:
                keep.append(i)
        got = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b")], names=["a", "b"])


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose multisets are similar; shingles: (node, shingles), one row per node."""
    left = pairs.join(shingles.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(shingles.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(_verify, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each node's component, for all nodes of edges (a, b).

    Each round takes the smallest label among neighbours, then follows labels once; the labels are
    written each round. A node with very many edges is a hot key on one side of a join only.
    """
    arcs = materialize(edges.select("a", "b").union(edges.select("b", "a")), "arcs")
    labels = materialize(arcs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp")), "labels")
    while True:
        near = arcs.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        near = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = materialize(near.join(jump, "comp").select("node", F.least("comp", "further").alias("comp"), "was"), "labels")
        labels = after.select("node", "comp")
        if after.filter("comp <> was").isEmpty():
            return labels


def _placed(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(key, doc_id, comp) of every row, written; rows of one comp are one class. Tables of the work go when it is done."""
    with discarding(docs.sparkSession), small_batches(docs.sparkSession, 4 << 20):
        return materialize(_grouped(docs, key), "placed", outer=True)


def _grouped(docs: DataFrame, key: str | None) -> DataFrame:
    signed = materialize(sign(docs, key), "signed")
    full = signed.filter(F.size("bands") > 0)
    own = ("weight", "bands", *SKETCH)
    nodes = materialize(full.select("node", *own).groupBy("node").agg(*[F.first(c).alias(c) for c in own]), "nodes")
    held = nodes.select("node", F.explode("bands").alias("band"))
    buckets = held.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(held.join(materialize(buckets, "buckets"), "band"), "members")
    shingles = full.select("node", "shingles").groupBy("node").agg(F.first("shingles").alias("shingles"))
    shingles = materialize(shingles.join(members.select("node").hint("merge"), "node", "left_semi"), "shingles", codec="none")
    profiles = materialize(nodes.drop("bands").join(members.select("node").hint("merge"), "node", "left_semi"), "profiles")
    # one try per node, with the member of its buckets that shares most bands with others: what copies were made from, if it is there
    known = materialize(members.join(members.groupBy("node").agg(F.sum("n").alias("shared")), "node").select("band", "node", F.struct("shared", "node").alias("rank")), "known")
    top = materialize(known.groupBy("band").agg(F.max("rank").alias("top")), "tops")
    first = known.join(top, "band").groupBy(F.col("node").alias("b")).agg(F.max("top")["node"].alias("a")).filter("a <> b").select("a", "b")
    links = materialize(verified(first, shingles), "links")
    labels = components(links)
    cards = _cards(profiles, labels)
    small, large = members.filter(F.col("n") <= SMALL), members.filter(F.col("n") > SMALL)
    # what large buckets leave apart is dealt anew by rare shingles
    apart = large.select("band", "node").join(cards.select("node", "weight", "comp"), "node")
    mixed = materialize(apart.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1"), "mixed")
    again = apart.join(mixed.select("band"), "band", "left_semi").groupBy("node").agg(F.first("weight").alias("weight"))
    rare = rare_shingle_buckets(materialize(again, "apart"), shingles)
    small = small.select("band", "node").unionByName(rare.filter(F.col("n") <= SMALL).select("band", "node"))
    links = links.unionByName(materialize(verified(materialize(_small_tries(small, cards), "tries"), shingles), "links"))
    labels = components(links)
    tries = _large_tries(rare.filter(F.col("n") > SMALL), _cards(profiles, labels))
    more = materialize(verified(materialize(tries, "tries"), shingles), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    rows = signed.select(*["key"] * bool(key), "doc_id", "node").join(labels, "node", "left")
    return rows.select(*["key"] * bool(key), "doc_id", F.coalesce("comp", "node").alias("comp"))


def near_dup_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of the class of texts linked, directly or over others, by a similarity of SIMILAR or more.

    Null text: empty. Empty texts are copies of each other and similar to nothing else; texts of
    fewer than SHINGLE words are similar to their copies only. Null doc_id: a row as any; a class
    of null ids only has a null class_id. Repeated rows: a row each, of one class. Empty table: no
    rows. Other columns are ignored.
    """
    placed = _placed(docs)
    least = materialize(placed.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "classes")
    return placed.join(least, "comp").select("doc_id", "class_id")


def near_dup_keepers(docs: DataFrame, key: str) -> DataFrame:
    """(key): one key per class, of the row with the smallest doc_id (null ids last, then the smallest key). key: a binary column that differs between different rows."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    return _placed(docs, key).groupBy("comp").agg(F.min(rank)["key"].alias("key")).select("key")


def _cards(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, weight, sketch, comp) of the nodes that share buckets."""
    return materialize(profiles.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "cards")


def _slot(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) & np.uint64(RARE_SLOTS - 1)).astype(np.int64)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n) of the slots that several texts of a task fall into."""
    total = np.zeros(RARE_SLOTS, np.int64)
    for batch in batches:
        for raw in batch.column("shingles").to_pylist():
            total += np.bincount(np.unique(_slot(_numbered(np.frombuffer(raw, "<u4")))), minlength=RARE_SLOTS)
    at = np.flatnonzero(total > 2)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["slot", "n"])


def _prefixes(counts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = counts.value
    for batch in batches:
        for at in range(batch.num_rows):
            own = _numbered(np.frombuffer(batch.column("shingles")[at].as_py(), "<u4"))
            size = len(own) - int(np.ceil(SIMILAR * len(own) - 1e-9)) + 1
            rare = own[np.lexsort((own, common[_slot(own)]))[:size]].view(np.int64)
            node = pa.array([batch.column("node")[at].as_py()], pa.binary()).take(pa.array(np.zeros(len(rare), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(rare), node, pa.array(np.arange(len(rare), dtype=np.int32))], names=["band", "node", "place"])


def rare_shingle_buckets(nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """(band, node, place, n): buckets of nodes (node) by rare shingles, such that any two similar nodes share one.

    All nodes order shingles alike, rare ones first; two multisets of a similarity of SIMILAR or
    more share an element among the first fifth of theirs. What only a common passage holds
    together falls apart here. Frequencies are hashed to RARE_SLOTS counters, the only thing that
    goes over the driver; they change the order, not the result.
    """
    own = materialize(shingles.join(nodes.select("node"), "node"), "own", codec="none")
    counts = np.zeros(RARE_SLOTS, np.int64)
    common = own.select("shingles").mapInArrow(_common, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[common.column("slot").to_numpy()] = common.column("n").to_numpy()
    shared = own.sparkSession.sparkContext.broadcast(counts)
    held = materialize(own.mapInArrow(partial(_prefixes, shared), "band long, node binary, place int"), "prefixes")
    sizes = materialize(held.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    return materialize(held.join(sizes, "band"), "rare")


def _small_tries(members: DataFrame, cards: DataFrame) -> DataFrame:
    """All pairs (a, b) of different classes of each bucket that can be similar; members: (band, node), at most SMALL a bucket."""
    known = members.join(cards, "node")
    listed = known.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("node", "weight", "comp", *SKETCH))).alias("all"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    each = listed.select(F.posexplode("all").alias("i", "x"), "all")

    def fits(y: Column) -> Column:
        x, weights = (lambda c: F.col(f"x.{c}")), (F.col("x.weight"), y["weight"])
        return (x("comp") != y["comp"]) & (F.least(*weights) >= F.greatest(*weights) * SIMILAR) & (differing(x, lambda c: y[c]) <= FAR)

    pairs = each.select(F.col("x.node").alias("a"), F.explode(F.filter(F.slice("all", F.col("i") + 2, SMALL), fits)).alias("y"))
    return pairs.select("a", F.col("y.node").alias("b")).distinct()


def _large_tries(members: DataFrame, cards: DataFrame) -> DataFrame:
    """Every pair (a, b) of different classes of each bucket that can be similar; members: rows of rare_shingle_buckets.

    One of a pair is outside the bucket's largest class. Those outside and all nodes are split into
    blocks of about BLOCK by hash, and each block of the one meets each block of the other under a
    key of its own. What is left out is not similar: by weights, by the places of the shingle (the
    bucket of a pair's first common shingle has them right), and by the signatures.
    """
    now = materialize(members.select("band", "node", "place").join(cards, "node"), "now")
    classes = now.groupBy("band", "comp").agg(F.count("*").alias("k"))
    several = classes.groupBy("band").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("main"), F.count("*").alias("classes")).filter("classes > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    several = several.select("band", F.col("main.comp").alias("main"), blocks(F.col("n") - F.col("main.k")).alias("ins"), blocks(F.col("n")).alias("outs"))
    mixed = now.join(materialize(several, "several"), "band")
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = mixed.filter("comp <> main").withColumn("l", own(F.col("ins"), 1)).withColumn("r", every(F.col("outs")))
    right = mixed.withColumn("r", own(F.col("outs"), 2)).withColumn("l", every(F.col("ins")))
    facts = ("node", "weight", "place", "comp", *SKETCH)
    left = left.select("band", "l", "r", *[F.col(c).alias(f"x_{c}") for c in facts])
    right = right.select("band", "l", "r", *[F.col(c).alias(f"y_{c}") for c in facts], (F.col("comp") == F.col("main")).alias("largest"))
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    least = (x("weight") + y("weight")) * (SIMILAR / (1 + SIMILAR)) - 1e-6  # elements that similar texts share at least
    can = (x("comp") != y("comp")) & (F.col("largest") | (x("node") < y("node"))) & (F.least(x("weight"), y("weight")) >= F.greatest(x("weight"), y("weight")) * SIMILAR)
    can = can & (F.least(x("weight") - x("place"), y("weight") - y("place")) >= least) & (differing(x, y) <= FAR)
    met = left.alias("left").join(right.alias("right"), (F.col("left.band") == F.col("right.band")) & (F.col("left.l") == F.col("right.l")) & (F.col("left.r") == F.col("right.r")) & can)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
