"""Exact join of texts by the Jaccard similarity of their word n-gram sets, skipping by set relations.

Equal texts are one node. All sets order their shingles alike, those of rare hash slots first, so
that two sets that link share one among the first fifth of theirs. These first shingles go to an
index: a list per shingle of the nodes that have it, with the shingle's place and the set's size.

Answers of one set are used for others like it. First each node is compared with one leader, the
node of its lists that shares most with others: what the leader has and it hasn't (and the other way
round) is kept as the node's difference. Links to leaders already join most of a group of copies.
Then lists that still hold several components are cut into blocks by component, size and place; a
pair of blocks is skipped whole where the bounds of sizes and places rule it out, or where all its
nodes are connected. What is left is derived: of two nodes with the same leader, the shared parts
bound their overlap from both sides, and where the bounds don't decide, their two small differences
give it exactly. Only nodes of different leaders are read again. No link is lost: a pair is left out
only if it is connected, or can't reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discarding, id_and_text, materialize, small_batches, text_batches
from .hashing import STEP, mix, word_hashes, word_runs
from .near_dup import components

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union, that is (100 + PERCENT) * intersection >= PERCENT * (sum of sizes).
PERCENT = 80
#: Counters of shingles by hash, which only order them; and bits of the table of nodes whose texts are wanted.
SLOTS, MARKS = 1 << 18, 1 << 26
CHUNKS = 64
#: A shingle in more than one of HOT index entries is hot (there are fewer than 2 * HOT); its list is dealt by node, too.
HOT, SALT = 4096, 64
#: Entries of a block of a list.
BLOCK = 256
#: Node pairs that are tried at once.
AT_ONCE = 1 << 20
FACTS = ("node", "n", "place", "comp", "leader", "shared", "leader_n")


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted; A-Z count as a-z. A text of fewer words has one shingle, one without words none."""
    doc, hashes = word_runs(*word_hashes(texts, lower=True), len(texts), SHINGLE)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) & np.uint64(SLOTS - 1)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in text_batches(batches, most_bytes=1 << 20):
        total += np.bincount(_slot(np.concatenate([*shingle_sets(batch.column("text").to_pylist()), np.zeros(0, np.uint64)])), minlength=SLOTS)
    for chunk, part in enumerate(np.split(total.astype("<i8"), CHUNKS)):
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(raw, "<i8")
            total[chunk] = total[chunk] + own if chunk in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How many documents hold a shingle of each slot: SLOTS numbers, added up in CHUNKS parts of the table."""
    made = docs.select("text").mapInArrow(_tally, "chunk int, counts binary").repartition(CHUNKS, "chunk").mapInArrow(_sum, "chunk int, counts binary")
    out = np.zeros(SLOTS, np.int64)
    for row in made.collect():
        out[row.chunk * (SLOTS // CHUNKS) : (row.chunk + 1) * (SLOTS // CHUNKS)] = np.frombuffer(row.counts, "<i8")
    return out


def prefix_size(n: int) -> int:
    """Of so many shingles, in order, two sets that link share one at least: n less those that they share at least, and one."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def _prefixes(order, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = order.value
    for batch in text_batches(batches, most_bytes=1 << 20):
        sets = shingle_sets(batch.column("text").to_pylist())
        first = [own[np.lexsort((own, common[_slot(own)]))[: prefix_size(len(own))]].astype("<u8").tobytes() for own in sets]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.binary())], names=["key", "n", "prefix"])


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, k) of those that a task's nodes hold in more than one of 2 * HOT entries."""
    found = [np.frombuffer(raw.as_buffer(), "<i8") for batch in batches for raw in batch.column("prefix")]
    tokens, k = np.unique(np.concatenate(found) if found else np.zeros(0, "<i8"), return_counts=True)
    most = k > max(1, k.sum() // (2 * HOT))
    yield pa.RecordBatch.from_arrays([pa.array(tokens[most]), pa.array(k[most])], names=["token", "k"])


def _entries(hot, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, salt, node, size and place): salt is 0 but for hot shingles."""
    for batch in text_batches(batches, most_bytes=1 << 20):
        found = [np.frombuffer(raw.as_buffer(), "<i8") for raw in batch.column("prefix")]
        k = np.array([len(f) for f in found], np.int64)
        if k.sum():
            token, node = np.concatenate(found), np.repeat(batch.column("node").to_numpy(), k)
            place = np.arange(len(token)) - np.repeat(np.cumsum(k) - k, k)
            at = np.minimum(np.searchsorted(hot.value, token), max(0, len(hot.value) - 1))
            is_hot = hot.value[at] == token if len(hot.value) else np.zeros(len(token), bool)
            salt = np.where(is_hot, 1 + (mix(node.astype(np.uint64) * STEP) % np.uint64(SALT)).astype(np.int64), 0)
            size = np.repeat(batch.column("n").to_numpy().astype(np.int64), k)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(salt.astype(np.int32)), pa.array(node), pa.array((size << 32) | place)], names=["token", "salt", "node", "meta"])


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in order of their shingle, those of shingles that several nodes hold; hot ones pass. One row waits for what follows it."""
    held, before = None, None  # the last row so far, and the shingle before it
    schema = None

    def chosen(batch: pa.RecordBatch, after: int | None) -> pa.RecordBatch:
        token = batch.column("token").to_numpy()
        same = np.diff(token) == 0
        keep = np.concatenate([[before == token[0] if before is not None else False], same]) | np.concatenate([same, [after == token[-1]]]) | (batch.column("salt").to_numpy() > 0)
        return batch.filter(pa.array(keep)).select(["token", "node", "meta"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        schema = batch.schema
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if table.num_rows > 1:
            body = table.slice(0, table.num_rows - 1)
            yield chosen(body, table.column("token")[-1].as_py())
            before = body.column("token")[-1].as_py()
        held = table.slice(table.num_rows - 1)
    if schema is not None:
        yield chosen(held, None)


def index_lists(nodes: DataFrame) -> DataFrame:
    """(token, node, n, place): the index entries of shingles that several nodes hold."""
    spark, total = nodes.sparkSession, nodes.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    heavy = nodes.select("prefix").mapInArrow(_heavy, "token long, k long").groupBy("token").agg(F.sum("k").alias("k")).filter(F.col("k") > max(SALT, total // (2 * HOT)))
    hot = spark.sparkContext.broadcast(np.array(sorted(r.token for r in heavy.collect()), np.int64))  # fewer than 2 * HOT
    dealt = nodes.select("node", "n", "prefix").mapInArrow(partial(_entries, hot), "token long, salt int, node long, meta long").repartition("token", "salt").sortWithinPartitions("token", "salt")
    kept = dealt.mapInArrow(_several, "token long, node long, meta long")
    return kept.select("token", "node", F.shiftright("meta", 32).cast("int").alias("n"), F.col("meta").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place"))


def _mark_slots(keys: pa.Array) -> np.ndarray:
    data = np.frombuffer(b"".join(keys.to_pylist()), "<u8")[::2]
    return data % np.uint64(MARKS)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(MARKS >> 6, np.uint64)
    for batch in batches:
        slots = _mark_slots(batch.column(0))
        np.bitwise_or.at(bits, (slots >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slots & np.uint64(63)))
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].view(np.int64))], names=["at", "bits"])


def _wanted(marks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = marks.value
    for batch in batches:
        slots = _mark_slots(batch.column("key"))
        on = (bits[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
        yield batch.filter(pa.array(on))


def texts_of(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of wanted (key, node); a table of MARKS bits lets few other texts into the shuffle."""
    found = wanted.select("key").mapInArrow(_mark, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # MARKS / 64 rows at most
    bits = np.zeros(MARKS >> 6, np.uint64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    some = keyed.mapInArrow(partial(_wanted, keyed.sparkSession.sparkContext.broadcast(bits)), "key binary, text string")
    return some.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("node", "text")


def linked(shared, n_a, n_b):
    """Whether two sets with so many shared shingles link; for numbers, arrays and columns alike."""
    return shared * (100 + PERCENT) >= (n_a + n_b) * PERCENT


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, linked, a_n, plus, minus): b's set against a's; the differences where they are smaller than half of b."""
    last, own = None, np.zeros(0, np.uint64)
    for batch in text_batches(batches, most_bytes=2 << 20):
        out: list[list] = [[] for _ in range(5)]
        sets = shingle_sets(batch.column("right").to_pylist())
        for a, text, b_set in zip(batch.column("a").to_pylist(), batch.column("left"), sets, strict=True):
            if a != last:
                last, own = a, shingle_sets([text.as_py()])[0]
            both = np.intersect1d(own, b_set, assume_unique=True)
            small = len(own) + len(b_set) - 2 * len(both) <= len(b_set) // 2
            plus = np.setdiff1d(b_set, both, assume_unique=True).astype("<u8").tobytes() if small else None
            minus = np.setdiff1d(own, both, assume_unique=True).astype("<u8").tobytes() if small else None
            for column, value in zip(out, (len(both), bool(linked(len(both), len(own), len(b_set))), len(own), plus, minus), strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["a", "b", "shared", "linked", "a_n", "plus", "minus"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) compared on their whole sets. a's text comes last, so that it isn't shuffled once for each partner."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(_compare, "a long, b long, shared int, linked boolean, a_n int, plus binary, minus binary")


def leader_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): for each node b the member a of its lists that shares most entries with others, if that is another node."""
    sizes = lists.groupBy("token").agg(F.count("*").alias("k"))
    ranks = materialize(lists.join(sizes, "token").groupBy("node").agg(F.sum("k").alias("weight")), "ranks")
    known = materialize(lists.select("token", "node").join(ranks, "node").select("token", "node", F.struct("weight", "node").alias("rank")), "known")
    top = materialize(known.groupBy("token").agg(F.max("rank").alias("top")), "tops")
    return known.join(top, "token").groupBy(F.col("node").alias("b")).agg(F.max("top")["node"].alias("a")).filter("a <> b").select("a", "b")


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, way) of the block pairs' nodes that may link: way 0 link by bounds alone, 1 have the same leader, 2 are to be read. Many block pairs, with AT_ONCE node pairs about, are tried together."""
    for batch in batches:
        ends = {s: batch.column(f"{s}_node").offsets.to_numpy() for s in "xy"}
        lengths = {s: np.diff(ends[s]) for s in "xy"}
        count = lengths["x"].astype(np.int64) * lengths["y"]
        cuts = np.flatnonzero(np.diff(np.cumsum(count) // AT_ONCE, prepend=-1)).tolist() + [batch.num_rows]
        facts = {f"{s}_{c}": batch.column(f"{s}_{c}").values.to_numpy(zero_copy_only=False) for s in "xy" for c in FACTS}
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            own = count[first:last]
            row = np.repeat(np.arange(first, last), own)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
            wide = lengths["y"][row]
            at = {"x": ends["x"][row] + nth // wide, "y": ends["y"][row] + nth % wide}

            def keep(on: np.ndarray) -> None:
                for s in "xy":
                    at[s] = at[s][on]  # noqa: B023

            def get(c: str) -> tuple[np.ndarray, np.ndarray]:
                return facts[f"x_{c}"][at["x"]], facts[f"y_{c}"][at["y"]]  # noqa: B023

            keep(np.not_equal(*get("comp")))
            (nx, ny), (px, py) = get("n"), get("place")
            reach = np.minimum(nx - px, ny - py)  # exact for a pair's first common shingle
            keep((100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny)) & linked(reach, nx, ny))
            (x, y), (lx, ly) = get("node"), get("leader")
            keep((lx != y) & (ly != x))  # the others are answered
            (x, y), (lx, ly), (nx, ny), (sx, sy) = get("node"), get("leader"), get("n"), get("shared")
            same = (lx == ly) & (lx >= 0)
            may = ~same | linked(np.minimum(sx, sy) + np.minimum(nx - sx, ny - sy), nx, ny)
            way = np.where(same, np.where(linked(sx + sy - get("leader_n")[0], nx, ny), 0, 1), 2)[may]
            x, y = x[may], y[may]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(way.astype(np.int32))], names=["a", "b", "way"])


def open_pairs(lists: DataFrame, cards: DataFrame) -> DataFrame:
    """(a, b, way): pairs of different components that share a list and that no bound rules out.

    cards: (node, comp, leader, shared, leader_n). The largest component of a list stands on one side
    only, so no two of its nodes meet.
    """
    now = materialize(lists.join(cards, "node"), "now")
    groups = materialize(now.groupBy("token", "comp").agg(F.count("*").alias("k")), "groups")
    mixed = groups.groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp"))["comp"].alias("main")).filter("comps > 1").select("token", "main")
    # bands of sizes: what links lies in the same band or in neighbours
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    depth = F.floor(F.col("place") * 20 / F.col("n")).cast("int")
    placed = now.join(mixed, "token").withColumn("other", F.col("comp") != F.col("main")).withColumn("band", band).withColumn("depth", depth)
    placed = materialize(placed, "placed")
    parts = placed.groupBy("token", "other", "band", "depth").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    keyed = placed.join(parts, ["token", "other", "band", "depth"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    key = ["token", "other", "band", "depth", "part"]
    lists_of = [F.collect_list(F.col(c).cast("long")).alias(c) for c in FACTS]  # about BLOCK entries each
    blocks = materialize(keyed.groupBy(*key).agg(*lists_of, F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("place").alias("p0"), F.min("comp").alias("c0"), F.max("comp").alias("c1")), "blocks")
    x = blocks.filter("other").select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct("band", "depth", "part").alias("xk"), *[F.col(c).alias(f"x_{c}") for c in FACTS], *[F.col(c).alias(f"x{c}") for c in ("n0", "n1", "p0", "c0", "c1")])
    y = blocks.select("token", "band", F.col("other").alias("y_other"), F.struct("band", "depth", "part").alias("yk"), *[F.col(c).alias(f"y_{c}") for c in FACTS], *[F.col(c).alias(f"y{c}") for c in ("n0", "n1", "p0", "c0", "c1")])
    once = ~F.col("y_other") | (F.col("xk") <= F.col("yk"))
    apart = (F.col("xc0") != F.col("yc0")) | (F.col("xc1") != F.col("yc1")) | (F.col("xc0") != F.col("xc1"))
    sizes = (F.col("xn1") * 100 >= F.col("yn0") * PERCENT) & (F.col("yn1") * 100 >= F.col("xn0") * PERCENT)
    reach = F.least(F.col("xn1") - F.col("xp0"), F.col("yn1") - F.col("yp0")) * (100 + PERCENT) >= (F.col("xn0") + F.col("yn0")) * PERCENT
    met = x.join(y, ["token", "band"]).filter(once & apart & sizes & reach)
    both = met.select(*[f"{s}_{c}" for s in "xy" for c in FACTS])
    return both.mapInArrow(_block_pairs, "a long, b long, way int").distinct()


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of pairs with one leader that link: what both lack of it and what both add to it give their overlap."""
    for batch in batches:
        keep = []
        get = lambda c, i: np.frombuffer(batch.column(c)[i].as_py(), "<u8")  # noqa: B023, E731
        for i in range(batch.num_rows):
            lack = len(np.union1d(get("a_minus", i), get("b_minus", i)))
            add = len(np.intersect1d(get("a_plus", i), get("b_plus", i), assume_unique=True))
            if linked(batch.column("leader_n")[i].as_py() - lack + add, batch.column("a_n")[i].as_py(), batch.column("b_n")[i].as_py()):
                keep.append(i)
        got = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b")], names=["a", "b"])


def derived(pairs: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links found from differences, pairs that lack one) of pairs with one leader; answers: (node, n, leader_n, plus, minus)."""
    of = lambda s: answers.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("leader_n").alias(f"{s}_leader_n"), F.col("plus").alias(f"{s}_plus"), F.col("minus").alias(f"{s}_minus"))
    both = materialize(pairs.join(of("a"), "a").join(of("b"), "b"), "differences")
    known = both.filter("a_plus is not null and b_plus is not null").withColumnRenamed("a_leader_n", "leader_n")
    return known.mapInArrow(_derive, "a long, b long"), both.filter("a_plus is null or b_plus is null").select("a", "b")


def links_and_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels (node, comp) of nodes with links, nodes (key, node, n)); docs: (key, text)."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(slot_counts(docs))
    distinct = docs.groupBy("key").agg(F.first("text").alias("text"))
    nodes = materialize(distinct.mapInArrow(partial(_prefixes, order), "key binary, n int, prefix binary").withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists = materialize(index_lists(nodes), "lists")
    wanted = materialize(nodes.select("key", "node", "n").join(lists.select("node").distinct(), "node", "left_semi"), "wanted")
    texts = materialize(texts_of(docs, wanted), "texts")
    with small_batches(spark):
        first = materialize(compared(leader_pairs(lists), texts), "answers")
    links = first.filter("linked").select("a", "b")
    labels = components(links)
    answers = first.select(F.col("b").alias("node"), F.col("a").alias("leader"), "shared", F.col("a_n").alias("leader_n"), "plus", "minus")
    cards = wanted.select("node").join(labels, "node", "left").join(answers.select("node", "leader", "shared", "leader_n"), "node", "left")
    cards = materialize(cards.select("node", F.coalesce("comp", "node").alias("comp"), *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("leader", "shared", "leader_n")]), "cards")
    tries = materialize(open_pairs(lists, cards), "tries")
    with small_batches(spark):
        near, rest = derived(tries.filter("way = 1").select("a", "b"), answers.join(wanted.select("node", "n"), "node"))
        links = materialize(links.unionByName(tries.filter("way = 0").select("a", "b")).unionByName(near), "links")
        # of what is to be read, first one pair of each two components, then those that these leave apart
        unread = materialize(tries.filter("way = 2").select("a", "b").unionByName(rest), "unread")
        for one_each in (True, False):
            labels = components(links)
            comp = lambda s: labels.select(F.col("node").alias(s), F.col("comp").alias(f"{s}_comp"))  # noqa: B023, E731
            apart = unread.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select("a", "b", F.coalesce("a_comp", "a").alias("x"), F.coalesce("b_comp", "b").alias("y")).filter("x <> y")
            if one_each:
                apart = apart.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
            more = materialize(compared(materialize(apart.select("a", "b"), "apart"), texts).filter("linked").select("a", "b"), "links")
            links = links.unionByName(more)
    return (labels if more.isEmpty() else components(links)), nodes.select("key", "node", "n")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that a document's links reach, itself included.

    Null text: empty. Texts without words have no shingles and link with nothing, each other
    included. Null doc_id: a row as any, that counts for no component_id; null where all of a
    component are. Repeated rows: a row each, of one component. Very long texts are read whole, one
    at a time. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    with discarding(docs.sparkSession):
        rows = id_and_text(docs, id_col, text_col).withColumn("key", F.unhex(F.md5("text")))
        labels, nodes = links_and_nodes(rows.select("key", "text"))
        known = nodes.join(labels, "node", "left").select("key", "n", F.coalesce("comp", "node").alias("comp"))
        placed = materialize(rows.select("doc_id", "key").join(known, "key").select("doc_id", "n", "comp"), "documents")
        full = placed.filter("n > 0")
        least = materialize(full.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
        out = full.join(least, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        alone = placed.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return materialize(out.unionByName(alone), "components", outer=True)
