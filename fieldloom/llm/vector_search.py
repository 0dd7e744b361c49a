"""Exact top-k search by a vector-approximation file.

Vectors are scaled to integers; equal vectors are one entry of the index, with the smallest ids that
hold it. The approximation file keeps, per entry, BITS bits a component: the number of its cell
among the dimension's cells, whose edges are quantiles, so an outlier stretches the outer cell of
its own dimension only. For a query, an entry's cells bound the inner product from both sides.

Query blocks meet blocks of the approximation file; no exact vector takes part in that scan. A
block passes on the entries that may be among the query's k best in the block. The best of the
blocks' kth lower bounds then rules out most of them. Of the rest, exact vectors are read in the
order of their bounds: first 2 k of a query, then those whose bound reaches the kth score so far.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discarding, materialize

#: Bits of a cell's number: a component is a byte of the approximation file.
BITS = 8
DATA_BLOCK, QUERY_BLOCK = 8192, 8192
#: Queries whose bounds are in memory at once.
CHUNK = 128

BOUNDED = "query_id long, mark long, floor double, reps array<long>, ups array<double>"


def scaled(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x).

    Rows with a null id, and vectors that are null or have null or non-finite components, are left
    out. A finite component beyond 63 bits fails the job, as no score with it fits a long.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * scale)
    finite = F.coalesce(F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = lambda c: F.when(F.abs(c) < 2.0**63, F.floor(c)).otherwise(F.raise_error(F.lit("a scaled component exceeds 63 bits")).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(finite, x).alias("x")).filter("vec_id is not null and x is not null").select("vec_id", F.transform("x", whole).alias("v"))


def _matrix(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    column = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(rows)) * width - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
    out.reshape(-1)[at] = flat
    return out


class Cells:
    """Per dimension the inner edges of its cells, and of each cell the least and greatest whole number in it."""

    def __init__(self, dims: list[tuple[int, int, list[int]]]):
        """dims: least value, greatest value and inner edges of each dimension."""
        self.edges = [np.unique(np.array(e, np.int64)) for _, _, e in dims]
        most = max(map(len, self.edges), default=0) + 1
        low, high = np.zeros((len(dims), most)), np.zeros((len(dims), most))
        for d, ((least, greatest, _), e) in enumerate(zip(dims, self.edges, strict=True)):
            low[d, : len(e) + 1], high[d, : len(e) + 1] = [least, *e], [*(e - 1), greatest]
        self.middle, self.half = (low + high) / 2, (high - low) / 2
        self.reach = np.maximum(np.abs(low), np.abs(high)).max(1, initial=0) if len(dims) else np.zeros(0)

    def of(self, v: np.ndarray) -> np.ndarray:
        """The cell of every component."""
        return np.stack([np.searchsorted(e, v[:, d], side="right") for d, e in enumerate(self.edges)], 1).astype(np.uint8) if self.edges else np.zeros((len(v), 0), np.uint8)

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the inner products of all rows of q with all rows of cells."""
        every = np.arange(len(self.edges))
        base, spread = q @ self.middle[every, cells].T, np.abs(q) @ self.half[every, cells].T
        spread += (np.abs(q) @ self.reach)[:, None] * 2.0**-44 + 1e-6  # rounding of sums of doubles
        return base - spread, base + spread


def _approximate(cells: Cells, batches):
    for batch in batches:
        raw = cells.of(_matrix(batch.column("v"), len(cells.edges)))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("alone"), pa.array([r.tobytes() for r in raw], pa.binary())], names=["rep", "alone", "cells"])


def _scan(k: int, cells: Cells, queries: pa.Table, data: pa.Table) -> pa.Table:
    """Per query of the block, the entries that may be among its k best of this block, with upper bounds, and the kth lower bound (null if there are no more than k entries)."""
    width, n = len(cells.edges), data.num_rows
    reps = data.column("rep").to_numpy()
    alone = data.column("alone").to_numpy(zero_copy_only=False)
    grid = np.frombuffer(b"".join(data.column("cells").to_pylist()), np.uint8).reshape(n, width)
    ids, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), width).astype(np.float64)
    floors, sizes, found, ups = [], [], [np.empty(0, np.int64)], [np.empty(0)]
    for at in range(0, len(q) if n else 0, CHUNK):
        low, up = cells.bounds(q[at : at + CHUNK], grid)
        own = (reps == ids[at : at + CHUNK, None]) & alone  # entries that only the query itself holds
        low[own], up[own] = -np.inf, -np.inf
        many = n - own.sum(1) > k
        floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
        floor = np.where(many, floor, -np.inf)
        rows, columns = np.nonzero((up >= floor[:, None]) & (up > -np.inf))
        floors += [f if m else None for f, m in zip(floor.tolist(), many.tolist(), strict=True)]
        sizes.append(np.bincount(rows, minlength=len(low)))
        found.append(reps[columns])
        ups.append(up[rows, columns])
    if not n:
        floors, sizes = [None] * len(q), [np.zeros(len(q), np.int64)]
    ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (found, ups)]
    return pa.table({"query_id": queries.column("vec_id"), "mark": queries.column("mark"), "floor": pa.array(floors, pa.float64()), "reps": lists[0], "ups": lists[1]})


def _product(a: str, b: str) -> Column:
    """Exact inner product of whole numbers, missing ones zero: by longs where they surely suffice, else by decimals. A result beyond 63 bits is an error."""
    size = lambda c: F.coalesce(F.array_max(F.transform(c, lambda v: F.abs(v.cast("double")))), F.lit(0.0))
    safe = size(a) * size(b) * F.least(F.size(a), F.size(b)) < 2.0**62

    def total(kind: str) -> Column:
        zero = F.lit(0).cast(kind)
        each = F.zip_with(F.col(a), F.col(b), lambda x, y: (F.coalesce(x, F.lit(0)).cast("decimal(19,0)" if kind != "long" else "long") * F.coalesce(y, F.lit(0)).cast("decimal(19,0)" if kind != "long" else "long")).cast(kind))
        return F.aggregate(each, zero, lambda s, x: (s + x).cast(kind)).cast("long")

    return F.when(safe, total("long")).otherwise(total("decimal(38,0)"))


def build_index(vectors: DataFrame, k: int) -> DataFrame:
    """(rep, v, ids): an entry per distinct vector; rep is its smallest id, ids its k + 1 smallest ids with the number of rows of each (k at most): no query needs more."""
    rows = vectors.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("i") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids")).select(F.col("ids")[0]["vec_id"].alias("rep"), "v", "ids")


def cells_of(index: DataFrame, bits: int = BITS) -> Cells:
    """Quantile edges of every dimension; a row per dimension comes to the driver."""
    shares = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    each = index.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", shares, 16 << bits).alias("edges"), F.count("*").alias("n"))
    total = index.count()
    # a vector that ends before a dimension has zero there
    dims = [(r.least, r.most, r.edges) if r.n == total else (min(r.least, 0), max(r.most, 0), r.edges) for r in sorted(each.collect(), key=lambda r: r.d)]
    return Cells(dims)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all vectors but those with its own id; ties to smaller ids.

    vectors, queries: (vec_id, v) as scaled() makes them. Vectors of other lengths count as filled
    with zeros. Repeated rows: a candidate each. Queries that repeat id and vector are one query; an
    id with several vectors is a query for each, ranked on its own. A query without candidates gives no rows. Empty
    tables: no rows. A score beyond 63 bits fails the job.
    """
    with discarding(vectors.sparkSession):
        return materialize(_top_k(vectors, queries, k, bits), "best", outer=True)


def _top_k(vectors: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    index = materialize(build_index(vectors, k), "index")
    asked = materialize(queries.select("vec_id", "v").distinct().withColumn("mark", F.xxhash64("v")), "queries")
    cells = cells_of(index, bits)
    rows = index.select("rep", "v", (F.size("ids") == 1).alias("alone"))
    approximation = materialize(rows.mapInArrow(partial(_approximate, cells), "rep long, alone boolean, cells binary"), "approximation")
    n_data, n_query = max(1, -(-index.count() // DATA_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # the query set meets the approximation file in blocks: each side is repeated once per block of the other
    left = asked.select(deal("vec_id", n_query).alias("q"), every(n_data).alias("d"), "vec_id", "mark", "v").groupBy("q", "d")
    right = approximation.select(every(n_query).alias("q"), deal("rep", n_data).alias("d"), "rep", "alone", "cells").groupBy("q", "d")
    bounded = materialize(left.cogroup(right).applyInArrow(partial(_scan, k, cells), BOUNDED), "bounds")
    query = ["query_id", "mark"]
    floors = bounded.groupBy(*query).agg(F.max("floor").alias("floor"))
    able = bounded.drop("floor").join(floors, query).select(*query, F.explode(F.filter(F.arrays_zip("reps", "ups"), lambda x: F.col("floor").isNull() | (x["ups"] >= F.col("floor")))).alias("x"))
    able = materialize(able.select(*query, F.col("x.reps").alias("rep"), F.col("x.ups").alias("up")), "able")
    asked = asked.select(F.col("vec_id").alias("query_id"), "mark", F.col("v").alias("q"))

    def read(pairs: DataFrame) -> DataFrame:
        exact = pairs.select(*query, "rep").join(index, "rep").join(asked, query)
        others = F.filter("ids", lambda x: x["vec_id"] != F.col("query_id"))
        return exact.select(*query, "rep", others.alias("ids"), _product("q", "v").alias("score"))

    own = Window.partitionBy(*query)
    first = able.withColumn("i", F.row_number().over(own.orderBy(F.col("up").desc(), "rep"))).filter(F.col("i") <= 2 * k)
    first = materialize(read(first), "first-reads")
    sure = first.groupBy(*query).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(*query, F.get("s", F.lit(k - 1)).alias("kth"))  # 2 k numbers a query at most
    rest = able.join(sure, query, "left").filter(F.col("kth").isNull() | (F.col("up") >= F.col("kth"))).join(first.select(*query, "rep"), [*query, "rep"], "left_anti")
    scores = first.unionByName(materialize(read(rest), "later-reads"))
    best = scores.withColumn("i", F.row_number().over(own.orderBy(F.col("score").desc(), F.col("ids")[0]["vec_id"]))).filter(F.col("i") <= k)
    ids = best.select(*query, "score", F.explode("ids").alias("x")).select(*query, "score", F.explode(F.array_repeat(F.col("x.vec_id"), F.col("x.n"))).alias("vec_id"))
    ranked = ids.withColumn("rank", F.row_number().over(own.orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
