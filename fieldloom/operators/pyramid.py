"""Region statistics and extrema of large grids from a pyramid of tile summaries.

Level 1 summarises tiles of side x side cells, each next level FACTOR x FACTOR of the level below:
count, total, sum of squared deviations, least and greatest value. A region is cut into the largest
blocks that lie whole inside it, level by level, and a rim of cells; so it reads one row per block
and the cells of the tiles along its perimeter only, however many cells it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tiles import row_pieces, tiles_within

SIDE, FACTOR = 16, 8


def tiles_of_grids(grids: DataFrame, side: int = SIDE, value: str = "z") -> DataFrame:
    """(state_ref, height, width, tr, tc, values) of grids (state_ref, h, w, z row-major), zero-based tile places."""
    named = grids.select("state_ref", F.col("h").alias("height"), F.col("w").alias("width"), F.col(value).alias("grid"))
    return named.select("state_ref", "height", "width", F.explode(tiles_within("grid", "height", "width", side)).alias("t")).select("state_ref", "height", "width", "t.*")


def _summary(values: Column) -> list[Column]:
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    m2 = F.get(F.transform(F.array(mean), lambda m: F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))), F.lit(0))
    return [F.size(values).cast("long").alias("n"), total.alias("total"), m2.alias("m2"), F.array_min(values).alias("low"), F.array_max(values).alias("high")]


def _combined() -> list[Column]:
    """Of blocks (n, total, m2, low, high) the same of their union; deviations by the shift of means."""
    n, total = F.sum("n"), F.sum("total")
    m2 = F.sum("m2") + F.sum(F.col("total") * F.col("total") / F.col("n")) - total * total / n
    return [n.alias("n"), total.alias("total"), F.greatest(m2, F.lit(0.0)).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high")]


def pyramid(tiles: DataFrame, levels: int = 3, factor: int = FACTOR) -> DataFrame:
    """(state_ref, level, tr, tc, n, total, m2, low, high) of all levels; each is a small fraction of the one below."""
    level = tiles.select("state_ref", F.lit(1).alias("level"), "tr", "tc", *_summary(F.col("values")))
    out = level
    for k in range(2, levels + 1):
        up = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
        level = level.select("state_ref", up("tr"), up("tc"), "n", "total", "m2", "low", "high").groupBy("state_ref", "tr", "tc").agg(*_combined()).select("state_ref", F.lit(k).alias("level"), "tr", "tc", "n", "total", "m2", "low", "high")
        out = out.unionByName(level)
    return out


def _whole(regions: DataFrame, level: int, side: int, factor: int) -> Column:
    """struct(a, b, c, d): block rows a to b and columns c to d of a level that lie whole inside the region; empty if b < a or d < c. A block that the grid's edge cuts is whole up to there."""
    size = side * factor ** (level - 1)
    last = lambda end, grid: F.when(F.col(end) == F.col(grid), F.ceil(F.col(grid) / size)).otherwise(F.floor(F.col(end) / size)).cast("int") - 1
    first = lambda start: F.ceil((F.col(start) - 1) / size).cast("int")
    return F.struct(first("r1").alias("a"), last("r2", "height").alias("b"), first("c1").alias("c"), last("c2", "width").alias("d"))


def _ring(outer: Column, inner: Column) -> Column:
    """array<struct<tr,tc0,tc1>>: rows of the outer rectangle without the inner one, which lies in it or is empty."""
    seq = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    some = (inner["b"] >= inner["a"]) & (inner["d"] >= inner["c"])
    part = lambda r, a, b: F.struct(r.alias("tr"), a.alias("tc0"), b.alias("tc1"))

    def row(r: Column) -> Column:
        split = some & r.between(inner["a"], inner["b"])
        return F.when(split, F.array(part(r, outer["c"], inner["c"] - 1), part(r, inner["d"] + 1, outer["d"]))).otherwise(F.array(part(r, outer["c"], outer["d"])))

    return F.filter(F.flatten(F.transform(seq(outer["a"], outer["b"]), row)), lambda x: x["tc1"] >= x["tc0"])


def region_blocks(regions: DataFrame, levels: int = 3, side: int = SIDE, factor: int = FACTOR) -> DataFrame:
    """(region, state_ref, level, tr, tc): the blocks of a region at each level, and at level 0 the tiles that hold its rim.

    regions: (region, state_ref, height, width, r1, r2, c1, c2), one-based, ends included.
    """
    touched = F.struct(*[F.floor((F.col(c) - 1) / side).cast("int").alias(n) for c, n in (("r1", "a"), ("r2", "b"), ("c1", "c"), ("c2", "d"))])
    named = regions.select("*", touched.alias("w0"), *[_whole(regions, k, side, factor).alias(f"w{k}") for k in range(1, levels + 1)])
    out = None
    for k in range(levels + 1):
        outer = F.col(f"w{k}")
        if k == levels:
            inner = F.struct(F.lit(0).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("c"), F.lit(-1).alias("d"))
        elif k == 0:
            inner = F.col("w1")
        else:
            up = F.col(f"w{k + 1}")
            end = lambda last, own: F.least((last + 1) * factor - 1, own)
            inner = F.struct((up["a"] * factor).alias("a"), F.when(up["b"] >= up["a"], end(up["b"], outer["b"])).otherwise(-1).alias("b"), (up["c"] * factor).alias("c"), F.when(up["d"] >= up["c"], end(up["d"], outer["d"])).otherwise(-1).alias("d"))
        rows = named.select("region", "state_ref", F.explode(_ring(outer, inner)).alias("x"))
        level = rows.select("region", "state_ref", F.lit(k).alias("level"), "x.tr", F.explode(F.sequence("x.tc0", "x.tc1")).alias("tc"))
        out = level if out is None else out.unionByName(level)
    return out


def _rim(regions: DataFrame, blocks: DataFrame, tiles: DataFrame, side: int) -> DataFrame:
    """(region, pieces): row parts (r, c, v), zero-based, of the region's cells in its level-0 tiles."""
    asked = blocks.filter("level = 0").drop("level").join(regions.select("region", "r1", "r2", "c1", "c2"), "region")
    frame = asked.join(tiles, ["state_ref", "tr", "tc"]).withColumn("top", F.col("r1") - 1).withColumn("left", F.col("c1") - 1).withColumn("h", F.col("r2") - F.col("r1") + 1).withColumn("w", F.col("c2") - F.col("c1") + 1)
    return frame.select("region", "state_ref", row_pieces(side).alias("pieces"))


def region_statistics(regions: DataFrame, tiles: DataFrame, levels_of: DataFrame, levels: int = 3, side: int = SIDE, factor: int = FACTOR) -> DataFrame:
    """(region, n, mean, std, low, high, rows_read): rows_read counts the summaries and the cells that the answer was made from.

    tiles: tiles_of_grids; levels_of: their pyramid of as many levels. A region has to lie in its grid.
    """
    blocks = region_blocks(regions, levels, side, factor)
    whole = blocks.filter("level > 0").join(levels_of, ["state_ref", "level", "tr", "tc"]).select("region", F.lit(1).cast("long").alias("read"), "n", "total", "m2", "low", "high")
    values = F.flatten(F.transform("pieces", lambda p: p["v"]))
    rim = _rim(regions, blocks, tiles, side).select("region", values.alias("values")).select("region", *_summary(F.col("values")))
    both = whole.unionByName(rim.withColumn("read", F.col("n")))
    out = both.groupBy("region").agg(*_combined(), F.sum("read").alias("rows_read"))
    return out.select("region", "n", (F.col("total") / F.col("n")).alias("mean"), F.sqrt(F.col("m2") / F.col("n")).alias("std"), "low", "high", "rows_read")


def region_extrema(regions: DataFrame, statistics: DataFrame, tiles: DataFrame, levels_of: DataFrame, op: str, levels: int = 3, side: int = SIDE, factor: int = FACTOR) -> DataFrame:
    """(region, r, c0, c1): the row runs of all cells that reach the region's least (argmin) or greatest (argmax) value, one-based.

    Only tiles whose own extremum is the region's are read, and the rim.
    """
    if op not in ("argmin", "argmax"):
        raise ValueError(f"unknown operator {op}")
    key = "low" if op == "argmin" else "high"
    named = regions.join(statistics.select("region", F.col(key).alias("best")), "region")
    blocks = region_blocks(regions, levels, side, factor)
    # whole blocks of any level stand for the tiles below them that have the value
    inner = named.withColumn("x", _whole(named, 1, side, factor))
    bottom = levels_of.filter("level = 1").select("state_ref", "tr", "tc", F.col(key).alias("best"))
    inside = F.col("tr").between(F.col("x.a"), F.col("x.b")) & F.col("tc").between(F.col("x.c"), F.col("x.d"))
    full = inner.join(bottom, ["state_ref", "best"]).filter(inside).select("region", "state_ref", "tr", "tc", F.lit(0).alias("level"))
    asked = blocks.filter("level = 0").select("region", "state_ref", "tr", "tc", "level").unionByName(full)
    pieces = _rim(regions, asked, tiles, side).join(named.select("region", "best"), "region")
    row = pieces.select("region", "best", F.explode("pieces").alias("p")).select("region", "best", (F.col("p.r") + 1).alias("r"), (F.col("p.c") + 1).alias("c"), F.posexplode("p.v").alias("i", "v"))
    tied = row.filter(F.col("v") == F.col("best")).select("region", "r", (F.col("c") + F.col("i")).alias("c"))
    group = F.col("c") - F.row_number().over(Window.partitionBy("region", "r").orderBy("c"))
    return tied.withColumn("g", group).groupBy("region", "r", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("g")
