"""Standardising crops, roughness, and tensor scaling by channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import roughness_bin
from ..functions.numeric import bound, fp16

EPSILON = 1e-6


def statistics(cells: DataFrame) -> DataFrame:
    """Per state: n, mean, population std, scale, is_constant (of raw values)."""
    return cells.groupBy("state_ref").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), (F.stddev_pop("x") + EPSILON).alias("scale"), (F.min("x") == F.max("x")).alias("is_constant")
    )


def standardize(cells: DataFrame) -> DataFrame:
    """cells with z: half-precision z-scores per state; constant states become zero. One shuffle, by state."""
    own = Window.partitionBy("state_ref")
    centred = (F.col("x") - F.avg("x").over(own)) / (F.stddev_pop("x").over(own) + EPSILON)
    constant = F.min("x").over(own) == F.max("x").over(own)
    return cells.withColumn("z", F.when(constant, 0.0).otherwise(fp16(centred))).drop("x")


def roughness(cells: DataFrame, value: str = "z") -> DataFrame:
    """Per state: root mean square of first-neighbour differences along both axes, 0 for constant states, and its bin."""
    v = F.col(value)
    right = v - F.lag(value).over(Window.partitionBy("state_ref", "r").orderBy("c"))
    down = v - F.lag(value).over(Window.partitionBy("state_ref", "c").orderBy("r"))
    both = cells.select("state_ref", v.alias("v"), right.alias("right"), down.alias("down")).select("state_ref", "v", F.explode(F.array("right", "down")).alias("d"))
    per = both.groupBy("state_ref").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), (F.min("v") == F.max("v")).alias("is_constant"))
    rms = F.when(F.col("is_constant"), 0.0).otherwise(F.coalesce("rms", F.lit(0.0)))
    return per.select("state_ref", rms.alias("roughness"), roughness_bin(F.col("is_constant"), rms).alias("roughness_bin"))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def packed_roughness(grids: DataFrame) -> DataFrame:
    """grids (h, w, z row-major) with roughness and roughness_bin, as roughness() has them, each grid by itself."""
    places, w, n = F.sequence(F.lit(0), F.size("z") - 1), F.col("w"), F.size("z")
    square = lambda i, j: (F.get("z", j) - F.get("z", i)) * (F.get("z", j) - F.get("z", i))
    edges = (w - 1) * F.col("h") + w * (F.col("h") - 1)
    sums = _total(F.transform(places, lambda i: F.when(i % w < w - 1, square(i, i + 1)).otherwise(0.0) + F.when(i + w < n, square(i, i + w)).otherwise(0.0)))
    flat = F.array_min("z") == F.array_max("z")
    rough = grids.withColumn("roughness", F.when(flat | (edges == 0), 0.0).otherwise(F.sqrt(sums / edges)))
    return rough.withColumn("roughness_bin", roughness_bin(flat, F.col("roughness")))


def standardize_grids(grids: DataFrame, value: str = "x") -> DataFrame:
    """(state_ref, h, w, z, mean, std, is_constant, roughness, roughness_bin) of grids (state_ref, h, w, x row-major): as standardize and roughness, each grid by itself in its own order, without a shuffle."""
    x, n = F.col(value), F.size(value)
    flat = F.array_min(x) == F.array_max(x)
    # bound, so that neither mean nor deviation is worked out again for every cell
    of = lambda m, s: F.struct(m.alias("mean"), s.alias("std"), F.transform(x, lambda v: F.when(flat, 0.0).otherwise(fp16((v - m) / (s + EPSILON)))).alias("z"))
    deviation = lambda m: F.sqrt(_total(F.transform(x, lambda v: (v - m) * (v - m))) / n)
    done = grids.select("state_ref", "h", "w", flat.alias("is_constant"), bound(_total(x) / n, lambda m: bound(deviation(m), lambda s: of(m, s))).alias("s"))
    return packed_roughness(done.select("state_ref", "h", "w", "s.*", "is_constant")).select("state_ref", "h", "w", "z", "mean", "std", "is_constant", "roughness", "roughness_bin")


def scale_channels(values: DataFrame, mode: str, keys: list[str], clip: float | None = None) -> DataFrame:
    """values (keys..., v) with y: none, minmax or zscore over each group of keys, optionally clipped to +-clip; a and b hold y = (v - a) / b."""
    if mode == "minmax":
        a, b = F.min("v"), F.max("v") - F.min("v") + EPSILON
    elif mode == "zscore":
        a, b = F.avg("v"), F.stddev_pop("v") + EPSILON
    elif mode == "none":
        a, b = F.min(F.lit(0.0)), F.min(F.lit(1.0))
    else:
        raise ValueError(f"unknown mode {mode}")
    if keys:
        out = values.join(values.groupBy(*keys).agg(a.alias("a"), b.alias("b")), keys)
    else:
        one = values.agg(a.alias("a"), b.alias("b")).first()  # two numbers
        out = values.withColumn("a", F.lit(one.a)).withColumn("b", F.lit(one.b))
    out = out.withColumn("y", (F.col("v") - F.col("a")) / F.col("b"))
    return out if clip is None else out.withColumn("y", F.greatest(F.lit(-clip), F.least(F.lit(clip), "y")))


def restore_channels(scaled: DataFrame) -> DataFrame:
    return scaled.withColumn("v", F.col("y") * F.col("b") + F.col("a"))
