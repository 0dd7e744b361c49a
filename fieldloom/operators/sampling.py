"""Splits, plans, budgets and reproducible selections; every order is a hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import bound, draw, gcd, order_key, uniform


def ranked(rows: DataFrame, order: str, out: str = "rank") -> DataFrame:
    """rows with their place (from 0) in the order of a column that has no equal values; many tasks, as running_offsets."""
    from .batching import running_offsets

    return running_offsets(rows.withColumn("one_", F.lit(1)), order, "one_", out).drop("one_")


def trajectory_splits(trajectories: DataFrame, seed: int = 1, key: str = "trajectory") -> DataFrame:
    """(key, split): 80/10/10 by rank in hash order, with exact cuts at floor(.8 n) and floor(.9 n)."""
    rows = trajectories.select(key).distinct()
    n = rows.count()
    order = ranked(rows.withColumn("order_", order_key(seed, F.col(key).cast("string"))), "order_")
    return order.select(key, F.when(F.col("rank") < n * 8 // 10, "train").when(F.col("rank") < n * 9 // 10, "val").otherwise("test").alias("split"))


def shape_pools(spark: SparkSession, heights: tuple[int, int], widths: tuple[int, int], fraction: float = 0.2, seed: int = 1) -> DataFrame:
    """(h, w, pool, anchor): all integer shapes; floor(fraction * all) are held out, never the four corners."""
    shapes = spark.range(heights[0], heights[1] + 1).select(F.col("id").cast("int").alias("h"), F.explode(F.sequence(F.lit(widths[0]), F.lit(widths[1]))).alias("w"))
    corner = F.col("h").isin(*heights) & F.col("w").isin(*widths)
    count = int((heights[1] - heights[0] + 1) * (widths[1] - widths[0] + 1) * fraction)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(order_key(seed, F.col("h").cast("string"), F.col("w").cast("string"))))
    return shapes.withColumn("anchor", corner).withColumn("pool", F.when(~F.col("anchor") & (rank <= count), "heldout").otherwise("train"))


def allocation(groups: DataFrame, total: int, family: str, source: str) -> DataFrame:
    """(family, source, quota): total split over families, then each family's share over its sources, with a difference of one at most, the first by name larger. groups: (family, source), a row for each."""
    split = lambda whole, i, k: F.floor(whole / k).cast("long") + (i < whole % k).cast("long")
    families = groups.select(family).distinct()
    k = families.count()
    shares = ranked(families, family, "i").select(family, split(F.lit(total), F.col("i"), F.lit(k)).alias("share"))
    own = Window.partitionBy(family)
    within = groups.withColumn("j", F.row_number().over(own.orderBy(source)) - 1).withColumn("k", F.count("*").over(own))
    return within.join(shares, family).select(family, source, split(F.col("share"), F.col("j"), F.col("k")).alias("quota"))


def plan(spark: SparkSession, pools: DataFrame, fields: list[str], count: int, seed: int = 1, evaluation: bool = False) -> DataFrame:
    """(i, h, w, field, part): every corner shape with every field first, then drawn shapes with the fields in turn; an evaluation plan alternates held-out and seen shapes."""
    corners = pools.filter("anchor").select("h", "w", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field")).withColumn("part", F.lit("boundary"))
    n_corners = pools.filter("anchor").count() * len(fields)
    if count < n_corners:
        raise ValueError("the plan is too small for every corner and field")
    order = Window.orderBy("h", "w", "field")
    first = corners.withColumn("i", F.row_number().over(order) - 1)
    numbered = pools.withColumn("j", F.row_number().over(Window.partitionBy("pool").orderBy("h", "w")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("pool")))
    sizes = {r.pool: r.n for r in pools.groupBy("pool").agg(F.count("*").alias("n")).collect()}  # two rows
    k = F.col("id") - F.lit(n_corners)
    pool = F.when((k % 2 == 0) & F.lit(evaluation), "heldout").otherwise("train")
    rest = spark.range(n_corners, count).withColumn("pool", pool).withColumn("j", draw(F.when(F.col("pool") == "heldout", sizes.get("heldout", 1)).otherwise(sizes.get("train", 1)), seed, F.col("id")))
    field = F.element_at(F.array(*[F.lit(f) for f in fields]), (k % len(fields) + 1).cast("int"))
    drawn = rest.withColumn("field", field).join(numbered.select("pool", "j", "h", "w"), ["pool", "j"]).select(F.col("id").cast("int").alias("i"), "h", "w", "field", F.col("pool").alias("part"))
    return first.select("i", "h", "w", "field", "part").unionByName(drawn)


def cycled(members: DataFrame, group: str, key: str, draws: int, seed: int = 1) -> DataFrame:
    """(group, i, key, cycle): `draws` picks per group that cover all members before any repeats; each cycle has its own order."""
    n = F.count("*").over(Window.partitionBy(group))
    counted = members.select(group, key).distinct().withColumn("n", n)
    cycles = counted.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.floor((F.lit(draws) - 1) / F.col("n")).cast("int"))))
    place = F.row_number().over(Window.partitionBy(group, "cycle").orderBy(order_key(seed, F.col("cycle"), F.col(key)))) - 1
    return cycles.withColumn("i", (F.col("cycle") * F.col("n") + place).cast("int")).filter(F.col("i") < draws).select(group, "i", key, "cycle")


def coprime_times(visits: DataFrame, steps: Column | int, seed: int = 1) -> DataFrame:
    """visits (key, visit) with time: an offset plus visit times a stride that shares no divisor with steps, so that every time comes before any repeats."""
    n = steps if isinstance(steps, Column) else F.lit(steps)
    strides = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda s: gcd(s, n) == 1)
    drawn = visits.withColumn("strides_", strides)
    stride = F.element_at("strides_", draw(F.size("strides_"), seed, "stride", F.col("key")) + 1)
    return drawn.withColumn("time", ((draw(n, seed, "offset", F.col("key")) + F.col("visit") * stride) % n).cast("int")).drop("strides_")


def weighted_order(items: DataFrame, group: str, key: str, weight: str, k: int, seed: int = 1) -> DataFrame:
    """The k items of each group with the least -log(u) / weight: a weighted draw without replacement, u a hash of group and key."""
    u = (draw(1_000_003, seed, F.col(group), F.col(key)) + 0.5) / 1_000_003.0
    ranked = items.withColumn("race", -F.log(u) / F.col(weight)).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("race", key)))
    return ranked.filter(F.col("rank") <= k).drop("race")


def sequential_draw(items: Column, weights: dict[str, float], k: int, *key) -> Column:
    """Up to k of an array of struct(task, kind), one after the other without replacement: each draw gives a kind its weight, shared equally by the kind's items that are still there.

    So the odds change after every draw, other than in weighted_order, where each item keeps its weight. An unknown kind weighs 1.
    """
    weight = F.lit(1.0)
    of = lambda kind: F.coalesce(*[F.when(kind == name, F.lit(float(w))) for name, w in weights.items()], weight) if weights else weight
    kind = items.getItem(0).getField("task")  # only for its type
    start = F.struct(items.alias("rest"), F.array_compact(F.array(F.when(F.lit(False), kind))).alias("done"))

    def step(s: Column, i: Column) -> Column:
        rest = s["rest"]
        shares = F.transform(rest, lambda x: of(x["kind"]) / F.size(F.filter(rest, lambda y: y["kind"] == x["kind"])))

        def pick(v: Column) -> Column:
            aim = uniform(*key, i) * F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
            zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
            passed = F.aggregate(v, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["at"] + F.when(a["sum"] + x <= aim, 1).otherwise(0)).alias("at")), lambda a: a["at"])
            return F.least(passed, F.size(v) - 1)

        at = bound(shares, pick)
        moved = bound(at, lambda j: F.struct(F.filter(rest, lambda _, q: q != j).alias("rest"), F.concat(s["done"], F.array(F.get(rest, j)["task"])).alias("done")))
        return F.when(F.size(rest) > 0, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda s: s["done"])


def shortfall(groups: DataFrame, selected: DataFrame, wanted: int, part: str, key: str) -> DataFrame:
    """Per part: groups, items wanted and selected, and how many are missing because a group allows fewer. groups: (key, part), a row each; selected: a row per item."""
    n = selected.groupBy(key).agg(F.count("*").alias("n"))
    per = groups.select(key, part).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.groupBy(part).agg(F.count("*").alias("groups"), (F.count("*") * wanted).alias("wanted"), F.sum("n").alias("selected"), F.sum(F.greatest(F.lit(wanted) - F.col("n"), F.lit(0))).alias("missing"))


def round_robin(rows: DataFrame, bins: str, groups: list[str], per_bin: int, seed: int = 1, size: str = "cells") -> DataFrame:
    """Per bin, rows in turn from every group in hash order, up to per_bin; the last one gives way to the bin's largest row if that would be missed."""
    h = order_key(seed, F.col("qa_id"))
    turn = F.row_number().over(Window.partitionBy(bins, *groups).orderBy(h))
    dealt = rows.withColumn("turn", turn).withColumn("queue", order_key(seed, F.col(bins), *[F.col(g) for g in groups]))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(bins).orderBy("turn", "queue"))).withColumn("largest", F.max(size).over(Window.partitionBy(bins)))
    chosen = ranked.filter(F.col("rank") <= per_bin)
    top = chosen.groupBy(bins).agg(F.max(size).alias("had"), F.max("rank").alias("rank"))
    missing = ranked.join(top.select(bins, "had", F.col("rank").alias("last")), bins).filter((F.col("had") < F.col("largest")) & (F.col(size) == F.col("largest")))
    stand_in = missing.withColumn("pick", F.row_number().over(Window.partitionBy(bins).orderBy(h))).filter("pick = 1")
    out = chosen.join(stand_in.select(bins, F.col("last").alias("rank")), [bins, "rank"], "left_anti").select(*rows.columns, "rank")
    return out.unionByName(stand_in.select(*rows.columns, F.col("last").alias("rank")))


def quota(candidates: DataFrame, group: str, key: str, budget: int, seed: int = 1) -> DataFrame:
    """`budget` distinct candidates per group in hash order; a group with fewer fails the job."""
    order = Window.partitionBy(group).orderBy(order_key(seed, F.col(key)))
    ranked = candidates.dropDuplicates([group, key]).withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(group)))
    short = F.when(F.col("n") < budget, F.raise_error(F.lit("too few distinct candidates")).cast("int")).otherwise(F.col("i"))
    return ranked.withColumn("i", short).filter(F.col("i") <= budget).drop("n")


def balanced_parts(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """rows with part: contiguous pieces in order whose sizes differ by one at most, larger ones first; order has no equal values."""
    n = rows.count()
    size, larger = n // parts, n % parts
    cut = larger * (size + 1)
    part = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (size + 1))).otherwise(larger + F.floor((F.col("rank") - cut) / max(1, size)))
    return ranked(rows, order).withColumn("part", part.cast("int")).drop("rank")
