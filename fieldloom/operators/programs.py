"""Query programs over grids: sampling, geometry, validation, execution, ties and records.

A program row holds one or two leaves in flat columns. A leaf's selector is `spans`, an array of
struct(pos, r1, r2, c1, c2): one span per listed cell of points and lines, one for a whole region.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels as L
from ..functions.numeric import bound, draw, exact_round, permuted

SPANS = "array<struct<pos:int,r1:int,r2:int,c1:int,c2:int>>"
#: Operator of each task's leaves, limits of sampled selectors, and answer precision.
OPS = {**dict.fromkeys(L.READ_TASKS, "read"), "region_mean": "mean", "region_std": "std", "region_min": "min", "region_max": "max", "region_argmin": "argmin", "region_argmax": "argmax",
       "nearest_value_location": "nearest", "point_difference": "read", "region_mean_difference": "mean", "threshold_fraction": "fraction_gt"}
LIMITS = {"read": 32, "line": 32, "region_values": 32, "statistic": 4096}
#: Fixed value: how often a second region is drawn before a single cell stands for it.
REDRAWS = 32
DECIMALS, TOLERANCE, FRACTION_DECIMALS, FRACTION_TOLERANCE = 1, 0.2, 3, 0.02


# ---------------------------------------------------------------- selectors


def region_spans(r: Column, c: Column, h: Column, w: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("pos"), r.alias("r1"), (r + h - 1).alias("r2"), c.alias("c1"), (c + w - 1).alias("c2")))


def point_spans(points: Column) -> Column:
    """Of an array of struct(r, c), in order."""
    return F.transform(points, lambda p, i: F.struct(i.alias("pos"), p["r"].alias("r1"), p["r"].alias("r2"), p["c"].alias("c1"), p["c"].alias("c2")))


def line_spans(r: Column, c: Column, dr: Column, dc: Column, count: Column) -> Column:
    """From (r, c), `count` cells by signed steps, in that order."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("pos"), (r + i * dr).alias("r1"), (r + i * dr).alias("r2"), (c + i * dc).alias("c1"), (c + i * dc).alias("c2")))


def bounds(spans: Column) -> Column:
    """struct(n, r1, r2, c1, c2): number of cells and bounding box, without listing a region's cells."""
    total = F.aggregate(spans, F.lit(0), lambda s, x: s + (x["r2"] - x["r1"] + 1) * (x["c2"] - x["c1"] + 1))
    low = lambda k: F.array_min(F.transform(spans, lambda x: x[k]))
    high = lambda k: F.array_max(F.transform(spans, lambda x: x[k]))
    return F.struct(total.alias("n"), low("r1").alias("r1"), high("r2").alias("r2"), low("c1").alias("c1"), high("c2").alias("c2"))


# ---------------------------------------------------------------- sampling


def fitting_tasks(h: Column, w: Column) -> Column:
    """Tasks that a grid of this shape allows."""
    cells = h * w
    fits = {t: F.lit(True) for t in L.TASKS}
    for t in ("multi_point", "point_difference", "region_mean", "region_std", "region_mean_difference"):
        fits[t] = cells >= 2
    fits["line_profile"] = F.greatest(h, w) >= 2
    return F.filter(F.array(*[F.when(f, F.lit(t)) for t, f in fits.items()]), lambda t: t.isNotNull())


def drawn_region(h: Column, w: Column, most: Column | int, proper: bool, *key) -> Column:
    """struct(r, c, h, w): a height, then a width within the cap, then a corner; proper leaves out the whole grid. Needs two cells if proper."""
    most = most if isinstance(most, Column) else F.lit(most)
    heights = F.least(h, most)
    if proper:
        heights = F.when((w == 1) & (heights == h), heights - 1).otherwise(heights)
    rh = 1 + draw(heights, "height", *key)
    widths = F.least(w, F.floor(most / rh).cast("int"))
    if proper:
        widths = F.when(rh == h, F.least(widths, w - 1)).otherwise(widths)
    rw = 1 + draw(widths, "width", *key)
    return F.struct((1 + draw(h - rh + 1, "row", *key)).alias("r"), (1 + draw(w - rw + 1, "column", *key)).alias("c"), rh.alias("h"), rw.alias("w"))


def sample_programs(states: DataFrame, seed: int = 1, tasks: tuple[str, ...] = L.TASKS) -> DataFrame:
    """One program per state (state_ref, h, w) and task that fits: (state_ref, h, w, task, op, left, right, target_cell).

    All draws are hashes of (seed, state, task), so programs don't depend on other states or tasks.
    target_cell is the cell whose displayed value becomes the target; region tasks without one have null.
    """
    every = states.select("state_ref", "h", "w", F.explode(fitting_tasks(F.col("h"), F.col("w"))).alias("task")).filter(F.col("task").isin(*tasks))
    h, w, task, key = F.col("h"), F.col("w"), F.col("task"), (F.lit(seed), F.col("state_ref"), F.col("task"))
    cells = h * w
    a = draw(cells, "a", *key)
    b = (a + 1 + draw(F.greatest(cells - 1, F.lit(1)), "b", *key)) % cells
    count = F.least(cells, F.lit(LIMITS["read"]), 2 + draw(F.lit(6), "count", *key))
    cell = lambda i: F.struct((F.floor(i / w) + 1).cast("int").alias("r"), (i % w + 1).cast("int").alias("c"))
    # distinct cells, uniform without replacement: the first of a random order of all cells
    walk = F.transform(F.sequence(F.lit(0), count - 1), lambda i: cell(permuted(i, cells, *key, "points")))
    vertical = ((h >= 2) & (draw(2, "axis", *key) == 0)) | (w < 2)
    extent = F.when(vertical, h).otherwise(w)
    length = 2 + draw(F.greatest(F.least(extent, F.lit(LIMITS["line"])) - 1, F.lit(1)), "length", *key)
    stride = 1 + draw(F.greatest(F.floor((extent - 1) / (length - 1)).cast("int"), F.lit(1)), "stride", *key)
    back = draw(2, "back", *key) == 1
    span = (length - 1) * stride
    begin = 1 + draw(F.greatest(extent - span, F.lit(1)), "begin", *key) + F.when(back, span).otherwise(0)
    step = F.when(back, -stride).otherwise(stride)
    line = line_spans(
        F.when(vertical, begin).otherwise(1 + draw(h, "r", *key)), F.when(vertical, 1 + draw(w, "c", *key)).otherwise(begin),
        F.when(vertical, step).otherwise(0), F.when(vertical, 0).otherwise(step), length,
    )
    spans_of = lambda s: region_spans(s["r"], s["c"], s["h"], s["w"])
    proper = task.isin("region_mean", "region_std", "region_mean_difference")
    region = F.when(proper, drawn_region(h, w, LIMITS["statistic"], True, "left", *key)).when(task == "region_values", drawn_region(h, w, LIMITS["region_values"], False, "left", *key)).otherwise(drawn_region(h, w, LIMITS["statistic"], False, "left", *key))
    drawn = every.withColumn("region", region)
    region = F.col("region")
    again = lambda o, i: F.when(o.isNull() | (o == region), drawn_region(h, w, LIMITS["statistic"], True, "right", i, *key)).otherwise(o)
    other = F.aggregate(F.sequence(F.lit(1), F.lit(REDRAWS)), F.lit(None).cast("struct<r:int,c:int,h:int,w:int>"), again)
    drawn = drawn.withColumn("other", F.when(task == "region_mean_difference", other))
    other = F.col("other")
    # equal however often drawn: the single cell that follows the first region's corner
    after = ((region["r"] - 1) * w + region["c"]) % cells
    fallback = F.struct((F.floor(after / w) + 1).cast("int").alias("r"), (after % w + 1).cast("int").alias("c"), F.lit(1).alias("h"), F.lit(1).alias("w"))
    distinct = F.when(other == region, fallback).otherwise(other)
    left = F.when(task.isin("single_point", "point_difference"), point_spans(F.array(cell(a)))).when(task == "multi_point", point_spans(walk)).when(task == "line_profile", line).otherwise(spans_of(region))
    right = F.when(task == "point_difference", point_spans(F.array(cell(b)))).when(task == "region_mean_difference", spans_of(distinct))
    inside = F.struct((region["r"] + draw(region["h"], "tr", *key)).alias("r"), (region["c"] + draw(region["w"], "tc", *key)).alias("c"))
    target = F.when(task.isin("nearest_value_location", "threshold_fraction"), inside)
    op = reduce(lambda acc, t: acc.when(task == t, OPS[t]), L.TASKS[1:], F.when(task == L.TASKS[0], OPS[L.TASKS[0]]))
    return drawn.select("state_ref", "h", "w", "task", op.alias("op"), left.cast(SPANS).alias("left"), right.cast(SPANS).alias("right"), target.alias("target_cell"))


def _with_target(attached: DataFrame) -> DataFrame:
    """target: the displayed (one-decimal) value of each program's target cell, null where it has none."""
    cell = F.get("grid", (F.col("target_cell.r") - 1) * F.col("grid_w") + F.col("target_cell.c") - 1)
    return attached.withColumn("target", F.when(F.col("target_cell").isNotNull(), exact_round(cell, 1)))


# ---------------------------------------------------------------- geometry and validation


def with_geometry(programs: DataFrame) -> DataFrame:
    """Counts of query points (a cell of both leaves counts once), operand points, outputs, operations, and the extent; closed form."""
    p = programs.withColumn("bl", bounds(F.col("left"))).withColumn("br", F.when(F.col("right").isNotNull(), bounds(F.col("right"))))
    bl, br = F.col("bl"), F.col("br")
    shared = F.greatest(F.lit(0), F.least(bl["r2"], br["r2"]) - F.greatest(bl["r1"], br["r1"]) + 1) * F.greatest(F.lit(0), F.least(bl["c2"], br["c2"]) - F.greatest(bl["c1"], br["c1"]) + 1)
    two = br.isNotNull()
    operands = bl["n"] + F.coalesce(br["n"], F.lit(0))
    points = operands - F.when(two, shared).otherwise(0)
    outputs = F.when(F.col("task").isin(*L.READ_TASKS), bl["n"]).when(F.col("task").isin(*L.LOCATION_TASKS), 2).otherwise(1)
    each = F.when(F.col("op") == "read", 1).otherwise(2)
    high = lambda k: F.greatest(bl[k], br[k])
    low = lambda k: F.least(bl[k], br[k])
    return p.select(
        *programs.columns, points.alias("query_point_count"), operands.alias("operand_point_count"), outputs.alias("output_count"),
        F.when(two, 2 * each + 1).otherwise(each).alias("operation_count"), ((high("r2") - low("r1") + 1) * (high("c2") - low("c1") + 1)).alias("query_extent_cells"),
        L.capability(F.col("task")).alias("capability"), L.difficulty(points).alias("difficulty"),
    )


def block_diagnostics(programs: DataFrame, block_h: int, block_w: int) -> DataFrame:
    """Distinct blocks that a program's cells touch, single or multiple, and the share of cells at a block's lower or right edge; cells of both leaves count once.

    In closed form from the spans: a leaf is a list of single cells or one rectangle, and two rectangles share a rectangle, of cells as of blocks.
    """
    left, right = F.col("left"), F.coalesce("right", F.array().cast(SPANS))
    cells = F.array_distinct(F.transform(F.concat(left, right), lambda x: F.struct(x["r1"].alias("r"), x["c1"].alias("c"))))
    single = F.forall(F.concat(left, right), lambda x: (x["r1"] == x["r2"]) & (x["c1"] == x["c2"]))
    block = lambda v, size: F.floor((v - 1) / size)
    at_edge = lambda x: (x["r"] % block_h == 0) | (x["c"] % block_w == 0)
    listed = F.struct(
        F.size(F.array_distinct(F.transform(cells, lambda x: F.struct(block(x["r"], block_h), block(x["c"], block_w))))).cast("long").alias("blocks"), F.size(F.filter(cells, at_edge)).cast("long").alias("edges"), F.size(cells).cast("long").alias("cells"),
    )

    def counts(r1: Column, r2: Column, c1: Column, c2: Column) -> tuple[Column, Column, Column]:
        """Blocks, edge cells and cells of a rectangle, zeros if it is empty."""
        some, high, wide = (r2 >= r1) & (c2 >= c1), r2 - r1 + 1, c2 - c1 + 1
        rows, columns = F.floor(r2 / block_h) - block(r1, block_h), F.floor(c2 / block_w) - block(c1, block_w)  # edge lines inside
        blocks = (block(r2, block_h) - block(r1, block_h) + 1) * (block(c2, block_w) - block(c1, block_w) + 1)
        return tuple(F.when(some, v.cast("long")).otherwise(0) for v in (blocks, rows * wide + columns * high - rows * columns, high * wide))

    one, two = F.col("left")[0], F.col("right")[0]
    sides = ("r1", "r2", "c1", "c2")
    own, other = counts(*[one[k] for k in sides]), counts(*[two[k] for k in sides])
    meet = counts(F.greatest(one["r1"], two["r1"]), F.least(one["r2"], two["r2"]), F.greatest(one["c1"], two["c1"]), F.least(one["c2"], two["c2"]))
    shared = lambda k, size: F.greatest(F.least(block(one[f"{k}2"], size), block(two[f"{k}2"], size)) - F.greatest(block(one[f"{k}1"], size), block(two[f"{k}1"], size)) + 1, F.lit(0))
    blocks = own[0] + F.when(F.col("right").isNotNull(), other[0] - shared("r", block_h) * shared("c", block_w)).otherwise(0)
    both = lambda k: own[k] + F.when(F.col("right").isNotNull(), other[k] - meet[k]).otherwise(0)
    rectangles = F.struct(blocks.cast("long").alias("blocks"), both(1).alias("edges"), both(2).alias("cells"))
    out = programs.select("state_ref", "task", F.when(single, listed).otherwise(rectangles).alias("x"))
    return out.select("state_ref", "task", F.col("x.blocks").alias("distinct_blocks"), (F.col("x.edges") / F.col("x.cells")).alias("boundary_point_fraction"), F.when(F.col("x.blocks") == 1, "single_block").otherwise("multiple_blocks").alias("block_relation"))


def block_relation(block_h: int, block_w: int) -> Column:
    """single_block if all cells of a program lie in one block, else multiple_blocks: from the bounds, without listing cells."""
    left, right = bounds(F.col("left")), F.when(F.col("right").isNotNull(), bounds(F.col("right")))
    block = lambda v, size: F.floor((v - 1) / size)
    one = lambda low, high, size: block(F.least(left[low], right[low]), size) == block(F.greatest(left[high], right[high]), size)
    return F.when(one("r1", "r2", block_h) & one("c1", "c2", block_w), "single_block").otherwise("multiple_blocks")


def violations(programs: DataFrame) -> DataFrame:
    """(state_ref, task, problem) of programs that break a rule, a row for each rule broken."""
    task, left, right = F.col("task"), F.col("left"), F.col("right")
    n = F.col("bl.n")
    two = task.isin("point_difference", "region_mean_difference")
    inside = lambda b: (b["r1"] >= 1) & (b["c1"] >= 1) & (b["r2"] <= F.col("h")) & (b["c2"] <= F.col("w"))
    expected = reduce(lambda acc, t: acc.when(task == t, OPS[t]), L.TASKS[1:], F.when(task == L.TASKS[0], OPS[L.TASKS[0]]))
    reads = task.isin("single_point", "multi_point", "point_difference")
    rules = {
        "unknown_task": ~task.isin(*L.TASKS),
        "wrong_operator": expected != F.col("op"),
        "second_operand": two != right.isNotNull(),
        "empty_selector": F.size(left) < 1,
        "outside_grid": ~inside(F.col("bl")) | F.coalesce(~inside(F.col("br")), F.lit(False)),
        "repeated_position": F.size(F.array_distinct(F.transform(left, lambda s: F.struct(s["r1"], s["c1"])))) < F.size(left),
        "one_point_needed": task.isin("single_point", "point_difference") & (n != 1),
        "two_points_needed": task.isin("multi_point", "line_profile") & (n < 2),
        "region_needed": ~reads & (task != "line_profile") & (F.size(left) != 1),
        "whole_grid": task.isin("region_mean", "region_std", "region_mean_difference") & ((n == F.col("h") * F.col("w")) | F.coalesce(F.col("br.n") == F.col("h") * F.col("w"), F.lit(False))),
        "equal_operands": F.coalesce(left == right, F.lit(False)),
        "target_needed": task.isin("nearest_value_location", "threshold_fraction") & (F.col("target").isNull() | F.isnan("target")),
    }
    named = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    framed = programs.withColumn("bl", bounds(left)).withColumn("br", F.when(right.isNotNull(), bounds(right)))
    return framed.select("state_ref", "task", F.explode(named).alias("problem"))


# ---------------------------------------------------------------- execution


def _on_grids(programs: DataFrame, grids: DataFrame, how: str = "inner") -> DataFrame:
    """programs with their state's width (grid_w) and row-major values (grid): one join, by state. A program without its state has nulls where how is left, and fails the job where it is inner."""
    met = programs.join(grids.select("state_ref", F.col("w").alias("grid_w"), F.col("z").alias("grid")), "state_ref", "left")
    if how == "left":
        return met
    return met.withColumn("grid", F.when(F.col("grid").isNull(), F.raise_error(F.concat(F.lit("no grid for state "), "state_ref")).cast("array<double>")).otherwise(F.col("grid")))


def _cells(spans: Column) -> Column:
    """The values of a leaf's cells, span by span, each in row-major order: slices of the grid's rows."""
    rows = lambda s: F.transform(F.sequence(s["r1"], s["r2"]), lambda r: F.slice("grid", (r - 1) * F.col("grid_w") + s["c1"], s["c2"] - s["c1"] + 1))
    return F.flatten(F.flatten(F.transform(spans, rows)))


def _leaf(spans: Column) -> Column:
    """The values that a leaf's operator gives: means are exact sums of half-precision values, deviations are summed in row-major order, so neither depends on partitions."""
    op, target = F.col("op"), F.col("target")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    mean = lambda v: total(v) / F.size(v)

    def of(v: Column) -> Column:
        std = bound(mean(v), lambda m: F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)))
        return (
            F.when(op == "read", v).when(op == "mean", F.array(mean(v))).when(op == "std", F.array(std)).when(op == "min", F.array(F.array_min(v))).when(op == "max", F.array(F.array_max(v)))
            .when(op == "fraction_gt", F.array(F.size(F.filter(v, lambda x: x > target)) / F.size(v)))
        )

    return bound(_cells(spans), of)


def _tie_runs(span: Column) -> Column:
    """Row runs of all cells of a region that reach the least, greatest or nearest value: a run begins where the cell to the left is no tie or no part of the row, and ends likewise."""
    op, target, width = F.col("op"), F.col("target"), span["c2"] - span["c1"] + 1
    goal = F.transform(_cells(F.array(span)), lambda z: F.when(op == "argmin", z).when(op == "argmax", -z).otherwise(F.abs(z - target)))

    def of(g: Column) -> Column:
        return bound(F.array_min(g), lambda best: runs(g, lambda i: F.get(g, i) == best))

    def runs(g: Column, tied) -> Column:
        places = F.sequence(F.lit(0), F.size(g) - 1)
        first = F.filter(places, lambda i: tied(i) & ((i % width == 0) | ~F.coalesce(tied(i - 1), F.lit(False))))
        last = F.filter(places, lambda i: tied(i) & ((i % width == width - 1) | ~F.coalesce(tied(i + 1), F.lit(False))))
        return F.zip_with(first, last, lambda i, j: F.struct((span["r1"] + F.floor(i / width)).cast("int").alias("r"), (span["c1"] + i % width).cast("int").alias("c0"), (span["c1"] + j % width).cast("int").alias("c1")))

    return bound(goal, of)


def execute(programs: DataFrame, grids: DataFrame) -> DataFrame:
    """programs with (values, operands, encoding, runs); programs need target, or target_cell, from which it is set.

    grids: (state_ref, w, z in row-major order). Programs have to be valid: a cell outside its grid fails the job or is missed. One join by state; each program reads its own cells from the array.
    Locations give the first tie in row-major order, and all ties as a rectangle or as row runs.
    """
    attached = _on_grids(programs, grids)
    if "target" not in programs.columns:
        attached = _with_target(attached)
    return _executed(attached).drop("grid_w", "grid")


def _executed(attached: DataFrame) -> DataFrame:
    place = F.col("op").isin("argmin", "argmax", "nearest")
    two = F.col("right").isNotNull()
    rest = attached.columns
    leaves = attached.select(*rest, F.when(~place, _leaf(F.col("left"))).alias("a_"), F.when(~place & two, _leaf(F.col("right"))).alias("b_"), F.when(place, _tie_runs(F.col("left")[0])).alias("runs"))
    runs, none = F.col("runs"), F.array().cast("array<double>")
    values = F.when(place, F.array(runs[0]["r"].cast("double"), runs[0]["c0"].cast("double"))).when(two, F.array(F.col("a_")[0] - F.col("b_")[0])).otherwise(F.col("a_"))
    ties = F.aggregate(runs, F.lit(0), lambda n, x: n + x["c1"] - x["c0"] + 1)
    encoding = F.when(place, F.when(ties == bounds(F.col("left"))["n"], "rectangle").otherwise("row_runs"))
    return leaves.select(*rest, values.alias("values"), F.when(two & ~place, F.array(F.col("a_")[0], F.col("b_")[0])).otherwise(none).alias("operands"), encoding.alias("encoding"), runs.cast("array<struct<r:int,c0:int,c1:int>>").alias("runs"))


def invalid_ties(located: DataFrame) -> DataFrame:
    """Rows whose runs are empty, out of bounds, unsorted, overlapping or adjacent within a row."""
    b = bounds(F.col("left"))
    runs = F.col("runs")
    outside = F.exists(runs, lambda x: (x["r"] < F.col("b.r1")) | (x["r"] > F.col("b.r2")) | (x["c0"] < F.col("b.c1")) | (x["c1"] > F.col("b.c2")) | (x["c0"] > x["c1"]))
    pairs = F.zip_with(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), lambda p, q: (q["r"] < p["r"]) | ((q["r"] == p["r"]) & (q["c0"] <= p["c1"] + 1)))
    bad = F.coalesce(F.size(runs) < 1, F.lit(True)) | outside | F.exists(pairs, lambda x: x)
    return located.withColumn("b", b).filter(bad).drop("b")


# ---------------------------------------------------------------- records


def _selector_text(kind: Column, spans: Column, style: str) -> Column:
    first, last = F.col(spans)[0], F.element_at(F.col(spans), -1)
    listed = F.array_join(F.transform(F.col(spans), lambda s: F.format_string("(%d, %d)", s["r1"], s["c1"])), "; ")
    offsets = F.array_join(F.transform(F.col(spans), lambda s: F.format_string("(%d down, %d right)", s["r1"] - 1, s["c1"] - 1)), "; ")
    high, wide = first["r2"] - first["r1"] + 1, first["c2"] - first["c1"] + 1
    if style == "relative":
        area = F.format_string("the %d by %d block that begins %d down and %d right of the top-left cell", high, wide, first["r1"] - 1, first["c1"] - 1)
        cells = F.concat(F.lit("the cells at these moves from the top-left cell, in order: "), offsets)
    elif style == "interval":
        area = F.format_string("rows %d to %d and columns %d to %d, ends included", first["r1"], first["r2"], first["c1"], first["c2"])
        cells = F.concat(F.lit("exactly these (row, column) cells, in order: "), listed)
    elif style == "coordinate_tuple":
        area = F.format_string("the area with corner (%d, %d) and size (%d, %d)", first["r1"], first["c1"], high, wide)
        cells = F.concat(F.lit("(row, column) = "), listed)
    else:
        area = F.format_string("the area of height %d and width %d from row %d, column %d", high, wide, first["r1"], first["c1"])
        cells = F.concat(F.lit("the cells "), listed, F.lit(" in this order"))
    line = F.format_string("the %d cells on the line from (%d, %d) to (%d, %d)", F.size(F.col(spans)), first["r1"], first["c1"], last["r1"], last["c1"])
    return F.when(kind == "region", area).when(kind == "line", F.concat(line, F.lit(": "), cells)).otherwise(cells)


def question(template: str) -> Column:
    """The question of a program row (task, op, left, right, target) in one of the six template families; our own wording."""
    task = F.col("task")
    kind = F.when(task.isin("single_point", "multi_point", "point_difference"), "points").when(task == "line_profile", "line").otherwise("region")
    target = F.coalesce(F.col("target").cast("string"), F.lit(""))

    def described(side: str) -> Column:
        where = _selector_text(kind, side, template)
        op = F.col("op")
        return (
            F.when(op == "read", F.concat(F.lit("the standardized values of "), where))
            .when(op == "mean", F.concat(F.lit("the mean of "), where)).when(op == "std", F.concat(F.lit("the population standard deviation of "), where))
            .when(op == "min", F.concat(F.lit("the least value in "), where)).when(op == "max", F.concat(F.lit("the greatest value in "), where))
            .when(op == "fraction_gt", F.concat(F.lit("the share (0 to 1) of cells above "), target, F.lit(" in "), where))
            .when(op == "nearest", F.concat(F.lit("a cell whose value lies nearest to "), target, F.lit(" in "), where))
            .otherwise(F.concat(F.lit("a cell with the "), F.when(op == "argmin", "least").otherwise("greatest"), F.lit(" value in "), where))
        )

    body = F.when(F.col("right").isNull(), described("left")).otherwise(F.concat(F.lit("the first minus the second; first: "), described("left"), F.lit("; second: "), described("right")))
    frames = {"direct": "Give %s.", "question": "In this grid, what is %s?", "region_first": "Look at the named cells, then give %s.", "coordinate_tuple": "Grid query: %s.", "interval": "By explicit indices, give %s.", "relative": "Counting from the top-left cell, give %s."}
    ending = F.when(task.isin(*L.LOCATION_TASKS), " Answer [row, column], counted from one; any tied cell counts.").otherwise(" Answer a JSON array of numbers only.")
    return F.concat(F.format_string(frames[template], body), ending)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(",", *[s[k].cast("string") for k in ("pos", "r1", "r2", "c1", "c2")])), ";")


def semantic_id() -> Column:
    """24 hex digits over state, task, selectors and target: equal for all wordings of a program."""
    return F.substring(F.sha2(F.concat_ws("|", "state_ref", "task", spans_text(F.col("left")), F.coalesce(spans_text(F.col("right")), F.lit("")), F.coalesce(F.col("target").cast("decimal(18,1)").cast("string"), F.lit(""))), 256), 1, 24)


#: What a record says of its program besides the program itself; all of it follows from the grid.
CLAIMS = ("semantic_id", "answer", "tolerance", "decimals", "answer_kind", "query_point_count", "operand_point_count", "output_count", "operation_count", "query_extent_cells", "capability", "difficulty", "encoding", "runs")


def _answered(executed: DataFrame) -> DataFrame:
    """Executed programs with their ids, answer text, precision, tolerance, capability and difficulty."""
    from ..functions.answers import answer_text

    place, share = F.col("task").isin(*L.LOCATION_TASKS), F.col("task") == "threshold_fraction"
    digits = lambda d: F.transform("values", lambda v: exact_round(v, d))
    answer = F.when(place, answer_text(F.transform("values", lambda v: v.cast("int")))).when(share, answer_text(digits(FRACTION_DECIMALS))).otherwise(answer_text(digits(DECIMALS)))
    base = with_geometry(executed).withColumn("semantic_id", semantic_id()).withColumn("answer", answer)
    return base.withColumn("tolerance", F.when(share, FRACTION_TOLERANCE).otherwise(TOLERANCE)).withColumn("decimals", F.when(share, FRACTION_DECIMALS).otherwise(DECIMALS)).withColumn("answer_kind", F.when(place, "coordinate").otherwise("values"))


def _qa_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", "semantic_id", "template_family"), 256), 1, 24)


def records(executed: DataFrame, templates: tuple[str, ...] = ("direct",)) -> DataFrame:
    """A record per executed program and template: ids, answer text, precision, tolerance, capability and difficulty."""
    base = _answered(executed)
    worded = base.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("template_family"), F.lit("seen" if t in L.TEMPLATES["train"] else "heldout").alias("language_group"), question(t).alias("question")) for t in templates])).alias("t"))
    return worded.select(*base.columns, "t.*").withColumn("qa_id", _qa_id())


def tampered(records_df: DataFrame, grids: DataFrame) -> DataFrame:
    """(qa_id, problem) of records that don't replay. Each record's own program runs again on its grid; what the record claims is compared field by field, values to 1e-9 of their size. A missing grid is a problem of its own."""
    known = {"semantic_id": ["semantic_id"], "answer": ["answer"], "precision": ["tolerance", "decimals", "answer_kind"], "metadata": list(CLAIMS[5:12]), "ties": ["encoding", "runs"]}
    program = ["state_ref", "h", "w", "task", "op", "left", "right", "target", "template_family"]
    claims = records_df.select(*program, F.struct("qa_id", "question", "values", "operands", *CLAIMS).alias("claimed"))
    again = _on_grids(claims, grids, "left")
    found = _answered(_executed(again.filter("grid is not null")).drop("grid_w", "grid")).withColumn("qa_id", _qa_id())
    said = lambda c: F.col("claimed")[c]
    near = lambda a, b: F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(y))), lambda x: x), F.lit(False))
    wording = F.lit(None).cast("string")
    for t in (t for group in L.TEMPLATES.values() for t in group):
        wording = F.when(F.col("template_family") == t, question(t)).otherwise(wording)
    same = lambda c: said(c).eqNullSafe(F.col(c))
    rules = {k: ~reduce(lambda x, y: x & y, map(same, columns)) for k, columns in known.items()}
    rules |= {"values": ~(near(said("values"), F.col("values")) & near(said("operands"), F.col("operands"))), "question": ~said("question").eqNullSafe(wording)}
    rules["qa_id"] = ~rules["semantic_id"] & ~same("qa_id")  # it follows from the semantic id
    problems = found.select(said("qa_id").alias("qa_id"), F.explode(F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())).alias("problem"))
    return problems.unionByName(again.filter("grid is null").select(said("qa_id").alias("qa_id"), F.lit("missing_state").alias("problem")))


#: The tasks that the older record form has.
LEGACY_TASKS = L.READ_TASKS + L.STAT_TASKS + L.LOCATION_TASKS


def legacy_records(executed: DataFrame) -> DataFrame:
    """Records in the older form, of the eleven tasks without a second operand: every tie as a (row, column) pair instead of runs; lines have to step by one cell."""
    rows = executed.filter(F.col("task").isin(*LEGACY_TASKS))
    unit = F.forall(_steps(), lambda x: x)
    cells = F.flatten(F.transform("runs", lambda x: F.transform(F.sequence(x["c0"], x["c1"]), lambda c: F.struct(x["r"].alias("r"), c.alias("c")))))
    base = _answered(rows.filter((F.col("task") != "line_profile") | unit))
    return base.select("state_ref", "task", "left", "target", "answer", "values", "tolerance", "answer_kind", F.when(F.col("runs").isNotNull(), cells).alias("valid_coordinates"))


def _steps() -> Column:
    """Of consecutive spans of a line, whether each lies one cell to the right of or below the one before."""
    return F.zip_with(F.slice("left", 1, F.size("left") - 1), F.slice("left", 2, F.size("left") - 1), lambda a, b: ((b["r1"] - a["r1"] == 1) & (b["c1"] == a["c1"])) | ((b["c1"] - a["c1"] == 1) & (b["r1"] == a["r1"])))


#: Choices of the older sampler: points, line lengths, and region sizes of reads and of statistics.
LEGACY_COUNTS, LEGACY_LINES, LEGACY_REGIONS, LEGACY_AREAS = (2, 3, 4), (3, 4, 5), ((2, 2),), ((2, 2), (4, 4))


def sample_legacy(states: DataFrame, seed: int = 1, tasks: tuple[str, ...] = LEGACY_TASKS, counts: tuple[int, ...] = LEGACY_COUNTS, lines: tuple[int, ...] = LEGACY_LINES, regions: tuple[tuple[int, int], ...] = LEGACY_REGIONS, areas: tuple[tuple[int, int], ...] = LEGACY_AREAS) -> DataFrame:
    """Programs in the older form, one per state (state_ref, h, w) and task: counts and sizes are drawn from what is configured and fits, lines step by one cell to the right or down.

    Same columns as sample_programs. A grid that no configured line or region fits fails the job.
    """
    every = states.select("state_ref", "h", "w", F.explode(F.array(*map(F.lit, tasks))).alias("task"))
    h, w, task, key = F.col("h"), F.col("w"), F.col("task"), (F.lit(seed), F.col("state_ref"), F.col("task"))
    option = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    lengths = F.filter(F.array(*[option(n, down) for n in lines for down in (0, 1)]), lambda x: x["a"] <= F.when(x["b"] == 1, h).otherwise(w))
    fits = lambda sizes: F.filter(F.array(*[option(*s) for s in sizes]), lambda x: (x["a"] <= h) & (x["b"] <= w))
    options = F.when(task == "line_profile", lengths).when(task == "region_values", fits(regions)).otherwise(fits(areas))
    choice = F.get("options", draw(F.size("options"), "choice", *key))
    none = F.raise_error(F.concat(F.lit("no configured selector fits a grid of "), L.shape_label(h, w))).cast("struct<a:int,b:int>")
    points = task.isin("single_point", "multi_point")
    chosen = every.withColumn("options", options).withColumn("x", F.when(points, F.lit(None)).when(F.size("options") > 0, choice).otherwise(none)).drop("options")
    a, b = F.col("x.a"), F.col("x.b")
    line = task == "line_profile"
    high, wide = F.when(points, 1).when(line, 1 + (a - 1) * b).otherwise(a), F.when(points, 1).when(line, 1 + (a - 1) * (1 - b)).otherwise(b)
    at = chosen.withColumn("r", 1 + draw(h - high + 1, "row", *key)).withColumn("c", 1 + draw(w - wide + 1, "column", *key))
    r, c = F.col("r"), F.col("c")
    cell = lambda i: F.struct((F.floor(i / w) + 1).cast("int").alias("r"), (i % w + 1).cast("int").alias("c"))
    count = F.get(F.array(*map(F.lit, counts)), draw(len(counts), "count", *key))
    several = F.transform(F.sequence(F.lit(0), F.least(count, h * w) - 1), lambda i: cell(permuted(i, h * w, *key, "points")))
    left = (
        F.when(task == "single_point", point_spans(F.array(F.struct(r.alias("r"), c.alias("c"))))).when(task == "multi_point", point_spans(several))
        .when(line, line_spans(r, c, b, 1 - b, a)).otherwise(region_spans(r, c, a, b))
    )
    inside = F.struct((r + draw(a, "tr", *key)).alias("r"), (c + draw(b, "tc", *key)).alias("c"))
    op = reduce(lambda acc, t: acc.when(task == t, OPS[t]), LEGACY_TASKS[1:], F.when(task == LEGACY_TASKS[0], OPS[LEGACY_TASKS[0]]))
    return at.select("state_ref", "h", "w", "task", op.alias("op"), left.cast(SPANS).alias("left"), F.lit(None).cast(SPANS).alias("right"), F.when(task == "nearest_value_location", inside).alias("target_cell"))


def unit_lines(programs: DataFrame) -> DataFrame:
    """Line programs that step by one cell, rightwards or downwards: those that the older protocol allows."""
    return programs.filter(F.col("task") == "line_profile").filter(F.forall(_steps(), lambda x: x))
