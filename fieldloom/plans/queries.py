"""Registered queries: each runs an operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import labels as L, numeric as N
from ..functions.answers import answer_text, parse_answer
from ..operators import audit, batching, normalize, programs as P, pyramid, sampling, scoring
from ..sources import files, grids, tiles, versions
from ..sources.grids import table
from ..sources.tables import discarding, removed, work_path, written
from .build import BuildConfig, Dataset, build_dataset, dataset_problems, load_dataset, publish

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIMS = ["task", "shape", "field", "answer_kind", "shape_partition", "source_id", "family", "is_static", "is_constant", "capability", "difficulty", "language_group", "template_family", "query_area_bucket", "query_points_bucket", "output_length_bucket", "block_relation", "operation_count", "roughness_bin", "split"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def listed(c: str) -> Column:
    """An array of doubles as text with six decimals."""
    return F.array_join(F.transform(c, lambda v: F.round(v, 6).cast("decimal(18,6)").cast("string")), ",")


# ---------------------------------------------------------------- inputs that the queries share


def raw(s: SparkSession, d: str) -> DataFrame:
    return grids.embedding_cells(s, d)


def cells(s: SparkSession, d: str) -> DataFrame:
    return grids.cells_of(packed(s, d))


def states(s: SparkSession, d: str) -> DataFrame:
    """One row per vector with its number n, from which the fixed programs are set."""
    e = table(s, d, "embeddings")
    return e.select(F.concat(F.lit("emb:"), F.col("vec_id").cast("string")).alias("state_ref"), F.col("vec_id").cast("int").alias("n"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("field"), F.lit("emb").alias("source_id"), F.lit(8).alias("h"), F.lit(8).alias("w"))


def fixed_programs(st: DataFrame) -> DataFrame:
    """All tasks for every state, with selectors set by the state's number."""
    n, i = F.col("n"), lambda v: F.lit(v)
    div = lambda a, b: F.floor(a / b).cast("int")
    point = lambda r, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))
    one = P.point_spans(F.array(point(1 + n % 8, 1 + div(n, 8) % 8)))
    many = P.point_spans(F.array(point(1 + n % 8, i(1)), point(1 + (n + 3) % 8, i(5)), point(8 - n % 8, i(8))))
    line = P.line_spans(1 + n % 8, i(8), i(0), i(-2), i(4))
    block = P.region_spans(1 + n % 5, 1 + div(n, 5) % 5, i(2), i(3))
    r, c, h, w = 1 + n % 4, 1 + div(n, 4) % 4, 2 + n % 3, 1 + div(n, 3) % 4
    region = P.region_spans(r, c, h, w)
    first, second = P.point_spans(F.array(point(1 + n % 8, i(1)))), P.point_spans(F.array(point(1 + (n + 1) % 8, i(8))))
    other = P.region_spans(i(5), i(5), i(2), i(2))
    left = {"single_point": one, "multi_point": many, "line_profile": line, "region_values": block, "point_difference": first}
    right = {"point_difference": second, "region_mean_difference": other}
    at = F.struct(r.alias("r"), c.alias("c"))
    rows = [
        F.struct(F.lit(t).alias("task"), F.lit(P.OPS[t]).alias("op"), left.get(t, region).cast(P.SPANS).alias("left"), right.get(t, F.lit(None)).cast(P.SPANS).alias("right"), (at if t in ("nearest_value_location", "threshold_fraction") else F.lit(None).cast("struct<r:int,c:int>")).alias("target_cell"))
        for t in L.TASKS
    ]
    return st.select("state_ref", "n", "h", "w", "field", "source_id", F.explode(F.array(*rows)).alias("p")).select("state_ref", "n", "h", "w", "field", "source_id", "p.*")


def packed(s: SparkSession, d: str) -> DataFrame:
    """Every vector as a standardized grid, each by itself: no cell is shuffled."""
    return normalize.standardize_grids(grids.embedding_grids(s, d)).select("state_ref", "h", "w", "z")


def executed(s: SparkSession, d: str) -> DataFrame:
    return P.execute(fixed_programs(states(s, d)), packed(s, d))


def records(s: SparkSession, d: str, templates: tuple[str, ...] = ("direct",)) -> DataFrame:
    split = F.when(F.col("n") % 10 < 8, "train").when(F.col("n") % 10 == 8, "val").otherwise("test")
    return P.records(executed(s, d), templates).withColumn("shape", L.shape_label(F.col("h"), F.col("w"))).withColumn("split", split)


def answered(rec: DataFrame) -> DataFrame:
    """rec with prediction, terminated and given, set by (n + task length) mod 8: exact, close, far, too many, not JSON, cut short, none, not finite."""
    mode = (F.col("n") + F.length("task")) % 8
    place = F.col("answer_kind") == "coordinate"
    shifted = lambda x: answer_text(F.transform("values", lambda v: F.round(v + x, 4)))
    near = F.when(place, answer_text(F.col("values"))).when(F.col("task") == "threshold_fraction", shifted(0.01)).otherwise(shifted(0.1))
    far = F.when(place, "[99, 1]").otherwise(shifted(0.5))
    more = F.concat(F.regexp_replace("answer", r"\]$", ""), F.lit(", 1.0]"))
    text = F.when(mode == 1, near).when(mode == 2, far).when(mode == 3, more).when(mode == 4, F.concat(F.lit("it is "), "answer")).when(mode == 7, "[NaN]").otherwise(F.col("answer"))
    given = lambda x: F.when(mode != 6, x)
    return rec.withColumn("prediction_", given(text)).withColumn("terminated_", given(mode != 5)).withColumn("given_", given(F.lit(True))).withColumnsRenamed({f"{c}_": c for c in ("prediction", "terminated", "given")})


def predictions(rec: DataFrame) -> DataFrame:
    return answered(rec).filter("given").select("qa_id", "prediction", "terminated")


def scored(s: SparkSession, d: str) -> DataFrame:
    """Every record with its own prediction scored: programs run once."""
    return scoring.annotate(scoring.scored_pairs(answered(records(s, d))))


def annotated(s: SparkSession, d: str) -> DataFrame:
    """Scored rows with what the metric groups need of their states and blocks: shapes seen in training, family, static and constant fields, roughness, block relation."""
    sc = scored(s, d).withColumn("block_relation", P.block_relation(3, 3))
    own = normalize.packed_roughness(packed(s, d)).select("state_ref", "roughness_bin", (F.col("roughness_bin") == "constant").alias("is_constant"))
    seen = states(s, d).filter("n % 10 < 8").select("h", "w").distinct().withColumn("shape_partition", F.lit("seen"))
    rows = sc.join(own, "state_ref").join(seen, ["h", "w"], "left")
    return rows.withColumn("shape_partition", F.coalesce("shape_partition", F.lit("heldout"))).withColumn("family", F.when(F.col("n") % 2 == 0, "even").otherwise("odd")).withColumn("is_static", F.col("n") % 3 == 0)


# ---------------------------------------------------------------- sources and standardising


@query
def crop_read(s, d):
    """A rectangle of every grid, with coordinates of its own."""
    return grids.crop(raw(s, d), 1, 2, 4, 5).select("state_ref", "field", "r", "c", "x")


@query
def state_statistics(s, d):
    """Mean, population deviation and constancy per state."""
    return normalize.statistics(raw(s, d)).select("state_ref", long("n").alias("n"), F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), F.round("scale", 9).alias("scale"), "is_constant")


@query
def standardized_cells(s, d):
    """Half-precision z-scores."""
    return cells(s, d).select("state_ref", "r", "c", "z")


@query
def region_mean(s, d):
    """The mean over rows 2-5 and columns 3-7 of every standardized grid."""
    inside = cells(s, d).filter("r between 2 and 5 and c between 3 and 7")
    return inside.groupBy("state_ref").agg(F.avg("z").alias("region_mean"), F.min("z").alias("region_min"), F.max("z").alias("region_max"), F.count("*").alias("n"))


@query
def event_grids(s, d):
    """Event values by day and hour, standardized."""
    return normalize.standardize(grids.event_cells(s, d)).select("state_ref", "r", "c", "z")


@query
def lineitem_grids(s, d):
    """Discounts by line number and year, standardized."""
    return normalize.standardize(grids.lineitem_cells(s, d)).select("state_ref", "r", "c", "z")


@query
def roughness(s, d):
    """First-neighbour roughness and its bin."""
    return normalize.roughness(cells(s, d)).select("state_ref", F.round("roughness", 9).alias("roughness"), "roughness_bin")


@query
def event_min_ties(s, d):
    """Row runs of each event grid's least value."""
    grid = normalize.standardize(grids.event_cells(s, d))
    whole = grid.select("state_ref", "h", "w").distinct().select("state_ref", F.lit("region_argmin").alias("task"), F.lit("argmin").alias("op"), F.lit(None).cast("double").alias("target"), P.region_spans(F.lit(1), F.lit(1), F.col("h"), F.col("w")).cast(P.SPANS).alias("left"), F.lit(None).cast(P.SPANS).alias("right"))
    return P.execute(whole, grids.grids_of(grid)).select("state_ref", F.explode("runs").alias("x")).select("state_ref", "x.*")


@query
def vector_components(s, d):
    """B1: order price and year as a two-component field per order."""
    o = table(s, d, "orders").select("o_orderkey", F.lit("velocity").alias("field"), F.array(F.col("o_totalprice"), F.year("o_orderdate").cast("double")).alias("vector"))
    return grids.components(o).select("o_orderkey", "field", "component", "x")


@query
def packed_grids(s, d):
    """Grids as row-major arrays, and the number of cells before each by id."""
    rows = packed(s, d).withColumn("id", F.substring("state_ref", 5, 12).cast("long")).withColumn("size", F.size("z"))
    return batching.running_offsets(rows, "id", "size", "cache_offset").select("state_ref", long("cache_offset").alias("cache_offset"), "size", listed("z").alias("z"))


@query
def full_matrix_prompt(s, d):
    """The whole grid as text, with nothing but its shape."""
    rows = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.concat(F.lit("["), F.array_join(F.transform(F.slice("z", i * F.col("w") + 1, F.col("w")), lambda v: F.round(v, 3).cast("decimal(12,3)").cast("string")), ","), F.lit("]")))
    return packed(s, d).select("state_ref", F.concat(F.format_string("%d x %d grid: [", "h", "w"), F.array_join(rows, ","), F.lit("]")).alias("prompt"))


# ---------------------------------------------------------------- large fields in tiles


def _frame_name() -> Column:
    return F.concat_ws(":", "source_file_id", "sample_index", "time_index")


def _shipment_store(s: SparkSession, d: str, side: int = 16) -> tiles.TileStore:
    return tiles.write_store(grids.shipment_tiles(s, d, side, side), side)


@query
def tile_crops(s, d):
    """A1 A2: three crops of every frame of shipped quantities, read from a tile store by the tiles they touch."""
    store = _shipment_store(s, d)
    with discarding(s):
        frames = store.tiles.filter("tr = 0 and tc = 0").select(*tiles.FRAME, "height", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
        k, t = F.col("k"), F.col("time_index")
        sized = frames.withColumn("h", F.least(5 + 3 * k, F.col("height"))).withColumn("w", 7 + 11 * k)
        placed = sized.withColumn("top", (t * 7 + k * 13) % (F.col("height") - F.col("h") + 1)).withColumn("left", (F.col("sample_index") * 29 + k * 17 + t * 5) % (84 - F.col("w") + 1))
        states = placed.select(F.concat_ws(":", _frame_name(), "k").alias("state_ref"), *tiles.FRAME, "top", "left", "h", "w")
        crops = tiles.read_crops(store, states).select("state_ref", "w", F.posexplode("x").alias("i", "x"))
        out = written(crops.select("state_ref", (F.floor(F.col("i") / F.col("w")) + 1).cast("int").alias("r"), (F.col("i") % F.col("w") + 1).cast("int").alias("c"), "x"), "crops", outer=True)
    store.remove()
    return out


@query
def tile_layout(s, d):
    """Shape, values, bytes and problems of each file of a tile store; file N has values that aren't finite, file R lacks a time step, both by the data's own keys."""
    whole = _shipment_store(s, d)
    with discarding(s):
        file = F.col("source_file_id")
        x = F.transform("values", lambda v: F.when(v == 0, float("nan")).otherwise(v))
        bent = whole.tiles.filter((file != "R") | (F.col("time_index") != 6)).withColumn("values", F.when(file == "N", x).otherwise(F.col("values")))
        found = tiles.layout_problems(tiles.TileStore(bent, whole.layout, whole.side, whole.path)).groupBy("source_file_id").agg(F.array_join(F.array_sort(F.collect_list("problem")), ",").alias("problems"))
        out = whole.layout.join(found, "source_file_id", "left").select("source_file_id", "samples", "times", "height", "width", "dtype", "value_count", "bytes", F.coalesce("problems", F.lit("")).alias("problems"))
        out = written(out, "layout", outer=True)
    whole.remove()
    return out


def _shipment_regions(frames: DataFrame) -> DataFrame:
    """Four regions of every frame, about half its rows and columns; frames: (state_ref, source_file_id, sample_index, time_index, height, width)."""
    k = F.col("k")
    each = frames.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    half = F.floor(F.col("height") / 2).cast("int")
    r1, c1 = 1 + (k * 7 + F.col("time_index")) % (F.col("height") - half), 1 + (k * 11 + F.col("sample_index") * 5) % 40
    return each.select(F.concat_ws(":", "state_ref", "k").alias("region"), "state_ref", "height", "width", r1.alias("r1"), (r1 + half).alias("r2"), c1.alias("c1"), (c1 + 30 + 4 * k).alias("c2"))


def _shipment_pyramid(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, tiles, pyramid) of the shipped quantities."""
    own = written(grids.shipment_tiles(s, d, pyramid.SIDE, pyramid.SIDE).withColumn("state_ref", _frame_name()), "tiles")
    regions = _shipment_regions(own.filter("tr = 0 and tc = 0").select("state_ref", "source_file_id", "sample_index", "time_index", "height", "width"))
    return regions, own, written(pyramid.pyramid(own), "pyramid")


@query
def pyramid_statistics(s, d):
    """Statistics of large regions from tile summaries and their rims."""
    with discarding(s):
        stats = pyramid.region_statistics(*_shipment_pyramid(s, d))
        return written(stats.select("region", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "low", "high"), "statistics", outer=True)


@query
def pyramid_ties(s, d):
    """Row runs of the greatest values of large regions; only tiles that have them are read."""
    with discarding(s):
        regions, own, levels = _shipment_pyramid(s, d)
        stats = written(pyramid.region_statistics(regions, own, levels), "statistics")
        return written(pyramid.region_extrema(regions, stats, own, levels, "argmax"), "ties", outer=True)


# ---------------------------------------------------------------- programs


@query
def program_values(s, d):
    """Ordered reads, statistics, fractions and differences of all tasks in one join."""
    out = executed(s, d).filter("encoding is null")
    return out.select("state_ref", "task", listed("values").alias("answer"), listed("operands").alias("operands"))


@query
def program_locations(s, d):
    """First tie and all tie runs of least, greatest and nearest values."""
    runs = F.array_join(F.transform("runs", lambda x: F.format_string("%d:%d-%d", x["r"], x["c0"], x["c1"])), ";")
    return executed(s, d).filter("encoding is not null").select("state_ref", "task", F.col("values")[0].cast("int").alias("r"), F.col("values")[1].cast("int").alias("c"), "encoding", runs.alias("runs"))


@query
def tie_set_audit(s, d):
    """Tie sets that are empty, out of bounds, unsorted or mergeable: by the state's number sound, emptied, with the first run twice, or with runs moved to the right."""
    runs, n = F.col("runs"), F.col("n") % 4
    moved = F.transform(runs, lambda x: F.struct(x["r"].alias("r"), (x["c0"] + 2).alias("c0"), (x["c1"] + 2).alias("c1")))
    bent = F.when(n == 1, F.slice(runs, 1, 0)).when(n == 2, F.concat(F.slice(runs, 1, 1), runs)).when(n == 3, moved).otherwise(runs)
    return P.invalid_ties(executed(s, d).filter("encoding is not null").withColumn("runs", bent)).select("state_ref", "task")


@query
def program_geometry(s, d):
    """Counts, operations, extent, capability and difficulty, in closed form."""
    g = P.with_geometry(fixed_programs(states(s, d)))
    return g.select("state_ref", "task", long("query_point_count").alias("points"), long("operand_point_count").alias("operands"), long("output_count").alias("outputs"), long("operation_count").alias("operations"), long("query_extent_cells").alias("extent"), "capability", "difficulty")


@query
def block_relations(s, d):
    """Blocks of 3 x 3 that programs touch."""
    b = P.block_diagnostics(fixed_programs(states(s, d)), 3, 3)
    return b.select("state_ref", "task", "distinct_blocks", F.round("boundary_point_fraction", 9).alias("boundary_point_fraction"), "block_relation")


@query
def program_violations(s, d):
    """Rule breaks of programs that were bent by their state's number."""
    p = fixed_programs(states(s, d)).withColumn("target", F.lit(0.5))
    n = F.col("n") % 7
    bent = p.withColumn("op", F.when(n == 1, "mode").otherwise(F.col("op"))).withColumn("right", F.when((n == 2) & F.col("right").isNotNull(), F.col("left")).otherwise(F.col("right"))).withColumn("h", F.when(n == 3, 1).otherwise(F.col("h"))).withColumn("target", F.when(n == 4, None).otherwise(F.col("target")))
    return P.violations(bent).groupBy("task", "problem").agg(F.count("*").alias("programs"))


@query
def record_build(s, d):
    """Answers at their precision, tolerance, kind."""
    return records(s, d).select("state_ref", "task", "answer", "tolerance", "decimals", "answer_kind", "difficulty", "capability")


@query
def record_identity(s, d):
    """H4: ids of programs, shared by all wordings, and ids of wordings."""
    r = records(s, d, L.TEMPLATES["train"] + L.TEMPLATES["val"] + L.TEMPLATES["test"])
    return r.select("state_ref", "task", "template_family", "semantic_id", "qa_id")


@query
def legacy_records(s, d):
    """Records in the older form, every tie listed."""
    ties = F.array_join(F.transform("valid_coordinates", lambda x: F.format_string("%d,%d", x["r"], x["c"])), ";")
    return P.legacy_records(executed(s, d)).select("state_ref", "task", "answer", ties.alias("ties"))


@query
def legacy_programs(s, d):
    """Programs of the older sampler: first and last cell (of single draws), cells and target cell."""
    p = P.sample_legacy(states(s, d))
    one, first, last = F.col("task") != "multi_point", F.col("left")[0], F.element_at("left", -1)
    return p.select("state_ref", "task", *[F.when(one, x).alias(n) for n, x in (("r1", first["r1"]), ("c1", first["c1"]), ("r2", last["r2"]), ("c2", last["c2"]))], long(P.bounds(F.col("left"))["n"]).alias("cells"), F.col("target_cell.r").alias("tr"), F.col("target_cell.c").alias("tc"))


@query
def record_questions(s, d):
    """H1: the question texts of all six families."""
    return records(s, d, L.TEMPLATES["train"] + L.TEMPLATES["val"] + L.TEMPLATES["test"]).select("state_ref", "task", "template_family", "question")


@query
def record_tampering(s, d):
    """Changed answers, values and metadata that a replay finds, by kind."""
    r = records(s, d)
    n = F.col("n") % 5
    bent = r.withColumn("answer", F.when(n == 1, F.lit("[9.9]")).otherwise(F.col("answer"))).withColumn("values", F.when(n == 2, F.array(F.lit(77.0))).otherwise(F.col("values"))).withColumn("difficulty", F.when(n == 3, F.lit("0")).otherwise(F.col("difficulty"))).withColumn("semantic_id", F.when(n == 4, F.lit("x")).otherwise(F.col("semantic_id")))
    return P.tampered(bent, packed(s, d)).groupBy("problem").agg(F.count("*").alias("records"))


@query
def sampled_programs(s, d):
    """Programs drawn by hash; what they select and how often rules break (never)."""
    drawn = P.sample_programs(states(s, d))
    g = P.with_geometry(drawn)
    bad = P.violations(drawn.withColumn("target", F.lit(0.0))).groupBy("task").agg(F.count("*").alias("problems"))
    return g.groupBy("task").agg(F.count("*").alias("programs"), F.min("query_point_count").alias("fewest"), F.max("query_point_count").alias("most")).join(bad, "task", "left").fillna(0, ["problems"])


# ---------------------------------------------------------------- scoring and metrics


@query
def answer_parsing(s, d):
    """H2: error classes of answers given in customers' names: numbers, arrays and junk by key."""
    forms = ["[1]", "[0.5, 2]", " [1e3] ", "[NaN]", "[-Infinity, 1]", "[true]", "[]", "[0.2,]", "[1e999]", "0.2", "[0.2] or [0.3]", '{"a": 1}', "[[1]]", '["1"]', "", "null", "[1 2]", "[01]", "[.5]", "[1]//c"]
    text = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("c_custkey") % len(forms) + 1).cast("int"))
    c = table(s, d, "customer").select(text.alias("text")).withColumn("p", parse_answer(F.col("text")))
    return c.groupBy("text", F.coalesce("p.error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query
def scored_answers(s, d):
    """Validity, error, units and hits of every question."""
    return scored(s, d).select("state_ref", "task", F.coalesce("error", F.lit("none")).alias("error"), "valid", "units", "hits", "all_correct", "observed_count")


@query
def score_summary(s, d):
    """Metrics of the whole and of every dimension, in one pass."""
    out = scoring.summarize(annotated(s, d), DIMS).orderBy("dim", "key")
    return out.select("dim", "key", "questions", long("units").alias("units"), *[F.round(c, 9).alias(c) for c in ("unit_accuracy", "answer_accuracy", "valid_rate")])


@query
def score_errors(s, d):
    """Error counts by task."""
    return scoring.errors(scored(s, d), "task")


@query
def macro_average(s, d):
    """Unweighted means over tasks."""
    return scoring.macro(scored(s, d)).select("tasks", F.round("macro_unit_accuracy", 9).alias("macro_unit_accuracy"), F.round("macro_answer_accuracy", 9).alias("macro_answer_accuracy"))


@query
def incomplete_annotations(s, d):
    """Dimensions that only some rows have."""
    sc = scored(s, d).withColumn("half", F.when(F.col("n") % 2 == 0, "x"))
    return scoring.incomplete_dims(sc, ["half", "task", "split"])


@query
def prediction_ids(s, d):
    """C4: unknown and repeated predictions."""
    rec = records(s, d).select("qa_id", "n", "task", "answer", "values", "answer_kind")
    p = predictions(rec).select("qa_id")
    bent = p.union(p.join(rec.filter("n % 9 = 0").select("qa_id"), "qa_id", "left_semi")).union(rec.filter("n % 11 = 0").select(F.concat(F.lit("x"), "qa_id")))
    return scoring.unknown_or_repeated(rec, bent).groupBy("problem").agg(F.count("*").alias("n"))


@query
def exact_cover(s, d):
    """Ids that only records or only predictions have."""
    rec = records(s, d).select("qa_id", "n", "task", "answer", "values", "answer_kind")
    return scoring.uncovered(rec, predictions(rec)).groupBy("side").agg(F.count("*").alias("n"))


@query
def language_pairs(s, d):
    """Seen and held-out wordings of the same programs."""
    rec = records(s, d, ("direct", "relative"))
    p = predictions(rec.withColumn("n", F.when(F.col("language_group") == "seen", F.col("n")).otherwise(F.col("n") + 1)))
    return scoring.language_pairs(scoring.annotate(scoring.score(rec, p))).withColumn("both_correct_rate", F.round("both_correct_rate", 9))


@query
def field_pairs(s, d):
    """Pairs of neighbouring states under the same task."""
    sc = scored(s, d)
    pair = F.concat_ws(":", F.floor(F.col("n") / 2).cast("string"), "task")
    return scoring.field_pairs(sc.withColumn("input_pair_id", F.when(F.col("n") % 3 != 2, pair)).withColumn("input_pair_member", F.when(F.col("n") % 2 == 0, "original").otherwise("alternative"))).withColumn("both_correct_rate", F.round("both_correct_rate", 9))


@query
def zero_baseline(s, d):
    """The answer zero, by task."""
    out = scoring.summarize(scoring.zero_baseline(records(s, d)), ["task"])
    return out.select("dim", "key", "questions", long("units").alias("units"), *[F.round(c, 9).alias(c) for c in ("unit_accuracy", "answer_accuracy")])


@query
def changed_answers(s, d):
    """Pairs of a record and its program on another state that changes the answer."""
    return scoring.changed_answer_pairs(records(s, d), packed(s, d))


def _prediction_rows(s, d) -> DataFrame:
    e = table(s, d, "events")
    v = F.col("event_id")
    return e.select(
        v.alias("id"), F.when(v % 2 == 0, "normalized_point_value").otherwise("raw_point_value_with_stats").alias("task"), F.col("event_type").alias("source"), F.when(v % 3 == 0, "8x8").otherwise("4x16").alias("shape"),
        F.concat(F.lit("f"), (v % 4).cast("string")).alias("field"), (v % 32).alias("coordinate_32"), (v % 96).alias("coordinate_96"), F.when(v % 5 == 0, "height").alias("extrapolation_axis"), F.when(v % 2 == 0, "seen").otherwise("heldout").alias("shape_partition"),
        (v % 7 < 4).alias("correct"), F.when(v % 6 != 0, (v % 100) / 64.0).alias("absolute_z_error"), F.when(v % 10 < 6, (v % 11) / 8.0).alias("value_gap"), F.when(v % 13 != 0, F.floor(v / 2)).alias("pair_id"), (v % 9).alias("chosen_value_rank"),
    )


@query
def prediction_breakdowns(s, d):
    """Accuracy along ten keys and the value gap's band."""
    b = scoring.breakdowns(_prediction_rows(s, d))
    return b.select("key", long("correct").alias("correct"), "total", F.round("accuracy", 9).alias("accuracy"), F.round("mean_absolute_z_error", 9).alias("mean_absolute_z_error"))


@query
def numeric_format_pairs(s, d):
    """Normalised and raw questions on the same value."""
    return scoring.numeric_pairs(_prediction_rows(s, d))


@query
def run_comparison(s, d):
    """Two runs' accuracy by task over the same questions, in percentage points; the second run's predictions are those of the next state's number."""
    rec = records(s, d)
    second = scoring.score(rec, predictions(rec.withColumn("n", F.col("n") + 1)))
    out = scoring.compare_runs(scored(s, d), second, "task", "all_correct")
    return out.select("key", *[F.round(c, 7).alias(c) for c in ("a", "b", "delta_points")])


# ---------------------------------------------------------------- audits


@query
def finite_scan(s, d):
    """Rows and non-finite values per label."""
    bad = raw(s, d).withColumn("x", F.when(F.col("trajectory") % 50 == 0, float("nan")).otherwise(F.col("x")))
    return audit.not_finite(bad, ["field"])


@query
def monotone_axes(s, d):
    """Users whose events' values step back in time order."""
    return audit.not_increasing(table(s, d, "events"), "user_id", "event_id", "value")


@query
def trajectory_repair(s, d):
    """A5: declared counts of -1 replaced where all fields agree."""
    f = table(s, d, "supplier").select("s_nationkey", F.when(F.col("s_nationkey") % 3 == 0, -1).otherwise(5).alias("declared"), (F.col("s_suppkey") % (F.col("s_nationkey") % 2 + 1)).alias("observed"))
    return audit.agreed_count(f, "declared", "observed", "s_nationkey")


def _manifest(s, d) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.when(k % 17 == 0, ".txt").otherwise(".parquet")
    path = F.when(k % 23 == 0, "../up.parquet").when(k % 29 == 0, "same.parquet").otherwise(F.concat(F.lit("data/"), F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (k % 3 + 1).cast("int")), F.lit("/f"), k.cast("string"), ext))
    return table(s, d, "part").select(path.alias("path"), F.when(k % 31 == 0, "extra").otherwise("train").alias("split"), (k % 37).alias("size_bytes"), F.when(k % 41 == 0, "zz").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"), k.alias("k"))


@query
def manifest_audit(s, d):
    """Rule breaks of a manifest."""
    return audit.manifest_problems(_manifest(s, d)).groupBy("problem").agg(F.count("*").alias("n"))


@query
def manifest_splits(s, d):
    """Splits by path, null for the rest."""
    c = audit.classify_files(_manifest(s, d), {"train": "^data/train/", "val": "^data/valid/", "test": "^data/test/"})
    return c.groupBy(F.coalesce("split", F.lit("excluded")).alias("split")).agg(F.count("*").alias("files"))


@query
def receipt_audit(s, d):
    """Manifest against receipt."""
    m = _manifest(s, d).filter("path like 'data/%'")
    r = m.filter("k % 7 <> 0").withColumn("size_bytes", F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("size_bytes"))).withColumn("sha256", F.when(F.col("k") % 11 == 0, "x").otherwise(F.col("sha256"))).select("path", "size_bytes", "sha256").union(m.filter("k % 13 = 0").select(F.concat(F.lit("new/"), "path"), "size_bytes", "sha256"))
    return audit.receipt_problems(m, r).groupBy("problem").agg(F.count("*").alias("n"))


@query
def duplicate_content(s, d):
    """Documents whose text occurs in several splits."""
    docs = table(s, d, "documents").select(F.sha2("text", 256).alias("digest"), F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"))
    return audit.shared_digests(docs, "digest")


@query
def trajectory_leaks(s, d):
    """States outside their trajectory's split."""
    st = states(s, d).select("state_ref", (F.col("n") % 50).alias("trajectory"), F.when(F.col("n") % 97 == 0, "test").otherwise("train").alias("split"))
    sp = st.select("trajectory").distinct().filter("trajectory <> 49").withColumn("split", F.lit("train"))
    return audit.leaks(st, sp).select("state_ref", "split")


@query
def partition_overlaps(s, d):
    """Customers with orders of several priorities' partitions."""
    return audit.overlaps(table(s, d, "orders"), "o_custkey", "o_orderpriority").select("o_custkey", "parts")


@query
def repeated_ids(s, d):
    """keys with several rows."""
    return audit.repeated_ids(table(s, d, "lineitem"), "l_orderkey").select("l_orderkey", "n")


@query
def wanted_states(s, d):
    """C14: per field the states that labelled ids name, and how many ids name no state."""
    rec = table(s, d, "labels").select(F.concat(F.lit("emb:"), F.col("doc_id").cast("string")).alias("state_ref"))
    have = audit.wanted_states(states(s, d), rec).groupBy("field").agg(F.count("*").alias("states"))
    return have.unionByName(audit.missing_states(rec, states(s, d)).agg(F.count("*").alias("states")).select(F.lit("missing").alias("field"), "states"))


@query
def offset_audit(s, d):
    """Breaks in running offsets, by customer."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 5 + 1).alias("size"))
    from pyspark.sql import Window

    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    built = o.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)) + (F.col("o_orderkey") % 101 == 0).cast("int"))
    return batching.offset_breaks(built, "o_custkey", "o_orderkey", "offset", "size").select("o_custkey", "o_orderkey", "offset", "expected")


@query
def precision_audit(s, d):
    """Records whose rounding isn't finer than their tolerance."""
    r = records(s, d).withColumn("tolerance", F.when(F.col("n") % 4 == 0, 0.0005).otherwise(F.col("tolerance")))
    return audit.coarse_precision(r).groupBy("decimals").agg(F.count("*").alias("records"))


@query
def source_preflight(s, d):
    """Enough trajectories and one shape per source."""
    three = raw(s, d).unionByName(grids.event_cells(s, d)).unionByName(grids.lineitem_cells(s, d))
    return audit.preflight(three)


@query
def content_digests(s, d):
    """A digest per state of its values in order."""
    return audit.content_digests(raw(s, d), ["state_ref", "field"])


@query
def trajectory_digests(s, d):
    """Digests of every trajectory of shipped quantities and of its first frame, and how many trajectories share that."""
    strips = grids.shipment_tiles(s, d, tiles.SIDE, 84).withColumn("source_id", F.lit("ship"))
    with discarding(s):
        each = written(audit.strip_digests(strips), "frame-digests")  # read several times
        found = written(audit.digests_of_frames(each), "digests")
        shared = audit.shared_initial_states(found).select("initial", "trajectories")
        out = found.join(shared, "initial", "left").select("source_file_id", "sample_index", "digest", "initial", long(F.coalesce("trajectories", F.lit(1))).alias("sharing"))
        return written(out, "shared", outer=True)


@query
def file_verification(s, d):
    """Size and digest of every file of the given tables, read once, and found unchanged by a second run that opens none."""
    state = work_path(s, "file-state")
    with discarding(s):
        first = written(files.verify_files(s, d, state), "files")
        again = files.verify_files(s, d, state).select("path", F.col("sha256").alias("again"))
        changed = files.changed_files(s, d, state).select("path", F.lit(True).alias("changed"))
        name = F.regexp_extract("path", r"[^/]+\.parquet(/.*)?$", 0)
        out = first.join(again, "path").join(changed, "path", "left").select(name.alias("name"), long("size_bytes").alias("size_bytes"), "sha256", (F.col("sha256") == F.col("again")).alias("same"), F.coalesce("changed", F.lit(False)).alias("changed"))
        out = written(out, "verified", outer=True)
    removed(s, state)
    return out


# ---------------------------------------------------------------- sampling and plans


@query
def trajectory_split(s, d):
    """L1: 80/10/10 by hash rank."""
    return sampling.trajectory_splits(table(s, d, "customer").select(F.col("c_custkey").alias("trajectory")))


@query
def shape_pools(s, d):
    """G1: shapes up to the greatest part size and the number of nations by pool, and the parts that have each."""
    high = table(s, d, "part").agg(F.max("p_size").cast("int")).first()[0]  # two numbers
    wide = table(s, d, "nation").count()
    parts = table(s, d, "part").select(F.col("p_size").cast("int").alias("h"), (F.col("p_partkey") % wide + 1).cast("int").alias("w")).groupBy("h", "w").agg(F.count("*").alias("parts"))
    pools = sampling.shape_pools(s, (1, high), (1, wide)).join(parts, ["h", "w"], "left")
    return pools.select("h", "w", "anchor", "pool", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"))


@query
def evaluation_plan(s, d):
    """Corners with every field, then held-out and seen shapes in turn."""
    fields = [r.r_name for r in table(s, d, "region").orderBy("r_regionkey").collect()]  # field names are a parameter of the plan
    p = sampling.plan(s, sampling.shape_pools(s, (1, 32), (1, 24)), fields, 200, evaluation=True)
    return p.groupBy("part", "field").agg(F.count("*").alias("rows"))


@query
def fitting_tasks(s, d):
    """The tasks that parts' shapes allow: a part's size number sets its shape."""
    k = F.col("p_size")
    p = table(s, d, "part").select((k % 4 + 1).cast("int").alias("h"), (F.floor(k / 4) % 4 + 1).cast("int").alias("w"))
    return p.withColumn("task", F.explode(P.fitting_tasks(F.col("h"), F.col("w")))).groupBy("h", "w", "task").agg(F.count("*").alias("parts"))


@query
def balanced_quotas(s, d):
    """1000 states over the regions, then over the nations of each."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sampling.allocation(n.select("r_name", "n_name"), 1000, "r_name", "n_name")


@query
def trajectory_cycles(s, d):
    """Each nation's suppliers drawn 40 times, all before any repeats."""
    m = table(s, d, "supplier").select("s_nationkey", "s_suppkey")
    return sampling.cycled(m, "s_nationkey", "s_suppkey", 40).select("s_nationkey", "i", "s_suppkey", "cycle")


@query
def time_cycles(s, d):
    """12 time steps with a co-prime stride."""
    v = table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("visit"))
    return sampling.coprime_times(v, 12).select("key", "visit", "time")


@query
def weighted_tasks(s, d):
    """Three weighted parts per brand without replacement."""
    p = table(s, d, "part").withColumn("weight", (F.col("p_size") + 1).cast("double"))
    return sampling.weighted_order(p, "p_brand", "p_partkey", "weight", 3).select("p_brand", "p_partkey", "rank")


@query
def distinct_points(s, d):
    """L3: six distinct cells of each supplier's 7 x 7 grid, the first of a keyed random order."""
    v = table(s, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return v.select("s_suppkey", "i", N.permuted(F.col("i"), F.lit(49), 1, F.col("s_suppkey"), "points").alias("cell"))


@query
def sequential_tasks(s, d):
    """Four tasks per state, drawn one after the other: a capability's weight is shared by its tasks that are still there."""
    st = states(s, d)
    tasks = F.transform(P.fitting_tasks(F.col("h"), F.col("w")), lambda t: F.struct(t.alias("task"), L.capability(t).alias("kind")))
    weights = {"readout": 4.0, "localization": 3.0, "aggregation": 2.0, "composition": 1.0}
    drawn = st.select("state_ref", F.posexplode(sampling.sequential_draw(tasks, weights, 4, 1, F.col("state_ref"), "pick")).alias("i", "task"))
    return drawn.select("state_ref", (F.col("i") + 1).alias("rank"), "task")


@query
def budget_shortfall(s, d):
    """Tasks wanted and allowed on grids of many shapes: a part's type number sets its shape."""
    k = F.col("p_size")
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("state_ref"), F.col("p_brand").alias("split"), (k % 3 + 1).cast("int").alias("h"), (F.floor(k / 3) % 3 + 1).cast("int").alias("w"))
    made = p.select("state_ref", F.explode(P.fitting_tasks(F.col("h"), F.col("w"))).alias("task"))
    return sampling.shortfall(p, made, len(L.TASKS), "split", "state_ref").select("split", "groups", "wanted", long("selected").alias("selected"), long("missing").alias("missing"))


@query
def benchmark_requests(s, d):
    """12 requests per area bin, in turn over tasks, with the largest grid."""
    st = states(s, d).select("state_ref", "n", "field")
    rows = st.select(F.concat(F.lit("q"), F.col("n").cast("string")).alias("qa_id"), F.col("field").alias("task"), ((F.col("n") * 37) % 300 + 1).alias("cells"))
    binned = rows.withColumn("bin", L.area_bin(F.col("cells"), [64, 256])).filter("bin is not null")
    return sampling.round_robin(binned, "bin", ["task"], 12).select("bin", "qa_id", "task", "cells", "rank")


@query
def crop_quota(s, d):
    """2 distinct crops per label, in hash order."""
    c = states(s, d).select("field", (F.col("n") % 40).cast("string").alias("crop"))
    return sampling.quota(c, "field", "crop", 2).select("field", "crop", "i")


@query
def balanced_parts(s, d):
    """Suppliers in 7 contiguous parts."""
    return sampling.balanced_parts(table(s, d, "supplier").select("s_suppkey"), "s_suppkey", 7).select("s_suppkey", "part")


def _build_rows(s, d) -> DataFrame:
    """Programs of all states with the keys that builds count: split, family, file, trajectory, frame and corner."""
    n = F.col("n")
    st = states(s, d).select("state_ref", F.when(n % 10 < 8, "train").when(n % 10 == 8, "val").otherwise("test").alias("split"), F.when(n % 2 == 0, "even").otherwise("odd").alias("family"), (n % 6).alias("file"), (n % 50).alias("trajectory"), (n % 7).alias("time"), (n % 3).alias("top"), (n % 5).alias("from_left"))
    return P.with_geometry(fixed_programs(states(s, d))).join(st, "state_ref").withColumn("shape", L.shape_label(F.col("h"), F.col("w")))


@query
def build_counters(s, d):
    """Records and states of each split, by family, source, field, shape, task, capability and difficulty."""
    return audit.counters(_build_rows(s, d), "split", ["family", "source_id", "field", "shape", "task", "capability", "difficulty"])


@query
def coverage_counts(s, d):
    """Distinct files, trajectories, frames, corners, shapes and crops by split and source."""
    distinct = {"source_files": ["file"], "trajectories": ["file", "trajectory"], "field_trajectories": ["file", "field", "trajectory"], "field_frames": ["file", "field", "trajectory", "time"], "top_left_coordinates": ["top", "from_left"], "shapes": ["h", "w"], "sampled_crops": ["state_ref"]}
    return audit.coverage(_build_rows(s, d), ["split", "source_id"], distinct)


def event_frames(s, d) -> DataFrame:
    """Two sources of frames: event values by weekday and hour, per group of events, week and type; order prices by month and eighth of the month, per customer group, year and priority, with numbers of orders as a field without time, and over all customers as one without samples."""

    def frame(rows: DataFrame, h: int, w: int) -> DataFrame:
        """A frame for every trajectory, time and field of a source, cells without rows being zero."""
        kinds = rows.agg(F.max("time_index").alias("last"), F.array_sort(F.collect_set(F.struct("field_key", F.coalesce("component", F.lit(-1)).alias("component")))).alias("fields")).first()  # a source's few fields
        names = F.array(*[F.struct(F.lit(x.field_key).alias("field_key"), F.lit(None if x.component < 0 else x.component).cast("int").alias("component")) for x in kinds.fields or []])
        times = F.array(F.lit(None).cast("int")) if kinds.last is None else F.sequence(F.lit(0), F.lit(kinds.last))
        every = rows.select(*keys[:3], "sample_index").distinct().withColumn("time_index", F.explode(times)).withColumn("f", F.explode(names)).select("*", "f.*").drop("f")
        sums = rows.groupBy(*keys, "cell").agg((F.sum("c") / 100).alias("v")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"))
        met = every.alias("a").join(sums.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
        values = F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        return met.select(*[F.col(f"a.{k}") for k in keys], F.lit(h).alias("height"), F.lit(w).alias("width"), values.alias("values"))

    keys = ["source_id", "family", "source_file_id", "field_key", "component", "sample_index", "time_index"]
    none = F.lit(None).cast("int")
    e = table(s, d, "events").select(F.lit("evt").alias("source_id"), F.lit("use").alias("family"), F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")).alias("source_file_id"), F.col("event_type").alias("field_key"), none.alias("component"), (F.col("event_id") % 48).cast("int").alias("sample_index"), (F.floor((F.dayofyear("ts") - 1) / 7)).cast("int").alias("time_index"), ((F.dayofweek("ts") - 1) * 24 + F.hour("ts")).alias("cell"), F.round(F.col("value") * 100).alias("c"))
    o = table(s, d, "orders").withColumn("cell", (F.month("o_orderdate") - 1) * 8 + F.least(F.floor((F.dayofmonth("o_orderdate") - 1) / 4), F.lit(7)).cast("int"))
    trade = [F.lit("ord").alias("source_id"), F.lit("trade").alias("family"), F.lit("o0").alias("source_file_id")]
    p = o.select(*trade, F.lit("price").alias("field_key"), (F.ascii("o_orderpriority") - 49).alias("component"), (F.col("o_custkey") % 40).cast("int").alias("sample_index"), (F.year("o_orderdate") - 1992).cast("int").alias("time_index"), "cell", F.round("o_totalprice").alias("c"))
    k = o.select(*trade, F.lit("count").alias("field_key"), none.alias("component"), (F.col("o_custkey") % 40).cast("int").alias("sample_index"), none.alias("time_index"), "cell", F.lit(100.0).alias("c"))
    u = o.select(*trade, F.lit("season").alias("field_key"), none.alias("component"), none.alias("sample_index"), none.alias("time_index"), "cell", F.lit(100.0).alias("c"))
    out = frame(e, 7, 24)
    for x in (p, k, u):
        out = out.unionByName(frame(x, 12, 8))
    return out


BUILD = BuildConfig(train_states=240, eval_states=48, heights=(1, 7), widths=(1, 8), tasks_per_state=5, capability_weights={"localization": 2.0}, diagnostic_states=4)


def built(s, d) -> Dataset:
    return build_dataset(s, event_frames(s, d), BUILD)


@query
def dataset_build(s, d):
    """States with exact budgets over families and sources, crops, programs and records; their counters."""
    return built(s, d).counters()


@query
def dataset_audit(s, d):
    """Rule breaks of a build (none): what the loader of its published set checks, leaves that differ from the digest trees, budgets, repeated crops, shared trajectories, replay."""
    folder = work_path(s, "dataset")
    publish(built(s, d), folder, BUILD)
    data, version = load_dataset(s, folder, scan=True)
    checks = dataset_problems(version).select("problem").unionByName(versions.damage(version).select(F.concat(F.lit("damaged_"), "name").alias("problem")))
    split = data.states.groupBy("split").agg(F.count("*").alias("n")).filter("n <> case when split = 'train' then 240 else 48 end").select(F.lit("budget").alias("problem"))
    repeated = audit.repeated_ids(data.states, "state_ref").select(F.lit("repeated_crop").alias("problem"))
    moving = data.states.filter("sample_index is not null").withColumn("trajectory", F.concat_ws("/", "source_id", "source_file_id", "sample_index"))
    shared = audit.overlaps(moving, "trajectory", "split").select(F.lit("shared_trajectory").alias("problem"))
    replay = P.tampered(data.records, data.grids).select("problem")
    every = checks.unionByName(split).unionByName(repeated).unionByName(shared).unionByName(replay)
    with discarding(s):
        out = written(every.groupBy("problem").agg(F.count("*").alias("n")), "problems", outer=True)
    removed(s, folder)
    return out


@query
def template_partitions(s, d):
    """Of all records' wordings, those of each split, how many another split has, too, and the records."""
    split = F.coalesce(*[F.when(F.col("template_family").isin(*names), k) for k, names in L.TEMPLATES.items()])
    rows = records(s, d, L.TEMPLATES["train"] + L.TEMPLATES["val"] + L.TEMPLATES["test"]).select(split.alias("split"), "template_family").groupBy("split", "template_family").agg(F.count("*").alias("n"))
    shared = audit.overlaps(rows, "template_family", "split")
    return rows.join(shared, "template_family", "left").groupBy("split").agg(F.count("*").alias("templates"), F.count("parts").alias("shared"), F.sum("n").alias("records"))


@query
def prompt_lengths(s, d):
    """Least, greatest and mean length of the full-matrix prompts."""
    return batching.length_summary(full_matrix_prompt(s, d).select(F.length("prompt").alias("n")), "n")


# ---------------------------------------------------------------- batches, budgets, features


def _requests(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("h"), (F.col("o_custkey") % 3 + 1).cast("int").alias("w"), (F.col("o_totalprice") % 997 + 1).cast("int").alias("tokens"))


@query
def shape_batches(s, d):
    """Batches of 32 per shape, and their sizes."""
    return batching.batch_statistics(batching.shape_batches(_requests(s, d), 32, 1, 0), 32).select("batches", long("total").alias("total"), "least", "most", F.round("mean", 9).alias("mean"), "partial")


@query
def planned_updates(s, d):
    """Updates of 3 epochs with accumulation 4."""
    return batching.planned_updates(_requests(s, d), 32, 3, 4)


@query
def padding_share(s, d):
    """Padding when a shape's rows form one batch."""
    return batching.padding_fraction(_requests(s, d), ["h", "w"], "tokens").select(F.round("padding_fraction", 9).alias("padding_fraction"))


@query
def token_preflight(s, d):
    """Reports of three parts merged."""
    r = _requests(s, d)
    parts = [batching.token_report(r.filter(f"id % 3 = {k}"), 900) for k in range(3)]
    return batching.merged_reports(parts[0].union(parts[1]).union(parts[2])).select(long("rows").alias("rows"), "longest", "longest_id", long("over").alias("over"))


@query
def token_examples(s, d):
    """the first eight rows over the limit."""
    return batching.first_over(_requests(s, d), 900).select("id", "tokens")


def _token_rows(s: SparkSession, d: str) -> DataFrame:
    """A question per order: its price and customer as token counts."""
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("position"), F.concat(F.lit("o"), "o_orderkey").alias("qa_id"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("template_family"),
        (F.floor("o_totalprice") % 400).cast("int").alias("prompt_tokens"), (F.col("o_custkey") % 45).cast("int").alias("target_tokens"), (F.col("o_orderkey") % 5).alias("part"),
    )


@query
def token_budgets(s, d):
    """Reports of five parts merged per template, with the first eight questions over a limit."""
    parts = batching.token_budget_report(_token_rows(s, d), 380, 42, ["template_family", "part"])
    out = batching.merged_token_reports(parts, ["template_family"])
    return out.select(
        "template_family", long("questions").alias("questions"), long("max_prompt_tokens").alias("max_prompt_tokens"), F.col("max_prompt_record.qa_id").alias("max_prompt_qa_id"), long("max_target_tokens").alias("max_target_tokens"), F.col("max_target_record.qa_id").alias("max_target_qa_id"),
        long("prompt_overflow").alias("prompt_overflow"), long("target_overflow").alias("target_overflow"), long("overflow").alias("overflow"), F.array_join(F.transform("examples", lambda x: x["qa_id"]), ",").alias("examples"), "status",
    )


@query
def balanced_shards(s, d):
    """customers' orders in 6 shards, a customer in one: rows, states, states in several shards, and whether the fullest keeps its bound."""
    o = table(s, d, "orders").select(F.concat(F.lit("c"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).cast("string")).alias("state_ref"))
    with discarding(s):
        placed = written(batching.least_loaded_shards(o, 6), "shards")
        loads = placed.groupBy("shard").agg(F.sum("n").alias("load"))
        most = placed.agg(F.sum("n").alias("rows"), F.count("*").alias("states"), F.countDistinct("state_ref").alias("distinct"), F.max("n").alias("largest"))
        both = most.withColumn("one", F.lit(1)).join(loads.agg(F.max("load").alias("fullest"), F.count("*").alias("shards")).withColumn("one", F.lit(1)), "one")
        bound = F.greatest(F.col("rows") / 6 * 4 / 3, F.col("largest")) + F.col("rows") / 6 / 16 + 1
        return written(both.select(long("rows").alias("rows"), F.col("distinct").alias("states"), (F.col("states") - F.col("distinct")).alias("split_states"), "shards", (F.col("fullest") <= bound).alias("within")), "summary", outer=True)


@query
def strided_merge(s, d):
    """Vectors of every third item put together."""
    r = _requests(s, d).select(F.col("id").alias("i"), "tokens")
    parts = r.select((F.col("i") % 3).alias("part"), F.lit(3).alias("parts"), F.floor(F.col("i") / 3).alias("k"), F.col("tokens").alias("length"))
    return batching.merge_strided(parts).select("i", long("length").alias("length"))


@query
def running_offsets(s, d):
    """E5: tokens before each order."""
    return batching.running_offsets(_requests(s, d), "id", "tokens").select("id", long("offset").alias("offset"))


@query
def field_runs(s, d):
    """Runs of equal priority in each customer's orders."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return batching.field_runs(o, "o_custkey", "o_orderkey", "o_orderpriority").groupBy("o_custkey").agg((F.max("run") + 1).alias("runs"))


@query
def length_balance(s, d):
    """Rows per part of length-balanced batches of 48 over 3 parts."""
    r = _requests(s, d).select(F.floor(F.col("id") / 48).cast("int").alias("batch"), "id", F.col("tokens").alias("length"))
    return batching.length_balanced(r, 3).groupBy("batch").agg(F.count("*").alias("rows"), F.countDistinct("part").alias("parts"))


@query
def state_shards(s, d):
    """The shard of each state, with its rows and shards (one)."""
    rows = batching.state_shards(fixed_programs(states(s, d)), 8)
    return rows.groupBy("state_ref").agg(F.min("shard").alias("shard"), F.countDistinct("shard").alias("shards"), F.count("*").alias("rows"))


@query
def geometry_extrema(s, d):
    """first rows with the most cells, height, width and aspect."""
    return batching.geometry_extrema(_requests(s, d))


@query
def block_tokens(s, d):
    """H8: 3 x 3 block tokens with padding masks."""
    return batching.block_tokens(cells(s, d), 3, 3).select("state_ref", "token", "slot", "z", "mask")


@query
def masked_loss(s, d):
    """Mean masked smooth-L1 between neighbouring slots."""
    t = batching.block_tokens(cells(s, d), 3, 3).withColumn("zero", F.lit(0.25))
    return batching.masked_smooth_l1(t, "z", "zero", "mask").select(F.round("loss", 9).alias("loss"))


@query
def channel_scaling(s, d):
    """Quantities scaled by return flag, and restored."""
    v = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("ch"), F.col("l_quantity").alias("v"))
    y = normalize.scale_channels(v, "minmax", ["ch"], clip=0.9)
    return y.groupBy("ch").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("y") * 1000)), 0).alias("total"), F.min("a").alias("a"), F.round(F.max("y"), 9).alias("most"))


@query
def value_basis(s, d):
    """H7: the value features of every cell."""
    z = F.col("z")
    names = ("z", "tanh", "abs", "sign", "sin0", "cos0", "sin1", "cos1")
    return cells(s, d).select("state_ref", "r", "c", *batching.value_basis(z)).select("state_ref", "r", "c", *[(F.round(n, 9) + 0.0).alias(n) for n in names])


@query
def positions(s, d):
    """H7: sinusoidal positions of the nations' keys."""
    p = batching.sinusoidal_positions(table(s, d, "nation").select(F.col("n_nationkey").alias("p")), 4)
    return p.select("p", *[(F.round(c, 9) + 0.0).alias(c) for c in ("sin0", "cos0", "sin1", "cos1")])


@query
def schedule(s, d):
    """H7: warm-up and cosine decay by step."""
    return table(s, d, "nation").select(F.col("n_nationkey").alias("step"), F.round(N.warmup_cosine(F.col("n_nationkey"), 5, 25, 0.1), 9).alias("factor"))


@query
def integer_functions(s, d):
    """Divisor, ceiling, bits and powers of two of part sizes."""
    p, k = table(s, d, "part"), F.col("p_size")
    return p.select("p_partkey", long(N.gcd(F.col("p_partkey") * 7, F.lit(3360))).alias("gcd"), N.ceil_div(k, 7).alias("pieces"), N.cost_bucket(k + 1).alias("bits"), N.floor_power_of_two(k).alias("power"))


@query
def exact_rounding(s, d):
    """H5: fractions k/n at one, two and three decimals, by their exact binary value."""
    li = table(s, d, "lineitem").select((F.col("l_partkey") % 2000).alias("k"), (F.col("l_suppkey") % 97 + 1).alias("n")).distinct()
    v = F.col("k") / F.col("n")
    return li.select("k", "n", *[N.exact_round(v, i).alias(f"r{i}") for i in (1, 2, 3)])


@query
def half_precision(s, d):
    """H6: prices over their quantity as half-precision numbers."""
    li = table(s, d, "lineitem").select((F.col("l_extendedprice") / 1000 / F.col("l_quantity")).alias("v")).distinct()
    return li.select("v", N.fp16(F.col("v")).alias("half"))


@query
def count_buckets(s, d):
    """Buckets of part sizes squared."""
    n = (F.col("p_size") * F.col("p_size")).cast("int")
    return table(s, d, "part").select("p_partkey", L.count_bucket(n).alias("bucket"), L.difficulty(n).alias("difficulty"))


@query
def shape_parser(s, d):
    """Shapes written as text."""
    t = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "X").when(F.col("p_partkey") % 3 == 1, "x").otherwise("by"), (F.col("p_size") % 9).cast("string"))
    x = table(s, d, "part").select("p_partkey", L.parse_shape(t).alias("x"))
    return x.select("p_partkey", "x.h", "x.w", "x.ok")


@query
def path_safety(s, d):
    """Safe and unsafe paths made of part names."""
    pre = F.element_at(F.array(*[F.lit(x) for x in ("a/", "/a/", "../", "a/./", "c:", "a//", "a\\", "")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", L.safe_path(F.concat(pre, F.lit("f.h5"))).alias("safe"))


@query
def efficiency_summary(s, d):
    """Quantiles, throughput and peaks of timed requests."""
    e = batching.efficiency(_timings(s, d))
    ints = ("attempts", "unique_questions", "completed", "length_limited", "out_of_memory")
    return e.select("method", "decode_mode", "bin", *ints, *[F.round(c, 7).alias(c) for c in e.columns if c not in ints and c not in ("method", "decode_mode", "bin")])


@query
def paired_speed(s, d):
    """Time ratio of paired requests."""
    return batching.paired_speed(_timings(s, d)).select("decode_mode", "bin", "pairs", *[F.round(c, 9).alias(c) for c in ("time_ratio", "slow_tokens_mean", "fast_tokens_mean")])


def _timings(s, d) -> DataFrame:
    k = F.col("event_id")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.floor(k / 7) % len(x) + 1).cast("int"))
    return table(s, d, "events").select(
        F.when(k % 2 == 0, "serialized").otherwise("interface").alias("method"), F.when(F.floor(k / 2) % 2 == 0, "natural").otherwise("fixed").alias("decode_mode"), F.concat(F.lit("cells_"), (F.floor(k / 4) % 3).cast("string")).alias("bin"),
        F.concat(F.lit("q"), F.floor(k / 2).cast("string")).alias("qa_id"), F.lit(0).alias("repeat"), pick("complete", "fixed_length", "length_limit", "complete", "oom").alias("status"),
        ((k % 89) / 4.0 + 1).alias("request_ms"), F.when(k % 5 != 0, (k % 17) / 8.0).alias("ttft_ms"), (k % 33).alias("generated_tokens"), ((k % 41) / 16.0).alias("peak_gib"),
    )


def entry(s: SparkSession, d: str) -> DataFrame:
    """The flagship query: metrics of scored answers along every dimension."""
    return score_summary(s, d)
