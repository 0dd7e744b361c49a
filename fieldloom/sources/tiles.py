"""Large fields as stores of tiles, so that a crop reads only the tiles that it touches.

A store is a Parquet table of tiles in order of file, field, sample, time and place, and a layout
row per field that declares its shape. Filters on file, sample, time and tile rows and columns reach
the scan, which skips row groups and pages by their statistics; many crops at once meet their tiles by an
equality join. No frame is ever one row, so fields may be of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import removed, work_path

#: What names a frame: nulls as crop_states has them.
FRAME = ("source_file_id", "field_key", "component", "sample_index", "time_index")
FIELD = FRAME[:3]
SIDE = 64
#: Tiles of a page: what a scan reads or skips at once, by the pages' least and greatest values.
PAGE_ROWS = 64
BYTES = 8
TILES = "source_file_id string, field_key string, component int, sample_index int, time_index int, height int, width int, tr int, tc int, values array<double>"
LAYOUT = "source_file_id string, field_key string, component int, samples int, times int, height int, width int, side int, dtype string, value_count long, bytes long"


def _extent(size: str, index: str, side: int) -> Column:
    """Cells of a tile along one axis: the last one may be short."""
    return F.least(F.lit(side), F.col(size) - F.col(index) * side)


def tiles_of_cells(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles (TILES) of cells (FRAME, height, width, r, c, x), one-based; cells that are missing are missing in the tile, too, which layout_problems() finds."""
    placed = cells.withColumn("tr", F.floor((F.col("r") - 1) / side).cast("int")).withColumn("tc", F.floor((F.col("c") - 1) / side).cast("int"))
    packed = placed.groupBy(*FRAME, "height", "width", "tr", "tc").agg(F.array_sort(F.collect_list(F.struct("r", "c", "x"))).alias("cells"))  # side * side at most
    return packed.select(*FRAME, "height", "width", "tr", "tc", F.transform("cells", lambda v: v["x"]).alias("values"))


def tiles_within(values: str, height: str, width: str, side: int) -> Column:
    """array<struct<tr,tc,values>>: the tiles of one row-major array. Cells are taken one by one, since a slice copies its whole array, and the array isn't repeated on a row for each tile."""
    many = lambda size: F.sequence(F.lit(0), F.ceil(F.col(size) / side).cast("int") - 1)
    ends = lambda size, index: F.least(F.lit(side), F.col(size) - index * side)

    def tile(tr: Column, tc: Column) -> Column:
        wide = ends(width, tc)
        place = lambda i: (tr * side + F.floor(i / wide)) * F.col(width) + tc * side + i % wide
        cells = F.transform(F.sequence(F.lit(0), ends(height, tr) * wide - 1), lambda i: F.get(values, place(i).cast("int")))
        return F.struct(tr.alias("tr"), tc.alias("tc"), cells.alias("values"))

    return F.flatten(F.transform(many(height), lambda tr: F.transform(many(width), lambda tc: tile(tr, tc))))


def tiles_of_frames(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of frames (FRAME, height, width, values row-major), cut without a shuffle."""
    return frames.select(*FRAME, "height", "width", F.explode(tiles_within("values", "height", "width", side)).alias("t")).select(*FRAME, "height", "width", "t.*")


@dataclass
class TileStore:
    """tiles (TILES) and layout (LAYOUT) of a store with tiles of side x side cells."""

    tiles: DataFrame
    layout: DataFrame
    side: int
    path: str

    @staticmethod
    def open(spark: SparkSession, path: str) -> TileStore:
        layout = spark.read.schema(LAYOUT).parquet(f"{path}/layout")
        return TileStore(spark.read.schema(TILES).parquet(f"{path}/tiles"), layout, layout.agg(F.max("side")).first()[0] or SIDE, path)

    def remove(self) -> None:
        removed(self.tiles.sparkSession, self.path)


def write_store(tiles: DataFrame, side: int = SIDE, path: str | None = None) -> TileStore:
    """A new store of these tiles; the layout declares the shape that the tiles imply. A path that exists fails."""
    spark = tiles.sparkSession
    path = path or work_path(spark, "tiles")
    order = [*FRAME, "tr", "tc"]
    ordered = tiles.select(*[F.col(c.split()[0]) for c in TILES.split(", ")]).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("errorifexists").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/tiles")
    stored = spark.read.schema(TILES).parquet(f"{path}/tiles")
    seen = stored.groupBy(*FIELD).agg(
        F.max(F.col("sample_index") + 1).alias("samples"), F.max(F.col("time_index") + 1).alias("times"), F.max("height").alias("height"), F.max("width").alias("width"),
        F.lit(side).alias("side"), F.lit("float64").alias("dtype"), F.sum(F.size("values")).cast("long").alias("value_count"),
    )
    seen.withColumn("bytes", F.col("value_count") * BYTES).write.parquet(f"{path}/layout")
    return TileStore.open(spark, path)


def declared_shape() -> Column:
    """The number of values that a layout row's shape stands for: samples where the field varies by sample, times where it varies by time, rows and columns."""
    return F.coalesce("samples", F.lit(1)).cast("long") * F.coalesce("times", F.lit(1)) * F.col("height") * F.col("width")


def layout_problems(store: TileStore) -> DataFrame:
    """(source_file_id, field_key, component, problem) of fields whose tiles aren't as their layout declares, by one scan of all values."""
    side, values = store.side, F.col("values")
    broken = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    marked = store.tiles.select(
        *FRAME, "height", "width", "tr", "tc", F.size(values).alias("n"), (_extent("height", "tr", side) * _extent("width", "tc", side)).alias("wanted"), F.exists(values, broken).alias("broken"),
    )
    frames = F.struct(F.col("sample_index"), F.col("time_index"))
    found = marked.groupBy(*FIELD).agg(
        F.count("*").alias("tiles"), F.countDistinct(F.struct(frames, F.col("tr"), F.col("tc"))).alias("places"), F.countDistinct(frames).alias("frames"), F.countDistinct("height", "width").alias("shapes"),
        F.max("height").alias("h"), F.max("width").alias("w"), F.sum(F.col("n").cast("long")).alias("n"), F.sum((F.col("n") != F.col("wanted")).cast("int")).alias("short"), F.sum(F.col("broken").cast("int")).alias("broken"),
        F.max("sample_index").alias("last_sample"), F.max("time_index").alias("last_time"), F.count("sample_index").alias("sampled"), F.count("time_index").alias("timed"),
    )
    told = store.layout.select(*[F.col(c).alias(f"l_{c}") for c in FIELD], "samples", "times", "height", "width", "dtype", "value_count", "bytes")
    both = found.join(told, [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in FIELD], "full")
    here, said = F.col("tiles").isNotNull(), F.col("dtype").isNotNull()
    frames_said = F.coalesce("samples", F.lit(1)) * F.coalesce("times", F.lit(1))
    per_frame = F.ceil(F.col("height") / side) * F.ceil(F.col("width") / side)
    index = lambda count, last, seen: F.when(F.col(count).isNull(), F.col(seen) > 0).otherwise((F.col(seen) != F.col("tiles")) | (F.col(last) != F.col(count) - 1))
    rules = {
        "undeclared": here & ~said, "absent": said & ~here, "dtype": F.col("dtype") != "float64", "shape": (F.col("shapes") > 1) | (F.col("h") != F.col("height")) | (F.col("w") != F.col("width")),
        "samples": said & index("samples", "last_sample", "sampled"), "times": said & index("times", "last_time", "timed"), "frames": said & (F.col("frames") != frames_said),
        "missing_tiles": F.col("places") < frames_said * per_frame, "repeated_tiles": F.col("tiles") > F.col("places"), "short_tiles": F.col("short") > 0, "not_finite": F.col("broken") > 0,
        "value_count": (F.col("n") != F.col("value_count")) | (F.col("value_count") != declared_shape()), "bytes": F.col("bytes") != F.col("value_count") * BYTES,
    }
    named = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return both.select(*[F.coalesce(c, f"l_{c}").alias(c) for c in FIELD], F.explode(named).alias("problem"))


def row_pieces(side: int) -> Column:
    """Of a tile that overlaps the rectangle (top, left, h, w): (r, c, values) of each row's part inside, zero-based places of the frame."""
    r0, r1 = F.greatest(F.col("top"), F.col("tr") * side), F.least(F.col("top") + F.col("h"), F.col("tr") * side + _extent("height", "tr", side)) - 1
    c0, c1 = F.greatest(F.col("left"), F.col("tc") * side), F.least(F.col("left") + F.col("w"), F.col("tc") * side + _extent("width", "tc", side)) - 1
    first = lambda r: (r - F.col("tr") * side) * _extent("width", "tc", side) + c0 - F.col("tc") * side + 1
    return F.transform(F.sequence(r0, r1), lambda r: F.struct(r.alias("r"), c0.alias("c"), F.slice("values", first(r), c1 - c0 + 1).alias("v")))


def read_region(store: TileStore, file: str, field: str, component: int | None, sample: int | None, time: int | None, top: int, left: int, h: int, w: int) -> DataFrame:
    """(tr, tc, pieces) of one rectangle: filters on the frame and on tile rows and columns reach the scan."""
    last = lambda a, n: (a + n - 1) // store.side
    named = zip(FRAME, (file, field, component, sample, time), strict=True)
    wanted = F.lit(True)
    for name, value in named:
        wanted = wanted & (F.col(name).isNull() if value is None else F.col(name) == value)
    rows = store.tiles.filter(wanted & F.col("tr").between(top // store.side, last(top, h)) & F.col("tc").between(left // store.side, last(left, w)))
    return rows.withColumn("top", F.lit(top)).withColumn("left", F.lit(left)).withColumn("h", F.lit(h)).withColumn("w", F.lit(w)).select("tr", "tc", row_pieces(store.side).alias("pieces"))


def read_crops(store: TileStore, states: DataFrame, value: str = "x") -> DataFrame:
    """states (FRAME, top, left, h, w, state_ref) with each one's rectangle of its own frame, row-major, as crop_states() has it.

    Each state asks for the tiles it touches; the range of frames and tiles that all of them ask for
    reaches the scan. A state without a frame, and a rectangle that leaves its frame, fail the job.
    """
    side = store.side
    span = lambda a, n: F.sequence(F.floor(F.col(a) / side).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / side).cast("int"))
    asks = states.select("state_ref", *FRAME, "top", "left", "h", "w", F.explode(span("top", "h")).alias("tr")).select("*", F.explode(span("left", "w")).alias("tc"))
    ends = asks.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("source_file_id", "sample_index", "time_index", "tr", "tc") for f in (F.min, F.max)]).first()  # one row
    some = store.tiles
    for c in ("source_file_id", "sample_index", "time_index", "tr", "tc"):
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        if low is not None:
            inside = F.col(c).between(low, high)
            some = some.filter(inside if c in ("source_file_id", "tr", "tc") else inside | F.col(c).isNull())
    named = some.select(*[F.col(k).alias(f"t_{k}") for k in FRAME], "height", "width", F.col("tr").alias("t_tr"), F.col("tc").alias("t_tc"), "values")
    met = asks.join(named, [*[F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in FRAME], F.col("tr") == F.col("t_tr"), F.col("tc") == F.col("t_tc")], "left")
    inside = (F.col("top") >= 0) & (F.col("left") >= 0) & (F.col("top") + F.col("h") <= F.col("height")) & (F.col("left") + F.col("w") <= F.col("width"))
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<struct<r:int,c:int,v:array<double>>>")
    read = F.when(F.col("width").isNull(), fail("a state has no frame, or leaves it")).when(~inside, fail("a crop leaves its frame")).otherwise(row_pieces(side))
    parts = met.select("state_ref", read.alias("pieces"))
    whole = parts.groupBy("state_ref").agg(F.array_sort(F.flatten(F.collect_list("pieces"))).alias("rows"))  # as many values as the crop has
    return states.join(whole.select("state_ref", F.flatten(F.transform("rows", lambda p: p["v"])).alias(value)), "state_ref")


