"""Columnar tables seen as grids of raw cells: (state_ref, source_id, field, trajectory, h, w, r, c, x), one-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIDE = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _within(name: str, most: int) -> Column:
    """The column, which has to lie in 1 ... most: a row outside would be missed silently."""
    return F.when(F.col(name).between(1, most), F.col(name)).otherwise(F.raise_error(F.lit(f"{name} lies outside the grid")).cast("int"))


def embedding_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector of 64 as an 8 x 8 grid."""
    long = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return long.select(
        F.concat(F.lit("emb:"), F.col("vec_id").cast("string")).alias("state_ref"), F.lit("emb").alias("source_id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("field"),
        F.col("vec_id").alias("trajectory"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"),
        (F.floor(F.col("i") / SIDE) + 1).cast("int").alias("r"), (F.col("i") % SIDE + 1).cast("int").alias("c"), F.col("v").cast("double").alias("x"),
    )


def embedding_grids(spark: SparkSession, folder: str) -> DataFrame:
    """(state_ref, h, w, x): the same grids as row-major arrays."""
    values = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, folder, "embeddings").select(F.concat(F.lit("emb:"), F.col("vec_id").cast("string")).alias("state_ref"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), values.alias("x"))


def event_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Per event type the mean value by day (30) and hour (24), in hundredths so that sums are exact; hours without events are 0."""
    e = table(spark, folder, "events")
    day = (F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 86400) + 1).cast("int")
    sums = e.select("event_type", day.alias("r"), (F.hour("ts") + 1).alias("c"), F.round(F.col("value") * 100).cast("bigint").alias("cents")).withColumn("r", _within("r", 30)).groupBy("event_type", "r", "c").agg((F.sum("cents") / F.count("*") / 100.0).alias("x"))
    frame = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("r")).select("event_type", "r", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("c"))
    full = frame.join(sums, ["event_type", "r", "c"], "left")
    return full.select(F.concat(F.lit("evt:"), "event_type").alias("state_ref"), F.lit("evt").alias("source_id"), F.col("event_type").alias("field"), F.xxhash64("event_type").alias("trajectory"), F.lit(30).alias("h"), F.lit(24).alias("w"), "r", "c", F.coalesce("x", F.lit(0.0)).alias("x"))


def lineitem_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Per supplier the mean discount by line number (7) and ship year (1995-2001), in hundredths; missing cells are 0."""
    li = table(spark, folder, "lineitem")
    sums = li.select("l_suppkey", F.col("l_linenumber").alias("r"), (F.year("l_shipdate") - 1994).alias("c"), F.round(F.col("l_discount") * 100).cast("bigint").alias("cents")).withColumn("r", _within("r", 7)).withColumn("c", _within("c", 7)).groupBy("l_suppkey", "r", "c").agg((F.sum("cents") / F.count("*") / 100.0).alias("x"))
    frame = li.select("l_suppkey").distinct().select("l_suppkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("r")).select("l_suppkey", "r", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("c"))
    full = frame.join(sums, ["l_suppkey", "r", "c"], "left")
    return full.select(F.concat(F.lit("lin:"), F.col("l_suppkey").cast("string")).alias("state_ref"), F.lit("lin").alias("source_id"), F.lit("discount").alias("field"), F.col("l_suppkey").alias("trajectory"), F.lit(7).alias("h"), F.lit(7).alias("w"), "r", "c", F.coalesce("x", F.lit(0.0)).alias("x"))


def dense(cells: str, size: Column) -> Column:
    """A row-major array of size cells from the sparse ones (array<struct<at int, x double>>, at from 0, each once): 0 where there is none, by runs between neighbours rather than by a look-up for each cell."""
    entries, zeros = F.array_sort(cells), lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    run = lambda v: F.transform(v, lambda e, i: F.concat(F.array(e["x"]), zeros(F.coalesce(F.get(v, i + 1)["at"], size) - e["at"] - 1)))
    full = lambda v: F.when(F.size(v) == 0, zeros(size)).otherwise(F.concat(zeros(F.get(v, F.lit(0))["at"]), F.flatten(run(v))))
    return F.get(F.transform(F.array(entries), full), F.lit(0))  # sorted once


def shipment_tiles(spark: SparkSession, folder: str, high: int, wide: int) -> DataFrame:
    """Quantities shipped by supplier (rows) and month (84 columns), a frame for each return flag (file), line status (sample) and line number (time), in tiles of high x wide cells: (source_file_id, field_key, component, sample_index, time_index, height, width, tr, tc, values), 0 where nothing was shipped.

    Only cells with shipments are shuffled; each tile fills itself up. Tiles without any come from the list of all tiles.
    """
    li, months = table(spark, folder, "lineitem"), 84
    low, most = table(spark, folder, "supplier").agg(F.min("s_suppkey").cast("int"), F.max("s_suppkey").cast("int")).first()  # two numbers
    height = most - low + 1
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int")
    frame = ["l_returnflag", "l_linestatus", "l_linenumber"]
    sums = li.select(*frame, (F.col("l_suppkey").cast("int") - low + 1).alias("r"), month.alias("c"), "l_quantity").withColumn("r", _within("r", height)).withColumn("c", _within("c", months))
    sums = sums.groupBy(*frame, "r", "c").agg(F.sum("l_quantity").alias("x"))
    place = lambda c, side: F.floor((F.col(c) - 1) / side).cast("int")
    tall, broad = F.least(F.lit(high), height - F.col("tr") * high), F.least(F.lit(wide), months - F.col("tc") * wide)
    at = ((F.col("r") - 1 - F.col("tr") * high) * broad + F.col("c") - 1 - F.col("tc") * wide).cast("int")
    cells = sums.withColumn("tr", place("r", high)).withColumn("tc", place("c", wide)).select(*frame, "tr", "tc", F.struct(at.alias("at"), F.coalesce("x", F.lit(0.0)).alias("x")).alias("cell"))
    strips = spark.range(-(-height // high)).select(F.col("id").cast("int").alias("tr"))
    every = strips.crossJoin(F.broadcast(li.select(*frame).distinct())).select(*frame, "tr", F.explode(F.sequence(F.lit(0), F.lit(-(-months // wide) - 1))).alias("tc"))
    met = cells.unionByName(every.withColumn("cell", F.lit(None).cast(cells.schema["cell"].dataType))).groupBy(*frame, "tr", "tc").agg(F.collect_list("cell").alias("cells"))  # high * wide at most
    return met.select(
        F.col("l_returnflag").alias("source_file_id"), F.lit("quantity").alias("field_key"), F.lit(None).cast("int").alias("component"), (F.col("l_linestatus") == "O").cast("int").alias("sample_index"), (F.col("l_linenumber") - 1).cast("int").alias("time_index"),
        F.lit(height).alias("height"), F.lit(months).alias("width"), "tr", "tc", dense("cells", tall * broad).alias("values"),
    )


def crop(cells: DataFrame, top: int, left: int, h: int, w: int) -> DataFrame:
    """Cells of the rectangle at the zero-based corner (top, left), with one-based coordinates of their own."""
    inside = cells.filter(F.col("r").between(top + 1, top + h) & F.col("c").between(left + 1, left + w))
    return inside.withColumn("r", F.col("r") - top).withColumn("c", F.col("c") - left).withColumn("h", F.lit(h)).withColumn("w", F.lit(w))


def crop_states(frames: DataFrame, states: DataFrame, value: str = "x") -> DataFrame:
    """states with (h, w, x): each state's rectangle of its own frame, row-major.

    frames: (source_file_id, field_key, component, sample_index, time_index, height, width, values):
    a static field has null as time, one that all samples share null as sample, a scalar field null
    as component; nulls meet nulls. states: the same five keys, top, left (zero-based), h, w. A
    state without a frame, and a rectangle that leaves its frame, fail the job.
    """
    keys = ["source_file_id", "field_key", "component", "sample_index", "time_index"]
    named = frames.select(*[F.col(k).alias(f"f_{k}") for k in keys], "height", "width", "values")
    met = states.join(named, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in keys], "left")
    inside = (F.col("top") >= 0) & (F.col("left") >= 0) & (F.col("top") + F.col("h") <= F.col("height")) & (F.col("left") + F.col("w") <= F.col("width"))
    rows = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.slice("values", (F.col("top") + i) * F.col("width") + F.col("left") + 1, F.col("w")))
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<double>")
    read = F.when(F.col("width").isNull(), fail("a state has no frame")).when(~inside, fail("a crop leaves its frame")).otherwise(F.flatten(rows))
    return met.select(*[states[c] for c in states.columns], read.alias(value))


def components(frames: DataFrame, key: str = "field", vector: str = "vector") -> DataFrame:
    """Vector-valued cells as scalar fields key[0], key[1], ...; other columns stay."""
    rest = [c for c in frames.columns if c not in (key, vector)]
    return frames.select(*rest, key, F.posexplode(vector).alias("component", "x")).withColumn(key, F.concat(F.col(key), F.lit("["), F.col("component").cast("string"), F.lit("]")))


def grids_of(cells: DataFrame, value: str = "z") -> DataFrame:
    """(state_ref, h, w, z array<double>): each grid in row-major order. A grid is one row, as its source's shape bounds it."""
    packed = cells.groupBy("state_ref", "h", "w").agg(F.array_sort(F.collect_list(F.struct("r", "c", F.col(value).alias("z")))).alias("cells"))
    return packed.select("state_ref", "h", "w", F.transform("cells", lambda x: x["z"]).alias("z"))


def cells_of(grids: DataFrame) -> DataFrame:
    long = grids.select("state_ref", "h", "w", F.posexplode("z").alias("i", "z"))
    return long.select("state_ref", "h", "w", (F.floor(F.col("i") / F.col("w")) + 1).cast("int").alias("r"), (F.col("i") % F.col("w") + 1).cast("int").alias("c"), "z")
