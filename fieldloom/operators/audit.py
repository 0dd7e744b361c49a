"""Constraint queries: each returns the rows that break a rule, so that an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import safe_path


def not_finite(cells: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Per key: rows, and rows that are null, NaN or infinite."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"))


def not_increasing(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Groups whose value does not strictly increase along order."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("before", before).filter(F.col(value) <= F.col("before")).groupBy(group).agg(F.count("*").alias("steps_back"))


def agreed_count(fields: DataFrame, declared: str, observed: str, group: str) -> DataFrame:
    """Per group the sample count to use: as declared, or, where that is negative, the one that all its fields agree on; `sound` tells whether there is one."""
    per = fields.groupBy(group).agg(F.min(declared).alias("declared"), F.countDistinct(observed).alias("kinds"), F.min(observed).alias("observed"))
    count = F.when(F.col("declared") >= 0, F.col("declared")).when(F.col("kinds") == 1, F.col("observed"))
    return per.select(group, "declared", count.alias("samples"), (F.col("declared") < 0).alias("repaired"), count.isNotNull().alias("sound"))


def classify_files(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """files (path) with split by the first pattern that fits, null where none does."""
    split = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        split = F.when(F.col("path").rlike(pattern), name).otherwise(split)
    return files.withColumn("split", split)


def missing_splits(files: DataFrame, wanted: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    have = files.filter("split is not null").select("split").distinct()
    need = files.sparkSession.createDataFrame([(w,) for w in wanted], "split string")
    return need.join(have, "split", "left_anti")


def manifest_problems(manifest: DataFrame, extension: str = "parquet") -> DataFrame:
    """(path, problem) of manifest rows (path, split, size_bytes, sha256)."""
    own = Window.partitionBy("path")
    rules = {
        "unsafe_path": ~safe_path(F.col("path")), "repeated_path": F.count("*").over(own) > 1, "unknown_split": ~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False)),
        "bad_size": ~F.coalesce(F.col("size_bytes") > 0, F.lit(False)), "bad_digest": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "wrong_extension": ~F.coalesce(F.col("path").endswith("." + extension), F.lit(False)),
    }
    return _problems(manifest, "path", rules)


def _problems(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    marked = rows.select(key, F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull()).alias("p"))
    return marked.select(key, F.explode("p").alias("problem"))


def receipt_problems(manifest: DataFrame, receipt: DataFrame) -> DataFrame:
    """(path, problem): full comparison of two inventories (path, size_bytes, sha256)."""
    m = manifest.select("path", F.col("size_bytes").alias("ms"), F.col("sha256").alias("mh"), F.lit(1).alias("im"))
    r = receipt.select("path", F.col("size_bytes").alias("rs"), F.col("sha256").alias("rh"), F.lit(1).alias("ir"))
    j = m.join(r, "path", "full")
    both = F.col("im").isNotNull() & F.col("ir").isNotNull()
    return _problems(j, "path", {"not_in_receipt": F.col("ir").isNull(), "not_in_manifest": F.col("im").isNull(), "size": both & (F.col("ms") != F.col("rs")), "digest": both & (F.col("mh") != F.col("rh"))})


def shared_digests(rows: DataFrame, digest: str, split: str = "split") -> DataFrame:
    """Digests that occur in several splits."""
    return rows.groupBy(digest).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("n")).filter("splits > 1")


def content_digests(cells: DataFrame, keys: list[str], value: str = "x", scale: float = 2.0**30) -> DataFrame:
    """(keys, digest): SHA-256 over the digests of a grid's rows in order, a row's over its values in order, as whole multiples of 1 / scale."""
    number = F.floor(F.col(value) * scale).cast("decimal(38,0)").cast("string")
    joined = lambda order, what: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), what.alias("v")))), lambda x: x["v"]), ","), 256)
    row = cells.groupBy(*keys, "r").agg(joined("c", number).alias("d"))
    return row.groupBy(*keys).agg(joined("r", F.col("d")).alias("digest"))


#: What names a frame of a source.
TOLD = ("source_id", "source_file_id", "field_key", "component", "sample_index", "time_index")


def _values_text(values: str) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def _frame_text(values: Column) -> Column:
    return F.concat_ws("|", "field_key", F.coalesce(F.col("component").cast("string"), F.lit("-")), F.col("height").cast("string"), F.col("width").cast("string"), values)


def trajectory_digests(frames: DataFrame, values: str = "values") -> DataFrame:
    """(source_id, source_file_id, sample_index, digest, initial): SHA-256 over all fields and times of a trajectory, and over its fields' first frames; fields without time, and those that all samples of a file share, count for both.

    frames: (source_id, source_file_id, field_key, component, sample_index, time_index, height, width, values).
    """
    return digests_of_frames(frames.select(*TOLD, F.sha2(_frame_text(_values_text(values)), 256).alias("d")))


def strip_digests(strips: DataFrame, values: str = "values") -> DataFrame:
    """(TOLD, d): the frame digests that trajectory_digests() makes, of frames in strips of whole rows (tr, their order). SHA-256 runs over a frame's text from end to end, so one group holds that text, but no cells."""
    told = strips.select(*TOLD, "height", "width", "tr", _values_text(values).alias("part"))
    whole = told.groupBy(*TOLD, "height", "width").agg(F.array_sort(F.collect_list(F.struct("tr", "part"))).alias("parts"))
    return whole.select(*TOLD, F.sha2(_frame_text(F.array_join("parts.part", ",")), 256).alias("d"))


def digests_of_frames(frames: DataFrame) -> DataFrame:
    """trajectory_digests() of frames (TOLD) with digests d of their own."""
    each = frames.select("source_id", "source_file_id", "sample_index", "field_key", F.coalesce("component", F.lit(-1)).alias("component"), F.coalesce("time_index", F.lit(-1)).alias("time_index"), "d")
    own, shared = each.filter("sample_index is not null"), each.filter("sample_index is null").drop("sample_index")
    samples = own.select("source_id", "source_file_id", "sample_index").distinct()
    every = own.unionByName(samples.join(shared, ["source_id", "source_file_id"]))
    key = ["source_id", "source_file_id", "sample_index"]
    joined = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["d"]), ","), 256)
    row = F.struct("field_key", "component", "time_index", "d")
    fields = every.groupBy(*key, "field_key", "component").agg(joined(row).alias("d"), F.min_by("d", "time_index").alias("first"))  # one field's times
    return fields.groupBy(*key).agg(joined(F.struct("field_key", "component", "d")).alias("digest"), joined(F.struct("field_key", "component", F.col("first").alias("d"))).alias("initial"))


def shared_initial_states(digests: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """(initial, trajectories, distinct, splits): first frames that several trajectories have; equal first frames alone are a note, not proof of a copy. splits: (source_id, source_file_id, sample_index, split)."""
    rows = digests.withColumn("split", F.lit(None).cast("string")) if splits is None else digests.join(splits, ["source_id", "source_file_id", "sample_index"], "left")
    return rows.groupBy("initial").agg(F.count("*").alias("trajectories"), F.countDistinct("digest").alias("distinct"), F.countDistinct("split").alias("splits")).filter("trajectories > 1")


def leaks(states: DataFrame, splits: DataFrame, key: str = "trajectory") -> DataFrame:
    """States whose split isn't their trajectory's, or whose trajectory has none."""
    given = splits.select(key, F.col("split").alias("wanted"))
    return states.join(given, key, "left").filter(~F.col("split").eqNullSafe(F.col("wanted")))


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def overlaps(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that occur in several parts."""
    return rows.groupBy(key).agg(F.countDistinct(part).alias("parts")).filter("parts > 1")


def missing_states(records: DataFrame, states: DataFrame) -> DataFrame:
    return records.select("state_ref").distinct().join(states.select("state_ref"), "state_ref", "left_anti")


def wanted_states(states: DataFrame, records: DataFrame) -> DataFrame:
    return states.join(records.select("state_ref"), "state_ref", "left_semi")


def coarse_precision(records: DataFrame) -> DataFrame:
    """Records whose rounding step is not strictly finer than their tolerance."""
    return records.filter(F.col("tolerance") <= 0.5 * F.pow(F.lit(10.0), -F.col("decimals"))).select("qa_id", "tolerance", "decimals")


def preflight(cells: DataFrame, least: int = 20) -> DataFrame:
    """Per source: trajectories, shapes, whether there are enough trajectories and one shape."""
    per = cells.groupBy("source_id").agg(F.countDistinct("trajectory").alias("trajectories"), F.countDistinct("h", "w").alias("shapes"))
    return per.withColumn("sound", (F.col("trajectories") >= least) & (F.col("shapes") == 1))


def counters(rows: DataFrame, part: str, dims: list[str]) -> DataFrame:
    """(part, dim, key, records, states): rows and distinct states of each part by every dimension, by grouping sets in one pass."""
    named = rows.select(part, "state_ref", *[F.col(d).cast("string").alias(d) for d in dims])
    out = named.groupingSets([[F.col(part), F.col(d)] for d in dims], F.col(part), *[F.col(d) for d in dims]).agg(F.count("*").alias("records"), F.countDistinct("state_ref").alias("states"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    dim, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        dim, key = F.when(F.col(f"g_{d}") == 0, d).otherwise(dim), F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(key)
    return out.select(part, dim.alias("dim"), key.alias("key"), "records", "states")


def coverage(rows: DataFrame, keys: list[str], distinct: dict[str, list[str]]) -> DataFrame:
    """keys and, for each name, the number of distinct combinations of its columns; a null is a value of its own."""
    return rows.groupBy(*keys).agg(*[F.countDistinct(F.struct(*columns)).alias(name) for name, columns in distinct.items()])
