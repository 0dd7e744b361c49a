"""Buckets and categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Upper ends of the count buckets, tasks, their capabilities and template families.
COUNT_ENDS = (1, 4, 16, 64, 256, 1024, 4096, 16384)
READ_TASKS = ("single_point", "multi_point", "line_profile", "region_values")
STAT_TASKS = ("region_mean", "region_std", "region_min", "region_max")
LOCATION_TASKS = ("region_argmin", "region_argmax", "nearest_value_location")
COMPOSITION_TASKS = ("point_difference", "region_mean_difference", "threshold_fraction")
TASKS = READ_TASKS + STAT_TASKS + LOCATION_TASKS + COMPOSITION_TASKS
TEMPLATES = {"train": ("direct", "question", "region_first", "coordinate_tuple"), "val": ("interval",), "test": ("relative",)}


def _buckets(n: Column, ends: tuple[int, ...]) -> Column:
    out, low = None, 1
    for e in ends:
        name = str(e) if e == low else f"{low}-{e}"
        out = F.when(n <= e, name) if out is None else out.when(n <= e, name)
        low = e + 1
    return out.otherwise(f"{ends[-1] + 1}+")


def count_bucket(n: Column) -> Column:
    """Nine bins; counts below one raise an error."""
    return F.when(n < 1, F.raise_error(F.lit("counts must be positive"))).otherwise(_buckets(n, COUNT_ENDS))


def difficulty(points: Column) -> Column:
    return _buckets(points, COUNT_ENDS[:6])


def value_gap_band(gap: Column) -> Column:
    return F.when(gap < 0.25, "lt_0.25").when(gap < 0.5, "0.25_to_0.5").when(gap < 1, "0.5_to_1").when(gap.isNotNull(), "ge_1")


def roughness_bin(constant: Column, roughness: Column) -> Column:
    return F.when(constant, "constant").when(roughness < 0.25, "smooth").when(roughness < 1, "moderate").otherwise("sharp")


def area_bin(cells: Column, edges: list[int]) -> Column:
    """cells_<low>_<high> of the first edge not below; null above the last edge."""
    out, low = None, 1
    for e in edges:
        out = F.when(cells <= e, f"cells_{low}_{e}") if out is None else out.when(cells <= e, f"cells_{low}_{e}")
        low = e + 1
    return out


def capability(task: Column) -> Column:
    return F.when(task.isin(*READ_TASKS), "readout").when(task.isin(*STAT_TASKS), "aggregation").when(task.isin(*LOCATION_TASKS), "localization").when(task.isin(*COMPOSITION_TASKS), "composition")


def shape_label(h: Column, w: Column) -> Column:
    return F.concat_ws("x", h.cast("string"), w.cast("string"))


def parse_shape(text: Column) -> Column:
    """struct(h, w, ok) of a text such as 8X12; ok needs both sides to be four or more."""
    parts = F.split(F.lower(F.trim(text)), "x")
    h, w = (F.expr("1").cast("int"), F.expr("1").cast("int"))
    sound = F.lower(F.trim(text)).rlike(r"^[0-9]{1,9}x[0-9]{1,9}$")
    h, w = F.when(sound, parts[0].cast("int")), F.when(sound, parts[1].cast("int"))
    return F.struct(h.alias("h"), w.alias("w"), F.coalesce((h >= 4) & (w >= 4), F.lit(False)).alias("ok"))


def safe_path(path: Column) -> Column:
    """Relative, canonical, forward slashes only: no empty, '.' or '..' part, no colon or backslash."""
    return F.coalesce(path.rlike(r"^[^/\\:]+(/[^/\\:]+)*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)"), F.lit(False))
