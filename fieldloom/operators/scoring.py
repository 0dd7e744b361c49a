"""Scoring free-text answers, and metrics along many dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.answers import parse_answer
from ..functions.labels import count_bucket


def unknown_or_repeated(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """(qa_id, problem) of predictions without a record, or with several rows."""
    unknown = predictions.join(records.select("qa_id"), "qa_id", "left_anti").select("qa_id", F.lit("unknown").alias("problem")).distinct()
    repeated = predictions.groupBy("qa_id").count().filter("count > 1").select("qa_id", F.lit("repeated").alias("problem"))
    return unknown.union(repeated)


def uncovered(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """(qa_id, side) of ids that only one side has, for joins that must cover both exactly."""
    a, b = records.select("qa_id").withColumn("in_records", F.lit(1)), predictions.select("qa_id").withColumn("in_predictions", F.lit(1))
    return a.join(b, "qa_id", "full").filter("in_records is null or in_predictions is null").select("qa_id", F.when(F.col("in_records").isNull(), "prediction").otherwise("record").alias("side"))


def accepted(values: Column, runs: Column) -> Column:
    """Whether a pair of whole numbers lies in a tie run."""
    return F.exists(runs, lambda x: (x["r"] == values[0]) & (values[1] >= x["c0"]) & (values[1] <= x["c1"]))


def score(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """records with parsed values, error, valid, units, hits, all_correct. Missing predictions are errors of their own; invalid answers keep their units.

    An error is, in order: a parse error, generation_truncated (which overrides it), wrong_value_count, invalid_coordinate; missing_prediction last.
    """
    given = predictions.select("qa_id", F.col("prediction"), F.coalesce("terminated", F.lit(True)).alias("terminated"), F.lit(True).alias("given"))
    return scored_pairs(records.join(given, "qa_id", "left"))


def scored_pairs(rows: DataFrame) -> DataFrame:
    """score() of records that have their prediction beside them (prediction, terminated, and given, which is null where there is none)."""
    if "given" not in rows.columns:
        rows = rows.withColumn("given", F.lit(True))
    j = rows.withColumn("parsed", parse_answer(F.coalesce("prediction", F.lit(""))))
    parsed, expected, n = F.col("parsed.values"), F.col("values"), F.size("values")
    place = F.col("answer_kind") == "coordinate"
    whole = F.forall(parsed, lambda v: v == F.floor(v)) & (parsed[0] >= 1) & (parsed[0] <= F.col("h")) & (F.get(parsed, F.lit(1)) >= 1) & (F.get(parsed, F.lit(1)) <= F.col("w"))
    error = (
        F.when(F.col("given").isNull(), "missing_prediction")
        .when(~F.col("terminated"), "generation_truncated")
        .when(F.col("parsed.error").isNotNull(), F.col("parsed.error"))
        .when(F.size(parsed) != n, "wrong_value_count")
        .when(place & ~whole, "invalid_coordinate")
    )
    j = j.withColumn("error", error).withColumn("valid", error.isNull())
    off = F.zip_with(parsed, expected, lambda a, b: F.abs(a - b))
    close = F.size(F.filter(off, lambda e: e <= F.col("tolerance")))
    hits = F.when(~F.col("valid"), 0).when(place, accepted(parsed, F.col("runs")).cast("int")).otherwise(close)
    units = F.when(place, 1).otherwise(n)
    return (
        j.withColumn("units", units).withColumn("hits", hits).withColumn("all_correct", F.col("valid") & (F.col("hits") == F.col("units")))
        .withColumn("observed_count", F.when(parsed.isNotNull(), F.size(parsed)).otherwise(0)).withColumn("parsed_values", parsed)
        .withColumn("absolute_errors", F.when(F.col("valid") & ~place, off)).drop("parsed", "given")
    )


def annotate(scored: DataFrame) -> DataFrame:
    """Buckets of counts and areas, and the label signature by which pairs are compared."""
    runs = F.coalesce(F.array_join(F.transform("runs", lambda x: F.concat_ws(",", *[x[k].cast("string") for k in ("r", "c0", "c1")])), ";"), F.lit(""))
    values = F.array_join(F.transform("values", lambda v: F.round(v, 6).cast("decimal(20,6)").cast("string")), ",")
    signature = F.sha2(F.concat_ws("|", values, "answer_kind", runs, F.col("tolerance").cast("string")), 256)
    return (
        scored.withColumn("query_points_bucket", count_bucket(F.col("query_point_count"))).withColumn("query_area_bucket", count_bucket(F.col("query_extent_cells")))
        .withColumn("output_length_bucket", count_bucket(F.col("output_count"))).withColumn("label_signature", signature)
    )


def _sums() -> list[Column]:
    return [
        F.count("*").alias("questions"), F.sum("units").alias("units"), (F.sum("hits") / F.sum("units")).alias("unit_accuracy"),
        F.avg(F.col("all_correct").cast("int")).alias("answer_accuracy"), F.avg(F.col("valid").cast("int")).alias("valid_rate"),
    ]


def summarize(scored: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, key, questions, units, unit_accuracy, answer_accuracy, valid_rate): the whole ('all') and every value of each dimension, by grouping sets in one pass.

    A dimension that no row has is left out; one that only some rows have fails the job.
    """
    named = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims], F.struct(F.lit("all").alias("dim"), F.lit("all").alias("key")))
    narrow = scored.select("units", "hits", "all_correct", "valid", F.explode(named).alias("x")).select("x.*", "units", "hits", "all_correct", "valid")
    out = narrow.groupBy("dim", "key").agg(*_sums())
    own = Window.partitionBy("dim")  # a row per key
    partly = (F.max(F.col("key").isNull()).over(own)) & (F.count("key").over(own) > 0)
    checked = out.withColumn("dim", F.when(partly, F.raise_error(F.concat(F.lit("some rows lack the dimension "), "dim")).cast("string")).otherwise(F.col("dim")))
    return checked.filter("key is not null").select("dim", "key", "questions", "units", "unit_accuracy", "answer_accuracy", "valid_rate")


def errors(scored: DataFrame, dim: str) -> DataFrame:
    """Rows by dim and error. Rows without one are dropped after the count: a filter on the error itself would be pushed below all that it is made from, a copy of the programs' expressions for each use."""
    return scored.groupBy(F.col(dim).cast("string").alias("key"), "error").agg(F.count("error").alias("questions")).filter("questions > 0")


def macro(scored: DataFrame, task: str = "task") -> DataFrame:
    """Unweighted means over tasks of unit and answer accuracy."""
    per = scored.groupBy(task).agg(*_sums())
    return per.agg(F.avg("unit_accuracy").alias("macro_unit_accuracy"), F.avg("answer_accuracy").alias("macro_answer_accuracy"), F.count("*").alias("tasks"))


def incomplete_dims(scored: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, present, questions) of dimensions that some rows have and others lack."""
    counts = scored.agg(F.count("*").alias("n"), *[F.count(d).alias(d) for d in dims])
    rows = counts.select("n", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("present")) for d in dims])).alias("x"))
    return rows.filter("x.present > 0 and x.present < n").select("x.dim", "x.present", F.col("n").alias("questions"))


def language_pairs(scored: DataFrame) -> DataFrame:
    """One row of counts over (state_ref, semantic_id) pairs of a seen and a held-out wording; several rows of a kind, or unequal labels, raise."""
    side = lambda g, c: F.max(F.when(F.col("language_group") == g, F.col(c)))
    pairs = scored.groupBy("state_ref", "semantic_id").agg(
        F.count(F.when(F.col("language_group") == "seen", 1)).alias("ns"), F.count(F.when(F.col("language_group") == "heldout", 1)).alias("nh"), F.countDistinct("label_signature").alias("labels"),
        side("seen", "all_correct").alias("sc"), side("heldout", "all_correct").alias("hc"), side("seen", "valid").alias("sv"), side("heldout", "valid").alias("hv"),
        side("seen", "parsed_values").alias("sp"), side("heldout", "parsed_values").alias("hp"),
    )
    bad = (F.col("ns") > 1) | (F.col("nh") > 1) | ((F.col("ns") == 1) & (F.col("nh") == 1) & (F.col("labels") > 1))
    pairs = pairs.withColumn("ns", F.when(bad, F.raise_error(F.lit("a language pair has repeated members or unequal labels")).cast("long")).otherwise(F.col("ns")))
    full = (F.col("ns") == 1) & (F.col("nh") == 1)
    n = lambda cond: F.count(F.when(full & cond, 1))
    sc, hc = F.col("sc"), F.col("hc")
    out = pairs.agg(
        F.count(F.when(full, 1)).alias("complete_pairs"), F.count(F.when(~full, 1)).alias("incomplete_pairs"), n(sc).alias("seen_correct"), n(hc).alias("heldout_correct"), n(sc & hc).alias("both_correct"),
        n(sc & ~hc).alias("seen_correct_heldout_wrong"), n(~sc & hc).alias("seen_wrong_heldout_correct"), n(F.col("sv") & F.col("hv") & (F.col("sp") == F.col("hp"))).alias("valid_prediction_agreement"),
    )
    return out.withColumn("both_correct_rate", F.try_divide(F.col("both_correct"), F.col("complete_pairs")))


def field_pairs(scored: DataFrame) -> DataFrame:
    """Counts over pairs (input_pair_id) of an original and an alternative field."""
    side = lambda m, c: F.max(F.when(F.col("input_pair_member") == m, F.col(c)))
    pairs = scored.filter("input_pair_id is not null").groupBy("input_pair_id").agg(
        *[side(m, c).alias(f"{m}_{c}") for m in ("original", "alternative") for c in ("all_correct", "valid", "parsed_values")], F.countDistinct("input_pair_member").alias("members")
    )
    full = F.col("members") == 2
    both = F.col("original_all_correct") & F.col("alternative_all_correct")
    changed = F.col("original_valid") & F.col("alternative_valid") & (F.col("original_parsed_values") != F.col("alternative_parsed_values"))
    out = pairs.agg(F.count(F.when(full, 1)).alias("complete_pairs"), F.count(F.when(~full, 1)).alias("incomplete_pairs"), F.count(F.when(full & both, 1)).alias("both_correct"), F.count(F.when(full & changed, 1)).alias("valid_changed"))
    return out.withColumn("both_correct_rate", F.try_divide(F.col("both_correct"), F.col("complete_pairs")))


def changed_answer_pairs(records: DataFrame, grids: DataFrame, max_pairs: int = 128, max_candidates: int = 4096, per_query: int = 32) -> DataFrame:
    """(qa_id, other_qa_id, other_state, pair_id): up to max_pairs records, each with a state of its shape on which its own program has a disjoint answer; an id is in one pair at most.

    A bounded diagnostic: records are taken in hash order, and for each the next per_query states of
    its shape, in a hash order that wraps at its end, until max_candidates states were tried. So
    max_candidates records at most are looked at, and the picking is done on the driver.
    """
    from . import programs as P
    from .sampling import ranked
    from ..functions.numeric import order_key

    states = records.select("state_ref", "h", "w").distinct().withColumn("order_", F.concat_ws(":", "h", "w", order_key("pair", F.col("state_ref"))))
    placed = ranked(states, "order_", "place")
    shapes = placed.groupBy("h", "w").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = records.select("qa_id", "state_ref", "h", "w", "task", "op", "left", "right", "target", "template_family", F.col("values").alias("v"), F.col("tolerance").alias("t"), F.col("runs").alias("a"))
    asked = rows.join(shapes, ["h", "w"]).withColumn("order", order_key("query", F.col("qa_id"))).orderBy("order", "qa_id").limit(max_candidates)
    asked = asked.join(placed.select("state_ref", "place"), "state_ref")
    ahead = asked.withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.lit(per_query), F.col("n") - 1).cast("int"))))
    ahead = ahead.withColumn("place", F.col("first") + (F.col("place") - F.col("first") + F.col("step")) % F.col("n")).drop("state_ref").join(placed.select("place", "state_ref"), "place")
    done = P.execute(ahead, grids)
    numbers = (F.size("v") != F.size("values")) | F.exists(F.zip_with("v", "values", lambda a, b: F.abs(a - b)), lambda d: d > F.col("t") * 2)
    meets = F.exists("a", lambda p: F.exists("runs", lambda q: (p["r"] == q["r"]) & (p["c0"] <= q["c1"]) & (q["c0"] <= p["c1"])))
    named = done.withColumn("semantic_id", P.semantic_id()).withColumn("apart", F.when(F.col("a").isNull(), numbers).otherwise(~meets))
    other = F.substring(F.sha2(F.concat_ws("|", "semantic_id", "template_family"), 256), 1, 24)
    tried = named.select("order", "qa_id", "step", other.alias("other_qa_id"), F.col("state_ref").alias("other_state"), "apart").orderBy("order", "qa_id", "step").collect()  # max_candidates x per_query rows at most
    pairs, used, closed, attempts = [], set(), set(), 0
    for r in tried:
        if len(pairs) >= max_pairs or attempts >= max_candidates:
            break
        if r.qa_id in closed or r.qa_id in used:
            continue
        attempts += 1
        if r.apart and r.other_qa_id not in used:
            pairs.append((r.qa_id, r.other_qa_id, r.other_state))
            used |= {r.qa_id, r.other_qa_id}
            closed.add(r.qa_id)
    frame = records.sparkSession.createDataFrame(pairs, "qa_id string, other_qa_id string, other_state string")
    return frame.withColumn("pair_id", F.substring(F.sha2(F.concat_ws("|", "qa_id", "other_qa_id"), 256), 1, 24))


def zero_baseline(records: DataFrame) -> DataFrame:
    """Scores of the answer 0 to numerical questions at their own length and tolerance; coordinates are left out."""
    numeric = records.filter("answer_kind <> 'coordinate'")
    close = F.size(F.filter("values", lambda v: F.abs(v) <= F.col("tolerance")))
    return numeric.withColumn("units", F.size("values")).withColumn("hits", close).withColumn("valid", F.lit(True)).withColumn("all_correct", F.col("hits") == F.col("units"))


def breakdowns(rows: DataFrame) -> DataFrame:
    """(key, correct, total, accuracy, mean_absolute_z_error) of prediction rows along ten keys, and the value gap's band where there is one."""
    from ..functions.labels import value_gap_band

    t = F.col("task")
    key = lambda name, *parts: F.concat(F.lit(f"{name}:"), F.concat_ws("|", *parts))
    band = value_gap_band(F.col("value_gap"))
    keys = F.array(
        F.lit("all"), key("task", t), key("source", F.col("source")), key("source_task", F.col("source"), t), key("shape_task", F.col("shape"), t), key("source_shape_task", F.col("source"), F.col("shape"), t),
        key("field_task", F.col("field"), t), key("coordinate32_task", F.col("coordinate_32").cast("string"), t), key("coordinate96_task", F.col("coordinate_96").cast("string"), t),
        key("partition_task", F.coalesce("extrapolation_axis", "shape_partition"), t), F.when(band.isNotNull(), key("gap_task", band, t)),
    )
    long = rows.select(F.explode(F.array_compact(keys)).alias("key"), F.col("correct").cast("int").alias("correct"), "absolute_z_error")
    return long.groupBy("key").agg(F.sum("correct").alias("correct"), F.count("*").alias("total"), F.avg("correct").alias("accuracy"), F.avg("absolute_z_error").alias("mean_absolute_z_error"))


def numeric_pairs(rows: DataFrame) -> DataFrame:
    """Counts over pairs (pair_id) of a normalised and a raw question on the same value."""
    side = lambda task, c: F.max(F.when(F.col("task") == task, F.col(c)))
    p = rows.filter("pair_id is not null").groupBy("pair_id").agg(side("normalized_point_value", "correct").alias("n"), side("raw_point_value_with_stats", "correct").alias("r"), side("normalized_point_value", "chosen_value_rank").alias("nr"), side("raw_point_value_with_stats", "chosen_value_rank").alias("rr"))
    full, n, r = F.col("n").isNotNull() & F.col("r").isNotNull(), F.col("n"), F.col("r")
    c = lambda cond: F.count(F.when(full & cond, 1))
    return p.agg(F.count(F.when(~full, 1)).alias("incomplete"), F.count(F.when(full, 1)).alias("total"), c(F.col("nr") == F.col("rr")).alias("same_value_rank"), c(n & r).alias("both_correct"), c(n & ~r).alias("norm_correct_raw_wrong"), c(~n & r).alias("norm_wrong_raw_correct"), c(~n & ~r).alias("both_wrong"))


def compare_runs(a: DataFrame, b: DataFrame, group: str, value: str) -> DataFrame:
    """compare() of two runs' scored rows (qa_id, group, value) by group; both have to hold the same ids, or the job fails."""
    odd = unequal_sets(a, b).count()
    if odd:
        raise ValueError(f"{odd} ids are not in both runs alike")
    mean = lambda x: x.groupBy(F.col(group).alias("key")).agg(F.avg(F.col(value).cast("int")).alias(value))
    return compare(mean(a), mean(b), ["key"], value)


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, both values and the difference in percentage points, for groups that both have."""
    left, right = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return left.join(right, keys).withColumn("delta_points", (F.col("b") - F.col("a")) * 100)


def unequal_sets(a: DataFrame, b: DataFrame, key: str = "qa_id") -> DataFrame:
    """Ids with unequal numbers of rows on the two sides."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).withColumn("side", F.lit("first")).union(y.exceptAll(x).withColumn("side", F.lit("second")))
