"""Batch plans, token budgets, offsets, block tokens and feature bases."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import draw, order_key
from ..sources.tables import written


def running_offsets(rows: DataFrame, order: str, size: str, out: str = "offset") -> DataFrame:
    """rows with the sum of size over all earlier rows: range-partitioned by order, summed within and between partitions.

    Only one row per partition takes part in the sum between partitions. Rows are written with their
    partition, as two scans of a range partitioning need not have the same bounds.
    """
    ranged = written(rows.repartitionByRange(order).withColumn("part_", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("inner_", F.coalesce(F.sum(size).over(within), F.lit(0)))
    totals = inner.groupBy("part_").agg(F.sum(size).alias("t_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part_", F.coalesce(F.sum("t_").over(before), F.lit(0)).alias("base_"))
    return inner.join(F.broadcast(bases), "part_").withColumn(out, F.col("base_") + F.col("inner_")).drop("part_", "inner_", "base_")


def offset_breaks(rows: DataFrame, group: str, order: str, offset: str, size: str) -> DataFrame:
    """Rows whose offset isn't where the row before them in their group ends, or whose size isn't positive."""
    end = F.lag(F.col(offset) + F.col(size)).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("expected", F.coalesce(end, F.lit(0))).filter((F.col(offset) != F.col("expected")) | (F.col(size) < 1))


def shape_batches(rows: DataFrame, batch: int, seed: int, epoch: int) -> DataFrame:
    """rows (id, h, w) with batch: shuffled within each shape by hash, cut into batches, the batches shuffled among themselves (batch_order)."""
    order = F.concat_ws(":", "h", "w", order_key(seed + epoch, F.col("id")), F.col("id").cast("string"))
    placed = running_offsets(rows.withColumn("order_", order).withColumn("one_", F.lit(1)), "order_", "one_", "place_")
    first = placed.groupBy("h", "w").agg(F.min("place_").alias("first_"))  # a shape's rows are neighbours
    cut = placed.join(first, ["h", "w"]).withColumn("batch", F.floor((F.col("place_") - F.col("first_")) / batch).cast("int")).drop("order_", "one_", "place_", "first_")
    return cut.withColumn("batch_order", order_key(seed + epoch, "batch", F.col("h"), F.col("w"), F.col("batch")))


def batch_statistics(batched: DataFrame, batch: int) -> DataFrame:
    sizes = batched.groupBy("h", "w", "batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("batches"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.count(F.when(F.col("n") < batch, 1)).alias("partial"))


def planned_updates(rows: DataFrame, batch: int, epochs: int, accumulation: int) -> DataFrame:
    per = rows.groupBy("h", "w").agg(F.ceil(F.count("*") / batch).alias("batches"))
    return per.agg(F.ceil(F.sum("batches") * epochs / accumulation).cast("long").alias("updates"))


def padding_fraction(rows: DataFrame, keys: list[str], length: str) -> DataFrame:
    """One minus true tokens over padded tokens, every batch padded to its longest."""
    per = rows.groupBy(*keys).agg(F.sum(length).alias("true"), (F.count("*") * F.max(length)).alias("padded"))
    return per.agg((1 - F.sum("true") / F.sum("padded")).alias("padding_fraction"))


def token_report(rows: DataFrame, limit: int, examples: int = 8) -> DataFrame:
    """One row: count, longest with its id, rows over the limit, and the first of them by id."""
    over = F.when(F.col("tokens") > limit, F.col("id"))
    return rows.agg(F.count("*").alias("rows"), F.max("tokens").alias("longest"), F.max_by("id", F.struct("tokens", -F.col("id"))).alias("longest_id"), F.count(over).alias("over"), F.min(over).alias("first_over"))


def first_over(rows: DataFrame, limit: int, examples: int = 8) -> DataFrame:
    return rows.filter(F.col("tokens") > limit).orderBy("id").limit(examples)


def merged_reports(reports: DataFrame) -> DataFrame:
    """Reports of parts as one: sums, and the longest with its id."""
    return reports.agg(F.sum("rows").alias("rows"), F.max("longest").alias("longest"), F.max_by("longest_id", F.struct("longest", -F.col("longest_id"))).alias("longest_id"), F.sum("over").alias("over"))


#: What a token report says of one question.
DETAIL = ("position", "qa_id", "task", "template_family", "prompt_tokens", "target_tokens")


def token_budget_report(rows: DataFrame, prompt_limit: int, target_limit: int, parts: list[str] | None = None, examples: int = 8) -> DataFrame:
    """Per part (one row without parts): questions, longest prompt and target with their first records, overflow counts, and the first `examples` questions over a limit.

    rows: DETAIL and the parts' columns; position is a question's place in the whole set. A report
    holds a bounded number of examples, and reports of parts merge in any order to that of the whole.
    """
    keys = list(parts or [])
    detail = F.struct(*DETAIL)
    first = lambda c: F.max_by(detail, F.struct(F.col(c), -F.col("position")))
    over = lambda c, limit: F.count(F.when(F.col(c) > limit, 1))
    either = (F.col("prompt_tokens") > prompt_limit) | (F.col("target_tokens") > target_limit)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("questions"), F.max("prompt_tokens").alias("max_prompt_tokens"), first("prompt_tokens").alias("max_prompt_record"), F.max("target_tokens").alias("max_target_tokens"), first("target_tokens").alias("max_target_record"),
        over("prompt_tokens", prompt_limit).alias("prompt_overflow"), over("target_tokens", target_limit).alias("target_overflow"), F.count(F.when(either, 1)).alias("overflow"),
    )
    found = rows.filter(either).select(*keys, detail.alias("d"))
    if keys:
        own = Window.partitionBy(*keys).orderBy("d.position")
        few = found.withColumn("n_", F.row_number().over(own)).filter(F.col("n_") <= examples).groupBy(*keys).agg(F.array_sort(F.collect_list("d")).alias("examples"))
        out = sums.join(few, keys, "left")
    else:
        few = found.orderBy("d.position").limit(examples).agg(F.array_sort(F.collect_list("d")).alias("examples"))
        out = sums.withColumn("one_", F.lit(1)).join(few.withColumn("one_", F.lit(1)), "one_", "left").drop("one_")  # a row each
    none = F.array().cast(out.schema["examples"].dataType)
    return out.withColumn("examples", F.coalesce("examples", none)).withColumn("status", F.when(F.col("overflow") > 0, "overflow").otherwise("ok"))


def merged_token_reports(reports: DataFrame, keys: list[str] | None = None, examples: int = 8) -> DataFrame:
    """Reports of token_budget_report as one (per keys): sums, longest with their first records, and the first examples by position."""
    longest = lambda c: F.max_by(f"max_{c}_record", F.struct(F.col(f"max_{c}_tokens"), -F.col(f"max_{c}_record.position")))
    sums = ("questions", "prompt_overflow", "target_overflow", "overflow")
    out = reports.groupBy(*(keys or [])).agg(
        *[F.sum(c).alias(c) for c in sums], *[x for c in ("prompt", "target") for x in (F.max(f"max_{c}_tokens").alias(f"max_{c}_tokens"), longest(c).alias(f"max_{c}_record"))],
        F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, examples).alias("examples"),  # `examples` of each report
    )
    return out.withColumn("status", F.when(F.col("overflow") > 0, "overflow").otherwise("ok"))


def merge_strided(parts: DataFrame) -> DataFrame:
    """(i, length) of vectors (part, parts, k, length) that hold every parts-th item."""
    return parts.select((F.col("part") + F.col("k") * F.col("parts")).alias("i"), "length").groupBy("i").agg(F.sum("length").alias("length"))


def length_summary(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: least, greatest and mean length."""
    return rows.agg(F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.avg(tokens).alias("mean"))


def field_runs(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """rows with run: the number of changes of key up to the row, within its group."""
    change = (F.col(key) != F.lag(key).over(Window.partitionBy(group).orderBy(order))).cast("int")
    return rows.withColumn("run", F.sum(F.coalesce(change, F.lit(0))).over(Window.partitionBy(group).orderBy(order)))


def _balance(parts: int, rows: list[dict]) -> list[int]:
    """The part of each row, in their order. Longest first, each to the part whose padded cost would grow least; parts stay within one of equal size."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["length"] is None, -(rows[i]["length"] or 0), rows[i]["id"] is None, rows[i]["id"] or 0))
    most = math.ceil(len(rows) / parts)
    size, longest, out = [0] * parts, [0] * parts, [0] * len(rows)
    for i in order:
        length = rows[i]["length"] or 0
        p = min((max(longest[p], length) * (size[p] + 1) - longest[p] * size[p], -longest[p], p) for p in range(parts) if size[p] < most)[2]
        size[p], longest[p], out[i] = size[p] + 1, max(longest[p], length), p
    return out


def _balanced(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, sizes = batch.column("rows"), pc.list_value_length(batch.column("rows"))
        rows = own.flatten()
        part = [p for r in own.to_pylist() for p in _balance(parts, r)]
        group = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes.to_numpy())))
        yield pa.RecordBatch.from_arrays([group, rows.field("id"), rows.field("length"), pa.array(part, pa.int32())], names=[batch.schema.names[0], "id", "length", "part"])


def length_balanced(rows: DataFrame, parts: int, group: str = "batch") -> DataFrame:
    """rows (batch, id, length) with part, per batch; a batch is bounded by the training step's size.

    Batches go to Python many at a time: a call a batch cost more than its rows.
    """
    whole = rows.groupBy(F.col(group).cast("int").alias(group)).agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), F.col("length").cast("int").alias("length"))).alias("rows"))
    return whole.mapInArrow(partial(_balanced, parts), f"`{group}` int, id long, length int, part int")


def state_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows with shard: all rows of a state share one, by hash."""
    return rows.withColumn("shard", draw(shards, "shard", F.col("state_ref")))


def _filled(loads: list[int], room: int) -> list[int]:
    """How much of room each part gets so that the fullest ends as low as can be: the lowest parts are filled to one level."""
    order = sorted(range(len(loads)), key=lambda j: loads[j])
    level, k = loads[order[0]], 1
    left = room
    while k < len(order) and (loads[order[k]] - level) * k <= left:
        left -= (loads[order[k]] - level) * k
        level, k = loads[order[k]], k + 1
    share, rest = divmod(left, k)
    out = [0] * len(loads)
    for i, j in enumerate(order[:k]):
        out[j] = level - loads[j] + share + (i < rest)
    return out


def least_loaded_shards(rows: DataFrame, shards: int, seed: int = 1, fine: int = 16) -> DataFrame:
    """(state_ref, n, shard): all rows of a state in one shard, and shards of nearly equal numbers of rows.

    States that hold more than 1 / fine of a shard's mean, at most shards * fine, are dealt to the
    least loaded shard, the largest first; the others fill what is left, in hash order, by running
    sums. No shard exceeds the larger of 4/3 of the best and the filled level by more than one small state.
    """
    loads = written(rows.groupBy("state_ref").agg(F.count("*").alias("n")), "loads")
    total = loads.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * shards * fine > total
    placed, held = {}, [0] * shards
    for r in sorted(loads.filter(heavy).collect(), key=lambda r: (-r.n, r.state_ref)):  # fewer than shards * fine
        j = min(range(shards), key=held.__getitem__)
        placed[r.state_ref], held[j] = j, held[j] + r.n
    ends, before = [], 0
    for share in _filled(held, total - sum(held)):
        before += share
        ends.append(before)
    light = running_offsets(loads.filter(~heavy).withColumn("order_", order_key(seed, "shard", F.col("state_ref"))), "order_", "n", "at_")
    full = F.array(*[F.lit(e).cast("long") for e in ends])
    out = light.select("state_ref", "n", F.least(F.size(F.filter(full, lambda e: e <= F.col("at_"))), F.lit(shards - 1)).alias("shard"))
    if placed:
        dealt = loads.sparkSession.createDataFrame(list(placed.items()), "state_ref string, shard int")
        out = out.unionByName(loads.filter(heavy).join(dealt, "state_ref").select("state_ref", "n", "shard"))
    return out


def geometry_extrema(rows: DataFrame) -> DataFrame:
    """(criterion, id): the first rows with the most cells, the greatest height, the greatest width and the longest side over short side."""
    w = {"cells": F.col("h") * F.col("w"), "height": F.col("h"), "width": F.col("w"), "aspect": F.greatest("h", "w") / F.least("h", "w")}
    best = rows.agg(*[F.max_by("id", F.struct(v, -F.col("id"))).alias(k) for k, v in w.items()])
    return best.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(k).alias("id")) for k in w])).alias("x")).select("x.*")


def block_tokens(cells: DataFrame, bh: int, bw: int) -> DataFrame:
    """(state_ref, token, slot, z, mask): ceil-divided tiling in row-major order, missing cells as zeros with mask 0."""
    down, across = F.ceil(F.col("h") / bh).cast("int"), F.ceil(F.col("w") / bw).cast("int")
    frame = cells.select("state_ref", "h", "w").distinct().select("state_ref", "h", "w", across.alias("across"), F.explode(F.sequence(F.lit(0), down * across - 1)).alias("token"))
    slots = frame.select("state_ref", "token", "across", F.explode(F.sequence(F.lit(0), F.lit(bh * bw - 1))).alias("slot"))
    at = slots.select("state_ref", "token", "slot", (F.floor(F.col("token") / F.col("across")) * bh + F.floor(F.col("slot") / bw) + 1).cast("int").alias("r"), ((F.col("token") % F.col("across")) * bw + F.col("slot") % bw + 1).cast("int").alias("c"))
    return at.join(cells.select("state_ref", "r", "c", "z"), ["state_ref", "r", "c"], "left").select("state_ref", "token", "slot", F.coalesce("z", F.lit(0.0)).alias("z"), F.col("z").isNotNull().cast("int").alias("mask"))


def masked_smooth_l1(rows: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    d = F.abs(F.col(a) - F.col(b))
    loss = F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)
    return rows.agg((F.sum(loss * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1))).alias("loss"))


def value_basis(z: Column, frequencies: int = 2) -> list[Column]:
    """z, tanh z, |z|, sign z, and sine and cosine of 2**k pi z."""
    out = [z.alias("z"), F.tanh(z).alias("tanh"), F.abs(z).alias("abs"), F.signum(z).alias("sign")]
    for k in range(frequencies):
        out += [F.sin(z * (2.0**k * math.pi)).alias(f"sin{k}"), F.cos(z * (2.0**k * math.pi)).alias(f"cos{k}")]
    return out


def sinusoidal_positions(positions: DataFrame, dims: int, base: float = 10_000.0) -> DataFrame:
    """positions (p) with one sine and one cosine column per pair of dimensions."""
    out = [F.col("p")]
    for k in range(dims // 2):
        angle = F.col("p") / (base ** (2 * k / dims))
        out += [F.sin(angle).alias(f"sin{k}"), F.cos(angle).alias(f"cos{k}")]
    return positions.select(*out)


def efficiency(timings: DataFrame) -> DataFrame:
    """Per method, mode and bin: attempts, questions, statuses, throughput over all active time, quantiles of completed requests, means of executed ones, peaks."""
    done, ran = F.col("status").isin("complete", "fixed_length"), F.col("status").isin("complete", "fixed_length", "length_limit")
    seconds = F.sum("request_ms") / 1000
    when = lambda cond, c: F.when(cond, F.col(c))
    return timings.groupBy("method", "decode_mode", "bin").agg(
        F.count("*").alias("attempts"), F.countDistinct("qa_id").alias("unique_questions"), F.count(F.when(done, 1)).alias("completed"), F.count(F.when(F.col("status") == "length_limit", 1)).alias("length_limited"), F.count(F.when(F.col("status") == "oom", 1)).alias("out_of_memory"),
        F.try_divide(F.count(F.when(done, 1)), seconds).alias("completed_per_second"), F.try_divide(F.sum("generated_tokens"), seconds).alias("tokens_per_second"),
        F.percentile(when(done, "request_ms"), 0.5).alias("completed_p50_ms"), F.percentile(when(done, "request_ms"), 0.95).alias("completed_p95_ms"), F.avg(when(ran, "request_ms")).alias("request_ms_mean"), F.percentile(when(ran, "ttft_ms"), 0.5).alias("ttft_ms_p50"),
        F.avg(when(ran, "ttft_ms")).alias("ttft_ms_mean"), F.avg(when(ran, "generated_tokens")).alias("generated_tokens_mean"), F.max(when(ran, "peak_gib")).alias("peak_gib"), F.max(when(F.col("status") == "oom", "peak_gib")).alias("oom_peak_gib"),
    )


def paired_speed(timings: DataFrame, slow: str = "serialized", fast: str = "interface") -> DataFrame:
    """Per mode and bin: time of the slow method over the fast one's, on requests that both completed."""
    done = timings.filter(F.col("status").isin("complete", "fixed_length"))
    keys = ["decode_mode", "bin", "qa_id", "repeat"]
    side = lambda m, p: done.filter(F.col("method") == m).select(*keys, F.col("request_ms").alias(f"{p}_ms"), F.col("generated_tokens").alias(f"{p}_tokens"))
    j = side(slow, "slow").join(side(fast, "fast"), keys)
    return j.groupBy("decode_mode", "bin").agg(F.count("*").alias("pairs"), (F.sum("slow_ms") / F.sum("fast_ms")).alias("time_ratio"), F.avg("slow_tokens").alias("slow_tokens_mean"), F.avg("fast_tokens").alias("fast_tokens_mean"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("n_ = 1").drop("n_")


def in_order_of(rows: DataFrame, order: DataFrame, key: str = "qa_id", position: str = "pos") -> DataFrame:
    """rows with the position that order (key, position) gives them, sorted by it; rows without one are left out."""
    return rows.join(order.select(key, position), key).orderBy(position)
