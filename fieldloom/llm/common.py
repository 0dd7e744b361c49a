"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.tables import discarding as discarding, shared_folder as shared_folder, work_path as work_path, written as materialize

#: The six white-space characters that separate words (space, and tab to carriage return).
SPACES = "\\x20\\x09-\\x0D"


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of bounded bytes for what runs inside: by rows alone, JVM and Python would hold 10,000 texts of any length at once, or one that a join repeats."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: What this worker keeps for later tasks, by its key: one entry at most.
_state: dict[Hashable, Any] = {}


def worker_state(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gave for this key, kept for the worker's later tasks. A worker keeps one such state: Spark uses it again for other operators, and their states would add up."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


def without_state() -> None:
    """For tasks that keep nothing: drops what another operator left in this worker."""
    _state.clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the two columns an operator reads, null texts as empty; extra columns are dropped whatever their names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def rows_out(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def text_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold a bounded amount of text (one row at least), so that a run of very long texts stays small in memory."""
    for batch in batches:
        step = max(1, min(most_rows, most_bytes * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: monotonically_increasing_id() holds a row's place within its partition in as many lower bits.
PLACE_BITS = 33


def positioned(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `position`, from 0, along order over all rows: written in ranges of the order, so that no task sees more than a range.

    Where the order leaves ties, equal rows share a range; give it a last column that differs where these may be many.
    """
    at = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), name)
    at = at.withColumn("part_", F.shiftright("at_", PLACE_BITS))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("part_").agg(F.count("*").alias("n_"))  # a row per range
    bases = sizes.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    place = F.col("at_").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return at.join(F.broadcast(bases), "part_").withColumn("position", F.col("base_") + place).drop("at_", "part_", "base_")
