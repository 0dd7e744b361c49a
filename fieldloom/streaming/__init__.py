"""Scoring predictions as they arrive: an addition to the batch engine.

Deduplication and running totals live in Spark's keyed state, which a checkpoint keeps together with
the files that were read; a sink's batch folder is overwritten if its batch is tried again. So every
prediction counts once, whatever stops a run between or within batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring

PREDICTIONS = "qa_id string, prediction string, terminated boolean"


def arriving(spark: SparkSession, folder: str, files: int | None = None, horizon: str | None = None) -> DataFrame:
    """Predictions of the JSON files that land in folder, the first of each qa_id only, across all batches.

    The state holds every qa_id seen; with a horizon (such as "7 days") and a column `at` of times, only
    those of that long, and a repeat that comes later is a row again. files: most files a batch.
    """
    reader = spark.readStream.schema(PREDICTIONS + (", at timestamp" if horizon else ""))
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = reader.json(folder)
    if horizon is None:
        return rows.dropDuplicates(["qa_id"])
    return rows.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["qa_id"])


def score_stream(spark: SparkSession, records: DataFrame, folder: str, out: str, checkpoint: str, files: int | None = None, horizon: str | None = None) -> StreamingQuery:
    """Score predictions that land in folder, the first of each question, into out, a folder per batch (column batch).

    A batch that is tried again overwrites its own folder, so no row is there twice; rows without a
    record are dropped by the join.
    """

    def each(batch: DataFrame, number: int) -> None:
        known = records.join(batch.select("qa_id"), "qa_id", "left_semi")
        scored = scoring.score(known, batch.select("qa_id", "prediction", "terminated"))
        scored.select("qa_id", "task", "valid", "error", "units", "hits", "all_correct").write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = arriving(spark, folder, files, horizon)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals_stream(spark: SparkSession, records: DataFrame, folder: str, out: str, checkpoint: str, dims: tuple[str, ...] = ("task",), files: int | None = None, horizon: str | None = None) -> StreamingQuery:
    """Running totals of scored predictions by dims: questions, units, hits, valid and all-correct answers, as keyed state; out holds the state after each batch (a folder per batch), the last one the current totals.

    The scoring of a batch is a join with the static records inside the streaming plan, so that state and
    files advance together.
    """
    rows = arriving(spark, folder, files, horizon)
    named = rows.select("qa_id", "prediction", F.coalesce("terminated", F.lit(True)).alias("terminated"))
    scored = scoring.scored_pairs(named.join(records, "qa_id"))
    sums = scored.groupBy(*dims).agg(
        F.count("*").alias("questions"), F.sum("units").cast("long").alias("units"), F.sum("hits").cast("long").alias("hits"), F.sum(F.col("valid").cast("long")).alias("valid"), F.sum(F.col("all_correct").cast("long")).alias("all_correct"),
    )

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sums.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_totals(spark: SparkSession, out: str) -> DataFrame:
    """The totals after the last batch."""
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")
