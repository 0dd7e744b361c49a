"""From raw documents to packed sequences: quality rules, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its rows are
written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents. Only a document that a stage rejects is lost: one that fails the quality rules, is
scored toxic, or has a nearly equal document with a smaller doc_id. Secrets are replaced in place.

Every stage decides row by row, never by doc_id: rows with null or repeated ids are judged by their
own texts. Of rows that are equal in a class of near-duplicates one stays, null ids last. Null
texts have no words and fail the quality rules. Empty tables give no rows. Columns beyond those
of documents are dropped at the first stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldloom.llm import toxicity
from fieldloom.llm.common import discarding, materialize, read, small_batches, work_path
from fieldloom.llm.near_dup import near_dup_keepers
from fieldloom.llm.packing import pack
from fieldloom.llm.quality_rules import judge
from fieldloom.llm.secrets import redacted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can't fit the toxicity model or follow the curve; the pipeline is tested against its parts.
ORACLE_SQL = None


def row_key() -> Column:
    """SHA-256 over all columns of a row, each with its length: equal for equal rows only."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(part, COLUMNS)), 256))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs, read(spark, sf_dir, "labels"), carry=COLUMNS).filter("kept").select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, *toxicity.train(docs, read(spark, sf_dir, "labels")), carry=COLUMNS[1:])
    with small_batches(spark, 4 << 20):  # holds where it is written, and whole texts go through Python here
        return materialize(scored.filter("predicted = 0").select(*COLUMNS), "ordinary")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal rows share a key, so they are one before keys are compared."""
    keyed = docs.select(*COLUMNS, row_key().alias("key"))
    kept = materialize(near_dup_keepers(keyed, "key"), "keepers")
    return keyed.dropDuplicates(["key"]).join(kept.hint("merge"), "key", "left_semi").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span replaced; n_chars follows the changed texts."""
    return redacted(docs.select(*COLUMNS), count_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096, ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_dup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with discarding(spark):  # a stage's own tables go once its rows are written
            docs = materialize(stage(spark, docs, sf_dir), name, path=work_path(spark, name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
